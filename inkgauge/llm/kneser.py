"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted documents have a label of quality 1 and none of quality 0 or of toxicity. Two thirds of them
train the model; the others, which it hasn't seen, set each language's threshold, a quantile of
their scores. Documents stand in blocks that are written once, bucketed by block. The counts of the
model and the probabilities of the n-grams that blocks ask for are tables that joins go through;
neither goes to the driver or to every task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.columns import without
from inkgauge.llm.staging import new_path, stage, stage_alone

ORDER = 5
QUANTILE = 0.99
#: Judged rows from which a language has a threshold of its own: with fewer, the quantile is just their maximum.
MIN_JUDGED = 100
#: A score is the mean of -log p less this many standard errors, so that short texts aren't rejected on little evidence.
CAUTION = 2.0
#: Characters of a block (a longer document is a block of its own) and of what is worked on at once.
BLOCK_CHARS, SEGMENT_CHARS = 12_000_000, 500_000
#: At most this many of the most frequent n-grams go to every task, about 20 bytes each; all others go by joins.
COMMON = 1 << 18

_START = "\x02"
_STEP, _TURN, _NEAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(44)
BLOCKS = "bid long, doc_id array<long>, lang array<string>, tag array<long>, sizes array<long>, payload binary, grams array<string>"


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of codes, every step a bijection of what came before.

    Two of n different n-grams have the same hash with a chance of about n^2 / 2^65: 3 in a million for ten million n-grams of a block.
    """
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out ^= c
        out *= _STEP
        out ^= out >> _TURN
    return out


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of every window of ``order`` codes."""
    n = max(len(codes) - order + 1, 0)
    wide = codes.astype(np.uint64)
    return _mixed([wide[k : k + n] for k in range(order)])


def _windows(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one string with start marks; of each of their characters in turn: window's start, window's hash, text."""
    pad = _START * (order - 1)
    joined = pad + pad.join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(owner)) + owner * (order - 1)
    return joined, start, _hashes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), order)[start], owner


def _segments(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SEGMENT_CHARS characters together."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SEGMENT_CHARS:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _first_places(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """A place in ``found`` of each of ``wanted``, which are sorted, distinct and all there; only those that share 20 bits with one are sorted."""
    near = np.zeros(1 << 20, bool)
    near[wanted >> _NEAR] = True
    places = np.flatnonzero(near[found >> _NEAR])
    values = found[places]
    by = np.argsort(values)
    return places[by[np.searchsorted(values, wanted, sorter=by)]]


def _counted(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of any number of texts, with counts, a segment at a time; only n-grams that are new are cut out."""
    hashes, counts, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
    for a, b in _segments(texts):
        joined, start, found, _ = _windows(texts[a:b], order)
        h, c = np.unique(found, return_counts=True)  # without places it needs no stable sort
        at = np.searchsorted(hashes, h)
        known = np.zeros(len(h), bool)
        inside = at < len(hashes)
        known[inside] = hashes[at[inside]] == h[inside]
        counts[at[known]] += c[known]
        new = np.array([joined[i : i + order] for i in start[_first_places(found, h[~known])].tolist()], object)
        hashes, counts, grams = (np.insert(old, at[~known], more) for old, more in ((hashes, h[~known]), (counts, c[~known]), (grams, new)))
    return grams.tolist(), counts


class _Places:
    """Where values stand among sorted distinct keys: the first key of a value's leading bits, then on while keys are smaller."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(len(keys), 1).bit_length() + 1
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """``np.searchsorted(keys, values)``."""
        at = self.first[values >> self.shift]
        left = np.flatnonzero(self.keys[at] < values)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < values[left]]
        return at


def _open(payload: bytes, sizes: np.ndarray, asked: list[int] | None = None) -> list[str]:
    """The texts of a block, all of them or those asked for."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    ends = [0, *np.cumsum(sizes).tolist()]
    return [data[ends[i] : ends[i + 1]].decode("utf-8", "surrogatepass") for i in (range(len(sizes)) if asked is None else asked)]


def document_blocks(docs: DataFrame, order: int = ORDER, name: str | None = None) -> DataFrame:
    """The rows of ``docs`` in blocks, each with its texts compressed and its distinct n-grams.

    Written as a table bucketed by block, so that later joins on the block move only their other side.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        rows, texts, held = [], [], 0
        press = zstandard.ZstdCompressor(level=6)

        def row() -> pa.RecordBatch:
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            values = [(part << 32) + block, *map(list, zip(*rows)), [len(d) for d in data], press.compress(b"".join(data)), sorted(_counted(texts, order)[0])]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, lang, tag, text in zip(*(batch.column(i) for i in range(4))):
                text = text.as_py()
                if rows and held + len(text) > BLOCK_CHARS:
                    yield row()
                    rows, texts, held, block = [], [], 0, block + 1
                rows.append((doc_id.as_py(), lang.as_py(), tag.as_py()))
                texts.append(text)
                held += len(text)
        if rows:
            yield row()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(run, BLOCKS)
    name = name or f"blocks_{uuid.uuid4().hex}"
    made.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "bid").option("path", new_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id and train (false for the third that sets thresholds) of the trusted documents."""
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return by_id.where("quality = 1 and toxic = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("train"))


def gram_counts(blocks: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """g and c: the n-grams of the trusted documents that train, with counts."""
    places = blocks.select("bid", F.posexplode("doc_id").alias("pos", "doc_id")).join(trusted.where("train"), "doc_id").select(F.col("bid").alias("in"), "pos")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, counts = [], np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            texts = _open(left["payload"][0].as_py(), np.array(left["sizes"][0].as_py(), np.int64), right["pos"].to_pylist())
            grams, counts = _counted(texts, order)
        return pa.table({"g": pa.array(grams, pa.string()), "c": pa.array(counts, pa.int64())})

    parts = blocks.select("bid", "sizes", "payload").groupBy("bid").cogroup(places.groupBy("in")).applyInArrow(run, "g string, c long")
    return stage(parts.groupBy("g").agg(F.sum("c").alias("c")), "grams")


@dataclass
class Order:
    """The tables of one order: counts (g, c), contexts (h, total, gamma), and its three discounts."""

    counts: DataFrame
    contexts: DataFrame
    discounts: tuple[float, float, float]


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not all((n["n1"], n["n2"], n["n3"])):  # too few to estimate
        return 0.5, 0.75, 0.9
    y = n["n1"] / (n["n1"] + 2 * n["n2"])
    return tuple(min(max(k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"], 0.01), k - 0.01) for k in (1, 2, 3))


def model(grams: DataFrame, order: int = ORDER) -> list[Order]:
    """Orders 1 to ``order``: counts of the highest, continuation counts (distinct characters before) below."""
    tables, out = [grams], []
    for k in range(order - 1, 0, -1):
        tables.append(stage(tables[-1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")), f"grams{k}"))
    for k, counts in enumerate(reversed(tables), 1):
        d = _discounts(counts)
        mass = F.sum(F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))
        contexts = counts.groupBy(F.substring("g", 1, k - 1).alias("h")).agg(F.sum("c").alias("total"), mass.alias("mass"))
        out.append(Order(counts, stage(contexts.select("h", "total", (F.col("mass") / F.col("total")).alias("gamma")), f"contexts{k}"), d))
    return out


def probabilities(wanted: DataFrame, orders: list[Order]) -> DataFrame:
    """(g) distinct n-grams -> g, p: the probability of the last character after the others."""
    asked = [wanted]
    for k in range(len(orders) - 1, 0, -1):
        asked.append(asked[-1].select(F.substring("g", 2, k).alias("g")).distinct())
    known = orders[0].counts.count()
    lower: DataFrame | None = None
    for k, (want, o) in enumerate(zip(reversed(asked), orders), 1):
        d = F.when(F.col("c") == 1, o.discounts[0]).when(F.col("c") == 2, o.discounts[1]).otherwise(o.discounts[2])
        rows = want.withColumn("h", F.substring("g", 1, k - 1)).join(o.counts, "g", "left").join(o.contexts, "h", "left")
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / (known + 1)))
        else:
            rows = rows.withColumn("s", F.substring("g", 2, k - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise(F.coalesce((F.col("c") - d) / F.col("total"), F.lit(0.0)) + F.col("gamma") * F.col("q"))
        lower = stage(rows.select("g", p.alias("p")), f"p{k}")
    return lower


def common_grams(grams: DataFrame, most: int = COMMON) -> DataFrame:
    """The most frequent n-grams of the model, by a count from which on there are at most ``most``."""
    step = F.floor(F.log2("c") * 8)
    by_step = grams.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None  # a few hundred rows at most
    for r in by_step:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return grams.where(F.lit(False) if least is None else F.col("c") >= least).select("g")


def _keys(grams: list[str], order: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order)
    return _mixed([codes[:, k].astype(np.uint64) for k in range(order)])


def _sorted(grams: list[str], logp: np.ndarray, order: int) -> tuple[_Places, np.ndarray]:
    keys = _keys(grams, order)
    by = np.argsort(keys)
    return _Places(keys[by]), np.asarray(logp, np.float64)[by]


def block_scores(blocks: DataFrame, orders: list[Order]) -> DataFrame:
    """doc_id, lang, tag, n_chars, mean and score of every row of the blocks.

    Blocks ask for their own n-grams, but for those that are common everywhere, which every task has.
    """
    order = len(orders)
    common = stage(common_grams(orders[-1].counts), "common")
    asked = blocks.select("bid", F.explode("grams").alias("g")).join(F.broadcast(common), "g", "left_anti")  # COMMON rows at most
    p = probabilities(stage(asked.select("g").unionByName(common).distinct(), "wanted"), orders)
    logp = F.log("p").cast("float").alias("logp")
    known = p.join(F.broadcast(common), "g", "left_semi").select("g", logp).toPandas()
    everywhere = blocks.sparkSession.sparkContext.broadcast(_sorted(known["g"].tolist(), known["logp"], order))
    answers = asked.join(p.select("g", logp), "g").select(F.col("bid").alias("to"), "g", "logp")
    schema = "doc_id long, lang string, tag long, n_chars long, mean double, score double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        texts = _open(row["payload"], row["sizes"])
        keys, logp = _sorted(right["g"].tolist(), right["logp"], order)
        common, common_logp = everywhere.value

        def look(hashes: np.ndarray) -> np.ndarray:
            out = np.zeros(len(hashes))
            there = np.zeros(len(hashes), bool)
            if len(common_logp):
                at = np.minimum(common(hashes), len(common_logp) - 1)
                there = common.keys[at] == hashes
                out[there] = common_logp[at[there]]
            if not there.all():
                out[~there] = logp[keys(hashes[~there])]
            return out

        total, square = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in _segments(texts):
            _, _, hashes, owner = _windows(texts[a:b], order)
            if len(hashes):
                v = -look(hashes)
                total[a:b] = np.bincount(owner, v, b - a)
                square[a:b] = np.bincount(owner, v * v, b - a)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
        spread = np.sqrt(np.maximum(np.divide(square, n, out=np.zeros(len(n)), where=n > 0) - np.nan_to_num(mean) ** 2, 0))
        score = mean - CAUTION * np.divide(spread, np.sqrt(n), out=np.zeros(len(n)), where=n > 0)
        out = pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in row["doc_id"]], "Int64"), "lang": list(row["lang"]), "tag": row["tag"], "n_chars": n, "mean": mean, "score": score})
        return out.astype({"mean": object, "score": object}).where(out["n_chars"] > 0, out.assign(mean=None, score=None)) if (n == 0).any() else out

    return blocks.select("bid", "doc_id", "lang", "tag", "sizes", "payload").groupBy("bid").cogroup(answers.groupBy("to")).applyInPandas(run, schema)


def language_thresholds(judged: DataFrame, quantile: float = QUANTILE, least: int = MIN_JUDGED) -> tuple[DataFrame, DataFrame]:
    """(lang, score) of judged rows -> (_lang, threshold) by language, and one row with overall, the quantile of all.

    A language with ``least`` judged rows or more has the quantile of their scores. One with k rows, fewer,
    has their mean plus sqrt(1 + 1/k) times the pooled quantile of how far scores lie above their language's
    mean, each times sqrt(n / (n - 1)) for its language's n rows: the quantile of a new document of the
    language. Without any language of two rows there is no pooled quantile, and the overall one holds.
    """
    cut = lambda c: F.percentile_approx(c, F.lit(quantile), F.lit(10_000))
    stats = judged.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n"), F.avg("score").alias("center"), cut("score").alias("own"))
    above = judged.join(stats.where("n > 1"), F.col("lang").eqNullSafe(F.col("_lang"))).select(((F.col("score") - F.col("center")) * F.sqrt(F.col("n") / (F.col("n") - 1))).alias("above"))
    pooled = above.agg(cut("above").alias("pooled"))
    threshold = F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("center") + F.sqrt(1 + 1 / F.col("n")) * F.col("pooled"))
    return stats.join(F.broadcast(pooled)).select("_lang", threshold.alias("threshold")), judged.agg(cut("score").alias("overall"))  # one row


def quality_report(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_chars, perplexity, score, threshold, kept; and tag, the text's hash.

    A document stays if its score is at most its language's threshold (see ``language_thresholds``).
    A null lang is a language of its own. A language without trusted documents to set a threshold takes the threshold of all
    languages together; without any at all everything stays. Null and empty texts have null
    perplexity and score and stay. Repeated rows get the same verdict. Empty tables give empty
    tables; other columns are ignored. ``labels`` may name a document several times; null labels
    don't make it trusted.
    """
    name = f"blocks_{uuid.uuid4().hex}"
    trusted = stage(trusted_ids(labels), "trusted")

    def scored() -> DataFrame:
        blocks = document_blocks(docs, order, name)
        return block_scores(blocks, model(gram_counts(blocks, trusted, order), order))

    try:
        scores, _ = stage_alone(scored, docs.sparkSession, "scores")  # blocks, counts and probabilities go when it is written
    finally:
        docs.sparkSession.sql(f"drop table if exists {name}")  # the catalog's entry
    judged = scores.join(trusted.where("not train"), "doc_id", "left_semi").where("score is not null")
    thresholds, overall = language_thresholds(judged, quantile)
    rows = scores.join(thresholds, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall))  # one row
    threshold = F.coalesce("threshold", "overall")
    kept = F.coalesce(F.col("score") <= threshold, F.lit(True))
    return rows.select("doc_id", "lang", "n_chars", F.exp("mean").alias("perplexity"), "score", threshold.alias("threshold"), kept.alias("kept"), "tag")


def quality_filter(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``quality_report`` keeps, with all their columns.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives an empty table.
    """
    gone = stage(quality_report(docs, labels, order, quantile).where("not kept").select("doc_id", "tag").distinct(), "gone")
    return without(docs, gone, gone.limit(0))
