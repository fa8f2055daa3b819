"""Near duplicates by SimHash fingerprints, with pairs found by covering locality-sensitive hashing.

For radius r, every bit position gets a non-zero vector of r+1 bits. Each of the 2^(r+1)-1 non-zero
vectors v gives a mask: the bits whose vector has an odd inner product with v. Bits in which a pair
differs span at most r dimensions, so some v is orthogonal to all of them and its mask keeps none of
them: the pair has equal masked fingerprints in that table. No pair within the radius is missed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.columns import without
from inkgauge.llm.components import connected_components
from inkgauge.llm.shingles import AT_LEAST, links, may_reach, shingle_set, sketch
from inkgauge.llm.staging import stage, stage_alone

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once, to bound memory on very long texts.
_BLOCK = 1 << 16
#: Members up to which one task compares a bucket; larger buckets go by midpoints.
BUCKET_LIMIT = 1 << 14
#: Members up to which pairs of a bucket are compared without a search tree.
_SMALL = 24


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text as an unsigned 64-bit number.

    Words are runs without ASCII white space of the text with A-Z in lower case; shingles are
    ``width`` words joined by a space, repeats counted; fewer words make one shingle. A bit is set
    if it is set in over half of the shingles' XXH64 (seed 42). Null or wordless texts give 0.
    """
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at the six bytes of ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        upto = min(n, at + _BLOCK)
        hashes = np.fromiter(
            (digest(joined[i:j], 42) for i, j in zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist())),
            np.uint64,
            upto - at,
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, int] = {}
            fps = []
            for text in batch.column(1).to_pylist():
                if text not in seen:
                    seen[text] = _signed(fingerprint(text, width))
                fps.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 4) -> list[int]:
    """2^(radius+1)-1 masks such that any ``radius`` bits are all outside one of them."""
    rng = random.Random(seed)
    size = 1 << (radius + 1)
    vectors = [rng.randrange(1, size) for _ in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what ``members`` (distinct uint64) link within the radius, one per member at most."""
    waiting = np.arange(len(members))
    links: list[tuple[int, int]] = []
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            reached = np.zeros(len(waiting), bool)
            parent = np.zeros(len(waiting), np.int64)
            for i in front:
                near = ~reached & (np.bitwise_count(members[waiting] ^ members[i]) <= radius)
                parent[near] = i
                reached |= near
            front, new_parent = waiting[reached], parent[reached]
            waiting = waiting[~reached]
            links += zip(members[new_parent].view(np.int64).tolist(), members[front].view(np.int64).tolist())
    return links


def _bucket_links(table: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int, limit: int) -> pd.DataFrame:
    """Links among rows sorted by (table, key): members of the same bucket within the radius."""
    new = np.ones(len(fp), bool)
    new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    u, v, hot = [], [], []
    bits = fp.view(np.uint64)
    group = np.cumsum(new) - 1
    small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= _SMALL))
    for shift in range(1, _SMALL):
        left, right = small[:-shift], small[shift:]
        together = (group[left] == group[right]) & (right - left == shift)
        if not together.any():
            break
        left, right = left[together], right[together]
        near = np.bitwise_count(bits[left] ^ bits[right]) <= radius
        u.append(fp[left[near]])
        v.append(fp[right[near]])
    for at, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        if n > limit:
            hot.append(fp[at : at + n])
        elif links := spanning_links(bits[at : at + n], radius):
            a, b = zip(*links)
            u.append(np.array(a, np.int64))
            v.append(np.array(b, np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    pairs = pd.DataFrame({"u": join(u), "v": join(v)}).drop_duplicates()
    pairs["hot"] = False
    if hot:
        alone = np.unique(join(hot))
        pairs = pd.concat([pairs, pd.DataFrame({"u": alone, "v": alone, "hot": True})])
    return pairs


def fingerprint_links(fps: DataFrame, radius: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp) distinct fingerprints -> (u, v) links that connect all that lie within ``radius`` bits.

    Buckets of the covering tables are compared inside one task. A bucket with more than
    ``bucket_limit`` distinct fingerprints is not: its members link to all points within half the
    radius instead, where any two within the radius meet. Both ways are exact; neither lists pairs.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    dealt = tables.repartition("t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, over = None, None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            t, k, fp = pdf["t"].to_numpy(np.int32), pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
            if over == (t[0], k[0]) or len(fp) > bucket_limit and (t[0], k[0]) == (t[-1], k[-1]):
                same = (t == t[0]) & (k == k[0])
                over = (t[0], k[0])
                yield pd.DataFrame({"u": fp[same], "v": fp[same], "hot": True})
                t, k, fp = t[~same], k[~same], fp[~same]
            rest = None
            if len(fp):
                last = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1]) + 1 if ((t != t[-1]) | (k != k[-1])).any() else 0
                rest = pd.DataFrame({"fp": fp[last:], "t": t[last:], "key": k[last:]})
                yield _bucket_links(t[:last], k[:last], fp[:last], radius, bucket_limit)
        if rest is not None:
            yield _bucket_links(rest["t"].to_numpy(), rest["key"].to_numpy(), rest["fp"].to_numpy(), radius, bucket_limit)

    found = stage(dealt.mapInPandas(run, "u long, v long, hot boolean"), "bucket-links")
    links = found.where("not hot").select("u", "v")
    hot = found.where("hot").select("u").distinct()
    if hot.isEmpty():
        return links
    half = radius // 2
    flips = [0] + [1 << i for i in range(64)] if half == 1 else _flips(half)
    middle = hot.select("u", F.explode(F.array(*[F.col("u").bitwiseXOR(F.lit(_signed(m))) for m in flips])).alias("v"))
    if radius % 2:  # one end may lie a step further from the middle
        raise ValueError("radius must be even")
    return links.unionByName(middle.where("u <> v"))


def _flips(most: int) -> list[int]:
    found = {0}
    for _ in range(most):
        found |= {x ^ (1 << i) for x in found for i in range(64)}
    return sorted(found)


def near_duplicate_groups(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id that can be reached over fingerprints that differ in at
    most ``radius`` bits, the row itself included; equal fingerprints are linked. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Repeated rows stay repeated.
    A null doc_id has a row of its own and never names a component unless all its members are null.
    An empty table gives an empty table; other columns are ignored.
    """
    rows = stage(fingerprints(docs, width), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Seeds of the word fingerprints under which near duplicates are sought, and the differing bits that make two of them meet.
SEEDS, RADIUS = 4, 4
#: Differing bits of the fingerprints of word pairs up to which a pair that met is a candidate: 6 on average for pairs at 0.8, 32 for strangers.
ALIKE = 20
#: Members up to which all pairs of a bucket are candidates at once; larger ones begin with links that span them.
PAIRS = 16
#: Members of a block in which the rest of a family is compared, and blocks that one of fewer members is dealt into, if they have FEW each.
BLOCK, SPREAD, FEW = 2048, 8, 128

_SEED_MIX = np.random.default_rng(12).integers(1, 1 << 63, SEEDS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _STEP
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        total += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little"))


def word_fingerprints(text: str | None) -> list[int]:
    """SimHashes of a text's distinct words under each seed, and last that of its distinct word pairs; texts without words have zeros."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return [0] * (SEEDS + 1)
    digests = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    distinct = np.fromiter(digests.values(), np.uint64, len(digests))
    row = np.fromiter((digests[w] for w in words), np.uint64, len(words))
    pairs = np.unique(_mixed(row[:-1] * np.uint64(3) ^ row[1:])) if len(row) > 1 else _mixed(row)
    return [_majority(_mixed(distinct ^ mix)) for mix in _SEED_MIX] + [_majority(pairs)]


def _classes(rows: DataFrame) -> DataFrame:
    """cid, k1, k2, fps, like (the fingerprint of word pairs), n and bits (the sketch of its shingle set) of each distinct text, staged; two 64-bit hashes tell texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, bits = [], [], []
            for text in batch.column("text"):
                fps.append(word_fingerprints(text := text.as_py()))
                members = shingle_set(text)
                sizes.append(len(members))
                bits.append(sketch(members))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["k1", "k2", "fps", "n", "bits"])

    made = stage(rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, fps array<long>, n long, bits binary"), "word-fingerprints")
    each = made.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("fps", "n", "bits")])
    each = each.select("k1", "k2", F.slice("fps", 1, SEEDS).alias("fps"), F.element_at("fps", SEEDS + 1).alias("like"), "n", "bits")
    return stage(each.withColumn("cid", F.monotonically_increasing_id()), "classes")


_MASKS = [_signed(m) for m in covering_masks(RADIUS)]


def _key() -> Column:
    """A row's bucket in its table: it follows from the fingerprint, so it need not travel."""
    return F.col("fp").bitwiseAND(F.get(F.array(*map(F.lit, _MASKS)), F.col("t") % len(_MASKS)))


def _tables(classes: DataFrame) -> DataFrame:
    """t, cid, fp, like: every class in every covering table of every seed."""
    fps = classes.select("cid", "like", F.posexplode("fps").alias("s", "fp"))
    tables = fps.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(_MASKS) - 1))))
    return tables.select((F.col("s") * len(_MASKS) + F.col("m")).alias("t"), "cid", "fp", "like")


def _near(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether fingerprints a and b of words are within the radius and c and d of word pairs are alike."""
    return (np.bitwise_count(a ^ b) <= RADIUS) & (np.bitwise_count(c ^ d) <= ALIKE)


def _first_pairs(starts: list[int], cid: np.ndarray, fp: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Members of buckets -> all near pairs of small ones, and of others links that span what is near: rows u, v and whether the bucket is large, repeats left out."""
    u, v, large = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(starts, starts[1:]):
        if b - a < 2:
            continue
        c, f, l = cid[a:b], fp[a:b], like[a:b]  # noqa: E741
        if b - a <= PAIRS:
            i, j = np.nonzero(np.triu(_near(f[:, None], f[None, :], l[:, None], l[None, :]), 1))
            u.append(c[i])
            v.append(c[j])
            large.append(np.zeros(len(i), np.int64))
            continue
        waiting = np.argsort(c)
        while len(waiting):  # the least class of what is left, and all that is near it, and so on
            front, waiting = waiting[:1], waiting[1:]
            while len(front) and len(waiting):
                i, front = front[0], front[1:]
                near = _near(f[waiting], f[i], l[waiting], l[i])
                u.append(np.full(int(near.sum()), c[i]))
                v.append(c[waiting[near]])
                large.append(np.ones(len(v[-1]), np.int64))
                front, waiting = np.append(front, waiting[near]), waiting[~near]
    u, v = np.concatenate(u), np.concatenate(v)
    return np.unique(np.stack((np.minimum(u, v), np.maximum(u, v), np.concatenate(large))), axis=1)


def _candidate_pairs(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v: pairs of classes with a fingerprint within the radius, enough to span every bucket; and those of them that buckets of more than PAIRS members gave; staged."""
    dealt = tables.repartition("t", _key()).select("t", _key().alias("key"), "cid", "fp", "like").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        for batch in _with_end(batches):
            if batch is not None:
                held = [np.concatenate((h, batch.column(i).to_numpy().astype(np.int64))) for i, h in enumerate(held)]
            t, key, cid, fp, like = held
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            last = len(t) if batch is None or len(t) and (not len(new) and len(t) > BUCKET_LIMIT) else (int(new[-1]) if len(new) else 0)
            if last:
                found = _first_pairs([0, *new[new < last].tolist(), last], cid[:last], fp[:last].view(np.uint64), like[:last].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2] > 0)], ["u", "v", "large"])
                held = [h[last:] for h in held]

    found = dealt.mapInArrow(run, "u long, v long, large boolean").groupBy("u", "v").agg(F.max("large").alias("large"))
    found = stage(found, "candidates")
    return found.select("u", "v"), found.where("large").select("u", "v")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _other_pairs(classes: DataFrame, roots: DataFrame, large: DataFrame, at_least: float) -> DataFrame:
    """u, v: all near pairs whose sketches allow ``at_least`` and that share a bucket of more than PAIRS members but, so far, no component; staged.

    ``large`` spans what is near in those buckets, so the ends of such a pair are in one component of
    it, a family. Two within the radius share a bucket of some table, so a family's members are compared
    directly and each stands there once, not once a table. Families whose members have one root
    have no such pairs; others are dealt out as pairs of blocks.
    """
    families = connected_components(large).select(F.col("node").alias("cid"), F.col("root").alias("family"))
    placed = stage(families.join(roots, "cid"), "families")
    mixed = placed.groupBy("family").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.lit(SPREAD), F.ceil(F.col("n") / FEW))).cast("int")
    rows = placed.join(stage(mixed.select("family", blocks.alias("blocks")), "open-families"), "family")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(classes.select("cid", "like", "fps", "n", "bits"), "cid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "cid", "like", "root", "fps", "n", "bits")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cid, like, root, block, n = (table[c].to_numpy() for c in ("cid", "like", "root", "block", "n"))
        fps = table["fps"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cid), SEEDS)
        sketches = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(cid), -1)
        pairs, u, v = like.view(np.uint64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        apart = key[1].as_py() != key[2].as_py()
        for at in range(len(cid)):
            near = _near(fps[at + 1 :], fps[at], pairs[at + 1 :, None], pairs[at]).any(axis=1) & (root[at + 1 :] != root[at])
            if apart:
                near &= block[at + 1 :] != block[at]
            near = np.flatnonzero(near) + at + 1
            near = near[may_reach(sketches[at : at + 1], n[at : at + 1], sketches[near], n[near], at_least)]
            u.append(np.full(len(near), cid[at]))
            v.append(cid[near])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return stage(rows.groupBy("family", "b1", "b2").applyInArrow(run, "u long, v long"), "other-candidates")


def similar_groups(docs: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text) and root, equal for rows that links connect.

    Candidates are texts of which one of four SimHashes of their distinct words is within 4 bits,
    of which the covering tables miss none, and whose SimHashes of word pairs are within 20. A candidate is a link if the Jaccard similarity of the two whole sets
    of five-word shingles is ``at_least`` or more. Pairs within a bucket that are already connected
    need no look; all others get one, however large the bucket.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(4), text).alias("k2"), text.alias("text"))
    classes = _classes(rows)
    near, large = _candidate_pairs(_tables(classes))
    found = links(near, classes, rows, at_least)
    named = lambda roots: classes.select("cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"))
    roots = connected_components(found)
    more = _other_pairs(classes, stage(named(roots), "first-roots"), large, at_least)
    if not more.isEmpty():
        roots = connected_components(found.unionByName(links(more, classes, rows, at_least)))
    told = classes.select("cid", "k1", "k2").join(named(roots), "cid").select("k1", "k2", "root")
    return rows.select("doc_id", "k1", "k2").join(told, ["k1", "k2"])


def near_dedup(docs: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, that with the smallest doc_id (null last).

    Rows are near duplicates as ``similar_groups`` says; texts without words are one group. Of rows
    of the group with that doc_id one stays. Rows keep all their columns. An empty table gives an
    empty table.
    """
    groups, _ = stage_alone(lambda: similar_groups(docs, at_least), docs.sparkSession, "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = groups.groupBy("root").agg(F.min(order).alias("b"), F.count("*").alias("n")).where("n > 1")
    wins = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("k1") == F.col("b.k1")) & (F.col("k2") == F.col("b.k2"))
    judged = stage(groups.join(best, "root").select("doc_id", F.col("k1").alias("tag"), wins.alias("wins")), "judged")
    gone = stage(judged.where("not wins").select("doc_id", "tag").distinct(), "gone")
    repeated = stage(judged.where("wins").groupBy("doc_id", "tag").count().where("count > 1").select("doc_id", "tag"), "repeated")
    return without(docs, gone, repeated)
