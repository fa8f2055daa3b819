"""Sets of five-word shingles of whole texts, and the exact similarity of pairs of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.staging import stage

WIDTH, AT_LEAST = 5, 0.8
#: Bits of a set's sketch, as a power of two.
SKETCH = 11
#: Pairs that one group judges by sketches, on average; it holds at most two sketches of 256 bytes a pair.
GROUP = 1 << 15
#: Bits of the map of asked texts.
SLOTS = 1 << 25

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; words as in ``simhash.fingerprint``, fewer than ``width`` make one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    digests = np.fromiter((known[w] for w in words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ digests[k : k + len(out)]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Common part of two sorted sets over their union; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(members: np.ndarray) -> bytes:
    """A bit for each member of the set, by the first ``SKETCH`` bits of its hash; members may share one."""
    bits = np.zeros(1 << SKETCH, bool)
    bits[members >> np.uint64(64 - SKETCH)] = True
    return np.packbits(bits).tobytes()


def may_reach(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, at_least: float) -> np.ndarray:
    """Whether sets with sketches ``a`` and ``b`` (rows of uint64) and ``n`` and ``m`` members can be ``at_least`` similar.

    A bit that only one sketch has stands for at least one member that only its set has, so the
    common part is bounded from above and no pair that reaches ``at_least`` is refused.
    """
    common = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return common >= at_least * (n + m - common) - 1e-9


def _sketches(texts: DataFrame) -> DataFrame:
    """cid, n (members of the text's shingle set) and bits (their sketch), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [], []
            for text in batch.column("text"):
                members = shingle_set(text.as_py())
                sizes.append(len(members))
                bits.append(sketch(members))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["cid", "n", "bits"])

    return stage(texts.select("cid", "text").mapInArrow(run, "cid long, n long, bits binary"), "sketches")


def possible(pairs: DataFrame, sketches: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """(u, v) -> the pairs whose sketches (cid, n, bits) allow a similarity of ``at_least``, staged; none that reaches it is lost.

    Pairs are dealt by the blocks of both ends, so that a sketch travels once a group, not once a pair.
    """
    blocks = max(1, math.ceil(math.sqrt(2 * pairs.count() / GROUP)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    swap = block("u") > block("v")
    dealt = pairs.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"))
    dealt = dealt.select(block("u").alias("p"), block("v").alias("q"), "u", "v")
    end = lambda c: dealt.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col(c).alias("cid"))
    held = end("u").unionByName(end("v")).distinct().join(sketches, "cid").select("p2", "q2", "cid", "n", "bits")

    def run(pair: pa.Table, sketches: pa.Table) -> pa.Table:
        sketches = sketches.sort_by("cid")
        cid, n = sketches["cid"].to_numpy(), sketches["n"].to_numpy()
        bits = np.frombuffer(b"".join(sketches["bits"].to_pylist()), np.uint64).reshape(len(cid), -1)
        u, v = np.searchsorted(cid, pair["u"].to_numpy()), np.searchsorted(cid, pair["v"].to_numpy())
        good = [may_reach(bits[i], n[i], bits[j], n[j], at_least) for i, j in ((u[k : k + 8192], v[k : k + 8192]) for k in range(0, len(u), 8192))]
        return pair.select(["u", "v"]).filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return stage(dealt.groupBy("p", "q").cogroup(held.groupBy("p2", "q2")).applyInArrow(run, "u long, v long"), "possible")


def _asked_rows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose k1 may be one of ``asked``: all that are, and of others about one in SLOTS / asked.

    A map of a bit for each of SLOTS values goes to every task, 4 MB however many are asked, so that few texts travel in vain.
    """
    slot = F.pmod("k1", F.lit(SLOTS)) + 1
    parts = asked.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()  # SLOTS / 32768 rows at most
    width = 32768 // 8
    held = np.zeros(SLOTS // 8, np.uint8)
    for r in parts:
        held[(r["b"] - 1) * width : r["b"] * width] = np.frombuffer(r["m"], np.uint8)
    everywhere = docs.sparkSession.sparkContext.broadcast(held)

    def run(k1: pd.Series) -> pd.Series:
        at = k1.to_numpy() % SLOTS
        return pd.Series((everywhere.value[at >> 3] >> (at & 7) & 1).astype(bool))

    run.__annotations__ = {"k1": pd.Series, "return": pd.Series}
    return docs.where(F.pandas_udf(run, "boolean")("k1"))


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """(u, v) of class ids -> the pairs whose shingle sets have a similarity of ``at_least`` or more, staged.

    ``classes`` has cid, k1, k2, the hashes of a class's text, and n and bits, its sketch, if they are known;
    ``docs`` has k1, k2, text. Texts travel for pairs alone whose sketches allow that similarity; those are
    judged by the whole sets.
    """
    def texts_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).distinct()
        asked = stage(ends.join(classes.select("cid", "k1", "k2"), "cid"), "asked")
        return stage(_asked_rows(docs, asked).join(asked, ["k1", "k2"]).groupBy("cid").agg(F.min("text").alias("text")), "candidate-texts")

    sketches = classes.select("cid", "n", "bits") if "bits" in classes.columns else _sketches(texts_of(pairs))
    likely = possible(pairs, sketches, at_least)
    texts = texts_of(likely)
    side = lambda cid, text: texts.select(F.col("cid").alias(cid), F.col("text").alias(text))
    both = likely.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(64)(shingle_set)
        for batch in batches:
            good = [similarity(read(a.as_py()), read(b.as_py())) >= at_least for a, b in zip(batch.column("a"), batch.column("b"))]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return stage(both.sortWithinPartitions("u").mapInArrow(run, "u long, v long"), "shingle-links")
