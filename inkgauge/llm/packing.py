"""Best-fit packing by exact-complement hashing over the histogram of lengths.

Lengths are at most the capacity, so the whole plan is made on counts by length: for each length,
longest first, its gap to the capacity is looked up in an index of single lengths, sums of two and
sums of three, and combinations that fill it exactly are used as often as counts allow. What remains goes
by best fit, longest first, whole counts at a time. Pieces then take their places by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.encode import encoder, vocabulary_path
from inkgauge.llm.staging import stage

CAPACITY = 2048
Runs = tuple[tuple[int, int], ...]


def _runs(lengths: list[int]) -> Runs:
    out: list[tuple[int, int]] = []
    for x in lengths:
        out[-1:] = [(x, out[-1][1] + 1)] if out and out[-1][0] == x else [*out[-1:], (x, 1)]
    return tuple(out)


class SumIndex:
    """Which single lengths, pairs and triples have a given sum: made once, from the lengths that occur.

    ``pairs[s]`` are the longer lengths of pairs with sum s, ``triples[s]`` the longest lengths of triples, both longest first.
    """

    def __init__(self, lengths: np.ndarray, most: int):
        there = np.zeros(most + 1, bool)
        there[lengths[lengths <= most]] = True
        longest_first = np.flatnonzero(there)[::-1]
        self.pairs = [longest_first[(2 * longest_first >= s) & (longest_first < s)] for s in range(most + 1)]
        self.pairs = [a[there[s - a]] for s, a in enumerate(self.pairs)]
        least = np.array([a[-1] if len(a) else most + 1 for a in self.pairs])  # the pair's longer length, at least
        self.triples = [longest_first[(3 * longest_first >= s) & (longest_first < s)] for s in range(most + 1)]
        self.triples = [a[least[s - a] <= a] for s, a in enumerate(self.triples)]


def _exact(left: np.ndarray, capacity: int) -> list[tuple[int, Runs]]:
    """Use up combinations of at most four lengths with sum ``capacity``; ``left`` keeps what remains."""
    made: list[tuple[int, Runs]] = []
    spare = np.zeros_like(left)
    index = SumIndex(np.flatnonzero(left), capacity)

    def use(lengths: list[int]) -> None:
        runs = _runs(sorted(lengths, reverse=True))
        if times := min(left[x] // n for x, n in runs):
            for x, n in runs:
                left[x] -= n * times
            made.append((int(times), runs))

    def fillings(gap: int, long: int) -> Iterator[list[int]]:
        if gap <= long:
            yield [gap]
        for a in index.pairs[gap]:
            if a <= long:
                yield [int(a), gap - int(a)]
        for a in index.triples[gap]:
            if a <= long and left[a]:
                for b in index.pairs[gap - a]:
                    if b <= a:
                        yield [int(a), int(b), gap - int(a) - int(b)]
                        if not left[a]:
                            break

    for long in range(capacity, 0, -1):
        if left[long] and long == capacity:
            use([long])
        for filling in fillings(capacity - long, long) if 0 < long < capacity and left[long] else ():
            if all(left[x] for x in filling):
                use([long, *filling])
                if not left[long]:
                    break
        spare[long], left[long] = left[long], 0
    left += spare
    return made


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, Runs]]:
    """Best fit decreasing on counts; bins with the same contents are one group."""
    groups: list[list[tuple[int, Runs]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            gap = next((g for g in range(length, capacity) if groups[g]), capacity)
            bins, runs = groups[gap].pop() if groups[gap] else (count, ())
            each = gap // length
            full, part = min(bins, count // each), 0
            if full:
                groups[gap - each * length].append((full, (*runs, (length, each))))
            elif part := count:
                groups[gap - part * length].append((1, (*runs, (length, part))))
            used = full + bool(part)
            if runs and bins > used:
                groups[gap].append((bins - used, runs))
            count -= full * each + part
    return [g for at in groups for g in at]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Runs]]:
    """Counts by length (1 to ``capacity``) -> (how many sequences, their (length, times) runs)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made = _exact(left, capacity)
    return made + _best_fit(left, capacity)


def _places(made: list[tuple[int, Runs]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, times in a sequence, offset), in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, runs in made:
        offset = 0
        for length, times in runs:
            out.setdefault(length, []).append((used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's ids with ``end_id`` appended, cut only where longer than ``capacity``.

    doc_id, piece, start, length, ids_crc32, and the piece's rank among those of its length in its
    part; with_ids adds the ids as little-endian unsigned 32-bit integers. Written once.
    """
    vocabulary = vocabulary or vocabulary_path()
    names = ["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out, data = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(tool.encode(text.as_py()) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    out.append((part, seen[n], doc_id, k, at // 4, n, zlib.crc32(cut)))
                    seen[n] += 1
                    if with_ids:
                        data.append(bytes(cut))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return stage(rows.mapInArrow(run, schema + ", ids binary" * with_ids), "pieces")


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with part, rank and length -> the same with sequence_id and offset instead of part and rank.

    The driver gets one row per length, the plan has a bounded number of entries per length. What a
    task needs to know of the parts before it grows with the parts, so it goes by a shuffle of the
    narrow rows, not by a broadcast.
    """
    by_part = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = cut.join(stage(first, "first").hint("merge"), ["length", "part"]).withColumn("rank", F.col("first") + F.col("rank")).drop("first", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rows = places[x][np.searchsorted(places[x][:, 0], rank[at], "right") - 1]
                inside = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 1] + inside // rows[:, 2]
                offset[at] = rows[:, 3] + inside % rows[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its one piece is the end id. Repeated rows are packed each for
    itself, null doc_ids too. An empty table gives an empty table. Other columns are ignored.
    """
    out = assign(pieces(docs, vocabulary, end_id, capacity, with_ids), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> sequence_id, length, doc_ids and the sequence's ids; a sequence is bounded."""

    def run(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": [key[0]], "length": [len(ids)], "doc_ids": [pdf["doc_id"].tolist()], "ids": [ids.tolist()]})

    return packed.select("sequence_id", "offset", "doc_id", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id long, length long, doc_ids array<long>, ids array<long>")
