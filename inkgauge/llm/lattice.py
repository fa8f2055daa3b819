"""Near duplicates among vectors by lattice hashing, with candidates verified by cosine.

In each table a random projection takes a unit vector to eight dimensions, where it is decoded to
the nearest point of a scaled E8 lattice; the vector also probes the lattice cells next to it.
Vectors that are near in angle fall into the same or neighbouring cells of some table. Every
candidate pair's cosine is computed in double precision, so no link is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.components import connected_components
from inkgauge.llm.staging import stage

THRESHOLD = 0.98
#: Tables, lattice points that make a table's cell, cells that each vector probes in a table (its own first), and the lattice's scale.
TABLES, BLOCKS, PROBES, SCALE = 6, 2, 4, 0.5
#: Members of a cell that one task compares with each other; larger cells are dealt out in pairs of blocks.
MEMBERS = 512


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sum, by row."""
    y = np.rint(x)
    odd = (y.sum(axis=1).astype(np.int64) & 1) == 1
    gap = x - y
    worst = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(odd)
    y[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1.0, -1.0)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (D8 and D8 moved by a half in every coordinate), times two, as integers."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(better[:, None], 2 * half, 2 * whole).astype(np.int64)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: neighbours of the origin."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (-2, 2) for b in (-2, 2)]
    out = np.zeros((240, 8), np.int64)
    for k, (i, j, a, b) in enumerate(pairs):
        out[k, i], out[k, j] = a, b
    signs = np.array([[1 - 2 * (n >> i & 1) for i in range(8)] for n in range(256) if n.bit_count() % 2 == 0])
    out[112:] = signs
    return out


NEIGHBOURS = _shortest()


def projections(dimension: int, tables: int = TABLES, blocks: int = BLOCKS, seed: int = 8) -> np.ndarray:
    """(tables, blocks, dimension, 8) matrices with orthonormal columns where the dimension allows it."""
    rng = np.random.default_rng(seed)
    out = [np.linalg.qr(rng.standard_normal((max(dimension, 8), 8)))[0][:dimension] for _ in range(tables * blocks)]
    return np.array(out).reshape(tables, blocks, dimension, 8)


def cells(unit: np.ndarray, planes: np.ndarray, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(rows, tables, probes) hashes of the cells of unit vectors, the vector's own cell first.

    A table's cell is one lattice point per block; the probed cells have a neighbouring point in one
    block, and are those whose points are nearest to the vector.
    """
    tables, blocks = planes.shape[:2]
    mix = np.random.default_rng(88).integers(1, 1 << 62, (blocks, 8), dtype=np.int64) | 1
    out = np.zeros((len(unit), tables, probes), np.int64)
    stretch = np.sqrt(max(unit.shape[1], 8) / 8) / scale
    for t in range(tables):
        own, gain, moved = np.zeros(len(unit), np.int64), [], []
        for k in range(blocks):
            x = unit @ planes[t, k] * stretch
            point = nearest_e8(x)
            own += point @ mix[k]
            # |x - (point + s)|^2 = |x - point|^2 - 2 (x - point).s + 2: the nearest neighbours have the largest products
            gain.append((x - point / 2) @ (NEIGHBOURS.T / 2))
            moved.append(NEIGHBOURS @ mix[k])
        best = np.argsort(-np.hstack(gain), axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + np.concatenate(moved)[best]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array<double>), ok (label not null, vector with a direction) and the key of equal vectors; written once."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    return stage(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
        .withColumn("ok", F.coalesce(ok, F.lit(False)))
        .withColumn("k1", F.xxhash64("label", "v"))
        .withColumn("k2", F.xxhash64(F.lit(10), "v", "label")),
        "vectors",
    )


def _hashed(classes: DataFrame, tables: int, blocks: int, probes: int, scale: float) -> DataFrame:
    """cid, grp, n of the classes with unit (float64 bytes) and cells (tables x probes hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            units, found = [b""] * len(vectors), [b""] * len(vectors)
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.array([vectors[i] for i in at.tolist()], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if d not in planes:
                    planes[d] = projections(d, tables, blocks)
                for i, u, c in zip(at.tolist(), x, cells(x, planes[d], probes, scale)):
                    units[i], found[i] = u.tobytes(), c.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "grp", "n")), pa.array(units, pa.binary()), pa.array(found, pa.binary())], ["cid", "grp", "n", "unit", "cells"])

    rows = classes.select("cid", F.concat_ws("/", F.size("v").cast("string"), "label").alias("grp"), "n", "v")
    return stage(rows.mapInArrow(run, "cid long, grp string, n long, unit binary, cells binary"), "hashed")


def _cell_links(cid: np.ndarray, n: np.ndarray, unit: np.ndarray, cell: np.ndarray, own: np.ndarray, block: np.ndarray, table: int, split: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Members of one cell of one table -> the rows each links to that it meets first here, and a root for each.

    A pair meets in a cell if it is the own cell of one of them. It counts in the first table where
    it meets; where it meets in the own cells of both, in the own cell of the smaller cid.
    """
    order = np.argsort(cid, kind="stable")
    cid, n, unit, cell, own, block = (x[order] for x in (cid, n, unit, cell, own, block))
    k = len(cid)
    links, root = np.zeros(k, np.int64), np.arange(k)
    for at in range(0, k, 256):
        i, j = np.nonzero(unit[at : at + 256] @ unit.T >= threshold)
        i += at
        keep = (i < j) & (own[i] | own[j])
        if split:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        again = ~own[i] & (cell[j, table] == cell[i, table, :1]).any(axis=1)
        for t in range(table):
            again |= (cell[j, t] == cell[i, t, :1]).any(axis=1) | (cell[i, t] == cell[j, t, :1]).any(axis=1)
        i, j = i[~again], j[~again]
        links += np.bincount(i, n[j], k).astype(np.int64) + np.bincount(j, n[i], k).astype(np.int64)
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := root[root]).tolist() != root.tolist():
                root = up
    back = np.empty(k, np.int64)
    back[order] = links
    top = np.empty(k, np.int64)
    top[order] = cid[root]
    return back, top


def vector_links(hashed: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, members: int = MEMBERS) -> DataFrame:
    """Rows (u, v, links): v is null in rows that add to the number of rows u links to, else links is and u and v are connected.

    Cells in which nobody can meet go before vectors travel. A cell with more than ``members``
    classes is dealt out as pairs of blocks, so no task holds more than two blocks of it; no pair is
    left out or listed.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.int64)
                each = tables * probes
                rows = np.repeat(np.arange(batch.num_rows), each)
                t = np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), batch.num_rows)
                own = np.tile(np.arange(each) % probes == 0, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(rows)), batch.column("grp").take(pa.array(rows)), pa.array(t), pa.array(found), pa.array(own)], ["cid", "grp", "t", "cell", "own"])

    listed = hashed.select("cid", "grp", "cells").mapInArrow(entries, "cid long, grp string, t int, cell long, own boolean")
    met = listed.groupBy("grp", "t", "cell").agg(F.count("*").alias("size"), F.max("own").alias("any_own")).where("size > 1 and any_own").drop("any_own")
    asked = stage(listed.join(met, ["grp", "t", "cell"]), "met")
    blocks = F.ceil(F.col("size") / members).cast("int")
    dealt = (
        asked.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
        .select("cid", "grp", "t", "cell", "own", "block", "b1", "b2")
        .join(hashed.drop("grp"), "cid")
    )
    key = ["grp", "t", "cell", "b1", "b2"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def solve(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cid, n, t = (pdf[c].to_numpy(np.int64) for c in ("cid", "n", "t"))
        own, block = pdf["own"].to_numpy(bool), pdf["block"].to_numpy(np.int64)
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for c in key:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.append(np.flatnonzero(new), len(pdf)).tolist()
        b1, b2, unit, cell = pdf["b1"].to_numpy(), pdf["b2"].to_numpy(), pdf["unit"].tolist(), pdf["cells"].tolist()
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                u = np.frombuffer(b"".join(unit[a:b]), np.float64).reshape(b - a, -1)
                c = np.frombuffer(b"".join(cell[a:b]), np.int64).reshape(b - a, tables, probes)
                links, top = _cell_links(cid[a:b], n[a:b], u, c, own[a:b], block[a:b], int(t[a]), bool(b1[a] != b2[a]), threshold)
                yield cid[a:b], links, top

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ending = np.ones(len(pdf), bool)
            for c in key:
                ending &= (pdf[c] == pdf[c].iloc[-1]).to_numpy() if len(pdf) else ending
            rest = pdf[ending]
            yield from told(pdf[~ending])
        if rest is not None:
            yield from told(rest)

    def told(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        for cid, links, top in solve(pdf):
            some = links > 0
            yield pd.DataFrame({"u": cid[some], "v": pd.array([None] * int(some.sum()), "Int64"), "links": pd.array(links[some], "Int64")})
            moved = top != cid
            yield pd.DataFrame({"u": cid[moved], "v": pd.array(top[moved], "Int64"), "links": pd.array([None] * int(moved.sum()), "Int64")})

    return stage(dealt.mapInPandas(run, "u long, v long, links long"), "vector-links")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are compared only when their labels are equal and not null and they have equally many
    components; null, empty and zero vectors and those with null or non-finite components link with
    nothing. Equal vectors are one class that is compared once. n_links counts rows, repeated rows
    included. component_id is the smallest vec_id that can be reached; a row that links with nothing
    has its own. A null vec_id is never the smallest unless alone, and is kept only then. An empty
    table gives an empty table; other columns are ignored.
    """
    rows = usable(vectors)
    classes = stage(
        rows.where("ok").groupBy("k1", "k2")
        .agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    found = vector_links(_hashed(classes, tables, blocks, probes, scale), threshold, tables, probes)
    more = found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("more"))
    roots = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "cid")
    named = classes.select("k1", "k2", "cid", "first", "n").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = named.join(smallest, "root").join(more, "cid", "left").select("k1", "k2", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("ok").select("vec_id", "k1", "k2").join(told, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


NEAR_SQL = """
with recursive ok as (
  select vec_id, label, [cast(x as double) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
link as (
  select a.vec_id as u, b.vec_id as v from ok a join ok b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (
  select vec_id as u, vec_id as v from embeddings
  union
  select r.u, l.v from reach r join link l on l.u = r.v),
low as (select u, min(v) as component_id from reach group by u),
cnt as (select u, count(*) as n from link group by u)
select e.vec_id, coalesce(cnt.n, 0) as n_links, low.component_id, e.vec_id = low.component_id as kept
from embeddings e join low on low.u = e.vec_id left join cnt on cnt.u = e.vec_id
"""
