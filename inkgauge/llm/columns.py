"""Small column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space of the word and text rules: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def spread(*keys: str) -> Column:
    """A number in [0, 1) that depends on the keys, for bounded samples."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) / F.lit(float(1 << 31))


def tag(text: Column) -> Column:
    """A hash that, with the doc_id, tells a row from others; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, tag) isn't in ``gone``, and one row of each that is in ``repeated``.

    Both are staged tables, so Spark knows their sizes and broadcasts small ones; texts are shuffled only past that.
    """
    key, mark, rank = fresh(docs, "_tag"), fresh(docs, "_gone_tag"), fresh(docs, "_rank")
    rows = docs.withColumn(key, tag(F.col("text")))

    def side(df: DataFrame, how: str) -> DataFrame:
        ids = df.select(F.col("doc_id").alias(f"{mark}_id"), F.col("tag").alias(mark))
        return rows.join(ids, rows["doc_id"].cast("long").eqNullSafe(ids[f"{mark}_id"]) & (rows[key] == ids[mark]), how)

    if repeated.isEmpty():
        return side(gone, "left_anti").drop(key)
    order = Window.partitionBy("doc_id", key).orderBy(F.lit(1))
    one = side(repeated, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return side(gone.unionByName(repeated), "left_anti").unionByName(one).drop(key)
