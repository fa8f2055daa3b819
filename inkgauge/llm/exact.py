"""Exact deduplication, native: frequent digests are settled on the map side, the rest by a shuffle.

Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the
row with the most code points, then the smallest doc_id (null last), then the least hash of the text
stays. Which of fully tied rows stays is open, but exactly one does. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.columns import ASCII_SPACE, tag, without
from inkgauge.llm.staging import stage

#: A digest with at least this share of the rows is found as frequent; at most 1/SUPPORT digests are.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, ""), 256)


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, sha, len and tag of every row, written once: later steps don't read texts again."""
    return stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha"), code_points(F.col("text")).alias("len"), tag(F.col("text")).alias("tag")),
        "digests",
    )


def _best(rows: DataFrame) -> DataFrame:
    """sha, size, keep_id, keep_tag, keep_len of each digest: combined where rows are read, so copies never gather in a task."""
    best = rows.groupBy("sha").agg(
        F.count("*").alias("size"),
        F.min(F.struct((-F.col("len")).alias("neg"), F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("best"),
    )
    return best.select("sha", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), (-F.col("best.neg")).alias("keep_len"))


def frequent_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """sha, size, keep_id, keep_tag, keep_len of the frequent digests: 1/support rows at most.

    ``freqItems`` is the Misra-Gries sketch: it misses no digest above the support but may name
    rarer ones. One more pass counts the named ones exactly and finds the row that stays; those
    that occur once are dropped.
    """
    named = rows.stat.freqItems(["sha"], support).select(F.explode("sha_freqItems").alias("sha"))
    hot = rows.join(F.broadcast(named), "sha")  # at most 1/support rows by the sketch's own bound
    return stage(_best(hot).where("size > 1"), "winners")


def _judged(rows: DataFrame, support: float) -> DataFrame:
    """``rows`` with size, keep_id and wins: frequent digests by a broadcast, the rest by a shuffle of narrow rows."""
    winners = frequent_winners(rows, support)
    hot = rows.join(F.broadcast(winners), "sha")  # 1/support rows
    rest = rows.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    judged = hot.unionByName(rest.join(_best(rest), "sha"), allowMissingColumns=True)
    return judged.withColumn("wins", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")) & (F.col("tag") == F.col("keep_tag")))


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null, empty and blank texts are equal to each other. Fully tied rows are counted, and one of them is kept.
    """
    judged = _judged(narrow(docs), support)
    losers = judged.where("not wins").select("doc_id", "keep_id", "size", F.lit(False).alias("kept"), "sha")
    tied = judged.where("wins").groupBy("doc_id", "keep_id", "size", "sha").agg(F.count("*").alias("n"))
    won = tied.select("doc_id", "keep_id", "size", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda i: i == 1)).alias("kept"), "sha")
    return losers.unionByName(won).withColumnsRenamed({"size": "group_size", "sha": "text_sha256"})


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts, as in ``exact_groups``.

    All is decided on narrow rows; the ids of those that go are staged, and texts are passed by them
    once. Null and empty texts are one group, of fully tied rows an open one stays, an empty table
    gives an empty table, and any other column keeps its name and values.
    """
    judged = stage(_judged(narrow(docs), support), "judged")
    gone = stage(judged.where("not wins").select("doc_id", "tag").distinct(), "gone")
    repeated = stage(judged.where("wins").groupBy("doc_id", "tag").count().where("count > 1").select("doc_id", "tag"), "repeated")
    return without(docs, gone, repeated)


EXACT_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by len desc, doc_id nulls last) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by len desc, doc_id nulls last) = 1 as kept,
       text_sha256
from n
"""
