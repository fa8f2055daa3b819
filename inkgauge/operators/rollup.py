"""Runs, progress and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import text as tx

STALE_SECONDS = 300


def run_order(runs: DataFrame) -> DataFrame:
    """started_at, rank: runs in order of their stamps; rows without one are left out. One row per run."""
    stamps = runs.select("started_at").where("started_at <> ''").distinct()
    return stamps.withColumn("rank", F.dense_rank().over(Window.orderBy("started_at")))


def run_totals(engines: Column) -> Column:
    """struct(lines, failures) over engines that weren't skipped."""
    ran = F.filter(engines, lambda e: ~F.coalesce(e["skipped"], F.lit(False)))
    add = lambda f: F.aggregate(ran, F.lit(0), lambda s, e: s + F.coalesce(e[f], F.lit(0)))
    return F.struct(add("lines").alias("lines"), add("failures").alias("failures"))


def run_summary(runs: DataFrame) -> DataFrame:
    """started_at, pages, lines, failures, minutes, completed and a line of text."""
    t = runs.withColumn("t", run_totals(F.col("engines"))).withColumn("minutes", F.col("duration_s") / 60)
    said = F.format_string("%d pages, %d lines, %d failures, %.1f min", F.coalesce("pages", F.lit(0)), F.col("t.lines"), F.col("t.failures"), F.coalesce("minutes", F.lit(0.0)))
    return t.select("started_at", "pages", F.col("t.lines").alias("lines"), F.col("t.failures").alias("failures"), "minutes", "completed", said.alias("summary"))


def age_seconds(updated_at: Column, now: Column | None = None) -> Column:
    """Seconds since a stamp; null for one that can't be read."""
    at = F.try_to_timestamp(updated_at)
    return (F.current_timestamp() if now is None else now).cast("double") - at.cast("double")


def progress(status: DataFrame, now: Column | None = None) -> DataFrame:
    """Status rows with engine_fraction, overall_fraction, eta_seconds, stale and running."""
    over = lambda a, b: F.coalesce(F.least(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double")), F.lit(1.0)), F.lit(0.0))
    done, total, n, k = F.col("done"), F.col("total"), F.col("engines"), F.col("engine_no")
    left = (total - done) + (n - k - 1) * total
    stale = F.coalesce(age_seconds(F.col("updated_at"), now) > STALE_SECONDS, F.lit(False))
    finished = F.coalesce("finished", F.lit(False))
    return status.withColumns({"engine_fraction": over(done, total), "overall_fraction": over(k * total + done, n * total), "eta_seconds": F.when(F.col("last_seconds") > 0, F.col("last_seconds") * left), "stale": stale, "running": ~finished & ~stale})


def text_stats(text: Column) -> Column:
    """struct(lines, chars, thai, thai_digits, arabic_digits) of a page's text."""
    return F.struct(F.size(tx.split_lines(text)).cast("long").alias("lines"), F.length(text).cast("long").alias("chars"), tx.thai_chars(text).alias("thai"), tx.thai_digits(text).alias("thai_digits"), tx.arabic_digits(text).alias("arabic_digits"))


def document_overview(pages: DataFrame) -> DataFrame:
    """doc, pages, first page's size, text characters, upright pages."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.min_by(F.struct("width", "height"), "page_no").alias("size"), F.sum("text_chars").alias("text_chars"), F.count_if("portrait").alias("portrait"))


def inventory(lines: DataFrame) -> DataFrame:
    """engine, pages, lines, chars, thai_digits: what each reader gave."""
    return lines.groupBy("engine").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum(tx.thai_digits(F.col("text"))).alias("thai_digits"))


def histogram(values: DataFrame, column: str, edges: list[float], *keys: str) -> DataFrame:
    """keys, bucket, n, cumulative share: counts between edges."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col(column) >= e).cast("int")
    n = values.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return n.withColumn("share", F.sum("n").over(w.orderBy("bucket")) / F.sum("n").over(w))
