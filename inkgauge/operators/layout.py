"""Words to lines: grouping by layout, reading order, and spacing by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = "page_id string, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"


def line_boxes(words: DataFrame) -> DataFrame:
    """page_id, block, par, line, confidence (mean of those not negative, of 1), box; lines from the top down."""
    g = words.groupBy("page_id", "block", "par", "line").agg(
        (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"),
        F.struct(F.min("left").alias("x"), F.min("top").alias("y"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("w"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("h")).alias("box"),
    )
    return g.withColumn("line_no", F.row_number().over(Window.partitionBy("page_id").orderBy("box.y", "block", "par", "line")) - 1)


def line_texts(words: DataFrame, how: str = "gap", ratio: float = 0.28) -> DataFrame:
    """page_id, block, par, line, text: words joined by spaces (``naive``), by nothing (``tight``), or by a space where the gap is wide (``gap``)."""
    keys = ["page_id", "block", "par", "line"]
    if how == "naive":
        piece = F.concat(F.when(F.col("prev").isNull(), "").otherwise(" "), F.col("text"))
    elif how == "tight":
        piece = F.col("text")
    else:
        piece = F.concat(F.when(F.col("left") - F.col("prev") > F.col("height") * ratio, " ").otherwise(""), F.col("text"))
    order = Window.partitionBy(*keys).orderBy("left", "word")
    w = words.withColumn("prev", F.lag(F.col("left") + F.col("width")).over(order)).withColumn("piece", piece)
    joined = w.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("left", "word", "piece"))).alias("l"))
    return joined.select(*keys, F.array_join(F.transform("l", lambda x: x["piece"]), "").alias("text"))


def reading_order(boxes: DataFrame, *keys: str, min_height: int = 0, most: int | None = None) -> DataFrame:
    """Boxes from the top, then from the left, numbered; a missing box counts as at the origin.

    ``most`` keeps the first few of a page, as a detector's limit does; it is off unless asked for.
    """
    y, x = F.coalesce(F.col("box.y"), F.lit(0)), F.coalesce(F.col("box.x"), F.lit(0))
    rows = boxes.where(F.coalesce(F.col("box.h"), F.lit(min_height)) >= min_height).withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy(y, x)) - 1)
    return rows if most is None else rows.where(F.col("line_no") < most)
