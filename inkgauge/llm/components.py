"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.staging import stage


def connected_components(edges: DataFrame, seed: int = 1) -> DataFrame:
    """(u long, v long) links -> (node long, root long), one row per node that has a link.

    Each round every node points to the smallest of itself and its neighbours under an order that
    a random XOR mask gives, the links are rewritten to what their ends point to, and loops and
    repeats go. A star needs two rounds under one mask and a chain about log(n) masks, so the mask
    changes every second round. The roots of the rounds are then followed with joins. Self-links
    and nulls are dropped; an empty table gives an empty table. ``root`` is some node of the
    component, not the smallest.
    """
    masks = random.Random(seed)
    left = stage(
        edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
        .where("u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    steps: list[DataFrame] = []
    mask = 0
    while not left.isEmpty():
        if len(steps) % 2 == 0:
            mask = masks.getrandbits(62)
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = stage(
            both.groupBy(F.col("u").alias("node"))
            .agg(F.min(F.col("v").bitwiseXOR(F.lit(mask))).alias("near"))
            .select("node", F.least(F.col("near"), F.col("node").bitwiseXOR(F.lit(mask))).bitwiseXOR(F.lit(mask)).alias("root")),
            "step",
        )
        steps.append(step)
        to_u = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = stage(
            left.join(to_u, "u").join(to_v, "v").where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct(),
            "links",
        )
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stage(found, "roots")
