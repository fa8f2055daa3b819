"""Mixing sources to target weights, native: repetition rates and hash-seeded draws.

A source's target is its weight's part of the budget, at most ``most`` times its words; what a
source can't take is shared among the others by weight until none is above. That fixed point is
found in one pass: with sources in order of limit over weight, a source is at its limit as long as
the level (budget left / weight left) is above its ratio.

Each row is taken floor(rate) times, and once more if its hash-seeded draw is below its source's cut,
which lies where the words taken come nearest to the target: next to the fraction, from which it
differs by no more than chance makes the drawn words differ.

A row of null text has no words. A null source is a source of its own and comes last. Rows that are
equal in source, doc_id and text draw each for themselves. Sources without words have target 0 and
are not repeated. Empty tables give empty tables. Every figure is a function of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.columns import fresh, word_count
from inkgauge.llm.staging import stage

WEIGHTS = (3, 1, 2)
#: Ranges of draws in each of the two steps that find a source's cut.
RANGES = 4096
SHARE = 1.5
MOST = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) rows -> source, source_size, target (words), one row per source.

    The windows below have one row per source, not per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = totals.withColumn("place", place).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", "place")
    level = (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = (
        weighed.withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
    )
    open_level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return filled.withColumn("open", open_level).select(
        "source", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("open") * F.col("w"), F.lit(float("inf")))).alias("target")
    )


SAME = ("source", "doc_id", "tag", "nth")


def text_tag() -> F.Column:
    """What tells texts apart; null counts as empty."""
    return F.left(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(16))


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tag and nth of every row, written once; nth counts rows that are equal in doc_id, source and text."""
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), text_tag().alias("tag")), "sizes")
    return _numbered(rows, _repeated(rows))


def _repeated(rows: DataFrame) -> DataFrame:
    return stage(rows.groupBy("source", "doc_id", "tag").count().where("count > 1").drop("count"), "repeated")


def _numbered(rows: DataFrame, repeated: DataFrame, names: tuple[str, ...] = SAME) -> DataFrame:
    """``rows`` with nth: 0, but counted among rows that are equal in source, doc_id and tag; ``names`` are those columns'."""
    *same, nth = names
    if repeated.isEmpty():
        return rows.withColumn(nth, F.lit(0))
    named = repeated.select(*[F.col(c).alias(f"r_{name}") for c, name in zip(SAME, same)])
    one = F.lit(True)
    for c in same:
        one = one & rows[c].eqNullSafe(named[f"r_{c}"])
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))) - 1
    return rows.join(named, one, "left_anti").withColumn(nth, F.lit(0)).unionByName(rows.join(named, one, "left_semi").withColumn(nth, number))


def draw(seed: str = "mix", names: tuple[str, ...] = SAME) -> F.Column:
    """A number in [0, 1) that depends on the seed, the row's source, doc_id and text, and its number among equal rows alone."""
    parts = [F.lit(seed)] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cuts(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies of every row) and cut (rows drawn below it are taken once more), staged.

    A draw is below the fraction with a probability equal to it. The cut is moved from the fraction
    to where the words of the rows below it come nearest to the fraction of the source's words: by
    sums over 4096 ranges of draws, and over 4096 ranges inside the one where the words cross.
    Each step leaves one row per source.
    """
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    t = targets.withColumn("whole", F.floor(rate)).withColumn("need", (rate - F.floor(rate)) * F.col("source_size"))
    need = t.select(F.col("source").alias("s"), "need")
    found = need.withColumn("low", F.lit(0.0)).withColumn("below", F.lit(0).cast("long"))
    width = 1.0
    for _ in range(2):
        width /= RANGES
        known = stage(found, "cuts")
        inside = drawn.join(known, drawn["source"].eqNullSafe(known["s"])).where(F.col("u") >= F.col("low"))
        if width < 1.0 / RANGES:
            inside = inside.where(F.col("u") < F.col("low") + width * RANGES)
        sums = inside.groupBy("s", "need", "low", "below", F.floor((F.col("u") - F.col("low")) / width).alias("k")).agg(F.sum("size").alias("words"))
        so_far = F.col("below") + F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = sums.withColumn("before", so_far).where("before + words > need")  # from the range in which the words cross
        cross = ranges.groupBy("s", "need").agg(F.min(F.struct("k", "low", "before", "words")).alias("r"))
        found = cross.select("s", "need", (F.col("r.low") + F.col("r.k") * width).alias("low"), F.col("r.before").alias("below"), F.col("r.words").alias("words"))
    over = F.col("below") + F.col("words") - F.col("need") < F.col("need") - F.col("below")
    last = found.select("s", (F.col("low") + F.when(over, width).otherwise(0.0)).alias("cut"))
    both = t.join(last, t["source"].eqNullSafe(last["s"]), "left")
    return stage(both.select("source", "source_size", "target", "whole", F.when(F.col("need") > 0, F.coalesce("cut", F.lit(1.0))).otherwise(0.0).alias("cut")), "cuts")


def mix_counts(sizes: DataFrame, seed: str = "mix", **how: object) -> DataFrame:
    """The rows of ``document_sizes`` with source_size, target and copies."""
    drawn = sizes.withColumn("u", draw(seed))
    known = cuts(drawn, source_targets(sizes, **how)).withColumnRenamed("source", "s")
    joined = drawn.join(known, drawn["source"].eqNullSafe(known["s"])).drop("s")
    return joined.withColumn("copies", (F.col("whole") + (F.col("u") < F.col("cut")).cast("long")).cast("long"))


def mix_report(docs: DataFrame, **how: object) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    return mix_counts(document_sizes(docs), **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", **how: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    The rates are one staged row per source. Of rows equal in source, doc_id and text but not in
    other columns, it is open which are taken once more, but not how many. Null sources, empty
    texts and tables as in ``mix_report``.
    """
    sizes = document_sizes(docs)
    known = cuts(sizes.withColumn("u", draw(seed)), source_targets(sizes, **how))
    names = tuple(fresh(docs, f"_{c}") for c in SAME)
    u, n, s, whole, cut = (fresh(docs, f"_{c}") for c in ("u", "n", "s", "whole", "cut"))
    rows = docs.withColumns({names[0]: F.col("source").cast("string"), names[1]: F.col("doc_id").cast("long"), names[2]: text_tag()})
    rows = _numbered(rows, _repeated(sizes), names).withColumn(u, draw(seed, names))
    known = known.select(F.col("source").alias(s), F.col("whole").alias(whole), F.col("cut").alias(cut))
    joined = rows.join(known, rows[names[0]].eqNullSafe(known[s]))
    joined = joined.withColumn(n, (F.col(whole) + (F.col(u) < F.col(cut)).cast("long")).cast("int")).where(F.col(n) > 0)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


MIX_SQL = r"""
with d as (
  select doc_id, source, substr(md5(coalesce(text, '')), 1, 16) as tag,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
t as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w,
         row_number() over (order by source nulls last) as place, source_size * 2 as lim,
         cast(sum(source_size) over () as double) as total
  from t),
r as (select *, cast(lim as double) / w as ratio from w),
l as (
  select *, (total * cast(1.5 as double) - cast(coalesce(sum(lim) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0) as double))
            / cast(sum(w) over (order by ratio, place rows between current row and unbounded following) as double) as level
  from r),
g as (
  select *, least(cast(lim as double), coalesce(max(case when level <= ratio then level end) over () * w, cast('inf' as double))) as target
  from l),
m as (
  select d.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate
  from d join g on d.source is not distinct from g.source),
u as (
  select *, cast(concat('0x', substr(md5(concat_ws(':', 'mix', coalesce(source, ''), coalesce(cast(doc_id as varchar), ''), tag, cast(nth as varchar))), 1, 6)) as bigint) as k,
         (rate - floor(rate)) * source_size as need
  from (select *, row_number() over (partition by source, doc_id, tag) - 1 as nth from m)),
z as (select source, need, k, sum(size) as words from u group by source, need, k),
c as (select *, sum(words) over (partition by source order by k) - words as before from z),
x as (select source, min(k) as k, arg_min(before, k) as before, arg_min(words, k) as words, any_value(need) as need from c where before + words > need group by source),
e as (select source, k + case when before + words - need < need - before then 1 else 0 end as cut from x)
select u.doc_id, u.size, u.source_size, u.target,
       cast(u.size * (floor(u.rate) + case when u.need > 0 and u.k < coalesce(e.cut, 16777216) then 1 else 0 end) as bigint) as taken
from u left join e on u.source is not distinct from e.source
"""
