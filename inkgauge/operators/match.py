"""Matching the lines of a page as truth has them with the lines a reader gave.

Long tables are (engine, page_id, line_no, text); nothing joins across pages. ``align`` goes from
what is cheap to what is dear: equal lines, like lines by distances and one ordered pass, lines that a
reader merged by best windows, and last the cutting of merged lines. Usual pages are matched whole
(``functions/pages.py``), very long ones as a plan whose steps spread a page over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions import text as tx
from inkgauge.functions.edits import best_window, edit_distance, like_pairs, normal_form, split_by_parts
from inkgauge.functions.pages import align_pages
from inkgauge.sources.staged import stage

#: Least similarity of a pair; least score of a line inside a longer one and how much longer that is; least similarity of a merged line.
THRESHOLD, WINDOW, LONGER, GROUP = 0.45, 80.0, 1.3, 0.7
#: Lines of a page that are compared with as many others at once; lines of a page above which it is spread over tasks.
BLOCK, LONG = 128, 4096
PAGE = ["engine", "page_id"]


def cheap_distance(a: Column, b: Column, first: int = 32, last: int = 16_384) -> Column:
    """``levenshtein``, at a cost that follows the distance: equal texts cost nothing, and the band around the diagonal is widened only until the distance fits."""
    bands, band = [], first
    while band <= last:
        bands.append(F.nullif(F.levenshtein(a, b, band), F.lit(-1)))
        band *= 8
    return F.when(a == b, 0).otherwise(F.coalesce(*bands, F.levenshtein(a, b))).cast("long")


def any_distance(a: Column, b: Column) -> Column:
    """``levenshtein`` of texts of any length: those that differ are counted in batches by machine words."""
    differ = a != b
    return F.when(a == b, 0).otherwise(edit_distance(F.when(differ, a), F.when(differ, b))).cast("long")


def text_similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - cheap_distance(a, b) / F.nullif(longer, F.lit(0)))


def _blocks(lines: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """Lines in blocks of at most ``most`` of a page: keys, ``name`` (the block's number), no and text (arrays)."""
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1) / F.lit(most)
    l = F.array_sort(F.collect_list(F.struct("line_no", "norm")))  # noqa: E741
    got = lines.where("norm <> ''").select(*keys, F.col("line_no").cast("int").alias("line_no"), "norm", F.floor(place).cast("int").alias(name))
    return got.groupBy(*keys, name).agg(l.alias("l")).select(*keys, name, F.transform("l", lambda x: x["line_no"]).alias("no"), F.transform("l", lambda x: x["norm"]).alias("text"))


def candidates(truth: DataFrame, reads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """engine, page_id, truth_no, read_no, similarity of all pairs of non-empty lines of a page at or above the threshold.

    ``truth`` has page_id, line_no, norm, or engine too if its lines differ by reader; ``reads`` has
    engine. Blocks of lines meet, so a page of any length is spread over tasks and no pair is listed
    before it is known to be alike.
    """
    keys = [c for c in PAGE if c in truth.columns]
    t, r = _blocks(truth, keys, BLOCK, "a"), _blocks(reads, PAGE, BLOCK, "b")
    parts = t.groupBy(*keys).agg((F.max("a") + 1).alias("parts"))
    spread = r.join(parts, keys).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*PAGE, "a", "b", F.col("no").alias("rno"), F.col("text").alias("rtext"))
    met = t.join(spread, [*keys, "a"]).repartition("page_id", "a", "b")  # readers of a page often have the same texts
    return met.select(*PAGE, F.inline(like_pairs(F.col("no"), F.col("text"), F.col("rno"), F.col("rtext"), threshold)))


def _any_text(lines: DataFrame) -> Column:
    """Lines that aren't blank, told by their texts if there are any: a filter on a normal form has it made twice."""
    return tx.has_text(F.col("text")) if "text" in lines.columns else F.col("norm") != ""


def equal_pairs(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """The pairs that a greedy match takes among equal lines: the last with the last, and so on down."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line_no")))
    t = truth.where(_any_text(truth)).withColumn("k", rank("page_id", "norm")).select("page_id", "norm", "k", F.col("line_no").alias("truth_no"))
    r = reads.where(_any_text(reads)).withColumn("k", rank("engine", "page_id", "norm")).select("engine", "page_id", "norm", "k", F.col("line_no").alias("read_no"))
    return t.join(r, ["page_id", "norm", "k"]).select("engine", "page_id", "truth_no", "read_no")


def mutual_best(pairs: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """The greedy one-to-one match of scored pairs (engine, page_id, truth_no, read_no, similarity), as a loop of joins.

    Order: higher similarity, then larger truth_no, then larger read_no. A pair that is first for
    both its lines is one that greedy takes; taken lines leave and the rest goes on. For pages of
    any size, as no task needs a whole page; ``best_first`` is the cheaper way for usual ones.
    """
    order = [F.desc("similarity"), F.desc("truth_no"), F.desc("read_no")]
    left, taken, rounds = stage(pairs, "pairs"), None, 0
    while most_rounds is None or rounds < most_rounds:
        for_truth = F.row_number().over(Window.partitionBy(*PAGE, "truth_no").orderBy(*order))
        for_read = F.row_number().over(Window.partitionBy(*PAGE, "read_no").orderBy(*order))
        ranked = left.withColumn("a", for_truth).withColumn("b", for_read)
        won = stage(ranked.where("a = 1 and b = 1").select(*PAGE, "truth_no", "read_no", "similarity"), "won")
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        left = stage(
            left.join(won.select(*PAGE, "truth_no"), [*PAGE, "truth_no"], "left_anti")
            .join(won.select(*PAGE, "read_no"), [*PAGE, "read_no"], "left_anti"),
            "left",
        )
        rounds += 1
    return pairs.limit(0) if taken is None else taken


def best_first(pairs: DataFrame) -> DataFrame:
    """The same match in one pass over the pairs of each page, best first; a task remembers the lines its current page has used."""
    schema = pairs.select(*PAGE, "truth_no", "read_no").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, gone = None, (set(), set())
        for batch in batches:
            free = []
            for engine, page_id, t, r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (engine, page_id) != page:
                    page, gone = (engine, page_id), (set(), set())
                free.append(t not in gone[0] and r not in gone[1])
                if free[-1]:
                    gone[0].add(t)
                    gone[1].add(r)
            yield batch.select(range(4)).filter(pa.array(free, pa.bool_()))

    ordered = pairs.repartition(*PAGE).sortWithinPartitions(*PAGE, F.desc("similarity"), F.desc("truth_no"), F.desc("read_no"))
    return ordered.select(*PAGE, "truth_no", "read_no", "similarity").mapInArrow(run, schema)


def _settled(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """engine, page_id, side (0 truth, 1 read), no, text, norm, mate: all lines that aren't blank, with the equal line of the other side."""
    def side(df: DataFrame, k: int) -> DataFrame:
        form = F.col("norm") if "norm" in df.columns else normal_form(F.col("text"))
        return df.where(tx.has_text(F.col("text"))).select(*[c for c in PAGE if c in df.columns], F.lit(k).alias("side"), F.col("line_no").cast("int").alias("no"), "text", form.alias("norm"))

    engines = reads.select(*PAGE).distinct()
    lines = side(truth, 0).join(engines, "page_id").unionByName(side(reads, 1)).repartition(*PAGE, "norm")
    ranked = lines.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "norm", "side").orderBy(F.desc("no"))))
    same = Window.partitionBy(*PAGE, "norm", "k")
    other = F.max(F.when(F.col("side") == 1, F.col("no"))).over(same), F.max(F.when(F.col("side") == 0, F.col("no"))).over(same)
    return stage(ranked.withColumn("mate", F.when(F.col("side") == 0, other[0]).otherwise(other[1])).drop("k"), "lines")


def _holders(alone: DataFrame, reads: DataFrame) -> DataFrame:
    """engine, page_id, truth_no, held: the longer read that best holds an unmatched truth line, the first of equals.

    A read that holds the line as it is has the best score there is, so windows are scored only for lines without one.
    """
    met = alone.join(reads, PAGE).where(F.length("r") > LONGER * F.length("t")).withColumn("whole", F.when(F.col("r").contains(F.col("t")), F.col("read_no")))
    met = met.withColumn("first", F.min("whole").over(Window.partitionBy(*PAGE, "truth_no"))).where("first is null or whole = first")
    loose = F.col("first").isNull()
    scored = met.withColumn("score", F.when(loose, best_window(F.when(loose, F.col("t")), F.when(loose, F.col("r")), WINDOW)).otherwise(100.0))
    best = scored.where(F.col("score") > WINDOW).groupBy(*PAGE, "truth_no").agg(F.max(F.struct("score", (-F.col("read_no")).alias("first"))).alias("b"))
    return best.select(*PAGE, "truth_no", (-F.col("b.first")).alias("held"))


def _with_neighbours(held: DataFrame, found: DataFrame, truth: DataFrame, reads: DataFrame) -> DataFrame:
    """``held`` with lines whose neighbours both sit elsewhere moved to the neighbour's read that holds them better, if one holds them well.

    Lines are judged from the top, so a line sees where the one above went. Only runs of lines that
    no neighbour supports are scored again.
    """
    seats = found.select(*PAGE, "truth_no", F.col("read_no").alias("seat"), F.lit(False).alias("is_held"))
    seats = seats.unionByName(held.select(*PAGE, "truth_no", F.col("held").alias("seat"), F.lit(True).alias("is_held")))
    order = Window.partitionBy(*PAGE).orderBy("truth_no")
    beside = lambda step, k: F.when(step("truth_no").over(order) == F.col("truth_no") + k, step("seat").over(order))
    seen = seats.withColumn("before", beside(F.lag, -1)).withColumn("after", beside(F.lead, 1)).where("is_held")
    agrees = F.coalesce(F.col("seat") == F.col("before"), F.lit(False)) | F.coalesce(F.col("seat") == F.col("after"), F.lit(False))
    seen = seen.withColumn("agrees", agrees).drop("is_held")
    lonely = seen.where(~F.col("agrees")).withColumn("run", F.col("truth_no") - F.row_number().over(order))
    places = lonely.select(*PAGE, "run", F.explode(F.array("seat", "before", "after")).alias("read_no")).where("read_no is not null").distinct()
    scored = (
        lonely.select(*PAGE, "run", "truth_no").join(places, [*PAGE, "run"]).join(truth, [*PAGE, "truth_no"]).join(reads, [*PAGE, "read_no"])
        .withColumn("score", best_window(F.col("t"), F.col("r"), WINDOW))
        .groupBy(*PAGE, "run", "truth_no").agg(F.array_sort(F.collect_list(F.struct("read_no", "score"))).alias("scores"))
    )
    line = F.struct("truth_no", "seat", "before", "after", "scores")
    runs = lonely.join(scored, [*PAGE, "run", "truth_no"]).groupBy(*PAGE, "run").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    kind = "array<struct<truth_no:int,held:int>>"

    def step(done: Column, x: Column) -> Column:
        before = F.when(F.size(done) == 0, x["before"]).otherwise(F.element_at(done, -1)["held"])
        stays = F.coalesce((x["seat"] == before) | (x["seat"] == x["after"]), x["seat"] == before, x["seat"] == x["after"], F.lit(False))
        above, below = (F.coalesce(F.get(F.filter(x["scores"], lambda s: s["read_no"] == c), F.lit(0))["score"], F.lit(0.0)) for c in (before, x["after"]))
        moved = F.when(stays, x["seat"]).when((above > WINDOW) & (above >= below), before).when(below > WINDOW, x["after"]).otherwise(x["seat"])
        return F.concat(done, F.array(F.struct(x["truth_no"].alias("truth_no"), moved.alias("held"))))

    moved = runs.select(*PAGE, F.explode(F.aggregate("lines", F.array().cast(kind), step)).alias("x")).select(*PAGE, "x.truth_no", "x.held")
    return seen.where("agrees").select(*PAGE, "truth_no", F.col("seat").alias("held")).unionByName(moved)


def _cut(held: DataFrame, found: DataFrame, truth: DataFrame, reads: DataFrame) -> DataFrame:
    """engine, page_id, truth_no, read_no, piece: reads that hold several lines, cut, where the lines together are like the read."""
    members = held.select(*PAGE, "truth_no", F.col("held").alias("read_no"), F.lit(True).alias("is_held"))
    members = members.unionByName(found.select(*PAGE, "truth_no", "read_no", F.lit(False).alias("is_held")))
    groups = members.join(truth, [*PAGE, "truth_no"]).groupBy(*PAGE, "read_no").agg(F.max("is_held").alias("any_held"), F.array_sort(F.collect_list(F.struct("truth_no", "t"))).alias("l")).where("any_held")
    parts = F.transform("l", lambda x: x["t"])
    whole = groups.join(reads, [*PAGE, "read_no"]).withColumn("joined", F.array_join(parts, ""))
    whole = whole.repartition("page_id", "read_no").sortWithinPartitions("page_id", "read_no")  # readers of a page often have the same texts
    like = 1 - any_distance(F.col("joined"), F.col("r")) / F.greatest(F.length("joined"), F.length("r")) >= GROUP
    cut = whole.where(like).withColumn("pieces", split_by_parts(parts, F.col("text")))
    zipped = F.arrays_zip(F.transform("l", lambda x: x["truth_no"]).alias("truth_no"), F.col("pieces").alias("piece"))
    return cut.select(*PAGE, "read_no", F.explode(zipped).alias("x")).select(*PAGE, "x.truth_no", "read_no", "x.piece")


def _align_spread(truth: DataFrame, reads: DataFrame, threshold: float) -> DataFrame:
    """``align`` with t and p for pages of any length: a page's lines are spread over tasks, and the lines and what is matched are staged."""
    lines = _settled(truth, reads)
    t = lines.where("side = 0").select(*PAGE, F.col("no").alias("truth_no"), F.col("text").alias("truth"), F.col("norm").alias("t"), "mate")
    r = lines.where("side = 1").select(*PAGE, F.col("no").alias("read_no"), "text", F.col("norm").alias("r"), "mate")
    open_lines = lambda k: lines.where(f"side = {k} and mate is null").select(*PAGE, F.col("no").alias("line_no"), "norm")
    like = stage(best_first(candidates(open_lines(0), open_lines(1), threshold)), "like")
    found = t.where("mate is not null").select(*PAGE, "truth_no", F.col("mate").alias("read_no")).unionByName(like)
    own, whole = t.select(*PAGE, "truth_no", "t"), r.select(*PAGE, "read_no", "text", "r")
    alone = t.where("mate is null").select(*PAGE, "truth_no", "t").join(like, [*PAGE, "truth_no"], "left_anti")
    held = stage(_holders(alone, whole), "held")
    pieces = stage(_cut(_with_neighbours(held, found, own, whole), found, own, whole), "pieces")
    seats = found.join(pieces.select(*PAGE, "truth_no"), [*PAGE, "truth_no"], "left_anti").withColumn("piece", F.lit(None).cast("string")).unionByName(pieces)
    matched = t.drop("mate").join(seats, [*PAGE, "truth_no"], "left").join(whole, [*PAGE, "read_no"], "left")
    more = [F.col("t"), F.when(F.col("piece").isNull(), F.coalesce("r", F.lit(""))).alias("p")]
    rows = matched.select(*PAGE, "truth_no", "read_no", "truth", F.coalesce("piece", "text", F.lit("")).alias("read"), *more)
    spurious = whole.join(seats.select(*PAGE, "read_no").distinct(), [*PAGE, "read_no"], "left_anti")
    more = [F.lit("").alias("t"), F.col("r").alias("p")]
    return rows.unionByName(spurious.select(*PAGE, F.lit(None).cast("int").alias("truth_no"), "read_no", F.lit("").alias("truth"), F.col("text").alias("read"), *more))


def _by_page(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """page_id, engine, no, text of all lines, engine null for the truth; a page's rows follow each other. Tables that are spread by page already aren't shuffled."""
    own = truth.select("page_id", F.lit(None).cast("string").alias("engine"), F.col("line_no").cast("int").alias("no"), "text")
    lines = own.unionByName(reads.select("page_id", "engine", F.col("line_no").cast("int").alias("no"), "text"))
    return lines.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("engine", "no")))


def align(truth: DataFrame, reads: DataFrame, threshold: float = THRESHOLD, forms: bool = False, readers: list[str] | None = None) -> DataFrame:
    """engine, page_id, truth_no, read_no, truth, read: one row per truth line of each page an engine read, and per spurious read.

    ``truth`` has page_id, line_no, text; ``reads`` has engine, page_id, line_no, text. read_no is null for
    missed lines, truth_no for spurious ones. Lines that are blank in normal form take no
    part; neighbours are lines whose numbers follow each other. A page that an engine has no rows
    for gives no rows; with the names of all ``readers`` it gives its lines as missed, as ``with_missing`` does.
    A page is matched where its lines are, in one task, and nothing is staged; pages of more than ``LONG`` truth lines are spread over tasks.
    ``forms`` adds t and p, the normal forms of truth and read as far as they are known.
    """
    columns = [*PAGE, "truth_no", "read_no", "truth", "read", *(("t", "p") if forms else ())]
    long = stage(truth.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("page_id"), "long")
    spread = None
    if not long.isEmpty():
        own, read = (df.join(long, "page_id", "left_semi") for df in (truth, reads))
        truth, reads = (df.join(long, "page_id", "left_anti") for df in (truth, reads))
        spread = _align_spread(own, read, threshold)
        if readers is not None:
            spread = with_missing(spread, own, truth.sparkSession.createDataFrame([(e,) for e in readers], "engine string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return align_pages(batches, columns, threshold, readers)

    kinds = {"truth_no": "int", "read_no": "int"}
    rows = _by_page(truth, reads).mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return rows if spread is None else rows.unionByName(spread.select(*columns))


def with_missing(pairs: DataFrame, truth: DataFrame, engines: DataFrame) -> DataFrame:
    """Pairs with every truth line of pages that an engine has nothing for as missed; ``engines`` has engine, one row per reader."""
    forms = [c for c in ("t", "p") if c in pairs.columns]
    lines = truth.where(tx.has_text(F.col("text"))).select("page_id", F.col("line_no").cast("int").alias("truth_no"), F.col("text").alias("truth"))
    readers = engines.agg(F.collect_set("engine").alias("e"))  # the names of the readers, in one row
    wanted = lines.join(F.broadcast(readers)).withColumn("engine", F.explode("e")).drop("e")
    lost = wanted.join(pairs.select("engine", "page_id").distinct(), ["engine", "page_id"], "left_anti")
    lost = lost.select("engine", "page_id", "truth_no", F.lit(None).cast("int").alias("read_no"), "truth", F.lit("").alias("read"))
    return pairs.unionByName(lost.withColumns({c: F.lit(None if c == "t" else "").cast("string") for c in forms}))


def nearest_line(lines: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """For each of ``lines`` (keys, line_no, text) the nearest line of ``pool`` with the same keys by distance, the first of equals."""
    p = pool.select(*keys, F.col("line_no").alias("pool_no"), F.col("text").alias("near"))
    scored = lines.join(p, keys).withColumn("d", cheap_distance(F.col("text"), F.col("near")))
    return scored.groupBy(*keys, "line_no", "text").agg(F.min(F.struct("d", "pool_no", "near")).alias("best")).select(*keys, "line_no", "text", "best.near", F.col("best.d").alias("distance"))


def per_truth_line(pairs: DataFrame) -> DataFrame:
    """engine, page_id, truth_no, truth, read, cer: what became of every truth line; one that wasn't read has a cer of 1."""
    t, p = (normal_form(F.coalesce(F.col(c), F.lit(""))) for c in ("truth", "read"))
    rows = pairs.where("truth_no is not null").withColumn("t", t).withColumn("p", p)
    cer = F.when(F.col("read_no").isNull(), 1.0).otherwise(F.try_divide(any_distance(F.col("t"), F.col("p")).cast("double"), F.length("t").cast("double")))
    return rows.select(*PAGE, "truth_no", "truth", "read", cer.alias("cer"))
