"""The queries of the library over pages made from ``documents``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions import names
from inkgauge.functions import text as tx
from inkgauge.operators import filters, layout, match, review, rollup, score, stability, suspect
from inkgauge.plans import reads as made
from inkgauge.sources import store
from inkgauge.plans.reads import READS_SQL, TRUTH_SQL, sql_ascii, sql_normalize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and reads of the same line number, for readers that keep lines."""
    t = made.truth(spark, sf_dir)
    r = made.reads(spark, sf_dir).where("engine in ('alpha', 'beta')")
    left = t.select("doc", "page_id", F.col("line_no").alias("truth_no"), F.col("text").alias("truth")).where("truth <> ''")
    right = r.select("engine", "page_id", F.col("line_no").alias("read_no"), F.col("text").alias("read"))
    engines = F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("engine")
    both = left.select("*", engines).withColumn("no", F.col("truth_no")).join(right.withColumn("no", F.col("read_no")), ["engine", "page_id", "no"], "full")
    return both.drop("no")


_SAME_LINE_SQL = f"""{READS_SQL},
l as (select doc, page_id, line_no, text, norm, engine from truth, (values ('alpha'), ('beta')) e(engine) where text <> ''),
r as (select * from reads where engine in ('alpha', 'beta')),
same as (
  select coalesce(l.engine, r.engine) as engine, coalesce(l.page_id, r.page_id) as page_id, l.doc, l.line_no as truth_no, r.line_no as read_no,
         coalesce(l.norm, '') as t, coalesce(r.norm, '') as p
  from l full join r on l.engine = r.engine and l.page_id = r.page_id and l.line_no = r.line_no),
errs as (
  select *, length(t) as truth_len, case when length(t) = 0 then 0 when t = p then 0 else levenshtein({sql_ascii('t')}, {sql_ascii('p')}) end as edits from same),
page as (
  select engine, page_id,
    count(truth_no) as truth_lines, count(case when truth_no is not null and read_no is not null then 1 end) as found,
    count(case when read_no is null then 1 end) as missed, count(case when truth_no is null then 1 end) as spurious,
    cast(coalesce(sum(case when read_no is null then truth_len end), 0) as bigint) as missed_chars,
    cast(coalesce(sum(case when truth_no is null then length(p) end), 0) as bigint) as spurious_chars,
    cast(coalesce(sum(case when truth_no is not null and read_no is not null then edits end), 0) as bigint) as edits,
    cast(coalesce(sum(case when truth_no is not null and read_no is not null then truth_len end), 0) as bigint) as chars
  from errs group by engine, page_id)"""


@query(f"""with {_SAME_LINE_SQL}
select engine, cast(sum(truth_lines) as bigint) as truth_lines, cast(sum(missed) as bigint) as missed, cast(sum(spurious) as bigint) as spurious,
  cast(sum(edits) as bigint) as edits, cast(sum(chars) as bigint) as chars,
  cast(sum(edits) as double) / nullif(sum(chars), 0) as matched_cer, cast(sum(truth_lines) - sum(missed) as double) / nullif(sum(truth_lines), 0) as recall
from page group by engine""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro error rate, recall and spurious lines of the line-keeping readers."""
    pages = score.page_scores(_same_line(spark, sf_dir))
    sums = pages.groupBy("engine").agg(*[F.sum(c).alias(c) for c in ("truth_lines", "missed", "spurious", "edits", "chars")])
    return score.with_rates(sums)


@query(f"with {_SAME_LINE_SQL} select * from page")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.page_scores(_same_line(spark, sf_dir))


@query(f"with {READS_SQL} select engine, page_id, line_no, text, norm from reads")
def normalized_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.reads(spark, sf_dir).select("engine", "page_id", "line_no", "text", "norm")


# -- text ------------------------------------------------------------------------------------------


@query(f"""with {TRUTH_SQL}, chars as (select doc, unnest(string_split(norm, '')) as ch from truth where norm <> ''),
c as (select doc, case when regexp_matches(ch, '^[๐-๙]$') then 'thai_digit' when regexp_matches(ch, '^[0-9]$') then 'arabic_digit'
  when regexp_matches(ch, '^[{tx.THAI_SYMBOLS}]$') then 'punct_symbol' when regexp_matches(ch, '^[ก-ฮ]$') then 'thai_consonant'
  when regexp_matches(ch, '^[\\x{{0E00}}-\\x{{0E7F}}]$') then 'thai_vowel_mark' when regexp_matches(ch, '^[A-Za-z]$') then 'latin' else 'punct_symbol' end as class from chars where ch <> ''),
n as (select doc, class, count(*) as n from c group by doc, class)
select doc, class, n, cast(n as double) / cast(sum(n) over (partition by doc) as double) as share from n""")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.class_histogram(made.truth(spark, sf_dir), "doc")


@query(r"""with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x85\x{2028}\x{2029}\x1c-\x1e]'), lambda x: regexp_replace(x, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g')), lambda x: x <> '') as lines from d)
select doc_id, cast(len(lines) as bigint) as lines, cast(length(text) as bigint) as chars, cast(len(regexp_extract_all(text, '[0-9]')) as bigint) as arabic_digits, cast(len(regexp_extract_all(text, '[๐-๙]')) as bigint) as thai_digits,
  array_to_string(lines, '|') as joined from l""")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, characters and digits of every document's whole text."""
    text = F.coalesce("text", F.lit(""))
    d = made.documents(spark, sf_dir).repartition("doc_id").withColumn("s", rollup.text_stats(text)).withColumn("l", tx.split_lines(text))
    return d.select("doc_id", "s.lines", "s.chars", "s.arabic_digits", "s.thai_digits", F.array_join("l", "|").alias("joined"))


@query(r"""with h as (select page_id, unnest(string_split(html, '>')) as piece, generate_subscripts(string_split(html, '>'), 1) - 1 as k from pages),
t as (select page_id, k, piece, regexp_replace(regexp_replace(piece || '>', '</?[A-Za-z_][^<>]*>', '', 'g'), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') as x from h)
select page_id, cast(k as int) as k, case when regexp_full_match(x, '[-|= ]*') then '' else regexp_replace(regexp_replace(x, '^#{1,6}\s+', ''), '\*\*(.+?)\*\*|__(.+?)__', '\1\2', 'gs') end as x from t""")
def tag_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure tags and rules cut from every piece of every page."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition("page_id")
    pieces = p.select("page_id", F.posexplode(F.split("html", ">")).alias("k", "piece"))
    return pieces.select("page_id", "k", tx.strip_markdown(F.concat("piece", F.lit(">"))).alias("x"))


_SARA = "regexp_replace(replace(text, 'ำ', ' ำ'), '([ก-ฮ])า', '\\1 า', 'g')"


@query(f"""with {TRUTH_SQL}, s as (select page_id, line_no, {_SARA} as raw from truth)
select page_id, line_no, regexp_replace(raw, '([ก-ฮ]) า', '\\1ำ', 'g') as joined,
  case when contains(raw, ' ำ') and not contains(raw, 'า') then 1 else 0 end as broken,
  replace(replace(replace(raw, ' ำ', '@@'), 'ำ', 'า'), '@@', 'ำ') as repaired from s where not contains(raw, '@@')""")
def truth_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split vowels joined again, and the font map undone."""
    raw = F.regexp_replace(F.replace("text", F.lit("ำ"), F.lit(" ำ")), "([ก-ฮ])า", "$1 า")
    t = made.truth(spark, sf_dir).select("page_id", "line_no", raw.alias("raw"))
    return t.select("page_id", "line_no", tx.join_split_sara_am(F.col("raw")).alias("joined"), tx.needs_sara_repair(F.col("raw")).cast("int").alias("broken"), tx.repair_sara(F.col("raw")).alias("repaired"))


@query(f"""with {TRUTH_SQL}, p as (select doc, page_no, string_agg(text, chr(10) order by line_no) as text from truth group by doc, page_no),
d as (select doc, string_agg(text, chr(10) order by page_no) as text from p group by doc)
select doc, cast(length(text) as bigint) as chars, coalesce(cast(len(regexp_extract_all(text, '[ก-๛][=<>*@^~`|0-9][ก-๛]')) as double) / nullif(len(regexp_extract_all(text, '[ก-๛]')), 0) * 1000, 0) as broken from d
where coalesce(cast(len(regexp_extract_all(text, '[ก-๛][=<>*@^~`|0-9][ก-๛]')) as double) / nullif(len(regexp_extract_all(text, '[ก-๛]')), 0) * 1000, 0) < 2""")
def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text layer can serve as truth."""
    t = made.truth(spark, sf_dir)
    return filters.trustworthy_documents(score.page_texts(t, "doc", "page_no"))


@query()
def truth_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made.truth(spark, sf_dir)
    return t.select("page_id", "line_no", F.explode(tx.truth_defects(F.col("text"))).alias("d")).select("page_id", "line_no", "d.label", "d.context")


@query(f"""with {TRUTH_SQL}, l as (
  select page_id, line_no, 0 as k, regexp_matches(text, '^[ะาำิีึืุูํ็่้๊๋์]') as y from truth
  union all select page_id, line_no, len(regexp_extract_all(text, '[ก-ฮ] [ะาำิีึืุูํ็่้๊๋์]')), false from truth
  union all select page_id, line_no, len(regexp_extract_all(text, '[่้๊๋]{{2,}}')), false from truth
  union all select page_id, line_no, len(regexp_extract_all(text, '[ก-๛][=<>*@^~`|][ก-๛]')), false from truth)
select page_id, cast(sum(k + case when y then 1 else 0 end) as bigint) as defects from l group by page_id""")
def defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.truth(spark, sf_dir).groupBy("page_id").agg(F.sum(F.size(tx.truth_defects(F.col("text")))).cast("long").alias("defects"))


# -- filters ---------------------------------------------------------------------------------------

_REPEATED = f"""{READS_SQL},
pg as (select engine, doc, count(distinct page_id) as pages from reads group by engine, doc),
rep as (select r.engine || '/' || r.doc as grp, r.text from (select distinct engine, doc, page_id, text from reads) r join pg on pg.engine = r.engine and pg.doc = r.doc
  group by r.engine, r.doc, r.text, pg.pages having count(*) >= greatest(2, cast(floor(pg.pages * cast(0.1 as double)) as int)))"""


def _grouped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.reads(spark, sf_dir).withColumn("grp", F.concat_ws("/", "engine", "doc"))


@query(f"with {_REPEATED} select * from rep")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a tenth of a document's pages, by reader."""
    return filters.repeated_lines(_grouped_reads(spark, sf_dir), "grp", 0.1)


@query(f"""with {_REPEATED} select engine, count(*) as lines, cast(sum(length(text)) as bigint) as chars from reads r
where not exists (select 1 from rep where rep.grp = r.engine || '/' || r.doc and rep.text = regexp_replace(r.text, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')) group by engine""")
def without_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _grouped_reads(spark, sf_dir)
    kept = filters.drop_repeated(r, filters.repeated_lines(r, "grp", 0.1), "grp")
    return kept.groupBy("engine").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(f"""with {READS_SQL}, s as (select engine, page_id, regexp_replace(text, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g') as s, line_no from reads),
c as (select engine, page_id, s, count(*) as n, min(line_no) as f from s where s <> '' group by engine, page_id, s)
select engine, page_id, s as text, n from (select *, row_number() over (partition by engine, page_id order by n desc, f) as k from c) where k = 1 and n >= 8""")
def reading_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which a reader got stuck."""
    return filters.loops(made.reads(spark, sf_dir), "engine", "page_id")


@query(f"""with {READS_SQL}, f as (select engine, page_id, text from reads where regexp_replace(text, '[\\s\\x1c-\\x1f]+', '', 'g') <> ''),
r as (select engine, page_id, count(*) as n, sum(length(text)) as c from f group by engine, page_id),
t as (select page_id, count(*) as n, sum(length(text)) as c from truth where regexp_replace(text, '[\\s\\x1c-\\x1f]+', '', 'g') <> '' group by page_id)
select r.engine, r.page_id, case when t.n >= 3 and cast(r.c * t.n as double) / cast(r.n * t.c as double) >= 2 then cast(r.c * t.n as double) / cast(r.n * t.c as double) end as ratio from r join t on r.page_id = t.page_id""")
def merging_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which a reader's lines are at least twice as long as the truth's."""
    t = made.truth(spark, sf_dir)
    return filters.merging_ratio(t, made.reads(spark, sf_dir))


@query(f"""with {READS_SQL}, s as (select engine, doc, page_id, sum(len(regexp_extract_all(text, '[๐-๙]'))) as th, sum(len(regexp_extract_all(text, '[0-9]'))) as ar from reads group by engine, doc, page_id)
select engine, page_id, sum(th) over (partition by engine, doc) >= 10 and sum(th) over (partition by engine, doc) > 4 * sum(ar) over (partition by engine, doc) as thai_doc from s""")
def thai_digit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's document is written in Thai digits, by reader."""
    return filters.thai_digit_pages(made.reads(spark, sf_dir), "engine")


@query(f"""with {READS_SQL}, p as (select distinct page_id, page_no from truth), d as (select distinct engine, page_id from reads where page_no % 3 <> 0)
select e.engine, cast(count(*) filter (where d.page_id is null) as bigint) as todo, cast(count(d.page_id) as bigint) as skipped
from p cross join (select distinct engine from reads) e left join d on d.engine = e.engine and d.page_id = p.page_id group by e.engine""")
def pending_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be read where every third page is missing."""
    t = made.truth(spark, sf_dir)
    r = made.reads(spark, sf_dir)
    return filters.pending_counts(t.select("page_id").distinct(), r.select("engine").distinct(), r.where("page_no % 3 <> 0"))


# -- matching and scores ------------------------------------------------------------------------------

#: Pages with few lines, on which all pairs of lines are compared: the operator is quadratic in a page's lines by definition.


@query(f"""with {READS_SQL}, t as (select *, row_number() over (partition by page_id, norm order by line_no desc) as k from truth where norm <> ''),
r as (select *, row_number() over (partition by engine, page_id, norm order by line_no desc) as k from reads where norm <> '')
select r.engine, r.page_id, t.line_no as truth_no, r.line_no as read_no from t join r on t.page_id = r.page_id and t.norm = r.norm and t.k = r.k""")
def equal_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made.truth(spark, sf_dir)
    return match.equal_pairs(t, made.reads(spark, sf_dir))


@query()
def line_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader's lines matched with the truth: one to one, and merged lines cut back."""
    t = made.truth(spark, sf_dir)
    return match.align(t, made.reads(spark, sf_dir))


@query(f"""with {READS_SQL},
t as (select page_id, string_agg(text, chr(10) order by line_no) as text from truth group by page_id),
r as (select engine, page_id, string_agg(text, chr(10) order by line_no) as text from reads group by engine, page_id),
n as (select r.engine, r.page_id, {sql_normalize('t.text')} as t, {sql_normalize('r.text')} as p from t join r on t.page_id = r.page_id)
select engine, page_id, cast(length(t) as bigint) as page_chars, case when t <> '' then case when t = p then 0 else levenshtein({sql_ascii('t')}, {sql_ascii('p')}) end end as page_edits,
  case when t <> '' then case when t = p then 0 else levenshtein({sql_ascii('t')}, {sql_ascii('p')}) end / cast(length(t) as double) end as page_cer from n""")
def page_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate over whole pages of all readers."""
    t = made.truth(spark, sf_dir)
    return score.page_error_rates(t, made.reads(spark, sf_dir))


@query()
def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.class_accuracy(_read_lines(spark, sf_dir))


@query()
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent substitutions of each reader."""
    return score.confusions(_read_lines(spark, sf_dir), 20)


@query()
def thai_digit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thai digits read as Thai digits (strict) and as digits of the same value (lenient)."""
    return score.digit_report(_read_lines(spark, sf_dir), "engine")


@query(f"""with {_SAME_LINE_SQL}, d as (select distinct page_id, doc from truth),
s as (select d.doc, p.engine, count(*) as pages, cast(sum(edits) as bigint) as edits, cast(sum(chars) as bigint) as chars, cast(sum(found) as bigint) as found, cast(sum(missed) as bigint) as missed, cast(sum(spurious) as bigint) as spurious
  from page p join d on d.page_id = p.page_id group by grouping sets ((p.engine, d.doc), (p.engine)))
select engine, doc, pages, edits, chars, found, missed, spurious, cast(edits as double) / nullif(chars, 0) as cer, cast(found as double) / nullif(found + missed, 0) as recall from s where chars > 0""")
def leaderboard_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers by document and over all, in one grouping."""
    pages = score.page_scores(_same_line(spark, sf_dir)).withColumn("doc", filters.doc_of(F.col("page_id")))
    s = pages.groupingSets([["engine", "doc"], ["engine"]], "engine", "doc").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("edits", "chars", "found", "missed", "spurious")]).where("chars > 0")
    return s.withColumn("cer", score.rate(F.col("edits"), F.col("chars"))).withColumn("recall", score.rate(F.col("found"), F.col("found") + F.col("missed")))


# -- all readers: their lines are matched, which SQL can't do ---------------------------------------------


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and reads of all readers, aligned; pages that a reader lacks count as missed."""
    names = [r["engine"] for r in made.readers(spark).collect()]
    return match.align(made.truth(spark, sf_dir), made.reads(spark, sf_dir), forms=True, readers=names)


def _read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``_matched`` that have both sides: pages that a reader lacks have none."""
    pairs = match.align(made.truth(spark, sf_dir), made.reads(spark, sf_dir), forms=True)
    return pairs.where("truth_no is not null and read_no is not null")


@query()
def matched_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.page_scores(_matched(spark, sf_dir))


@query()
def all_page_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_error_rates``, under the name that the matched queries have it by."""
    return page_error_rates(spark, sf_dir)


@query()
def matched_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readers by document and over all, best first; pages that failed or were never read are left out."""
    runs = made.runs(spark, sf_dir).where("error is null")
    docs = runs.select("page_id", filters.doc_of(F.col("page_id")).alias("doc")).distinct()
    return score.leaderboard(matched_page_scores(spark, sf_dir), all_page_error_rates(spark, sf_dir), runs, docs)


@query()
def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each class of characters, one column a reader."""
    return score.accuracy_matrix(class_accuracy(spark, sf_dir))


@query()
def matched_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reader by line error rate, page error rate and recall."""
    return score.leaders(matched_leaderboard(spark, sf_dir))


# -- suspicion, review, stability -----------------------------------------------------------------------


@query(f"""with {READS_SQL}, b as (select engine, page_id, line_no, regexp_extract_all(text, '[0-9๐-๙]+') as toks from reads), x as (select engine, page_id, line_no, unnest(toks) as tok from b),
k as (select *, case when regexp_matches(tok, '[0-9]') then 'mixed' else 'digit' end as kind from x)
select engine, kind, tok as text, case when kind = 'mixed' then translate(tok, '{tx.ARABIC_DIGITS}', '{tx.THAI_DIGITS}') end as suggestion, count(*) as n from k group by all""")
def digit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked digit runs of all readers in documents of Thai digits, with what they should be."""
    r = review.review_lines(made.reads(spark, sf_dir), F.lit(True))
    m = r.select("engine", F.explode("marks").alias("m")).select("engine", "m.kind", "m.text")
    return m.withColumn("suggestion", tx.suggest(F.col("kind"), F.col("text"))).groupBy("engine", "kind", "text", "suggestion").agg(F.count("*").alias("n"))


@query(f"""with {READS_SQL}, b as (select engine, len(regexp_extract_all(text, '[0-9๐-๙]+')) as k, len(list_filter(regexp_extract_all(text, '[0-9๐-๙]+'), lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[๐-๙]'))) as m, case when line_no % 11 = 0 then 1 else 0 end as s from reads)
select engine, count(*) as lines, count(*) filter (where k + s > 0) as to_check, cast(sum(k - m) as bigint) as digit, cast(sum(m) as bigint) as mixed, cast(sum(s) as bigint) as shaky from b group by engine""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = made.reads(spark, sf_dir)
    return review.review_summary(review.review_lines(r, None, F.col("line_no") % 11 == 0), "engine")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reader's lines with a section number before every run of digits."""
    r = made.reads(spark, sf_dir).where("engine = 'alpha'")
    return r.withColumn("text", F.regexp_replace("text", "([๐-๙]+)", "มาตรา $1"))


@query(f"""with {READS_SQL}, s as (select doc, page_id, line_no, unnest(regexp_extract_all(text, '[๐-๙]+')) as digits, generate_subscripts(regexp_extract_all(text, '[๐-๙]+'), 1) as k from reads where engine = 'alpha'),
n as (select *, length(digits) as len from s), c as (select doc, len, count(*) as c, min((page_id, line_no, k)) as f from n group by doc, len),
u as (select doc, len as usual from (select *, row_number() over (partition by doc order by c desc, f) as r, sum(c) over (partition by doc) as total from c) where r = 1 and total >= 3)
select n.page_id, n.line_no, n.digits, left(n.digits, u.usual) as guess, cast(n.len as int) as len, cast(u.usual as int) as usual from n join u on n.doc = u.doc where n.len >= u.usual + 2""")
def section_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers with a footnote number stuck to them."""
    return suspect.section_outliers(_sections(spark, sf_dir)).select("page_id", "line_no", "digits", "guess", "len", "usual")


@query(f"""with {READS_SQL}, n as (select distinct engine, split_part(split_part(engine, '+', 1), '-', 1) as family from reads)
select t.engine as target, min(p.engine) as peer from n t join n p on t.family <> p.family group by t.engine, p.family""")
def independent_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspect.independent_peers(made.reads(spark, sf_dir).select("engine").distinct())


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' lines with boxes by line, for all but ``beta``."""
    box = F.struct(F.lit(10).alias("x"), (F.col("line_no") * 40).alias("y"), F.lit(300).alias("w"), F.lit(36).alias("h"))
    return made.reads(spark, sf_dir).withColumn("box", F.when(F.col("engine") != "beta", box))


@query(f"""with {READS_SQL}, b as (select page_id, engine, count(*) as n from reads where engine <> 'beta' group by page_id, engine)
select page_id, engine as grid from (select *, row_number() over (partition by page_id order by n, engine) as k from b) where k = 1""")
def page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader whose boxes serve as each page's lines."""
    return suspect.pick_grid(_boxed(spark, sf_dir))


@query()
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suspicious lines of all readers: rules, section numbers, and votes of independent readers."""
    r = _boxed(spark, sf_dir)
    found = suspect.scan(r, filters.thai_digit_pages(r, "engine"))
    return found.select("engine", "page_id", "grid_line", "text", suspect.layers(F.col("findings")).alias("layers"), F.size("findings").alias("n"), names.highlight(F.col("text"), F.col("findings")).alias("html"))


@query()
def borrowed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of alpha lent to beta's lines."""
    r = _boxed(spark, sf_dir)
    return review.borrow_boxes(r.where("engine = 'beta'").select("page_id", "line_no", "text"), r.where("engine = 'alpha'").select("engine", "page_id", "line_no", "text", "box"))


@query(f"""with {READS_SQL}, r as (select distinct page_id, engine, norm from reads where engine in ('beta', 'gamma-x')),
a as (select page_id, line_no, text, norm from reads where engine = 'alpha'), w as (select page_id, count(distinct engine) as others from r group by page_id)
select a.page_id, a.line_no, a.text, count(distinct r.engine) = max(w.others) as stable from a join w on w.page_id = a.page_id left join r on r.page_id = a.page_id and r.norm = a.norm group by a.page_id, a.line_no, a.text""")
def stable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are equal in every round of reading."""
    r = made.reads(spark, sf_dir).where("engine <> 'gamma-y'")
    return stability.stable_lines(r.withColumnRenamed("engine", "round"), "page_id")


@query(f"""with {READS_SQL}, g as (select page_id, line_no, norm, list_sort(list(engine)) as rounds, count(*) as n from reads group by page_id, line_no, norm)
select page_id, line_no, norm, array_to_string(rounds, ',') as rounds, n, cast(row_number() over (partition by page_id, line_no order by n desc, rounds[1]) as int) as rank from g""")
def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = made.reads(spark, sf_dir).withColumnRenamed("engine", "round")
    return stability.variant_groups(r, "page_id", "line_no").withColumn("rounds", F.array_join("rounds", ","))


@query("""with c as (select conv_id, turn, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g') as text from conversations),
b as (select *, lag(text) over (partition by conv_id order by turn) as before from c)
select conv_id, turn as round, cast(length(text) as bigint) as chars, cast(len(regexp_extract_all(text, '[0-9]')) as bigint) as arabic_digits,
  case when before is null then null when before = text then 0.0 else cast(levenshtein(text, before) as double) / greatest(length(text), length(before)) end as change from b""")
def round_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round of a conversation against the one before, by its ASCII characters: DuckDB's distance counts bytes. ``whole_round_history`` has whole texts."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "")
    return stability.round_history(c.select("conv_id", F.col("turn").alias("round"), text.alias("text")), "conv_id").select("conv_id", "round", "chars", "arabic_digits", "change")


@query()
def whole_round_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round of a conversation against the one before, over all its characters."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.coalesce("text", F.lit(""))
    return stability.round_history(c.select("conv_id", F.col("turn").alias("round"), text.alias("text")), "conv_id").select("conv_id", "round", "chars", "arabic_digits", "change")


# -- tables and runs -----------------------------------------------------------------------------------


@query(f"""with {READS_SQL}, o as (select engine, page_id, line_no, text, 0 as v from reads where line_no % 2 = 0 or page_no % 5 = 0), n as (select engine, page_id, line_no, upper(text) as text, 1 as v from reads where page_no % 5 = 0)
select engine, page_id, line_no, text from (select *, row_number() over (partition by engine, page_id, line_no order by v desc) as k from (select * from o union all select * from n)) where k = 1""")
def upserted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a write of changed lines: last write wins, other rows stay."""
    r = made.reads(spark, sf_dir).select("engine", "page_id", "line_no", "text", "page_no")
    old = r.where("line_no % 2 = 0 or page_no % 5 = 0").drop("page_no")
    new = r.where("page_no % 5 = 0").withColumn("text", F.upper("text")).drop("page_no")
    return store.upsert(old, new, ["engine", "page_id", "line_no"])


@query(f"""with {READS_SQL}, p as (select doc, page_no, page_id, string_agg(text, chr(10) order by line_no) as body from reads where engine = 'alpha' group by doc, page_no, page_id),
e as (select page_no, case when page_no % 10 = 0 then 'edited ' || page_id end as edited, doc, page_id, body from p),
b as (select doc, string_agg('---' || chr(10) || chr(10) || '<!-- page ' || page_no || ' · ' || page_id || ' -->' || chr(10) || chr(10) || coalesce(edited, body) || chr(10), chr(10) order by page_no) as text, count(*) as pages, count(edited) as edited from e group by doc)
select doc, 'alpha' as engine, pages, edited, regexp_replace('# ' || doc || chr(10) || chr(10) || '> read by `alpha` · ' || pages || ' pages' || case when edited > 0 then ' · ' || edited || ' edited by hand' else '' end || ' · made 2024-01-01 00:00' || chr(10) || chr(10) || text, '\\s+$', '') || chr(10) as markdown from b""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as Markdown, edited pages in place of raw ones."""
    r = made.reads(spark, sf_dir).where("engine = 'alpha'")
    pages = r.groupBy("doc", "engine", "page_no", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    edits = pages.where("page_no % 10 = 0").select("page_id", "engine", F.concat(F.lit("edited "), "page_id").alias("text"))
    return store.export_markdown(pages, edits, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("doc", "engine", "pages", "edited", "markdown")


@query(f"""with {READS_SQL} select engine, count(distinct page_id) as pages, count(*) as lines, cast(sum(length(text)) as bigint) as chars, cast(sum(len(regexp_extract_all(text, '[๐-๙]'))) as bigint) as thai_digits from reads group by engine""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.inventory(made.reads(spark, sf_dir))


@query("""with d as (select distinct o_orderdate as started_at from orders) select cast(started_at as varchar) as started_at, cast(dense_rank() over (order by started_at) as int) as rank from d""")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps in order, numbered."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rollup.run_order(o.select(F.col("o_orderdate").cast("string").alias("started_at")))


@query("""with l as (select l_orderkey as page, l_partkey % 50 as x, l_suppkey % 10 as y, l_linenumber as n, l_quantity as q from lineitem)
select page, cast(avg(case when q >= 10 then q end) as double) / 100 as confidence, min(x * 10) as bx, min(y * 30) as by_, max(x * 10 + 80) - min(x * 10) as bw, max(y * 30 + 25) - min(y * 30) as bh from l group by page""")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words grouped into lines with boxes and mean confidence."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = F.lit(1)
    words = li.select(F.col("l_orderkey").alias("page_id"), one.alias("block"), one.alias("par"), one.alias("line"), F.col("l_linenumber").alias("word"), (F.col("l_partkey") % 50 * 10).alias("left"), (F.col("l_suppkey") % 10 * 30).alias("top"), F.lit(80).alias("width"), F.lit(25).alias("height"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("double")).otherwise(-1.0).alias("conf"))
    b = layout.line_boxes(words)
    return b.select(F.col("page_id").alias("page"), "confidence", F.col("box.x").alias("bx"), F.col("box.y").alias("by_"), F.col("box.w").alias("bw"), F.col("box.h").alias("bh"))


@query("""select c_custkey, split_part(split_part(c_name, '+', 1), '#', 1) as x, 'doc' || left(md5(c_name), 6) as doc_id, case when length(c_name) <= 12 then c_name else left(c_name, 11) || '…' end as short,
  left(regexp_replace(regexp_replace(c_name || '?.', '[<>:"/\\\\|?*]', '-', 'g'), '^[. ]+|[. ]+$', '', 'g'), 120) || ' · a-b.md' as path, 'rescue_' || translate(c_name || '+clean', '+/', '__') || '.json' as report from customer""")
def names_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = F.col("c_name")
    return c.select("c_custkey", F.split_part(n, F.lit("#"), F.lit(1)).alias("x"), names.doc_id(n).alias("doc_id"), names.short(n, 12).alias("short"), names.export_path(F.concat(n, F.lit("?.")), F.lit("a/b")).alias("path"), names.report_path("rescue", n, F.lit(True)).alias("report"))
