"""Pages, truth and readers made from the ``documents`` table, the same in Spark and in SQL.

A document is a page, its source is the document, and its lines are the truth in Thai letters: each
Latin letter and digit has a Thai counterpart, accents are dropped. Readers are derived from the truth by rule:
``alpha`` confuses letters on every fifth line and drops every seventh, ``beta`` writes ASCII digits
and adds a header to each page, ``gamma-x`` and ``gamma-y`` share a family, and read line pairs as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions import text as tx
from inkgauge.functions.edits import normal_form

# What stands for what in the made-up pages.
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçß", "aaaaaeeeeiiiiooooouuuuncs"
LATIN, THAI = "abcdefghijklmnopqrstuvwxyz", "าบคดเฟกหิจขลมนอปงรสตุว้ซย่"
FROM, TO = ACCENTED + LATIN + tx.ARABIC_DIGITS, "".join(THAI[LATIN.index(c)] for c in PLAIN) + THAI + tx.THAI_DIGITS
#: Letters that alpha confuses.
SWAP_FROM, SWAP_TO = "กนส๓", "ถมศ๗"
HEADER = "สำเนา"
#: Tasks for one of a shuffle: readers' lines are a dozen times as many bytes as the document, and a task sorts them.
SPREAD = 4
ENGINES = ("alpha", "beta", "gamma-x", "gamma-y")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with page_id, over ``SPREAD`` times as many tasks as the session's shuffles have: their text work is dear for its bytes. Dealt out by page, so what goes by page later needs no further shuffle."""
    d = documents(spark, sf_dir).withColumn("page_id", _page())
    return d.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")


def _page() -> Column:
    return F.concat("source", F.lit("_p"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))


def _text(raw: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(raw), FROM, TO), r"[^\x{20}-\x{7E}\x{0E00}-\x{0E7F}]", "")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page_id, page_no, line_no, text, norm: the lines of every page. Dealt out by page before the text work."""
    d = _dealt(spark, sf_dir)
    lines = d.select("source", "doc_id", "page_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    return lines.select(F.col("source").alias("doc"), "page_id", F.col("doc_id").alias("page_no"), "line_no", _text(F.col("raw")).alias("text")).withColumn("norm", normal_form(F.col("text")))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine, doc, page_id, page_no, line_no, text, norm of four readers.

    A page's lines stand in one row while its readers are made up, so no reader scans for itself.
    """
    d = _dealt(spark, sf_dir)
    raw = F.split(F.coalesce("text", F.lit("")), "\n")
    pages = d.select(F.col("source").alias("doc"), "page_id", F.col("doc_id").alias("page_no"), F.transform(raw, _text).alias("l"))
    line = lambda engine, no, text: F.struct(F.lit(engine).alias("engine"), no.cast("int").alias("line_no"), text.alias("text"))
    named = lambda engine: lambda x, k: line(engine, k, x)
    confused = lambda x, i: F.when((F.col("page_no") + i) % 5 == 0, F.translate(x, SWAP_FROM, SWAP_TO)).otherwise(x)
    alpha = F.filter(F.transform("l", lambda x, i: line("alpha", i, confused(x, i))), lambda x: x["line_no"] % 7 != 3)
    beta = F.transform("l", lambda x, i: line("beta", i, tx.thai_to_arabic_digits(x)))
    head = F.array(line("beta", F.lit(-1), F.lit(HEADER)))
    pairs = F.transform(F.sequence(F.lit(0), ((F.size("l") - 1) / 2).cast("int")), lambda k: F.array_join(F.slice("l", k * 2 + 1, F.lit(2)), " "))
    gammas = [F.transform(pairs, named(e)) for e in ("gamma-x", "gamma-y")]
    rows = pages.select("doc", "page_id", "page_no", F.inline(F.concat(alpha, beta, head, *gammas)))
    return rows.select("engine", "doc", "page_id", "page_no", "line_no", "text").withColumn("norm", normal_form(F.col("text")))


def readers(spark: SparkSession) -> DataFrame:
    """engine: the four readers."""
    return spark.createDataFrame([(e,) for e in ENGINES], "engine string")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine, page_id, core_ms, error: what became of each reader's call for each page; every 13th page fails for ``beta``."""
    rows = documents(spark, sf_dir).select(F.explode(F.array(*map(F.lit, ENGINES))).alias("engine"), _page().alias("page_id"), "doc_id")
    ms = (F.col("doc_id") % 97 + F.length("engine") * 10).cast("double")
    return rows.select("engine", "page_id", ms.alias("core_ms"), F.when((F.col("engine") == "beta") & (F.col("doc_id") % 13 == 0), "no answer").alias("error"))


# -- the same in SQL -------------------------------------------------------------------------------


def sql_text(raw: str) -> str:
    return f"regexp_replace(translate(lower({raw}), '{FROM}', '{TO}'), '[^\\x20-\\x7E\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')"


def sql_normalize(c: str, space: str = "") -> str:
    """The normal form of texts that hold ASCII and Thai alone."""
    c = f"replace({c}, '{tx.NIKHAHIT + tx.SARA_AA}', '{tx.SARA_AM}')"
    c = f"translate({c}, '{tx.FOLD_FROM}', '{tx.FOLD_TO.replace(chr(39), chr(39) * 2)}')"
    groups = " || ".join(f"regexp_replace(x, '[^{g}]', '', 'g')" for g in (tx.BELOW, tx.ABOVE, tx.TONE, tx.TOP))
    c = f"array_to_string(list_transform(regexp_extract_all({c}, '[{tx.MARKS}]+|[^{tx.MARKS}]+'), lambda x: case when regexp_matches(x, '^[{tx.MARKS}]') then {groups} else x end), '')"
    for m in tx.MARKS:
        c = f"regexp_replace({c}, '{m}+', '{m}', 'g')" if m in THAI else c
    return f"regexp_replace({c}, '[\\s\\x1c-\\x1f]+', '{space}', 'g')"


def sql_ascii(c: str) -> str:
    """Thai letters as ASCII ones, one for one, so that a distance in bytes is one in characters."""
    others = "".join(sorted(set(SWAP_TO + HEADER) - set(THAI + tx.THAI_DIGITS)))
    return f"translate({c}, '{THAI + tx.THAI_DIGITS + others}', '{LATIN}ABCDEFGHIJ{'KLMNOPQRST'[: len(others)]}')"


TRUTH_SQL = f"""
raw as (select source as doc, doc_id as page_no, source || '_p' || lpad(cast(doc_id as varchar), 6, '0') as page_id,
         unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no from documents),
truth0 as (select doc, page_no, page_id, cast(line_no as int) as line_no, {sql_text('raw')} as text from raw),
truth as (select *, {sql_normalize('text')} as norm from truth0)"""

RUNS_SQL = """
runs as (select engine, source || '_p' || lpad(cast(doc_id as varchar), 6, '0') as page_id, source as doc, cast(doc_id % 97 + length(engine) * 10 as double) as core_ms,
           case when engine = 'beta' and doc_id % 13 = 0 then 'no answer' end as error from documents, (values ('alpha'), ('beta'), ('gamma-x'), ('gamma-y')) e(engine))"""

READS_SQL = f"""{TRUTH_SQL},
reads0 as (
  select 'alpha' as engine, doc, page_id, page_no, line_no, case when (page_no + line_no) % 5 = 0 then translate(text, '{SWAP_FROM}', '{SWAP_TO}') else text end as text from truth where line_no % 7 <> 3
  union all select 'beta', doc, page_id, page_no, line_no, translate(text, '{tx.THAI_DIGITS}', '{tx.ARABIC_DIGITS}') from truth
  union all select 'beta', doc, page_id, page_no, -1, '{HEADER}' from truth where line_no = 0
  union all select e.engine, g.* from (select doc, page_id, page_no, cast(floor(line_no / 2) as int) as line_no, string_agg(text, ' ' order by line_no) as text from truth group by doc, page_id, page_no, cast(floor(line_no / 2) as int)) g, (values ('gamma-x'), ('gamma-y')) e(engine)),
reads as (select *, {sql_normalize('text')} as norm from reads0)"""
