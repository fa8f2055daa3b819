"""Thai text as column expressions: normal form, character classes, repairs, digits, markup.

Everything here is built-in functions except ``nfc``. Spark's regular expressions are ASCII unless
told otherwise, so white space is spelled out to match Unicode's and U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks by the place where they stand on their consonant (below, above, tone, top).
BELOW, ABOVE, TONE, TOP = "ฺุู", "ัิีึื็", "่้๊๋", "์ํ๎"
MARKS = BELOW + ABOVE + TONE + TOP
THAI_DIGITS, ARABIC_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
SUPERSCRIPTS, SUBSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
# Characters that mean the same and what stands for them.
FOLD_FROM = "“”„‟«»" + "‘’‚‛" + "‐‑‒–—―−" + SUPERSCRIPTS + SUBSCRIPTS
FOLD_TO = '"' * 6 + "'" * 4 + "-" * 7 + ARABIC_DIGITS * 2
NIKHAHIT, SARA_AA, SARA_AM = "ํ", "า", "ำ"
THAI_SYMBOLS = "ฯๆ๏๚๛฿"
CLASSES = ("thai_consonant", "thai_vowel_mark", "thai_digit", "arabic_digit", "latin", "punct_symbol", "other")

SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
_EDGES = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"
_BREAKS = r"\R|[\x{1c}-\x{1e}]"
_PLACEHOLDER = ""


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, _EDGES, "")


def fold_typography(c: Column) -> Column:
    """Quotes, dashes and raised or lowered digits in their plain form, character for character."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def is_mark(c: Column) -> Column:
    return c.rlike(f"^[{MARKS}]$")


def compose_sara_am(c: Column) -> Column:
    return F.replace(c, F.lit(NIKHAHIT + SARA_AA), F.lit(SARA_AM))


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


#: Later places and the place that belongs before them.
_LATER = ((ABOVE + TONE + TOP, BELOW), (TONE + TOP, ABOVE), (TOP, TONE))
_UNORDERED = "|".join(f"[{late}][{early}]" for late, early in _LATER)


def sort_marks(c: Column) -> Column:
    """Each run of marks in order of place by taking runs apart; right for any text, and slow."""
    tokens = F.regexp_extract_all(c, F.lit(f"[{MARKS}]+|[^{MARKS}]+"), F.lit(0))
    ordered = lambda t: F.concat(*[F.regexp_replace(t, f"[^{group}]", "") for group in (BELOW, ABOVE, TONE, TOP)])
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^[{MARKS}]"), ordered(t)).otherwise(t)), "")


def reorder_marks(c: Column) -> Column:
    """Each run of marks in order of place; marks of the same place keep their order.

    Texts in order stay as they are. Others have later places moved behind earlier ones, which
    settles all runs but long mixed ones; only what is still out of order is taken apart.
    """
    def moved(x: Column) -> Column:
        for late, early in _LATER:
            x = F.regexp_replace(x, f"([{late}]+)([{early}]+)", "$2$1")
        return _let(x, lambda y: F.when(y.rlike(_UNORDERED), sort_marks(y)).otherwise(y))

    return F.when(c.rlike(_UNORDERED), moved(c)).otherwise(c)


def drop_duplicate_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"([{MARKS}])\\1+", "$1")


def thai_to_arabic_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, ARABIC_DIGITS)


def arabic_to_thai_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, THAI_DIGITS)


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(strip(c), SPACE, " ")


def strip_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def normalize(c: Column, keep_spaces: bool = False, compose: bool = False) -> Column:
    """The form in which texts are compared.

    ``compose`` adds Unicode's canonical composition first, the one step that needs Python; of Thai
    text it changes only runs with U+0E3A.
    """
    if compose:
        from inkgauge.functions.edits import nfc

        c = nfc(c)
    c = compose_sara_am(fold_typography(c))
    c = drop_duplicate_marks(reorder_marks(c))
    return collapse_whitespace(c) if keep_spaces else strip_whitespace(c)


def has_text(c: Column) -> Column:
    """Whether there is anything but white space: the normal form isn't empty."""
    return c.rlike(r"(?U)[^\s\x{1c}-\x{1f}]")


def classify_char(c: Column) -> Column:
    """The class of a one-character string."""
    return (
        F.when(c.rlike("^[๐-๙]$"), "thai_digit")
        .when(c.rlike("^[0-9]$"), "arabic_digit")
        .when(c.rlike(f"^[{THAI_SYMBOLS}]$"), "punct_symbol")
        .when(c.rlike("^[ก-ฮ]$"), "thai_consonant")
        .when(c.rlike(r"^[\x{0E00}-\x{0E7F}]$"), "thai_vowel_mark")
        .when(c.rlike("^[A-Za-z]$"), "latin")
        .when(c.rlike(r"(?U)^[\p{L}\p{N}\s\x{1c}-\x{1f}]$"), "other")
        .otherwise("punct_symbol")
    )


#: What the classes hold, as far as one pattern tells; all else is punct_symbol.
CLASS_PATTERNS = {
    "thai_consonant": "[ก-ฮ]",
    "thai_vowel_mark": rf"[\x{{0E00}}-\x{{0E7F}}&&[^๐-๙ก-ฮ{THAI_SYMBOLS}]]",
    "thai_digit": "[๐-๙]",
    "arabic_digit": "[0-9]",
    "latin": "[A-Za-z]",
    "other": r"(?U)[\p{L}\p{N}\s\x{1c}-\x{1f}&&[^0-9A-Za-z\x{0E00}-\x{0E7F}]]",
}


def class_counts(c: Column) -> list[Column]:
    """How many characters of a text are in each of ``CLASSES``."""
    n = {k: count_matches(c, p) for k, p in CLASS_PATTERNS.items()}
    rest = F.length(c).cast("long")
    for k in n.values():
        rest = rest - k
    return [n.get(k, rest) for k in CLASSES]


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def thai_digits(c: Column) -> Column:
    return count_matches(c, "[๐-๙]")


def arabic_digits(c: Column) -> Column:
    return count_matches(c, "[0-9]")


def thai_chars(c: Column) -> Column:
    """Characters of the Thai block."""
    return count_matches(c, r"[\x{0E00}-\x{0E7F}]")


# -- lines -------------------------------------------------------------------------------------


def split_lines(c: Column) -> Column:
    """Lines without white space at their ends and without empty ones."""
    return F.filter(F.transform(F.split(c, _BREAKS), strip), lambda x: x != "")


def regex_spans(c: Column, pattern: str) -> Column:
    """Every match as struct(start, end, text), positions in characters; for patterns that match no empty text."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(c, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, t: F.struct(F.length(b).alias("gap"), t.alias("text")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["text"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), s["text"].alias("text")))).alias("spans"))

    return F.aggregate(steps, zero, step, lambda acc: acc["spans"])


# -- ground truth -------------------------------------------------------------------------------


def needs_sara_repair(c: Column) -> Column:
    return c.contains(" " + SARA_AM) & ~c.contains(SARA_AA)


def repair_sara(c: Column) -> Column:
    """Undo a font map that wrote sara aa as sara am, and sara am as a space and sara am."""
    c = F.replace(c, F.lit(" " + SARA_AM), F.lit(_PLACEHOLDER))
    c = F.replace(c, F.lit(SARA_AM), F.lit(SARA_AA))
    return F.replace(c, F.lit(_PLACEHOLDER), F.lit(SARA_AM))


def join_split_sara_am(c: Column) -> Column:
    return F.regexp_replace(c, "([ก-ฮ]) " + SARA_AA, "$1" + SARA_AM)


def clean_lines(raw: Column) -> Column:
    """A page's text as lines, repaired where the whole page shows the broken font map."""
    return split_lines(join_split_sara_am(F.when(needs_sara_repair(raw), repair_sara(raw)).otherwise(raw)))


def broken_glyphs(c: Column) -> Column:
    """Strange characters inside Thai words."""
    return count_matches(c, r"[ก-๛][=<>*@^~`|0-9][ก-๛]")


def thai_letters(c: Column) -> Column:
    return count_matches(c, "[ก-๛]")


def broken_glyph_rate(c: Column) -> Column:
    """Strange characters inside Thai words per thousand Thai characters; 0 without Thai."""
    return F.coalesce(F.try_divide(broken_glyphs(c), F.nullif(thai_letters(c), F.lit(0))) * 1000, F.lit(0.0))


_FLOATING = "ะาำิีึืุูํ็่้๊๋์"
#: What shows that a truth line is broken.
DEFECTS = (
    ("detached mark", f"[ก-ฮ] [{_FLOATING}]"),
    ("line starts with a mark", f"^[{_FLOATING}]"),
    ("stacked tones", "[่้๊๋]{2,}"),
    ("strange character in a word", r"[ก-๛][=<>*@^~`|][ก-๛]"),
)


def truth_defects(line: Column) -> Column:
    """Every defect as struct(label, context): the match with 20 characters on either side."""
    def found(label: str, pattern: str) -> Column:
        context = lambda s: F.substring(line, F.greatest(s["start"] - 19, F.lit(1)), s["end"] + 20 - F.greatest(s["start"] - 20, F.lit(0)))
        return F.transform(regex_spans(line, pattern), lambda s: F.struct(F.lit(label).alias("label"), context(s).alias("context")))

    return F.concat(*[found(*d) for d in DEFECTS])


# -- readers' output ------------------------------------------------------------------------------

_TAG = r"</?[A-Za-z_][^<>]*>"


def strip_markdown(line: Column) -> Column:
    """A line without structure tags, rules, heading marks, paired bold and table bars."""
    text = strip(F.regexp_replace(line, _TAG, ""))
    plain = strip(F.regexp_replace(text, r"^#{1,6}\s+", ""))
    plain = F.regexp_replace(plain, r"(?s)\*\*(.+?)\*\*|__(.+?)__", "$1$2")
    inner = F.regexp_replace(plain, r"^\|+|\|+$", "")
    cells = F.array_join(F.filter(F.transform(F.split(inner, r"\|"), strip), lambda x: x != ""), " ")
    plain = F.when(plain.startswith("|") & plain.endswith("|"), cells).otherwise(plain)
    return F.when(text.rlike("^[-|= ]*$"), "").otherwise(strip(plain))


def digit_marks(line: Column, thai_doc: Column) -> Column:
    """Every run of digits as struct(start, end, kind, text).

    ``mixed`` if it has both scripts, or has no Thai digit in a Thai-digit document; else ``digit``.
    A null ``thai_doc`` means unknown.
    """
    kind = lambda t: F.when(
        (t.rlike("[๐-๙]") & t.rlike("[0-9]")) | (F.coalesce(thai_doc, F.lit(False)) & ~t.rlike("[๐-๙]")), "mixed"
    ).otherwise("digit")
    return F.transform(regex_spans(line, "[0-9๐-๙]+"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s["text"]).alias("kind"), s["text"].alias("text")))


def suggest(kind: Column, token: Column) -> Column:
    """Thai digits for a mixed mark; null where nothing changes."""
    return F.when(kind == "mixed", F.nullif(arabic_to_thai_digits(token), token))


def row_kind(kinds: Column) -> Column:
    """The most urgent of a row's mark kinds: mixed, shaky, digit."""
    first = lambda k: F.when(F.array_contains(kinds, k), k)
    return F.coalesce(first("mixed"), first("shaky"), first("digit"))


def rule_findings(line: Column, thai_doc: Column) -> Column:
    """struct(start, end, text, suggestion, reason, layer) of raised digits, and of ASCII digits in a Thai-digit document."""
    found = lambda spans, to, why: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), to(s["text"]).alias("suggestion"), F.lit(why).alias("reason"), F.lit("rule").alias("layer"))
    )
    raised = found(regex_spans(line, f"[{SUPERSCRIPTS}]+"), lambda t: F.translate(t, SUPERSCRIPTS, THAI_DIGITS), "raised digits")
    ascii_runs = found(regex_spans(line, "[0-9]+"), arabic_to_thai_digits, "ASCII digits in a Thai-digit document")
    return F.concat(raised, F.when(F.coalesce(thai_doc, F.lit(False)), ascii_runs).otherwise(F.filter(ascii_runs, lambda x: F.lit(False))))
