"""Language by compression: the language whose text helps most to compress a text is its language.

Each language has a raw-content zstandard dictionary made of text known to be in it. A text is cut
into chunks, every chunk is compressed with each dictionary, and the language with the smallest sum
wins; ties go to the language with more labelled documents. The margin between the two smallest
sums is the score, and a narrow margin rejects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.columns import spread

UNKNOWN = "und"
#: A dictionary's bytes; what it is made of: so many of a language's labelled texts, drawn by hash among all, and so many characters of each.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 110 * 1024, 400, 8000
CHUNK = 2048
#: Texts up to SHORT bytes are compressed at the finer level with matches from three bytes on.
SHORT, LEVEL, FINE_LEVEL = 600, 3, 12

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, with everything in ASCII that isn't a letter made one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


@dataclass
class Model:
    """Languages, those with more labelled documents first, and their dictionaries."""

    languages: list[str]
    dictionaries: list[bytes]


def train(docs: DataFrame) -> Model:
    """A model from the rows of ``docs`` whose text and lang aren't null.

    Each language gives a bounded sample (see the constants); counts, which only settle ties, are
    over all rows. The driver gets the sample alone.
    """
    known = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), spread("doc_id", "text").alias("u"))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()
    totals = {r["lang"]: r["n"] for r in found}
    drawn = F.lit(False)
    for r in found:  # the least draw has a row, even where all rows are copies
        drawn = drawn | ((F.col("lang") == r["lang"]) & (F.col("u") <= max(2 * SAMPLE_DOCS / r["n"], r["least"])))
    rows = known.where(drawn).select("lang", "u", F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    sample = rows.withColumn("place", place).where(F.col("place") <= 4 * SAMPLE_DOCS).collect()
    texts: dict[str, list[tuple[float, bytes]]] = {lang: [] for lang in totals}
    for r in sample:
        texts[r["lang"]].append((r["u"], plain(r["text"])))
    languages = sorted((lang for lang in totals if any(t for _, t in texts[lang])), key=lambda x: (-totals[x], x))
    return Model(languages, [b" ".join(t for _, t in sorted(texts[lang])[:SAMPLE_DOCS])[:DICTIONARY_BYTES] for lang in languages])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.main, self.fine = [], []
        for data in model.dictionaries:
            for tools, level, more in ((self.main, LEVEL, {}), (self.fine, FINE_LEVEL, {"min_match": 3})):
                how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(data), source_size=1024, write_content_size=0, write_checksum=0, write_dict_id=0, **more)
                shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(compression_params=how)
                tools.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        """The text's compressed size with each language's dictionary."""
        data = plain(text)
        tools = self.fine if len(data) <= SHORT else self.main
        if len(data) <= CHUNK:
            return [len(t.compress(data)) for t in tools]
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(t.compress(c)) for c in chunks) for t in tools]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin; (``und``, 0) for a null text, one without a letter, or an empty model."""
        if not text or not self.model.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        found = sorted(zip(self.sizes(text), range(len(self.model.languages))))
        margin = 1.0 if len(found) == 1 else (found[1][0] - found[0][0]) / found[1][0]
        return self.model.languages[found[0][1]], margin


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), min_margin: float = 0.01) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with lang_pred, score and rejected.

    score is the margin, 0 to 1; rejected is true where it is below ``min_margin``, and for ``und``.
    lang_pred names the smallest sum even where rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 110 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scorer(shared.value)
        for batch in batches:
            found = [tool.predict(t.as_py()) for t in batch.column("_text")]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            rejected = [n == UNKNOWN or s < min_margin for n, s in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def language_report(docs: DataFrame, min_margin: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Learns from rows that aren't held out. Null texts and texts without a letter give ``und`` and
    score 0; an empty table gives an empty table; repeated rows get the same prediction; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    model = train(rows.where("not held_out"))
    return predict(rows.drop("lang"), model, ("doc_id", "held_out"), min_margin)
