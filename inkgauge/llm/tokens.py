"""Token ids on disk: a shared zstandard dictionary and one frame per document.

A token table is a folder with two Parquet tables. ``dictionary`` has one row: the dictionary, its
SHA-256, and the bytes per id. ``blocks`` has one row per block of documents in ascending doc_id
order: the ids of each document, compressed by themselves with the shared dictionary, stand one
after the other in ``payload``; ``offset`` says where each begins, so one short document is read by
one slice and one decompression. Blocks carry their first and last doc_id that
isn't null for pruned lookups.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgauge.llm.columns import spread
from inkgauge.llm.encode import encoder, vocabulary_path
from inkgauge.llm.staging import new_path

#: The dictionary is trained on about this many documents (by hash; twice as many at most) and this many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 16_384
DICTIONARY_BYTES = 64 * 1024
#: A block ends with the document that brings it to this many payload bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 8192
LEVEL = 3

BLOCKS = "part int, block int, dictionary string, first_doc long, last_doc long, tokens long, before long, doc_id array<long>, n_tokens array<long>, offset array<long>, payload binary"


def _train(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Encode every row of ``docs`` (doc_id, text) with ``end_id`` appended and write the token table.

    A null text counts as empty and has the end id alone. Rows are in ascending order of doc_id,
    null first; rows with the same doc_id stand together, in order of a hash of the text, then of the
    text, so that many of them are spread over tasks too. An empty table gives
    a token table without blocks. Other columns are ignored.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    least = rows.select(spread("doc_id", "text").alias("u")).agg(F.count("*").alias("n"), F.min("u").alias("u")).first()
    bound = max(SAMPLE_DOCS / max(1, least["n"]), least["u"] or 0.0)  # copies of one row draw alike: there is always a row
    drawn = rows.withColumn("u", spread("doc_id", "text")).where(F.col("u") <= bound).select("u", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"))
    sample = drawn.distinct().orderBy("u", "text").limit(2 * SAMPLE_DOCS).collect()
    tool = encoder(vocabulary)
    kind = "<u2" if max(end_id, tool.tokenizer.get_vocab_size()) < 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()
    narrow = lambda ids: np.frombuffer(ids, "<u4").astype(kind).tobytes()
    shared = _train([narrow(tool.encode(r["text"]) + end) for r in sample])
    digest = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(digest, bytearray(shared), kind, len(sample))], "sha256 string, data binary, ids string, samples int").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        trained = _dictionary(shared)
        if trained:
            trained.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        ids, counts, frames, held, block, before = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            known = [i for i in ids if i is not None]
            values = [part, block, digest, known[0] if known else None, known[-1] if known else None, sum(counts), before, ids, counts, offsets, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                plain = narrow(tool.encode(text.as_py()) + end)
                ids.append(doc_id)
                counts.append(len(plain) // np.dtype(kind).itemsize)
                frames.append(press.compress(plain))
                held += len(frames[-1])
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield row()
                    before += sum(counts)
                    ids, counts, frames, held, block = [], [], [], 0, block + 1
        if ids:
            yield row()

    keyed = rows.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str, str]:
    head = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(head["data"])
    if hashlib.sha256(data).hexdigest() != head["sha256"]:
        raise ValueError(f"{path}: the dictionary doesn't have its recorded hash")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), data, head["sha256"], head["ids"]


def _documents(data: bytes, digest: str, batch: pa.RecordBatch, wanted: frozenset[int] | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """part, doc_id, start (in the part) and stored ids of the documents of a batch of blocks."""
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
    for i in range(batch.num_rows):
        get = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
        if get("dictionary") != digest:
            raise ValueError("a block was written with another dictionary")
        payload, offset, at = memoryview(batch.column("payload")[i].as_buffer()), get("offset"), get("before")
        for k, (doc_id, n) in enumerate(zip(get("doc_id"), get("n_tokens"))):
            if wanted is None or doc_id in wanted:
                yield get("part") if k == 0 or wanted else None, doc_id, at, opener.decompress(payload[offset[k] : offset[k + 1]])
            at += n


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token table: doc_id, start (ids before it), n_tokens, ids_crc32 (as 32-bit ids).

    Rows are those written, repeated and null doc_ids included; a table without blocks gives no rows.
    """
    blocks, data, digest, kind = _blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, part = [], 0
            for found, doc_id, start, plain in _documents(data, digest, batch):
                part = part if found is None else found
                wide = np.frombuffer(plain, kind).astype("<u4").tobytes()
                out.append((part, doc_id, start, len(wide) // 4, zlib.crc32(wide)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 4])], ["part", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(run, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # one row per write task
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of a few documents: only blocks that may hold them are read, only their frames opened.

    A doc_id that several rows have gives a row for each; one that none has gives none. Null doc_ids can't be asked for.
    """
    blocks, data, digest, kind = _blocks(spark, path)
    wanted = frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, np.frombuffer(plain, kind).astype(np.int64).tolist()) for _, d, _, plain in _documents(data, digest, batch, wanted)]
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64()))], ["doc_id", "ids"])

    near = F.lit(False)
    for d in wanted:
        near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    return blocks.where(near).mapInArrow(run, "doc_id long, ids array<long>")


def token_table(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a token table in the shared folder and return ``read_digests`` of it."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_digests(docs.sparkSession, path)
