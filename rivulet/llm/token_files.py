"""Token-id files: one concatenated id array for each block, with Elias-Fano encoded document boundaries.

A token file is a block of whole documents: magic, width of an id in bytes, the boundaries (first id of
each document and the end) as Elias-Fano sequence, then the ids. Spark's own writer commits the blocks
as rows of a Parquet folder, so no half-written file is ever seen after a lost executor, and any store
that Spark can write holds them; ``payload`` is the file's content and can be saved on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import with_locator
from rivulet.llm.elias_fano import EliasFano
from rivulet.llm.encoders import ByteBpe, per_process, vocabulary

MAGIC = b"RVTOK1"
#: Ids of a block: the documents that reach this number close it. A longer document has a block of its own.
BLOCK_TOKENS = 1 << 20

_SCHEMA = "shard int, block int, before long, n_tokens long, doc_ids array<{kind}>, payload binary"


def pack_block(docs: list[np.ndarray]) -> bytes:
    """The file of some documents' ids (all of one unsigned type)."""
    ends = np.cumsum([0, *map(len, docs)])
    ids = np.concatenate(docs)
    return MAGIC + bytes([ids.dtype.itemsize]) + EliasFano.encode(ends).to_bytes() + ids.tobytes()


class TokenBlock:
    """Reads a token file by select on the boundaries: ``doc(i)`` one document, ``docs()`` all, from one sampled boundary to the next."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.index, at = EliasFano.from_bytes(payload, len(MAGIC) + 1)
        self.ids = np.frombuffer(payload, f"<u{payload[len(MAGIC)]}", offset=at)

    def __len__(self) -> int:
        return self.index.n - 1

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.index.select(i) : self.index.select(i + 1)]

    def docs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first place, ids) of each document in order; no more boundaries than between two samples are held."""
        start = None
        for k in range(len(self.index.samples)):
            for end in self.index.stretch(k).tolist():
                if start is not None:
                    yield start, self.ids[start:end]
                start = end


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes every whole ``text`` with the byte-level BPE file ``tokenizer``, appends ``end_id`` and writes blocks in ascending id order.

    One range shuffle by id orders the documents (its bounds are sampled from ids and places, no text); ids
    may be of any type that has an order. A null id comes first. Rows of one id are ordered by their place in
    their files, and no shard need hold them all. A null or empty text is the end id alone. Other columns of
    ``docs`` are not read.
    """
    key, blob = vocabulary(docs.sparkSession, tokenizer)
    kind = docs.schema[doc_id].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = per_process(ByteBpe, key, blob), TaskContext.get().partitionId()
        if end_id > np.iinfo(coder.dtype).max:
            raise ValueError(f"id {end_id} does not fit {coder.dtype}")
        end = np.array([end_id], coder.dtype)
        ids, held, n, block, before = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            of = pa.chunked_array(held).combine_chunks()
            of = pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "before": [before], "n_tokens": [n], "doc_ids": of, "payload": pa.array([pack_block(ids)], pa.binary())})

        for batch in batches:
            first = 0
            for i, own in enumerate(coder.batch(batch.column(1).to_pylist())):
                ids.append(np.concatenate((own, end)))
                n += len(ids[-1])
                if n >= block_tokens:
                    held.append(batch.column(0).slice(first, i + 1 - first))
                    yield row()
                    ids, held, n, block, before, first = [], [], 0, block + 1, before + n, i + 1
            held.append(batch.column(0).slice(first))
        if ids:
            yield row()

    rows = with_locator(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("_file").alias("_file"), "_row")
    order = ["doc_id", "_file", "_row"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(blocks, _SCHEMA.format(kind=kind)).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from its file: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. A shard's first id is known from the shards'
    totals: one number for each shard, of which there are no more than tasks that wrote them.
    """
    files = spark.read.parquet(path)
    totals = np.array(sorted(map(tuple, files.groupBy("shard").agg(F.sum("n_tokens")).collect())), np.int64).reshape(-1, 2)
    base = spark.sparkContext.broadcast((totals[:, 0], np.cumsum(totals[:, 1]) - totals[:, 1]))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, starts = base.value
        for batch in batches:
            for k, (shard, before, payload) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("shard", "before", "payload")))):
                first = int(starts[np.searchsorted(shards, shard)]) + before
                found = [(first + a, len(own), zlib.crc32(own.astype("<u4").tobytes())) for a, own in TokenBlock(payload).docs()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, *[pa.array(x, pa.int64()) for x in zip(*found)]], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "before", "doc_ids", "payload").mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
