"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent chunks, broadcast to the workers; tier two is
each worker's bounded cache, which encodes what it has not met. No chunk is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.encoders import PieceCounts, per_process, vocabulary

#: Texts looked at for the table of frequent chunks, each of at most SAMPLE_BYTES. It decides speed only, never a count.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 15
#: Entries of that table.
FREQUENT = 1 << 15


def frequent_lengths(docs: DataFrame, blob: bytes, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent chunks in a bounded sample of texts; at most FREQUENT entries."""
    rows = docs.select(text).where(F.octet_length(text) <= SAMPLE_BYTES).limit(SAMPLE_ROWS).toArrow()
    counts, coder = Counter(), PieceCounts(blob)
    if coder.exact:
        for x in rows.column(0).to_pylist():
            counts.update(coder.chunks(x))
    chunks = [c for c, n in counts.most_common(FREQUENT) if n > 1]
    return dict(zip(chunks, coder.lengths(chunks)))


def token_count(docs: DataFrame, tokenizer: str, text: str = "text") -> Column:
    """Column with the number of tokens of each whole ``text`` by the sentencepiece model at ``tokenizer``."""
    spark = docs.sparkSession
    key, blob = vocabulary(spark, tokenizer)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, blob.value, text))

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = per_process(PieceCounts, key, blob, table)
        for batch in batches:
            yield pa.array(coder.batch(batch.to_pylist()), pa.int64())

    return lengths(F.col(text))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    A null or empty text has 0 bytes and 0 tokens. No begin, end or special tokens are added; special
    strings inside texts are ordinary text, as the library takes them. Columns of these three names in
    ``docs`` are replaced; rows are neither merged nor dropped, whatever ids they have.
    """
    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": token_count(docs, tokenizer, text)}).withColumn("over_limit", F.col("n_tokens") > limit)
