"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.storage import shared_dir, written  # noqa: F401 (used from here by the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Plan nodes that pass rows of their input on as they are, or drop some.
_PLAIN = ("Project", "Filter", "SubqueryAlias", "View")


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` itself where each of its rows is one row of a file, the same at every run; else written as it is and read again.

    Rows of a join, an explode or a limit may stand for one row of a file several times, or change from run to run.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _PLAIN and plan.deterministic():
        plan = plan.children().head()
    straight = plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    return docs if straight else written(docs, "rows")


def with_locator(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` (else all, as one struct ``row``) with _file and _row, which tell its rows apart whatever they hold."""
    docs = stable(docs)
    place = docs.metadataColumn("_metadata")  # also where a column of the table has that name
    return docs.select(*(columns or [F.struct("*").alias("row")]), place["file_path"].alias("_file"), place["row_index"].alias("_row"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bytes of a text that are split into words together.
_STEP = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of about a megabyte that end at a blank."""
    a = 0
    while a < len(raw):
        m = _BLANK.search(raw, a + _STEP) if len(raw) - a > _STEP else None
        b = m.end() if m else len(raw)
        yield raw[a:b]
        a = b


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """``words_of`` a text of any length, a part at a time."""
    for piece in pieces(text.encode("utf-8", "surrogatepass").lower()) if text else ():
        yield piece.split()
