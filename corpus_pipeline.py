"""From raw documents to packed training sequences: each stage works on all that the one before kept.

Every stage but the last returns the columns of its input, whatever they are called besides doc_id and
text. Ids are integers; null ids and repeated ones are said for each stage. An empty table gives an
empty result everywhere, and texts of any length are treated whole.
"""

from __future__ import annotations

from collections.abc import Callable

from provlake.llm import jaccard, lines, packing, quality, secrets
from provlake.llm.common import documents, written
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose compression stays in the bands of their length.

    Null and empty texts go. Rows are judged each for itself, so repeated rows and null ids don't matter.
    """
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one up to a few edits.

    Documents that are left blank by it go; null ids, null and empty texts stay as they are. Rows that repeat
    an id and a text lose the same lines; different texts of an id lose their own.
    """
    return lines.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Texts without words and null ids stay. Rows that repeat an id and a text stay or go together.
    """
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each confirmed secret replaced by a mark of its kind; all rows stay, whatever their ids."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences.

    Null and empty texts have no pieces. A null id is the least; repeated rows have pieces each.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: zstandard, edit distances and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder and read again.

    The written tables stay, for retries and for looking into; the folder's owner clears it. Nulls, repeated
    and long rows are treated as the stages say.
    """
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
