"""A corpus pipeline: each stage works on all that the one before it kept.

Language ID drops documents that it rejects, toxicity those that it finds toxic, near-duplicates all but one of each
group; personal data is redacted, and what is left is packed into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.llm import langid, neardup, packing, pii, toxicity
from tomeworks.session import app_dir, attach, discard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; their column lang stays as it is.

    Null, empty and blank texts have no language and go, as do ties. Texts count whole. Rows that repeat stay or go together. An empty
    table gives no rows. Extra columns stay, whatever their names.
    """
    attach(spark)
    return langid.keep(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic.

    Null and empty texts aren't; a score of 0 isn't. Texts count whole. Rows that repeat stay or go together. An empty table, or one
    without labelled rows, loses nothing. Extra columns stay, whatever their names.
    """
    attach(spark)
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, and one row of each that repeats.

    Rows with a null id, null texts and texts without words stay. Texts count whole. An empty table gives no rows. Extra columns stay,
    whatever their names.
    """
    attach(spark)
    return neardup.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with redacted texts; n_chars follows the text.

    Null and empty texts stay as they are, n_chars null and 0. Texts count whole. Rows that repeat stay. An empty table gives no rows.
    Extra columns stay, whatever their names.
    """
    attach(spark)
    done = pii.clean(docs, pii.fit())
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, offset) of all documents that are left.

    Null, empty and blank texts: one row of length 0 without bin. Long texts: consecutive pieces. Ties: the smallest gap. Rows that repeat
    are each packed. An empty table gives no rows. Extra columns are ignored.
    """
    attach(spark)
    return packing.best_fit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Compression, a learned model and sketches have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written to the shared folder, read again, and deleted when the next one is there."""
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    where, before = f"{app_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if before:
            discard(spark, before)
        before = f"{where}/{name}"
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
