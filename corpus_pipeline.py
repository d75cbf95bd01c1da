"""A cleaning pipeline over the documents table: five stages, each written and read again before the next.

toxicity: documents that score 0.5 or more go. simhash: one document of each group of similar texts stays
(five-word Jaccard similarity of 0.8 or more, found by SimHash links and, beyond their 4 bits, by MinHash).
decontamination: documents with windows of two or more test items, or mostly of such windows, go; from others
the windows are cut out. pii: surrogates take the place of personal data. sentencepiece: the remaining texts are encoded.

All stages but the last return the columns of their input. A stage is a function of (spark, docs, sf_dir).
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, segment, simhash, surrogates, toxicity
from keyloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.scrub(docs, surrogates.session_key(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segment.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", replace_pii),
    ("sentencepiece", encode),
]

#: Classifier, fingerprints, keyed surrogates and the piece lattice are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages in turn over the documents; what a stage returns lies as Parquet in the shared folder.

    In a folder of the caller all stages stay, and a run that was broken off goes on behind the last one that is whole. Without
    one, a stage's rows go once the next are written.
    """
    docs, at = table(spark, sf_dir, "documents"), folder or f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None and folder is None:
            files.delete(before, True)
        before = path
    return docs
