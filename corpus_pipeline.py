"""A corpus pipeline: language, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  run() applies them to the table documents and writes what each
stage leaves as a table in the shared folder, from which the next one reads.

What the stages decide: documents whose language is rejected go; one document of each
group of near copies stays (similarity of five-word shingles 0.8 or more; they meet by SimHash and are
compared exactly, and an exact join links what that left apart);
documents with a benchmark passage go; personal data is written over (n_chars follows); the rest is
cut and packed.  SQL cannot express trained stages, so the tests hold run() against the
operators' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, decontaminate, langid, near_copies, packing, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs.select(*COLUMNS))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the packed pieces of what is kept."""
    docs = common.table(spark, sf_dir, "documents", *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
