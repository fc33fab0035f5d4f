"""From raw documents to packed training sequences: toxic documents go, boilerplate lines go, one document of each
group of near copies stays, contaminated documents go, the rest is packed.

Every stage reads all that its predecessor kept. ORACLE_SQL is None: a trained classifier, MinHash joins and a linear
program are not SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import common, decontaminate, lines, near, packing, toxicity

ORACLE_SQL = None


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_lines(docs, "source")


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line dedup", _lines),
    ("n-gram Jaccard join", _near),
    ("benchmark decontamination", _decontaminate),
    ("packing", _pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
