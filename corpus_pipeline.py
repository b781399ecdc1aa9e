"""Training-data pipeline over documents: each stage applies one operator to all its predecessor kept."""

from textdist.llm import stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("decontaminated", stages.decontaminated),
    ("tokens", stages.tokens),
]

#: The first stage counts tokens of a public vocabulary, which SQL cannot; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.written(stage(spark, docs, sf_dir), name)
    return docs
