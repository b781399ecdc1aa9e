"""Stages of the corpus pipeline: (spark, docs, folder) to the documents a stage keeps, with the columns of documents.

A row with a null id is judged by its own text where a stage can, and else kept. Rows of one id are one document: the
Jaccard stage keeps one of them. Other columns than those of documents are left behind.
"""

from pyspark.sql import functions as F

from textdist.llm import bpe, decontam, jaccard, suffixes
from textdist.llm.quality import quality
from textdist.llm.queries import table, vocabulary
from textdist.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def written(df, name):
    """Rows written as Parquet to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quality_rules(spark, docs, folder):
    """Documents that the quality rules keep; the texts come along with their measures, so rows are not joined."""
    rows = quality(docs, vocabulary("piece_bpe_32k.model"), lang="lang", carry=COLUMNS[1:])
    return rows.where("kept").select("doc_id", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(COLUMNS[1:])])


def near_duplicates(spark, docs, folder):
    """One document, that of the least id, of each component of near copies. Of several rows of that id the one of the least text hash
    stays, so a task that runs again keeps the same."""
    keep = jaccard.classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(F.xxhash64("text").alias("_h"), *COLUMNS[1:])
    one = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_r"))
    return one.select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in COLUMNS[1:]]).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def repeated_passages(spark, docs, folder):
    """All documents, without the windows of bytes that also start earlier."""
    rows = suffixes.remove(docs, carry=["lang", "source"], as_text=True)
    return rows.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontaminated(spark, docs, folder):
    """Documents that do not hold benchmark items. What the verdict drops is few rows, so these are looked up, not the rest."""
    bad = decontam.contamination(docs, table(spark, folder, "benchmark")).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_d"), F.col("_x").alias("_y")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_y")), "left_anti").select(*COLUMNS)


def tokens(spark, docs, folder):
    """Token counts and digests of ids and decoded bytes of what is left."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))
