"""Registration and shared inputs.

P and Q are the rows with even and odd ids; together they are the whole table.
"""

from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def side(key):
    return F.when(F.col(key) % 2 == 0, F.lit("p")).otherwise(F.lit("q"))


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label", side("vec_id").alias("side"))


def vector_sides(spark, folder):
    v = vectors(spark, folder)
    return v.where("side = 'p'").drop("side"), v.where("side = 'q'").drop("side")


def titled(spark, folder):
    """Documents as biographies: the first words are the title, the text the content."""
    return table(spark, folder, "documents").select(
        "doc_id", F.substring_index("text", " ", 12).alias("title"), F.col("text").alias("content"))


TITLED_SQL = "SELECT doc_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS title, text AS content FROM documents"
