"""Joins, set operations and grouped concatenation."""

from pyspark.sql import functions as F

from textdist.operators import entity, joins
from textdist.registry.base import query, side, table
from textdist.registry.corpus import ANSWERED, answered


@query("attach_predictions", ANSWERED)
def attach(spark, d):
    turns = table(spark, d, "conversations")
    source = turns.where("role = 'user'").select(F.struct("conv_id", "turn").alias("row"), "text")
    said = turns.where("role = 'assistant'").select(
        F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("row"), F.col("text").alias("prediction"))
    return joins.attach_predictions(source, said, "row").select("row.*", "text", "prediction")


ENTITY = """WITH occ AS (SELECT o_custkey AS c_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS occupations
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
  SELECT DISTINCT c.c_custkey, c.c_name, c.c_mktsegment, n.n_name AS title, r.r_name AS label, coalesce(occ.occupations, '') AS occupations
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 4
  LEFT JOIN nation m ON m.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = m.n_regionkey
  LEFT JOIN occ USING (c_custkey)
  WHERE c.c_mktsegment IN (SELECT p.p_segment FROM (SELECT c_mktsegment AS p_segment FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4400) p)"""


def featured(spark, d):
    """Customers as entities: market segment is the badge, nation the optional title, region
    the label, order priorities the occupations."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    home = customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    titles = home.join(nation.where("n_regionkey < 4"), "n_nationkey").select("c_custkey", F.col("n_name").alias("title"))
    labels = home.join(nation, "n_nationkey").join(
        table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(
        "c_custkey", F.col("r_name").alias("label"))
    badges = customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a")).where("a > 4400").select("c_mktsegment")
    done = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("occupation"))
    return entity.entity_facts(
        customer.select("c_custkey", "c_name", "c_mktsegment"), badges, titles, done, labels, "c_custkey", "c_mktsegment")


@query("entity_facts", ENTITY)
def entity_facts(spark, d):
    return featured(spark, d)


@query("concat_distinct", """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities
  FROM orders GROUP BY o_custkey""")
def concat_distinct(spark, d):
    return joins.concat_distinct(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "priorities").orderBy("o_custkey")


@query("first_per_title", """SELECT title, c_name, c_custkey FROM (SELECT n.n_name AS title, c.c_name, c.c_custkey,
  row_number() OVER (PARTITION BY n.n_name ORDER BY c.c_name, c.c_custkey) AS r FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 4) WHERE r = 1 AND title IS NOT NULL""")
def first_per_title(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey < 4").withColumnRenamed("n_nationkey", "c_nationkey")
    named = table(spark, d, "customer").join(nation, "c_nationkey", "left").select(F.col("n_name").alias("title"), "c_name", "c_custkey")
    return entity.one_per_title(named, "title", ["c_name", "c_custkey"])


@query("existing_pages", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT page_id FROM pages)")
def existing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return joins.existing_pages(docs, table(spark, d, "pages"), "doc_id", "page_id")


@query("missing_pages", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def missing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return joins.missing_pages(docs, table(spark, d, "pages"), "doc_id", "page_id")


@query("experiment_grid", """SELECT r.event_type AS model, s.label AS ref_seed, k.turn AS n_icl FROM (SELECT DISTINCT event_type FROM events) r,
  (SELECT DISTINCT label FROM embeddings) s, (SELECT DISTINCT turn FROM conversations) k""")
def grid(spark, d):
    return joins.experiment_grid(
        table(spark, d, "events").select(F.col("event_type").alias("model")).distinct(),
        table(spark, d, "embeddings").select(F.col("label").alias("ref_seed")).distinct(),
        table(spark, d, "conversations").select(F.col("turn").alias("n_icl")).distinct())


@query("stack_sides", """SELECT CASE WHEN vec_id % 2 = 0 THEN 'p' ELSE 'q' END AS side, vec_id, label FROM embeddings""")
def stack(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", side("vec_id").alias("s"))
    return joins.stack_sides(v.where("s = 'q'").drop("s"), v.where("s = 'p'").drop("s"))
