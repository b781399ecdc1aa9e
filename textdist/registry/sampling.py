"""Samples, orders, batches and latest rows."""

from pyspark.sql import functions as F

from textdist.functions.keys import hash_order
from textdist.functions.prompts import CREATIVE_PROMPTS
from textdist.functions.text import has_more_words_than
from textdist.operators import sampling as S
from textdist.registry.base import TITLED_SQL, query, table, titled

HASH = "md5('{seed}-' || CAST({key} AS VARCHAR))"


def h(seed, key):
    return HASH.format(seed=seed, key=key)


@query("seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {h(12345, 'doc_id')}) - 1 AS place FROM documents")
def shuffle(spark, d):
    placed = table(spark, d, "documents").select("doc_id", hash_order(12345, F.col("doc_id")).alias("_h"))
    return S.dense_index(placed, "_h", "place").drop("_h")


@query("seeded_sample", f"""SELECT doc_id, text FROM documents WHERE len(string_split(text, ' ')) > 10
  ORDER BY {h(12345, 'doc_id')}, doc_id LIMIT 500""")
def sample(spark, d):
    # The kept web texts: filter, shuffle, first n.
    kept = table(spark, d, "documents").where(has_more_words_than(F.col("text"))).select("doc_id", "text")
    return S.hash_sample(kept, "doc_id", 12345, n=500)


@query("sample_share_by_group", f"""SELECT source, doc_id FROM (SELECT source, doc_id,
  row_number() OVER (PARTITION BY source ORDER BY {h(7, 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents)
  WHERE r <= floor(c * 0.2)""")
def sample_share(spark, d):
    return S.hash_sample(table(spark, d, "documents").select("source", "doc_id"), "doc_id", 7, ratio=0.2, by=["source"])


@query("hypothesis_sample", f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {h(12345, 'doc_id')}, doc_id) AS r,
  count(*) OVER () AS c FROM documents) WHERE r <= floor(c * 0.2)""")
def hypothesis_sample(spark, d):
    return S.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 12345, ratio=0.2)


@query("pca_fit_rows", f"SELECT vec_id FROM embeddings ORDER BY {h(30, 'vec_id')}, vec_id LIMIT 200")
def fit_rows(spark, d):
    return S.hash_sample(table(spark, d, "embeddings").select("vec_id"), "vec_id", 30, n=200)


@query("first_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 400")
def first_n(spark, d):
    return S.first_n(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 400)


@query("equal_length", """WITH s AS (SELECT CASE WHEN lang = 'en' THEN 'p' ELSE 'q' END AS side, doc_id FROM documents),
  r AS (SELECT side, doc_id, row_number() OVER (PARTITION BY side ORDER BY doc_id) AS r FROM s),
  n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM s GROUP BY side))
  SELECT side, doc_id FROM r, n WHERE r.r <= n.m""")
def equal_length(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("lang") == "en", "p").otherwise("q").alias("side"), "doc_id")
    p, q = S.equal_length(docs.where("side = 'p'"), docs.where("side = 'q'"), "doc_id")
    return p.unionByName(q)


@query("draw_with_replacement", f"""WITH items AS (SELECT text AS prompt, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark)
  SELECT doc_id, prompt FROM documents JOIN items
  ON items.i = CAST('0x' || substr({h(12357, 'doc_id')}, 1, 15) AS BIGINT) % (SELECT count(*) FROM benchmark)""")
def draw(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return S.draw_with_replacement(table(spark, d, "documents").select("doc_id"), "doc_id", items, "item_id", 12357, "prompt")


LISTED = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in CREATIVE_PROMPTS) + "]"


@query("creative_prompt_draws", f"""SELECT doc_id, {LISTED}[CAST('0x' || substr({h(12357, 'doc_id')}, 1, 15) AS BIGINT) % {len(CREATIVE_PROMPTS)} + 1] AS prompt
  FROM documents""")
def prompt_draws(spark, d):
    return S.draw_from_values(table(spark, d, "documents").select("doc_id"), "doc_id", CREATIVE_PROMPTS, 12357, "prompt")


ICL = f"""WITH b AS (SELECT array_to_string(string_split(title, ' ')[1:10], ' ') AS title,
    array_to_string(string_split(content, ' ')[1:350], ' ') AS content, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM ({TITLED_SQL})),
  s AS (SELECT c.page_id, v.slot, CAST('0x' || substr(md5('12357-' || CAST(c.page_id AS VARCHAR) || '-' || CAST(v.slot AS VARCHAR)), 1, 15) AS BIGINT)
    % (SELECT count(*) FROM documents) AS i FROM pages c, (VALUES (0), (1), (2)) v(slot)),
  e AS (SELECT page_id, slot, title, content FROM s JOIN b USING (i))"""


def icl_samples(spark, d):
    return S.in_context_examples(table(spark, d, "pages").select("page_id"), "page_id", titled(spark, d), "doc_id", 3, 12357)


@query("in_context_examples", ICL + """ SELECT page_id, max(CASE WHEN slot = 0 THEN title END) AS title_0,
  max(CASE WHEN slot = 0 THEN content END) AS content_0, max(CASE WHEN slot = 1 THEN title END) AS title_1,
  max(CASE WHEN slot = 1 THEN content END) AS content_1, max(CASE WHEN slot = 2 THEN title END) AS title_2,
  max(CASE WHEN slot = 2 THEN content END) AS content_2 FROM e GROUP BY page_id""")
def icl(spark, d):
    wide = S.widen_examples(icl_samples(spark, d), 3)
    return wide.select("page_id", *[F.col(f"example_{i}.{f}").alias(f"{f}_{i}") for i in range(3) for f in ("title", "content")])


@query("dense_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def dense(spark, d):
    return S.dense_index(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("fixed_batches", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch FROM documents")
def batches(spark, d):
    return S.with_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 16)


@query("latest_run", """SELECT user_id, event_type, event_id, value FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest(spark, d):
    runs = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return S.latest_run(runs, ["user_id", "event_type"], "ts", tie=["event_id"]).drop("ts")


@query("chosen_run", """SELECT user_id, event_type, event_id, value FROM events
  WHERE ts = (SELECT max(ts) FROM events)""")
def chosen(spark, d):
    runs = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    newest = runs.agg(F.max("ts")).first()[0]
    return S.latest_run(runs, ["user_id", "event_type"], "ts", date=newest, tie=["event_id"]).drop("ts")
