"""Prompts, token ids and generation output."""

from pyspark.sql import functions as F

from textdist.functions import prompts as P
from textdist.operators import tokens as K
from textdist.registry.base import query, table
from textdist.registry.sampling import ICL, icl_samples


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("continuation_prompt", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:10], ' ') AS prompt_text FROM documents")
def continuation(spark, d):
    return P.build_prompts(docs(spark, d), "webtext", top_k_words=10).select("doc_id", "prompt_text")


@query("continuation_prompt_chat", """SELECT doc_id, '[INST] ' || E'Continue the following text:\\n\\n' || array_to_string(t[1:9], ' ') || ' [/INST] ' || t[10] AS prompt_text
  FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)""")
def continuation_chat(spark, d):
    return P.build_prompts(docs(spark, d), "webtext", top_k_words=10, chat=("[INST]", "[/INST]")).select("doc_id", "prompt_text")


def user_prompts(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))


@query("creative_prompt", """SELECT conv_id, turn, E'Below is a text following the instructions:\\n\\n' || text ||
  ' Your text should be approximately between 100 and 500 words.' || E'\\n\\n### Text:\\n\\n' AS prompt_text FROM conversations WHERE role = 'user'""")
def creative(spark, d):
    return P.build_prompts(user_prompts(spark, d), "creative").select("conv_id", "turn", "prompt_text")


@query("creative_prompt_chat", """SELECT conv_id, turn, 'USER: ' || text || ' Your text should be approximately between 100 and 500 words. ' ||
  E'\\n\\nASSISTANT: Sure here is a proposition:\\n\\n' AS prompt_text FROM conversations WHERE role = 'user'""")
def creative_chat(spark, d):
    return P.build_prompts(user_prompts(spark, d), "creative", chat=("USER:", "\n\nASSISTANT:")).select("conv_id", "turn", "prompt_text")


SHOWN = "string_agg('- Biography of ' || title || E':\\n\\n' || content, E'\\n\\n' ORDER BY slot)"
HEADER = "E'Write biographies of various people. Here are a few examples:\\n\\n'"


@query("in_context_prompt", ICL + f" SELECT page_id, {HEADER} || {SHOWN} || E'\\n\\n- Biography of' AS prompt_text FROM e WHERE slot < 2 GROUP BY page_id")
def in_context(spark, d):
    return P.build_prompts(icl_samples(spark, d), "wikipedia_bio", n_icl=2).select("page_id", "prompt_text")


@query("in_context_prompt_chat", ICL + f""" SELECT page_id, '[INST] ' || {HEADER} || {SHOWN} || ' [/INST]' || E'\\n\\n- Biography of' AS prompt_text
  FROM e GROUP BY page_id""")
def in_context_chat(spark, d):
    return P.build_prompts(icl_samples(spark, d), "wikipedia_bio", n_icl=3, chat=("[INST]", "[/INST]")).select("page_id", "prompt_text")


def ids(spark, d):
    """Code points of each word's first letter stand for token ids."""
    return docs(spark, d).select("doc_id", F.transform(K.split_tokens(F.col("text")), lambda w: F.ascii(w)).alias("ids"))


IDS = """SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CASE WHEN w = '' THEN 0 ELSE ascii(w) END) AS ids FROM documents"""


def joined(col):
    return F.array_join(col, ",")


@query("split_tokens", "SELECT doc_id, array_to_string(string_split(text, ' '), '|') AS tokens FROM documents")
def split_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(K.split_tokens(F.col("text")), "|").alias("tokens"))


@query("model_input", f"SELECT doc_id, array_to_string([1] || ids[1:255], ',') AS input_ids, len([1] || ids[1:255]) AS type_ids FROM ({IDS})")
def model_input(spark, d):
    full, types = K.model_input(F.col("ids"), 256, in_context=True)
    return ids(spark, d).select("doc_id", joined(full).alias("input_ids"), F.size(types).cast("bigint").alias("type_ids"))


@query("truncate_tokens", f"SELECT doc_id, array_to_string(ids[1:1024], ',') AS ids FROM ({IDS})")
def truncate(spark, d):
    from textdist.operators.vectors import truncate_tokens

    return ids(spark, d).select("doc_id", joined(truncate_tokens(F.col("ids"))).alias("ids"))


BATCHED = f"""b AS (SELECT doc_id, ids, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch FROM ({IDS})),
  m AS (SELECT batch, max(len(ids)) AS w FROM b GROUP BY batch)"""


@query("batch_width", f"WITH {BATCHED} SELECT doc_id, batch, CAST(w AS BIGINT) AS batch_width FROM b JOIN m USING (batch)")
def batch_width(spark, d):
    from textdist.operators.sampling import with_batches

    return K.batch_width(with_batches(ids(spark, d), "doc_id", 16), "ids", "batch").select(
        "doc_id", "batch", F.col("batch_width").cast("bigint"))


@query("pad_right", f"""WITH {BATCHED} SELECT doc_id, batch, array_to_string(ids || list_transform(range(w - len(ids)), lambda i: 0), ',') AS ids,
  array_to_string(list_transform(ids, lambda i: 1) || list_transform(range(w - len(ids)), lambda i: 0), ',') AS mask FROM b JOIN m USING (batch)""")
def pad_right(spark, d):
    return K.pad_right(ids(spark, d), "doc_id", "ids", 16).select(
        "doc_id", "batch", joined("ids").alias("ids"), joined("attention_mask").alias("mask"))


@query("collate_left", f"""WITH {BATCHED}, f AS (SELECT batch, CAST(ceil(w / 8.0) * 8 AS BIGINT) AS w FROM m)
  SELECT doc_id, batch, array_to_string(list_transform(range(w - len(ids)), lambda i: 2) || ids, ',') AS ids,
  array_to_string(list_transform(range(w - len(ids)), lambda i: 0) || list_transform(ids, lambda i: 1), ',') AS mask,
  array_to_string(list_transform(range(w - len(ids)), lambda i: 0) || list_transform(ids, lambda i: i % 2), ',') AS kinds FROM b JOIN f USING (batch)""")
def collate(spark, d):
    rows = ids(spark, d).withColumn("kinds", F.transform("ids", lambda i: i % 2))
    return K.collate(rows, "doc_id", "ids", 16, token_types="kinds").select(
        "doc_id", "batch", joined("ids").alias("ids"), joined("attention_mask").alias("mask"), joined("kinds").alias("kinds"))


@query("drop_prompt", f"SELECT doc_id, array_to_string(ids[11:], ',') AS generated FROM ({IDS})")
def drop_prompt(spark, d):
    return ids(spark, d).select("doc_id", joined(K.drop_prompt(F.col("ids"), 10)).alias("generated"))


@query("cut_at_eos", f"""SELECT doc_id, array_to_string(CASE WHEN list_position(ids, 97) > 0 THEN ids[1:list_position(ids, 97)] ELSE ids END, ',') AS generated
  FROM ({IDS})""")
def cut_at_eos(spark, d):
    return ids(spark, d).select("doc_id", joined(K.cut_at_eos(F.col("ids"), 97)).alias("generated"))


VOCAB = """v AS (SELECT token, row_number() OVER (ORDER BY token) + 2 AS token_id FROM
  (SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark)))"""


def vocabulary(spark, d):
    """Words of the benchmark texts, numbered from 3."""
    from textdist.operators.sampling import dense_index

    words = table(spark, d, "benchmark").select(F.explode(K.split_tokens(F.col("text"))).alias("token")).distinct()
    return dense_index(words, "token").select("token", (F.col("idx") + 3).alias("token_id"))


@query("encode_vocabulary", f"""WITH {VOCAB}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
  SELECT doc_id, string_agg(CAST(coalesce(token_id, 0) AS VARCHAR), ',' ORDER BY i) AS ids FROM w LEFT JOIN v USING (token) GROUP BY doc_id""")
def encode(spark, d):
    out = K.encode_with_vocabulary(docs(spark, d), "doc_id", "text", vocabulary(spark, d))
    return out.select("doc_id", joined("ids").alias("ids"))


@query("decode_vocabulary", f"""WITH {VOCAB}, w AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)
  SELECT item_id, string_agg(token, ' ' ORDER BY i) AS decoded FROM w JOIN v USING (token) WHERE token_id <> 5 GROUP BY item_id""")
def decode(spark, d):
    vocab = vocabulary(spark, d)
    encoded = K.encode_with_vocabulary(table(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", vocab)
    framed = encoded.select("item_id", F.concat(F.array(F.lit(1).cast("bigint")), "ids", F.array(F.lit(2).cast("bigint"))).alias("ids"))
    return K.decode_with_vocabulary(framed, "item_id", "ids", vocab, "decoded", special_ids=(1, 2, 5)).select("item_id", "decoded")
