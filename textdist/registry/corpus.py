"""Text preparation."""

from pyspark.sql import functions as F

from textdist.functions import text as X
from textdist.plans import evaluate
from textdist.registry.base import TITLED_SQL, query, table, titled


def docs(spark, d):
    return table(spark, d, "documents")


def answered(spark, d):
    """User turns with the assistant's answer as prediction."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return asked.join(said, ["conv_id", "turn"])


ANSWERED = """SELECT u.conv_id, u.turn, u.text, a.text AS prediction FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn
  WHERE u.role = 'user' AND a.role = 'assistant'"""


@query("first_words", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:50], ' ') AS prefix FROM documents")
def first_words(spark, d):
    return docs(spark, d).select("doc_id", X.first_words(F.col("text"), 50).alias("prefix"))


@query("min_words_filter", "SELECT doc_id, text FROM documents WHERE len(string_split(text, ' ')) > 10")
def min_words(spark, d):
    return docs(spark, d).where(X.has_more_words_than(F.col("text"))).select("doc_id", "text")


@query("word_range_filter", "SELECT doc_id, n_chars FROM documents WHERE len(string_split(text, ' ')) BETWEEN 80 AND 350")
def word_range(spark, d):
    return docs(spark, d).where(X.words_between(F.col("text"))).select("doc_id", "n_chars")


@query("continuation_text_chars", f"""SELECT conv_id, turn,
  substr(array_to_string(string_split(text, ' ')[1:10], ' ') || ' ' || prediction, 1, 370) AS formatted_text FROM ({ANSWERED})""")
def continuation_chars(spark, d):
    return evaluate.format_continuations(answered(spark, d)).select("conv_id", "turn", "formatted_text")


@query("continuation_text_words", f"""SELECT conv_id, turn, array_to_string(string_split(
  array_to_string(string_split(text, ' ')[1:10], ' ') || ' ' || prediction, ' ')[1:370], ' ') AS formatted_text FROM ({ANSWERED})""")
def continuation_words(spark, d):
    return evaluate.format_continuations(answered(spark, d), unit="words").select("conv_id", "turn", "formatted_text")


@query("reference_text", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:370], ' ') AS formatted_text FROM documents")
def reference(spark, d):
    return evaluate.format_references(docs(spark, d)).select("doc_id", "formatted_text")


@query("creative_text", f"""SELECT conv_id, turn,
  array_to_string(string_split(prediction, ' ')[1:500], ' ') AS formatted_text FROM ({ANSWERED})""")
def creative(spark, d):
    return evaluate.format_creative(answered(spark, d)).select("conv_id", "turn", "formatted_text")


@query("cut_at_delimiter", """WITH g AS (SELECT o.doc_id, o.text || E'\\n\\n- Biography of ' || o.lang || E':\\n\\n' || o.text AS prediction FROM documents o)
  SELECT doc_id, regexp_split_to_array(prediction, E'\\n\\n- Biography|\\n\\n#')[1] AS formatted_text FROM g""")
def cut(spark, d):
    # A generation that runs on into a second biography.
    run_on = docs(spark, d).select(
        "doc_id", F.concat("text", F.lit("\n\n- Biography of "), "lang", F.lit(":\n\n"), "text").alias("prediction"))
    return evaluate.format_biographies(run_on).select("doc_id", "formatted_text")


@query("title_content", f"SELECT doc_id, title || E':\\n\\n' || content AS formatted_text FROM ({TITLED_SQL})")
def title_content(spark, d):
    return evaluate.format_biography_references(titled(spark, d)).select("doc_id", "formatted_text")


@query("tokens_per_word", """SELECT round(sum(tokens) / sum(words), 9) AS ratio, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(words) AS BIGINT) AS words
  FROM (SELECT len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z\\s]')) AS tokens, len(string_split(text, ' ')) AS words FROM documents)""")
def tokens_per_word(spark, d):
    counted = docs(spark, d).select(
        F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|[^A-Za-z\s]"), F.lit(0))).alias("tokens"),
        X.word_count(F.col("text")).alias("words"))
    return counted.agg(
        F.round(X.tokens_per_word(F.col("tokens"), F.col("words")), 9).alias("ratio"),
        F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))


@query("corpus_means", """SELECT lang, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words,
  round(avg(len(string_split(text, ' '))), 6) AS mean_words FROM documents GROUP BY lang""")
def corpus_means(spark, d):
    return docs(spark, d).groupBy("lang").agg(
        F.sum(X.word_count(F.col("text"))).alias("words"), F.round(F.avg(X.word_count(F.col("text"))), 6).alias("mean_words"))


@query("text_only", "SELECT text FROM documents")
def text_only(spark, d):
    return docs(spark, d).select("text")
