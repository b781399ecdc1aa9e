import pytest
from pyspark.sql import functions as F

from textdist.functions import prompts as P
from textdist.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def test_first_words_count_empty_words(spark):
    assert one(spark, "a  b c ", lambda c: X.first_words(c, 3)) == "a  b"
    assert one(spark, "a b", lambda c: X.first_words(c, 5)) == "a b"
    assert one(spark, "", lambda c: X.first_words(c, 5)) == ""


def test_words_split_on_one_space(spark):
    assert one(spark, "a  b ", X.words) == ["a", "", "b", ""]
    assert one(spark, "", X.word_count) == 1


def test_filters(spark):
    ten, eleven = " ".join("a" * 10), " ".join("a" * 11)
    df = spark.createDataFrame([(ten,), (eleven,)], "s string")
    assert [r.s for r in df.where(X.has_more_words_than(F.col("s"))).collect()] == [eleven]
    assert df.where(X.words_between(F.col("s"), 10, 11)).count() == 2


def test_before_delimiter(spark):
    assert one(spark, "x\n\n#y\n\n- Biography z", X.before_delimiter) == "x"
    assert one(spark, "no delimiter", X.before_delimiter) == "no delimiter"


def test_continuation_units(spark):
    df = spark.createDataFrame([("a b c d", "x" * 400)], "t string, p string")
    row = df.select(
        X.continuation_text(F.col("t"), F.col("p"), 2).alias("chars"),
        X.continuation_text(F.col("t"), F.col("p"), 2, unit="words").alias("words")).first()
    assert row.chars == ("a b " + "x" * 400)[:370] and row.words == "a b " + "x" * 400
    with pytest.raises(ValueError):
        X.continuation_text(F.col("t"), F.col("p"), unit="lines")


def test_prompts(spark):
    text = "w1 w2 w3 w4"
    assert one(spark, text, lambda c: P.continuation_prompt(c, 3)) == "w1 w2 w3"
    chat = ("[INST]", "[/INST]")
    assert one(spark, text, lambda c: P.continuation_prompt(c, 3, chat)) == (
        "[INST] Continue the following text:\n\nw1 w2 [/INST] w3")
    assert one(spark, text, lambda c: P.continuation_prompt(c, 9, chat)) is None
    assert one(spark, "Tell.", lambda c: P.creative_prompt(c, 1, 2)).endswith("between 1 and 2 words.\n\n### Text:\n\n")


def test_in_context_prompt(spark):
    df = spark.createDataFrame([([("T1", "C1"), ("T2", "C2")],)], "examples array<struct<title:string,content:string>>")
    out = P.build_prompts(df, "wikipedia_bio", n_icl=2, header="H: ", instruction="- About").first().prompt_text
    assert out == "H: - About T1:\n\nC1\n\n- About T2:\n\nC2\n\n- About"
    with pytest.raises(ValueError):
        P.build_prompts(df, "poetry")
