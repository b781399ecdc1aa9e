import pytest
from pyspark.sql import functions as F

from textdist.operators import tokens as K


def ids(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, ids array<int>")


def test_cut_at_eos(spark):
    rows = ids(spark, [[5, 6, 2, 7, 2], [2, 5], [5, 6], []]).select("id", K.cut_at_eos(F.col("ids"), 2).alias("g")).orderBy("id").collect()
    assert [r.g for r in rows] == [[5, 6, 2], [2], [5, 6], []]


def test_collate(spark):
    rows = K.collate(ids(spark, [[1, 5, 6], [1, 5, 6, 7, 8]]), "id", "ids", 2, pad=2, multiple=4).orderBy("id").collect()
    assert [r.ids for r in rows] == [[2, 2, 2, 2, 2, 1, 5, 6], [2, 2, 2, 1, 5, 6, 7, 8]]
    assert [r.attention_mask for r in rows] == [[0] * 5 + [1] * 3, [0] * 3 + [1] * 5]


def test_collate_fills_token_types(spark):
    df = spark.createDataFrame([(0, [1, 5], [1, 1]), (1, [1, 5, 6], [0, 1, 1])], "id bigint, ids array<int>, kinds array<int>")
    rows = K.collate(df, "id", "ids", 2, multiple=4, token_types="kinds").orderBy("id").collect()
    assert [r.kinds for r in rows] == [[0, 0, 1, 1], [0, 0, 1, 1]] and [len(r.ids) for r in rows] == [4, 4]


def test_decoding_keeps_nulls(spark):
    vocab = spark.createDataFrame([("the", 3)], "token string, token_id int")
    df = spark.createDataFrame([(None, [1, 3, 2]), (1, None), (2, [1, 2])], "id bigint, ids array<int>")
    assert {r.id: r.text for r in K.decode_with_vocabulary(df, "id", "ids", vocab).collect()} == {None: "the", 1: None, 2: ""}


def test_pad_right(spark):
    rows = K.pad_right(ids(spark, [[1], [1, 2, 3], [4]]), "id", "ids", 2).orderBy("id").collect()
    assert [r.ids for r in rows] == [[1, 0, 0], [1, 2, 3], [4]] and rows[0].attention_mask == [1, 0, 0]


def test_model_input_and_prompt(spark):
    full, types = K.model_input(F.col("ids"), 3)
    short, _ = K.model_input(F.col("ids"), 3, in_context=True)
    r = ids(spark, [[7, 8, 9, 10]]).select(full.alias("a"), types.alias("b"), short.alias("c"), K.drop_prompt(F.col("ids"), 3).alias("d"),
                                           K.drop_prompt(F.col("ids"), 9).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ([1, 7, 8, 9], [0] * 4, [1, 7, 8], [10], [])


@pytest.mark.parametrize("salted", [False, True])
def test_vocabulary_roundtrip(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr("textdist.operators.joins.small_enough", lambda *a: False)
    texts = spark.createDataFrame([(1, "the cat the  hat"), (2, "the"), (3, "dog")], "id int, text string")
    vocab = spark.createDataFrame([("the", 3), ("cat", 4), ("hat", 5), ("", 6)], "token string, token_id int")
    coded = K.encode_with_vocabulary(texts, "id", "text", vocab)
    assert {r.id: r.ids for r in coded.collect()} == {1: [3, 4, 3, 6, 5], 2: [3], 3: [0]}
    framed = coded.select("id", F.concat(F.array(F.lit(1)), "ids", F.array(F.lit(2))).alias("ids"))
    back = {r.id: r.text for r in K.decode_with_vocabulary(framed, "id", "ids", vocab).collect()}
    assert back == {1: "the cat the  hat", 2: "the", 3: "<unk>"}
