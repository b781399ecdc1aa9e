"""Importance resampling against brute force."""

import hashlib
import math
import re
from zlib import crc32

import pyarrow as pa
import pytest

from textdist.llm import resample as R


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, least, most):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, least, most, buckets, percent, min_words, seed=2024):
    bucket = lambda g: crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for g in grams(text, least, most):
            s[bucket(g)] += 1
    for text in target:
        for g in grams(text, least, most):
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for k, text in rows:
        features = grams(text, least, most)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in features)
        out.append((k, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    many = percent * len(able) // 100
    ranked = [(*r[:4], i + 1 if i < many else None) for i, r in enumerate(able)]
    return ranked + [(*r[:4], None) for r in out if not r[4]]


@pytest.mark.parametrize("least,most,buckets,percent", [(1, 1, 10_000, 10), (1, 3, 97, 35), (2, 2, 1, 100)])
def test_resample(spark, messy, messy_rows, least, most, buckets, percent):
    goal = [messy_rows[1][1], "Ein wort und NOCH ein wort", None, ""]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(goal)], "item_id int, text string, weight int")
    got = R.resample(messy, target, least=least, most=most, buckets=buckets, percent=percent, min_words=5).collect()
    want = brute(messy_rows, goal, least, most, buckets, percent, 5)
    order = lambda r: repr(tuple(r))
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert any(r.rank for r in got)


def test_nothing_and_no_target(spark, messy, nothing):
    assert R.resample(nothing, messy).count() == 0
    rows = R.resample(messy, nothing, percent=100).collect()
    ranks = sorted(r.rank for r in rows if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_words_of_awkward_texts():
    texts = pa.array([None, "", "--", "Aé9\x00b", "x" * 10_000, " É a"])
    found, bounds = R.words_of(texts)
    flat = found.to_pylist()
    assert [flat[a:b] for a, b in zip(bounds, bounds[1:])] == [words(t) for t in texts.to_pylist()]


def test_invalid_bytes_are_part_of_words(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff2062' AS STRING) AS text")
    assert R.weights(df, R.np.zeros(7, int)).first().n_features == 2


def test_ranks_do_not_depend_on_partitions(spark, messy):
    a, b = (R.resample(df, messy, percent=50).collect() for df in (messy, messy.repartition(7)))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_drawn_rows_keep_their_columns(messy):
    ranked = R.resample(messy.where("doc_id < 40"), messy, percent=20)
    rows = R.drawn(messy, ranked)
    assert rows.columns == messy.columns and rows.select("doc_id").distinct().count() == ranked.where("rank IS NOT NULL").select("doc_id").distinct().count()
