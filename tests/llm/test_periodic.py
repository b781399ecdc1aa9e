"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest

from textdist.llm import periodic as P


def brute(w, least=6, repeats=4):
    """Runs by definition: for each period, maximal stretches whose smallest period it is."""
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, repeats * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(k, w):
    h = crc32(str(k).encode())
    if k is None or not w or h % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(1)
    for least, repeats in ((6, 4), (1, 4), (9, 6)):
        for _ in range(250):
            texts = []
            for _ in range(rng.randint(0, 5)):
                text = []
                for _ in range(rng.randint(0, 6)):
                    unit = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 9))]
                    text += (unit * rng.randint(1, 8))[: rng.randint(1, 60)]
                texts.append(text)
            bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
            start, length, period = P.runs_of(np.array([x for t in texts for x in t], np.int64), bounds, least, repeats)
            of = np.searchsorted(start, bounds)
            got = [[(int(s - bounds[i]), int(x), int(q)) for s, x, q in zip(start[a:b], length[a:b], period[a:b])] for i, (a, b) in enumerate(zip(of, of[1:]))]
            assert got == [brute(t, least, repeats) for t in texts]


def test_long_names_do_not_overflow():
    rng = np.random.default_rng(2)
    first, second, places = rng.integers(0, 3, 200), rng.integers(0, 3, 200), np.arange(200)
    short, long = P.names_of(first, second, places, 200), P.names_of(first, second, places, 1 << 40)
    assert [x.tolist() for x in short] == [x.tolist() for x in long]


@pytest.mark.parametrize("tails", [None, P.planted_tails])
def test_digests_and_texts(messy, messy_rows, tails):
    want = []
    for k, text in messy_rows:
        w = words(text) if tails is None else planted(k, words(text))
        # by brute force the long text of one word takes quadratic time
        runs = [(0, len(w), 1)] if len(w) > 5000 and len(set(w)) == 1 else brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((k, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    rows = P.digests(messy, tails=tails).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)
    if tails:
        assert sum(r.n_runs > 0 for r in rows) > 3
    texts = P.collapse(messy, tails=tails).collect()
    digest = lambda r: (r.doc_id, len(r.runs), hashlib.sha256(r.collapsed.encode()).hexdigest())
    assert sorted(map(repr, map(digest, texts))) == sorted(repr((r[0], r[1], r[-1])) for r in want)


def test_empty_table_and_rows(spark, nothing):
    assert P.digests(nothing).count() == 0
    row = P.digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (1, 0, None, None, None, None, empty, empty)


def test_ties_for_the_longest_run(spark):
    text = "a a a a a a x b b b b b b y c d c d c d"
    row = P.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 6, 1, 6000)


def test_time_grows_with_the_text():
    """Texts that stay periodic at every length are the worst case."""
    w = np.tile(np.arange(3), 200_000)
    begin = time.time()
    start, length, period = P.runs_of(w, np.array([0, len(w)]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [600_000], [3]) and time.time() - begin < 30
