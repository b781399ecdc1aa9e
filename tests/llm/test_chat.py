"""Chat formatting: round trips, loss flags, turn orders."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textdist.llm import chat as C

HARD = ["", " ", "</s>", "<\\/s>", "<\\\\/s>", "<s> [INST]", "[/INST", "[/INST] ]", " [/INST]", "\\", "<", "[", "[ROLE]x[/ROLE] y </s>", "a\nb", "[\\SYS] [/SYS]",
        "é漢😀", "x < y [0] \\n", "[[INST]]", "<</s>", "[INST][INST]", "INST]", "/s>"]


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        roles = (["system"] if c % 5 == 0 else []) + ["user", "assistant"] * rng.randint(0, 4)
        if c % 7 == 3:
            roles.insert(rng.randint(0, len(roles)), rng.choice(["assistant", "tool </s>", "[ROLE]", None, ""]))
        rows += [(c, i, r, None if rng.random() < 0.1 else "".join(rng.choice(HARD) for _ in range(rng.randint(0, 4)))) for i, r in enumerate(roles)]
    rows += [(100, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)]
    rows += [(101, 5, "user", "b"), (101, 5, "user", "a"), (101, None, "system", "first"), (102, 0, "user", "x" * 200_000), (102, 1, "assistant", "y </s>" * 20_000)]
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (103, 0, "user", "same"), (103, 0, "user", "same")]
    return rows


def by_conversation(rows):
    out = {}
    for c, i, r, t in rows:
        out.setdefault(c, []).append((i is not None, i or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


@pytest.fixture(scope="module")
def table(spark):
    full = [(c, i, r, t, 1, True, "z", 2) for c, i, r, t in conversations()]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, place long, loss boolean, _t string, _c int").repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(table):
    got = {r.conv_id: tuple(r)[1:5] for r in C.digests(table).collect()}
    want = {}
    for c, turns in by_conversation(conversations()).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert got == want


def test_segments_are_the_formatted_texts(spark, table):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = C.segments(table).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    texts, under = {}, {}
    for r in sorted(rows, key=lambda r: r.place):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
        if r.loss:
            under[r.conv_id] = under.get(r.conv_id, "") + C.LLAMA_LIKE.escaping()[1](r.text)
    for c, turns in by_conversation(conversations()).items():
        reader, back = C.Reader(C.LLAMA_LIKE), []
        for start in range(0, len(texts[c]), 997):
            back += [(r, t) for r, t, _ in reader.feed(texts[c][start : start + 997], False)]
        assert back == turns and not reader.left
        assert under.get(c, "") == "".join(t for r, t in turns if r == "assistant")
        # an escaped text holds no control string: each turn has as many as its markers
        marks = sum(texts[c].count(m) for m in C.LLAMA_LIKE.controls)
        assert marks == sum(2 if r in C.LLAMA_LIKE.turns else 3 for r, _ in turns)


def orders(turns):
    """(length of the legal prefix, valid) by stepping through the roles."""
    before, legal = None, 0
    for r, _ in turns:
        if r not in C.LLAMA_LIKE.follows.get(before, ()):
            return legal, False
        before, legal = r, legal + 1
    return legal, before in C.LLAMA_LIKE.ends


def test_turn_orders_over_many_tasks(spark, table):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    got = {r.conv_id: (r.n_turns, r.n_legal, r.valid) for r in C.turn_orders(table).collect()}
    spread = C._dealt(C._turns(table.where("conv_id = 100"), "conv_id", "turn", "role", "text")).select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    turns = by_conversation(conversations())
    assert got == {c: (len(t), *orders(t)) for c, t in turns.items()}
    assert spread > 10, "a long conversation is in many tasks"
    assert {v for _, _, v in got.values()} == {True, False}


def test_legal_flags(table):
    turns = by_conversation(conversations())
    seen = {}
    for r in sorted(C.segments(table).collect(), key=lambda r: r.place):
        seen.setdefault(r.conv_id, []).append(r.legal)
    known = 0
    for c, flags in seen.items():
        legal, _ = orders(turns[c])
        for i, flag in enumerate(flags):
            known += flag is not None
            assert flag is None or flag == (i // 3 < legal)
    assert known > len(flags) and any(f is not None for x in seen.values() for f in x)


def test_escapes_are_reversible():
    escape, plain = C.LLAMA_LIKE.escaping()
    rng = random.Random(5)
    seen = {}
    for _ in range(4000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "a", " "]) for _ in range(rng.randint(0, 9)))
        coded = escape(text)
        assert plain(coded) == text and not any(m in coded for m in C.LLAMA_LIKE.controls)
        assert seen.setdefault(coded, text) == text


def test_templates_that_could_not_be_read_are_refused():
    for controls in ({"user": ("<a", "b<", False)}, {"user": ("", "x", False)}, {"user": ("[\\a]", "x", False)}):
        with pytest.raises(ValueError):
            C.Template(turns=controls, other=("{r}", "{/r}", "{e}"), follows={}, ends=())


def test_damaged_output_is_noticed():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array(["[INST] ", "no end"]), pa.array([False, False])], names=["_c", "text", "loss"])
    with pytest.raises(ValueError):
        list(C.read_back([batch], C.LLAMA_LIKE))


def test_empty_table(table):
    none = table.where("1 = 0")
    assert C.digests(none).count() == C.segments(none).count() == C.turn_orders(none).count() == 0


def test_invalid_bytes(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(X'61ff' AS STRING) AS text")
    assert C.digests(df).first().turns_sha256 == sha("user\na�\n")
