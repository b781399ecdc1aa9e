"""Lines and nested records by byte ranges, against whole reads."""

import io
import json
import random

import pytest

from textdist.sources import ranges


class Where:
    """A range of bytes held in memory."""

    def __init__(self, start, end, state=()):
        self.location, self.start, self.end, self.state = "f", start, end, list(state)


def parts(data, size):
    return [(a, min(a + size, len(data))) for a in range(0, len(data), size)]


def records_of(data, at, size):
    """The two passes of ``nested_records`` over bytes."""
    f, goal = io.BytesIO(data), len(at) + 1
    cut = [("f", a, b) for a, b in parts(data, size)]
    found = {}
    for p, a, b in cut:
        row = [c[0].as_py() for c in next(iter(ranges.scan_json(f, Where(a, b), at)))]
        found[p, a] = (tuple(row[2:5]), tuple(row[5:8]))
    stack, out = [], []
    for (_, a, b), (inside, depth, least) in zip(cut, ranges.composed(cut, found)):
        for columns in ranges.read_records(f, Where(a, b, [inside, depth, stack]), at):
            out += columns[0].to_pylist()
        if least < goal:
            after = json.loads(next(iter(ranges.scan_keys(f, Where(a, b, [inside, depth]), at)))[2][0].as_py())
            stack = [[stack[i][0] if k is None else k, stack[i][1] if key == ranges.KEEP else key] for i, (k, key) in enumerate(after)]
    return [json.loads(x) for x in out]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return rng.choice([None, 1, "plain", 'quo"te', "back\\", '\\"', "}]{[", '"bindings": [{', "é\u2028", "\\\\", ""])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    names = ["results", "bindings", 'a"b', "c\\", "x"]
    return {rng.choice(names): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def document(rng):
    rows = [value(rng, 1) for _ in range(rng.randrange(12))]
    inner = {"other": value(rng), "bindings": rows, "after": value(rng)}
    return {"head": {"bindings": [{"no": 1}]}, "results": inner, "bindings": [{"no": 2}], "tail": [[{"no": 3}]]}


@pytest.mark.parametrize("seed", range(60))
def test_records_of_any_ranges(seed):
    rng = random.Random(seed)
    docs = [document(rng) for _ in range(rng.randrange(1, 4))]
    text = "\n".join(json.dumps(d, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for d in docs)
    expected = [r for d in docs for r in d["results"]["bindings"] if isinstance(r, dict)]
    for size in (1, 2, 3, 7, 50, 1 << 20):
        assert records_of(text.encode(), ["results", "bindings"], size) == expected


def test_escaped_name_is_the_same_key():
    assert records_of(b'{"r\\u0065sults": {"bindings" : [{"a": 1}]}}', ["results", "bindings"], 5) == [{"a": 1}]


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n\na\r\nbc\n\n\ndef", "long" * 50 + "\nx\n"])
def test_lines_of_any_ranges(text):
    data = text.encode()
    expected = [x.removesuffix("\r") for x in (text[:-1] if text.endswith("\n") else text).split("\n")] if text else []
    for size in (1, 2, 3, 10, 1000):
        f, before, got = io.BytesIO(data), 0, []
        for a, b in parts(data, size):
            got += [pair for c in ranges.read_lines(f, Where(a, b, [before, None]), None) for pair in zip(c[0].to_pylist(), c[1].to_pylist())]
            before += next(iter(ranges.count_lines(f, Where(a, b), None)))[2][0].as_py()
        assert got == list(enumerate(expected)) and before == len(expected)


def test_limit_reads_the_ranges_that_hold_it(spark, tmp_path):
    for name, first in (("part-0", 0), ("part-1", 1000), ("_hidden", 9)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(first, first + 1000)))
    rows = ranges.lines(spark, str(tmp_path), 1100, range_bytes=500).collect()
    assert sorted((r.number, r.line) for r in rows) == [(i, f"line {i}") for i in range(1100)]
    assert len(ranges.line_index(spark, str(tmp_path), 500, limit=10)) == 1
    assert ranges.lines(spark, str(tmp_path), 0).count() == 0
    assert ranges.lines(spark, str(tmp_path)).count() == 2000


def test_records_through_spark(spark, tmp_path):
    rows = [{"a": "x" * i, "b": ['"}', {"c": i}]} for i in range(200)]
    (tmp_path / "big.json").write_text(json.dumps({"results": {"bindings": rows}}, indent=1))
    for size in (100, 1 << 20):
        got = ranges.nested_records(spark, str(tmp_path / "big.json"), ["results", "bindings"], size).collect()
        assert sorted((json.loads(r.record)["b"][1]["c"] for r in got)) == list(range(200))
