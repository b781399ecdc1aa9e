"""The corpus pipeline and the registered queries of the package."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import compare, database  # noqa: E402

import corpus_pipeline  # noqa: E402
from textdist.llm import queries, stages  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    text, good = compare(spark, database(FOLDER), FOLDER, name, queries.QUERIES[name], queries.SQL.get(name))
    assert good, text


def test_stages_on_messy_rows(spark, messy):
    """Columns stay those of documents, and every stage's output is a sound input of the next."""
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stages.written(stage(spark, docs, FOLDER), name)
        assert out.columns == stages.COLUMNS and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, nothing, name, stage):
    assert stage(spark, nothing, FOLDER).count() == 0


def test_stages_take_effect(spark):
    """Each stage against the operators' rules by brute force, on the documents it is given."""
    from tests.llm.test_corpus import contaminated, removed, shingles

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in stages.near_duplicates(spark, docs, FOLDER).collect()}
    sets = {k: shingles(t) for k, t in rows.items()}
    least = {a: a for a in rows}

    def head(a):
        while least[a] != a:
            a = least[a]
        return a

    for a in rows:
        for b in rows:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((head(a), head(b)))
                least[y] = x
    assert set(kept) == {a for a in rows if head(a) == a} and len(kept) < len(rows)
    assert all(rows[a] == text for a, text in kept.items())
    good = {r.doc_id for r in queries.QUERIES["op3_fertility"](spark, FOLDER).where("kept").collect()}
    judged = {r.doc_id: r.text for r in stages.quality_rules(spark, docs, FOLDER).collect()}
    assert set(judged) == good and len(good) < len(rows) and all(rows[a] == text for a, text in judged.items())
    want = removed(list(rows.items()), 100)
    for r in stages.repeated_passages(spark, docs, FOLDER).collect():
        assert abs(len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1])) <= 6 * want[r.doc_id][2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {x[0] for x in contaminated(list(rows.items()), items) if x[-1]}
    assert {r.doc_id for r in stages.decontaminated(spark, docs, FOLDER).collect()} == set(rows) - bad and bad


def test_rows_of_one_id_keep_the_same_text(spark):
    texts = [" ".join(f"{w}{i}" for i in range(20)) for w in "abc"]
    kept = set()
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame([(1, t, "en", "s", len(t)) for t in order], "doc_id long, text string, lang string, source string, n_chars long")
        rows = stages.near_duplicates(spark, docs.repartition(3), FOLDER).collect()
        assert len(rows) == 1
        kept.add(rows[0].text)
    assert len(kept) == 1


def test_task_gives_back_memory(spark):
    """A worker that worked on texts of several MB holds hardly more after the task than before."""
    import re

    import numpy as np
    import pyarrow as pa

    from textdist.llm import bpe
    from textdist.llm.queries import vocabulary

    class Rows:
        dtypes = [("doc_id", "bigint")]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def withColumnRenamed(self, old, new):
            return self

    def held():
        found = re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())
        return int(found.group(1)) / 1024

    def batches(seed, rows):
        words = np.random.default_rng(seed).integers(0, 1 << 40, (rows, 250))
        texts = [" ".join(f"{w:x}" for w in row) for row in words.tolist()]
        yield pa.record_batch([pa.array(range(rows), pa.int64()), pa.array(texts)], ["_k", "_t"])

    plan = Rows()
    bpe.round_trip(plan, vocabulary("byte_bpe_multi_50k.tiktoken"))
    list(plan.run(batches(1, 10)))
    before = held()
    assert sum(b.num_rows for b in plan.run(batches(2, 3000))) == 3000
    assert held() - before < 40
