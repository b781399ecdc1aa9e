"""Registered queries of the operators, each with production parameters over its whole table."""

from pyspark.sql import functions as F

from textdist.llm import backoff, chat, decontam, jaccard, jaccard_sql, langid, licences, periodic, resample, sharding, suffixes, warc
from textdist.session import scratch_path

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_fertility")
def op3_fertility(spark, folder):
    from textdist.llm.quality import quality

    rows = quality(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), lang="lang")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "n_tokens", "chars_per_token", "byte_share", "token_entropy", "band")


@query("op5_byte_bpe")
def op5_byte_bpe(spark, folder):
    from textdist.llm.bpe import round_trip

    return round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@query("op4_winnowing", decontam.SQL)
def op4_winnowing(spark, folder):
    rows = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.drop("_x")


@query("op7_extendible_hashing", sharding.SQL)
def op7_extendible_hashing(spark, folder):
    return sharding.assign(table(spark, folder, "documents"), limit=1 << 20)


@query("op6_licence_dice", licences.SQL)
def op6_licence_dice(spark, folder):
    return licences.scan(table(spark, folder, "documents"))


@query("op10_language_evidence")
def op10_language_evidence(spark, folder):
    return langid.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query("op2_warc")
def op2_warc(spark, folder):
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), path)
    return warc.page_records(spark, path)


@query("op8_jaccard_trie", jaccard_sql.SQL)
def op8_jaccard_trie(spark, folder):
    return jaccard.classes(table(spark, folder, "documents")).drop("class_id")


@query("op1_suffix_array")
def op1_suffix_array(spark, folder):
    return suffixes.remove(table(spark, folder, "documents")).drop("kept")


@query("op9_stupid_backoff_order3", backoff.SQL_3)
def op9_stupid_backoff_order3(spark, folder):
    rows = backoff.score(table(spark, folder, "documents"), order=3)
    return rows.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


@query("op9_stupid_backoff", backoff.SQL)
def op9_stupid_backoff(spark, folder):
    rows = backoff.score(table(spark, folder, "documents"))
    return rows.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


@query("op11_importance_resampling", resample.SQL)
def op11_importance_resampling(spark, folder):
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, folder):
    return periodic.digests(table(spark, folder, "documents"), tails=periodic.planted_tails)


@query("op13_chat_formatting", chat.SQL)
def op13_chat_formatting(spark, folder):
    hostile = spark.createDataFrame([(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(hostile))
