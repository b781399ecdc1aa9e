"""Language identification of web pages by Bayesian evidence fusion.

Three kinds of evidence meet in log odds: the text's likelihood under naive Bayes models of hashed byte trigrams,
trained on labelled documents; the language the markup declares; and priors of the address, smoothed level
by level: host, site (last two labels), address suffix (last label), all pages. The priors are sums of the pages' posteriors from
text and markup, by grouped aggregation; a page's own share is taken out of its host's sums before it is judged.

Rows of a hot host meet the priors in one small join row per page (no text), which adaptive execution can split.
The text models are a languages x buckets table; the priors' upper levels are read from aggregates of the hosts.

Edges: a page without text, url or markup falls back on the evidence it has, at last on the share of each language over
all pages. Ties go to the first language by name. Null and repeated page ids keep their rows. Labels that are
null are not trained on; without any label there is no language, and every page gets null.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textdist.llm.bytesbatch import flat, slices
from textdist.session import cut_lineage

BUCKETS = 1 << 16
MOST_LANGUAGES = 200


def visible(html):
    """Text of a page: comments, scripts, styles and tags cut away, as a column."""
    x = F.coalesce(html.cast("string"), F.lit(""))
    x = F.regexp_replace(x, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"<[^<>]*>", " ")
    return F.regexp_replace(x, r"&[#a-zA-Z0-9]+;?", " ")


def trigrams(data, offs):
    """Bucket of the byte trigram at every position and the position's text; trigrams stay inside a text. A-Z are lowered."""
    d = data.astype(np.uint32)
    d[(data >= 65) & (data <= 90)] += 32
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = text[:-2] == text[2:]
    return key[inside].astype(np.int64), text[:-2][inside]


def train(labelled, text="text", lang="lang"):
    """Rows (lang, bucket, n): trigram counts of the labelled texts. A task sums its own rows first."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))

    def run(batches):
        counts = {}
        for batch in batches:
            for part in slices(batch, "t"):
                names = np.array(part.column("l").to_pylist())
                key, text_of = trigrams(*flat(part.column("t")))
                for name in np.unique(names):
                    mine = (names == name)[text_of]
                    own = counts.setdefault(str(name), np.zeros(BUCKETS, np.int64))
                    own += np.bincount(key[mine], minlength=BUCKETS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model_of(counts):
    """(languages, log probabilities [language, bucket], float32). At most MOST_LANGUAGES x BUCKETS rows reach the driver."""
    if counts.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = counts.toPandas()
    names = sorted(rows["lang"].unique())
    table = np.full((len(names), BUCKETS), 0.5)
    np.add.at(table, (rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), rows["bucket"].to_numpy(int)), rows["n"].to_numpy(float))
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def likelihoods(pages, model, key, text, carry):
    """Rows (key, carried columns, n_bytes, loglik array<double>) for the texts in column ``text``."""
    names, logs = model
    keep = pages.select(*[F.col(c) for c in carry], F.col(text).alias("_t"))
    types = dict(keep.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", n_bytes long, loglik array<double>"
    shared = keep.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        table = shared.value
        for batch in batches:
            for part in slices(batch, "_t"):
                data, offs = flat(part.column("_t"))
                bucket, text_of = trigrams(data, offs)
                n = len(offs) - 1
                out = np.stack([np.bincount(text_of, row[bucket], n) for row in table], 1) if len(names) else np.zeros((n, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(np.diff(offs)), lists], names=[*carry, "n_bytes", "loglik"])

    return keep.mapInArrow(run, schema)


def _softmax(logs):
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def _sums(names, share):
    return [F.sum(F.get(share, F.lit(i))).alias(f"s{i}") for i in range(len(names))]


def address(url):
    """Host, site (last two labels) and suffix (last label) of an address, lower case; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def declared(html):
    """Primary subtag of the language the root element declares; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))


def identify(pages, labelled, key="page_id", url="url", html="html", text="text", lang="lang",
             trust=0.9, root=0.5, weights=(20.0, 20.0, 20.0), floor=0.01):
    """Rows (key, host, declared, text_lang, lang, confidence, n_bytes), one per page.

    ``trust`` is the chance that a declaration is true; text log odds are divided by the number of trigrams to the power ``root``
    (neighbouring trigrams are not independent); ``weights`` are the pages' worth of the parent level in a suffix, site and host."""
    names, logs = model_of(train(labelled, text, lang))
    host, site, suffix = address(F.col(url))
    rows = pages.select(F.col(key).alias("_k"), host.alias("host"), site.alias("site"), suffix.alias("suffix"), declared(F.col(html)).alias("declared"), visible(F.col(html)).alias("_v"))
    if not names:
        return rows.select(F.col("_k").alias(key), "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("confidence"), F.octet_length("_v").cast("long").alias("n_bytes"))
    langs, n = F.array(*map(F.lit, names)), len(names)
    rows = likelihoods(rows, (names, logs), key, "_v", ["_k", "host", "site", "suffix", "declared"])
    scale = F.pow(F.greatest(F.col("n_bytes"), F.lit(1)).cast("double"), F.lit(root))
    other = (1 - trust) / max(1, n - 1)
    markup = F.transform(langs, lambda l: F.when(F.array_contains(langs, F.col("declared")), F.log(F.when(l == F.col("declared"), F.lit(trust)).otherwise(F.lit(max(other, 1e-9))))).otherwise(F.lit(0.0)))
    rows = rows.select("*", F.transform("loglik", lambda x: x / scale).alias("tl"), markup.alias("ml"))
    rows = rows.select("*", _softmax(F.zip_with("tl", "ml", lambda a, b: a + b)).alias("share"))
    rows = cut_lineage(rows.select("_k", "host", "site", "suffix", "declared", "n_bytes", "tl", "ml", "share"))

    hosts = rows.groupBy("suffix", "site", "host").agg(*_sums(names, "share"), F.count(F.lit(1)).alias("pages"))
    add = lambda df, by: df.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)], F.sum("pages").alias("pages"))
    sites = add(hosts, ["suffix", "site"])
    suffixes = add(sites, ["suffix"])
    whole = suffixes.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)], F.sum("pages").alias("pages")).first()
    base = [((whole[f"s{i}"] or 0.0) + 1.0) / ((whole["pages"] or 0) + n) for i in range(n)]

    def smoothed(df, parent, weight):
        up = parent if isinstance(parent, list) else [F.get(parent, F.lit(i)) for i in range(n)]
        return F.array(*[(F.col(f"s{i}") + weight * up[i]) / (F.col("pages") + weight) for i in range(n)])

    suffixes = suffixes.select("suffix", smoothed(suffixes, [F.lit(b) for b in base], weights[0]).alias("up"))
    sites = sites.join(suffixes, "suffix").select("suffix", "site", smoothed(sites, F.col("up"), weights[1]).alias("up"))
    hosts = hosts.join(sites, ["suffix", "site"]).select("host", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("sums"), "pages", "up")

    met = rows.join(hosts, "host")
    rest = F.zip_with("sums", "share", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = F.zip_with(rest, "up", lambda a, u: F.log(F.greatest((a + weights[2] * u) / (F.col("pages") - 1 + weights[2]), F.lit(floor / n))))
    met = met.select("*", _softmax(F.zip_with(F.zip_with("tl", "ml", lambda a, b: a + b), prior, lambda a, b: a + b)).alias("post"))
    best = lambda p: F.get(langs, F.array_position(p, F.array_max(p)).cast("int") - 1)
    return met.select(F.col("_k").alias(key), "host", "declared", best(F.col("tl")).alias("text_lang"), best(F.col("post")).alias("lang"),
                      F.round(F.array_max("post"), 6).alias("confidence"), "n_bytes")
