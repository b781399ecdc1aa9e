"""Quality rules: tokeniser fertility.

Every word of a text is encoded by a public vocabulary. A text has three measures: characters per
token, the share of tokens that are single bytes (what the vocabulary lacks), and the entropy of its
tokens relative to the most its token count allows. A band belongs to a language, else to the script
of most letters, else to all. Byte share and entropy have fixed limits per band. The limits of characters per
token are fitted: median and spread over the distinct texts of the band, so copies do not count. The variance of a text is
that of its tokens, which falls with their count, and that between texts, which does not. Both have a floor, so a group
of near copies does not narrow a band.

Edges: null and empty texts have no words, all counts 0, and fail the base rules. Rows keep their
keys, repeated and null keys included. A text under ``min_tokens`` tokens is not judged by entropy; a band
with fewer than ``min_texts`` distinct texts is judged by its parent's fit (script, then all texts), and by fixed limits if that has too few as well.
"""

from collections.abc import Mapping
from itertools import chain

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textdist.session import cut_lineage
from textdist.llm.bytesbatch import SPACE, flat, mix, packed, slices, spans, sums, tidy

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
#: bytes of a task's cache of words, their objects included, and of the texts worked at once
CACHE_BYTES, WORD_BYTES = 48 << 20, 160
SLICE_BYTES = 1 << 20

#: most byte share, least relative entropy
BANDS = {
    "default": (0.50, 0.30),
    "en": (0.05, 0.35),
    "de": (0.08, 0.35),
    "fr": (0.08, 0.35),
    "es": (0.08, 0.35),
    "Latin": (0.15, 0.35),
    "Cyrillic": (0.15, 0.35),
    "Greek": (0.40, 0.30),
    "Han": (0.70, 0.30),
}

#: the band whose fit stands in for a band of few texts; of all others "default", to which every text belongs
PARENTS = {"en": "Latin", "de": "Latin", "fr": "Latin", "es": "Latin"}

#: least and most characters per token where no band can be fitted
FIXED = {"default": (0.25, 12.0), "Latin": (1.25, 12.0), "Cyrillic": (1.0, 12.0), "Greek": (0.4, 12.0), "Han": (0.25, 4.0)}

#: least deviation of one token and between texts, in parts of the median
LEAST_SPREAD, LEAST_BETWEEN = 0.25, 0.01

#: first and last code point of the letters that decide a script
SCRIPTS = (("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Han", 0x4E00, 0x9FFF))

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURES = "n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string, inside boolean"


class Pieces:
    """Token ids of words, looked up once for each distinct word while it stays in the cache."""

    def __init__(self, model):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)])
        self.forget()

    def forget(self):
        self.known, self.ids, self.bounds, self.held = {}, np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def rows(self, words):
        """Row of each word in the ragged array (ids, bounds) of known words."""
        if self.held > CACHE_BYTES:
            self.forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            made = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.held += sum(map(len, new)) + WORD_BYTES * len(new) + 4 * int(sizes.sum())
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def ragged(bounds, index):
    """Positions of the elements of rows ``index`` of a ragged array, and the new bounds."""
    lengths = (bounds[1:] - bounds[:-1])[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[index], lengths)
    return at, out


def repeated_words(ids, bounds, window=WINDOW):
    """Per text, words inside a window of ``window`` words that occurs twice or more in the text."""
    n = len(ids)
    if n < window:
        return np.zeros(len(bounds) - 1, np.int64)
    value = mix(ids)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = mix(text[: n - window + 1]).copy()
    for j in range(window):
        key += value[j : n - window + 1 + j] * np.uint64(2 * (j * 0x2545F4914F6CDD1D + 0x1B873593) + 1 & (1 << 64) - 1)
    whole = text[: n - window + 1] == text[window - 1 :]
    at = np.flatnonzero(whole)
    key = key[at]
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    first = np.zeros(n, bool)
    first[at[order[same]]] = True
    first[at[order[same + 1]]] = True
    covered = first.copy()
    for j in range(1, window):
        covered[j:] |= first[:-j]
    return sums(covered, bounds)


def duplicate_lines(data, offs):
    raw, out = data.tobytes(), np.zeros(len(offs) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        out[i] = len(lines) - len(set(lines))
    return out


def entropies(tokens, bounds, size):
    """Entropy in bits of each text's tokens, divided by the most its token count allows."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n), dtype=np.int64), n)
    key = np.sort(text * size + tokens)
    out = np.zeros(len(n))
    if len(key):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[edge, len(key)]).astype(float)
        part = np.bincount(key[edge] // size, count * np.log2(count), len(n))
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.log2(n) - part / n
            most = np.log2(np.minimum(n, size))
            out = np.where(n > 1, bits / most, 0.0)
    return out


def scripts(data, offs):
    """Name of the script of most letters of each text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    bounds = np.r_[0, np.cumsum(lead)][offs] if len(data) else np.zeros(len(offs), np.int64)
    bounds = np.minimum(bounds, len(points))
    counts = np.stack([sums((points >= a) & (points <= b), bounds) for _, a, b in SCRIPTS])
    names = np.array([s for s, _, _ in SCRIPTS])
    return np.where(counts.max(0) > 0, names[counts.argmax(0)], "default")


def band_of(langs, data, offs, bands):
    """The band each text is judged by: its language's, else its script's, else the default."""
    found = [x if x in bands else None for x in langs]
    if None in found:
        by_script = scripts(data, offs).tolist()
        found = [x or (s if s in bands else "default") for x, s in zip(found, by_script)]
    return found


def measure(data, offs, langs, pieces, bands, min_words, max_repeat, min_tokens):
    starts, ends = spans(data, offs, SPACE)
    bounds = np.searchsorted(starts, offs)
    n_words = np.diff(bounds)
    chars = sums(((data & 0xC0) != 0x80) & ~SPACE[data], offs)
    words = packed(data, starts, ends).dictionary_encode()
    index = words.indices.to_numpy()
    repeat = repeated_words(index, bounds)
    failed = (n_words < min_words) | (100 * repeat > max_repeat * n_words)
    row = pieces.rows(words.dictionary.to_pylist())[index]
    at, token_bounds = ragged(pieces.bounds, row)
    tokens, token_bounds = pieces.ids[at], token_bounds[bounds]
    n_tokens = np.diff(token_bounds)
    byte = sums(pieces.byte[tokens], token_bounds)
    entropy = entropies(tokens.astype(np.int64), token_bounds, pieces.size)
    some = np.maximum(n_tokens, 1)
    per_token, share = chars / some, byte / some
    band = band_of(langs, data, offs, bands)
    most_bytes, least = np.array([bands[b] for b in band], float).reshape(-1, 2).T
    good = (share <= most_bytes) & ((entropy >= least) | (n_tokens < min_tokens))
    return [n_words, chars, sums(SYMBOLS[data], offs), duplicate_lines(data, offs), repeat, failed,
            n_tokens, per_token, share, entropy, band, good]


def measures(df, model, key="doc_id", text="text", lang=None, carry=(), bands: Mapping = BANDS, min_words=10, max_repeat=20, min_tokens=50):
    """Rows (key, text_hash, base counts, measures, band, inside: within the fixed limits), one per row of ``df``; columns in ``carry``
    come along as _c0, _c1 and so on, so no join is needed to keep or drop rows. A text that is measured and carried goes to Python once."""
    bands = dict(bands)
    once = df.schema[text].dataType.typeName() == "string"
    held = ["text_hash", *(f"_c{i}" for i in range(len(carry)))]
    kept = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("_l"),
                     F.xxhash64(F.col(text).cast("string")).alias("text_hash"), *[F.col(c).alias(h) for c, h in zip(carry, held[1:]) if not (once and c == text)])
    source = {h: "_t" if once and c == text else h for c, h in zip([None, *carry], held)}
    types = dict(kept.dtypes)
    types.update({h: types[c] for h, c in source.items()})
    schema = ", ".join(f"{c} {types[c]}" for c in ["_k", *held]) + f", {BASE}, {MEASURES}"
    names = ["_k", *held, *(c.split()[0] for c in f"{BASE}, {MEASURES}".split(", "))]

    def run(batches):
        pieces = Pieces(model)
        for batch in batches:
            for part in slices(batch, "_t", SLICE_BYTES):
                data, offs = flat(part.column("_t"))
                made = measure(data, offs, part.column("_l").to_pylist(), pieces, bands, min_words, max_repeat, min_tokens)
                yield pa.RecordBatch.from_arrays([part.column("_k"), *(part.column(source[h]) for h in held), *map(pa.array, made)], names=names)

    return kept.mapInArrow(tidy(run), schema).withColumnRenamed("_k", key)


def lineage(band):
    """The band and those whose fit can stand in for it, nearest first."""
    return list(dict.fromkeys([band, PARENTS.get(band, "default"), "default"]))


def fitted(rows, bands=BANDS, min_texts=30):
    """Rows (band, middle, spread, between, least, most), one per name in ``bands``: median characters per token over distinct texts, the
    deviation of a text of one token and that between texts (median absolute deviations, scaled to standard deviations); null
    where neither the band nor its parents have ``min_texts`` texts, and fixed limits. Aggregations; one row per band reaches the driver."""
    ways = F.create_map(*chain.from_iterable((F.lit(b), F.array(*map(F.lit, lineage(b)))) for b in bands))
    used = rows.where("NOT base_failed AND n_tokens > 0").select(F.explode(ways[F.col("band")]).alias("band"), "text_hash", "chars_per_token", "n_tokens")
    once = cut_lineage(used.groupBy("band", "text_hash").agg(F.first("chars_per_token").alias("x"), F.first("n_tokens").alias("n")))
    middle = once.groupBy("band").agg(F.percentile_approx("x", 0.5, 10000).alias("middle"), F.percentile_approx("n", 0.75, 10000).alias("long"), F.count(F.lit(1)).alias("texts"))
    away, far = F.abs(F.col("x") - F.col("middle")), F.col("n") >= F.col("long")
    found = once.join(F.broadcast(middle.where(F.col("texts") >= min_texts)), "band").groupBy("band").agg(
        F.first("middle").alias("middle"), (1.4826 * F.percentile_approx(away * F.sqrt("n"), 0.5, 10000)).alias("spread"),
        (1.4826 * F.percentile_approx(F.when(far, away), 0.5, 10000)).alias("apart"), F.percentile_approx(F.when(far, F.col("n")), 0.5, 10000).alias("size"))
    fit = {}
    for r in found.collect():
        spread = max(r.spread, LEAST_SPREAD * r.middle)
        # what the longest quarter of the texts deviates beyond its tokens
        between = max(r.apart**2 - spread**2 / r.size, (LEAST_BETWEEN * r.middle) ** 2) ** 0.5
        fit[r.band] = (r.middle, spread, between)
    made = [(b, *next((fit[x] for x in lineage(b) if x in fit), (None,) * 3), *next(FIXED[x] for x in lineage(b) if x in FIXED)) for b in bands]
    return rows.sparkSession.createDataFrame(made, "band string, middle double, spread double, between double, least double, most double")


def quality(df, model, deviations=4.0, min_texts=30, bands: Mapping = BANDS, **options):
    """``measures`` with the verdict ``kept``. ``model`` is the path of a sentencepiece vocabulary that every
    executor has, ``lang`` a column of language codes or None. The measures are written once to the
    shared folder; the bands (at most as many as ``bands`` has) are broadcast."""
    rows = cut_lineage(measures(df, model, bands=bands, **options))
    x, n = F.col("chars_per_token"), F.greatest("n_tokens", F.lit(1))
    room = deviations * F.sqrt(F.col("spread") * F.col("spread") / n + F.col("between") * F.col("between"))
    usual = F.when(F.col("middle").isNull(), x.between(F.col("least"), F.col("most"))).otherwise(F.abs(x - F.col("middle")) <= room)
    inside = F.col("inside") & ((F.col("n_tokens") == 0) | usual)
    return rows.join(F.broadcast(fitted(rows, bands, min_texts)), "band", "left").withColumn("kept", ~F.col("base_failed") & inside).drop("inside", "text_hash", "least", "most")
