"""Token-id arrays: vocabulary lookup, assembly, padding and cutting."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textdist.functions.text import words
from textdist.operators.joins import lookup_join
from textdist.operators.sampling import with_batches

# Ids of the run configurations.
BOS_ID = 1
EOS_ID = 2
PAD_ID = 2
PAD_MULTIPLE = 8


def split_tokens(col):
    return words(col)


def encode_with_vocabulary(df, key, text, vocab, out="ids", unknown=0):
    """Words to ids through a ``(token, token_id)`` table; unlisted words become ``unknown``. A null text has null ids."""
    # Whole texts move to their key first; words meet a broadcast vocabulary and regroup in place.
    dealt = df.repartition(key)
    placed = dealt.select(key, F.posexplode(words(F.col(text))).alias("_p", "token"))
    found = lookup_join(placed, vocab.select("token", "token_id"), ["token"], F.col(key), "left")
    ids = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("token_id", F.lit(unknown)).alias("i")))).alias("_e"))
    ids = ids.select(F.col(key).alias("_key"), F.transform("_e", lambda e: e["i"]).alias(out))
    return dealt.join(ids, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def decode_with_vocabulary(df, key, ids, vocab, out="text", special_ids=(BOS_ID, EOS_ID), separator=" ", unknown="<unk>"):
    """Ids to text through a ``(token, token_id)`` table, special ids dropped first; ids it lacks become ``unknown``. Null ids have a null text."""
    plain = F.filter(ids, lambda i: ~i.isin(*special_ids)) if special_ids else F.col(ids)
    dealt = df.repartition(key)
    placed = dealt.select(key, F.posexplode(plain).alias("_p", "token_id"))
    found = lookup_join(placed, vocab.select("token", "token_id"), ["token_id"], F.xxhash64(key, "_p"), "left")
    text = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("token", F.lit(unknown)).alias("token")))).alias("_e"))
    decoded = text.select(F.col(key).alias("_key"), F.array_join(F.transform("_e", lambda e: e["token"]), separator).alias("_text"))
    rows = dealt.join(decoded, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.withColumn(out, F.when(F.col(ids).isNotNull(), F.coalesce("_text", F.lit("")))).drop("_key", "_text")


def model_input(ids, max_length, bos=BOS_ID, in_context=False):
    """(input_ids, token_type_ids): ids cut to the limit after a BOS id, and as many zeros.
    In-context prompts give one place of the limit to the BOS id."""
    kept = max_length - 1 if in_context else max_length
    full = F.concat(F.array(F.lit(bos).cast("int")), F.slice(ids, 1, kept))
    return full, F.array_repeat(F.lit(0), F.size(full))


def _padded(df, ids, batch, side, pad, multiple, token_types=None):
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    width = F.ceil(longest / multiple) * multiple
    gap = (F.col("_width") - F.size(ids)).cast("int")
    fill = lambda v: F.array_repeat(F.lit(v).cast("int"), gap)
    ones = F.array_repeat(F.lit(1), F.size(ids))
    wide = df.withColumn("_width", width)
    if side not in ("left", "right"):
        raise ValueError(f"side must be 'left' or 'right', got {side!r}")
    place = (lambda gap, kept: F.concat(gap, kept)) if side == "left" else (lambda gap, kept: F.concat(kept, gap))
    filled = {"attention_mask": place(fill(0), ones), ids: place(fill(pad), F.col(ids))}
    if token_types is not None:
        filled[token_types] = place(fill(0), F.col(token_types))
    return wide.withColumns(filled).drop("_width")


def batch_width(df, ids, batch, out="batch_width"):
    """Longest array of each batch; a batch has a fixed number of rows."""
    return df.withColumn(out, F.max(F.size(ids)).over(Window.partitionBy(batch)))


def pad_right(df, key, ids, batch_size, pad=0):
    """Batches in key order, arrays filled at the end to the batch maximum, with a mask."""
    return _padded(with_batches(df, key, batch_size), ids, "batch", "right", pad, 1)


def collate(df, key, ids, batch_size, pad=PAD_ID, multiple=PAD_MULTIPLE, token_types=None):
    """Batches in key order, arrays filled in front to the batch maximum rounded up to a
    multiple, with a mask. ``token_types`` names an array column as long as the ids, filled with zeros."""
    return _padded(with_batches(df, key, batch_size), ids, "batch", "left", pad, multiple or 1, token_types)


def drop_prompt(ids, prompt_len):
    return F.slice(ids, prompt_len + 1, F.greatest(F.size(ids), F.lit(1)))


def cut_at_eos(ids, eos=EOS_ID):
    """Up to and with the first EOS id; all of it when there is none."""
    at = F.array_position(ids, F.lit(eos).cast("int"))
    return F.slice(ids, F.lit(1), F.when(at > 0, at.cast("int")).otherwise(F.size(ids)))
