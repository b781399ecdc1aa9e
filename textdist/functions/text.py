"""Text columns. A word is what lies between single spaces, so two spaces in a row
enclose an empty word, as in ``str.split(" ")``."""

from pyspark.sql import functions as F

# Word and character limits of the three evaluation tasks.
MIN_CORPUS_WORDS = 10
MIN_BIO_WORDS = 80
MAX_BIO_WORDS = 350
CONTINUATION_LIMIT = 370
CREATIVE_LIMIT = 500

# Fixed value: where a generated biography ends and the next one begins.
BIO_DELIMITER = r"\n\n- Biography|\n\n#"


def words(col):
    return F.split(col, " ", -1)


def word_count(col):
    return F.size(words(col))


def first_words(col, k):
    return F.substring_index(col, " ", k)


def has_more_words_than(col, k=MIN_CORPUS_WORDS):
    return word_count(col) > k


def words_between(col, low=MIN_BIO_WORDS, high=MAX_BIO_WORDS):
    return word_count(col).between(low, high)


def continuation_text(text, prediction, k=10, limit=CONTINUATION_LIMIT, unit="chars"):
    """Prompt prefix plus prediction. The limit counts characters; ``unit='words'`` counts words."""
    joined = F.concat(first_words(text, k), F.lit(" "), prediction)
    if unit == "chars":
        return F.substring(joined, 1, limit)
    if unit == "words":
        return first_words(joined, limit)
    raise ValueError(f"unknown unit {unit!r}")


def reference_text(text, limit=CONTINUATION_LIMIT):
    return first_words(text, limit)


def creative_text(prediction, limit=CREATIVE_LIMIT):
    return first_words(prediction, limit)


def before_delimiter(col, pattern=BIO_DELIMITER):
    return F.split(col, pattern, 2)[0]


def title_and_content(title, content):
    return F.concat(title, F.lit(":\n\n"), content)


def tokens_per_word(token_count, row_word_count):
    """Corpus ratio: all tokens over all words."""
    return F.sum(token_count) / F.sum(row_word_count)
