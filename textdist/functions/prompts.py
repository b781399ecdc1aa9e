"""Prompt texts of the three tasks, as column expressions."""

from pyspark.sql import functions as F

from textdist.functions.text import first_words, words

# Wording of the prompts.
CONTINUE_PHRASE = "Continue the following text:\n\n"
LENGTH_HINT = " Your text should be approximately between {low} and {high} words."
CREATIVE_PLAIN_HEAD = "Below is a text following the instructions:\n\n"
CREATIVE_PLAIN_TAIL = "\n\n### Text:\n\n"
CREATIVE_CHAT_TAIL = "Sure here is a proposition:\n\n"
BIO_HEADER = "Write biographies of various people. Here are a few examples:\n\n"
BIO_INSTRUCTION = "- Biography of"

# Instructions of the creative task.
CREATIVE_PROMPTS = (
    "Write about a dream you had.",
    "Create and write about a new character.",
    "Write about a place you'd love to visit.",
    "Write about an important life event.",
    "Write about life 100 years from now.",
    "Write a story where magic exists in everyday life.",
    "Write a poem about a personal experience.",
    "Write a speech for a cause you believe in.",
    "Write a short mystery story.",
    "Write a modern day fairy tale.",
    "Write a story set in a historical period.",
    "Write a story about a technological advancement.",
    "Write a letter to your future self.",
    "Write a story from an animal's perspective.",
    "Write a week's worth of diary entries for a character.",
    "Write a short story using mythological characters.",
    "Write a conversation between two characters.",
    "Write about a day in your life.",
    "Write a series of Haikus about seasons.",
    "Describe a place without naming it.",
    "Write a news article about an event in your town.",
    "Write a recipe with a story.",
    "Write a one-act play.",
    "Write a story set in a dystopian future.",
    "Write a satirical essay on a trending topic.",
    "Write a humorous comic strip.",
    "Write a piece inspired by nature.",
    "Write a short story about your favorite fictional character.",
    "Write instructions for an invented machine.",
    "Write a story using only metaphors.",
    "Write a script for a short film.",
    "Write a conversation in text message format.",
    "Write a limerick about a funny event.",
    "Write a story about a journey to space.",
    "Write a script for a documentary on a subject of your choice.",
    "Write a eulogy for a character from your favorite book.",
    "Write a script for a radio show.",
    "Write a song about a memorable event.",
    "Write a story with a hidden meaning.",
    "Write a fable with a moral.",
    "Write a comedic monologue.",
    "Write an opinion piece on a current event.",
    "Write a parody of a popular book or movie.",
    "Write a story where a character has a magical power.",
    "Write a story about time travel.",
    "Write a story based on an object in a mystery box.",
    "Write a ghost story.",
    "Describe a haunted house without using cliché descriptions.",
    "Write a story about a conspiracy theory.",
    "Write a story about a non-traditional superhero.",
)

TASKS = ("webtext", "creative", "wikipedia_bio")


def continuation_prompt(text, k, chat=None):
    """First ``k`` words; in chat form the k-th word opens the answer. A chat prompt
    of a text shorter than ``k`` words is null."""
    if chat is None:
        return first_words(text, k)
    return F.concat(
        F.lit(f"{chat[0]} {CONTINUE_PHRASE}"),
        first_words(text, k - 1),
        F.lit(f" {chat[1]} "),
        F.get(words(text), F.lit(k - 1)),
    )


def creative_prompt(prompt, low=100, high=500, chat=None):
    asked = F.concat(prompt, F.lit(LENGTH_HINT.format(low=low, high=high)))
    if chat is None:
        return F.concat(F.lit(CREATIVE_PLAIN_HEAD), asked, F.lit(CREATIVE_PLAIN_TAIL))
    return F.concat(F.lit(f"{chat[0]} "), asked, F.lit(f" {chat[1]} {CREATIVE_CHAT_TAIL}"))


def in_context_prompt(examples, n_icl, header=BIO_HEADER, instruction=BIO_INSTRUCTION, chat=None):
    """``examples`` is ``array<struct<title, content>>``; the first ``n_icl`` are shown."""
    shown = F.transform(
        F.slice(examples, 1, n_icl),
        lambda e: F.concat(F.lit(f"{instruction} "), e["title"], F.lit(":\n\n"), e["content"]),
    )
    opening, closing = (f"{chat[0]} ", f" {chat[1]}") if chat else ("", "")
    return F.concat(
        F.lit(opening + header), F.array_join(shown, "\n\n"), F.lit(f"{closing}\n\n{instruction}")
    )


def build_prompts(df, task, out="prompt_text", **params):
    """Add the prompt column of a named task."""
    if task == "webtext":
        col = continuation_prompt(F.col("text"), params.get("top_k_words", 50), params.get("chat"))
    elif task == "creative":
        col = creative_prompt(F.col("prompt"), params.get("low", 100), params.get("high", 500), params.get("chat"))
    elif task == "wikipedia_bio":
        col = in_context_prompt(
            F.col("examples"),
            params.get("n_icl", 1),
            params.get("header", BIO_HEADER),
            params.get("instruction", BIO_INSTRUCTION),
            params.get("chat"),
        )
    else:
        raise ValueError(f"unknown task {task!r}, expected one of {TASKS}")
    return df.withColumn(out, col)
