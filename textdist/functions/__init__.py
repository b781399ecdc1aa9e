"""Column expressions: text, hash keys, vectors, BLEU arithmetic and prompts."""
