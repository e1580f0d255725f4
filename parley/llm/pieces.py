"""Long texts as rows of bounded size, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a piece; the word at its end is left whole.
PIECE = 1 << 16


def pieces(text: Column, word: str, gap: str = "", ahead: int = 0, size: int = PIECE) -> Column:
    """array<struct<piece, next>> of a text, null for null: cut after at least `size` characters and the rest
    of a word, so that no word is cut; `next` starts the following piece and has its first `ahead` words.
    `word` and `gap` are character classes, of words and of all else. The pieces in a row are the text."""
    cut = f"(?s).{{1,{size}}}{word}*+"
    follows = f"{cut}(?=((?:{gap}*+{word}++){{0,{ahead}}}+))"
    whole = F.array(F.struct(text.alias("piece"), F.lit("").alias("next")))
    if not ahead:
        many = F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(0)), lambda p: F.struct(p.alias("piece"), F.lit("").alias("next")))
    else:
        zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(cut), F.lit(0)).alias("piece"), F.regexp_extract_all(text, F.lit(follows), F.lit(1)).alias("next"))
        many = F.transform(zipped, lambda p: F.struct(p["piece"].alias("piece"), p["next"].alias("next")))
    return F.when(F.length(text) <= size, whole).when(text.isNotNull(), many)
