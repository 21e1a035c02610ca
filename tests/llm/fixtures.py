"""Small tables with every odd case."""

from __future__ import annotations

import random

LETTERS = "the of and thing wherer stone anly und nicht que les ciónar".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


PASSAGE = prose(999, 60)

ODD_ROWS = [
    (1, prose(1, 80), "en", "b"), (2, prose(1, 80), "en", "b"), (2, prose(1, 80), "en", "b"), (3, None, "de", None), (4, "", None, "a"),
    (5, "   \n\n\t ", "fr", "a"), (6, "...", None, ""), (7, prose(7, 30) + "\n" + PASSAGE + "\n" + prose(8, 30), "en", "c"),
    (8, prose(9, 20) + "\n" + PASSAGE, None, None), (9, prose(10, 30000), "es", "a"), (None, prose(11, 40), "en", "a"), (None, None, None, None),
    (10, "é", "fr", "c"), (11, "<|endoftext|> x\x1c y　z <|endoftext|>", "en", "b"), (12, prose(1, 79) + " end.", "en", "b"), (13, prose(1, 80), "de", "c"),
    (14, prose(12, 25) + "\n" + prose(13, 25) + "\n" + prose(14, 25), "en", "b"), (15, prose(13, 25) + "\n" + prose(14, 25) + "\n" + prose(15, 25), "en", "b"),
    (16, "a", "en", "b"), (16, "b", "en", "b"),
]

#: Names that the operators use for their own columns.
CLASHING = (
    "n_lines n_removed removed version windows least content size copies copy words position target source_size __none score kept class_id node "
    "component bucket bands block own n codes ids fingerprint k h guest lang_pred held_out"
).split()


def odd_documents(spark):
    rows = [(i, t, lang, source, None if t is None else len(t), *[7] * len(CLASHING)) for i, t, lang, source in ODD_ROWS]
    names = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
