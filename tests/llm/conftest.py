import random

import pytest

WORDS = "the of and river stone Light über café niño garçon tree cloud 42 x-ray don't".split()


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", str(draw.randrange(900)), ".", ",\n"]) for _ in range(n))


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def build(rows, lang="en", source="s"):
        full = [
            (i, t, lang, source, None if t is None else len(t), 7, "own", [1], True) for i, t in rows
        ]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, "
            "n int, doc string, ids array<int>, kept boolean",
        )

    return build


@pytest.fixture
def awkward():
    """Null, empty and blank texts, null and repeated ids, repeated rows, long texts, odd characters."""
    draw = random.Random(8)
    long = prose(draw, 6000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (4, "other text"), (None, "no id"), (None, None),
        (5, long), (6, long.upper()), (7, "a" * 60_000), (8, "é▁x 日本語 😀 \x00\x0b"), (9, "x\ny\n\nx\n"),
        (10, "<|endoftext|> <0x41> <s>"), (11, "  two  spaces  "), (12, "ONE"), (13, "one"), (14, "\r\n\r\n"),
    ]
