from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row string"


def prose(seed: int, n: int, language: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "tion", "er", "ing", "ha", "wh", "st"], "de": ["der", "und", "sch", "ung", "keit", "ö", "ä", "ei"]}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies and clashing columns."""
    base = prose(1, 60)
    long = prose(2, 30_000)
    near = base.split(" ")
    near[30] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t ", "one", "four words are here", "four  WORDS are\nhere", long, "12345 !!! ???", "日本語 テスト", prose(3, 80, "de"), prose(4, 50), "The " * 500, "x" * 5000, "naïve café ﬁ <|endoftext|> ▁ \x85"]
    out = [(i * 3, t, "de" if i == 12 else "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, "no id here at all", None, None, 0, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
