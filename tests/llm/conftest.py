"""A hostile corpus: nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""

import random

import pytest

CLASH = ("row", "size", "label", "h", "key", "batch", "_id", "_cell", "start", "place", "bucket", "n")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def corpus() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    texts: list[str | None] = [None, "", " \t\n ", "a", "two words", "Two  WORDS", "x" * 700]
    for i in range(40):
        body = [word() for _ in range(rng.randint(60, 160))]
        if i % 4 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passage.split()
        if i % 3 == 0:
            body[10] += "\n"
            body[30] += "\nA shared line that many of these documents carry in full.\n"
        texts.append(" ".join(body))
    base = [word() for _ in range(120)]
    for i in range(30):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(120)] = word()
        texts.append(" ".join(near))
    texts += [texts[10]] * 5 + [" ".join(word() for _ in range(20_000))]
    texts += ["The quick line of some length number one here.\nzz", "The quick line of some length number two here.\nzz", "The quick line of some lengths number one here.\nyy"]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), *["z"] * len(CLASH)) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, "text of a row without a number, " * 12, None, None, None, *[None] * len(CLASH)), (None, None, None, None, None, *[None] * len(CLASH))]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "n_chars").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
