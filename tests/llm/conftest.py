import random

import pytest

WORDS = "the of and river stone light under morning they walked slowly across a wide field while rain fell on old houses near bridge".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, slot int, h1 string, tokens string, lang_pred string, spans int, sequence_id string, bytes string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randint(4, 12)
        out += [w for w in r.choices(WORDS, k=k)]
        out[-1] += ".\n" if r.random() < 0.2 else "."
    return " ".join(out[:n]).replace("\n ", "\n")


def edge_texts() -> list[tuple]:
    """(doc_id, text, lang): nulls, empties, long, repeated and similar texts."""
    long = prose(1, 30_000)
    base = prose(2, 300)
    changed = base.split(" ")
    changed[150] = "comet"
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "one two", "xx"), (6, base, "en"), (7, base, "en"), (8, " ".join(changed), "en"),
        (9, long, "en"), (10, "a" * 50_000, None), (11, "é" * 700 + " ünï", "de"), (None, base, "en"), (None, None, None), (12, prose(3, 120), "en"), (12, prose(3, 120), "en"),
        (13, "aaa " * 400, "en"), (14, "123 !!! ###", None), (15, "x <|endoftext|> y", "en"), (16, "\x0b\x0c one\x00two \U0001f600 words", "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, g, None, None if t is None else len(t), "k", "s", 3, "h", "t", "p", 1, "q", "b") for i, t, g in edge_texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
