import random

import pytest

#: Names that working columns could have had.
CLASHES = ["row", "_row", "_key", "_p", "_salt", "_hash", "_doc", "place", "line", "w", "items", "_text_key", "_kept", "fp", "n_lines", "_score", "lang_pred", "score", "quality", "start", "bin"]

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(i % 977) for i in range(40_000))


def edge_rows():
    base = "the quick brown fox jumps over the lazy dog and runs away from the old red barn"
    return [
        (1, base + "\nshared line of text number one here", "en", "s"),
        (2, base + "\nshared line of text number one here", "en", "s"),
        (2, base + "\nshared line of text number one here", "en", "s"),
        (3, None, "en", None), (4, "", None, "s"), (5, LONG, "en", "s"), (None, "a row without an id but with words in it", "en", "s"), (None, None, None, None),
        (6, "   \n \t ", "en", "s"), (7, "1234 5678 !!!", "de", "s"), (8, base.replace("lazy", "lasy"), "en", "s"), (9, "ŝaĝa ĉu ñandú çeşme ﬁn 中文 🙂", "xx", "s"), (10, "x", "en", "s"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    rows = [(*r, *(f"{c}-{i}" for c in CLASHES)) for i, r in enumerate(edge_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
