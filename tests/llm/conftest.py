"""Documents with everything that may be wrong with them."""

import pytest

SCHEMA = "doc_id long, text string, lang string, row string, batch string, shard string, node string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at noon"


def texts():
    words = PROSE.split()
    near = [" ".join([*words[:k], *words[k + 1 :]] * 3) for k in (0, 1)]
    return [
        (1, PROSE),
        (2, PROSE),
        (2, PROSE),
        (3, PROSE.upper()),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "three short words"),
        (8, "Three  short\nwords"),
        (None, PROSE),
        (None, "only here"),
        (9, " ".join(words * 3)),
        (10, " ".join(words * 3 + ["end"])),
        (11, near[0]),
        (12, near[1]),
        (13, "x" * 5000 + " " + "word " * 9000),
        (14, "é漢 ΑΣ <|endoftext|> it's　x\x1cy 🤷"),
        (15, "x" * 5000 + " " + "word " * 9000),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, ties, repeats, long texts and columns named like internal ones."""
    rows = [(i, t, None, "r", "b", "s", "n") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
