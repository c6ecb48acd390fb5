import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


@pytest.fixture(scope="session")
def rows(sf):
    """(doc_id, text, source) of the smallest table."""
    import pyarrow.parquet as pq
    t = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["source"].to_pylist()))


#: Nulls in every column, empty and long texts, ties, repeated rows, an id
#: with two texts, and columns that clash with names the operators use.
ODD = [
    (1, "Alpha beta gamma delta. " * 30 + "\nLicensed under the Apache License, Version 2.0.", "en", "a", 10, "x", 1.0),
    (1, "Alpha beta gamma delta. " * 30 + "\nLicensed under the Apache License, Version 2.0.", "en", "a", 10, "x", 1.0),
    (2, None, None, None, None, None, None), (3, "", "", "", 0, "", 0.0), (4, " \t\n\x0b ", "en", "b", 5, None, None),
    (None, "one two three four five six seven eight nine ten", "en", "a", 1, "y", 2.0),
    (None, None, None, "b", None, None, None),
    (5, "The quick brown fox jumps over the lazy dog again and again until the night falls on the hill, it seems.\n"
        "The quick brown fox jumps over the lazy dog again and again until the night falls on the hill, it seemed.",
     "en", "b", 1, "z", None),
    (5, "another text under the same number", "en", None, 1, "z", None),
    (6, "word " * 30000, "en", "c", 1, "w", 3.0), (7, "x" * 100000, None, "c", 1, "w", 3.0),
    (8, "日本語 テスト　é́ \U0001F600 <|endoftext|> \x1c\x85 end", "ja", "c", 1, "w", 3.0),
    (9, "Alpha beta gamma delta. " * 30 + "\nLicensed under the Apache License, Version 2.0.", "en", "b", 10, "x", 1.0),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, __mark string, `features` double")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
