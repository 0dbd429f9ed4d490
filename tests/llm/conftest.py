import pytest

TEXTS = [
    (1, "One two three four five six seven"),
    (2, "one TWO three four five six seven"),
    (3, None),
    (4, ""),
    (5, "Éa x"),
    (6, "éa x"),
    (7, "w " * 40_000),
    (7, "w " * 40_000),
    (None, "no id"),
    (9, " \t\n"),
    (10, "a b"),
    (11, "A\x0bB"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, with extra columns whose names operators use inside."""
    rows = [(i, t, "s1", 5, b"x", 0, 1.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id int, digest binary, row int, key double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
