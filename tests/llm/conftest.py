import pytest

WORDS = "alpha beta gamma delta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(WORDS[i * i % 17] + str(i % 97) for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a", "Der Größe naïve 漢字 🙂", "same text here\nand there", "same text here\nand there", "don't  'll go\r\n\n  x  ", LONG]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    rows = [(i, t, "x", f"s{i}", None) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x", "s", None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string, score string, n_chars long").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
