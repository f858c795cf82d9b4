import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double"
WORDS = "and the of to in erent thing ation ouse ble ning stand for with that this from have are was".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, blanks, copies, near copies, ties, a hot source, a long text; extra columns clash with results."""
    out = [(k, prose(k, 20 + 7 * k), "en" if k % 2 else "de", "hot" if k % 3 else f"s{k % 5}", 1, 9, 9, 0.5) for k in range(60)]
    text = prose(900, 150)
    out += [(100 + k, text, "en", "hot", 1, 9, 9, 0.5) for k in range(6)]
    out += [(110, text.replace("and", "AND", 1), "en", "s1", 1, 9, 9, 0.5), (111, prose(901, 90) + " " + text[:600], "en", None, 1, 9, 9, 0.5)]
    out += [(120, None, None, None, None, None, None, None), (121, "", "en", "s1", 0, 9, 9, 0.5), (122, " \n\t ", None, "s1", 3, 9, 9, 0.5)]
    out += [(None, "no id here", "en", "s2", 1, 9, 9, 0.5), (130, "Éa Straße, über!! <|endoftext|> x", "de", "s2", 1, 9, 9, 0.5)]
    out += [(130, "Éa Straße, über!! <|endoftext|> x", "de", "s2", 1, 9, 9, 0.5), (131, "ab " * 4000, "en", "s3", 1, 9, 9, 0.5)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
