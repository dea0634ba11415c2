import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int = 60) -> str:
    """Words that look random and repeat exactly for one seed."""
    out, x = [], seed * 2654435761 + 12345
    for k in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(f"{WORDS[(x >> 33) % len(WORDS)]}{(x >> 40) % 97}" + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and long texts, equal rows, equal doc_ids; extra columns with clashing names."""
    return [
        (1, sentence(1), "en", "b", 5, 1, "k", "x"),
        (2, sentence(1), "en", None, None, None, None, None),
        (2, sentence(2), None, "a", 5, 1, "k", "x"),
        (3, None, "en", "a", 0, 1, "k", "x"),
        (4, "", "en", "a", 0, 1, "k", "x"),
        (5, " \t\n ", "en", "é", 0, 1, "k", "x"),
        (6, "one", "en", "b", 0, 1, "k", "x"),
        (7, sentence(3, 30_000), "en", "b", 0, 1, "k", "x"),
        (8, "é à 漢字 😀 mail me: a.b@c.example.org or +1 (743) 555-3824.", "en", "b", 0, 1, "k", "x"),
        (8, "é à 漢字 😀 mail me: a.b@c.example.org or +1 (743) 555-3824.", "en", "b", 0, 1, "k", "x"),
        (None, sentence(5), "en", "b", 0, 1, "k", "x"),
        (None, sentence(5), "en", "b", 0, 1, "k", "x"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def make_documents(spark):
    def make(*texts, source="s"):
        rows = [(i, t, "en", source, len(t), 0, "k", "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS).repartition(2)

    return make


@pytest.fixture(scope="session")
def prose():
    return sentence
