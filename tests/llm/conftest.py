import random

import pytest

WORDS = "the of and to in that was on with this from house river stone light paper music cold green idea open walk tree".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rep long, `key` string, part string, block int, kept boolean, spans string, page_id long"


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies and odd white space."""
    base = text(1, 120)
    texts = [None, "", " \n\t ", "one", "one two three four", base, base, base.upper(), base + " extra words here", text(2, 300), text(3, 60), "x" * 5000, "a b " * 400, text(4, 9000)]
    texts += ["tab\tand\x0bvertical\x0cfeed\rreturn line\n\nline\nline", "mail me at ann.lee@mail.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111 ip 10.0.0.255", "é ñ ü 語 " * 20, "AAA!! BBB!! " * 60]
    texts += [text(5 + k, 80 + 5 * k) for k in range(20)]
    out = [(k, t, "en" if k % 3 else None, ["a", "b", None][k % 3], len(t) if t and k % 4 else None, k % 2, 0.5, k, "k", "p", 1, True, "s", 7) for k, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base, None, "a", None, 0, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
