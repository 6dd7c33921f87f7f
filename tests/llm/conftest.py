import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, long and odd texts."""
    rng = random.Random(1)
    passage = prose(rng, 90)
    out = [(i, prose(rng, rng.randrange(1, 120))) for i in range(40)]
    out += [(100 + i, out[i][1]) for i in range(6)] + [(200 + i, out[0][1]) for i in range(5)]
    out += [(300 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 20)) for i in range(6)]
    long = prose(rng, 900)
    out += [(400, long), (401, long.replace("alpha1 ", "omega ", 1) + " end"), (402, "x" * 1500), (403, "ab " * 700)]
    out += [(500, None), (501, ""), (502, "  \n\t "), (503, "É ß 中文 😀 <|endoftext|>"), (504, None), (505, "one"), (506, "A b c.\n\n  D\r\nE, f")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with the other columns of documents, and columns whose names clash with those the operators add."""
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "x", i) for i, t in texts]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept bigint"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
