import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Rows with nulls in any column, empty and long texts, ties and repeated rows.
EDGE = [
    (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, "one", None, None, 3), (3, "one", None, None, 3), (None, "one two three four", "de", "b", 18), (5, "  \n\t ", "fr", "b", 5),
    (6, "x" * 200_000, "en", "c", 200_000), (7, "word " * 40_000, "en", "c", 200_000), (8, "🙂 é　ß ﬁ\x00 İ", "de", None, 9), (9, "plain text ends here.", "en", "a", 21), (10, "plain text ends here.", "en", "a", 21),
]
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus: edge rows, prose, exact and near copies, shared passages, secrets, notices, junk."""
    rows = list(EDGE)
    base = [prose(n, 80 + 7 * n) for n in range(12)]
    for n, t in enumerate(base):
        rows += [(100 + 10 * n, t, "en", f"s{n % 3}", len(t)), (101 + 10 * n, t.replace(t.split()[5], "changed"), "en", f"s{n % 4}", len(t)), (102 + 10 * n, t, "en", "big", len(t))]
    passage = prose(99, 90)
    rows += [(400 + n, prose(200 + n, 60) + " " + passage + " " + prose(300 + n, 40), "en", "big", None) for n in range(6)]
    rows += [
        (500, 'key: password = "abc/DEF123" and token: short AKIA' + "Z9" * 10 + " " + "0123456789abcdef" * 3, "en", "s1", None),
        (501, "api_key=a1b2c3d4 é passwd:'xx' ghp_" + "a" * 40 + "\nsecret := longenough", "en", "s1", None),
        (502, "# header\nReleased under the MIT License.\n" + base[0], "en", "s2", None),
        (503, "Licensed under the Apache License, Version 2.0.", "en", "s2", None),
        (504, " | ".join(base[1].split()), "en", "s2", None),
        (505, " ".join(w + "###" for w in base[2].split()), "en", "s2", None),
        (506, "\n".join([base[3]] * 4), "en", "s2", None),
    ]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["id", "key", "fp", "mark", "word", "words", "lines", "spans", "row", "bucket", "kind", "block", "epoch", "tokens", "low", "path", "dir", "i", "m"]
    return docs.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="session")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from factloom.llm.queries import tokenizer_path

    return tokenizer_path()
