import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, uid string, body string, size string, row string"


def make_docs(seed=3, n=120):
    """Small corpus with nulls, empties, repeats, copies, near copies, shared passages, a long text and odd white space."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = say(60)
    rows = []
    for i in range(n):
        kind = i % 12
        text = say(rng.randint(1, 90))
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            text = f"{say(20)}\n{passage}\t{say(15)}"
        elif kind == 3:
            base = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 4:
            text = (rows[rng.randrange(len(rows))][1] or "").upper().replace(" ", "  ")
        rows.append((i * 3 - 20, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "s4"])))
    rows += [(None, None, None, None), (1001, None, "en", "s1"), (1002, "", "en", "s2"), (1003, " \n\t ", "de", "s1"), (1004, "!!! 123", "de", None), (1005, say(9000), "en", "s1"), (1006, passage + passage, "en", "s2"), (1007, "a", "en", "s3")]
    rows += [rows[5], rows[5], (None, rows[7][1], "en", "s1"), (None, "lonely null id text of some words here", "en", "s2")]
    return [(*r, 0, "k", "u", "b", "z", "r") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
