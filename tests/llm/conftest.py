import random

import pytest
from pyspark.sql import types as T

PARTS = ("an", "er", "in", "th", "on", "re", "st", "la", "que", "der", "tion", "é", "ción")


def prose(r, n):
    return " ".join("".join(r.choice(PARTS) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, odd texts, and a very long one."""
    r = random.Random(5)
    rows, i = [], 0

    def add(text):
        nonlocal i
        rows.append((i * 3 + 1, text))
        i += 1

    hot, line = prose(r, 60), prose(r, 9)
    for _ in range(60):
        add(prose(r, r.randrange(1, 200)))
    for _ in range(12):
        add(f"{prose(r, 30)} {hot} {prose(r, 40)}")
    for _ in range(12):
        add(line + "\n" + prose(r, 50))
    base = prose(r, 120).split()
    for _ in range(25):  # near copies, some beside the threshold
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = prose(r, 1)
        add(" ".join(words))
    for _ in range(6):
        add("Exact  copy\tof A text " + line)
    add("exact copy of a text " + line.upper())
    for odd in (None, "", " \n\t ", "one", "one two three four", "ONE two THREE four", "a b c d e", "\x00 nul", "of " * 400, "é" * 300, "x" * 5000):
        add(odd)
    add(prose(r, 20_000))
    add(rows[-1][1][:60_000])
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with other columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, root long, kept string, vec_id int"
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", None if t is None else len(t), "k", 1, "no", 2) for i, t in corpus]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, i % 2, int(i % 5 == 0)) for i, _ in corpus] + [(None, 1, 1), (1, None, None), (10**9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def vectors_schema():
    return T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("leaf", T.StringType())])
