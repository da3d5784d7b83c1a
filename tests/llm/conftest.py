import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=0, n=80):
    """Documents with copies, near copies, shared passages and lines, junk, nulls and very long ones; unique ids."""
    r = random.Random(seed)
    passage = [prose(r, 30) for _ in range(4)]
    licence = prose(r, 12)
    docs = []
    for i in range(n):
        k = r.random()
        if docs and k < 0.15:
            text = r.choice(docs)[1]
        elif docs and k < 0.35 and (old := r.choice(docs)[1]):
            w = old.split(" ")
            w[r.randrange(len(w))] = "edited"
            text = " ".join(w)
        else:
            lines = [prose(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 8))]
            if r.random() < 0.5:
                lines.insert(r.randrange(len(lines) + 1), licence)
            if r.random() < 0.4:
                at = r.randrange(len(lines) + 1)
                lines[at:at] = passage[r.randrange(3) :]
            text = "\n".join(lines)
        docs.append((i * 3 - 20, text))
    docs += [(1000, None), (1001, ""), (1002, ""), (1003, "é"), (1004, "one two"), (1005, "ONE, two"), (1006, "\n\n"), (1007, prose(r, 20_000)), (1008, "a \U0001f600 ß İ <|endoftext|>" * 3)]
    return docs


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """With columns whose names clash with those of results."""
    rows = [(d, t, "x", d) for d, t in docs_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words long").repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
