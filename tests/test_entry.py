import ast
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert sorted(df.columns) == ["distance", "p", "q"]
    assert df.count() == 1809


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, res.fetchall())
    assert got


def test_library_does_not_import_the_training_data_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "relata")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, n)).read())
                found = [m for x in ast.walk(tree) for m in ([x.module or ""] if isinstance(x, ast.ImportFrom) else [a.name for a in x.names] if isinstance(x, ast.Import) else [])]
                assert not [m for m in found if "llm" in m or m == "corpus_pipeline"], n
