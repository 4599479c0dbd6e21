"""Results that SQL can express against DuckDB on the driver's tables and on rows with nulls, odd values and control strings."""

import glob
import os

import duckdb
import pytest

from quantloom.llm import queries

SF = "/root/testdata/sf0.01"


def compare(spark, name, folder):
    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{files}'")
    cur = db.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(cols)
    want, got = cur.fetchall(), [tuple(r) for r in df.select(*cols).collect()]
    assert len(want) > 0
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_tables(spark, name):
    compare(spark, name, SF)


def test_odd_turns(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "\\ <s> [/INST\\] [ROLE] é😀"), (1, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "tool<s>", "</s>"), (2, None, "assistant", ""), (3, 5, "system", "<<SYS>>"), (None, 0, "user", "a"), (4, 0, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, "op9_chat", str(tmp_path))


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (7, [1.0, 0.2]), (9, [1.0, 0.5]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (8, [inf, 1.0]), (10, [None, 1.0]), (11, []), (12, [1.0, 0.0, 0.0]), (13, [-1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(spark, "op6_embedding_duplicates", str(tmp_path))


def test_odd_texts(spark, tmp_path):
    piece = "".join(f"é{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, "ab" * 300), (4, piece), (4, piece), (None, "x" + piece[:200] + "y"), (5, "😀" * 3000), (6, piece[3:] + "." + piece), (7, "k" * 399), (8, "k" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, "op3_repeated_substrings", str(tmp_path))


def test_odd_searches(spark, tmp_path):
    nan = float("nan")
    rows = [(20, [1.0, 0.5]), (1, [2.0, 0.1]), (2, [2.0, 0.1]), (1, [2.0, 0.1]), (40, [0.0, 0.0]), (60, None), (3, [nan, 1.0]), (80, [1.0, 0.0, 0.0]), (4, [0.3, 0.3, 0.3]), (100, [-1.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(spark, "op8_nearest", str(tmp_path))
