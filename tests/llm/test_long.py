"""One text with very many hits: the time follows its length."""

import time

from weftline.llm import op5_licenses, op8_lines

SCHEMA = "doc_id long, text string"


def test_fifty_thousand_notices(spark):
    n = 50_000
    df = spark.createDataFrame([(1, "mit license " * n), (2, "Released under the MIT License. " * n)], SCHEMA)
    began = time.time()
    got = {r["doc_id"]: r for r in op5_licenses.license_documents(df).collect()}
    assert time.time() - began < 60
    assert got[1]["n_base"] == got[2]["n_base"] == n and got[2]["last_word"] == 5 * n - 2
    assert got[1]["labels"] == got[2]["labels"] == "mit"
    found = {r["doc_id"]: len(r["found"]) for r in op5_licenses.scan(df, ["doc_id"]).select("doc_id", "found").collect()}
    assert found == {1: n, 2: n}


def test_two_hundred_thousand_removed_lines(spark):
    n = 200_000
    lines = "\n".join(f"line {i} of it" for i in range(n))
    df = spark.createDataFrame([(1, lines), (2, f"top\n{lines}\n\nend")], SCHEMA)
    began = time.time()
    got = {r["doc_id"]: r for r in op8_lines.dedup_lines(df).collect()}
    assert time.time() - began < 60
    assert got[2]["n_removed"] == n and got[2]["text"] == "top\n\nend" and got[1]["text"] == lines and got[1]["n_removed"] == 0
