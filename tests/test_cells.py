"""Vector cells: the exact search against the scan, and the recall of the nearest cells on all ids that 20 divides."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scans import scanned

from weftline.indexes.cells import CellIndex
from weftline.operators import vectors


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


def test_recall_on_the_query_set(spark, tmp_path, table):
    index = CellIndex(spark, str(tmp_path / "v"), "vec_id").build(table)
    asked = table.where("vec_id % 20 = 0")
    found = index.fit(asked, 10, 0.9)
    assert found >= 0.9 and index.recall(asked, 10, index.probe) == found
    whole = index.vectors().select("cell").distinct().count()
    assert index.recall(asked, 10, whole) == 1.0


def test_exact_search_equals_the_scan(spark, tmp_path):
    """Clustered vectors, ties, and rows without a direction; of far cells none is read."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 5
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.1).tolist()) for i in range(600)]
    rows += [(1000, rows[0][1]), (1001, [0.0] * 16), (1002, None), (1003, [1.0] * 3), (1004, [None, *[1.0] * 15]), (1005, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    good = df.where("id < 1001")
    index = CellIndex(spark, str(tmp_path / "v")).build(df)
    assert index.vectors().count() == 601
    plain = lambda out: [(r["id"], round(r["similarity"], 12)) for r in out.collect()]
    for i in (0, 7, 599):
        q = rows[i][1]
        assert plain(index.exact(q, 12)) == plain(vectors.top_k(good, q, 12))
    assert plain(index.exact((-np.array(rows[3][1])).tolist(), 5)) == plain(vectors.top_k(good, (-np.array(rows[3][1])).tolist(), 5))
    assert plain(index.exact(rows[5][1], 700)) == plain(vectors.top_k(good, rows[5][1], 700))
    _, read, _ = scanned(index.exact(rows[0][1], 10))
    assert read < 600 / 3
    assert index.nearest(rows[2][1], 3).first()["id"] == 2
    assert index.exact([0.0] * 16, 3).count() == 0


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    index = CellIndex(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="no vector"):
        index.build(none)
    assert none.select(F.count("*")).first()[0] == 1
