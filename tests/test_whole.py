"""Registered queries over whole tables and whole texts."""

import os

import pytest

from pyspark.sql import functions as F
from weftline.operators import listings, vectors
from weftline.plans import catalog, graph_queries

SF = "/root/testdata/sf0.1"


def run(spark, name, sf=SF):
    return catalog.queries()[name](spark, sf)


def test_json_of_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").where(F.get_json_object("props", "$.k").isNotNull())
    assert run(spark, "json_properties").count() == events.count() > 2000


def test_headings_of_every_line(spark):
    lines = run(spark, "heading_sections").agg(F.max("line"), F.count_if(F.col("line") > 20)).first()
    assert lines[0] > 20 and lines[1] > 900


def test_prompts_of_whole_texts(spark):
    rows = run(spark, "user_prompts").join(spark.read.parquet(f"{SF}/conversations.parquet"), ["conv_id", "turn"])
    assert rows.where(F.length("text") > 50).count() == rows.where(F.length("prompt") > 50).count() > 4000


def test_neighbours_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, run(spark, "vector_batch_knn").collect()))
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert len({r[0] for r in whole}) == asked == len(whole) // 5
    monkeypatch.setattr(vectors, "MAX_QUERIES", 60)
    assert sorted(map(tuple, run(spark, "vector_batch_knn").collect())) == whole


@pytest.mark.parametrize("module, name, args", [("graph", "label_propagation", "communities_lpa"), ("coloured_lpa", "communities", "communities_sequential")])
def test_communities_see_every_edge(spark, monkeypatch, module, name, args):
    seen = []
    monkeypatch.setattr(getattr(graph_queries, module), name, lambda nodes, edges, **_: seen.append(edges) or nodes)
    run(spark, args, "/root/testdata/sf0.001")
    rows = {r["type"]: r["count"] for r in seen[0].groupBy("type").count().collect()}
    assert set(rows) == {"CALLS", "IMPLEMENTS", "IMPORTS"} and sum(rows.values()) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_scratch_tables_go_with_their_scope(spark):
    from weftline.session import materialize, scratch_scope

    with scratch_scope(spark) as made:
        kept = materialize(materialize(spark.range(5), "gone").select("id"), "kept")
        gone = made[0]
        assert len(made) == 2
        made.pop()
    assert kept.count() == 5 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert not os.path.exists(gone.removeprefix("file:"))


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace as N

    from weftline import session

    none = N(isDefined=lambda: False)
    jsc = N(sc=lambda: N(getCheckpointDir=lambda: none))
    cluster = N(conf=N(get=lambda *a: None), sparkContext=N(_jsc=jsc, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_root(cluster)


def test_small_inputs_are_dealt_over_all_cores(spark, monkeypatch):
    from weftline import session

    df = spark.read.parquet(f"{SF}/nation.parquet")
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SMALL", 1)
    assert session.spread(df) is df


def test_markdown_of_a_large_community_is_one_row(spark):
    """Whatever its length: the query's SQL has one row a community."""
    n = F.col("id").cast("string")
    nodes = spark.range(2500).select(n.alias("id"), F.lit(7).alias("community"), F.concat(F.lit("l"), F.lpad(n, 5, "0")).alias("label"), F.lit("k").alias("kind"), F.lit("f").alias("file_path"))
    (row,) = listings.community_markdown(nodes, part=None).collect()
    assert row["part"] == 0 and row["markdown"] == "# Galaxy 7\n\n2500 symbols\n\n" + "\n".join(f"- l{i:05} (k) f" for i in range(2500))
    assert [r["part"] for r in listings.community_markdown(nodes).orderBy("part").collect()] == [0, 1, 2]


def test_pushed_rows_stay_in_their_tasks(spark, monkeypatch):
    """No row of the stream comes to the driver; the counts are those of the table."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = sorted(map(tuple, events.groupBy(F.col("user_id").cast("string")).count().collect()))

    def refused(*_, **__):
        raise AssertionError("rows came to the driver")

    with monkeypatch.context() as m:
        m.setattr(type(events), "toLocalIterator", refused)
        m.setattr(type(events), "collect", refused)
        got = run(spark, "pushed_events")
    assert sorted(map(tuple, got.collect())) == want
