"""Scalar functions on given values."""

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import telemetry
from weftline.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_prompt(spark):
    tagged = "<USER_REQUEST>\nHello world test\n</USER_REQUEST>\n<META>x</META>"
    assert one(spark, T.user_prompt(F.lit(tagged))) == "Hello world test"
    assert one(spark, T.user_prompt(F.lit("  plain  "))) == "plain"
    assert one(spark, T.user_prompt(F.lit("<USER_REQUEST>\n</USER_REQUEST> rest"))) == ""
    assert one(spark, T.user_prompt(F.lit("x" * 2500))) == "x" * 2000 + "..."
    assert one(spark, T.prompt_preview(F.lit(tagged))) == "Hello world test"


def test_workspace(spark):
    assert one(spark, T.workspace_of(F.lit("Active Workspaces:\n- /a/b\nActive Document: /c/d.txt"))) == "/a/b"
    assert one(spark, T.workspace_of(F.lit("Active Document: /c/d.txt"))) == "/c"
    assert one(spark, T.workspace_of(F.lit("nothing"))) is None
    assert one(spark, T.project_name(F.lit("/x/knowledge/Repo/src/a.go"))) == "Repo"
    assert one(spark, T.project_name(F.lit("/x/Proj/src/main.go"))) == "Proj"
    assert one(spark, T.project_name(F.lit("/Untitled-1"))) == "Default"
    assert [one(spark, T.valid_workspace(F.lit(w))) for w in ("Repo", "src", ".x", "a.txt", "a/b", "x")] == [True, False, False, False, False, False]
    assert one(spark, T.normalize_workspace(F.lit(" /a/b// "))) == "b"


def test_a_project_is_made_once(spark):
    """However often its path is named, and however many parts it has."""
    paths = [None, "", "/", "/Untitled-1/x", "'/a/b.c/'", "/a/src/b.c", "/x/knowledge/src/Repo", "/x/Interviews/R2//", "~/q/.git/config", "//", "a.b/", "/x/knowledge/src/a.b"]
    want = ["Default", "Default", "Default", "Default", "Default", "Default", "Repo", "R2", "Default", "Default", "Default", "Default"]
    assert [one(spark, T.project_name(F.lit(p))) for p in paths] == want
    df = spark.range(1).select(T.project_name(T.workspace_of(F.concat(F.lit("Active Workspaces:\n- /home/P"), F.col("id").cast("string")))).alias("x"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("(?<=.)/+$") == 1 and plan.count("Command Working Directory") <= 2


def test_names(spark):
    assert one(spark, T.clean_record_id(F.lit("node:⟨ws:f:1⟩"))) == "ws:f:1"
    assert one(spark, T.callee_name(F.lit("std::fs::read"))) == "read"
    assert one(spark, T.field_type(F.lit("Vec<Option<Thing>>"))) == "Thing"
    syms = lambda lang, s: one(spark, T.imported_symbols(F.lit(lang), F.lit(s)))
    assert syms("python", "from foo import bar, baz as b") == ["bar", "baz"]
    assert syms("rust", "use crate::db::{Client, Load};") == ["Client", "Load"]
    assert syms("rust", "use std::collections::HashMap;") == ["HashMap"]
    assert syms("go", '"example.org/x/gin"') == ["gin"]
    assert syms("typescript", "import { a, b as c } from './utils'") == ["a", "b", "utils"]


def test_times(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    now = at("2024-01-02 00:00:00")
    want = {"2024-01-01 23:59:30": "just now", "2024-01-01 23:59:00": "1 minute ago", "2024-01-01 22:00:00": "2 hours ago", "2024-01-01 00:00:00": "yesterday", "2023-12-28 00:00:00": "5 days ago"}
    assert {s: one(spark, T.relative_time(at(s), now)) for s in want} == want
    assert str(one(spark, T.parse_date(F.lit("2024-01-05"), True))).startswith("2024-01-05 23:59:59.999999")
    assert one(spark, T.parse_date(F.lit("rubbish"))) is None


def test_previews(spark):
    assert one(spark, T.search_preview(F.lit("a" * 50 + "NEEDLE" + "b" * 50), "needle", 20)) == "..." + "a" * 10 + "NEEDLE" + "b" * 4 + "..."
    assert one(spark, T.highlight(F.lit("A dog. a DOG"), "dog")) == "A <mark>dog</mark>. a <mark>DOG</mark>"
    assert one(spark, T.args_preview(F.lit("x" * 130), 120)) == "x" * 120 + "..."


def test_commands(spark):
    kind = lambda c: one(spark, telemetry.classify(F.lit(c), ("mytool",)))
    assert kind("make graph-symbol NAME=x")["lookup"] is True
    assert kind("mytool watch")["capability"] == "live watch"
    assert kind("ls") is None


def test_admission(spark):
    ok = lambda p, n, c: one(spark, files.admissible(F.lit(p), F.lit(n), F.lit(c)))
    assert ok("a.rs", 5, b"hello") and not ok("a.png", 5, b"hello") and not ok("a.rs", 1 << 20, b"x") and not ok("a.rs", 3, b"a\x00b") and not ok("a.rs", 2, b"\xff\xfe")
    assert one(spark, files.clean_folders(F.lit("src/x/a.rs"))) and not one(spark, files.clean_folders(F.lit("src/node_modules/a.js")))
