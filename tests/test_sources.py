"""Trees, transcripts, parsers and sessions from temporary files."""

import json

from pyspark.sql import functions as F

from weftline.operators import parsing, sessions
from weftline.sources import files, transcripts


def test_tree(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}", "src/target/b.rs": b"x", ".hid/c.rs": b"x", "d.png": b"x", "e.txt": b"a\x00b", "README.md": b"# Hi\ntext"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.read_tree(spark, f"file://{tmp_path}", "ws")
    assert {r["file_path"] for r in got.collect()} == {"src/a.rs", "README.md"}
    assert files.stale(got, got).count() == 0
    assert files.stale(got, got.withColumn("file_hash", F.lit("old"))).count() == 2


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_transcripts(spark, tmp_path):
    step = {"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "status": "DONE", "created_at": "2026-09-18T10:00:00Z", "content": "<USER_REQUEST>\nHello\n</USER_REQUEST>"}
    call = {"name": "view_file", "args": {"AbsolutePath": "/x/Proj/a.go"}}
    write(tmp_path / "a" / "s1" / "transcript.jsonl", [step, "not-a-valid-json-line", {**step, "step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "content": "ok", "tool_calls": [call]}, {"step_index": 2, "source": "SYSTEM", "type": "ERROR_MESSAGE", "status": "ERROR", "content": "bad"}, ""])
    write(tmp_path / "a" / "s1" / "transcript_full.jsonl", [step])
    write(tmp_path / "b" / "s1" / "transcript.jsonl", [step])
    steps = transcripts.read_all(spark, [(f"file://{tmp_path}/a", "p", "ide"), (f"file://{tmp_path}/b", "p", "cli")])
    assert steps.where("malformed").count() == 1
    row = sessions.rollup(steps.where("not malformed")).first()
    assert (row["step_count"], row["user_message_count"], row["agent_response_count"], row["error_count"], row["tool_call_count"]) == (3, 1, 1, 1, 1)
    assert row["first_user_prompt_preview"] == "Hello" and row["tool_calls_map"] == {"view_file": 1}
    scores = sessions.project_scores(steps.where("not malformed"), spark.createDataFrame([("Other", "/o")], "name string, path string"))
    assert {(r["project"], r["score"]) for r in scores.collect()} == {("Proj", 15)}
    assert transcripts.read_location(spark, f"file://{tmp_path}/a", "p", "ide", prefer_full=True).count() == 1


def parsed(spark, path, content):
    df = spark.createDataFrame([("ws", path, content)], "workspace string, file_path string, content string")
    nodes, edges = parsing.parse(df)
    return nodes.collect(), edges.collect()


def test_rust(spark):
    nodes, edges = parsed(spark, "a.rs", "use std::fs::read;\n\npub struct Pool {\n    size: usize,\n    owner: Arc<Owner>,\n}\n\nimpl Drop for Pool {\n    fn drop(&mut self) {\n        self.close();\n    }\n}\n\nmacro_rules! my { () => {} }\n\nfn main() {\n    let p = Pool::new();\n}\n")
    kinds = {(n["label"], n["kind"]) for n in nodes}
    assert {("Pool", "struct"), ("drop", "method"), ("main", "function"), ("my", "macro"), ("import", "import"), ("size", "field")} <= kinds
    links = {(e["edge_type"], e["target_label"]) for e in edges}
    assert {("IMPORTS", "read"), ("IMPLEMENTS", "Drop"), ("CALLS", "close"), ("CALLS", "new"), ("REFERENCES", "Owner")} <= links
    assert next(n for n in nodes if n["label"] == "main")["id"].startswith("ws:a.rs:main:")


def test_python(spark):
    nodes, edges = parsed(spark, "a.py", "import os\nLIMIT = 3\nclass A(Base):\n    def run(self):\n        helper(1)\n\ndef helper(x):\n    return x\n")
    assert {(n["label"], n["kind"]) for n in nodes} == {("import", "import"), ("LIMIT", "constant"), ("A", "class"), ("run", "method"), ("helper", "function")}
    assert {("EXTENDS", "Base"), ("CALLS", "helper"), ("IMPORTS", "os"), ("DECLARES", "run")} <= {(e["edge_type"], e["target_label"]) for e in edges}


def test_go_and_typescript(spark):
    nodes, edges = parsed(spark, "a.go", 'package main\n\nimport "example.org/x/gin"\n\ntype Server struct {\n\tPort int\n}\n\nfunc (s *Server) Start() {\n\tlisten()\n}\n')
    assert {("Server", "struct"), ("Start", "method"), ("import", "import")} <= {(n["label"], n["kind"]) for n in nodes}
    assert {("IMPORTS", "gin"), ("CALLS", "listen")} <= {(e["edge_type"], e["target_label"]) for e in edges}
    nodes, edges = parsed(spark, "a.ts", "import { a } from './utils'\nexport class B extends C implements D {\n  run() { a(); }\n}\nexport const f = async (x) => {\n  a();\n}\ninterface E { x: string }\n")
    assert {("B", "class"), ("f", "function"), ("E", "interface")} <= {(n["label"], n["kind"]) for n in nodes}
    assert {("EXTENDS", "C"), ("IMPLEMENTS", "D"), ("IMPORTS", "a"), ("IMPORTS", "utils"), ("CALLS", "a")} <= {(e["edge_type"], e["target_label"]) for e in edges}


def test_markdown(spark):
    nodes, edges = parsed(spark, "d.md", "# Title\nsee [x](./other.md#part) and `some_name` or `true`\n## Sub\n```python\ndef inner():\n    pass\n```\n# Next\n")
    assert {("Title", "document"), ("Sub", "section"), ("inner", "function"), ("Next", "document")} == {(n["label"], n["kind"]) for n in nodes}
    assert {("LINKS_TO", "other.md"), ("REFERENCES", "some_name"), ("CONTAINS", "Sub"), ("CONTAINS", "inner")} == {(e["edge_type"], e["target_label"]) for e in edges}


def test_config_kinds(spark):
    labels = lambda path, text: {(n["label"], n["kind"]) for n in parsed(spark, path, text)[0]}
    assert {("web", "Deployment"), ("x.yaml", "manifest")} <= labels("x.yaml", "kind: Deployment\nmetadata:\n  name: web\n---\nkind: Service\nmetadata:\n  name: svc\n")
    assert {("a", "property"), ("x.json", "config")} == labels("x.json", '{"a": {"b": 1}}')
    assert {("go", "function"), ("stop", "function"), ("x.sh", "script")} == labels("x.sh", "go() {\n}\nfunction stop {\n}\n")
    assert {("t", "table"), ("x.sql", "sql")} == labels("x.sql", "CREATE TABLE IF NOT EXISTS t (a int);\n")
    assert {("pkg", "section"), ("x.toml", "config")} == labels("x.toml", '[pkg]\na = 1\n')
    assert len(labels("x.txt", "\n".join(map(str, range(100))))) == 4


def test_wip(spark):
    rows = [("s1", "P", "2026-09-01"), ("s2", "P", "2026-09-02"), ("s3", "Q", "2026-09-03")]
    s = spark.createDataFrame(rows, "session_id string, project_name string, at string").select("session_id", "project_name", F.lit("/w").alias("workspace"), F.array("project_name").alias("projects_touched"), F.col("at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_message_at"))
    status = lambda **k: tuple(sessions.wip_status(s, **k).first())
    assert status(workspace="p") == ("ambiguous_multi_session", None, 2)
    assert status(workspace="p", force_latest=True) == ("resolved", "s2", 2)
    assert status(workspace="q") == ("resolved", "s3", 1)
    assert status(session_id="none")[0] == "not_found"
    hit = sessions.lifetime_overlaps(F.col("created_at"), F.col("last_message_at"), F.lit("2026-09-02").cast("timestamp"), F.lit("2026-09-02").cast("timestamp"))
    assert [r["session_id"] for r in s.where(hit).collect()] == ["s2"]
