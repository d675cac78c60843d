"""The engine from a source tree and from transcripts."""

import json

from weftline.api import CodeGraph, Transcripts


def test_code_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def first():\n    second()\n\ndef third():\n    first()\n")
    (tmp_path / "src" / "b.py").write_text("def second():\n    return 1\n")
    (tmp_path / "README.md").write_text("# Title\nuses `second`\n")
    g = CodeGraph.ingest(spark, f"file://{tmp_path}", "ws", dim=32)
    assert {r["label"] for r in g.symbol("second").collect()} == {"second"}
    callers = {(r["caller"], r["type"]) for r in g.references("second").collect()}
    assert callers == {("first", "CALLS"), ("Title", "REFERENCES")}
    clustered = g.cluster()
    assert clustered.galaxies().count() >= 1 and clustered.boundary("second").count() == 1
    assert "first" in g.condense("second").first()["markdown"]
    assert g.search("first function", k=2).count() == 2
    assert g.query("second")["context"] is not None and g.stats().count() >= 3
    assert g.purge("ws").nodes.count() == 0
    g.save(str(tmp_path / "out"))
    again = CodeGraph.load(spark, str(tmp_path / "out"))
    assert again.nodes.count() == g.nodes.count()
    known = g.nodes.select("workspace", "file_path", "file_hash").distinct()
    (tmp_path / "src" / "b.py").write_text("def second():\n    return 2\n")
    fresh = CodeGraph.ingest(spark, f"file://{tmp_path}/src", "ws", dim=8)
    assert fresh.nodes.count() == 3 and known.count() == 3


def test_transcripts(spark, tmp_path):
    step = {"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "status": "DONE", "created_at": "2026-09-18T10:00:00Z", "content": "fix the parser in Proj"}
    call = {"name": "write_to_file", "args": {"TargetFile": "/x/Proj/a.go"}}
    lines = [step, {**step, "step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "content": "done", "tool_calls": [call]}]
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "transcript.jsonl").write_text("\n".join(map(json.dumps, lines)))
    t = Transcripts.scan(spark, [(f"file://{tmp_path}", "any", "ide")], spark.createDataFrame([("Proj", "/x/Proj")], "name string, path string"))
    row = t.list(workspace="proj").first()
    assert (row["project_name"], row["workspace"], row["step_count"]) == ("Proj", "/x/Proj", 2)
    assert t.search("parser").count() == 1 and t.search("parser", "RESPONSES").count() == 0
    digest = t.wip("proj")
    assert digest["status"].first()["status"] == "resolved" and digest["files"].first()["value"] == "/x/Proj/a.go"
    assert t.stats().first()["sessions"] == 1 and t.projects().first()["session_count"] == 1
    assert "fix the parser" in t.export("s1").first()["markdown"] and t.detail("s1").count() == 2
