"""Parsers of code and configuration on texts made from the driver's tables, a file for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph, indexing, parsing, vectors
from weftline.plans.registry import query
from weftline.plans.views import files, table
from weftline.streaming import sync


def _written(spark, d, end: str, text: str):
    """A file a part, with the part's key for each ``{k}``."""
    key = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(F.lit("ws").alias("workspace"), F.concat(key, F.lit("." + end)).alias("file_path"), F.replace(F.lit(text), F.lit("{k}"), key).alias("content"))


def _values(rows: list[tuple], names: str) -> str:
    """SQL of rows for each part; strings hold ``{k}`` for its key."""
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "replace('" + v.replace("'", "''") + "', '{k}', p_partkey::varchar)"
    return " union all ".join("select " + ", ".join(f"{cell(v)} as {n}" for v, n in zip(row, names.split(), strict=True)) + " from part" for row in rows)


_NODE, _EDGE = "id label kind line_start line_end", "source_id target_label edge_type"


def _nodes(frames):
    return frames[0].select(*_NODE.split())


def _edges(frames):
    return frames[1].select(*_EDGE.split())


_PYTHON = "import os\nfrom x.y import a{k}, b as c\n\nLIMIT_{k} = 1\n\nclass C{k}(Base):\n    def run(self):\n        text = 'no_call()'\n        self.inner.helper{k}(1)\n\ndef helper{k}(\n    x,\n):\n    return x\n"


@query(_values([("ws:{k}.py:import:1", "import", "import", 1, 1), ("ws:{k}.py:import:2", "import", "import", 2, 2), ("ws:{k}.py:LIMIT_{k}:4", "LIMIT_{k}", "constant", 4, 4), ("ws:{k}.py:C{k}:6", "C{k}", "class", 6, 9), ("ws:{k}.py:run:7", "run", "method", 7, 9), ("ws:{k}.py:helper{k}:11", "helper{k}", "function", 11, 14)], _NODE))
def python_nodes(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "py", _PYTHON)))


@query(_values([("ws:{k}.py:import:1", "os", "IMPORTS"), ("ws:{k}.py:import:2", "a{k}", "IMPORTS"), ("ws:{k}.py:import:2", "b", "IMPORTS"), ("ws:{k}.py:C{k}:6", "Base", "EXTENDS"), ("ws:{k}.py:C{k}:6", "run", "DECLARES"), ("ws:{k}.py:run:7", "helper{k}", "CALLS")], _EDGE))
def python_edges(spark, d):
    return _edges(parsing.parse(_written(spark, d, "py", _PYTHON)))


_RUST = 'use std::{fs, io::Read};\n/* fn no() {\n*/\npub struct S{k}<T: Into<Vec<u8>>> {\n    pub size: Vec<u32>,\n}\n\nimpl<T: Into<Vec<u8>>> Shape<T> for S{k}<T> {\n    fn area(\n        &self,\n        x: u32,\n    ) -> u32 {\n        let s = "}} { nope(1)"; // also_not(2) {\n        grow{k}(2)\n    }\n}\n\nconst MAX: usize = 3;\nfn grow{k}(n: u32) -> u32 { n }\nmacro_rules! m{k} { () => {} }\n'


@query(_values([("ws:{k}.rs:import:1", "import", "import", 1, 1), ("ws:{k}.rs:S{k}:4", "S{k}", "struct", 4, 6), ("ws:{k}.rs:size:5", "size", "field", 5, 5), ("ws:{k}.rs:area:9", "area", "method", 9, 15), ("ws:{k}.rs:MAX:18", "MAX", "constant", 18, 18), ("ws:{k}.rs:grow{k}:19", "grow{k}", "function", 19, 19), ("ws:{k}.rs:m{k}:20", "m{k}", "macro", 20, 20)], _NODE))
def rust_nodes(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "rs", _RUST)))


@query(_values([("ws:{k}.rs:import:1", "fs", "IMPORTS"), ("ws:{k}.rs:import:1", "io::Read", "IMPORTS"), ("ws:{k}.rs:S{k}:4", "size", "CONTAINS"), ("ws:{k}.rs:size:5", "u32", "REFERENCES"), ("ws:{k}.rs:S{k}", "Shape", "IMPLEMENTS"), ("ws:{k}.rs:S{k}", "area", "DECLARES"), ("ws:{k}.rs:area:9", "grow{k}", "CALLS")], _EDGE))
def rust_edges(spark, d):
    return _edges(parsing.parse(_written(spark, d, "rs", _RUST)))


_GO = 'package p\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype S{k} struct {\n\tSize int `json:"x{"`\n}\n\nfunc (s *S{k}) Area(\n\ta int,\n) int {\n\treturn grow{k}(a)\n}\n\nfunc grow{k}(n int) int { return n }\n\nconst Max{k} = 3\n'


@query(_values([("ws:{k}.go:import:4", "import", "import", 4, 4), ("ws:{k}.go:import:5", "import", "import", 5, 5), ("ws:{k}.go:S{k}:8", "S{k}", "struct", 8, 10), ("ws:{k}.go:Size:9", "Size", "field", 9, 9), ("ws:{k}.go:Area:12", "Area", "method", 12, 16), ("ws:{k}.go:grow{k}:18", "grow{k}", "function", 18, 18), ("ws:{k}.go:Max{k}:20", "Max{k}", "constant", 20, 20)], _NODE))
def go_nodes(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "go", _GO)))


@query(_values([("ws:{k}.go:import:4", "fmt", "IMPORTS"), ("ws:{k}.go:import:5", "b", "IMPORTS"), ("ws:{k}.go:S{k}:8", "Size", "CONTAINS"), ("ws:{k}.go:Size:9", "int", "REFERENCES"), ("ws:{k}.go:S{k}", "Area", "DECLARES"), ("ws:{k}.go:Area:12", "grow{k}", "CALLS")], _EDGE))
def go_edges(spark, d):
    return _edges(parsing.parse(_written(spark, d, "go", _GO)))


_SCRIPT = "import { a{k} as z, b } from './lib/x';\nexport class C{k} extends Base implements Shape {\n  area(n: number): number {\n    if (n) { return grow{k}(n); }\n    return 0;\n  }\n}\nexport const grow{k} = async (n: number): Promise<number> => {\n  return twice{k}(n);\n};\nfunction twice{k}<T>(n: T) {\n  return `}} not_a_call(1) ${n}`;\n}\n"


@query(_values([("ws:{k}.ts:import:1", "import", "import", 1, 1), ("ws:{k}.ts:C{k}:2", "C{k}", "class", 2, 7), ("ws:{k}.ts:area:3", "area", "method", 3, 6), ("ws:{k}.ts:grow{k}:8", "grow{k}", "function", 8, 10), ("ws:{k}.ts:twice{k}:11", "twice{k}", "function", 11, 13)], _NODE))
def typescript_nodes(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "ts", _SCRIPT)))


@query(_values([("ws:{k}.ts:import:1", "a{k}", "IMPORTS"), ("ws:{k}.ts:import:1", "b", "IMPORTS"), ("ws:{k}.ts:import:1", "x", "IMPORTS"), ("ws:{k}.ts:C{k}:2", "Base", "EXTENDS"), ("ws:{k}.ts:C{k}:2", "Shape", "IMPLEMENTS"), ("ws:{k}.ts:C{k}:2", "area", "DECLARES"), ("ws:{k}.ts:area:3", "grow{k}", "CALLS"), ("ws:{k}.ts:grow{k}:8", "twice{k}", "CALLS")], _EDGE))
def typescript_edges(spark, d):
    return _edges(parsing.parse(_written(spark, d, "ts", _SCRIPT)))


@query("""with f as (select p_partkey as k, case p_size % 3 when 0 then 'walk' when 1 then 'Run' else 'run' end as child from part)
select k, child, case when child = 'run' then 'CONTAINS' else 'DECLARES' end as edge_type from f""")
def nested_edge_names(spark, d):
    """A member whose parent's id ends with its own name is contained, any other declared: an impl block's id ends with its type."""
    name = F.when(F.col("p_size") % 3 == 1, "Run").when(F.col("p_size") % 3 == 2, "run").otherwise("walk")
    part = table(spark, d, "part")
    content = F.concat(F.lit("impl run {\n    fn "), name, F.lit("(&self) {}\n}\n"))
    f = part.select(F.lit("ws").alias("workspace"), F.concat(F.col("p_partkey").cast("string"), F.lit(".rs")).alias("file_path"), content.alias("content"))
    edges = parsing.parse(f)[1].where("edge_type in ('CONTAINS', 'DECLARES')")
    return edges.select(F.regexp_extract("source_id", r":(\d+)\.rs:", 1).cast("long").alias("k"), F.col("target_label").alias("child"), "edge_type")


_MARKDOWN = "# Top {k}\nsee [a](./x/a{k}.md#part) and `word{k}` and `true`\n## Sub\n```python\ndef f{k}(x):\n    # Not a heading\n```\n[out](http://e.org/a) `word{k}` `word{k}`\n# Next\n"


@query(_values([("ws:{k}.md:Top {k}:1", "Top {k}", "document", 1, 2), ("ws:{k}.md:Sub:3", "Sub", "section", 3, 8), ("ws:{k}.md:f{k}:4", "f{k}", "function", 4, 7), ("ws:{k}.md:Next:9", "Next", "document", 9, 9)], _NODE))
def markdown_nodes(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "md", _MARKDOWN)))


@query(_values([("ws:{k}.md:Top {k}:1", "a{k}.md", "LINKS_TO"), ("ws:{k}.md:Top {k}:1", "word{k}", "REFERENCES"), ("ws:{k}.md:Top {k}:1", "Sub", "CONTAINS"), ("ws:{k}.md:Sub:3", "f{k}", "CONTAINS"), ("ws:{k}.md:Sub:3", "word{k}", "REFERENCES")], _EDGE))
def markdown_edges(spark, d):
    return _edges(parsing.parse(_written(spark, d, "md", _MARKDOWN)))


_YAML = "kind: Service\nmetadata:\n  name: \"one{k}\"\n---\nkind: A\nname: two\nspec:\n  kind: Deployment\n  name: later\n---\nname: bare{k}\n---\nkind: Lost\n"


@query(_values([("ws:{k}.yaml:one{k}", "one{k}", "Service"), ("ws:{k}.yaml:two", "two", "Deployment"), ("ws:{k}.yaml:bare{k}", "bare{k}", "resource"), ("ws:{k}.yaml", "{k}.yaml", "manifest")], "id label kind"))
def yaml_documents(spark, d):
    """Of each document the last kind and the first name; one without name has no node."""
    return parsing.parse(_written(spark, d, "yaml", _YAML))[0].select("id", "label", "kind")


_SHELL = "#!/bin/sh\nfunction one_{k} {\n  two\n}\ntwo-{k} () {\n  echo\n}\none_{k}\n"


@query(_values([("ws:{k}.sh:one_{k}", "one_{k}", "function", 2, 8), ("ws:{k}.sh:two-{k}", "two-{k}", "function", 5, 8), ("ws:{k}.sh", "{k}.sh", "script", 1, 8)], _NODE))
def shell_functions(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "sh", _SHELL)))


_TOML = "top = 1\n[package]\nname = 'x{k}'\n[[bin.{k}]]\npath = 'y'\n"


@query(_values([("ws:{k}.toml:package", "package", "section", 2, 5), ("ws:{k}.toml:bin.{k}", "bin.{k}", "section", 4, 5), ("ws:{k}.toml", "{k}.toml", "config", 1, 5)], _NODE))
def toml_sections(spark, d):
    return _nodes(parsing.parse(_written(spark, d, "toml", _TOML)))


@query("""select doc_id, case doc_id % 7 when 0 then 'rust' when 1 then 'python' when 2 then 'typescript' when 3 then 'yaml' when 4 then 'markdown' end as language from documents""")
def language_dispatch(spark, d):
    ends = F.array(*[F.lit(e) for e in ("a.b.rs", "x.PY", "q.tsx", "k.yml", "r.markdown", "image.png", "Makefile")])
    path = F.concat(F.lit("dir.go/f"), F.col("doc_id").cast("string"), F.lit("/"), F.get(ends, (F.col("doc_id") % 7).cast("int")))
    return table(spark, d, "documents").select("doc_id", parsing.language(path).alias("language"))


@query("""select 'ws:' || p_partkey || case when p_size % 2 = 0 then '.py' else '.xyz' end as id, case when p_size % 2 = 0 then p_partkey || '.py' else p_partkey || '.xyz' end as label, 'file' as kind, 1 as lines from part""")
def empty_parse_falls_back(spark, d):
    """Python that does not parse, and unknown kinds, become plain files."""
    key = F.col("p_partkey").cast("string")
    python = F.col("p_size") % 2 == 0
    f = table(spark, d, "part").select(F.lit("ws").alias("workspace"), F.concat(key, F.when(python, ".py").otherwise(".xyz")).alias("file_path"), F.when(python, "def (:").otherwise("plain").alias("content"))
    return parsing.parse(f)[0].select("id", "label", "kind", F.col("line_end").alias("lines"))


@query("""select doc_id, '[' || lang || '] doc ' || doc_id || ' in ' || source || chr(10) || text as rich from documents""")
def enriched_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.enriched_text(F.col("lang"), F.lit("doc"), F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("rich"))


@query("""select doc_id, case when length(text) % 5 = 0 then 0.0 else length(text)::double end as a, case when length(text) % 5 = 0 then 0.0 else (length(text) - length(replace(text, 'e', '')))::double end as b from documents""")
def embed_batches(spark, d):
    """An embedder that is given at most BATCH texts, and of the wrong length for some: those get zero vectors."""

    def run(texts: list[str]) -> list[list[float]]:
        assert len(texts) <= vectors.BATCH
        return [[1.0] if len(t) % 5 == 0 else [float(len(t)), float(t.count("e"))] for t in texts]

    out = vectors.embed(table(spark, d, "documents").select("doc_id", "text"), dim=2, embedder=run)
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query("""with nodes as (select 'ws:' || p_brand || ':' || p_type as id, p_brand as f, p_type as l from part),
x as (select p_partkey as k, p_brand as f, p_type as l, p_size from part)
select k, case p_size % 3 when 0 then (select min(id) from nodes n where n.f = x.f and n.l = x.l) when 1 then (select min(id) from nodes n where n.l = x.l) else 'ws:' || f || ':' || l || ':9' end as source from x""")
def edge_source_resolution(spark, d):
    """Sources of three parts are looked up by label, in their file first, then in the workspace; longer ids stand as they are."""
    part = table(spark, d, "part")
    nodes = part.select(F.concat_ws(":", F.lit("ws"), "p_brand", "p_type").alias("id"), F.lit("ws").alias("workspace"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("label"))
    kind = F.col("p_size") % 3
    file = F.when(kind == 1, "elsewhere").otherwise(F.col("p_brand"))
    own = F.concat_ws(":", F.lit("ws"), file, "p_type", F.when(kind == 2, "9"))
    wanted = part.select(F.lit("ws").alias("workspace"), own.alias("source_id"), F.lit("t").alias("target_label"), F.col("p_partkey").cast("string").alias("target_id"), F.lit("CALLS").alias("edge_type"), F.lit("EXTRACTED").alias("category"))
    return graph.resolve_edges(nodes, wanted).select(F.col("target").cast("long").alias("k"), "source")


@query("""with o as (select doc_id, text, doc_id % 4 as m from documents)
select 'ws' || doc_id % 3 || ':' || doc_id || '.txt' as id, case when m <> 0 then 7 end as community, (m = 1)::int as changed from o where m <> 3
union all select 'ws' || doc_id % 3 || ':' || doc_id || '.txt', null, 1 from o where m = 3""")
def reindex_changed(spark, d):
    """Unchanged files (0, 2), a changed one (1) that keeps its file's community, and a new one (3); a hash decides."""
    docs = table(spark, d, "documents")
    m = F.col("doc_id") % 4
    whole = docs.select(F.concat(F.lit("ws"), (F.col("doc_id") % 3).cast("string")).alias("workspace"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("one line").alias("content"), m.alias("m"))
    hashed = lambda df: df.withColumn("file_hash", F.sha2("content", 256))
    old = whole.where("m <> 3").select(F.concat_ws(":", "workspace", "file_path").alias("id"), "workspace", F.col("file_path").alias("label"), F.lit("file").alias("kind"), "file_path", F.lit("text").alias("language"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("old").alias("text"), F.when(F.col("m") == 1, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256)).alias("file_hash"), F.lit(None).cast("array<float>").alias("embedding"), F.when(F.col("m") != 0, F.lit(7)).alias("community"))
    edges = spark.createDataFrame([], "source string, target string, type string")
    nodes, _ = indexing.reindex(old, edges, hashed(whole.drop("m")), 2, lambda texts: [[1.0, 0.0]] * len(texts))
    return nodes.select("id", "community", (F.col("text") == "one line").cast("int").alias("changed"))


@query("""with n as (select 'n' || p_partkey as id, 'ws' || p_size % 3 as workspace, 'f' || p_partkey % 50 as file_path, p_size as community from part),
d as (select distinct workspace, file_path, case when substr(file_path, 2)::int % 3 = 0 then 'Deleted' when substr(file_path, 2)::int % 3 = 1 then 'Renamed' end as kind from n)
select n.id, case when d.kind = 'Renamed' then 'new/' || n.file_path else n.file_path end as file_path, n.community from n join d using (workspace, file_path) where d.kind is distinct from 'Deleted'""")
def apply_changeset(spark, d):
    key = F.col("p_partkey")
    nodes = table(spark, d, "part").select(F.concat(F.lit("n"), key.cast("string")).alias("id"), F.concat(F.lit("ws"), (F.col("p_size") % 3).cast("string")).alias("workspace"), F.concat(F.lit("f"), (key % 50).cast("string")).alias("file_path"), F.col("p_size").alias("community"))
    n = F.substring("file_path", 2, 9).cast("int") % 3
    kind = F.when(n == 0, "Deleted").when(n == 1, "Renamed")
    every = nodes.select("workspace", "file_path").distinct().withColumn("kind", kind).where("kind is not null")
    deltas = every.select("workspace", F.when(F.col("kind") == "Renamed", F.concat(F.lit("new/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"), "kind", F.when(F.col("kind") == "Renamed", F.col("file_path")).alias("old_path"))
    none = nodes.limit(0).drop("community")
    edges = spark.createDataFrame([], "source string, target string")
    return sync.apply_changes(nodes, edges, deltas, none, edges)[0].select("id", "file_path", "community")


@query("""with f as (select source as workspace, max(doc_id) as m from documents group by source)
select 'gone' as what, source as workspace, doc_id || '.txt' as file_path, null::bigint as changes from documents where doc_id % 5 = 0
union all select 'due', (user_id % 4)::varchar, null, count(*) from events group by user_id % 4 having max(ts) <= timestamp '2024-01-30 12:00:00' - interval 3500 millisecond""")
def periodic_sweep(spark, d):
    known = files(spark, d).select("workspace", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), "doc_id")
    events = table(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("workspace"), "ts")
    gone, due = indexing.sweep(known, known.where("doc_id % 5 <> 0"), events, F.lit("2024-01-30 12:00:00").cast("timestamp"))
    nothing = lambda kind: F.lit(None).cast(kind)
    return gone.select(F.lit("gone").alias("what"), "workspace", "file_path", nothing("long").alias("changes")).unionByName(due.select(F.lit("due").alias("what"), "workspace", nothing("string").alias("file_path"), "changes"))
