"""Telemetry: command classification by rule tables, votes, breakdowns, and the blend of two sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens a graph answer saves against reading files, and a symbol lookup.
GRAPH_SAVED, LOOKUP_SAVED = 14_500, 8_000


@dataclass(frozen=True)
class Rule:
    """A capability, given where a command holds any of ``words``, or any of ``gates`` and any of ``topics``."""

    capability: str
    category: str
    lookup: bool
    words: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()


#: Ordered rules; the words are those of the graph tool's command line and routes.
RULES = (
    Rule("symbol definition", "lookup", True, ("graph-symbol",), ("symbol",)),
    Rule("references", "lookup", True, ("graph-references",), ("references",)),
    Rule("condensed context", "condenser", True, ("graph-condense",), ("condense",)),
    Rule("graph retrieval", "rag", False, ("query-graph",), ("query",)),
    Rule("vector search", "vector", False, ("search-graph",), ("search",)),
    Rule("communities", "subsystem", False, ("graph-galaxies",), ("galaxies",)),
    Rule("live watch", "watch", False, (), ("watch",)),
    Rule("clustering", "cluster", False, (), ("cluster",)),
    Rule("ingestion", "ingest", False, (), ("ingest",)),
)


def classify(command: Column, gates: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (capability, category, lookup) of the first rule that fits, a general one behind them; null for other commands.

    ``gates`` are the words by which a command is known to call the graph tool.
    """
    low = F.lower(F.trim(command))
    has = lambda ws: F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(True)) for w in ws], F.lit(False)) if ws else F.lit(False)
    gate = has(gates)
    make = lambda a, b, c: F.struct(F.lit(a).alias("capability"), F.lit(b).alias("category"), F.lit(c).alias("lookup"))
    out = F.when(gate, make("general", "general", False))
    for rule in reversed(rules):
        fits = has(rule.words) | (gate & has(rule.topics))
        out = F.when(fits, make(rule.capability, rule.category, rule.lookup)).otherwise(out)
    return out


def canonical_workspace(value: Column, known: tuple[tuple[str, str], ...] = (), blocked: tuple[str, ...] = ()) -> Column:
    """The workspace a path or word stands for, by a table of (part, name), then the last folder of a path; null for blocked words."""
    bare = F.regexp_replace(value, r"^[\s'\"\\/;,]+|[\s'\"\\/;,]+$", "")
    low = F.lower(bare)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(name)) for part, name in known], F.lit(None).cast("string"))
    parts = F.split(bare, "/")
    leaf = F.when(F.contains(bare, F.lit(".")), F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(-1)))
    folder = F.when(F.contains(bare, F.lit("/")) & ~F.contains(leaf, F.lit(".")) & ~F.lower(leaf).isin(*blocked or ("",)), F.nullif(leaf, F.lit("")))
    return F.when((bare == "") | (low.isin(*blocked) if blocked else F.lit(False)), F.lit(None)).otherwise(F.coalesce(named, folder))


def command_workspace(command: Column, known: tuple[tuple[str, str], ...] = (), blocked: tuple[str, ...] = ()) -> Column:
    """The workspace that a command names: ``PROJECT=``, else ``workspace=``, else the first of its words that is a known name."""
    given = lambda pattern: canonical_workspace(F.nullif(F.regexp_extract(command, pattern, 1), F.lit("")), known, blocked)
    words = F.transform(F.split(command, r"\s+"), lambda w: F.regexp_replace(w, r"^['\",\\/;]+|['\",\\/;]+$", ""))
    names = F.array(*[F.lit(part) for part, _ in known]) if known else F.array().cast("array<string>")
    ours = F.filter(words, lambda w: (w != "") & ~F.startswith(w, F.lit("-")) & ~F.contains(w, F.lit(":")) & F.array_contains(names, F.lower(w)))
    return F.coalesce(given(r"PROJECT=['\"]?([^\s'\"]+)"), given(r"workspace=([^&\"'\s}]+)"), canonical_workspace(F.get(ours, F.lit(0)), known, blocked))


def workspace_votes(steps: DataFrame, gates: tuple[str, ...], known: tuple[tuple[str, str], ...] = (), blocked: tuple[str, ...] = (), tool: str = "run_command") -> DataFrame:
    """(session_id, workspace, weight): 2 for a graph command that names one, 2 for ``PROJECT=``, 1 for a command's folder, 1 for a tool's path."""
    calls = steps.select("session_id", F.explode("tool_calls").alias("c"))
    arg = lambda *names: F.regexp_replace(F.coalesce(*[F.get_json_object("c.args", f"$.{n}") for n in names]), "^['\"]+|['\"]+$", "")
    is_command, line = F.col("c.name") == tool, F.get_json_object("c.args", "$.CommandLine")
    own = lambda value: canonical_workspace(value, known, blocked)
    one = lambda when, ws, weight: F.struct(F.when(when, ws).alias("workspace"), F.lit(weight).alias("weight"))
    found = F.array(
        one(is_command & classify(line, gates).isNotNull(), command_workspace(line, known, blocked), 2),
        one(is_command, own(F.nullif(F.regexp_extract(line, r"PROJECT=(\S+)", 1), F.lit(""))), 2),
        one(is_command, own(arg("Cwd")), 1),
        one(F.lit(True), own(arg("AbsolutePath", "TargetFile", "SearchPath", "DirectoryPath")), 1),
    )
    return calls.select("session_id", F.inline(found)).where("workspace is not null")


def vote(votes: DataFrame, key: str, choice: str, weight: str, default: str) -> DataFrame:
    """(key, choice): the highest summed weight, the first name of equal ones; ``default`` where no weight is above 0."""
    sums = votes.groupBy(key, choice).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(key).agg(F.min_by(F.struct(choice, "w"), F.struct((-F.col("w")).alias("a"), F.col(choice).alias("b"))).alias("m"))
    return best.select(key, F.when(F.col("m.w") > 0, F.col(f"m.{choice}")).otherwise(F.lit(default)).alias(choice))


def summary(calls: DataFrame) -> DataFrame:
    """Calls and mean duration by capability and workspace."""
    return calls.groupBy("capability", "workspace").agg(F.count("*").alias("calls"), F.avg("duration_ms").alias("mean_ms"))


def recent(calls: DataFrame, n: int) -> DataFrame:
    return calls.orderBy(F.desc("created_at"), "id").limit(n)


def blend(a: DataFrame, b: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """The larger of two sources' counts for each key of either."""
    left, right = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return left.join(right, keys, "full_outer").select(*keys, F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).alias(value))


def tokens_saved(graph_calls: Column, lookups: Column) -> Column:
    return graph_calls * GRAPH_SAVED + lookups * LOOKUP_SAVED


def language_of(path: Column) -> Column:
    """The display name of an accepted extension; null for others."""
    names = {"rs": "Rust", "py": "Python", "go": "Go", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "md": "Markdown", "yaml": "YAML", "yml": "YAML", "json": "JSON", "sh": "Shell"}
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for e, name in names.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def attribute_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The workspace whose root is or holds each path, without regard to case; else the one with the path's last name.

    Of several roots a parent's wins over a worktree's (``is_worktree``, where there is such a
    column), then the longest, so that the choice is the same in any order.  Every ancestor of a path is looked up by an equi-join, so no pair of path and root
    is tested that does not match.
    """
    low = paths.withColumn("_low", F.lower("path")).withColumn("_parts", F.split("_low", "/"))
    ups = low.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_parts")))).withColumn("_root", F.array_join(F.slice("_parts", 1, F.col("_n")), "/"))
    tree = F.coalesce(F.col("is_worktree").cast("boolean"), F.lit(False)) if "is_worktree" in roots.columns else F.lit(False)
    places = roots.select(F.lower(F.regexp_replace("root_path", r"/+$", "")).alias("_root"), "workspace", tree.alias("_tree"))
    hits = ups.join(places, "_root").groupBy("path").agg(F.max_by("workspace", F.struct(~F.col("_tree"), "_n", "workspace")).alias("_by_root"))
    named = low.select("path", F.element_at(F.filter("_parts", lambda x: x != ""), -1).alias("_name")).join(roots.groupBy(F.lower("workspace").alias("_name")).agg(F.min("workspace").alias("_by_name")), "_name").groupBy("path").agg(F.min("_by_name").alias("_by_name"))
    return paths.join(hits, "path", "left").join(named, "path", "left").withColumn("workspace", F.coalesce("_by_root", "_by_name")).drop("_by_root", "_by_name")
