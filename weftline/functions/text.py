"""Scalar functions as column expressions: identifiers, paths, prompts, previews, times.

Lengths count characters, not bytes; only budgets count bytes (``octet_length``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are never a workspace, compared in lower case.
BLOCKED_WORKSPACES = (
    "src", "tools", "specs", "sdlc", "docs", "scripts", "rules", "analytics", "tests", "examples", "internal", "pkg",
    "node_modules", "dist", "build", "target", "config", "builtin", "skills", "plugins", "hooks", "book", "guides",
    "architecture", "scratch", "logs", "brain", "users", "home", "tmp", "var", "private", "knowledge", "interviews",
    "cloudstorage", "onedrive-personal", "g-drive", "default", "workspace", "runner", "work", "bin", "cmd", "lib", "library", "applications", "system", "volumes",
)
# Step types that a reader is shown.
DISPLAYABLE = (
    "USER_INPUT", "PLANNER_RESPONSE", "ERROR_MESSAGE", "VIEW_FILE", "RUN_COMMAND", "GREP_SEARCH", "LIST_DIRECTORY",
    "CODE_ACTION", "SEARCH_WEB", "READ_URL_CONTENT", "BROWSER_SUBAGENT", "ASK_QUESTION",
)
#: Path segments whose next segment names a repository.
PROJECT_PARENTS = ("knowledge", "Interviews")


def clean_record_id(value: Column) -> Column:
    """A record id without its table prefix and quoting marks."""
    return F.regexp_replace(F.regexp_replace(value, r"^node:", ""), "[`⟨⟩\"']", "")


def stored_text(value: Column) -> Column:
    """Text as a statement-based store keeps it: line ends become spaces, other control characters go."""
    return F.regexp_replace(F.regexp_replace(value, r"\n", " "), r"[\x00-\x09\x0B-\x1F\x7F]", "")


def normalize_workspace(value: Column) -> Column:
    """The last path segment of an argument, or null."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(F.trim(value), r"/+$", ""), "/"), -1), F.lit(""))


def parent_directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The text behind the last dot, in lower case; empty without a dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.element_at(F.split(path, r"\."), -1))).otherwise(F.lit(""))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; null outside it or at it."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.nullif(F.substring(path, len(prefix) + 1, 1 << 30), F.lit("")))


def suffix_match(label: Column, name: Column) -> Column:
    """Equal, or the last part of a qualified name."""
    return (label == name) | F.endswith(label, F.concat(F.lit("::"), name)) | F.endswith(label, F.concat(F.lit("."), name))


def callee_name(expression: Column) -> Column:
    """The called name of a call expression: behind the last dot, then the last double colon."""
    return F.trim(F.substring_index(F.substring_index(expression, ".", -1), "::", -1))


def field_type(declared: Column) -> Column:
    """The last alphanumeric run of a declared type, if shorter than 50; else null."""
    last = F.try_element_at(F.regexp_extract_all(declared, F.lit(r"(\w+)")), F.lit(-1))
    return F.when(F.octet_length(last) < 50, last)


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def imported_symbols(language: Column, snippet: Column) -> Column:
    """The names that an import statement brings in, each once, in order."""
    line = F.regexp_replace(F.trim(snippet), r";+$", "")
    listed = lambda text: F.transform(F.split(text, ","), lambda p: F.trim(p))
    inside = F.regexp_extract(line, r"\{([^}]*)\}", 1)
    braced = F.instr(line, "{") > 0
    first = lambda p: F.get(F.split(p, r"\s+"), F.lit(0))
    python = F.transform(listed(F.regexp_replace(line, r"^.*import ", "")), first)
    rust = F.when(braced, listed(inside)).otherwise(F.array(first(F.element_at(F.split(line, "::"), -1))))
    go = F.array(F.element_at(F.split(F.regexp_replace(line, r'^"+|"+$', ""), "/"), -1))
    module = F.element_at(F.split(F.regexp_replace(F.trim(F.element_at(F.split(line, "from "), -1)), "^['\"]+|['\"]+$", ""), "/"), -1)
    script = F.concat(F.when(braced, F.transform(listed(inside), lambda p: F.trim(F.get(F.split(p, " as "), F.lit(0))))).otherwise(F.array().cast("array<string>")), F.array(module))
    found = F.when(language == "python", python).when(language == "rust", rust).when(language == "go", go).when(language.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(found, _bare), lambda x: x != ""))


def user_prompt(content: Column, limit: int = 2000) -> Column:
    """The text inside the request tags; without tags the trimmed content, cut with dots."""
    pattern = r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>"
    bare = F.regexp_replace(content, r"^\s+|\s+$", "")
    cut = F.when(F.length(bare) > limit, F.concat(F.left(bare, F.lit(limit)), F.lit("..."))).otherwise(bare)
    return F.when(content.rlike(pattern), F.regexp_replace(F.regexp_extract(content, pattern, 1), r"^\s+|\s+$", "")).otherwise(cut)


def prompt_preview(content: Column, limit: int = 120) -> Column:
    """The first filled line without request tags, cut."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(content, r"</?USER_REQUEST>", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(limit)), F.lit(""))


def workspace_of(content: Column, own_folder: str | None = None) -> Column:
    """The workspace path that a message's metadata names; null without one.

    In order: active workspaces, the working directory, a mapping ``path -> name``,
    the folder of the active document.  Paths that hold ``own_folder`` are skipped.
    """

    def named(pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
        return F.when(~F.contains(found, F.lit(own_folder)), found) if own_folder else found

    document = F.nullif(F.regexp_extract(content, r"Active Document:\s*(/\S+)", 1), F.lit(""))
    return F.coalesce(
        named(r"(?m)Active Workspaces:\s*\n-\s*(/\S+)"),
        named(r"(?m)Command Working Directory:\s*(/\S+)"),
        named(r"(?m)(/\S+)\s*->\s*\S+"),
        F.when(~F.startswith(document, F.lit("/Untitled")), F.coalesce(F.nullif(parent_directory(document), F.lit("")), F.lit("/"))),
    )


def valid_workspace(name: Column, also_blocked: Sequence[str] = ()) -> Column:
    """Whether a name can be a workspace: visible, no file, no path, not blocked, two characters or more."""
    bare = F.trim(name)
    shaped = (F.length(bare) >= 2) & ~bare.rlike(r"^[._]") & ~bare.rlike(r"[./\\]")
    return F.coalesce(shaped & ~F.lower(bare).isin(*BLOCKED_WORKSPACES, *also_blocked), F.lit(False))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def project_name(path: Column, parents: Sequence[str] = PROJECT_PARENTS) -> Column:
    """The repository that a path lies in: behind a known parent, else the last valid folder, else ``Default``."""

    def last(parts: Column, n: Column) -> Column:
        folders = F.filter(parts, lambda x, i: ~((i == n - 1) & F.contains(x, F.lit("."))))
        return F.try_element_at(F.filter(folders, lambda x: valid_workspace(x)), F.lit(-1))

    def named(clean: Column) -> Column:
        behind = [_bound(F.nullif(F.regexp_extract(clean, f"/{p}/([^/]+)", 1), F.lit("")), lambda b: F.when(valid_workspace(b), b)) for p in parents]
        folder = _bound(F.split(clean, "/"), lambda parts: _bound(F.size(parts), lambda n: last(parts, n)))
        return F.coalesce(*behind, folder, F.lit("Default"))

    def whole(path: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(path, "^[\"']+|[\"']+$", ""), r"(?<=.)/+$", "")
        return F.when(path.isNull() | (path == "") | F.startswith(path, F.lit("/Untitled")), F.lit("Default")).otherwise(_bound(clean, named))

    return _bound(path, whole)


def search_preview(content: Column, query: str, width: int = 200) -> Column:
    """A window around the first match, with dots where it is cut."""
    at = F.instr(F.lower(content), query.lower())
    start = F.greatest(F.lit(0), at - 1 - width // 2)
    end = F.least(start + width, F.length(content))
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, start + 1, end - start), F.when(end < F.length(content), "...").otherwise(""))
    whole = F.when(F.length(content) > width, F.concat(F.left(content, F.lit(width)), F.lit("..."))).otherwise(content)
    return F.when(at == 0, whole).otherwise(window)


def highlight(content: Column, query: str) -> Column:
    return F.regexp_replace(content, F.lit("(?i)(\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E)"), F.lit("<mark>$1</mark>"))


def relative_time(then: Column, as_of: Column) -> Column:
    """Words for the time between two timestamps, whole units."""
    secs = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(then))
    mins, hours, days = (F.floor(secs / n) for n in (60, 3600, 86400))
    some = lambda n, unit: F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))
    return F.when(secs < 60, F.lit("just now")).when(mins < 60, some(mins, "minute")).when(hours < 24, some(hours, "hour")).when(days == 1, F.lit("yesterday")).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def date_bucket(then: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, then)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "past_7_days").otherwise("older")


def date_preset(then: Column, preset: str, as_of: Column) -> Column:
    """Whether a time is in ``today``, ``7d``, ``30d`` or ``all``."""
    back = {"today": 0, "7d": 7, "30d": 30}
    return F.lit(True) if preset == "all" else F.to_date(then) >= F.date_sub(as_of, back[preset])


def parse_date(value: Column, end_of_day: bool = False) -> Column:
    """A timestamp of a day (its start, or its last microsecond) or of one of four layouts; null otherwise."""
    day = F.try_to_timestamp(F.when(F.length(value) == 10, value), F.lit("yyyy-MM-dd"))
    if end_of_day:
        day = day + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND")
    layouts = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(day, *[F.try_to_timestamp(value, F.lit(p)) for p in layouts])


def args_preview(args: Column, limit: int = 500) -> Column:
    """Argument JSON cut with dots: 500 characters in details, 120 in digests."""
    return F.when(F.length(args) > limit, F.concat(F.left(args, F.lit(limit)), F.lit("..."))).otherwise(args)


def main_argument(args: Column) -> Column:
    """The path, command or query among JSON arguments, else all of them."""
    return F.coalesce(*[F.get_json_object(args, f"$.{k}") for k in ("AbsolutePath", "TargetFile", "CommandLine", "Query")], args)


def instability(afferent: Column, efferent: Column) -> Column:
    """Outgoing over all couplings; one half where there are none."""
    total = afferent + efferent
    return F.when(total == 0, F.lit(0.5)).otherwise(efferent / total)


def role(value: Column) -> Column:
    return F.when(value <= 0.25, "Core Foundation").when(value <= 0.65, "Domain Service").otherwise("Orchestrator / Leaf")


def basic_authorization(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat_ws(":", user, password).cast("binary")))


def message_filter(kind: str, type_: Column, content: Column, n_tools: Column) -> Column:
    """The named message filters; any other name is a step type."""
    spoken = (type_ == "PLANNER_RESPONSE") & (F.trim(F.coalesce(content, F.lit(""))) != "")
    kind = kind.upper()
    if kind in ("", "ALL"):
        return F.lit(True)
    if kind in ("AGENT_RESPONSES", "RESPONSES"):
        return spoken
    if kind in ("TOOL_CALLS", "TOOLS"):
        return n_tools > 0
    if kind in ("DIALOGUE", "CHAT"):
        return (type_ == "USER_INPUT") | spoken
    return type_ == kind
