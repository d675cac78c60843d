"""Parsers: source files (workspace, file_path, content) to nodes and unresolved edges.

The line-based kinds (chunks, links, YAML, JSON, shell, SQL, TOML) are column
expressions.  Markdown and programming languages keep a state from line to line
or need a syntax tree; they run in ``mapInArrow`` over whole files, one file at a
time, and feed the same tables.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import extension
from weftline.operators.lexing import blanked, without_type_arguments
from weftline.schemas import EXTRACTED_EDGES, PARSED_NODES
from weftline.session import materialize, spread

# Extensions by language, and the sizes of what is kept.
LANGUAGES = {
    "rs": "rust", "py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "md": "markdown", "markdown": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json",
    "sh": "shell", "bash": "shell", "sql": "sql", "toml": "toml",
}
TEXT_LIMIT, FIELD_LIMIT = 1000, 300
CHUNK, MAX_CHUNKS = 40, 25
SHELL_LINES, SQL_LINES, TOML_LINES = 25, 30, 20
# Sizes of work: files that a task takes from a batch at once, and rows that it gives at once.
FILES, ROWS = 200, 2000
# Words in backticks that are no references.
STOP_WORDS = {
    "true", "false", "null", "none", "None", "self", "this", "str", "int", "bool", "def", "class", "fn", "let",
    "mut", "const", "return", "git", "npm", "cargo", "pip", "http", "https", "node", "type", "array", "float",
    "list", "dict",
}
# Link targets that are files of the tree.
LINK_ENDS, LINK_STARTS = (".md", ".markdown", ".py", ".rs", ".go", ".ts", ".js"), ("./", "../")

_NODE_COLUMNS = [f.split()[0] for f in PARSED_NODES.split(", ")]
_EDGE_COLUMNS = [f.split()[0] for f in EXTRACTED_EDGES.split(", ")]


def language(path: Column) -> Column:
    """The language by extension; null for unknown ones."""
    ext, out = extension(path), F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def lines_of(content: Column) -> Column:
    """The lines without a trailing empty one."""
    return F.split(F.regexp_replace(content, r"\r?\n$", ""), r"\r?\n")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _file_id() -> Column:
    return F.concat_ws(":", "workspace", "file_path")


def _node(id_: Column, label: Column, kind, lang, start: Column, end: Column, text: Column) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [id_.alias("id"), F.col("workspace"), label.alias("label"), lit(kind).alias("kind"), F.col("file_path"), lit(lang).alias("language"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), F.left(text, F.lit(TEXT_LIMIT)).alias("text")]


def chunks(files: DataFrame) -> DataFrame:
    """Blocks of CHUNK lines of files with more lines than that, MAX_CHUNKS at most."""
    cut = files.withColumn("_l", lines_of(F.col("content"))).where(F.size("_l") > CHUNK)
    at = cut.withColumn("_s", F.explode(F.sequence(F.lit(0), F.least(F.size("_l") - 1, F.lit(CHUNK * MAX_CHUNKS - 1)), F.lit(CHUNK))))
    start, end = F.col("_s") + 1, F.least(F.col("_s") + CHUNK, F.size("_l"))
    span = F.concat(F.lit("L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    return at.select(*_node(F.concat(_file_id(), F.lit("#"), span), F.concat(name_of(F.col("file_path")), F.lit(" "), span), "block", "text", start, end, F.array_join(F.slice("_l", start, CHUNK), "\n")))


def file_nodes(files: DataFrame, kind: str = "file", lang: str = "text") -> DataFrame:
    size = F.size(lines_of(F.col("content")))
    return files.select(*_node(_file_id(), name_of(F.col("file_path")), kind, lang, F.lit(1), size, F.col("content")))


def fallback(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node a file and its blocks, with edges between them."""
    blocks = chunks(files)
    return file_nodes(files).unionByName(blocks), contains(blocks)


def contains(members: DataFrame, target_by_id: bool = True) -> DataFrame:
    """CONTAINS edges from the file to its members."""
    return members.select("workspace", F.concat_ws(":", "workspace", "file_path").alias("source_id"), F.col("label").alias("target_label"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("edge_type"), F.lit("EXTRACTED").alias("category"))


def _members(files: DataFrame, pattern: str, group: int, kind: Column | str, lang: str, window: int) -> DataFrame:
    """A node for each line that matches, with the lines from there as its text."""
    lines = files.withColumn("_l", lines_of(F.col("content")))
    found = lines.select("workspace", "file_path", "_l", F.posexplode("_l").alias("_i", "_line")).where(F.col("_line").rlike(pattern))
    named = found.withColumn("_name", F.regexp_extract("_line", pattern, group)).where("_name <> ''")
    return named.select(*_node(F.concat_ws(":", "workspace", "file_path", "_name"), F.col("_name"), kind, lang, F.col("_i") + 1, F.least(F.col("_i") + window, F.size("_l")), F.array_join(F.slice("_l", F.col("_i") + 1, window), "\n")))


def shell(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = _members(files, r"^\s*(?:function\s+(?=[\w-]+)|(?=[A-Za-z_][\w-]*\s*\(\)))([A-Za-z_][\w-]*)", 1, "function", "shell", SHELL_LINES)
    return file_nodes(files, "script", "shell").unionByName(members), contains(members)


def sql(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    pattern = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|PROCEDURE|FUNCTION)\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)"
    what = F.lower(F.regexp_extract("_line", r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW|PROCEDURE|FUNCTION)", 1))
    members = _members(files, pattern, 1, F.when(what == "procedure", "function").otherwise(what), "sql", SQL_LINES)
    return file_nodes(files, "sql", "sql").unionByName(members), contains(members)


def toml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = _members(files, r"^\s*\[+([^\]]+)\]+", 1, "section", "toml", TOML_LINES)
    return file_nodes(files, "config", "toml").unionByName(members), contains(members)


def json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Top-level keys as properties; a file that is no object gives its own node only."""
    keys = files.select("workspace", "file_path", F.explode(F.map_entries(F.from_json("content", "map<string,string>"))).alias("_e"))
    members = keys.select(*_node(F.concat_ws(":", "workspace", "file_path", "_e.key"), F.col("_e.key"), "property", "json", F.lit(1), F.lit(1), F.concat_ws(": ", "_e.key", "_e.value")))
    return file_nodes(files, "config", "json").unionByName(members), contains(members)


def yaml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node for each document between ``---`` lines: the last kind and the first name in it."""
    docs = files.select("workspace", "file_path", F.posexplode(F.split("content", r"(?m)^---[ \t]*$")).alias("_n", "_doc"))
    value = lambda key, which: F.trim(F.regexp_replace(F.try_element_at(F.regexp_extract_all("_doc", F.lit(rf"(?m)^\s*{key}:[ \t]*(.+)$")), F.lit(which)), "[\"']", ""))
    named = docs.withColumn("_kind", value("kind", -1)).withColumn("_name", value("name", 1)).where("_name is not null and _name <> ''")
    start = F.lit(1)
    members = named.select(*_node(F.concat_ws(":", "workspace", "file_path", "_name"), F.col("_name"), F.coalesce(F.nullif("_kind", F.lit("")), F.lit("resource")), "yaml", start, F.size(lines_of(F.col("_doc"))), F.trim("_doc")))
    return file_nodes(files, "manifest", "yaml").unionByName(members), contains(members)


def links(content: Column) -> Column:
    """The targets of Markdown links that are files of the tree, by their last part, each once."""
    targets = F.transform(F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)]*)\)")), lambda t: F.trim(F.get(F.split(t, "#"), F.lit(0))))
    ours = F.filter(targets, lambda t: F.exists(F.array(*[F.lit(e) for e in LINK_ENDS]), lambda e: F.endswith(t, e)) | F.exists(F.array(*[F.lit(s) for s in LINK_STARTS]), lambda s: F.startswith(t, s)))
    return F.array_distinct(F.filter(F.transform(ours, lambda t: F.element_at(F.split(t, "/"), -1)), lambda t: t != ""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'))


def headings(files: DataFrame) -> DataFrame:
    """(workspace, file_path, line, level, label) of Markdown headings outside fences, levels 1 to 4."""
    lines = F.transform(lines_of(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("t")))
    fence = F.filter(lines, lambda x: F.startswith(x["t"], F.lit("```")))
    heads = F.filter(lines, lambda x: x["t"].rlike(r"^#{1,4}(?!#)\s*\S"))
    rows = files.select("workspace", "file_path", fence.alias("_f"), F.explode(heads).alias("_h"))
    outside = rows.where(F.size(F.filter("_f", lambda f: f["line"] < F.col("_h.line"))) % 2 == 0)
    return outside.select("workspace", "file_path", "_h.line", F.length(F.regexp_extract("_h.t", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace("_h.t", r"^#+\s*", ""), r"^[*_`]+|[*_`]+$", "")).alias("label")).where("label <> ''")


class _Out:
    """Collects the nodes and edges of one file."""

    def __init__(self, workspace: str, path: str):
        self.ws, self.path, self.nodes, self.edges, self.seen = workspace, path, [], [], set()

    def node(self, label, kind, lang, start, end, text, id_=None, limit=TEXT_LIMIT) -> str:
        id_ = id_ or f"{self.ws}:{self.path}:{label}:{start}"
        self.nodes.append((id_, self.ws, label, kind, self.path, lang, start, end, text[:limit]))
        return id_

    def edge(self, source, label, kind, target=None, once=False) -> None:
        if not once or (source, label, kind) not in self.seen:
            self.seen.add((source, label, kind))
            self.edges.append((self.ws, source, label, target, kind, "EXTRACTED"))


def markdown_file(workspace: str, path: str, content: str) -> _Out:
    """Sections by headings with their hierarchy, fenced snippets, file links and names in backticks."""
    out, lines = _Out(workspace, path), content.splitlines()
    section, stack, fence = None, [], None

    def close(end: int) -> None:
        if section:
            out.node(section["label"], "document" if section["level"] == 1 else "section", "markdown", section["start"], end, "\n".join(section["body"]), section["id"])

    for n, line in enumerate(lines, 1):
        bare = line.strip()
        if bare.startswith("```"):
            if fence is None:
                fence = (n, bare.strip("`").strip().lower(), [])
                continue
            start, lang, body = fence
            fence, lang = None, lang or "code"
            name = next((m[1] or f"k8s:{m[2].strip()}" for x in body if (m := re.match(r"(?:(?:func|def|fn|class) ([^(:<{ ]+)|kind: (.*))", x.strip()))), None)
            label = name or f"{section['label'] if section else 'document'} ({lang})"
            made = out.node(label, "function" if name else "snippet", lang, start, n, "\n".join(body))
            if section:
                out.edge(section["id"], label, "CONTAINS", made)
            continue
        if fence is not None:
            fence[2].append(line)
            continue
        if (head := re.match(r"(#{1,4})(?!#)\s*(.*)", bare)) and (label := head[2].strip().strip("*_`").strip()):
            close(n - 1)
            level, made = len(head[1]), f"{workspace}:{path}:{label}:{n}"
            stack = [s for s in stack if s[0] < level]
            if stack:
                out.edge(stack[-1][1], label, "CONTAINS", made)
            stack.append((level, made))
            section = {"level": level, "label": label, "start": n, "body": [f"{head[1]} {head[2].strip()}"], "id": made}
            continue
        if section:
            section["body"].append(line)
        elif bare:
            label = path.rsplit("/", 1)[-1]
            section = {"level": 1, "label": label, "start": 1, "body": [line], "id": f"{workspace}:{path}:{label}:1"}
            stack.append((1, section["id"]))
        if section:
            for target in re.findall(r"\[[^\]]*\]\(([^)]*)\)", line):
                target = target.split("#")[0].strip()
                if (target.endswith(LINK_ENDS) or target.startswith(LINK_STARTS)) and (label := target.rsplit("/", 1)[-1]):
                    out.edge(section["id"], label, "LINKS_TO", once=True)
            for word in re.findall(r"`([^`]*)`", line):
                word = word.strip()
                if 3 <= len(word) <= 64 and re.fullmatch(r"[^\W\d][\w.]*", word) and word not in STOP_WORDS:
                    out.edge(section["id"], word, "REFERENCES", once=True)
    close(len(lines))
    return out


def _calls(tree: ast.AST) -> Iterator[str]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = ast.unparse(node.func).rsplit(".", 1)[-1].strip()
            if name.isidentifier():
                yield name


def python_file(workspace: str, path: str, content: str) -> _Out:
    """Functions, methods, classes with bases, constants, imports and calls of a Python file.

    Nothing where it does not parse, or is nested too deeply to be walked; such a
    file is chunked as any text.
    """
    try:
        return _python_tree(_Out(workspace, path), ast.parse(content), content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _Out(workspace, path)


def _python_tree(out: _Out, tree: ast.AST, content: str) -> _Out:
    workspace, path = out.ws, out.path
    lines = content.splitlines()
    text = lambda n: "\n".join(lines[n.lineno - 1 : n.end_lineno])

    def visit(node: ast.AST, parent: str | None, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                made = out.node(child.name, "method" if inside_class else "function", "python", child.lineno, child.end_lineno, text(child))
                if parent:
                    out.edge(parent, child.name, "CONTAINS" if parent.endswith(child.name) else "DECLARES", made)
                own = ast.Module([c for c in child.body if not isinstance(c, (ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef))], [])
                for name in _calls(own):
                    out.edge(made, name, "CALLS")
                visit(child, made, False)
            elif isinstance(child, ast.ClassDef):
                made = out.node(child.name, "class", "python", child.lineno, child.end_lineno, text(child))
                if parent:
                    out.edge(parent, child.name, "DECLARES", made)
                for base in child.bases:
                    out.edge(made, ast.unparse(base).rsplit(".", 1)[-1], "EXTENDS")
                visit(child, made, True)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                made = out.node("import", "import", "python", child.lineno, child.end_lineno, text(child), f"{workspace}:{path}:import:{child.lineno}")
                for alias in child.names:
                    out.edge(made, alias.name, "IMPORTS")
            elif parent is None and isinstance(child, ast.Assign):
                for t in child.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        out.node(t.id, "constant", "python", child.lineno, child.end_lineno, text(child))
            else:
                visit(child, parent, inside_class)

    visit(tree, None, False)
    return out


# Lexical patterns of declarations: (pattern with the name as group 1, kind); white space may span lines.
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_DECLARATIONS = {
    "rust": [(_PUB + r"(?:(?:async|unsafe|const|extern)\s+)*fn\s+(\w+)", "function"), (_PUB + r"struct\s+(\w+)", "struct"), (_PUB + r"enum\s+(\w+)", "enum"), (_PUB + r"(?:unsafe\s+)?trait\s+(\w+)", "trait"), (r"macro_rules!\s+(\w+)", "macro"), (_PUB + r"type\s+(\w+)", "type"), (_PUB + r"(?:const|static)\s+(?:mut\s+)?(\w+)\s*:", "constant")],
    "go": [(r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", "function"), (r"type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", "struct"), (r"type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", "interface"), (r"type\s+(\w+)\s+\w", "type"), (r"const\s+(\w+)\b", "constant")],
    "javascript": [(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=;{]+)?=>", "function"), (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"(?:export\s+)?interface\s+(\w+)", "interface"), (r"(?:export\s+)?type\s+(\w+)\s*[=<]", "type"), (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"), (r"(?:(?:public|private|protected|static|async|get|set|override)\s+)*(\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;=]+)?(?=\{)", "member")],
}
_IMPORT = {"rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+)", "go": r"^import\s+(?:\w+\s+|\.\s+)?(\"[^\"\n]+\")", "javascript": r"^[ \t]*import\s+((?:[^;'\"]*?from\s+)?['\"][^'\"\n]+['\"])"}
_MARK = re.compile(r"[()\[\]{};]|\n\s*")
_CALL = re.compile(r"([A-Za-z_][\w.:]*)!?\s*\(")
_NOT_CALLS = {"if", "for", "while", "match", "switch", "return", "fn", "func", "function", "catch", "loop", "in", "and", "or", "not", "await", "new", "constructor", "else", "do", "with", "typeof"}


def _symbols(lang: str, line: str) -> list[str]:
    """The names that an import brings in."""
    line = " ".join(line.split()).rstrip(";")
    clean = lambda xs: list(dict.fromkeys(y for x in xs if (y := re.sub(r"^\W+|\W+$", "", x))))
    inside = re.search(r"\{(.*)\}", line)
    if lang == "rust":
        return clean(re.split(r"[,{}]", inside[1]) if inside else [line.rsplit("::", 1)[-1].split(" ")[0]])
    if lang == "go":
        return clean([line.strip('"').rsplit("/", 1)[-1]])
    own = [p.split(" as ")[0] for p in inside[1].split(",")] if inside else []
    return clean([*own, line.rsplit("from ", 1)[-1].strip("'\" ").rsplit("/", 1)[-1]])


class _Code:
    """A source text with its comments and strings blanked, the ends of its blocks, and its lines."""

    def __init__(self, content: str, lang: str):
        self.lang, self.text, self.lines = lang, content, content.splitlines()
        self.code = blanked(content, lang)
        self.breaks = [m.start() for m in re.finditer("\n", content)]
        self.closes, open_ = {}, []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                self.closes[open_.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def body(self, at: int, start: int) -> tuple[int | None, int]:
        """(place of the block's brace, or None; place of the end) of a declaration whose name ends at ``at``.

        Brackets are skipped as a whole; a line's end closes a declaration without a
        block where the language has no need of a semicolon.
        """
        depth = self.code.count("(", start, at) - self.code.count(")", start, at) + self.code.count("[", start, at) - self.code.count("]", start, at)
        for m in _MARK.finditer(self.code, at):
            place, mark = m.start(), m[0][0]
            if mark in "([":
                depth += 1
            elif mark in ")]":
                depth -= 1
            elif depth <= 0:
                if mark == "{":
                    return place, self.closes.get(place, len(self.code))
                if mark == ";":
                    return None, place
                if mark == "}":
                    return None, place - 1
                if mark == "\n" and self.lang != "rust" and self.code[m.end() : m.end() + 1] != "{":
                    return None, place
        return None, len(self.code)

    def span(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first - 1 : last])


def _bare_types(header: str) -> str:
    """A header without its generics, however deep."""
    while (out := re.sub(r"<[^<>]*>", "", header)) != header:
        header = out
    return header


def lexical_file(workspace: str, path: str, content: str, lang: str) -> _Out:
    """Declarations, imports and calls by patterns over a text without comments and strings, and by matched brackets.

    An approximation of a syntax tree: signatures, generics and blocks may span lines.
    """
    kindred = "javascript" if lang == "typescript" else lang
    out, src = _Out(workspace, path), _Code(content, kindred)
    found = {}
    for pattern, kind in _DECLARATIONS[kindred]:
        for m in re.finditer(r"^[ \t]*" + pattern, src.code, re.M):
            found.setdefault(m.start(), (m, kind))
    if kindred == "rust":
        for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b", src.code, re.M):
            found[m.start()] = (m, "impl")
    scopes: list[tuple[int, int, str, str]] = []  # start, end, id, kind of the open blocks
    holders, heads = [], []  # blocks that may hold calls; the places of declarations
    for start in sorted(found):
        m, kind = found[start]
        while scopes and scopes[-1][1] < start:
            scopes.pop()
        outer = scopes[-1] if scopes else None
        if kind == "member" and (m[1] in _NOT_CALLS - {"constructor"} or not outer or outer[3] != "class"):
            continue
        brace, end = src.body(m.end(), start)
        if kind == "impl":
            header = _bare_types(re.sub(r"\bwhere\b.*", "", src.code[m.end() : brace or end], flags=re.S))
            if names := re.match(r"\s*!?\s*(?:([\w:]+)\s+for\s+)?&?\s*(?:mut\s+|dyn\s+)?([\w:]+)", header):
                own = f"{workspace}:{path}:{names[2].rsplit('::', 1)[-1]}"
                if names[1]:
                    out.edge(own, names[1].rsplit("::", 1)[-1], "IMPLEMENTS")
                scopes.append((start, end, own, kind))
            continue
        first, last = src.line(m.start(1)), src.line(max(end - 1, start) if brace is None else end)
        receiver = re.match(r"\s*func\s+\(\s*\w*\s*\*?(\w+)", m[0]) if kindred == "go" else None
        inside = kind == "function" and outer is not None and outer[3] in ("impl", "class", "trait", "interface")
        kind = "method" if kind == "member" or receiver or inside else kind
        made = out.node(m[1], kind, lang, first, last, src.span(first, last))
        heads.append((m.start(), m.end()))
        parent = f"{workspace}:{path}:{receiver[1]}" if receiver else outer[2] if outer else None
        if parent:
            out.edge(parent, m[1], "CONTAINS" if parent.endswith(m[1]) else "DECLARES", made)
        if kind == "class":
            header = _bare_types(src.code[m.end() : brace or end])
            for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
                if bases := re.search(rf"\b{word}\s+([\w.,\s]+?)(?=\bextends\b|\bimplements\b|$)", header):
                    for base in bases[1].split(","):
                        if base.strip():
                            out.edge(made, base.strip().rsplit(".", 1)[-1], edge)
        if kind == "struct" and brace is not None:
            _fields(out, src, lang, made, brace, end)
        if brace is not None:
            scopes.append((start, end, made, kind))
        if kind in ("function", "method"):
            holders.append((m.end(), end, made))
    _imports(out, src, kindred, lang, workspace, path)
    _called(out, without_type_arguments(src.code), holders, heads)
    return out


def _fields(out: _Out, src: _Code, lang: str, owner: str, brace: int, end: int) -> None:
    """The members of a struct, one a line of its own block."""
    at = src.line(brace)
    for offset, line in enumerate(src.code[brace + 1 : end].split("\n")):
        if "{" in line or "}" in line:
            continue
        if f := re.match(r"\s*" + _PUB + r"(\w+)\s*:?\s+([^,;]+)", line):
            made = out.node(f[1], "field", lang, at + offset, at + offset, src.lines[at + offset - 1].strip(), limit=FIELD_LIMIT)
            out.edge(owner, f[1], "CONTAINS", made)
            if (kinds := re.findall(r"\w+", f[2])) and len(kinds[-1]) < 50:
                out.edge(made, kinds[-1], "REFERENCES")


def _imports(out: _Out, src: _Code, kindred: str, lang: str, workspace: str, path: str) -> None:
    """A node for each import, with the names it brings in; paths stand in strings, so the text itself is read where code begins."""
    listed = []
    for m in re.finditer(_IMPORT[kindred], src.text, re.M):
        word = m.start() + len(m[0]) - len(m[0].lstrip())
        if src.code[word : word + 3].strip():
            listed.append((m.start(), m.end(), m[1]))
    if kindred == "go":
        for block in re.finditer(r"^import\s*\(([^)]*)\)", src.code, re.M):
            for m in re.finditer(r'"[^"\n]+"', src.text[block.start(1) : block.end(1)]):
                listed.append((block.start(1) + m.start(), block.start(1) + m.end(), m[0]))
    for start, end, what in sorted(listed):
        first, last = src.line(start), src.line(end - 1)
        made = out.node("import", "import", lang, first, last, src.span(first, last).strip(), f"{workspace}:{path}:import:{first}")
        for name in _symbols(kindred, what):
            out.edge(made, name, "IMPORTS")


def _called(out: _Out, code: str, holders: list[tuple[int, int, str]], heads: list[tuple[int, int]]) -> None:
    """Calls, each of the innermost function around it; the names of declarations are none."""
    holders, open_, at = sorted(holders), [], 0
    declared = {end for _, end in heads}
    starts = [a for a, _ in heads]
    for m in _CALL.finditer(code):
        while at < len(holders) and holders[at][0] <= m.start():
            open_.append(holders[at])
            at += 1
        while open_ and open_[-1][1] < m.start():
            open_.pop()
        k = bisect_right(starts, m.start()) - 1
        if not open_ or m.end() in declared or k >= 0 and m.start() < heads[k][1]:
            continue
        name = m[1].rsplit(".", 1)[-1].rsplit("::", 1)[-1]
        if m[1] not in _NOT_CALLS and name:
            out.edge(open_[-1][2], name, "CALLS")


def parse_code(workspace: str, path: str, content: str, lang: str) -> _Out:
    if lang == "markdown":
        return markdown_file(workspace, path, content)
    if lang == "python":
        return python_file(workspace, path, content)
    return lexical_file(workspace, path, content, lang)


_CODE = ("markdown", "python", "rust", "go", "javascript", "typescript")


def _code_rows(files: DataFrame) -> DataFrame:
    """Nodes and edges of files with a state, in one pass: ``n`` or ``e`` is filled."""

    types = {"string": pa.string(), "int": pa.int32()}
    fields = lambda ddl: [pa.field(n, types[t]) for n, t in map(str.split, ddl.split(", "))]
    node, edge = fields(PARSED_NODES), fields(EXTRACTED_EDGES)

    def structs(rows: list[tuple | None], own: list[pa.Field]) -> pa.StructArray:
        """The rows column by column; None is null."""
        filled = [r if r is not None else (None,) * len(own) for r in rows]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*filled, strict=True), own, strict=True)]
        return pa.StructArray.from_arrays(columns, fields=own, mask=pa.array([r is None for r in rows]))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        ws, paths, nodes, edges = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(paths, pa.string()), structs(nodes, node), structs(edges, edge)], ["workspace", "file_path", "n", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):  # a few files at a time are Python's objects
                for ws, path, content, lang in zip(*(c.to_pylist() for c in batch.slice(at, FILES).columns), strict=True):
                    out = parse_code(ws, path, content or "", lang)
                    rows += [(ws, path, x, None) for x in out.nodes]
                    rows += [(ws, path, None, x) for x in out.edges]
                    if len(rows) >= ROWS:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    pairs = lambda ddl: ",".join(":".join(f.split()) for f in ddl.split(", "))
    return files.select("workspace", "file_path", "content", "_lang").mapInArrow(run, f"workspace string, file_path string, n struct<{pairs(PARSED_NODES)}>, e struct<{pairs(EXTRACTED_EDGES)}>")


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and unresolved edges of all files; those that give nothing are chunked."""
    # written by language, so that each kind reads its own files alone, and those of no kind here none
    known = materialize(spread(files).withColumn("_lang", language(F.col("file_path"))), "files", ("_lang",))
    # written, as nodes, edges and the files without any come from it
    code = materialize(_code_rows(known.where(F.col("_lang").isin(*_CODE))), "code")
    nodes, edges = [code.where("n is not null").select("n.*")], [code.where("e is not null").select("e.*")]
    for name, run in (("yaml", yaml), ("json", json), ("shell", shell), ("sql", sql), ("toml", toml)):
        n, e = run(known.where(F.col("_lang") == name))
        nodes.append(n)
        edges.append(e)
    found = nodes[0].select("workspace", "file_path").distinct()
    rest = known.where(F.col("_lang").isNull()).unionByName(known.where(F.col("_lang").isin(*_CODE)).join(found, ["workspace", "file_path"], "left_anti").select(*known.columns))
    n, e = fallback(rest)
    all_nodes, all_edges = n, e
    for x, y in zip(nodes, edges, strict=True):
        all_nodes, all_edges = all_nodes.unionByName(x), all_edges.unionByName(y)
    return all_nodes, all_edges
