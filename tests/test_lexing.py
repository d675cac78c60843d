"""Blanking against texts that are put together from known parts."""

import random

import pytest
from pyspark.sql import functions as F
from scans import scanned

from weftline.operators import parsing
from weftline.operators.lexing import blanked, without_type_arguments

#: Code and literals of each language; literals hold what would count if it were code.
CODE = {"rust": ["a + b;", "f(x)", "'life: loop {}", "fn g<'a>(x: &'a str) {}", "x / y / z"], "go": ["a := b / c", "f(x)", "if x { y() }"], "javascript": ["a = b / c / d;", "f(x) / 2;", "if (x) { y() }", "z = { k: 1 };", "w[0] / 3;", "i++;"]}
SILENT = {
    "rust": ['"fn no() { \\" }"', "// fn no() {", "/* { /* nested } */ fn no() */", 'r#"a " } fn no()"#', "'{'", "'\\''", "b'}'", 'br"{"', "'\\u{7d}'", '"two\nlines }"'],
    "go": ['"func no() { \\" }"', "// func no() {", "/* { func no() */", "`raw \" } \\`", "'{'", "'\\''", "'\\n'"],
    "javascript": ['"function no() { \\" }"', "// function no() {", "/* { function no() */", "'it\\'s }'", "`text } no() { \\` `"],
}


@pytest.mark.parametrize("lang", sorted(CODE))
def test_code_stays_and_literals_go(lang):
    r = random.Random(3)
    for _ in range(300):
        text, want = "", ""
        for _ in range(r.randrange(1, 12)):
            part = r.choice(CODE[lang]) if r.random() < 0.5 else r.choice(SILENT[lang])
            silent = part in SILENT[lang]
            glue = "\n" if part.startswith("//") or lang == "javascript" and r.random() < 0.5 else r.choice([" ;\n", " = ", "\n"])
            text += part + glue
            want += ("".join("\n" if c == "\n" else " " for c in part) if silent else part) + glue
        assert blanked(text, lang) == want, text


def test_regular_expressions_and_divisions():
    for text, want in (
        ("x = /a{2}\\/\"[/}]/gi.test(y)", "x = " + " " * 15 + ".test(y)"),
        ("return /}/;", "return    ;"),
        ("if (a) /}/.test(b);", "if (a)    .test(b);"),
        ("(a) / b / c", "(a) / b / c"),
        ("n / '}'.length / m", "n /    .length / m"),
        ("a[0] / b } c / d", "a[0] / b } c / d"),
        ("f(/{/, /}/)", "f(   ,    )"),
        ("{ g() }\n/{/.exec(s)", "{ g() }\n   .exec(s)"),
        ("x = { a: 1 } / 2 / 3", "x = { a: 1 } / 2 / 3"),
    ):
        assert blanked(text, "javascript") == want


def test_code_in_templates_is_code_to_any_depth():
    text = "s = `a } ${ f(`b { ${ g({ k: '}' }) } c`) } no(`;\nh(1);"
    got = blanked(text, "javascript")
    assert "f(" in got and "g({ k:" in got and "no(" not in got and "h(1);" in got and got.count("{") == got.count("}") == 1
    deep = "`" + "${`" * 200 + "x" + "`}" * 200 + "`;f()"
    assert blanked(deep, "javascript").endswith(";f()")


def test_texts_that_do_not_end():
    for lang, text in (("rust", "/* a /* b */ {"), ("rust", 'r##"a"# {'), ("go", "`abc {"), ("javascript", "`a ${ f("), ("javascript", "/* {"), ("rust", '"abc {'), ("javascript", "'abc\n{")):
        got = blanked(text, lang)
        assert len(got) == len(text) and (got.count("{") == 0 or lang == "javascript")


def test_type_arguments_of_calls():
    assert without_type_arguments("let v = xs.collect::<Vec<Option<T>>>();").replace(" ", "") == "letv=xs.collect();"
    assert without_type_arguments("make<Map<string, T[]>>(a)").split() == ["make", "(a)"]
    for text in ("if a > (b)", "f = (x) => (y)", "fn g() -> (A)", "a < b, c > (d)"):
        assert without_type_arguments(text).replace(" ", "") == text.replace(" ", "") or text.startswith("a <")


def generated(r, lang):
    """A file of functions that call one another, with everything that could be taken for code strewn in."""
    names = [f"fun{i}" for i in range(r.randrange(2, 7))]
    text, want, calls = "", [], []
    head = {"rust": "fn {}() {{", "go": "func {}() {{", "javascript": "function {}() {{"}[lang]
    for name in names:
        start = text.count("\n") + 1
        text += head.format(name) + "\n"
        for _ in range(r.randrange(5)):
            if r.random() < 0.4:
                callee = r.choice(names)
                generic = r.random() < 0.3
                text += "  " + callee + {"rust": "::<Vec<u8>>", "javascript": "<Array<T>>"}.get(lang, "") * generic + "();\n"
                calls.append((name, callee))
            else:
                text += "  x = " + r.choice([s for s in SILENT[lang] if not s.startswith("//")]) + ";\n"
            if r.random() < 0.3:
                text += "  // } " + name + "() {\n"
        if lang == "javascript" and r.random() < 0.5:
            callee = r.choice(names)
            text += "  y = `} ${" + callee + "()} {`; z = /[}/]{/.test(q);\n"
            calls += [(name, callee), (name, "test")]
        text += "}\n"
        want.append((name, start, text.count("\n")))
    return text, want, calls


@pytest.mark.parametrize("lang", sorted(CODE))
def test_generated_files(lang):
    r = random.Random(17)
    for _ in range(150):
        text, want, calls = generated(r, lang)
        out = parsing.parse_code("w", "f", text, lang)
        assert [(n[2], n[6], n[7]) for n in out.nodes if n[3] == "function"] == want, text
        ids = {n[0]: n[2] for n in out.nodes}
        got = [(ids[e[1]], e[2]) for e in out.edges if e[4] == "CALLS"]
        assert sorted(set(got)) == sorted(set(calls)), text


def test_each_kind_reads_its_own_files(spark, tmp_path):
    """Where all files are Go, those who look for YAML, JSON, shell, SQL, TOML or unknown files read none; a table of one file is parsed by all cores."""
    n = F.col("id").cast("string")
    spark.range(400).coalesce(1).select(F.lit("w").alias("workspace"), F.concat(n, F.lit(".go")).alias("file_path"), F.concat(F.lit("package p\n\nfunc f"), n, F.lit("() { g() }\n")).alias("content")).write.parquet(str(tmp_path / "f"))
    nodes, edges = parsing.parse(spark.read.parquet(str(tmp_path / "f")))
    assert len({p for p in edges.inputFiles() if "/code-" in p}) == spark.sparkContext.defaultParallelism
    _, rows, found = scanned(edges)
    assert sorted(r["target_label"] for r in found) == ["g"] * 400
    assert rows <= 400 + 3 * 800  # the paths, and three readings of 400 nodes and 400 edges
