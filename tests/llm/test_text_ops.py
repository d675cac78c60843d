"""Licences, quality rules, line dedup and quotation linking."""

import random
import re
from collections import Counter

import duckdb

import corpus_pipeline
from pyspark.sql import functions as F
from weftline.llm import op5_licenses, op7_quality, op8_lines, op10_quotes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence_base(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = sorted((i, label) for p, label in op5_licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    return len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licences(spark, odd, odd_rows, small, empty):
    for df, data in ((odd, odd_rows), (small, [tuple(r) for r in small.collect()])):
        got = op5_licenses.license_documents(df).collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got) == Counter((r[0], *licence_base(r[1])) for r in data)
        for r in got:
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
            assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    own = {r["doc_id"]: r["labels"] for r in op5_licenses.license_documents(odd).collect()}
    assert own[14] == "cc-by,cc-by-nc,mit" and own[1] == ""
    assert op5_licenses.license_documents(empty).count() == 0


def test_every_notice_is_found(spark):
    data = [(i, "some words before\n" + text.upper() + " and behind") for i, (_, _, text) in enumerate(op5_licenses.NOTICES)]
    got = {r["doc_id"]: r["labels"].split(",") for r in op5_licenses.license_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(op5_licenses.NOTICES))


def test_every_notice_of_a_file_is_found(spark):
    """Several notices in one file, behind each other: rare words of one take no votes from another."""
    text = [t for _, _, t in op5_licenses.NOTICES]
    whole = {label: t for label, _, t in op5_licenses.NOTICES}
    rng, data = random.Random(9), []
    for _ in range(40):
        some = rng.sample(range(len(text)), rng.randint(2, 6))
        data.append((len(data), "\n".join(text[i] for i in some), {op5_licenses.NOTICES[i][0] for i in some}))
    data.append((len(data), "\n".join(text), set(whole)))
    data.append((len(data), "Copyright 2020 X. All rights reserved.\n" + whole["bsd"], {"all-rights-reserved", "bsd"}))
    data.append((len(data), "\n".join(whole[x] for x in ("apache-2.0", "mit", "mpl-2.0", "cc-by-nc")), {"apache-2.0", "mit", "mpl-2.0", "cc-by-nc"}))
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    got = {r["doc_id"]: {x["label"] for x in r["found"]} for r in op5_licenses.scan(docs, ["doc_id"]).collect()}
    assert all(want <= got[i] for i, _, want in data) and got[len(data) - 2] == data[-2][2]

    from weftline.llm.oracles import LICENCES

    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in data])
    done = con.execute(LICENCES)
    names = [x[0] for x in done.description]
    rows = op5_licenses.license_documents(docs).select(*names).collect()
    assert sorted((*r[:-1], round(r[-1], 9)) for r in map(tuple, rows)) == sorted((*r[:-1], round(r[-1], 9)) for r in done.fetchall())


def quality_base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count, covered, seen, dup = Counter(tri), set(), set(), 0
    for i, t in enumerate(tri):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality(spark, odd, odd_rows, small, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, data in ((odd, odd_rows), (small, [tuple(r) for r in small.collect()])):
        got = op7_quality.quality_documents(df).collect()
        assert Counter(tuple(r[c] for c in names) for r in got) == Counter((r[0], *quality_base(r[1])) for r in data)
        assert not any(r["kept"] and r["base_failed"] for r in got)
        kept = op7_quality.kept_documents(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert op7_quality.quality_documents(empty).count() == 0


def test_divergence_finds_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = op7_quality.quality_documents(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    rate = {r["quality"]: (r["kept"], r["n"]) for r in judged.groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert rate[1][0] == rate[1][1] and rate[0][0] <= 0.3 * rate[0][1]


def test_divergence_formula(spark):
    d = spark.range(1).select(op7_quality.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("a"), op7_quality.divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("b")).first()
    assert abs(d["a"] - 1) < 1e-12 and d["b"] == 0


def dedup_lines(data):
    """Brute force over (doc_id, text), repeated rows being one document."""
    docs = sorted(dict.fromkeys((a, t) for a, t in data), key=lambda x: (x[0] is None, x[0] or 0))
    first, gone = {}, {}
    for d in docs:
        own = [x.strip(" \t\n\x0b\x0c\r") for x in (d[1] or "").split("\n")]
        own = [x for x in own if x]
        gone[d] = set()
        for i in range(len(own) - 2):
            at = first.setdefault(tuple(own[i : i + 3]), (d, i))
            if at != (d, i):
                gone[d] |= {j for j in range(i, i + 3) if at[0] != d or j >= at[1] + 3}
    return gone


def test_lines(spark, odd, odd_rows, empty):
    data = [r for r in odd_rows if r[0] != 15]  # two texts of one id are ordered by their hashes
    got = op8_lines.dedup_lines(odd.where("doc_id is null or doc_id <> 15")).collect()
    gone = dedup_lines([(r[0], r[1]) for r in data])
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == Counter((r[0], len(gone[(r[0], r[1])])) for r in data)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[10].count("\n") == 4 and text[11] == "first" and text[12].count("\n") == 2 and text[4] is None and text[5] == ""
    assert op8_lines.dedup_lines(empty).count() == 0
    cleaned = op8_lines.clean(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.where("text is not null").collect())


def test_lines_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = Counter(con.execute(f"select doc_id, n_lines, n_removed, text from ({op8_lines.ORACLE_SQL})").fetchall())
    assert Counter(tuple(r) for r in op8_lines.dedup_lines(spark.read.parquet(path)).collect()) == want


def test_passages_on_one_or_two_lines(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two = words("a", 51), words("b", 30) + "\n" + words("c", 30)
    data = [
        (1, f"x\n{one}\ny\nz"), (2, f"p\nq\n  {one}\nr"), (3, f"s\n{two}\nt"), (4, f"u\nv\n{two}"), (5, one), (6, two), (7, "k\nshort"), (8, "k\nshort"), (9, "k\nshort\nmore"),
        (10, words("d", 50) + "\n1\n2"), (11, words("d", 50) + "\n3\n4"), (12, f"e\n{words('f', 60)}\ng\n{words('f', 60)}"), (13, None), (14, "same"), (15, "same"), (16, "same\nother"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op8_lines.clean(docs, passages=True).collect()}
    changed = {2: "p\nq\nr", 4: "u\nv", 5: "", 6: "", 8: "", 12: f"e\n{words('f', 60)}\ng", 15: ""}
    assert got == dict(data) | changed
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()} == got


TALK = "conv_id long, turn long, role string, text string"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\n\nSecond para here."), (1, 1, "assistant", "> Hello  there my FRIEND.\nHi!"), (1, 2, "user", "A new topic with words"),
        (1, 3, "assistant", ">> Hello there my friend.\n> Hi!\nGood\n> Second para here.\nok"), (1, 4, "user", "> a new topic\n> with words\nyes"), (1, 5, "user", "> never said\nhm"),
        (2, 0, "user", "> Hello there my friend.\nother conversation"), (2, 1, None, None), (None, None, None, "> x y z"), (2, 2, "user", ""), (2, 2, "user", ""),
    ]
    df = spark.createDataFrame(rows, TALK).select("*", F.lit(1).alias("position"), F.lit(2).alias("content"))
    got = op10_quotes.threads(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert {t: by[(1, t)]["parent_turn"] for t in range(6)} == {0: None, 1: 0, 2: None, 3: 1, 4: None, 5: None} | ({4: 2} if by[(1, 4)]["parent_turn"] == 2 else {})
    assert (by[(1, 3)]["root_turn"], by[(1, 3)]["depth"], by[(1, 3)]["max_level"]) == (0, 2, 2)
    assert by[(1, 3)]["content"] == "Good\nok" and by[(2, 0)]["parent_turn"] is None and by[(2, 1)]["content"] == ""
    assert sorted(r["position"] for r in got if r["conv_id"] == 2) == [0, 1, 2, 3]
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order[:3] == [0, 1, 3]
    text = {r["conv_id"]: r["text"] for r in op10_quotes.render(df).collect()}
    assert ">" not in "".join(text.values()) and text[1].startswith("user: Hello there")
    assert op10_quotes.threads(spark.createDataFrame([], TALK)).count() == 0


def test_wrapped_quote(spark):
    """A passage quoted over two lines is found as its words."""
    rows = [(1, 0, "u", "A new topic with words"), (1, 1, "a", "> a new topic\n> with words\nyes")]
    got = {r["turn"]: r["parent_turn"] for r in op10_quotes.threads(spark.createDataFrame(rows, TALK)).collect()}
    assert got == {0: None, 1: 0}


def test_whole_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = op10_quotes.threads(df).collect()
    want = Counter((r["conv_id"], r["turn"], r["role"], r["text"].strip(" \t\n\x0b\x0c\r")) for r in df.collect())
    assert Counter((r["conv_id"], r["turn"], r["role"], r["content"]) for r in got) == want


def test_random_threads_against_sql(spark):
    import random

    from weftline.llm.oracles import QUOTES

    rng, rows, words = random.Random(4), [], "alpha beta gamma delta eps zeta eta theta".split()
    for c in range(30):
        said = []
        for t in range(rng.randint(1, 9)):
            parts = []
            for _ in range(rng.randint(1, 4)):
                if said and rng.random() < 0.5:
                    lines = rng.choice(said).split("\n")
                    lines = lines if rng.random() < 0.6 else [rng.choice(lines)]
                    deep = "> " if rng.random() < 0.25 else ""
                    parts.append("\n".join(rng.choice(["> ", ">", " > "]) + deep + x.upper() for x in lines))
                else:
                    parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) + rng.choice(["", f"\n\n{rng.choice(words)} x y z"]))
            said.append("\n".join(x for x in "\n".join(parts).split("\n") if not x.strip().startswith(">")))
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(parts)))
    df = op10_quotes.threads(spark.createDataFrame(rows, TALK))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    done = con.execute(QUOTES)
    names = [x[0] for x in done.description]
    want = Counter(tuple(dict(zip(names, r, strict=True))[c] for c in df.columns) for r in done.fetchall())
    got = df.collect()
    assert Counter(map(tuple, got)) == want and sum(r["parent_turn"] is not None for r in got) > 20


def preorder(parent):
    """Turns of one conversation, replies behind what they answer, depth first."""
    out, kids = [], {}
    for t in sorted(parent):
        kids.setdefault(parent[t], []).append(t)
    stack = sorted(kids.get(None, []), reverse=True)
    while stack:
        t = stack.pop()
        out.append(t)
        stack += sorted(kids.get(t, []), reverse=True)
    return out


def test_replies_stand_behind_what_they_answer(spark):
    """Random trees, a long chain, and one root with many replies, depth first."""
    rng, rows, trees = random.Random(5), [], {}
    for c in range(6):
        n = (40, 40, 40, 70, 300, 1)[c]
        pick = {3: lambda t: t - 1, 4: lambda t: 0 if rng.random() < 0.9 else rng.randrange(t)}.get(c, lambda t: None if rng.random() < 0.15 else rng.randrange(t))
        trees[c] = {t: pick(t) if t else None for t in range(n)}
        for t, p in trees[c].items():
            rows.append((c if c else None, t, "u", (f"> says number {p} of {c}\n" if p is not None else "") + f"says number {t} of {c}"))
    rows += [(1, None, "u", "no turn")] * 3
    for parts in (1, 4):
        got = op10_quotes.threads(spark.createDataFrame(rows, TALK).repartition(parts)).collect()
        for c, tree in trees.items():
            own = sorted((r for r in got if r["conv_id"] == (c if c else None)), key=lambda r: r["position"])
            assert [r["position"] for r in own] == list(range(len(own))) and {r["turn"]: r["parent_turn"] for r in own if r["turn"] is not None} == tree
            assert [r["turn"] for r in own if r["turn"] is not None] == preorder(tree)
    assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])][-3:] == [None] * 3


def test_many_quoting_lines_are_linear(spark):
    """A message of 100,000 quoting lines, all different."""
    import time

    said = "\n".join(f"> line number {i} is quoted here" for i in range(100_000))
    began = time.time()
    got = op10_quotes.threads(spark.createDataFrame([(1, 0, "u", "line number 7 is quoted here"), (1, 1, "a", said)], TALK)).collect()
    assert {r["turn"]: r["parent_turn"] for r in got} == {0: None, 1: 0} and time.time() - began < 60


def test_runs(spark):
    rows = [(0, "a"), (1, "b"), (1, "c"), (1, ""), (1, "d"), (2, "e"), (1, "f"), (0, "g"), (1, "h")]
    df = spark.createDataFrame([([{"level": a, "line": b} for a, b in rows],), ([{"level": 1, "line": ""}],)], "x array<struct<level:int,line:string>>")
    got = df.select(op10_quotes._runs(F.col("x"), lambda x: F.lit(False)).alias("whole"), op10_quotes._runs(F.col("x"), lambda x: x["line"] == "").alias("cut")).collect()
    assert [tuple(r) for r in got[0]["whole"]] == [(0, "a"), (1, "b\nc\n\nd"), (2, "e"), (1, "f"), (0, "g"), (1, "h")]
    assert [tuple(r) for r in got[0]["cut"]] == [(0, "a"), (1, "b\nc"), (1, "d"), (2, "e"), (1, "f"), (0, "g"), (1, "h")]
    assert [tuple(r) for r in got[1]["whole"]] == [(1, "")] and got[1]["cut"] == []
