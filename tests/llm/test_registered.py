"""The registered queries against their SQL, and the pipeline's stages."""

import datetime
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from test_layout import BYTE, library, water
from test_similarity import one_of_each
from test_text_ops import quality_base

import corpus_pipeline
from weftline.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    done = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in done.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in done.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_all_operators_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.queries()}) == list(range(1, 14))


def signed_hash(text):
    """Spark's xxhash64 of one string."""
    return ((xxhash.xxh64_intdigest(text.encode(), seed=42) + (1 << 63)) % (1 << 64)) - (1 << 63) if text is not None else 42


def kept_by_rules(rows, enough):
    """Rows that pass the rules; where no language has ``enough`` documents for a reference the base rules alone decide."""
    if not enough:
        return [r for r in rows if not quality_base(r[1])[-1]]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    done = con.execute(queries.oracle_sql()["op7_divergence_rules"])
    names = [x[0] for x in done.description]
    good = {d["doc_id"] for r in done.fetchall() if (d := dict(zip(names, r, strict=True)))["kept"]}
    return [r for r in rows if r[0] in good]


def without_repeats(rows):
    """Windows of three filled lines, passages of over 50 words on one or two, and whole texts of fewer than three: later ones go."""
    docs = sorted({r[:2] for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, signed_hash(x[1])))
    filled = {d: [(i, y) for i, x in enumerate((d[1] or "").split("\n")) if (y := x.strip(" \t\n\x0b\x0c\r"))] for d in docs}
    first, gone = {}, {d: set() for d in docs}
    for d in docs:
        own = [y for _, y in filled[d]]
        for n in (1, 2, 3):
            for i in range(len(own) - n + 1):
                span = tuple(own[i : i + n])
                long = sum(len(re.findall(r"[^\x20\x09-\x0D]+", y)) for y in span) > 50
                kind = "window" if n == 3 else "passage" if long else "text" if len(own) == n else None
                if kind:
                    at = first.setdefault((kind, span), (d, i))
                    if at != (d, i):
                        gone[d] |= {j for j in range(i, i + n) if at[0] != d or j >= at[1] + n}
    out = []
    for a, t, *rest, n_chars in rows:
        d = (a, t)
        if gone[d]:
            lost = {filled[d][j][0] for j in gone[d]}
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
            n_chars = len(t)
        out.append((a, t, *rest, n_chars))
    return out


def check_mix(before, after):
    """Rows stand 0 to 2 times more often than before; each source's words are near its target, by less than one document."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    had, has = Counter(before), Counter(after)
    assert set(has) <= set(had) and all(n <= 2 * had[r] for r, n in has.items())
    sizes = {s: sum(words(r[1]) for r in before if r[3] == s) for s in {r[3] for r in before}}
    goal = water({s: n for s, n in sizes.items()}) if sizes else {}
    for s in sizes:
        most = max(words(r[1]) for r in before if r[3] == s)
        assert abs(sum(words(r[1]) for r in after if r[3] == s) - goal[s]) <= most + 1
    assert all(words(r[1]) for r in after)


def check_packing(rows, places):
    """Every document's pieces once, in gapless sequences, as many as best fit takes."""
    lib, want = library(BYTE, 0), Counter()
    for a, t, *_ in rows:
        ids = lib(t)
        stop, start, k = len(ids) % 2048 or 2048, 0, 0
        while start < len(ids):
            want[(a, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start, stop, k = stop, stop + 2048, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in places) == want
    used, spaces = defaultdict(list), []
    for r in places:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    for n in sorted((key[3] for key in want.elements()), reverse=True):
        at = min((i for i, s in enumerate(spaces) if s >= n), key=lambda i: spaces[i], default=None)
        if at is None:
            spaces.append(2048 - n)
        else:
            spaces[at] -= n
    assert len(used) == len(spaces)


def test_pipeline_against_brute_force(spark, small, odd):
    """Every stage on what the one before it gave, nulls and repeated rows among it."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    near = " ".join(f"gamma{i}" for i in range(80))
    more = [(7000, near, "en", "m", 1), (7000, near + " x", "en", "m", 2), (None, near, None, "m", 3), (None, near, None, "m", 3), (7001, near + "\n" + near.upper() + " y z", "en", None, 4), (7001, "\n".join(f"some words of line {i} " + near[: 40 + i] for i in range(9)), "en", None, 5), (7002, "top\n" + "\n".join(f"some words of line {i} " + near[: 40 + i] for i in range(9)), "en", "q", 6)]
    for docs, enough in ((small, True), (odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, small.schema)), False)):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        df = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, SF).collect(), docs.schema)
            assert df.columns == docs.columns
            got = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
            if name == "quality":
                assert Counter(got) == Counter(kept_by_rules(rows, enough))
            elif name == "lines":
                assert Counter(got) == Counter(without_repeats(rows))
            elif name == "near_duplicates":
                assert Counter(r[:2] for r in got) == one_of_each([r[:2] for r in rows]) and not Counter(got) - Counter(rows)
            else:
                check_mix(rows, got)
            assert got
            rows = got
        check_packing(rows, corpus_pipeline.packing(spark, df, SF).collect())


def test_pipeline(spark, odd, empty):
    """Reruns agree, run() applies the stages, and other columns, even of clashing names, and empty tables pass through."""
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), kept.schema)
    out = key(corpus_pipeline.run(spark, SF))
    assert out == key(corpus_pipeline.run(spark, SF)) == key(corpus_pipeline.packing(spark, kept, SF)) and out
    df, marks = odd, odd.select("_n", "bucket").distinct().collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == odd.columns and df.select("_n", "bucket").distinct().collect() == marks
    assert corpus_pipeline.packing(spark, df, SF).count() >= df.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
