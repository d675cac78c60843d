"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import op11_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(x):
    """Every maximal stretch of each period, the smallest period of a stretch."""
    out = {}
    for q in range(1, len(x) // 3 + 1):
        j = 0
        while j < len(x) - q:
            k = j
            while k < len(x) - q and x[k] == x[k + q]:
                k += 1
            if k - j + q >= max(24, 3 * q):
                out.setdefault((j, k - j + q), q)
            j = k + 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def sequence(r):
    """Noise, repeated stretches, powers of words within powers, Fibonacci words, near repeats."""
    letters, n, kind = r.choice([1, 2, 3, 5, 50]), r.randrange(260), r.randrange(6)
    noise = lambda n: [r.randrange(letters) for _ in range(n)]
    x = []
    if kind == 0:
        x = noise(n)
    elif kind == 1:
        while len(x) < n:
            x += (noise(r.randrange(1, 30)) * r.randrange(1, 9))[: r.randrange(1, 300)]
    elif kind == 2:
        while len(x) < n:
            x += [0] * r.randrange(1, 60) + [r.randrange(2)]
    elif kind == 3:
        x = (([0] * r.randrange(1, 40) + [1] + [0] * r.randrange(40) + [1] * r.randrange(2)) * 8)[:n]
        if x and r.random() < 0.6:
            x[r.randrange(len(x))] = r.randrange(3)
    elif kind == 4:
        x = ((noise(r.randrange(1, 12)) * r.randrange(1, 5) + [9]) * r.randrange(1, 9))[r.randrange(5) :]
        x = x + noise(10) + x
    else:
        a, x = [0], [0, 1]
        while len(x) < n:
            a, x = x, x + a
        x = x[:n] * 2
    return x


def test_runs_of_random_sequences():
    r, found = random.Random(11), 0
    for _ in range(1500):
        x = sequence(r)
        want = brute_runs(x)
        found += len(want)
        assert op11_runs.find_runs(np.array(x, np.int64)) == want
    assert found > 3000


@pytest.mark.parametrize("x", [np.zeros(200_000), np.tile(np.r_[np.zeros(999), 1], 200), np.concatenate([np.r_[np.zeros(900 + k % 211), 1] for k in range(200)])])
def test_long_repetitive_texts(x):
    """Near to linear also where every block recurs everywhere."""
    runs = op11_runs.find_runs(x.astype(np.int64))
    assert runs and all((x[s : s + m - q] == x[s + q : s + m]).all() and (s == 0 or x[s - 1] != x[s - 1 + q]) and (s + m == len(x) or x[s + m] != x[s + m - q]) for s, m, q in runs)


def digest(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and ws:
        n, g = len(ws), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = brute_runs(ws)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_block_runs(spark):
    """The query on a whole table; about a tenth of it holds planted runs."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_block_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [digest(*r) for r in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(w[1] > 0 for w in want) > len(rows) / 20


def test_odd_rows(spark, odd, empty, odd_rows):
    """Nulls, empty and very long texts, ties, repeated rows, other columns of clashing names, no rows."""
    extra = odd.withColumns({c: odd["size"] for c in ("runs", "collapsed", "best", "start", "h")})
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = [tuple(r) for r in op11_runs.run_documents(extra).collect()]
    brief = {r[0] for r in odd_rows if len(r[1] or "") < 100_000}
    short = [r for r in got if r[0] in brief]
    assert len(got) == len(odd_rows) and sorted(short, key=key) == sorted((digest(a, t) for a, t, *_ in odd_rows if a in brief), key=key)
    assert op11_runs.run_documents(empty).count() == 0


def test_scan_keeps_columns(spark):
    """The operator's own output: runs and the collapsed text beside any columns."""
    text = "start " + "la di da " * 20 + "end"
    df = spark.createDataFrame([(1, text, "x"), (2, "one\x0btwo\nthree", None), (3, None, "z")], "doc_id long, text string, `odd name` string")
    got = {r["doc_id"]: r for r in op11_runs.scan(df, ["odd name", "doc_id"]).collect()}
    assert got[1]["collapsed"] == "start la di da end" and [tuple(x) for x in got[1]["runs"]] == [(1, 60, 3)] and got[1]["odd name"] == "x"
    assert got[2]["collapsed"] == "one two three" and got[2]["runs"] == [] and got[3]["collapsed"] == ""
