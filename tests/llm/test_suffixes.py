"""Suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import op12_suffixes as sa
from weftline.llm import queries

SF = "/root/testdata/sf0.001"


def test_order_and_common_prefixes():
    """Random, repetitive and zero bytes: the order of the first SPAN bytes, and how many neighbours share."""
    r = random.Random(12)
    for _ in range(600):
        letters = r.choice([1, 2, 4, 256])
        x = bytes(r.randrange(letters) for _ in range(r.randrange(400)))
        if x and r.random() < 0.5:
            x = (x[: r.randrange(1, 60)] * 20)[: len(x)]
        text = np.frombuffer(x, np.uint8)
        order = sa.suffix_array(text)
        assert sorted(order.tolist()) == list(range(len(x)))
        heads = [(x + bytes(sa.SPAN))[i : i + sa.SPAN] for i in order.tolist()]
        assert heads == sorted(heads)
        if x:
            shared = [next((k for k in range(sa.SPAN) if a[k] != b[k]), sa.SPAN) for a, b in zip(heads, heads[1:], strict=False)]
            assert sa.common_prefixes(text, order).tolist() == shared


def test_smaller_than_successor():
    for x in (b"banana", b"aab", b"baa", b"aaaa", b"\x00\x00\x01"):
        want = [x[i:] < x[i + 1 :] for i in range(len(x))]
        assert sa.smaller_than_successor(np.frombuffer(x, np.uint8)).tolist() == want


def test_segments_cover_every_window():
    """Each window of a document is in one segment, whatever the chunk, and equal windows have equal anchors."""
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab ") for _ in range(n)) for n in (0, 49, 50, 51, 700, 300)]
    texts.append(texts[4][100:400])
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    found = sa.segments(data, sizes)
    windows, anchors = [], {}
    for anchor, first, last, doc in zip(*found, strict=True):
        for i in range(first, last + 1):
            windows.append((doc, i))
            assert anchors.setdefault(data[i : i + sa.SPAN].tobytes(), anchor) == anchor
    starts = np.cumsum(sizes) - sizes
    assert windows == [(d, s + i) for d, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)) for i in range(n - sa.SPAN + 1)]


def brute(rows):
    key = lambda i: sa.LAST if i is None else i
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            w = b[a : a + 50]
            first[w] = min(first.get(w, sa.LAST), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone, end = [False] * len(b), 0
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < key(i):
                gone[max(a, end) : a + 50] = [True] * (a + 50 - max(a, end))
                end = a + 50
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_two_stage_suffixes(spark):
    got = queries.op12_two_stage_suffixes(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    assert Counter(map(tuple, got.collect())) == want and sum(r[2] > 0 for r in want) > 20


def passages():
    """Matches of 49 to 51 bytes, over pieces of characters, of runs, within one document, between equal ids, and in copies."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    base = word(400)
    rows = [(10, base), (11, word(30) + base[100:149] + word(30)), (12, word(30) + base[100:150] + word(30)), (13, base[:60] + "x" + base[60:120] + "y" + base[90:200])]
    rows += [(14, "é" * 60), (15, "ü" + "é" * 40), (16, "a" * 300), (17, "b" + "a" * 120 + "c"), (18, word(80) * 3), (9, base[200:270])]
    rows += [(19, base), (19, base), (20, word(10) + base[5:90]), (20, base[5:90] + word(10)), (None, base[:80]), (None, "only here " * 9), (21, "only here " * 8), (22, None), (23, "")]
    rows += [(100 + i, word(20) + base[300:380] + word(20)) for i in range(40)] + [(200 + i, base[10:160]) for i in range(20)]
    return rows


@pytest.mark.parametrize(("pack", "hot"), [(sa.PACK, sa.HOT), (700, 3), (100, 0)])
def test_passages(spark, pack, hot):
    """One pack and many; anchors as they are, the frequent ones taken apart, all taken apart."""
    rows = passages()
    got = sa.suffix_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), pack, hot)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_spans_and_kept(spark):
    """The operator's own output."""
    base = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, base), (2, "start " + base[10:100] + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sa.deduplicate(df).collect()}
    assert bytes(got[2]["kept"]) == b"start  end" and [tuple(s) for s in got[2]["spans"]] == [(6, 96)]
    assert bytes(got[1]["kept"]).decode() == base and got[1]["spans"] == []


def test_odd_rows(spark, odd, empty, odd_rows):
    """Nulls, empty and very long texts, ties, repeated rows, other columns of clashing names, no rows."""
    extra = odd.withColumns({c: odd["size"] for c in ("pack", "plain", "hot", "number", "first", "kept")})
    assert Counter(map(tuple, sa.suffix_documents(extra).collect())) == brute([r[:2] for r in odd_rows])
    assert sa.suffix_documents(empty).count() == 0
    short = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in sa.suffix_documents(short).collect()) == [(1, 5, 0), (2, 0, 0)]


def test_only_segments_with_a_common_anchor_are_sorted(monkeypatch):
    """A text of which there are copies alone is its own class; the others are sorted, with one result."""
    r = random.Random(5)
    base, lone = bytes(r.choices(b"abcd", k=70)), bytes(r.choices(b"abcd", k=64))
    texts, least = [base, lone, b"x" + base[:60], base[8:66]], np.array([7, 5, 3, 9])
    want = [x.tolist() for x in sa.equal_windows(texts, least)]
    sorted_, own = [], sa.equal_windows
    monkeypatch.setattr(sa, "equal_windows", lambda t, k: sorted_.append(t) or own(t, k))
    got = sa.windows_by_kin(texts, least, np.array([4, 2, 4, 4], np.uint32))
    assert [x.tolist() for x in got] == want and sorted_ == [[texts[0], texts[2], texts[3]]]
    assert [x.tolist() for x in sa.windows_by_kin([lone], np.array([5]), np.array([2], np.uint32))] == [[0], [0], [14], [5]] and len(sorted_) == 1


def test_an_anchor_is_taken_apart_by_its_segments():
    """Not by its packs, which grow with the table: 40 packs of one segment stay whole, two of 30 don't."""
    rows = [(i, [1]) for i in range(40)] + [(40, [2, 3]), (41, [2, 3])]
    count = {1: 1, 2: 30, 3: 1}
    seen = [np.array([count[h] << 1 for h in hashes], np.uint16).tobytes() for _, hashes in rows]
    asked = pa.table({"pack": [p for p, _ in rows], "hashes": [np.array(h, np.uint64).tobytes() for _, h in rows], "seen": seen})
    got = {x["pack"]: (np.frombuffer(x["plain"], np.uint64).tolist(), np.frombuffer(x["hot"], np.uint64).tolist()) for x in sa._shared(50)(asked).to_pylist()}
    assert [p for p, x in got.items() if x == ([1], [])] == list(range(40)) and got[40] == got[41] == ([3], [2])
    assert not sa._shared(50)(pa.table({"pack": [1], "hashes": [np.array([9], np.uint64).tobytes()], "seen": [np.array([99 << 1], np.uint16).tobytes()]})).num_rows
