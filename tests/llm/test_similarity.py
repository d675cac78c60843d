"""The Jaccard join, NN-descent and components, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from weftline.llm import op6_nndescent, op9_partenum, shingles
from weftline.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def jaccard_components(data):
    sets = [shingle_set(t) for _, t in data]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union(len(sets), pairs)
    least = {}
    for (a, _), r in zip(data, root, strict=True):
        if a is not None:
            least[r] = min(least.get(r, a), a)
    return [(a, len(s), least.get(r) if s else a) for (a, _), s, r in zip(data, sets, root, strict=True)]


def test_join(spark, odd, odd_rows, small, empty):
    for df, data in ((odd, [r[:2] for r in odd_rows]), (small, [(r["doc_id"], r["text"]) for r in small.collect()])):
        got = op9_partenum.component_ids(df).collect()
        assert Counter(map(tuple, got)) == Counter(jaccard_components(data))
    assert op9_partenum.component_ids(empty).count() == 0


def test_chains_and_close_pairs(spark):
    """Copies with edits at and around the threshold, of all sizes, and chains that link only step by step."""
    rng, data = np.random.default_rng(3), []
    for size in (6, 7, 9, 12, 14, 20, 33, 60, 150, 400):
        base = [f"s{size}w{i}" for i in range(size)]
        for k in range(8):
            base = list(base)
            for i in rng.integers(0, size, max(1, size // 45)):
                base[i] = f"s{size}k{k}x{i}"
            data.append((len(data), " ".join(base)))
            data.append((len(data), " ".join(base[: size - k % 3])))
    got = op9_partenum.component_ids(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_components(data))


def one_of_each(data):
    """Brute force: the rows without words, and of each component the text of its smallest id (and text hash)."""
    import xxhash

    rank = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), seed=42) ^ (1 << 63))
    sets = [shingle_set(t) for _, t in data]
    root = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    best = {}
    for row, s, r in zip(data, sets, root, strict=True):
        if s:
            best[r] = min(best.get(r, row), row, key=rank)
    return Counter(best.values()) + Counter(row for row, s in zip(data, sets, strict=True) if not s)


def test_one_of_each(spark, odd, odd_rows, empty):
    kept = op9_partenum.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == one_of_each([r[:2] for r in odd_rows])
    assert op9_partenum.one_of_each(empty).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    """Unlike texts that share an id all stay; copies go, whatever ids they have."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "ABCDEF"}
    near = {k: text[k] + " z" for k in text}
    data = [(3, text["C"]), (5, text["C"]), (5, text["A"]), (5, text["B"]), (7, text["A"]), (9, near["B"]), (None, text["D"]), (None, text["D"]), (None, text["E"]), (None, near["E"]), (4, near["E"]), (None, text["F"]), (1, ""), (1, ""), (None, None)]
    for parts in (1, 4):
        got = op9_partenum.one_of_each(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == one_of_each(data)
    got = op9_partenum.component_ids(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(jaccard_components(data))


def test_many_rows_without_id_are_linear(spark):
    """10,000 rows without id, of 100 texts and their near copies: texts are fetched once a set."""
    from weftline import session

    base = [" ".join(f"d{d}w{i}" for i in range(30)) for d in range(100)]
    data = [(None, base[i % 100] + (" x" if i % 2 else "")) for i in range(10_000)]
    sizes, write = {}, session.materialize

    def counted(df, tag, *more):
        out = write(df, tag, *more)
        sizes[tag] = max(sizes.get(tag, 0), out.count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(op9_partenum, "materialize", counted)
        kept = op9_partenum.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(kept) == 100 and max(sizes.values()) <= 10_000


def test_pieces_of_long_texts(monkeypatch):
    """A text hashed in pieces has the shingles of the whole."""
    text = " ".join(f"w{i % 61}\t{'y' * (i % 9)}" for i in range(400)) + " " + "q" * 300 + "\nend"
    whole = shingles.shingle_sets([text, "a b", "", text + " more"])
    monkeypatch.setattr(shingles, "PIECE", 64)
    cut = shingles.shingle_sets([text, "a b", "", text + " more"])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and whole[1][0] == len(shingle_set(text))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.data())
def test_similar_sets_share_a_signature(size, data):
    """The pigeonhole holds: whenever the similarity is reached and the sets differ, a signature is shared."""
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    gone, new = data.draw(st.integers(0, max(0, size // 5))), data.draw(st.integers(0, max(0, size // 5)))
    b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
    shared = len(np.intersect1d(a, b))
    if len(b) == 0 or not shingles.linked(shared, len(a), len(b)) or (len(a) == len(b) == shared):
        return
    sig, of = op9_partenum.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 50, 900)]
    found, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    bits = op9_partenum.sketches(found, sizes)
    for i in range(3):
        for j in range(3):
            apart = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert apart <= len(np.setxor1d(sets[i], sets[j]))


def test_packing_round_trip():
    rng = np.random.default_rng(6)
    sig, node = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 40, 5000).astype(np.uint64)
    seen = Counter()
    for batch in op9_partenum._pack(sig, node, 7):
        for block in batch.column(1).to_pylist():
            s, n = op9_partenum._unpack(block)
            seen.update(zip(s.tolist(), n.tolist(), strict=True))
    assert seen == Counter(zip((sig & np.uint64((1 << 40) - 1)).tolist(), node.tolist(), strict=True))


def test_shingles_by_hand():
    texts = ["", "A b", "a B", "one two three four five six", "One two three four five", "x\x0by z", "a b c d e f a b c d e"]
    found, sizes = shingles.shingle_sets(texts)
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]
    ends = np.cumsum(sizes)
    part = [set(found[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)]
    assert part[1] == part[2] and part[4] < part[3]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 203), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[203] == 200 and len(got) == 46
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_answer(data):
    unit = []
    for _, v in data:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    n = len(data)
    pairs = [(i, j) for i in range(n) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    links, root, least = Counter(x for p in pairs for x in p), union(n, pairs), {}
    for (a, _), r in zip(data, root, strict=True):
        if a is not None:
            least[r] = min(least.get(r, a), a)
    return [(a, links[i], least.get(root[i]), a == least.get(root[i])) for i, (a, _) in enumerate(data)]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((150, 16))
    data = [(i, (centres[i % 150] + 0.08 * rng.standard_normal(16)).tolist()) for i in range(600)]
    data += [(1000 + i, centres[0].tolist()) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (5, centres[3].tolist()), (None, centres[4].tolist()), (2006, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("node"), F.lit(2).alias("label"))
    got = op6_nndescent.dedup_vectors(df).collect()
    want = Counter(vector_answer(data))
    true, found = sum(r[1] for r in want.elements()), sum(r["n_links"] for r in got)
    assert 0.9 * true <= found <= true  # recall of links; none below the threshold counts
    assert Counter(map(tuple, got)) == want
    odd = {r["vec_id"]: tuple(r)[1:] for r in got if r["vec_id"] is not None and r["vec_id"] >= 2000}
    assert odd[2000] == (0, 2000, True) and odd[2001] == (0, 2001, True) and odd[2004] == (1, 2004, True) and odd[2005] == (1, 2004, False)
    assert op6_nndescent.dedup_vectors(df.limit(0)).count() == 0


def test_full_lists_link_outward(spark):
    """Two groups of 12, cosine 0.96 within and 0.92 across: every list is full of links of its own group."""
    data = []
    for i in range(24):
        v = [0.0] * 27
        v[0], v[1 + i // 12], v[3 + i] = 0.92**0.5, 0.2, 0.2
        data.append((i, v))
    got = op6_nndescent.dedup_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(i, 23, 0, i == 0) for i in range(24)]


def test_components_of_many_cells(spark, monkeypatch):
    """Cells of 8 vectors: a dense group of 40 (all lists full of links), a chain of 30 that links its neighbours alone, both joined to a few others."""
    monkeypatch.setattr(op6_nndescent, "CELL", 8)
    monkeypatch.setattr(op6_nndescent, "CELL_NUMBERS", 8)
    rng, data = np.random.default_rng(11), []
    for i in range(40):
        v = np.zeros(12)
        v[0], v[1 + i % 9] = 1.0, 0.1 + 0.001 * i
        data.append((i, v.tolist()))
    for i in range(30):  # steps of 20 degrees in changing planes: cosine 0.94 to the next, 0.77 to the one behind it
        angle = np.radians(20) * i
        data.append((100 + i, [0.0] * 10 + [float(np.cos(angle)), float(np.sin(angle))] if i < 9 else (rng.standard_normal(12) * [0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0]).tolist()))
    data += [(300 + i, data[0][1]) for i in range(3)]
    got = op6_nndescent.dedup_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == Counter(vector_answer(data))


def test_trees_follow_depth():
    for total in (2_000, 10**5, 10**6, 10**7, 10**9):
        depth = max(1, op6_nndescent._depth(total))
        apart = 1 - (1 - np.arccos(op6_nndescent.THRESHOLD) / np.pi) ** depth
        assert 1 - apart ** op6_nndescent._trees(depth) >= op6_nndescent.RECALL


def test_audit_asks_until_it_sees_links(spark):
    """One linked pair among 3,000 vectors, in no component: the audit has to see it."""
    x = np.random.default_rng(8).standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[2999] = x[2998]
    nodes = spark.createDataFrame([(i, 1, 64, v.tobytes()) for i, v in enumerate(x)], "node long, copies long, dim int, vec binary")
    counted = lambda rows: spark.createDataFrame(rows, "node long, links long")
    ids = nodes.select(F.col("node").alias("vec_id"), "node")
    assert op6_nndescent.audit(nodes, counted([]), ids) == 0.0
    assert op6_nndescent.audit(nodes, counted([(2998, 1), (2999, 1)]), ids) == 1.0


def test_audit_asks_the_ids_that_twenty_divides(spark, monkeypatch):
    """All of them, in blocks, where there are more vectors than are asked whole; the others decide nothing."""
    monkeypatch.setattr(op6_nndescent, "ASKED", 10)
    monkeypatch.setattr(op6_nndescent, "SCAN", 3)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 32))
    x[1::2] = x[::2] + rng.standard_normal((200, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, 1, 32, v.tobytes()) for i, v in enumerate(x)], "node long, copies long, dim int, vec binary")
    ids = nodes.select(F.col("node").alias("vec_id"), "node")
    known = lambda some: spark.createDataFrame([(i, 1) for i in some], "node long, links long")
    assert op6_nndescent.audit(nodes, known(range(0, 400, 20)), ids) == 1.0
    assert op6_nndescent.audit(nodes, known(range(0, 400, 40)), ids) == 0.5
    assert op6_nndescent.audit(nodes, known(i for i in range(400) if i % 20), ids) == 0.0


def test_low_recall_is_not_accepted(spark, monkeypatch):
    """Then all vectors are compared with all, in blocks: chains, dense groups, copies, other lengths, vectors without a direction."""
    monkeypatch.setattr(op6_nndescent, "audit", lambda nodes, counted, ids: 0.5)
    monkeypatch.setattr(op6_nndescent, "FORESTS", 0)
    monkeypatch.setattr(op6_nndescent, "SCAN", 20)
    monkeypatch.setattr(op6_nndescent, "SLICE", 7)
    rng = np.random.default_rng(8)
    chain = [[float(np.cos(i * 0.4)), float(np.sin(i * 0.4)), 0.0] for i in range(7)]
    dense = [(np.array([0, 0, 1.0]) + rng.standard_normal(3) * 0.05).tolist() for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(chain + dense + rng.standard_normal((60, 3)).tolist() + dense[:5] + [[1.0, 2.0], [2.0, 4.1], [0.0, 0.0, 0.0], None])]
    got = {r["vec_id"]: tuple(r) for r in op6_nndescent.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and any(v)}
    near = {i: [j for j, w in good.items() if j != i and len(w) == len(v) and v @ w >= 0.9] for i, v in good.items()}
    least = {i: i for i, _ in rows}
    while True:
        after = {i: min([least[i], *(least[j] for j in near.get(i, []))]) for i in least}
        if after == least:
            break
        least = after
    assert got == {i: (i, len(near.get(i, [])), least[i], least[i] == i) for i, _ in rows}
