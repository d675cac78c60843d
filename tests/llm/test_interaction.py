"""The filter audit against brute force; its SQL is held against the query in test_registered."""

import re
from collections import Counter
from itertools import permutations

import pytest

from weftline.llm import op13_interaction as audit


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    known = {}
    for i, q, t in labels:
        if i is not None:
            known[i] = (known.get(i, (0, 0))[0] or q == 1, known.get(i, (0, 0))[1] or t == 1)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = t in least and (i is None or i > least[t])
        docs.append((s or "", fails, *known.get(i, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                fails = [d for d in own if d[1][f]]
                out[part, order, k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(sum(d[1].values()) == 1 for d in fails), sum(bool(d[2]) for d in gone), sum(bool(d[3]) for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(audit.ORDERS):
            assert table[mask, k] == next((s for s, f in enumerate(order) if mask >> f & 1), 5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, 1, None), (3, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (14, 0, 0), (20, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd, empty, odd_rows, labels):
    """Nulls, ties, repeated rows and labels, other columns of clashing names, no rows."""
    extra = odd.withColumns({c: odd["size"] for c in ("part", "mask", "label", "digest", "order", "removed", "low")})
    more = labels.withColumn("mask", labels["quality"]).withColumn("_id", labels["toxic"])
    got = audit.audit(extra, more)
    assert found(got) == brute([(a, b, d) for a, b, _, d, _ in odd_rows], labels.collect())
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert audit.audit(empty, labels).count() == 0
    none = audit.audit(odd, labels.limit(0))
    assert found(none) == brute([(a, b, d) for a, b, _, d, _ in odd_rows], [])


def test_copies_and_many_parts(spark, labels):
    """A text that most rows share, null ids among them, over more parts than a task holds at once."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i if i % 7 else None, same if i % 3 else f"{same} {i} #", f"part{i % (audit.PARTS * 2)}") for i in range(600)]
    rows += [(None, "nameless", "n"), (None, "nameless", "n"), (5, same, "part0"), (5, same, "part1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert found(audit.audit(docs, labels)) == brute(rows, labels.collect())
