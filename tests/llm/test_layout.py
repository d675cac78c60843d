"""Sharding, mixing, the content store and packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from weftline.llm import op1_sharding, op2_mixing, op3_store, op4_packing
from weftline.llm.tokens import Encoder
from weftline.session import scratch_path

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def library(path, end):
    tk = Tokenizer.from_file(path)
    return lambda text: np.array([*tk.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_shards(spark, odd, odd_rows, empty):
    got = op1_sharding.shard_documents(odd).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((a, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for a, t, *_ in odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert op1_sharding.shard_documents(empty).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (24, 25, 30):
        before = op1_sharding.assign(keys, "doc_id", op1_sharding.topology(n))
        after = op1_sharding.assign(before.withColumnRenamed("shard", "old"), "doc_id", op1_sharding.topology(n + 1))
        moved = after.where("shard <> old")
        share = moved.count() / 4000
        assert moved.where(f"shard <> {n}").count() == 0 and abs(share - 1 / (n + 1)) < 0.02
    # one rack gains weight: regions and racks whose weights stay trade no rows
    tree = op1_sharding.topology(24)
    racks = list(tree.children[0].children)
    racks[1] = op1_sharding.Node(racks[1].name, 8.0, racks[1].children)
    heavy = op1_sharding.subtree(0, [op1_sharding.subtree(0, racks), tree.children[1]])
    both = op1_sharding.assign(op1_sharding.assign(keys, "doc_id", tree).withColumnsRenamed({"region": "r0", "rack": "k0", "shard": "s0"}), "doc_id", heavy)
    assert both.where("region <> r0 and region <> 0").count() == 0
    assert both.where("region = r0 and rack <> k0 and rack <> 1").count() == 0
    assert both.where("rack = k0 and shard <> s0").count() == 0
    counts = {r["shard"]: r["count"] for r in op1_sharding.assign(keys, "doc_id", tree).groupBy("shard").count().collect()}
    assert len(counts) == 24 and max(counts.values()) < 1.35 * 4000 / 24


def water(sizes: dict, share=1.5, limit=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    pot, out, left = share * sum(sizes.values()), {}, set(names)
    while left:
        level = (pot - sum(out.values())) / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] >= limit * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in left}
        for s in over:
            out[s] = float(limit * sizes[s])
            left.discard(s)
    return out


def test_mix(spark, odd, odd_rows, small, empty):
    import re

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for df, data in ((odd, odd_rows), (small, [tuple(r) for r in small.collect()])):
        sizes, source = defaultdict(int), {}
        for a, t, _, s, _ in data:
            sizes[s] += words(t)
            source[(a, words(t))] = s
        goal = water(sizes)
        got = op2_mixing.mix_documents(df).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((a, words(t)) for a, t, *_ in data)
        taken, most = defaultdict(int), defaultdict(int)
        for r in got:
            s = source[(r["doc_id"], r["size"])]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
            assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
            taken[s] += r["taken"]
            most[s] = max(most[s], r["size"])
        assert all(abs(taken[s] - goal[s]) <= most[s] + 1 for s in sizes)  # the last document is drawn
        assert sorted(map(str, got)) == sorted(map(str, op2_mixing.mix_documents(df.repartition(3)).collect()))
        mixed = op2_mixing.mix(df)
        assert mixed.columns == df.columns
        assert sum(words(r["text"]) for r in mixed.collect()) == sum(taken.values())
    assert op2_mixing.mix_documents(empty).count() == 0 and op2_mixing.mix(empty).count() == 0


def test_pivotal_draws_keep_expectations(spark):
    """Over many sources alike but for their names: each document's mean of copies is its ratio, and each source keeps near its target."""
    sizes, sources = [1, 2, 3, 5, 8, 40], 900
    data = [(i, " ".join(["w"] * n), f"s{s:04d}") for s in range(sources) for i, n in enumerate(sizes)]
    got = op2_mixing.mix_documents(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    # by rank the sources weigh 3, 1, 2: targets 2, about 0.79 and 1.58 times their sizes, or what the sharing leaves
    copies = defaultdict(list)
    for r in got:
        copies[(round(r["target"] / r["source_size"], 6), r["doc_id"])].append(r["taken"] // r["size"])
    assert len({k for k, _ in copies}) == 3
    for (ratio, _), seen in copies.items():
        n, low = len(seen), int(ratio)
        p = ratio - low
        assert n == sources // 3 and set(seen) <= {low, low + 1}
        assert abs(sum(seen) / n - ratio) <= 4.5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_equal_rows_are_mixed_each_on_its_own(spark):
    """Rows that agree in all columns, however they are dealt: as many taken as the target says, and reruns agree."""
    rows = [(None, "a b c", "x")] * 600 + [(1, "d e", "y")] * 300 + [(2, "f", None)]
    want = None
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = Counter(map(str, op2_mixing.mix_documents(df).collect()))
        assert want is None or got == want
        want = got
        assert abs(op2_mixing.mix(df).where("source = 'y'").count() * 2 - op2_mixing.mix_documents(df).where("source = 'y'").first()["target"]) <= 2


FRAGMENTS = st.one_of(st.text(alphabet="ab .,\n\t'é1日\x01 |#<>", max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", " <|endoftext|>", "<|endoftext|> ", "\n", "  "]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(FRAGMENTS, max_size=6).map("".join), max_size=6))
def test_cached_encoding_is_the_library(texts):
    for path, spaced in ((WORD, True), (BYTE, False)):
        enc, lib = Encoder(path, spaced, cache=5), library(path, 0)
        assert [x.tolist() for x in enc.encode(texts)] == [lib(t)[:-1].tolist() for t in texts]


def test_special_strings_as_text():
    tk = Tokenizer.from_file(BYTE)
    tk.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>"
    assert Encoder(BYTE, False, ordinary=True).encode([text])[0].tolist() == tk.encode(text, add_special_tokens=False).ids
    assert Encoder(BYTE, False).encode([text])[0].tolist() == library(BYTE, 0)(text)[:-1].tolist() and 50256 in Encoder(BYTE, False).encode([text])[0]


def test_store(spark, odd, odd_rows, empty):
    lib = library(WORD, 2)
    data = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, len(lib(r[1]))))
    got = sorted(op3_store.store_documents(odd, WORD).collect(), key=lambda r: r["start"])
    start = 0
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((a, len(lib(t)), zlib.crc32(lib(t).tobytes())) for a, t, *_ in data)
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    assert op3_store.store_documents(empty, WORD).count() == 0


def test_store_round_trip_and_damage(spark, odd, odd_rows):
    store = op3_store.write_store(odd, scratch_path(spark, "store"), WORD)
    lib = library(WORD, 2)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in store.reconstruct().collect()) == Counter((a, tuple(lib(t).tolist())) for a, t, *_ in odd_rows)
    assert store.chunks().groupBy("hash").count().where("count > 1").count() == 0
    store.check_manifests()


def _damaged(spark, store, folder, change):
    """A store of which the files of one folder are written again, changed."""
    import shutil

    path = store.path.removeprefix("file:").replace("//", "/")
    copy = path + "-damaged"
    shutil.rmtree(copy, ignore_errors=True)
    shutil.copytree(path, copy)
    shutil.rmtree(f"{copy}/{folder}")
    change(spark.read.parquet(f"file://{path}/{folder}")).write.parquet(f"file://{copy}/{folder}")
    return op3_store.Store(spark, "file://" + copy)


def test_damage_is_seen(spark, odd):
    """Chunk lists, counts and roots that were changed after encoding, lost or repeated rows, and changed chunks."""
    store = op3_store.write_store(odd, scratch_path(spark, "store"), WORD)
    other = store.chunks().select("hash").first()[0]
    own = F.col("doc_id") == 7
    swapped = F.concat(F.expr("substring(chunks, 17, 16)"), F.expr("substring(chunks, 1, 16)"), F.expr("substring(chunks, 33)"))
    assert store.recipes().where(own).where(swapped != F.col("chunks")).count() == 1
    for change in (
        lambda df: df.withColumn("chunks", F.when(own, swapped).otherwise(F.col("chunks"))),
        lambda df: df.withColumn("chunks", F.when(own, F.lit(bytes(other))).otherwise(F.col("chunks"))),
        lambda df: df.withColumn("n_tokens", F.col("n_tokens") + F.when(own, 1).otherwise(0)),
        lambda df: df.withColumn("root", F.when(own, F.lit(b"0" * 16)).otherwise(F.col("root"))),
        lambda df: df.where(~F.coalesce(own, F.lit(False))),
        lambda df: df.unionByName(df.where(own)),
        lambda df: df.where("ord is not null"),
    ):
        with pytest.raises(ValueError, match="differ"):
            _damaged(spark, store, "recipes", change).check_manifests()
    raw = op3_store.pack_ids(np.array([1, 2, 3], "<u4"))
    bad = _damaged(spark, store, "blocks/kind=chunk", lambda df: df.withColumn("body", F.when(F.col("key") == F.lit(bytes(other)), F.lit(raw)).otherwise(F.col("body"))))
    bad.check_manifests()
    with pytest.raises(Exception, match="does not hold what its name says"):
        bad.documents().collect()
    lost = _damaged(spark, store, "blocks/kind=chunk", lambda df: df.where(F.col("key") != F.lit(bytes(other))))
    with pytest.raises(Exception, match="chunks are missing"):
        lost.documents().collect()


def test_many_equal_rows_are_dealt(spark):
    """Equal rows don't share a key of the shuffle and are split over recipe files."""
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text")).repartition(3)
    store = op3_store.write_store(df, scratch_path(spark, "store"), WORD)
    store.check_manifests()
    got = store.documents().collect()
    assert len(got) == 2000 and sorted(r["start"] for r in got) == [i * got[0]["n_tokens"] for i in range(2000)]
    assert store.manifests().count() > 1 and store.chunks().count() == 1


def test_checksums_and_cuts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49408, 20_000).astype("<u4")
    ends = op3_store.cuts(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= op3_store.MOST for a, b in zip([0, *ends], ends, strict=False))
    parts = [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
    assert op3_store.crc_join([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(ids.tobytes())
    moved = op3_store.cuts(np.concatenate([ids[:777], ids]))
    assert len({e - 777 for e in moved} & set(ends)) >= len(ends) - 3  # cuts find their places again
    for n in range(9):
        leaves, tree = [bytes([i]) * 16 for i in range(n)], op3_store.MerkleStream()
        for x in leaves:
            tree.add(x)
        assert tree.root() == op3_store.merkle(leaves)
    assert op3_store.unpack_ids(op3_store.pack_ids(np.array([1, 70_000], "<u4"))).tolist() == [1, 70_000]


def test_pack(spark, odd, odd_rows, empty):
    lib = library(BYTE, 0)
    got = op4_packing.pack_documents(odd, BYTE).collect()
    want = Counter()
    for a, t, *_ in odd_rows:
        ids = lib(t)
        stop, start, k = len(ids) % 2048 or 2048, 0, 0
        while start < len(ids):
            want[(a, k, start, min(stop, len(ids)) - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start, stop, k = min(stop, len(ids)), stop + 2048, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert op4_packing.pack_documents(empty, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan_is_best_fit(histogram):
    spaces = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = [i for i, s in enumerate(spaces) if s >= n]
        if fit:
            spaces[min(fit, key=lambda i: spaces[i])] -= n
        else:
            spaces.append(32 - n)
    used = defaultdict(int)
    ranks = Counter()
    for length, rank, count, per, first, at in op4_packing.plan(histogram, 32):
        assert rank == ranks[length]
        ranks[length] += count
        for i in range(count):
            assert used[first + i // per] == at + i % per * length
            used[first + i // per] += length
    assert ranks == Counter(histogram) and len(used) == len(spaces) and all(v <= 32 for v in used.values())


def test_sequences(spark, small):
    lib = library(BYTE, 0)
    few = small.limit(30)
    ids = sorted(x for r in few.collect() for x in lib(r["text"]).tolist())
    got = op4_packing.sequences(few, BYTE).collect()
    assert sorted(x for r in got for x in r["ids"]) == ids and all(len(r["ids"]) <= 2048 for r in got)


def test_sequences_of_repeated_ids(spark, odd, odd_rows):
    """Unlike texts under one id, null ids and equal rows: each piece has its own text's ids."""
    lib = library(BYTE, 0)
    got = op4_packing.sequences(odd, BYTE).collect()
    assert sorted(x for r in got for x in r["ids"]) == sorted(x for _, t, *_ in odd_rows for x in lib(t).tolist())
    # texts of one piece each stand whole, up to their end ids
    short = [lib(t).tolist() for _, t, *_ in odd_rows if len(lib(t)) <= 2048]
    packed = Counter()
    for r in op4_packing.sequences(odd.where("doc_id is null or doc_id <> 7"), BYTE).collect():
        ids = list(r["ids"])
        while ids:
            end = ids.index(0) + 1
            packed[tuple(ids[:end])] += 1
            ids = ids[end:]
    assert packed == Counter(map(tuple, short)) and all(0 not in t[:-1] for t in packed)
    assert op4_packing.sequences(odd.limit(0), BYTE).count() == 0


def test_a_small_store_is_few_files_at_any_width(spark, odd):
    """Files of blocks are as many as the data asks, however many partitions a shuffle has."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        store = op3_store.write_store(odd, scratch_path(spark, "store"), WORD)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    store.check_manifests()
    blocks = spark.read.parquet(f"{store.path}/blocks").inputFiles()
    assert 2 <= len(blocks) <= 2 * spark.sparkContext.defaultParallelism
