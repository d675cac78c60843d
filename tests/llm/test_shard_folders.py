"""The table as folders of shards."""

import os
from collections import Counter

import pytest

from weftline.llm import op1_sharding


def test_folders_hold_every_row_once(spark, odd, empty, tmp_path):
    """Nulls, ties and repeated rows; every row in the folder that its key is assigned."""
    rows = odd.drop("shard")
    op1_sharding.write_shards(rows, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    text = lambda df: Counter((r["doc_id"], r["text"], r["lang"], r["size"]) for r in df.collect())
    assert text(back) == text(rows)
    want = op1_sharding.assign(rows.select("doc_id"), "doc_id").select("doc_id", "region", "rack", "shard")
    place = lambda df: {(r["doc_id"], int(r["region"]), int(r["rack"]), int(r["shard"])) for r in df.select("doc_id", "region", "rack", "shard").collect()}
    assert place(back) == place(want) and len({r[0] for r in place(back)}) == len(place(back))
    op1_sharding.write_shards(empty, f"{tmp_path}/none")
    assert not [d for d in os.listdir(f"{tmp_path}/none") if "=" in d]
    with pytest.raises(ValueError, match="shard"):
        op1_sharding.write_shards(odd, f"{tmp_path}/t")
