"""Columns that bear an operator's names, and null or empty lists of sources."""

from weirflow.llm.mixing import mix
from weirflow.llm.sharding import shard_rows


def test_mixing_with_clashing_names_and_lists_of_sources(spark):
    rows = [(i, "a b c", [None, ["x"], [], ["y", "x"]][i % 4], 100 + i) for i in range(40)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>, size long"), keep=["size"]).collect()
    assert len(got) == 40 and all(r.size == 3 and r.size_in == 100 + r.doc_id for r in got)
    # the two lists give all they can, twice their words; the null source gives its target of 22
    assert sum(r.taken for r in got if r.doc_id % 2) == 120 and sum(r.taken for r in got) == 142


def test_sharding_with_clashing_names(spark):
    got = shard_rows(spark.createDataFrame([(i, "t", i) for i in range(33)], "doc_id long, text string, shard long"), shards=4, keep=["shard"]).collect()
    assert sorted(r.shard_in for r in got) == list(range(33)) and {r.shard for r in got} == {0, 1, 2, 3}
