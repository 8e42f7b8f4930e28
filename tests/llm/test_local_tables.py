"""The driver's small tables reach mixing and sharding without Python workers."""

from weirflow.llm.mixing import mix
from weirflow.llm.sharding import shard_rows
from weirflow.storage import local_table


def test_plans_of_mixing_and_sharding_run_no_python(spark):
    docs = spark.createDataFrame([(i, "a b " * (i % 5), "xyz"[i % 3] if i % 4 else None) for i in range(40)], "doc_id long, text string, source string").select("doc_id", "text", "source")
    path = docs._jdf.queryExecution().analyzed().toString().count("LogicalRDD")
    assert path == 1  # the test's own rows
    for got in (mix(docs), shard_rows(docs)):
        assert "LogicalRDD" not in got._jdf.queryExecution().analyzed().toString()
        assert got.count() == 40


def test_local_tables_keep_nulls_and_types(spark):
    rows = [([None, "a"], 1, 0.5), ([], 2**62, None), (None, None, -1.0)]
    got = local_table(spark, rows, "p array<string>, n long, x double")
    assert got.dtypes == [("p", "array<string>"), ("n", "bigint"), ("x", "double")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(rows, key=str)
