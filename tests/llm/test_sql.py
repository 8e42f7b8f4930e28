"""The corpus queries with SQL against DuckDB, row by row and order-insensitively."""

import duckdb
import pytest

pytest.importorskip("weirflow.llm")
from weirflow.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 0), (4, "one TWO", None, "a", 3), (5, "ONE two", "en", None, 3), (6, "a b c d e f a b c d e f\na b\n\na b", "en", "b", 7),
    (7, "x " * 3000, "en", "b", 6000), (8, " é ß end # & " * 30, "fr", "null", 20), (9, " ".join(f"w{i}" for i in range(80)), "fr", "c", 20), (10, " ".join(f"w{i}" for i in range(76)), "fr", "c", 20),
    (11, "x\x1cy\x85z \x0b\x0c\r end <|>", "fr", "c", 9),
]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def compare(spark, db, name, folder):
    df, r = QUERIES[name](spark, folder), db.execute(ORACLE[name])
    names, cols = [x[0] for x in r.description], sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(str([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert sorted(str([plain(row[c]) for c in cols]) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(spark, db, name, SF)


@pytest.mark.parametrize("rows", [ODD, []])
@pytest.mark.parametrize("name", ["op1_near_dedup", "op8_mixing", "op9_quality_rules"])
def test_oracle_on_awkward_rows(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(spark, db, name, str(tmp_path))
