"""Quality posteriors, revisits and the pipeline against plain Python."""

import math

import pytest

from weirflow.llm import quality_bayes, revisits
from weirflow.llm.quality_bayes import CAPITALS, DIGITS, FEATURES, SYMBOLS


def plain_measures(t):
    t = t or ""
    n = max(len(t), 1)
    share = lambda chars: sum(c in chars for c in t) / n
    return {"symbols": share(SYMBOLS), "bars": share("|"), "shouts": share("!"), "capitals": share(CAPITALS), "digits": share(DIGITS), "word_length": min(n / (t.count(" ") + 1), 20.0) / 20, "lines": share("\n") * 10, "length": math.log1p(n) / 10}


def test_measures_equal_plain_counts(spark):
    texts = [None, "", "Ab1 #*$ | !\n<é|ÄÖ 文字>", "x" * 5000, "A#0" * 40, "   \n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", *[v.alias(k) for k, v in quality_bayes.measures(df["text"]).items()]).collect()
    for r in got:
        want = plain_measures(texts[r.i])
        assert all(abs(r[k] - want[k]) < 1e-12 for k in FEATURES)


def test_posteriors_keep_rows_and_follow_labels(spark):
    rows = [(i, ("plain words in a calm sentence " * 4) if i % 2 else "$$$ BUY!!! ### NOW||", "s" if i % 3 else None, "en" if i % 5 else None) for i in range(120)] + [(3, "copy", "s", "en"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(500, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_bayes.quality_posteriors(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and 80 <= r.doc_id < 120]
    assert sum(r.kept == bool(r.doc_id % 2) for r in held) >= 0.9 * len(held)
    assert all(0 <= r.posterior <= 1 and 0 <= r.host_posterior <= 1 and 0 <= r.path_posterior <= 1 for r in got)


def test_posteriors_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_bayes.quality_posteriors(docs, labels).collect() == []


RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string, length long"


def plain_revisits(rows, keys):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        t = -(2**62) if r[2] is None else r[2]
        before = [((-(2**62) if x[2] is None else x[2]), x[0], x) for x in rows if x[3] == "response" and keys[x[0]] is not None and keys[x[0]] == keys[r[0]] and (-(2**62) if x[2] is None else x[2]) < t]
        if not before:
            out[r[0]] = ("no_response", None, None)
            continue
        x = max(before, key=lambda y: y[:2])[2]
        if r[4] is not None and x[4] is not None:
            same = r[4].removeprefix("W/") == x[4].removeprefix("W/")
        else:
            same = None if r[5] is None or x[5] is None else r[5] == x[5]
        head = {**{k.lower(): v for k, v in (x[6] or {}).items()}, **{k.lower(): v for k, v in (r[6] or {}).items() if k.lower() in revisits.PERMITTED}}
        out[r[0]] = ("validator_mismatch", None, None) if same is False else ("resolved" if same else "unvalidated", x[0], head)
    return out


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_revisits_equal_plain_search(spark, blocks):
    urls = ["http://www.a.org/x/", "https://A.org:443/x?q=1", "http://a.org:80/x#f", "http://b.org/", None]
    rows = []
    for i in range(150):
        kind = "response" if i * 7 % 3 == 0 else "revisit"
        rows.append((i, urls[i * i % 5], None if i % 41 == 0 else i * 37 % 60, kind, [None, "t", 'W/t', "u"][i % 4], [None, "d1", "d2"][i % 3], {"Date": str(i), "Content-Length": str(i)} if i % 6 else None, f"d{i}", i))
    df = spark.createDataFrame(rows, RECORDS)
    keys = {r.record_id: r.k for r in df.select("record_id", revisits.canonical_url(df["url"]).alias("k")).collect()}
    want = plain_revisits(rows, keys)
    got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in revisits.resolve_revisits(df, blocks).collect()}
    assert got == want
    assert {x[0] for x in want.values()} == {"resolved", "unvalidated", "no_response", "validator_mismatch"}


def test_revisits_of_an_empty_table(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).collect() == []


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 104729 + i * i * seed) % 100003}" for i in range(n))


def test_pipeline_stages_keep_clean_documents_and_place_all(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    rows = [(i, words(i + 1, 60 + i % 30), "en", f"s{i % 3}", 10) for i in range(40)]
    question = words(999, 40)
    rows += [(100, rows[0][1], "en", "s1", 10), (101, rows[1][1] + " tail", "en", "s2", 10), (102, "too short", "en", "s0", 10), (103, None, None, None, None), (104, words(500, 20) + " " + question + " " + words(501, 20), "en", "s0", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id for r in docs.collect()} == set(range(40))
    out = corpus.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(40))
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
