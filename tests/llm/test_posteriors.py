"""Posteriors of the site model against plain Python, by broadcast and by key; hosts and folders of URLs."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm.quality_bayes import quality_posteriors, site

WORDS = "calm river stones gather under quiet light while older trees keep counting years"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, (WORDS + ". ") * (1 + i % 3) if i % 5 else "###### BUY $$$ NOW 99 <<< >>> " * (1 + i % 4), None if i % 11 == 0 else "a" if i % 3 else f"s{i % 7}", f"p{i % 4}" if i % 13 else None) for i in range(240)]
    labels = [(i, int(i % 5 != 0)) for i in range(0, 240, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def strength(mean, values, sizes):
    centre = sum(values) / len(values)
    var = sum((x - centre) ** 2 for x in values) / len(values)
    within = mean * (1 - mean)
    return max(1.0, min(1e6, within / max(var - within / (len(sizes) / sum(1 / n for n in sizes)), 1e-4) - 1))


def test_posteriors_as_in_plain_python(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality_posteriors(docs, labels).collect()}
    by_path, by_host = defaultdict(list), defaultdict(list)
    where = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    for i, k in where.items():
        by_path[k].append(got[i].evidence)
        by_host[k[0]].append(got[i].evidence)
    every = [r.evidence for r in got.values()]
    mean = sum(every) / len(every)
    k_host = strength(mean, [sum(v) / len(v) for v in by_host.values()], [len(v) for v in by_host.values()])
    host = {h: (mean * k_host + sum(v)) / (k_host + len(v)) for h, v in by_host.items()}
    # the between-path mean is that of the deviations, the binomial variance that of all rows
    k_path = strength(mean, [sum(v) / len(v) - host[k[0]] + mean for k, v in by_path.items()], [len(v) for v in by_path.values()])

    def logit(x):
        return math.log(x / (1 - x))

    for i, k in where.items():
        path = (host[k[0]] * k_path + sum(by_path[k])) / (k_path + len(by_path[k]))
        odds = logit(got[i].evidence) + 0.5 * (logit(path) - logit(mean))
        assert got[i].host_posterior == pytest.approx(host[k[0]], rel=1e-6)
        assert got[i].path_posterior == pytest.approx(path, rel=1e-6)
        assert got[i].posterior == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)


def test_many_paths_by_key_give_the_same_rows(spark, tables):
    docs, labels = tables

    def rows(n):
        return sorted((r.doc_id, round(r.posterior, 9), r.kept) for r in quality_posteriors(docs, labels, broadcast_paths=n).collect())

    assert rows(0) == rows(250_000) and len(rows(0)) == 240


def test_host_and_folder_of_urls(spark):
    urls = [("https://www.Example.org:8080/Docs/a/b.html?x=/1/", "example.org", "Docs"), ("http://example.org", "example.org", ""), ("example.org/index.html#/a/", "example.org", ""), (None, None, None)]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "u string")
    host, path = site(F.col("u"))
    assert [(r[0], r[1]) for r in df.select(host, path).collect()] == [(h, p) for _, h, p in urls]
    docs = df.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("text", F.lit(WORDS))
    assert quality_posteriors(docs, spark.createDataFrame([], "doc_id long, quality int"), url_col="u").count() == 4
