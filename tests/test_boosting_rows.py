"""Boosted trees use every account: no bound on training rows, the same trees from memory and from files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import boosting as B
from weirflow.operators.detect import gbm_out_of_fold, stratified_folds
from weirflow.plans import catalog

FEW = B.Options(rounds=6, leaves=7)


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    return x, ((x[:, 0] * x[:, 1] > 0) & (rng.random(n) < 0.7)).astype(int)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(np.array_equal(p, q) for s, t in zip(a.trees, b.trees, strict=True) for p, q in zip(s, t, strict=True))


@pytest.mark.parametrize("held,size", [(0, 100), (8000, 64), (10**9, 7)])
def test_trees_are_the_same_from_files_and_in_any_order(held, size):
    x, y = table(700)
    want = B.fit(x, y, FEW)
    blocks, order = B.Blocks(held, size), np.random.default_rng(1).permutation(700)
    for part in np.array_split(order, 9):
        blocks.add(want.codes(x[part]), y[part], part)
    got = B.boost(blocks, want.edges, FEW)
    assert (blocks.folder is None) == (held > 10**6)
    blocks.close()
    assert same(got, want)


@pytest.mark.parametrize("ahead", [1, 2, 100])
def test_splitting_ahead_keeps_best_first_trees(monkeypatch, ahead):
    x, y = table(500)
    o = B.Options(rounds=1, leaves=9, rows=1.0, columns=1.0)
    monkeypatch.setattr(B, "AHEAD", ahead)
    got = B.fit(x, y, o)
    code, w = got.codes(x), np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    g, h = w * (0.5 - y), w * 0.25

    def best(rows):
        found, (gt, ht) = (1e-9, None, None), (g[rows].sum(), h[rows].sum())
        for j in range(3):
            for c in range(o.bins):
                less = code[rows, j] <= c
                if min(less.sum(), (~less).sum()) >= o.min_child:
                    gl, hl = g[rows][less].sum(), h[rows][less].sum()
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    if gain > found[0] + 1e-9:
                        found = (gain, j, c)
        return found

    leaves = {0: np.arange(500)}
    splits = {0: best(leaves[0])}
    while len(leaves) < o.leaves:
        k = max((k for k in leaves if splits[k][1] is not None), key=lambda k: splits[k][0])
        _, j, c = splits[k]
        rows = leaves.pop(k)
        less = code[rows, j] <= c
        for part in (rows[less], rows[~less]):
            leaves[len(splits)], splits[len(splits)] = part, best(part)
    z = np.zeros(500)
    for rows in leaves.values():
        z[rows] = -o.rate * g[rows].sum() / (h[rows].sum() + 1)
    assert got.score(x) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-7)


@pytest.mark.parametrize("held", [B.HELD_BYTES, 0])
def test_out_of_fold_models_are_fitted_on_all_other_accounts(spark, held):
    x, y = table(400, 3)
    rows = [(i * 3 + 1, int(y[i]), *[None if v == 0.01 else float(v) for v in x[i]]) for i in range(400)]
    f = spark.createDataFrame(rows, "account_id long, is_mule int, a double, b double, c double")
    got, _ = gbm_out_of_fold(f, ["a", "b", "c"], 3, FEW, held=held)
    score, fold = ({r[0]: r[1] for r in d.collect()} for d in (got, stratified_folds(f, 3, 0)))
    ids, x = np.arange(400) * 3 + 1, np.where(x == 0.01, 0.0, x)
    fold = np.array([fold[i] for i in ids])
    for k in range(3):
        out = fold == k
        want = B.fit(x[~out], y[~out], FEW, keys=ids[~out])
        assert np.array_equal([score[i] for i in ids[out]], want.score(x[out]))


def beyond(spark, n=240_000, bound=200_000):
    """account_id, early: whether the account is among the ``bound`` ones that the former code fitted on."""
    ids = spark.range(n).withColumnRenamed("id", "account_id")
    early = ids.orderBy(F.xxhash64("account_id", F.lit(0)), "account_id").limit(bound).withColumn("early", F.lit(1))
    return ids.join(early, "account_id", "left").select("account_id", F.coalesce("early", F.lit(0)).alias("early"))


def test_more_accounts_than_the_former_bound_all_count(spark):
    """Only accounts beyond the former bound have b = 1, all of them mules."""
    f = beyond(spark).withColumn("b", F.when(F.col("early") == 0, F.pmod("account_id", F.lit(2))).otherwise(0).cast("double")).withColumn("a", F.pmod("account_id", F.lit(50)).cast("double"))
    f = f.withColumn("is_mule", ((F.col("b") == 1) | (F.col("a") == 7)).cast("int"))
    got, importance = gbm_out_of_fold(f, ["a", "b"], 2, B.Options(rounds=3, leaves=4, columns=1.0, rows=1.0))
    assert importance["b"] > 0.1
    r = got.join(f, "account_id").groupBy("b").agg(F.min("score").alias("low"), F.count("*").alias("n")).orderBy("b").collect()
    assert sum(x.n for x in r) == 240_000 and r[1].low > 0.5


def test_leaderboard_ranks_models_of_all_accounts(spark, monkeypatch):
    """All mules lie beyond the former bound and have the largest fan-in; models fitted below it saw one class only."""
    f = beyond(spark).withColumn("is_mule", F.when(F.col("early") == 0, F.pmod("account_id", F.lit(2))).otherwise(0).cast("int"))
    others = {*catalog.ISO, *catalog.PRIOR, *catalog.ACTIVITY, "peak_in_val", "comm_score", "motif_chain_depth"} - {"fan_in", "in_n"}
    x = f.drop("early").withColumns({c: F.lit(1.0) for c in sorted(others)}).withColumns({c: F.col("is_mule") * 9.0 for c in ("fan_in", "in_n")})
    acc = f.select("account_id", "is_mule", F.lit("").alias("mule_network_id"), F.lit("salary").alias("account_type"))
    monkeypatch.setattr(catalog, "network_features", lambda s, d: x)
    monkeypatch.setattr(catalog, "accounts", lambda s, d: acc)
    monkeypatch.setattr(catalog.D, "unsupervised_score", lambda f, *_: f.select("account_id", F.lit(0.0).alias("score")))  # slow here, and not at issue
    monkeypatch.setattr(catalog.D, "gbm_out_of_fold", lambda f, cols: gbm_out_of_fold(f, cols, 2, B.Options(rounds=2, leaves=3, columns=1.0)))
    got = {r.detector: r.precision_at_k for r in catalog.QUERIES["leaderboard"](spark, "").collect()}
    assert len(got) == 8 and all(got[k] == 1.0 for k in ("gbm_all", "gbm_curated", "gbm_activity"))
