"""Detectors and their evaluation."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import split_list
from weirflow.operators.boosting import HELD_BYTES, Blocks, Model, Options, boost
from weirflow.operators.ranks import counts_before, quantiles
from weirflow.schema import CONFOUNDERS
from weirflow.storage import Scratch


def rules_baseline(f: DataFrame) -> DataFrame:
    """account_id, score by fixed rules; thresholds at quantiles of the table."""
    q = quantiles(f, {"q_fan": ("fan_in", 0.9), "q_peak": ("peak_in_val", 0.95)})
    x = f.crossJoin(F.broadcast(q))  # one row
    rules = ((2.0, F.col("p10_dwell") < 15), (2.0, F.col("med_matched_passthru") > 0.75), (1.5, F.col("fan_in") > F.col("q_fan")), (1.5, F.col("peak_in_val") > F.col("q_peak")), (1.0, F.col("age_min_at_first_txn") < 90 * 1440), (1.0, F.col("stranger_in_share") > 0.8))
    score = F.lit(0.0)
    for w, c in rules:
        score = score + F.when(c, w).otherwise(0.0)
    return x.select("account_id", score.alias("score"))


def z(df: DataFrame, cols: dict[str, float], name: str = "score") -> DataFrame:
    """account_id and the weighted sum of z-scores (sample deviation) of columns."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    x, out = df.crossJoin(F.broadcast(s)), F.lit(0.0)  # one row
    for c, w in cols.items():
        out = out + w * (F.col(c) - F.col(f"m_{c}")) / (F.coalesce(f"s_{c}", F.lit(0.0)) + 1e-9)
    return x.select("account_id", out.alias(name))


def final_score(f: DataFrame) -> DataFrame:
    if "motif_chain_depth" not in f.columns:
        raise ValueError("final_score needs motif_chain_depth: add motif features first")
    return z(f, {"comm_score": 1.0, "motif_chain_depth": 1.5})


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best per ``by``; ties go to the smaller account. Without ``by`` this is a distributed top-k, no global sort."""
    order = (F.desc("score"), F.asc("account_id"))
    if not by:
        return scores.orderBy(*order).limit(k)
    return scores.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def precision_recall(scores: DataFrame, accounts: DataFrame, k: int) -> DataFrame:
    hit = top_k(scores, k).join(accounts.select("account_id", "is_mule"), "account_id").agg(F.avg("is_mule").alias("precision_at_k"), F.coalesce(F.sum("is_mule"), F.lit(0)).alias("hits"))
    total = accounts.agg(F.coalesce(F.sum("is_mule"), F.lit(0)).alias("mules"), F.avg("is_mule").alias("base_rate"))
    return hit.crossJoin(F.broadcast(total)).select("precision_at_k", (F.col("hits") / F.greatest("mules", F.lit(1))).alias("recall_at_k"), "hits", "mules", "base_rate")  # one row


def networks_hit(scores: DataFrame, accounts: DataFrame, k: int) -> DataFrame:
    got = top_k(scores, k).join(accounts.select("account_id", "mule_network_id"), "account_id").select(F.explode(split_list(F.col("mule_network_id"))).alias("net")).agg(F.countDistinct("net").alias("networks_hit"))
    every = accounts.select(F.explode(split_list(F.col("mule_network_id"))).alias("net")).agg(F.countDistinct("net").alias("networks"))
    return got.crossJoin(F.broadcast(every))  # one row


def confounder_share(scores: DataFrame, accounts: DataFrame, k: int) -> DataFrame:
    x = top_k(scores, k).join(accounts.select("account_id", "account_type"), "account_id")
    return x.agg(F.avg(F.col("account_type").isin(*CONFOUNDERS).cast("int")).alias("confounder_share"), F.count_if(F.col("account_type").isin(*CONFOUNDERS)).alias("confounders"))


def auc(values: DataFrame, label: str = "is_mule", value: str = "value") -> DataFrame:
    """Rank-sum AUC and its direction-free form; ties share their mean rank (counted per distinct value)."""
    g = counts_before(values.withColumnRenamed(label, "pos"), value, ("pos",))
    s = g.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    a = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return s.select(a.alias("auc"), F.greatest(a, 1 - a).alias("auc_free"))


def leaderboard(scores: DataFrame, accounts: DataFrame, k: int) -> DataFrame:
    """scores (detector, account_id, score) to one row of metrics per detector."""
    x = top_k(scores, k, ("detector",)).join(accounts.select("account_id", "is_mule", "mule_network_id", "account_type"), "account_id")
    mules = accounts.agg(F.greatest(F.sum("is_mule"), F.lit(1)).alias("m"))
    nets = x.select("detector", F.explode(split_list(F.col("mule_network_id"))).alias("net")).groupBy("detector").agg(F.countDistinct("net").alias("mule_networks_hit"))
    g = x.groupBy("detector").agg(F.avg("is_mule").alias("precision_at_k"), F.sum("is_mule").alias("hits"), F.avg(F.col("account_type").isin(*CONFOUNDERS).cast("int")).alias("false_alerts_on_confounders"))
    return g.join(nets, "detector", "left").crossJoin(F.broadcast(mules)).select("detector", "precision_at_k", (F.col("hits") / F.col("m")).alias("recall_at_k"), F.coalesce("mule_networks_hit", F.lit(0)).alias("mule_networks_hit"), "false_alerts_on_confounders")  # one row


def isolation_scores(f: DataFrame, cols: list[str], trees: int = 400, sample: int = 256, seed: int = 0) -> DataFrame:
    """account_id, score in (0, 1]: trees grown on the driver from samples of at most trees * sample rows, all rows scored in Arrow batches."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    stats = f.agg(*[g(c).alias(f"{n}_{c}") for c in cols for g, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    m, s = np.array([float(stats[f"m_{c}"] or 0) for c in cols]), np.array([float(stats[f"s_{c}"] or 0) or 1.0 for c in cols])
    some = f.select("account_id", *[F.col(c).cast("double") for c in cols]).orderBy(F.xxhash64("account_id", F.lit(seed))).limit(trees * sample).select(*cols)
    rows = some.toArrow().to_pandas().to_numpy(float).reshape(-1, len(cols))  # bounded sample; by columns, a tenth of the memory of rows
    rows = (rows - m) / s
    top = int(np.ceil(np.log2(max(sample, 2))))

    def norm(n):
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x, d):
        live = [i for i in range(x.shape[1]) if len(x) > 1 and x[:, i].min() < x[:, i].max()]
        if d >= top or not live:
            return d + norm(len(x))
        i = live[rng.integers(len(live))]
        cut = rng.uniform(x[:, i].min(), x[:, i].max())
        return i, cut, grow(x[x[:, i] < cut], d + 1), grow(x[x[:, i] >= cut], d + 1)

    forest = [grow(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], 0) for _ in range(trees)] if len(rows) else []
    scale = norm(min(sample, max(len(rows), 2))) or 1.0

    def path(tree, x, at, out):
        if not isinstance(tree, tuple):
            out[at] += tree
            return
        i, cut, lo, hi = tree
        less = x[at, i] < cut
        path(lo, x, at[less], out)
        path(hi, x, at[~less], out)

    def run(it):
        for pdf in it:
            x = (pdf[cols].to_numpy(float) - m) / s
            out = np.zeros(len(x))
            for t in forest:
                path(t, x, np.arange(len(x)), out)
            yield pd.DataFrame({"account_id": pdf.account_id, "score": 2.0 ** (-out / max(len(forest), 1) / scale)})

    return f.select("account_id", *[F.col(c).cast("double") for c in cols]).mapInPandas(run, "account_id long, score double")


def unsupervised_score(f: DataFrame, cols: list[str], prior: dict[str, float]) -> DataFrame:
    iso = isolation_scores(f, cols).withColumnRenamed("score", "iso")
    x = f.select("account_id", *prior).join(iso, "account_id").join(z(f, prior, "prior"), "account_id")
    return z(x, {"iso": 0.5, "prior": 0.5})


def stratified_folds(f: DataFrame, folds: int, seed: int) -> DataFrame:
    """account_id, fold: within each label the accounts are dealt in turn, in order of a hash."""
    x = f.select("account_id", "is_mule", F.xxhash64("account_id", F.lit(seed)).alias("h"))
    out = None
    for label in (0, 1):
        one = x.where(F.col("is_mule") == label)
        part = one.join(counts_before(one, "h").select(F.col("value").alias("h"), "before"), "h").select("account_id", F.pmod("before", F.lit(folds)).cast("int").alias("fold"))
        out = part if out is None else out.unionByName(part)
    return out


def fold_edges(x: DataFrame, cols: list[str], folds: int, bins: int) -> dict[int, list]:
    """By fold left out, each column's bin edges: quantiles of all rows of the other folds, interpolated as numpy does.

    All values are sorted by column, one task a column, and read once in that order; x has fold and columns without nulls.
    """
    import numpy as np
    import pandas as pd

    sizes = {r.fold: r["count"] for r in x.groupBy("fold").count().collect()}
    q, rows = np.linspace(0, 1, bins)[1:-1], {k: sum(sizes.values()) - sizes.get(k, 0) for k in range(folds)}
    at = {k: q * (n - 1) for k, n in rows.items() if n}
    ranks = {k: np.unique(np.concatenate([np.floor(a), np.minimum(np.floor(a) + 1, rows[k] - 1)]).astype(np.int64)) for k, a in at.items()}

    def edges(k, found):
        low = np.floor(at[k]).astype(np.int64)
        a, b = (found[np.searchsorted(ranks[k], np.minimum(r, rows[k] - 1))] for r in (low, low + 1))
        t = at[k] - low
        return np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))

    def read(it):
        seen, found = {}, {}
        for pdf in it:
            for j, part in pdf.groupby("j"):
                v, fold = part.v.to_numpy(), part.fold.to_numpy()
                for k, need in ranks.items():
                    mine, before = v[fold != k], seen.get((j, k), 0)
                    lo, hi = np.searchsorted(need, [before, before + len(mine)])
                    found.setdefault((j, k), []).append(mine[need[lo:hi] - before])
                    seen[j, k] = before + len(mine)
        for (j, k), parts in found.items():
            yield pd.DataFrame({"left_out": [k], "j": [j], "edges": [edges(k, np.concatenate(parts))]})

    every = x.select("fold", F.posexplode(F.array(*cols)).alias("j", "v")).repartition(len(cols), "j").sortWithinPartitions("j", "v")
    got = {(r.left_out, r.j): np.array(r.edges) for r in every.mapInPandas(read, "left_out int, j int, edges array<double>").collect()}  # folds * columns rows
    return {k: [got[k, j] for j in range(len(cols))] for k in at}


def gbm_out_of_fold(f: DataFrame, cols: list[str], folds: int = 5, options: Options = Options(), seed: int = 0, held: int = HELD_BYTES):
    """account_id, score: each account scored by boosted trees that did not see it, classes weighted; importances by column.

    A fold's trees are fitted in one task, all folds at once, on all accounts of the other folds. A task keeps up to
    ``held`` bytes of them in memory, a byte a value and 32 an account, and the others in local files.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    s = Scratch(f.sparkSession, "gbm")
    numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols]
    x = s.save(f.join(stratified_folds(f, folds, seed), "account_id").select("account_id", "is_mule", "fold", *numbers), "rows")
    cuts = f.sparkSession.sparkContext.broadcast(fold_edges(x, cols, folds, options.bins))  # bounded by folds, columns and bins
    kind = np.uint8 if options.bins <= 256 else np.uint16

    def encode(it):
        for batch in it:
            key, y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("account_id", "is_mule", "fold"))
            v = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)
            for k, edges in cuts.value.items():
                use = fold != k
                code = np.ascontiguousarray(Model(edges, 0.0).codes(v[use]), kind)
                ends = np.arange(len(code) + 1, dtype=np.int32) * np.int32(len(cols) * code.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(code)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(key[use], pa.int64()), pa.array(y[use], pa.int32()), packed], ["left_out", "account_id", "is_mule", "code"])

    def learn(it):
        left_out, blocks = None, Blocks(held)
        try:
            for batch in it:
                if not batch.num_rows:
                    continue
                left_out, packed = batch.column("left_out")[0].as_py(), batch.column("code").cast(pa.binary())
                ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
                code = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(packed), len(cols))
                blocks.add(code.copy(), batch.column("is_mule").to_numpy(zero_copy_only=False), batch.column("account_id").to_numpy(zero_copy_only=False))
            if left_out is not None:
                m = boost(blocks, cuts.value[left_out], options, seed)
                yield pa.RecordBatch.from_arrays([pa.array([left_out], pa.int32()), pa.array([pickle.dumps(m)], pa.binary())], ["fold", "model"])
        finally:
            blocks.close()

    train = x.mapInArrow(encode, "left_out int, account_id long, is_mule int, code binary").repartitionById(folds, "left_out")
    models = {r.fold: pickle.loads(bytes(r.model)) for r in train.mapInArrow(learn, "fold int, model binary").collect()}  # one per fold
    shared = f.sparkSession.sparkContext.broadcast(models)  # bounded by rounds and leaves
    total = sum(m.gains.sum() for m in models.values()) or 1.0
    importance = {c: float(sum(m.gains[j] for m in models.values()) / total) for j, c in enumerate(cols)}

    def score(it):
        for pdf in it:
            v, out = pdf[cols].to_numpy(float), np.zeros(len(pdf))
            for k, m in shared.value.items():
                at = np.flatnonzero(pdf.fold.to_numpy() == k)
                out[at] = m.score(v[at])
            yield pd.DataFrame({"account_id": pdf.account_id, "score": out})

    return x.mapInPandas(score, "account_id long, score double"), importance
