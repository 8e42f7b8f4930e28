"""Quality by hierarchical empirical Bayes over hosts and paths.

A logistic regression on text measures gives each document its own evidence.
Its mean over a site is shrunk towards the global mean, and over a path towards
its site's posterior: with prior strengths fitted by the method of moments from
between-group variance, a site with few documents stays near the global prior.
The document's odds are then multiplied by how far its path's posterior odds
lie from the global ones, damped by ``site_weight``.

The model is fitted on at most ``sample`` labelled documents (smallest hashes of
their ids); everything else covers all rows.  Groups are summed by partial
aggregation, so a site with a third of all rows costs no more than another.
Posteriors reach the rows by a broadcast of all paths where they are few; else
paths that hold a thousandth of all rows or more (at most a thousand paths) are
broadcast and the others joined by their keys.  Host and path come from a URL
column where there is one; ``documents`` has none, so its query takes sources and
languages.
Null texts have zero measures; null hosts and paths are groups of their own;
without labels of both classes the evidence is the global prior 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.storage import Scratch

FEATURES = ("symbols", "bars", "shouts", "capitals", "digits", "word_length", "lines", "length")
#: Paths with one part in so many of all rows are broadcast, so at most that many.
HOT_SHARE = 1000
SYMBOLS, CAPITALS, DIGITS = "#*$%&<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def measures(text: Column) -> dict[str, Column]:
    """Shares of characters by kind, from JVM-side string functions.

    One pass maps each kind's characters to one of them; what is counted is ASCII, so bytes removed are characters.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    kinds = F.translate(t, SYMBOLS + CAPITALS + DIGITS, "#" * len(SYMBOLS) + "A" * len(CAPITALS) + "0" * len(DIGITS))

    def count(c):
        return F.octet_length(kinds) - F.octet_length(F.replace(kinds, F.lit(c), F.lit("")))

    return {
        "symbols": count("#") / n, "bars": count("|") / n, "shouts": count("!") / n, "capitals": count("A") / n, "digits": count("0") / n,
        "word_length": F.least(n / (count(" ") + 1), F.lit(20.0)) / 20, "lines": count("\n") / n * 10, "length": F.log1p(n.cast("double")) / 10,
    }


def site(url: Column) -> tuple[Column, Column]:
    """Host in lower case without www. and port, and the first folder of the path (empty at the root), of a URL."""
    page = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(page, r"^([^/]*)", 1)), r"^www[0-9]*\.", ""), r":[0-9]+$", "")
    return host, F.regexp_extract(page, r"^[^/]*/+([^/]+)/", 1)


def train(labelled: DataFrame, sample: int, label: str = "quality") -> tuple[list[float], float]:
    """Coefficients by FEATURES and intercept; zeros if one class is missing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    bounded = labelled.where(F.col(label).isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(bounded).select("x", F.col(label).cast("double").alias("y"))
    if rows.select("y").distinct().count() < 2:
        return [0.0] * len(FEATURES), 0.0
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=50).fit(rows)
    return [float(x) for x in m.coefficients], float(m.intercept)


def _strength(mean: float, var: float, n: float) -> float:
    """Prior rows of a Beta prior from the mean and variance of group means over groups of n rows (harmonic)."""
    within = mean * (1 - mean)
    between = max(var - within / max(n, 1.0), 1e-4)
    return max(1.0, min(1e6, within / between - 1))


def quality_posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = 20_000, site_weight: float = 0.5, keep_from: float = 0.3, url_col: str | None = None, broadcast_paths: int = 250_000) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior, kept for each row of docs; with ``url_col``, host and path are those of the URL."""
    host, path = site(F.col(url_col)) if url_col else (F.col(host_col).cast("string"), F.col(path_col).cast("string"))
    s = Scratch(docs.sparkSession, "quality-bayes")
    m = s.save(docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), *[v.alias(k) for k, v in measures(F.col(text_col)).items()]), "measures")
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    w, b = train(m.join(one, "doc_id"), sample)
    z = F.lit(b)
    for c, f in zip(w, FEATURES, strict=True):
        z = z + F.lit(c) * F.col(f)
    p = m.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))))).alias("evidence"))
    paths = s.save(p.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = s.save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")

    def moments(df, per):
        r = df.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.avg(per).alias("m"), F.coalesce(F.var_pop(per), F.lit(0.0)).alias("v"), (F.count("*") / F.sum(1 / F.col("n"))).alias("h")).first()
        mean = min(max((r.s or 0.0) / r.n, 1e-3), 1 - 1e-3) if r.n else 0.5
        return mean, _strength(mean, r.v or 0.0, r.h or 1.0)

    mean, k_host = moments(hosts, F.col("s") / F.col("n"))
    post_host = hosts.select(F.col("host").alias("_h"), ((F.lit(mean * k_host) + F.col("s")) / (k_host + F.col("n"))).alias("host_posterior"))
    within = s.save(paths.join(post_host, F.col("host").eqNullSafe(F.col("_h"))), "within")
    _, k_path = moments(within, F.col("s") / F.col("n") - F.col("host_posterior") + mean)
    posts = within.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", ((F.col("host_posterior") * k_path + F.col("s")) / (k_path + F.col("n"))).alias("path_posterior"), "n")
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    if paths.count() <= broadcast_paths:
        joined = p.join(F.broadcast(posts), same)
    else:
        hot = F.col("n") * HOT_SHARE >= m.count()
        large = F.broadcast(posts.where(hot))
        joined = p.join(large, same).unionByName(p.join(large, same, "left_anti").join(posts.where(~hot), same))

    def logit(c):
        c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(c / (1 - c))

    odds = logit(F.col("evidence")) + site_weight * (logit(F.col("path_posterior")) - logit(F.lit(mean)))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-odds))).select("doc_id", "evidence", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= keep_from).alias("kept"))
