"""Quality rules with thresholds that follow each language and source.

One pass over the whole texts gives counts (words, symbols, repeated lines,
words in repeated windows).  Four measures of them are cut by thresholds read
from mergeable quantile sketches: logarithmic histograms with relative error
``ACCURACY``, summed per (language, source), per language and over everything,
over the rows that pass the base rule.  The shares are smoothed by small counts
before the logarithm, so a text without symbols has a share that its length
explains and the sketches have a spread to measure.

A sketch's threshold lies ``spread`` times its half spread from its median: the
smaller of the distances from median to lower and to upper quartile, so up to
half of a group may be junk on one side, and at least ``LEAST`` bins.  A group's
threshold is pooled with its parent's (language, then everything) as ``prior``
rows of the parent would be, and a share's is at most ``SLACK`` bins above the
parent's.  All of it is integer arithmetic on bins.  No measure has a fixed cut-off.

Null or empty texts have zero in every count and fail the base rule; null
languages and sources are groups of their own; repeated rows are judged alike;
an empty table gives an empty result.  A group without a row that passes the
base rule needs no threshold.  ``extra`` columns come back under their names,
those with a name of the operator's with ``_in`` added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.columns import carried
from weirflow.llm.shingles import as_bytes, slices, window_hashes
from weirflow.storage import Scratch

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Least half spread and largest rise over the parent's threshold, in bins of 2 %.
LEAST, SLACK = 5, 35
#: measure: (numerator, denominator, whether the lower tail is cut too).
MEASURES = {
    "symbol_share": ("n_symbols + 1", "word_chars + 100", False), "duplicate_share": ("n_dup_lines + 1", "n_lines + 10", False),
    "repeat_share": ("n_repeat_words + 1", "n_words + 20", False), "word_length": ("word_chars", "n_words", True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, b"#*$%&|<>")), 0, 0, 0
    joined = b"".join(words)
    chars = len(joined)
    if not joined.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 6:
        h = window_hashes(words)
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(h, twice))
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(cover)[:-1]))
    return len(words), chars, len(text) - len(text.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated, len(lines)


def count_texts(docs: DataFrame, keep: list[str], text_col: str = "text", carry: bool = False) -> DataFrame:
    """``keep`` columns, the text itself if ``carry``, then COUNTS and n_lines."""
    names = [*COUNTS, "n_lines"]

    def count(batches):
        import pyarrow as pa

        for batch in slices(batches):
            rows = [text_counts(t) for t in as_bytes(batch.column(batch.num_columns - 1))]
            counted = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            upto = batch.num_columns if carry else batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:upto], *counted], names=[*batch.schema.names[:upto], *names])

    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: None if carry else -1]) + "".join(f", {n} long" for n in names)
    return src.mapInArrow(count, schema)


def bins() -> dict:
    """measure: number of its logarithmic bin; null for rows that fail the base rule."""
    return {m: F.when(~F.expr(BASE), F.ceil(F.log(F.expr(f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)")) / F.lit(math.log(GAMMA)))).cast("int") for m, (a, b, _) in MEASURES.items()}


def sketches(binned: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketch rows: groups, measure, bin, n.  Sketches merge by summing n."""
    named = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_b_{m}").alias("bin")) for m in MEASURES])
    return binned.select(*groups, F.explode(named).alias("m")).where("m.bin is not null").groupBy(*groups, F.col("m.measure").alias("measure"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], at: dict[str, float]) -> DataFrame:
    """Groups, measure, rows, and for each named quantile its bin."""
    w = Window.partitionBy(*groups, "measure")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("rows", F.sum("n").over(w))
    return run.groupBy(*groups, "measure").agg(F.first("rows").alias("rows"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("bin"))).cast("long").alias(k) for k, q in at.items()])


def thresholds(sketch: DataFrame, groups: list[str], spread: int, prior: int) -> DataFrame:
    """One row per group with bins ``hi_`` and ``lo_`` per measure, from its own sketch pooled with its parents'."""
    out = None
    for depth in range(len(groups) + 1):
        own = groups[:depth]
        q = quantiles(sketch.groupBy(*own, "measure", "bin").agg(F.sum("n").alias("n")), own, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
        half = F.greatest(F.lit(LEAST), F.least(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25")))
        q = q.select(*own, "measure", "rows", (F.col("q50") + spread * half).alias("hi"), (F.col("q50") - spread * half).alias("lo"))
        if out is not None:
            on = F.col("measure") == F.col("_m")
            for g in own[:-1]:
                on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
            q = q.join(out.select(*[F.col(g).alias(f"_{g}") for g in own[:-1]], F.col("measure").alias("_m"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo")), on)
            hi, lo = (F.floor((F.col("rows") * F.col(x) + prior * F.col(f"_{x}")) / (F.col("rows") + prior)).cast("long") for x in ("hi", "lo"))
            shares = ~F.col("measure").isin(*[m for m, v in MEASURES.items() if v[2]])
            q = q.select(*own, "measure", "rows", F.when(shares, F.least(hi, F.col("_hi") + SLACK)).otherwise(hi).alias("hi"), lo.alias("lo"))
        out = q
    return out.groupBy(*groups).agg(*[F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}") for m in MEASURES for x in ("hi", "lo")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: int = 7, prior: int = 50, extra: list[str] | None = None, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, counts, base_failed, kept, the thresholds that held, ``extra`` columns and, if ``carry``, the text as ``_text``."""
    s = Scratch(docs.sparkSession, "quality-rules")
    shown = [f"max_{m}" for m in MEASURES] + [f"min_{m}" for m, v in MEASURES.items() if v[2]]
    inner, outer = carried(extra, ["doc_id", *COUNTS, "base_failed", "kept", *shown, "_text"])
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), *inner, F.col(text_col).alias("_t"))
    counted = count_texts(renamed, renamed.columns[:-1], "_t", carry)
    counted = s.save(counted.withColumns({f"_b_{m}": b for m, b in bins().items()}), "counts")
    cuts = s.save(thresholds(s.save(sketches(counted, ["_lang", "_source"]), "sketch"), ["_lang", "_source"], spread, prior), "cuts")
    cuts = cuts.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = counted.join(cuts, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    passes = F.lit(True)
    for m, v in MEASURES.items():
        passes = passes & (F.col(f"_b_{m}") <= F.col(f"hi_{m}"))
        if v[2]:
            passes = passes & (F.col(f"_b_{m}") >= F.col(f"lo_{m}"))
    held = [F.pow(F.lit(GAMMA), F.col(f"hi_{m}")).alias(f"max_{m}") for m in MEASURES] + [F.pow(F.lit(GAMMA), F.col(f"lo_{m}") - 1).alias(f"min_{m}") for m, v in MEASURES.items() if v[2]]
    failed = F.expr(BASE)
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), F.when(failed, False).otherwise(passes).alias("kept"), *held, *outer, *["_text"] * carry)
