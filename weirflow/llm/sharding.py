"""Consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes are hashed onto one ring.  A key belongs to the first
virtual node clockwise; a shard that has reached its bound passes what
overflows on clockwise to the next virtual node of a shard with room.  Bounds
add up to the number of rows, so every shard is filled to its bound: row
counts differ by at most one, and a key moves only where its shard was full.

Rows are counted per arc and hash block (a table that grows with rows /
``block_rows``); only the counts per arc, at most shards * vnodes numbers, come
to the driver, which settles how many keys of each arc go to which shard.  A
row's shard and slot then follow from its rank on its arc, found block by block.

A null text counts as empty (size 1, CRC of nothing); a null doc_id is a key
like any other; repeated rows get slots of their own; an empty table gives an
empty result.  ``keep`` columns whose names are the operator's come back with
``_in`` added.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.columns import carried
from weirflow.storage import Scratch, local_table

RING = 1 << 62


def ring(shards: int, vnodes: int, seed: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; a shard's points do not depend on the number of shards."""
    points = []
    for shard in range(shards):
        rng = np.random.Generator(np.random.PCG64([seed, shard]))
        points += [(int(x), shard) for x in rng.integers(0, RING, vnodes)]
    return sorted(points)


def arc_of(h: Column, edges: list[int]) -> Column:
    """Number of the first edge at or after ``h``, 0 past the last: equal cells of the ring lead to the few edges inside."""
    bits = max(1, len(edges).bit_length())
    cell = [e >> (62 - bits) for e in edges]
    first = [bisect_left(cell, c) for c in range((1 << bits) + 1)]
    at = F.shiftright(h, 62 - bits).cast("int")
    start, stop = F.element_at(F.lit(first), at + 1), F.element_at(F.lit(first), at + 2)
    inside = F.when(stop > start, F.slice(F.lit(edges), start + 1, F.greatest(stop - start, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    return F.pmod(start + F.size(F.filter(inside, lambda e: e < h)), F.lit(len(edges))).cast("int")


def settle(counts: list[int], owners: list[int], bounds: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc in ring order: (shard, number of keys) pieces, its own shard's first.

    A shard's room goes to its own arcs in ring order; what is over moves on clockwise.
    """
    room, pieces, over = list(bounds), [[] for _ in counts], []
    for i, n in enumerate(counts):
        take = min(n, room[owners[i]])
        room[owners[i]] -= take
        if take:
            pieces[i].append((owners[i], take))
        if n > take:
            over.append((i, n - take))
    for i, left in over:
        j = i
        while left:
            j = (j + 1) % len(counts)
            take = min(left, room[owners[j]])
            if take:
                room[owners[j]] -= take
                left -= take
                pieces[i].append((owners[j], take))
    return pieces


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, seed: int = 17, block_rows: int = 50_000, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard, and the columns of ``keep``.

    Without ``keep`` the narrow rows are written once and reread.  With ``keep`` that table would be a copy of
    ``docs``, so ``docs`` itself is read again: it must then be a stored table, or otherwise give the same rows twice.
    """
    spark, s = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    inner, outer = carried(keep, ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "home_shard"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    points = ring(shards, vnodes, seed)
    position = F.xxhash64(F.col(id_col), text, F.lit(seed)).bitwiseAND(F.lit(RING - 1))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), position.alias("h"), *inner
    )
    rows = sized.withColumn("arc", arc_of(F.col("h"), [p for p, _ in points]))
    if not keep:
        rows = s.save(rows, "rows")
    total = rows.count()
    bits = max(0, 62 - max(0, (max(1, total // block_rows) - 1).bit_length()))
    rows = rows.withColumn("block", F.shiftright("h", bits))
    blocks = s.save(rows.groupBy("arc", "block").agg(F.count("*").alias("n")), "blocks")
    counts = [0] * len(points)
    for r in blocks.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most shards * vnodes rows
        counts[r.arc] = r.n
    bounds = [total // shards + (i < total % shards) for i in range(shards)]
    pieces, filled = [], [0] * shards
    for i, parts in enumerate(settle(counts, [o for _, o in points], bounds)):
        start = 0
        for shard, n in parts:
            pieces.append((i, start, start + n, shard, filled[shard]))
            filled[shard] += n
            start += n
    starts = F.sum("n").over(Window.partitionBy("arc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = blocks.select(F.col("arc").alias("_arc"), F.col("block").alias("_block"), F.coalesce(starts, F.lit(0)).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("arc", "block").orderBy("h", "doc_id", "text_crc32", "size")) - 1)
    ranked = ranked.join(before, (F.col("arc") == F.col("_arc")) & (F.col("block") == F.col("_block"))).withColumn("rank", F.col("before") + F.col("r"))
    table = local_table(spark, [(i, a, b, shard, slot) for i, a, b, shard, slot in pieces] or [(0, 0, 0, 0, 0)], "p_arc int, lo long, hi long, shard int, first_slot long")
    placed = ranked.join(F.broadcast(table), (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # bounded: pieces of shards * vnodes arcs
    home = F.element_at(F.lit([o for _, o in points]), F.col("arc") + 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), home.alias("home_shard"), *outer
    )
