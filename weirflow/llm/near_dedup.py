"""Near-duplicate groups by HyperMinHash banding, corrected estimates and full verification.

One pass makes of each text its shingle count, a 128-bit fingerprint of the
shingle set, compressed registers and band keys.  Equal sets are collapsed to
one node before anything is paired, so a group of copies costs one row.  Keys
with up to ``group_pairs`` sets pair them all; a larger key pairs its sets with
one leader.  Where the sets of a larger key then still lie in more than one
component, they are compared in blocks, by an inverted list of full sets per
block, which yields links only.  That work grows with the square of a key's
size, so keys of more than ``wide`` sets go by their rarest shingles instead: of
two similar sets the n - ceil(0.75 n) + 1 rarest (counted among such sets) have
one in common, so these serve as keys, in rows that grow with the texts.  Pairs
are confirmed on the full sets, those of bands after the corrected estimate: a
pair that shares a key is lost only if its estimate lies five standard errors
below the truth.

Nulls: a null or wordless text has an empty set and links with nothing; a null
doc_id takes part as no one's partner and its component is null.  Rows that share
a doc_id but not a text are sets of their own, each linked by its own words.
Repeated rows come back as often as they came.  Extra columns are ignored.
Sets count as equal where sizes and 128-bit fingerprints agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import hyperminhash as H
from weirflow.llm.shingles import U, as_bytes, mix, shingle_set, slices
from weirflow.operators.components import connected_components
from weirflow.storage import Scratch

#: Tables of at most this many narrow rows are broadcast (16 MB of memory) once counted; beyond it joins shuffle.
BROADCAST_ROWS = 250_000
SET = ["f0", "f1", "n_shingles"]


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    return int(h.sum(dtype=U).view(np.int64)), int(mix(h ^ U(0xD6E8FEB86659FD93)).sum(dtype=U).view(np.int64))


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text.cast("string"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: float = 0.75) -> DataFrame:
    """doc_id, text_key, n_shingles, f0, f1 (fingerprint of the set), registers, keys."""

    def sign(batches):
        import pyarrow as pa

        for batch in slices(batches):
            n, f0, f1, regs, keys = [], [], [], [], []
            for text in as_bytes(batch.column(2)):
                h = shingle_set(text, words)
                r, (x, y) = H.registers(h), _fingerprint(h)
                n.append(len(h))
                f0.append(x)
                f1.append(y)
                regs.append(r.tobytes())
                keys.append(H.band_keys(r, h, share).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "f0", "f1", "registers", "keys"],
            )

    return _source(docs, id_col, text_col).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, f0 long, f1 long, registers binary, keys array<long>")


def _estimate(batches, share: float, sigmas: float = 5.0):
    """Keeps pairs whose corrected estimate reaches share less ``sigmas`` standard errors."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            a = np.frombuffer(b"".join(batch.column("ra").to_pylist()), np.uint16).reshape(-1, H.BUCKETS)
            b = np.frombuffer(b"".join(batch.column("rb").to_pylist()), np.uint16).reshape(-1, H.BUCKETS)
            j, se = H.jaccard(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(j >= share - sigmas * se * 2 * np.sqrt(share * (1 - share))))


def _verify(batches, num: int, den: int):
    """Keeps pairs with den * |A and B| >= num * |A or B| on the full sets."""
    import pyarrow as pa

    for batch in slices(batches):
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _small(df: DataFrame) -> DataFrame:
    """A stored narrow table as a join side: broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Job:
    """The tables and parameters of one run."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, group_pairs: int, block: int, wide: int):
        self.docs, self.id_col, self.text_col, self.words, self.num, self.den, self.group_pairs, self.block, self.wide = docs, id_col, text_col, words, num, den, group_pairs, block, wide
        self.s = Scratch(docs.sparkSession, "near-dedup")

    def packed(self, sids: DataFrame) -> DataFrame:
        """(sid, n, set) of the listed nodes, a set as its sorted 64-bit hashes."""
        words = self.words

        def pack(batches):
            import pyarrow as pa

            for batch in slices(batches):
                sets = [shingle_set(t, words) for t in as_bytes(batch.column(2))]
                prints = [_fingerprint(h) for h in sets]
                cols = [batch.column(0), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *SET, "set"])

        wanted = self.s.save(self.nodes.join(sids, "sid", "left_semi").select("sid", F.col("rep").alias("doc_id"), *SET), "wanted")
        side = _small(wanted)
        texts = _source(self.docs, self.id_col, self.text_col).join(side.select("doc_id"), "doc_id", "left_semi")
        got = texts.mapInArrow(pack, "doc_id long, f0 long, f1 long, n_shingles long, set binary").join(side, ["doc_id", *SET])
        out = self.s.save(got.select("sid", F.col("n_shingles").alias("n"), "set").dropDuplicates(["sid"]), "packed")
        self.s.drop(wanted)
        return out

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among candidate pairs: size filter, corrected estimate, then the full sets."""
        share, num, den = self.num / self.den, self.num, self.den
        of_a, of_b = (self.sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab")
        both = pairs.join(of_a, "a").join(of_b, "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        close = self.s.save(both.mapInArrow(lambda it: _estimate(it, share), "a long, b long"), "close")
        return self.verified(close)

    def verified(self, close: DataFrame) -> DataFrame:
        num, den = self.num, self.den
        sids = close.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = self.packed(sids)
        joined = close.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("sb")), "b")
        links = self.s.save(joined.select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, num, den), "a long, b long"), "links")
        self.s.drop(close, sets)
        return links

    def candidates(self, members: DataFrame) -> DataFrame:
        """Pairs of members (key, c, lead, sid, comp): all of a key's, or with its leader, but none within a component."""
        held = members.where(F.col("c") <= self.group_pairs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("sid", "comp"))).alias("g"))
        pairs = held.select(F.posexplode("g").alias("i", "x"), "g").select("x", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("y")).where("x.comp <> y.comp").select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
        stars = members.where((F.col("c") > self.group_pairs) & (F.col("sid") != F.col("lead.sid")) & (F.col("comp") != F.col("lead.comp")))
        return pairs.unionByName(stars.select(F.least("sid", "lead.sid").alias("a"), F.greatest("sid", "lead.sid").alias("b"))).distinct()

    def grouped(self, members: DataFrame, name: str) -> DataFrame:
        """members (key, sid, comp) with their key's size and leader, without keys whose sets lie in one component."""
        groups = members.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("sid", "comp"), F.xxhash64("key", "sid")).alias("lead")).where("lo < hi")
        groups = self.s.save(groups.select("key", "c", "lead"), f"{name}-groups")
        return self.s.save(members.join(_small(groups), "key"), name)

    def in_components(self, members: DataFrame, comp: DataFrame) -> DataFrame:
        """members (key, sid) with the component of each sid."""
        return members.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp"))

    def rarest(self, members: DataFrame) -> DataFrame:
        """members (key, sid, comp) of crowded keys by their sets' rarest shingles, which two similar sets must share, as keys."""
        num, den, sids = self.num, self.den, members.select("sid", "comp").distinct()

        def spread(batches):
            import pyarrow as pa

            for batch in slices(batches):
                sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
                n = [len(x) for x in sets]
                cols = [pa.array(np.repeat(batch.column(i).to_numpy(), n), pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())], names=["sid", "n", "key"])

        shingles = self.s.save(self.packed(sids.select("sid")).select("sid", "n", "set").mapInArrow(spread, "sid long, n long, key long"), "shingles")
        counted = shingles.join(shingles.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "key", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        order = F.row_number().over(Window.partitionBy("sid").orderBy("df", "key"))
        first = counted.withColumn("r", order).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).where("df > 1")
        return first.select("key", "sid").join(sids, "sid")

    def across(self, members: DataFrame) -> DataFrame:
        """Links between components within keys that stay crowded, found block against block.

        A key's sets are dealt to chunks of about ``block``; a task gets two chunks, counts common shingles
        through an inverted list of full sets, and yields one link for each two components it joins, so at most a row per set.
        """
        num, den, block = self.num, self.den, self.block
        chunked = members.withColumn("chunks", F.ceil(F.col("c") / block).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
        dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "chunk", "sid", "comp")
        sets = self.packed(members.select("sid").distinct())

        def compare(pdf):
            import pandas as pd

            pdf = pdf.sort_values("sid").reset_index(drop=True)
            left, right = np.flatnonzero(pdf.chunk == pdf.p.iloc[0]), np.flatnonzero(pdf.chunk == pdf.q.iloc[0])
            sid, comp, n = pdf.sid.to_numpy(), pdf.comp.to_numpy(), pdf.n.to_numpy()
            bits = [np.frombuffer(x, U) for x in pdf.set]
            out, up = [], {}

            def top(x):
                while up.setdefault(x, x) != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            if len(left) and len(right):
                values = np.concatenate([bits[j] for j in right])
                owner = np.repeat(np.arange(len(right)), [len(bits[j]) for j in right])
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                for i in left:
                    lo, hi = np.searchsorted(values, bits[i], "left"), np.searchsorted(values, bits[i], "right")
                    size = hi - lo
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                    both = np.bincount(owner[at], minlength=len(right))
                    near = right[(den * both >= num * (n[i] + n[right] - both)) & (comp[right] != comp[i])]
                    for j in near[np.unique(comp[near], return_index=True)[1]].tolist():
                        x, y = top(int(comp[i])), top(int(comp[j]))
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            out.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        return self.s.save(dealt.join(sets, "sid").groupBy("key", "p", "q").applyInPandas(compare, "a long, b long").distinct(), "across")

    def run(self) -> DataFrame:
        s, share = self.s, self.num / self.den
        sig = s.save(signatures(self.docs, self.id_col, self.text_col, self.words, share), "signatures")
        some = sig.where("n_shingles > 0 and doc_id is not null")
        first = some.groupBy(*SET).agg(F.min("doc_id").alias("rep"))
        self.nodes = s.save(first.withColumn("sid", F.monotonically_increasing_id()), "nodes")
        unique = some.withColumnRenamed("doc_id", "rep").join(self.nodes, [*SET, "rep"]).dropDuplicates([*SET, "rep"])
        self.sets = s.save(unique.select("sid", F.col("n_shingles").alias("n"), "registers", "keys"), "sets")
        members = self.grouped(self.sets.select(F.explode("keys").alias("key"), "sid", F.col("sid").alias("comp")), "members")
        links = self.confirmed(self.candidates(members))
        comp = connected_components(links, "a", "b", s)
        hot = members.where(F.col("c") > self.group_pairs).select("key", "sid")
        open_ = self.grouped(self.in_components(hot, comp), "open")
        s.drop(members)
        if not open_.isEmpty():
            more, large = self.across(open_.where(F.col("c") <= self.wide)), open_.where(F.col("c") > self.wide)
            if not large.isEmpty():
                rare = self.grouped(self.rarest(large.select("key", "sid", "comp")), "rare")
                links = links.unionByName(self.confirmed(self.candidates(rare)))
                comp = connected_components(links.unionByName(more), "a", "b", s)
                still = self.grouped(self.in_components(rare.where(F.col("c") > self.group_pairs).select("key", "sid"), comp), "still")
                more = more.unionByName(self.across(still))
            comp = connected_components(links.unionByName(more), "a", "b", s)
        s.drop(open_, self.sets)
        named = self.nodes.join(comp.select(F.col("node").alias("sid"), "component"), "sid")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = named.join(least, "component").select("sid", "component_id")
        by_set = self.nodes.join(linked, "sid", "left").select(*SET, F.coalesce("component_id", "rep").alias("component_id"))
        out = sig.select("doc_id", "text_key", *SET).join(by_set, SET, "left")
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), None).otherwise(F.col("component_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75, den: int = 100, group_pairs: int = 64, block: int = 1024, wide: int = 32_768
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for each row of ``docs``."""
    return _Job(docs, id_col, text_col, words, num, den, group_pairs, block, wide).run()
