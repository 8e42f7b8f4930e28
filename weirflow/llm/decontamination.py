"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Items are the indexed texts; training passages are the queries.  Weights are
BM25 impacts divided by the item's score for its own text, so one threshold
holds for items of any length.  A passage is a window of words, long enough and
stepped so that each run of words as long as the longest item lies whole in one.

The index holds posting lists (item, impact) by term and, by term and block of
items, block maxima.  Retrieval is block-max WAND: first, for all windows of a
text at once, block maxima of the window's distinct terms are summed per block.
An item's commonest terms, worth at most ``PIVOT`` of the threshold, cannot lift
it over the threshold alone, so this sum runs over its other terms only and
skips the long lists of common words.  In blocks that are left a pivot walk over
the posting lists scores items one at a time: lists are in order of their next
item, the pivot is the first item at which the lists' block maxima reach the
threshold, and lists before it skip to it.  Every bound is an upper bound, so
nothing at or above the threshold is lost.  What is retrieved is verified:
enough of the question's and of the answer's word runs must occur in the passage.

The index holds the benchmark, which does not grow with the corpus; it is refused
above ``max_items`` items or ``max_bytes`` bytes before it is broadcast.  Null or
empty texts match nothing, an empty item is never matched, a null doc_id is
reported as null, repeated rows are reported as often as they come, and columns
other than those of ``keep`` are ignored; kept ones whose names are the
operator's come back with ``_in`` added.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.columns import carried
from weirflow.llm.shingles import as_bytes, slices, window_hashes

K1, B, PIVOT = 1.2, 0.75, 0.5
#: Windows whose bounds are held at once.
CHUNK = 4096


def split_item(words: list) -> tuple[list, list]:
    """Question and answer of an item: the answer is its last quarter, at least one word."""
    n = max(1, len(words) // 4)
    return words[:-n], words[-n:]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of all positions of the ranges lo[i] to hi[i]."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


class Index:
    """Posting lists of the items by term, with block maxima; term 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float, block: int = 8, run: int = 3):
        self.threshold, self.block, self.run = threshold, block, run
        kept = [(i, w) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0])) if (w := (t or b"").lower().split())]
        self.ids = [i for i, _ in kept]
        self.longest = max((len(w) for _, w in kept), default=0)
        df = Counter(x for _, w in kept for x in set(w))
        mean = sum(len(w) for _, w in kept) / max(1, len(kept))
        self.terms = {t: k for k, t in enumerate(sorted(df), 1)}
        n, term, item, impact, essential = len(kept), [], [], [], []
        for j, (_, w) in enumerate(kept):
            own = {}
            for t, tf in Counter(w).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                own[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            total, below = max(sum(own.values()), 1e-9), 0.0
            for t in sorted(own, key=lambda x: (-df[x], x)):
                below += own[t] / total
                term.append(self.terms[t])
                item.append(j)
                impact.append(own[t] / total)
                essential.append(below > PIVOT * threshold)  # commoner terms are already worth the pivot's share
        t, j = np.array(term, np.int64), np.array(item, np.int32)
        order = np.lexsort((j, t))
        t, self.item, self.impact, e = t[order], j[order], np.array(impact, np.float32)[order], np.array(essential, bool)[order]
        self.start = np.searchsorted(t, np.arange(len(self.terms) + 2))
        # by term and block: the largest impact, and the largest on an item of which the term is essential
        key = t * (n // block + 1) + self.item // block
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.block_of = (self.item[first] // block).astype(np.int32)
        self.block_max = np.maximum.reduceat(np.where(e, self.impact, 0), first) if len(key) else np.empty(0, np.float32)
        self.block_start = np.searchsorted(t[first], np.arange(len(self.terms) + 2))
        used = self.block_max > 0
        self.essential_start = np.concatenate(([0], np.cumsum(used)))[self.block_start]
        self.block_of, self.block_max = self.block_of[used], self.block_max[used]
        del self.block_start
        runs = []
        for _, w in kept:
            q, a = split_item(w)
            runs += [self._runs(q), self._runs(w[-(len(a) + run - 1) :])]
        self.run_start = np.cumsum([0, *[len(r) for r in runs]])
        self.run_hash = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        # a run shorter than ``run`` words, of a question or answer of fewer
        self.run_words = np.array([min(run, len(x)) for _, w in kept for x in (split_item(w)[0], w[-(len(split_item(w)[1]) + run - 1) :])], np.int32)

    def _runs(self, words: list) -> np.ndarray:
        return np.unique(window_hashes(words, self.run))

    def nbytes(self) -> int:
        return sum(len(t) + 100 for t in self.terms) + sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + 8 * len(self.ids)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        step = max(8, self.longest // 2)
        begin = np.arange(0, max(1, n - self.longest + 1), step)
        return begin, np.minimum(begin + self.longest + step, n)

    def search(self, text: bytes | None) -> list[tuple[int, int, int, float]]:
        """(item number, begin, end, score) of each window and item at or above the threshold."""
        words = (text or b"").lower().split()
        if not words or not self.ids:
            return []
        get = self.terms.get
        at = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        begin, end = self.windows(len(words))
        found = []
        for part in range(0, len(begin), CHUNK):  # bounded memory on texts of any length
            b, e = begin[part : part + CHUNK], end[part : part + CHUNK]
            found += self._search(at, b, e)
        return found

    def _search(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, float]]:
        n_blocks = len(self.ids) // self.block + 1
        # distinct (window, term) of terms that are essential to some item
        live = self.essential_start[at + 1] > self.essential_start[at]
        spot = np.flatnonzero(live[begin[0] : end[-1]]) + begin[0]
        lo, hi = np.searchsorted(end, spot, "right"), np.searchsorted(begin, spot, "right")
        owner, window = _ranges(lo, hi)
        pair = np.unique(window * (len(self.terms) + 1) + at[spot][owner])
        window, term = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1)
        owner, post = _ranges(self.essential_start[term], self.essential_start[term + 1])
        key = window[owner] * n_blocks + self.block_of[post]
        if not len(key):
            return []
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        bound = np.add.reduceat(self.block_max[post][order], first)
        found, last, terms = [], -1, None
        for k in key[first[bound >= (1 - PIVOT) * self.threshold - 1e-3]].tolist():
            w, block = divmod(k, n_blocks)
            if w != last:
                terms, last = np.unique(at[begin[w] : end[w]]), w
                terms = terms[terms > 0]
            found += [(j, int(begin[w]), int(end[w]), score) for j, score in self.walk(terms, block)]
        return found

    def walk(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """(item number, score) of the block's items that reach the threshold, by a pivot walk over the terms' lists."""
        lo_item, hi_item = block * self.block, (block + 1) * self.block
        lists = []  # [next item, place, end, block maximum]
        for t in terms.tolist():
            a, b = int(self.start[t]), int(self.start[t + 1])
            a, b = a + int(np.searchsorted(self.item[a:b], lo_item)), a + int(np.searchsorted(self.item[a:b], hi_item))
            if a < b:
                lists.append([int(self.item[a]), a, b, float(self.impact[a:b].max())])
        out, need = [], self.threshold - 1e-6
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= need:
                    pivot = x[0]
                    break
            if pivot is None:
                break
            if lists[0][0] == pivot:
                score = sum(float(self.impact[x[1]]) for x in lists if x[0] == pivot)
                if score >= need:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for x in lists:
                while x[1] < x[2] and x[0] < target:
                    x[1] += 1
                    x[0] = int(self.item[x[1]]) if x[1] < x[2] else hi_item
            lists = [x for x in lists if x[1] < x[2]]
        return out

    def overlaps(self, words: list, j: int) -> tuple[float, float]:
        """Shares of the question's and the answer's runs of words that occur among ``words``."""
        out, known = [], {}
        for i in (2 * j, 2 * j + 1):
            own, k = self.run_hash[self.run_start[i] : self.run_start[i + 1]], int(self.run_words[i])
            if k and k not in known:
                known[k] = window_hashes(words, k)
            out.append(float(np.isin(own, known[k]).mean()) if len(own) else 1.0)
        return out[0], out[1]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, question: float = 0.6, answer: float = 0.5,
    max_items: int = 100_000, max_bytes: int = 500_000_000, keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and ``keep`` columns for each document and item that overlap; of several passages the best."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    if size.n > max_items or size.b > max_bytes:
        raise ValueError(f"the benchmark has {size.n} items of {size.b} bytes, over {max_items} items or {max_bytes} bytes; query it in parts")
    built = Index([(r.i, r.t.encode() if r.t is not None else None) for r in rows.collect()], threshold)  # bounded just above
    if built.nbytes() > max_bytes:
        raise ValueError(f"the index takes {built.nbytes()} bytes, over {max_bytes}; query the benchmark in parts")
    index = docs.sparkSession.sparkContext.broadcast(built)
    own = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    inner, outer = carried(keep, own)

    def search(batches):
        import pyarrow as pa

        ix = index.value
        for batch in slices(batches):
            row, found = [], []
            for at, t in enumerate(as_bytes(batch.column(batch.num_columns - 1))):
                best: dict[int, tuple] = {}
                hits = ix.search(t)
                words = t.lower().split() if hits else []
                for j, a, b, score in hits:
                    q, r = ix.overlaps(words[a:b], j)
                    if q >= question and r >= answer:
                        best[j] = max(best.get(j, (0.0, 0.0, 0.0)), (score, q, r))
                row += [at] * len(best)
                found += [(ix.ids[j], *x) for j, x in sorted(best.items())]
            kept = batch.take(pa.array(row, pa.int64()))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=[*batch.schema.names[:-1], *own[1:]])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), *inner, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", item_id long, score double, question_overlap double, answer_overlap double"
    return src.mapInArrow(search, schema).select(*own, *outer)
