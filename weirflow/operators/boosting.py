"""Gradient-boosted trees on histograms, inside one task, for any number of rows.

Leaf-wise trees on quantile bins with logistic loss, second-order gains, row and
column sampling and weighted classes.  Rows are coded, a byte a column, and kept in
blocks: in memory up to a bound, beyond in local files that each step reads block by
block.  Gradients are whole multiples of a unit, so their sums are exact, and a round
takes its rows by a hash of their keys: the trees do not depend on the order of rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Rows that a step looks at together.
BLOCK_ROWS = 1 << 17
#: Bytes of blocks that a task keeps in memory; further ones are files.
HELD_BYTES = 128 << 20
#: A pass splits at most this part (one in ...) of the leaves that a tree may still split.
AHEAD = 2


@dataclass(frozen=True)
class Options:
    rounds: int = 350
    rate: float = 0.05
    leaves: int = 31
    min_child: int = 5
    rows: float = 0.9
    columns: float = 0.8
    ridge: float = 1.0
    bins: int = 64


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if x.shape[1] else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        c, z = self.codes(x), np.full(len(x), self.base)
        for column, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(column[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(c[inner, column[node]] <= cut[node], left[node], right[node])
            z += value[at]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Blocks:
    """Rows of a training set in blocks of named arrays: codes by column, label, key, and what a round knows of them."""

    def __init__(self, held: int = HELD_BYTES, size: int = BLOCK_ROWS):
        self.held, self.size, self.bytes, self.blocks, self.folder = held, size, 0, [], None
        self.rows, self.pos, self.wait = 0, 0, []

    def add(self, code: np.ndarray, y: np.ndarray, key: np.ndarray) -> None:
        """Rows as codes (rows, columns), labels and keys; any number at a time."""
        self.rows, self.pos = self.rows + len(y), self.pos + int(np.sum(y))
        self.wait.append((code, y, key))
        if sum(len(w[1]) for w in self.wait) >= self.size:
            self.flush()

    def flush(self) -> None:
        if not self.wait:
            return
        code, y, key = (np.concatenate(w) for w in zip(*self.wait, strict=True))
        self.wait, n = [], len(y)
        b = {"code": np.ascontiguousarray(code.T, np.uint8 if code.max(initial=0) < 256 else np.uint16), "y": y.astype(np.uint8), "key": key.astype(np.uint64), "z": np.zeros(n), "g": np.zeros(n, np.int32), "h": np.zeros(n, np.int32), "some": np.zeros(n, bool), "node": np.zeros(n, np.uint16)}
        self.bytes += sum(a.nbytes for a in b.values())
        if self.bytes > self.held:
            self.folder = self.folder or tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for k, a in b.items():
                np.save(f"{self.folder.name}/{len(self.blocks)}-{k}.npy", a)
            b = list(b)
        self.blocks.append(b)

    def __iter__(self) -> Iterator[dict[str, np.ndarray]]:
        """The blocks in turn, their arrays writable in place."""
        for i, b in enumerate(self.blocks):
            yield b if isinstance(b, dict) else {k: np.load(f"{self.folder.name}/{i}-{k}.npy", mmap_mode="r+") for k in b}

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def _mix(key: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each key (splitmix64)."""
    x = key + np.uint64(salt & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _best(hist: np.ndarray, cols: np.ndarray, unit: float, o: Options):
    """(gain, column, cut, rows on the left) of a node's best split, or None; ``hist`` holds counts, gradients and curvatures by column and bin."""
    n, gl, hl = hist[0].cumsum(1), hist[1].cumsum(1) * unit, hist[2].cumsum(1) * unit
    total, gt, ht = n[0, -1], gl[0, -1], hl[0, -1]
    gain = gl**2 / (hl + o.ridge) + (gt - gl) ** 2 / (ht - hl + o.ridge) - gt**2 / (ht + o.ridge)
    gain[(n < o.min_child) | (total - n < o.min_child)] = -np.inf
    best = int(np.argmax(gain))
    if not gain.flat[best] > 1e-9:
        return None
    return float(gain.flat[best]), int(cols[best // o.bins]), best % o.bins, int(n.flat[best])


class _Tree:
    """One round's tree, grown best leaf first.

    A pass over the blocks splits several leaves at once, those that may still come to be among the best;
    the tree is made of the splits that taking the best leaf each time would have chosen.
    """

    def __init__(self, blocks: Blocks, cols: np.ndarray, unit: float, o: Options):
        self.blocks, self.cols, self.unit, self.o = blocks, cols, unit, o
        self.up, self.kids, self.split, self.hist = [-1], {}, [None], {}
        self.total = [(0.0, 0.0)]

    def know(self, node: int, hist: np.ndarray) -> None:
        self.total[node] = (hist[1, 0].sum() * self.unit, hist[2, 0].sum() * self.unit)
        self.split[node] = _best(hist, self.cols, self.unit, self.o)
        if self.split[node]:
            self.hist[node] = hist

    def count(self, b: dict, at: np.ndarray, slot: np.ndarray, out: np.ndarray) -> None:
        """Adds rows ``at`` to the histograms of their slots."""
        slots, bins = out.shape[0], self.o.bins
        base, g, h = slot * bins, b["g"][at].astype(float), b["h"][at].astype(float)
        for i, c in enumerate(self.cols):
            key = base + b["code"][c][at]
            out[:, 0, i] += np.bincount(key, minlength=slots * bins).reshape(slots, bins)
            out[:, 1, i] += np.bincount(key, g, slots * bins).reshape(slots, bins)
            out[:, 2, i] += np.bincount(key, h, slots * bins).reshape(slots, bins)

    def expand(self, nodes: list[int]) -> None:
        """Splits nodes; the smaller child is counted, the other is what its parent has beside it."""
        first = len(self.up)
        column, cut, left = (np.full(first, -1) for _ in range(3))
        slot_of = np.full(first + 2 * len(nodes), -1)
        small = []
        for i, k in enumerate(nodes):
            _, column[k], cut[k], n = self.split[k]
            left[k] = first + 2 * i
            self.kids[k] = (first + 2 * i, first + 2 * i + 1)
            few = self.kids[k][int(2 * n > self.hist[k][0, 0].sum())]
            slot_of[few] = i
            small.append(few)
            self.up += [k, k]
            self.split += [None, None]
            self.total += [(0.0, 0.0)] * 2
        hist = np.zeros((len(nodes), 3, len(self.cols), self.o.bins))
        for b in self.blocks:
            at = np.flatnonzero(left[b["node"]] >= 0)
            k = b["node"][at]
            new = left[k] + (b["code"][column[k], at] > cut[k])
            b["node"][at] = new
            slot = slot_of[new]
            take = (slot >= 0) & b["some"][at]
            self.count(b, at[take], slot[take], hist)
        for i, k in enumerate(nodes):
            a, b = self.kids[k]
            other = self.hist.pop(k) - hist[i]
            self.know(small[i], hist[i])
            self.know(b if small[i] == a else a, other)

    def grow(self) -> list[int]:
        """The nodes that are split, best first."""
        root = np.zeros((1, 3, len(self.cols), self.o.bins))
        for b in self.blocks:
            at = np.flatnonzero(b["some"])
            self.count(b, at, np.zeros(len(at), np.int64), root)
        self.know(0, root[0])
        while True:
            leaves, chosen = [0], []
            while len(chosen) < self.o.leaves - 1:
                node = max((k for k in leaves if self.split[k]), key=lambda k: (self.split[k][0], -k), default=None)
                if node is None or node not in self.kids:
                    break
                chosen.append(node)
                leaves.remove(node)
                leaves += self.kids[node]
            else:
                return chosen
            if node is None:
                return chosen
            ahead = sorted((k for k in leaves if self.split[k] and k not in self.kids), key=lambda k: (-self.split[k][0], k))
            self.expand(ahead[: max(1, (self.o.leaves - 1 - len(chosen)) // AHEAD)])


def boost(blocks: Blocks, edges: list[np.ndarray], o: Options = Options(), seed: int = 0) -> Model:
    """Trees for the labels of ``blocks``; the positive class weighs as much as the negative one. One class alone gives a constant."""
    blocks.flush()
    width, pos, neg = len(edges), float(blocks.pos), float(blocks.rows - blocks.pos)
    m = Model(edges, 0.0, gains=np.zeros(width))
    if not pos or not neg:
        m.base = 30.0 if pos else -30.0
        return m
    weight = neg / pos
    unit = max(weight, 1.0) / 2.0 ** min(30, 52 - blocks.rows.bit_length())  # sums stay below 2 ** 53
    rng, kept = np.random.default_rng(seed), np.uint64(min(int(o.rows * 2**64), 2**64 - 1))
    value = np.zeros(1)
    for r in range(o.rounds):
        cols = np.sort(rng.choice(width, max(1, int(o.columns * width)), replace=False))
        for b in blocks:
            b["z"] += value[b["node"]]
            p, w = 1 / (1 + np.exp(-b["z"])), np.where(b["y"] == 1, weight, 1.0) / unit
            b["g"][:], b["h"][:] = np.rint(w * (p - b["y"])), np.rint(w * p * (1 - p))
            b["some"][:], b["node"][:] = _mix(_mix(b["key"], seed), r + 1) <= kept, 0
        t = _Tree(blocks, cols, unit, o)
        chosen = t.grow()
        place, column, cut, left, right = {0: 0}, [-1], [0], [0], [0]
        for k in chosen:
            gain, j, c, _ = t.split[k]
            m.gains[j] += gain
            i = place[k]
            column[i], cut[i], left[i], right[i] = j, c, len(column), len(column) + 1
            for kid in t.kids[k]:
                place[kid] = len(column)
                for one, empty in ((column, -1), (cut, 0), (left, 0), (right, 0)):
                    one.append(empty)
        value = np.zeros(len(t.up))  # of all nodes known, also those below the tree's leaves
        inner, leaf = set(chosen), np.zeros(len(column))
        for k, up in enumerate(t.up):
            if k in inner:
                continue
            if k in place:
                value[k] = leaf[place[k]] = -o.rate * t.total[k][0] / (t.total[k][1] + o.ridge)
            else:
                value[k] = value[up]
        m.trees.append((np.array(column), np.array(cut), np.array(left), np.array(right), leaf))
    return m


def fit(x: np.ndarray, y: np.ndarray, o: Options = Options(), seed: int = 0, keys: np.ndarray | None = None) -> Model:
    """Trees from arrays; ``keys`` tell the rows apart in sampling."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, o.bins)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    blocks = Blocks()
    blocks.add(Model(edges, 0.0).codes(x), y, np.arange(len(x)) if keys is None else keys)
    return boost(blocks, edges, o, seed)
