"""The corpus operators against brute force and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

pytest.importorskip("weirflow.llm")
from weirflow.llm import decontamination, licenses, mixing, near_dedup, pii, quality_rules, queries, reply_trees, sharding  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (None, None, None, None, 0), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 0), (3, "one", None, "a", 3), (4, "ONE", "en", None, 3), (5, "a b c d", "en", "b", 7), (5, "a b c d", "en", "b", 7),
    (6, "x " * 30_000, "en", "b", 60_000), (7, "mail a.b@c.org_d@e.org, 1.2.3.4.5 999.1.1.1 +1 (974) 555-3436 4111 1111 1111 1111 x", "en", "b", 60), (8, " é ß end " * 3, "fr", "c", 20),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, DOCS)
    return df.selectExpr("*", "1 as size", "'k' as key", "'s' as shard", "2 as component_id") if extra else df


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t):
    w = WORD.findall(lowered(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets, up = {}, {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in rows:
        if i is not None:
            sets[i], up[i] = shingles(t), i
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("limits", [{}, {"group_pairs": 2, "block": 3}])
def test_near_duplicates(spark, limits):
    base = [f"w{i}" for i in range(60)]
    near = [(1000 + i, " ".join(base[:i] + ["zz"] * (i % 3) + base[i + 1 + i % 2 :]), "en", "s", 0) for i in range(40)]
    small = [(2000 + i, " ".join(f"k{j}" for j in range(i % 9)), "en", "s", 0) for i in range(30)]
    docs = documents(spark).unionByName(spark.createDataFrame(near + small, DOCS))
    rows = docs.select("doc_id", "text").collect()
    want = components(rows)
    got = near_dedup.near_duplicates(docs, **limits).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(odd(spark)).collect()}
    assert {(None, 0, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 6)} <= got
    assert near_dedup.near_duplicates(odd(spark).where("false")).count() == 0


def py_spans(t):
    t = t or ""
    out = []
    for kind, pat in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pat, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark):
    more = [(10**6 + i, t, "en", "s", 0) for i, t in enumerate([
        "0255.000.1.1 256.1.1.1 1.2.3.4 1..2.3.4.5.6.7.8", "4111-1111-1111-1111 4111111111111112 12-3 4111 1111  1111", "é a@b.c.d.@e.f x@y z@z.z-_q@w.ee", "+12345678 +1 +49 (0) 30.123-45 67) +1234567890123456",
        "write to jane [at] mail [dot] com or call tel. 212-555-0199 now",
    ])]
    docs = documents(spark).unionByName(odd(spark, False)).unionByName(spark.createDataFrame(more, DOCS))
    rows = docs.select("doc_id", "text").collect()
    got = pii.personal_data(docs).select("doc_id", pii.joined(pii.F.col("base")).alias("b"), pii.joined(pii.F.concat("base", "added")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(r.doc_id), ",".join(py_spans(r.text))) for r in rows)
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)
    assert {r.doc_id: r.s for r in got}[10**6 + 4] == "email:9:33,phone:47:59"


def test_quality_counts():
    def slow(t):
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    for t in ["", " \n", "a b c d e a b c d e", "é ß x\x1cy\x85z # * <a> |\n\n a\na\n a\n", "x " * 500, "one two three four five six " * 3 + "one two three four"]:
        assert quality_rules.text_counts(t.encode())[:5] == slow(t)


def test_quality_rules(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][c] for c in quality_rules.COUNTS) == quality_rules.text_counts(r.text.encode())[:5]
        g = got[r.doc_id]
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words) and not (g.base_failed and g.kept)
    clean = [i for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    assert sum(got[i].kept for i in clean) >= 0.99 * len(clean)
    assert quality_rules.quality_rules(odd(spark)).count() == len(ODD)
    assert quality_rules.quality_rules(odd(spark).where("false")).count() == 0


def test_sharding(spark):
    for docs in (documents(spark), odd(spark), odd(spark).where("false")):
        rows = docs.select("doc_id", "text").collect()
        got = sharding.shard_rows(docs).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
        per = Counter(r.shard for r in got)
        assert not got or max(per.values()) - min(per.get(i, 0) for i in range(16)) <= 1
        for i in per:
            assert sorted(r.slot for r in got if r.shard == i) == list(range(per[i]))


def test_ring_moves_little():
    import random

    rng = random.Random(1)
    keys = sorted(rng.randrange(sharding.RING) for _ in range(20_000))
    import bisect

    def place(n):
        pts = sharding.ring(n, 64, 17)
        counts, out = [0] * len(pts), {}
        arcs = [bisect.bisect_left([p for p, _ in pts], k) % len(pts) for k in keys]
        for a in arcs:
            counts[a] += 1
        pieces = sharding.settle(counts, [o for _, o in pts], [len(keys) // n + (i < len(keys) % n) for i in range(n)])
        at = Counter()
        for k, a in sorted(zip(keys, arcs, strict=True), key=lambda x: (x[1], x[0])):
            r, at[a] = at[a], at[a] + 1
            for s, c in pieces[a]:
                if r < c:
                    out[k] = s
                    break
                r -= c
        return out

    a, b = place(16), place(17)
    assert sum(a[k] != b[k] for k in keys) < 0.35 * len(keys)


def test_mixing(spark):
    docs = documents(spark)
    got, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in again)
    size, src = {}, {}
    for r in docs.collect():
        size[r.doc_id], src[r.doc_id] = len(WORD.findall(r.text)), r.source
    per = Counter()
    for i, s in src.items():
        per[s] += size[i]
    names = sorted(per)
    goal = mixing.targets(dict(per), {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, Fraction(3, 2) * sum(per.values()))
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[src[r.doc_id]] and 0 <= r.taken <= 2 * r.size and abs(r.target - float(goal[src[r.doc_id]])) < 1e-6
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[n] - goal[n]) <= 1 for n in names)
    assert mixing.mix(odd(spark).drop("size")).count() == len(ODD) and mixing.mix(odd(spark)).count() == len(ODD)
    assert mixing.mix(docs.where("false")).count() == 0


def test_min_cost_flow_overlap():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 22, "b": 16})
    assert sum(x for (_, s), x in flow.items() if s == "a") == 22 and sum(x for (_, s), x in flow.items() if s == "b") == 16
    assert all(sum(x for (p, _), x in flow.items() if p == q) <= 2 * n for q, n in {("a",): 10, ("a", "b"): 10, ("b",): 4}.items())


def test_mixing_overlap(spark):
    rows = [(i, "w " * (i % 7), ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else [None, "b"]) for i in range(90)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 90 and sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=4)


def test_decontamination(spark):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: WORD.findall(lowered(r.text)) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    for r in docs.collect():
        text = " " + " ".join(WORD.findall(lowered(r.text))) + " "
        for i, w in items.items():
            if " " + " ".join(w) + " " in text:
                assert (r.doc_id, i) in got
    # bounds lose nothing: every window scored in full, on every document
    ix = decontamination.Index([(r.item_id, r.text.encode()) for r in bench.collect()], 0.6)
    import numpy as np

    full = np.zeros((len(ix.terms) + 1, len(ix.ids)))
    for t in range(1, len(ix.terms) + 1):
        full[t, ix.item[ix.start[t] : ix.start[t + 1]]] = ix.impact[ix.start[t] : ix.start[t + 1]]
    for r in docs.collect():
        words, want = r.text.encode().lower().split(), {}
        at = np.array([ix.terms.get(w, 0) for w in words], int)
        for a, e in zip(*(x.tolist() for x in ix.windows(len(words))), strict=True):
            t = np.unique(at[a:e])
            want.update({(j, a, e): x for j, x in enumerate(full[t[t > 0]].sum(0)) if x >= 0.6 - 1e-6})
        assert {x[:3]: x[3] for x in ix.search(r.text.encode())} == pytest.approx(want, abs=1e-5)
    assert decontamination.contaminated(odd(spark), bench).count() == 0 and decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_overlap_is_of_one_passage(spark):
    """Runs of question and answer scattered over a text are no passage of it; the same words together are."""
    item = [f"q{i}" for i in range(24)]
    filler = [f"f{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(filler + item + filler)), (2, " ".join(item[:12] + filler + item[12:])), (None, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontamination.contaminated(docs.selectExpr("*", "text as Score"), bench, keep=["Score"]).collect()
    assert {r.doc_id for r in got} == {1, None} and all(r.Score_in and r.score > 0.99 for r in got)
    with pytest.raises(ValueError):
        decontamination.contaminated(docs, bench, max_bytes=50)


def test_reply_trees_round_trip(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "a\\b <|im_end|>\n<|im_start|>user\nx", "", None, "\\", "<\\|", "é<<SYS>>"]
    rows = [(1, 1, None, "user", texts[0], 1.0), (1, 2, 1, "assistant", texts[1], 5.0), (1, 3, 1, "assistant", texts[2], 2.0), (1, 4, 3, "user", texts[3], 9.0), (1, 5, 99, "sys\ntem\\", texts[5], 0.0),
            (None, 1, None, None, texts[4], None), (None, 2, 1, "assistant", texts[6], None), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (3, 7, None, "assistant", texts[7], 1.0), (3, 7, None, "assistant", texts[7], 1.0)]
    df = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    f = reply_trees.format_trees(df, branches=None)
    got = {(r.tree, r.leaf): r for r in f.select("*", reply_trees.read_turns(reply_trees.F.col("formatted")).alias("turns"), reply_trees.masked_text(reply_trees.F.col("formatted"), reply_trees.F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {(1, 2), (1, 4), (1, 5), (None, 2), (3, 7)}
    want = {(1, 2): [0, 1], (1, 4): [0, 2, 3], (1, 5): [4], (None, 2): [5, 6], (3, 7): [9]}
    for k, ix in want.items():
        assert [(t.role, t.text) for t in got[k].turns] == [(rows[i][3] or "", rows[i][4] or "") for i in ix]
        assert got[k].loss == "".join(rows[i][4] or "" for i in ix if rows[i][3] == "assistant")
    best = {(r.tree, r.leaf) for r in reply_trees.format_trees(df, branches=1).collect()}
    assert best == {(1, 4), (None, 2), (3, 7)}


def test_reply_query(spark):
    got = {r.conv_id: r for r in queries.op2_reply_trees(spark, SF).collect()}
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(rows)
    for i, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[i].n_turns == len(turns) and got[i].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert got[i].loss_chars == len(loss) and got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_licences(spark):
    assert licenses.train()[3] >= 0.95
    rows = [(1, "text\nReleased under the MIT License.\nmore", "", "", 0), (2, "his driver license expired", "", "", 0), (3, "Licensed under CC BY-NC 4.0.", "", "", 0), (4, "a plain line", "", "", 0),
            (5, "This work is licensed under the GNU General Public License, version 3.", "", "", 0), (6, "Licensed under the Apache License, Version 2.0.", "", "", 0), (None, None, None, None, None)]
    got = {(r.doc_id, r.family) for r in licenses.licence_paragraphs(spark.createDataFrame(rows, DOCS)).collect() if r.confirmed}
    assert got == {(1, "MIT"), (3, "CC-BY-NC"), (5, "GPL-3.0"), (6, "Apache-2.0")}
    assert licenses.licence_paragraphs(odd(spark)).count() == 0
