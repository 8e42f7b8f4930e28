"""Spans that personal_data adds to the base: secrets, spelled-out addresses, and what must not be added."""

import re

from weirflow.llm import pii
from weirflow.llm.queries import op3_pii

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"(?i)token = \"([0-9a-f]{40})\"")


def test_added_spans_are_the_tokens_of_the_texts(spark):
    """Precision and recall against a plain search for what the test tables plant beside the base kinds."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in TOKEN.finditer(t)}
    rows = op3_pii(spark, SF).collect()
    got = {(r.doc_id, int(a), int(b)) for r in rows for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "secret"}
    assert len(want) > 5 and got == want
    planted = {i for i, t in texts.items() if TOKEN.search(t)} | {r.doc_id for r in rows if r.n_email + r.n_ip + r.n_card + r.n_phone}
    assert {r.doc_id for r in rows if r.has_pii} == planted


def test_many_matches_are_placed_like_few(spark):
    n = 5 * pii.STEP + 3
    text = " ".join(f"u{i}@m.org" for i in range(n))
    got = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.personal_data(got).collect()}
    want = [m.span() for m in re.finditer(r"[^ ]+", text)]
    assert [(s.start, s.end) for s in r[1].base] == want and not r[2].base and not r[3].base


def test_labelers_learn_from_anchors():
    """A vote that known positives share and known negatives lack is worth more than one that both have."""
    rows = [((1, 1, 0, 1, 0), True, 50), ((1, -1, 0, -1, 0), False, 50), ((1, 1, 1, 0, 0), None, 5)]
    post, table = pii.reliabilities(rows)
    assert table[1][1] > 1 > abs(table[0][1]) and post[2] > 0.5
