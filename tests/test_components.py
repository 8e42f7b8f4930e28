"""Connected components in arrays and by rounds."""

import random

from weirflow.operators.components import connected_components
from weirflow.storage import Scratch


def _plain(edges):
    top = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in top:
        before = dict(top)
        for a, b in edges:
            if a in top and b in top and None not in (a, b):
                top[a] = top[b] = min(top[a], top[b])
        if top == before:
            break
    return top


def _edges():
    rng = random.Random(5)
    found = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    path = list(range(1000, 1080))
    rng.shuffle(path)
    return found + list(zip(path, path[1:], strict=False)) + [(2**62, x) for x in range(3000, 3040)] + [(7, 7), (5000, 5000), (None, 3), (6000, None)]


def test_small_graphs_take_two_tables_and_equal_the_rounds(spark):
    e = spark.createDataFrame(_edges(), "u long, v long")
    want, tables = _plain(_edges()), {}
    for held in (None, 0):
        s = Scratch(spark, "components-test")
        got = connected_components(e, "u", "v", s) if held is None else connected_components(e, "u", "v", s, held=held)
        rows = got.collect()
        assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
        assert got.dtypes == [("node", "bigint"), ("component", "bigint")]
        tables[held] = s.count
        s.close()
    assert tables[None] == 2 < tables[0]  # the edges and the result, whatever the rounds


def test_other_types_and_empty_tables(spark):
    assert {tuple(r) for r in connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert connected_components(spark.createDataFrame([(3, 3), (None, 1)], "u long, v long")).collect() == []
