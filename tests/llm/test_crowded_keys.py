"""Near duplicates: shared ids, crowded keys, and words on which polynomial hashes collide."""

import numpy as np
import pytest

from weirflow.llm.near_dedup import near_duplicates
from weirflow.llm.shingles import shingle_set, window_hashes


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


def test_rows_of_one_id_are_linked_each_by_its_own_text(spark):
    a, b = words(1, 60), words(2, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b)), (3, " ".join(b[:-1]))]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_words_of_a_polynomial_collision_differ():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    x, y = f"{a} one two three four".encode(), f"{b} one two three four".encode()
    assert shingle_set(x)[0] != shingle_set(y)[0]
    assert len(set(window_hashes([a.encode(), b.encode()] * 5, 1).tolist())) == 2


@pytest.mark.parametrize("limits", [{}, {"wide": 10}])
def test_a_passage_that_all_share_links_only_similar_texts(spark, limits):
    """One passage of half of each text crowds its keys; families of near copies are found among them, and nothing else."""
    passage, rows = words(5, 60), []
    for f in range(40):
        own = words(100 + f, 60)
        rows += [(10 * f + i, " ".join(passage + own[: 60 - i])) for i in range(5)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group_pairs=6, block=16, **limits).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 10 * 10 for i, _ in rows}
