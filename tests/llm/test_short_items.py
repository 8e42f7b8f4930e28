"""Benchmark items shorter than a step of the windows."""

import pytest

from weirflow.llm.decontamination import Index


@pytest.mark.parametrize("length", [1, 3, 5, 7, 8, 20])
def test_an_item_is_found_wherever_it_stands(length):
    item = [f"i{k}" for k in range(length)]
    index = Index([(1, " ".join(item).encode()), (2, b"z")], 0.6)
    for n in range(length, 60):
        for at in range(n - length + 1):
            text = [f"f{k}" for k in range(n)]
            text[at : at + length] = item
            assert 0 in {x[0] for x in index.search(" ".join(text).encode())}, (n, at)
