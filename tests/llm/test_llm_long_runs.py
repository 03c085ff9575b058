"""Texts with a long run are found wherever the run begins."""

import pytest

from canopyspark.llm.packing import HALF, LONG_RUN, LONGEST, long_run


@pytest.mark.parametrize("unit", [" ", "\n\t", "x", "7", "-", "_", "-_", "x7", "漢", "éİ"])
@pytest.mark.parametrize("length", [HALF, LONGEST - 1, LONGEST, LONGEST + 1, 2 * LONGEST])
def test_long_runs(unit: str, length: int) -> None:
    run = (unit * length)[:length]
    for before in (0, 1, HALF - 1, HALF, LONGEST + 1):
        for fill in ("a b-", ".x "):
            for after in (0, 1):
                text = (fill * before)[:before] + run + (fill * after)[:after]
                assert long_run(text) == (LONG_RUN.search(text) is not None)


def test_plain_texts() -> None:
    assert not long_run("")
    assert not long_run("some words. " * 10000)
