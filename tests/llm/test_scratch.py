"""What the stages leave in the shared folder."""

import os

import pytest

from hazmeter.llm import common, exact_dedup, near_copies

from .conftest import table


@pytest.mark.parametrize("stage", [exact_dedup.keep_distinct, near_copies.drop_near_copies])
def test_one_table_stays(spark, stage):
    base = " ".join(f"w{k}" for k in range(60))
    rows = table(spark, [(1, base), (2, base), (3, base + " z"), (4, "alone")])
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert stage(rows).count() == (3 if stage is exact_dedup.keep_distinct else 2)
    assert len(set(os.listdir(folder)) - before) == 1
