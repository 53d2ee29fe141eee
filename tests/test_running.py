"""The chunked path must give exactly what the plain window gives, whatever the skew."""

import random

import pytest
from pyspark.sql import functions as F

from dyadflow.operators.running import LastK, ordinal, running_before


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        key = 1 if rng.random() < 0.5 else rng.randrange(2, 30)
        data.append((key, rng.randrange(5), i, rng.random()))
    return spark.createDataFrame(data, "k long, t long, id long, v double")


@pytest.mark.parametrize("limit", [10, 37, 120])
def test_chunked_equals_plain(rows, limit):
    def run(max_rows):
        return {
            r["id"]: (r["n"], round(r["s"], 9), r["m"], [x["id"] for x in r["l"]])
            for r in running_before(
                rows,
                ["k"],
                ["t", "id"],
                sums={"n": F.lit(1), "s": "v"},
                maxes={"m": "v"},
                last={"l": LastK(("id", "v"), 3)},
                max_rows_per_task=max_rows,
            ).collect()
        }

    assert run(limit) == run(10_000)


def test_global_ordinal_is_dense_in_both_paths(rows):
    for limit in (25, 10_000):
        got = ordinal(rows, [], ["t", "id"], "pos", max_rows_per_task=limit).collect()
        ordered = sorted(got, key=lambda r: (r["t"], r["id"]))
        assert [r["pos"] for r in ordered] == list(range(len(got)))
