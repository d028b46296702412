import random

import pyspark.sql.functions as F

from loomspace.operators.order import BLOCK, block_of, numbered


def _plain(rows, key):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return sorted(((*r, i + 1) for group in by.values() for i, r in enumerate(sorted(group, key=key))), key=repr)


def test_numbers_run_on_over_blocks_and_null_is_a_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), k * 9973) for k in rng.sample(range(3000), 400)]
    assert len({k // BLOCK for _, k in rows}) > 50
    df = spark.createDataFrame(rows, "g long, k long").repartition(5)
    got = numbered(df, ["g"], [block_of(F.col("k"))], ["k"], "place").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _plain(rows, lambda r: r[1])


def test_blocks_may_descend_and_hold_null(spark):
    rows = [(1, float(k % 4) if k % 5 else None, k) for k in range(60)]
    df = spark.createDataFrame(rows, "g long, a double, k long")
    got = numbered(df, ["g"], [-F.col("a")], ["k"], "place").collect()
    first = lambda r: (r[1] is not None, -(r[1] or 0.0), r[2])
    assert sorted((tuple(r) for r in got), key=repr) == _plain(rows, first)


def test_empty_repeated_and_other_source_of_keys(spark):
    none = spark.createDataFrame([], "g long, k long")
    assert numbered(none, ["g"], [block_of(F.col("k"))], ["k"], "place").collect() == []
    same = spark.createDataFrame([(1, 7, "x")] * 4, "g long, k long, t string")
    got = numbered(same, ["g"], [block_of(F.col("k"))], ["k"], "place", same.select("g", "k")).collect()
    assert sorted(r.place for r in got) == [1, 2, 3, 4]
