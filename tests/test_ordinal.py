"""Positions inside groups equal a plain row_number, for any skew and partition count."""

from __future__ import annotations

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopflow.plans.ordinal import blocked, position_within


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=120),
       parts=st.integers(min_value=1, max_value=9))
def test_position_matches_row_number(spark, groups, parts):
    rows = [(g, (i * 7919) % 31, i) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g string, t int, id int")
    got = position_within(df, ["g"], ["t", "id"], num_partitions=parts).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "t", "id"])
    pdf["want"] = pdf.sort_values(["t", "id"]).groupby("g", dropna=False).cumcount() + 1
    m = got.merge(pdf, on="id")
    assert len(m) == len(rows)
    assert (m.position == m.want).all()


def test_blocked_copies_the_tail(spark):
    df = spark.createDataFrame([(p,) for p in range(1, 11)], "position long")
    got = sorted((r.position, r._block, r._carry) for r in blocked(df, "position", 4, 2).collect())
    carried = [(p, b) for p, b, c in got if c]
    assert carried == [(3, 1), (4, 1), (7, 2), (8, 2)]
    assert sum(1 for _, _, c in got if not c) == 10


def test_a_hot_group_is_spread_over_partitions(spark):
    from pyspark.sql import functions as F

    from shopflow.plans.ordinal import ranged
    rows = [("hot", i) for i in range(4000)] + [("cold", i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, t int")
    per_task = ranged(df, ["g", "t"], 8).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) == 8                        # one group, yet every partition has rows
    assert max(r["count"] for r in per_task) < 4040 / 2
    blocks = blocked(position_within(df, ["g"], ["t"], num_partitions=8), "position", 500, 4)
    assert blocks.where("g = 'hot' AND NOT _carry").select("_block").distinct().count() == 8
