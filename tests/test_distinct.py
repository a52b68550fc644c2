from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rivetwatch.operators import distinct
from rivetwatch.operators.stats import column_profile


def plain(df):
    return tuple(df.agg(*[F.countDistinct(F.col(f"`{c}`").cast("string")) for c in df.columns]).first())


@pytest.fixture(scope="module")
def mixed(spark):
    n = F.col("id")
    return spark.range(0, 6000, 1, 6).select(
        n.alias("own"), (n % 7).alias("few"), (n % 3000).alias("twice"), F.lit("x").alias("one"), F.lit(None).cast("string").alias("none"),
        F.when(n % 5 == 0, F.lit("")).when(n % 5 == 1, None).otherwise(n.cast("string")).alias("gaps"),
        F.repeat(F.lit("é long "), (n % 4).cast("int") * 300).alias("text"), (n / 3).alias("a.b"), F.array(n % 9, n % 2).alias("list"),
    )


@pytest.mark.parametrize("unit_rows, unit_bytes, guard_bits", [(50, 1 << 25, 1 << 26), (1 << 17, 4000, 1 << 26), (700, 1 << 25, 64)])
def test_equals_plain_distinct(mixed, unit_rows, unit_bytes, guard_bits):
    assert tuple(distinct.distinct_counts(mixed, unit_rows, unit_bytes, guard_bits).first()) == plain(mixed)


def test_groups_by_leading_bits(mixed, monkeypatch):
    monkeypatch.setattr(distinct, "GROUP_VALUES", 100)
    assert tuple(distinct.distinct_counts(mixed, 500).first()) == plain(mixed)


def test_values_of_one_unit_stay(spark, mixed):
    df = mixed.select("own", "few", "one", "gaps")
    local = distinct.kept(distinct.unit_values(df, 1000), "distinct")
    moved = distinct.guarded(local, *distinct.guard(local, 4)).filter("text is not null")
    by = {r.position: r["count"] for r in moved.groupBy("position").count().collect()}
    units = local.filter("position = 2").count()
    assert by.get(0, 0) < 5 and by[1] == 7 * units and by[2] == units and by[3] < 2 * units
    assert moved.count() * 10 < 6000 * 4


def test_empty_table_and_one_row(mixed):
    assert set(distinct.distinct_counts(mixed.limit(0)).first()) == {0}
    assert tuple(distinct.distinct_counts(mixed.limit(1)).first()) == plain(mixed.limit(1))


def test_profile_takes_them(mixed):
    df = mixed.drop("a.b", "list")
    got = {r.column: r.unique_count for r in column_profile(df).collect()}
    assert got == dict(zip(df.columns, plain(df)))
