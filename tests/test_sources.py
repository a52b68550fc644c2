from __future__ import annotations

import json
import zipfile
from datetime import datetime

import pytest

from rivetwatch.operators import joins, mapping
from rivetwatch.plans import sensor_view as v
from rivetwatch.plans.sql import check_read_only, run_sql, slice_sql
from rivetwatch.sources import readers, sinks, slices


def test_readers_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text("machine_id,timestamp,temperature\nA,2024-01-01,70\nB,bad,x\n")
    (tmp_path / "b.tsv").write_text("machine_id\ttemperature\nA\t70\n")
    (tmp_path / "c.json").write_text(json.dumps([{"machine_id": "A", "temperature": 70.5}]))
    spark.range(10).write.parquet(str(tmp_path / "d.parquet"))
    csv = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert csv.filter("timestamp is null").count() == 1 and dict(csv.dtypes)["temperature"] == "string"
    assert readers.read_table(spark, str(tmp_path / "b.tsv")).first()["temperature"] == "70"
    assert readers.read_table(spark, str(tmp_path / "c.json")).first()["temperature"] == 70.5
    df, meta = readers.load_with_meta(spark, str(tmp_path / "d.parquet"), limit=4, count=True)
    assert meta["rows"] == 4 and meta["columns"] == ["id"] and meta["kind"] == "parquet"


def test_zip_members_and_pick(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, text in members:
                z.writestr(path, text)

    big = "machine_id,temperature\n" + "".join(f"M{i},{i}\n" for i in range(40))
    archive("one.zip", [("__MACOSX/._sensors.csv", "junk"), (".DS_Store", "x"), ("folder/sensors.csv", "machine_id,temperature\nA,\"7,0\"\n")])
    archive("two.zip", [("a.csv", "machine_id\nA\n"), ("logs/big.csv", big), ("notes.txt", "hello")])
    archive("three.zip", [("x.json", json.dumps([{"machine_id": "J", "temperature": 5}]))])
    listed = readers.zip_members(spark, str(tmp_path / "*.zip")).collect()
    picked = {r["archive"].rsplit("/", 1)[1]: r["member"] for r in listed if r["picked"]}
    assert picked == {"one.zip": "folder/sensors.csv", "two.zip": "logs/big.csv", "three.zip": "x.json"}
    rows = readers.spread_cells(readers.read_zipped(spark, str(tmp_path / "*.zip"), batch_rows=7), ["machine_id", "temperature"])
    assert rows.count() == 42
    assert rows.filter("machine_id = 'A'").first()["temperature"] == "7,0"
    archive("bad.zip", [("readme.txt", "no table")])
    with pytest.raises(Exception, match="no CSV/TSV/JSON table"):
        readers.read_zipped(spark, str(tmp_path / "bad.zip")).collect()


def test_slices_push_filters_into_the_scan(spark, sf):
    raw = v.table(spark, sf, "events")
    day = slices.date_range(raw, "2024-01-10", "2024-01-11", ts_col="ts")
    plan = day.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    one = slices.filter_asset(raw, 3, key="user_id").select("event_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_slice_dispatch(spark, sf):
    df = v.readings(spark, sf)
    assert slices.slice_table(df, "last_n_rows", n=7).count() == 7
    assert slices.slice_table(df, "last_n_days", n=3, as_of=datetime(2024, 1, 31)).count() > 0
    with pytest.raises(ValueError):
        slices.slice_table(df, "nope")
    with pytest.raises(ValueError):
        slices.slice_table(df, "last_n_rows", rows=7)
    assert "pdm_failure_focus" in slices.list_presets("predictive_maintenance")
    assert "pdm_failure_focus" not in slices.list_presets("energy_utilities")
    # A quote in the value stays a value.
    assert slices.slice_table(df, "filter_machine_id", machine_id="x' OR '1'='1").count() == 0


def test_hash_sample_is_repeatable(spark, sf):
    df = v.readings(spark, sf)
    a = {r[0] for r in slices.sample_percent(df, 20, key="event_id").select("event_id").collect()}
    b = {r[0] for r in slices.sample_percent(df.repartition(9), 20, key="event_id").select("event_id").collect()}
    assert a == b and 0 < len(a) < df.count()


# ---------------------------------------------------------------- joins
def test_left_join_and_auto_key(spark):
    left = spark.createDataFrame([("A", 1), ("B", 2)], ["machine_id", "x"])
    right = spark.createDataFrame([("A", "WO-1", 5)], ["machine_id", "work_order", "x"])
    out = joins.join_two(left, right, "left")
    assert out.count() == 2 and {"work_order", "x_l", "x_r"} <= set(out.columns)
    assert joins.suggest_join_keys(left, right) == ["machine_id", "x"]
    with pytest.raises(ValueError):
        joins.join_two(left, right.select("work_order"))
    with pytest.raises(ValueError):
        joins.join_two(left, right, "sideways")
    with pytest.raises(KeyError):
        joins.join_many({"a": left}, [{"left": "a", "right": "zzz"}])


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("x", 4)], "k string, b int")
    assert joins.join_two(a, b, "inner", ["k"]).count() == 1
    assert joins.join_two(a, b, "inner", ["k"], null_safe=True).count() == 2
    assert joins.join_two(a, b, "outer", ["k"], null_safe=True).count() == 2


# ---------------------------------------------------------------- sinks
def test_sinks(spark, sf, tmp_path):
    df = sinks.with_storage_keys(v.readings(spark, sf), 4)
    sinks.write_table(df, str(tmp_path / "t"), partition_by=["asset_bucket"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == df.count()
    sinks.write_table(df.drop("reading_date"), str(tmp_path / "c"), fmt="csv")
    assert readers.read_csv(spark, str(tmp_path / "c")).count() == df.count()
    events = spark.createDataFrame([("pdm.health_event.v1", "A")], ["schema", "asset"])
    sinks.write_health_events(events, str(tmp_path / "e"), "oil_srp", datetime(2026, 1, 1))
    head = spark.read.json(str(tmp_path / "e" / "document")).first()
    assert (head["count"], head["pack_id"], head["generated_at"]) == (1, "oil_srp", "2026-01-01T00:00:00Z")
    sinks.write_assets(events.select("asset"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first()["version"] == 1


# ---------------------------------------------------------------- SQL
def test_sql_guard_reads_the_plan(spark):
    for text in ("SELECT 1 AS update_ts", "SELECT 'DROP' AS x", "WITH a AS (SELECT 1) SELECT * FROM a;", "SELECT * FROM (SELECT 1) LIMIT 3"):
        check_read_only(spark, text)
    for text in ("DROP TABLE x", "CREATE TABLE t AS SELECT 1", "INSERT INTO t SELECT 1", "DELETE FROM t", "SET a=1", "CREATE VIEW q AS SELECT 1", ""):
        with pytest.raises(ValueError):
            check_read_only(spark, text)
    with pytest.raises(Exception):
        check_read_only(spark, "SELECT 1; DROP TABLE x")


def test_sql_over_tables_and_source(spark, sf):
    df = v.readings(spark, sf)
    assert run_sql(spark, "SELECT count(*) AS n FROM my_table", {"my table": df}).first()["n"] == df.count()
    out = slice_sql(spark, "SELECT machine_id FROM {source} WHERE temperature > 130", df)
    assert out.columns == ["machine_id"]
    with pytest.raises(ValueError):
        slice_sql(spark, "SELECT 1", df)


def test_preferred_metrics(spark, sf):
    df = v.engine(v.readings(spark, sf))
    assert mapping.preferred_metric(df, "aviation_uav_piston") == "egt"
    assert mapping.preferred_metric(df.select("machine_id")) is None
    assert mapping.live_chart_metrics(df.columns, "aviation_uav_piston")[:2] == ["cht", "egt"]
    assert mapping.live_chart_metrics(df.columns)[0] == "temperature"


# ---------------------------------------------------------------- catalog
def test_catalog_is_consistent(spark, sf):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).count() > 0
    for name in ("clean_sentinel", "join_full", "health_index", "canonical_payload"):
        assert queries[name](spark, sf).limit(5).count() >= 0
