"""Live status per asset, from a batch table or from a stream.

Both forms fold each asset's last rows into the same intermediate row, and one
set of column expressions turns that row into risk, life, decision and advice.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import LIVE_SCORE_SENSORS, LIVE_SCORE_TAIL, PHYSICS_COLUMNS, STALE_AFTER_SECONDS
from ..functions.columns import Keys
from ..functions.scalars import (
    advisory_action,
    ata_label,
    go_nogo,
    last_seen,
    mission_hours,
    mission_success,
    proxy_rul_days,
    risk_from_rate,
    risk_rank,
    risk_to_health,
)
from ..operators.physics import apply_physics_rules
from ..operators.series import last_rows

MIN_SCORED_ROWS = 12
_LAST = {
    "last_temperature": ("temperature",),
    "last_vibration": ("vibration",),
    "last_rpm": ("rpm",),
    "last_cht": ("cht", "temperature"),
    "last_egt": ("egt",),
    "last_oil_pressure": ("oil_pressure", "pressure"),
    "last_oil_temp": ("oil_temp",),
    "last_fuel_flow": ("fuel_flow",),
}


def _last_columns(df: DataFrame) -> dict[str, Column]:
    """The first column of each list that the table has, as the status field."""
    out = {}
    for name, sources in _LAST.items():
        found = next((s for s in sources if s in df.columns), None)
        out[name] = F.round(F.col(found).cast("double"), 3) if found else F.lit(None).cast("double")
    return out


def prepare(df: DataFrame, pack_id: str | None = None) -> DataFrame:
    """Stateless part: physics columns, completeness, flag, and the values to show."""
    sensors = [c for c in LIVE_SCORE_SENSORS if c in df.columns]
    rows = apply_physics_rules(df, pack_id)
    complete = F.lit(True)
    for c in sensors:
        complete = complete & F.col(c).isNotNull()
    flag = F.coalesce(F.col("is_anomaly"), F.lit(False)) if "is_anomaly" in df.columns else F.lit(False)
    usable = complete if len(sensors) >= 2 else F.lit(False)
    return rows.withColumns({"__ok": usable, "__bad": usable & flag, **_last_columns(df)})


def derive_status(folded: DataFrame, stale_after: int = STALE_AFTER_SECONDS, as_of: Column | None = None, keys: Keys = Keys()) -> DataFrame:
    """Folded row to status row.  ``predicted_days`` (a model's answer) wins over the proxy life."""
    rate, alert = F.col("anomaly_rate_pct"), F.col("physics_alert")
    base = risk_from_rate(rate)
    risk = F.when(alert & (rate >= 12), "High").when(alert & (base == "Low"), "Medium").otherwise(base)
    out = folded.withColumn("risk_level", risk)
    proxy = proxy_rul_days(rate, alert)
    days = F.coalesce(F.col("predicted_days").cast("int"), proxy) if "predicted_days" in folded.columns else proxy
    health = risk_to_health(F.col("risk_level"))
    health = F.bround(F.when(alert, F.greatest(F.lit(2.0), health - 22.0)).otherwise(health), 1)
    action = advisory_action(F.col("risk_level"), F.col("physics_fault"))
    out = out.withColumns({"predicted_rul_days": days, "health_index": health, "advisory": action})
    fields = [
        F.col(keys.id), "risk_level", "anomaly_rate_pct", "predicted_rul_days",
        mission_hours(F.col("predicted_rul_days")).alias("predicted_rul_hours"), "health_index",
        mission_success(F.col("health_index")).alias("mission_success_pct"),
        go_nogo(F.col("advisory"), F.col("risk_level")).alias("go_nogo"),
        "physics_fault", "physics_rule", "physics_label",
        ata_label(F.col("physics_fault"), F.col("physics_rule")).alias("ata_chapter"), "advisory", "n_rows",
        *_LAST,
    ]
    if as_of is not None:
        seen = last_seen(F.col("last_ts"), as_of, stale_after)
        fields += [c.alias(k) for k, c in seen.items()]
    else:
        fields += ["last_ts", "stale"]
    return out.select(*fields)


# ---------------------------------------------------------------- batch
def fold_batch(df: DataFrame, pack_id: str | None = None, tail: int = LIVE_SCORE_TAIL, keys: Keys = Keys()) -> DataFrame:
    """Last ``tail`` rows per asset (trimmed before the shuffle), folded to one row."""
    rows = prepare(df, pack_id)
    shown = [*PHYSICS_COLUMNS, *_LAST]
    counts = df.groupBy(keys.id).agg(F.count(F.lit(1)).alias("n_rows"))
    window = last_rows(rows.select(keys.id, keys.ts, keys.tie, "__ok", "__bad", *shown), tail, keys)
    n_ok = F.count_if("__ok")
    folded = window.groupBy(keys.id).agg(
        F.max_by(F.struct(*shown), keys.stamp()).alias("r"),
        F.max(keys.ts).alias("last_ts"),
        F.when(n_ok >= MIN_SCORED_ROWS, F.bround(100.0 * F.count_if("__bad") / n_ok, 2)).otherwise(0.0).alias("anomaly_rate_pct"),
    )
    return folded.select(keys.id, "r.*", "last_ts", "anomaly_rate_pct").join(counts, keys.id)


def live_status(
    df: DataFrame, as_of: datetime | Column, pack_id: str | None = None, tail: int = LIVE_SCORE_TAIL,
    stale_after: int = STALE_AFTER_SECONDS, predictions: DataFrame | None = None, keys: Keys = Keys(),
) -> DataFrame:
    """Status of every asset in a table of (optionally scored) live rows."""
    folded = fold_batch(df, pack_id, tail, keys)
    if predictions is not None:
        model = predictions.select(keys.id, F.col("predicted_rul_days").alias("predicted_days"))
        folded = folded.join(model, keys.id, "left")
    clock = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return derive_status(folded, stale_after, clock, keys)


def status_order(keys: Keys = Keys()) -> list[Column]:
    return [risk_rank(F.col("risk_level")), F.col("anomaly_rate_pct").desc(), F.col(keys.id)]


# ---------------------------------------------------------------- stream
_SHOWN_SCHEMA = (
    "physics_alert boolean, physics_fault string, physics_rule string, physics_label string, "
    + ", ".join(f"{c} double" for c in _LAST)
)
_FOLD_SCHEMA = (
    f"machine_id string, {_SHOWN_SCHEMA}, last_ts timestamp, anomaly_rate_pct double, n_rows long, stale boolean"
)
_SHOWN = [*PHYSICS_COLUMNS, *_LAST]


def _trim(tail: int):
    """Per task and batch: at most ``tail`` newest rows per asset, with the count of all rows.

    This bounds what one hot asset can send to its state task.
    """

    def trim(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.sort_values(["timestamp", "tie"], kind="stable")
            sizes = pdf.groupby("machine_id", sort=False)["tie"].transform("size")
            newest = pdf.groupby("machine_id", sort=False).cumcount(ascending=False)
            pdf = pdf.assign(seen=sizes.where(newest == 0, 0).astype("int64"))
            yield pdf[newest < tail]

    return trim


_NO_ROWS = pd.DataFrame({"ts": [], "tie": [], "ok": [], "bad": []})


class StatusProcessor(StatefulProcessor):
    """Keeps the flags of the last rows and the newest row of one asset.

    Late rows never move the newest row backwards.  A processing-time timer
    reports an asset that falls silent; after ``forget_after`` more seconds of
    silence its state is dropped, so assets that leave don't stay for ever.
    """

    def __init__(self, tail: int, stale_after: int, forget_after: int = 7 * 86_400):
        self.tail, self.stale_after, self.forget_after = tail, stale_after, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "ts array<long>, tie array<long>, ok array<boolean>, bad array<boolean>, n long")
        self.silent = handle.getValueState("silent", "flag boolean")
        self.newest = handle.getValueState("newest", f"ts timestamp, tie long, {_SHOWN_SCHEMA}, due long")

    def handleInputRows(self, key, rows, timerValues):
        window, total, stamp, shown, due = _NO_ROWS, 0, None, [], None
        if self.window.exists():
            ts, tie, ok, bad, total = self.window.get()
            window = pd.DataFrame({"ts": ts, "tie": tie, "ok": ok, "bad": bad})
        if self.newest.exists():
            held = self.newest.get()
            stamp, shown, due = (held[0], held[1]), list(held[2:-1]), held[-1]
        # Batch by batch: no more than the window and one batch is held, whatever the backlog.
        for pdf in rows:
            total += int(pdf["seen"].sum())
            fresh = pd.DataFrame(
                {"ts": pdf["timestamp"].astype("datetime64[us]").astype("int64"), "tie": pdf["tie"], "ok": pdf["ok"], "bad": pdf["bad"]}
            )
            joined = pd.concat([window, fresh], ignore_index=True) if len(window) else fresh
            window = joined.sort_values(["ts", "tie"], kind="stable").tail(self.tail)
            top = pdf.sort_values(["timestamp", "tie"], kind="stable").iloc[-1]
            own = (top["timestamp"].to_pydatetime(), int(top["tie"]))
            if stamp is None or own >= stamp:
                stamp = own
                shown = [None if pd.isna(top[c]) else (bool(top[c]) if c == "physics_alert" else top[c]) for c in _SHOWN]
        self.window.update((
            [int(v) for v in window["ts"]], [int(v) for v in window["tie"]],
            [bool(v) for v in window["ok"]], [bool(v) for v in window["bad"]], total,
        ))
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.stale_after * 1000
        self.handle.registerTimer(due)
        self.newest.update((*stamp, *shown, due))
        self.silent.clear()
        yield self._fold(key, stamp[0], shown, window["ok"], window["bad"], total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.newest.get()
        if self.silent.exists():  # reported before, and silent ever since
            for state in (self.window, self.newest, self.silent):
                state.clear()
            return
        due = timerValues.getCurrentProcessingTimeInMs() + self.forget_after * 1000
        self.handle.registerTimer(due)
        self.newest.update((*held[:-1], due))
        self.silent.update((True,))
        _, _, ok, bad, n = self.window.get()
        yield self._fold(key, held[0], list(held[2:-1]), pd.Series(ok), pd.Series(bad), n, True)

    def _fold(self, key, ts, shown, ok, bad, n, stale):
        scored = int(ok.sum())
        rate = round(100.0 * int(bad.sum()) / scored, 2) if scored >= MIN_SCORED_ROWS else 0.0
        row = [key[0], *shown, ts, rate, int(n), stale]
        return pd.DataFrame([row], columns=["machine_id", *_SHOWN, "last_ts", "anomaly_rate_pct", "n_rows", "stale"])

    def close(self) -> None:
        pass


def live_status_stream(
    rows: DataFrame, pack_id: str | None = None, tail: int = LIVE_SCORE_TAIL,
    stale_after: int = STALE_AFTER_SECONDS, keys: Keys = Keys(),
) -> DataFrame:
    """Streaming status: one updated row per asset that got data or fell silent.

    ``rows`` are canonical rows, already scored by a fitted forest if one is in
    use.  Needs the RocksDB state store provider.
    """
    ready = prepare(rows, pack_id).select(
        F.col(keys.id).alias("machine_id"), F.col(keys.ts).alias("timestamp"), F.col(keys.tie).cast("long").alias("tie"),
        F.col("__ok").alias("ok"), F.col("__bad").alias("bad"), *_SHOWN,
    )
    trimmed = ready.mapInPandas(
        _trim(tail), f"machine_id string, timestamp timestamp, tie long, ok boolean, bad boolean, {_SHOWN_SCHEMA}, seen long"
    )
    folded = trimmed.groupBy("machine_id").transformWithStateInPandas(
        StatusProcessor(tail, stale_after), _FOLD_SCHEMA, "update", "ProcessingTime"
    )
    return derive_status(folded, stale_after, None, Keys("machine_id", keys.ts, keys.tie))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
