"""Row-level rules as column expressions.

All of them stay inside whole-stage code generation and work the same on a
batch table and on a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..constants import (
    AVIATION_KEYS,
    BAR_KEYS,
    BAR_OIL_MAX,
    DUTY_CYCLE,
    FAULT_ATA,
    FAULT_LOW_OIL,
    FAULT_NONE,
    FAULT_OVERHEATING,
    FAULT_REGION,
    FAULT_VIBRATION,
    INVALID_ASSET_IDS,
    MISSION_HOURS,
    NO_ATA,
    OTHER_REGION,
    PSI_PER_BAR,
    REGION_PHRASE,
    RISK_HEALTH,
    RISK_ORDER,
    RISK_SURVIVAL,
    RULE_ATA,
    SENSOR_REGIONS,
    SENSOR_SHORT_NAMES,
    STALE_AFTER_SECONDS,
    WORK_ORDER_CODES,
)


def choose(source: Column, table: dict, default=None) -> Column:
    """A small constant lookup as one CASE expression."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(source == F.lit(key), F.lit(value)).otherwise(out)
    return out


def clamp(c: Column, low: float, high: float) -> Column:
    """Keep NULL as NULL (``greatest``/``least`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def is_valid_asset(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin(*INVALID_ASSET_IDS)


# ---------------------------------------------------------------- risk, health
def normalize_risk(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low.startswith("high") | low.isin("critical", "severe"), "High")
        .when(low.startswith("med") | low.isin("warn", "warning", "elevated"), "Medium")
        .when(low.startswith("low") | low.isin("ok", "healthy", "normal"), "Low")
        .otherwise("Unknown")
    )


def risk_from_rul(days: Column) -> Column:
    return F.when(days.isNull(), "Unknown").when(days <= 7, "High").when(days <= 14, "Medium").otherwise("Low")


def risk_from_rate(rate: Column) -> Column:
    return F.when(rate >= 15, "High").when(rate >= 5, "Medium").otherwise("Low")


def risk_rank(risk: Column) -> Column:
    return choose(risk, RISK_ORDER, 3)


def risk_to_health(risk: Column) -> Column:
    return choose(normalize_risk(risk), RISK_HEALTH, RISK_HEALTH["Unknown"])


def health_severity(health: Column) -> Column:
    return F.when(health < 55, "high").when(health < 75, "medium").otherwise("low")


def mission_hours(days: Column, duty_cycle: float = DUTY_CYCLE) -> Column:
    """Airborne hours left; missing or negative life gives 0."""
    if duty_cycle < 0:
        return F.lit(0.0)
    d = days.cast("double")
    return F.when(d >= 0, F.bround(d * 24.0 * duty_cycle, 1)).otherwise(F.lit(0.0))


def mission_success(health: Column) -> Column:
    """Half-even rounded health in 0..100; missing or NaN gives 0."""
    h = health.cast("double")
    usable = h.isNotNull() & ~F.isnan(h)
    return F.when(usable, clamp(F.bround(h, 0), 0.0, 100.0)).otherwise(F.lit(0.0)).cast("int")


def mission_line(asset: Column, health: Column) -> Column:
    return F.concat(
        F.lit("If "), F.coalesce(asset, F.lit("asset")), F.lit(" flies next mission, "),
        mission_success(health).cast("string"), F.lit("% success chance"),
    )


def survival_score(risk: Column, rul_days: Column, horizon_hours: float = MISSION_HOURS) -> Column:
    """Chance one asset completes the next sortie: risk prior blended with life left."""
    needed_days = max(max(horizon_hours / 24.0, 1e-6) * 3.0, 0.5)
    base = choose(normalize_risk(risk), RISK_SURVIVAL, RISK_SURVIVAL["Unknown"])
    days = F.coalesce(rul_days.cast("double"), F.lit(0.0))
    life = F.least(F.lit(1.0), days / F.lit(needed_days))
    return F.when(days > 0, 0.5 * base + 0.5 * (0.25 + 0.75 * life)).otherwise(base)


def proxy_rul_days(rate_pct: Column, alert: Column) -> Column:
    """Life left from the anomaly rate alone, shortened by a physics alert."""
    base = 28.0 * (1.0 - F.least(rate_pct, F.lit(85.0)) / 100.0)
    return F.greatest(F.lit(1), F.bround(F.when(alert, base * 0.42).otherwise(base), 0).cast("int"))


# ---------------------------------------------------------------- faults
def ata_label(fault: Column, rule: Column) -> Column:
    """Chapter of the first known rule in the ``; `` list, else of the fault."""
    parts = F.transform(F.split(F.coalesce(rule, F.lit("")), ";"), lambda p: F.trim(p))
    known = F.filter(parts, lambda p: p.isin(*RULE_ATA))
    return F.coalesce(choose(F.get(known, F.lit(0)), RULE_ATA), choose(F.trim(fault), FAULT_ATA), F.lit(NO_ATA))


def fault_region(fault: Column) -> Column:
    return choose(fault, FAULT_REGION, "")


def twin_region(fault: Column, driver_region: Column, driver_sensor: Column) -> Column:
    """Region to highlight: the fault's, else the driver's, else the sensor's."""
    by_fault = fault_region(fault)
    driver = F.coalesce(driver_region, F.lit(""))
    named = F.coalesce(driver_sensor, F.lit(""))
    return (
        F.when(by_fault != "", by_fault)
        .when(driver != "", driver)
        .when(named != "", sensor_region(named))
        .otherwise("")
    )


def _squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def _first_rule(name: Column, rules, pick: int, default: str) -> Column:
    blob = _squash(name)
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(blob.contains(rule[0]), F.lit(rule[pick])).otherwise(out)
    return out


def sensor_region(name: Column) -> Column:
    return _first_rule(name, SENSOR_REGIONS, 2, OTHER_REGION[1])


def sensor_region_phrase(name: Column) -> Column:
    return _first_rule(name, SENSOR_REGIONS, 1, OTHER_REGION[0])


def sensor_display(name: Column) -> Column:
    """``exhaust_temp`` -> ``exhaust_temp (EGT)``; a name equal to its tag stays bare."""
    short = _first_rule(name, SENSOR_SHORT_NAMES, 1, "")
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.when((short == "") | (_squash(short) == _squash(name)), plain).otherwise(
        F.concat(plain, F.lit(" ("), short, F.lit(")"))
    )


# ---------------------------------------------------------------- advisory
def advisory_action(
    risk: Column,
    fault: Column | None = None,
    driver_sensor: Column | None = None,
    driver_region: Column | None = None,
    phrase: Column | None = None,
) -> Column:
    """One action per asset from risk, red-line fault and (optional) sensor driver."""
    blank = F.lit("")

    def text(c):
        return blank if c is None else F.coalesce(c.cast("string"), blank)

    hit = F.lit(FAULT_NONE) if fault is None else F.when(text(fault).isin("", "nan"), FAULT_NONE).otherwise(text(fault))
    given = F.trim(text(phrase))
    region = F.when(text(driver_region) != "", text(driver_region)).when(given != "", given).otherwise(fault_region(hit))
    facts = F.struct(
        normalize_risk(risk).alias("level"), hit.alias("hit"), text(driver_sensor).alias("sensor"),
        region.alias("region"), given.alias("given"),
    )
    # Bound once per row: the rules below mention each fact many times.
    return F.get(F.transform(F.transform(F.array(facts), _advisory_words), _advisory_rule), F.lit(0))


def _advisory_words(f: Column) -> Column:
    region = f["region"]
    named = F.when(f["given"] != "", f["given"]).otherwise(
        F.coalesce(choose(region, REGION_PHRASE), F.trim(F.regexp_replace(region, "_", " ")))
    )
    named = F.when(F.lower(named).isin("", "region", "other", "other / unmapped region"), "").otherwise(named)
    return F.struct(
        f["level"].alias("level"), f["hit"].alias("hit"), named.alias("named"),
        F.lower(F.concat_ws(" ", f["hit"], f["sensor"], region)).alias("blob"),
    )


def _advisory_rule(f: Column) -> Column:
    level, hit, named, blob = f["level"], f["hit"], f["named"], f["blob"]

    def mentions(*tokens):
        return reduce(lambda a, b: a | b, [blob.contains(t) for t in tokens])

    oil = (hit == FAULT_LOW_OIL) | mentions("oil")
    hot = (hit == FAULT_OVERHEATING) | mentions("egt", "cht", "exhaust", "head", "cool", "temp")
    shake = (hit == FAULT_VIBRATION) | mentions("vib", "rotat", "crank")
    urgent = (level == "High") | (hit != FAULT_NONE)
    return (
        F.when(urgent & oil, "Inspect oil")
        .when(urgent & hot, "Check cooling")
        .when(urgent & shake, "Inspect rotating assembly")
        .when(level == "High", F.when(named != "", F.concat(F.lit("Inspect "), named)).otherwise("Inspect"))
        .when(
            level == "Medium",
            F.when(named != "", F.concat(F.lit("Monitor / inspect "), named)).otherwise("Monitor"),
        )
        .otherwise("OK")
    )


def go_nogo(action: Column, risk: Column) -> Column:
    act = F.trim(F.coalesce(action, F.lit("")))
    low = F.lower(act)
    level = normalize_risk(risk)
    return (
        F.when(act.isin("", "OK"), F.when(level == "High", "NO-GO").otherwise("GO"))
        .when(low.startswith("inspect") | low.startswith("check"), "NO-GO")
        .when(low.startswith("monitor"), "CAUTION")
        .when(level == "High", "NO-GO")
        .when(level == "Medium", "CAUTION")
        .otherwise("GO")
    )


def work_order_code(action: Column) -> Column:
    act = F.trim(F.coalesce(action, F.lit("")))
    low = F.lower(act)
    return (
        F.when(act.isin("", "OK"), "")
        .when(act.isin(*WORK_ORDER_CODES), choose(act, WORK_ORDER_CODES))
        .when(low.startswith("check") & low.contains("cool"), "COOL")
        .when(low.startswith("monitor"), "MON")
        .otherwise("INSP")
    )


def work_order_id(asset: Column, action: Column) -> Column:
    slug = F.upper(F.regexp_replace(F.regexp_replace(F.trim(asset), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    code = work_order_code(action)
    usable = is_valid_asset(asset) & (code != "") & (slug != "")
    return F.when(usable, F.concat(F.lit("WO-"), slug, F.lit("-"), code)).otherwise("")


# ---------------------------------------------------------------- text, time
def money(c: Column) -> Column:
    """``$1,234`` (two decimals under 10); half-even on whole dollars."""
    size = F.abs(c)
    body = F.when(size >= 10, F.format_number(F.bround(size, 0), 0)).otherwise(F.format_number(size, 2))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), body)


def fixed(c: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals and no grouping."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def iso_utc(ts: Column) -> Column:
    """``2024-01-01T00:00:00Z``; the session time zone is expected to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def last_seen(ts: Column, as_of: Column, stale_after: int = STALE_AFTER_SECONDS) -> dict[str, Column]:
    """Last-seen text, age in seconds, and the stale flag; a missing time is stale."""
    window = stale_after if stale_after >= 1 else STALE_AFTER_SECONDS
    age = (F.unix_micros(as_of) - F.unix_micros(ts)) / 1e6
    return {
        "last_seen": F.coalesce(iso_utc(ts), F.lit("")),
        "last_seen_age_s": F.bround(age, 1),
        "stale": F.coalesce(age > window, F.lit(True)),
        "stale_after_s": F.lit(window),
    }


# ---------------------------------------------------------------- live payloads
def number(c: Column) -> Column:
    """Text to DOUBLE; blank or unreadable text is NULL."""
    return c.try_cast("double")


def looks_aviation(text_of, has_key, pack_id: str | None = None) -> Column:
    """Aviation by pack, by tell-tale keys, or by an id that starts with ``UAV``.

    ``text_of(key)`` and ``has_key(key)`` look a payload key up as columns.
    """
    if pack_id == "aviation_uav_piston":
        return F.lit(True)
    asset = F.coalesce(F.nullif(text_of("machine_id"), F.lit("")), text_of("uav_id"), F.lit(""))
    told = F.upper(asset).startswith("UAV")
    return reduce(lambda acc, k: acc | has_key(k), AVIATION_KEYS, told)


def oil_pressure_psi(text_of, aviation: Column) -> Column:
    """PSI from explicit bar keys, a bar unit field, or small aviation values."""
    bar = F.coalesce(*[number(text_of(k)) for k in BAR_KEYS])
    unit = F.lower(F.coalesce(F.nullif(text_of("oil_pressure_unit"), F.lit("")), text_of("oil_unit"), F.lit("")))
    raw = F.coalesce(number(text_of("oil_pressure")), number(text_of("oil_psi")))
    as_bar = unit.isin("bar", "bars") | (aviation & (raw > 0) & (raw <= BAR_OIL_MAX))
    return (
        F.when(bar.isNotNull(), F.bround(bar * PSI_PER_BAR, 3))
        .when(as_bar, F.bround(raw * PSI_PER_BAR, 3))
        .otherwise(raw)
    )
