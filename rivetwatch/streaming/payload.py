"""Live messages: JSON text to canonical rows and back.  Stateless, batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import EFI_STATUS_FIELDS, LIVE_FIELD_ALIASES, LIVE_FIELDS, LIVE_ID_ALIASES, LIVE_TIME_ALIASES
from ..functions.scalars import looks_aviation, number, oil_pressure_psi

_TEXT_MAP = "map<string,string>"


def decodable(value: Column) -> Column:
    """True for any valid JSON text."""
    return F.try_parse_json(value).isNotNull()


def undecodable(df: DataFrame, value: str = "value") -> DataFrame:
    """Messages for the quarantine sink."""
    return df.filter(~F.coalesce(decodable(F.col(value)), F.lit(False)))


def normalize_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def flatten_payload(payload: Column) -> Column:
    """Key/value pairs with one level of nesting opened: ``{"a": {"b": 1}}`` gives ``a_b`` and ``b``.

    Pairs come newest first, so the first match for a key is the one that wins.
    """
    parts = F.transform(
        F.map_entries(payload),
        lambda e: F.when(
            F.ltrim(e["value"]).startswith("{"),
            F.flatten(
                F.transform(
                    F.map_entries(F.from_json(e["value"], _TEXT_MAP)),
                    lambda x: F.array(
                        _entry(normalize_key(F.concat(e["key"], F.lit("_"), x["key"])), x["value"]),
                        _entry(normalize_key(x["key"]), x["value"]),
                    ),
                )
            ),
        ).otherwise(F.array(_entry(normalize_key(e["key"]), e["value"]))),
    )
    return F.reverse(F.flatten(F.filter(parts, lambda x: x.isNotNull())))


def canonical_rows(
    df: DataFrame,
    value: str = "value",
    topic: str | None = None,
    arrived: str | None = None,
    machine_field: str = "machine_id",
    ts_field: str = "timestamp",
    fallback: str = "mqtt-asset",
    pack_id: str | None = None,
) -> DataFrame:
    """JSON messages to the canonical live row; every other column of ``df`` is kept.

    A missing or unreadable time becomes the arrival time and sets
    ``ts_imputed``.  A message that is valid JSON but not an object keeps its
    text in ``raw`` and gets the fallback id.  Invalid JSON is left out here;
    ``undecodable`` gives those messages.
    """
    others = [c for c in df.columns if c not in LIVE_FIELDS and c not in (value, "raw", "ts_imputed")]
    rows = df.filter(decodable(F.col(value)))
    rows = rows.withColumn("__p", F.coalesce(F.from_json(F.col(value), _TEXT_MAP), F.create_map().cast(_TEXT_MAP)))
    rows = rows.withColumn("__e", flatten_payload(F.col("__p")))
    # Two plain arrays: a lookup is one position search, with no map to build or de-duplicate.
    rows = rows.withColumns({"__k": F.col("__e")["key"], "__v": F.col("__e")["value"]})
    p = F.col("__p")

    def flat(key: str) -> Column:
        return F.get(F.col("__v"), F.array_position("__k", key).cast("int") - 1)

    def either(key: str) -> Column:
        return F.coalesce(flat(key), p[key])

    def has_key(key: str) -> Column:
        return F.array_contains("__k", key) | F.map_contains_key(p, key)

    aviation = looks_aviation(either, has_key, pack_id)
    by_topic = F.element_at(F.split(F.col(topic), "/"), -1) if topic else F.lit(None).cast("string")
    asset = F.coalesce(
        F.nullif(p[machine_field], F.lit("")),
        *[F.nullif(found, F.lit("")) for a in LIVE_ID_ALIASES for found in (p[a], flat(a))],
        F.nullif(by_topic, F.lit("")), F.lit(fallback),
    )
    told = F.coalesce(p[ts_field], *[F.nullif(flat(k), F.lit("")) for k in LIVE_TIME_ALIASES])
    parsed = told.try_cast("timestamp")
    arrival = F.col(arrived).cast("timestamp") if arrived else F.date_trunc("second", F.current_timestamp())

    fields = {}
    for name, aliases in LIVE_FIELD_ALIASES.items():
        if name == "oil_pressure":
            fields[name] = oil_pressure_psi(flat, aviation)
        else:
            fields[name] = F.coalesce(*[number(found) for a in aliases for found in (p[a], flat(a))])
    out = rows.withColumns({f"__{k}": v for k, v in fields.items()})
    final = {k: F.col(f"__{k}") for k in fields}
    final["temperature"] = F.coalesce(final["temperature"], final["cht"])
    final["pressure"] = F.coalesce(final["pressure"], final["oil_pressure"])
    return out.select(
        *others,
        F.coalesce(parsed, arrival).alias("timestamp"),
        asset.alias("machine_id"),
        *[final[k].alias(k) for k in LIVE_FIELD_ALIASES],
        F.col(value).alias("raw"),
        parsed.isNull().alias("ts_imputed"),
    )


def publisher_json(df: DataFrame) -> DataFrame:
    """Canonical rows as publisher JSON: NULL fields are skipped, ``uav_id`` repeats the id."""
    asset = F.nullif(F.col("machine_id").cast("string"), F.lit(""))
    fields = [F.col(c) for c in LIVE_FIELDS if c in df.columns and c not in ("timestamp", "machine_id")]
    body = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        asset.alias("uav_id"), asset.alias("machine_id"), *fields,
    )
    return df.select(F.col("machine_id").alias("key"), F.to_json(body).alias("value"))


def flight_log(df: DataFrame) -> DataFrame:
    """Batch view of the stream's log: raw payload dropped."""
    return df.drop("raw", "ts_imputed")


def efi_status_rows(df: DataFrame) -> DataFrame:
    """Decoded EFI_STATUS messages (one column per message field) under the canonical names.

    Where two fields of the message mean one canonical field, the first known value in the map's order wins.
    """
    mapped = [f for f in EFI_STATUS_FIELDS if f in df.columns]
    names = list(dict.fromkeys(EFI_STATUS_FIELDS[f] for f in mapped))
    fields = [F.coalesce(*[F.col(f) for f in mapped if EFI_STATUS_FIELDS[f] == n]).alias(n) for n in names]
    return df.select(*[c for c in df.columns if c not in mapped and c not in names], *fields)
