"""Small column functions: timestamps, durations, retention, samples, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: retention days of each record type
RETENTION_DAYS = {"event": 30, "metric": 90, "run": 180, "span": 14, "alert": 365, "notification_intent": 365, "incident": 365, "feedback_item": 365, "feedback_transition": 365, "audit": 730}
#: fixed values: seconds of each duration unit (a day is exactly 86,400 s)
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def milliseconds(t: Column) -> Column:
    """t cut (not rounded) to milliseconds."""
    return F.date_trunc("MILLISECOND", t)


def timestamp_text(t: Column) -> Column:
    """Canonical UTC text with milliseconds; the session's time zone must be UTC."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_canonical_time(t: Column) -> Column:
    return milliseconds(t) == t


def duration_seconds(text: Column) -> Column:
    """Seconds of `<n>[smhd]`; null where the text is no duration."""
    number = F.regexp_extract(text, r"^([1-9]\d{0,8})([smhd])$", 1)
    unit = F.regexp_extract(text, r"^([1-9]\d{0,8})([smhd])$", 2)
    factor = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    return F.when(number != "", number.cast("long") * factor[unit])


def retention_days(record_type: Column) -> Column:
    """Days that a record type is kept; null (refused) for a type without a window."""
    return F.create_map(*[F.lit(x) for kv in RETENTION_DAYS.items() for x in kv])[record_type]


def expires_at(ingested_at: Column, record_type: Column) -> Column:
    return ingested_at + F.make_dt_interval(days=retention_days(record_type))


def sample_outcome(status: Column) -> Column:
    """healthy is a success, degraded a failure, anything else no sample."""
    return F.when(status == "healthy", "success").when(status == "degraded", "failure")


def known_code(code: Column, known: list[str]) -> Column:
    return F.when(code.isin(known), code).otherwise(F.lit("OL_UNEXPECTED"))


def safe_resource_id(name: Column) -> Column:
    """name, or null where it is not fit to be shown."""
    return F.when(name.rlike(SAFE_ID), name)


def position_text(source: Column, device: Column, inode: Column, offset: Column, prefix: Column) -> Column:
    return F.to_json(F.struct(device.alias("device"), inode.alias("inode"), offset.alias("offset"), prefix.alias("prefix_sha256"), source.alias("source")))


POSITION = "device BIGINT, inode BIGINT, offset BIGINT, prefix_sha256 STRING, source STRING"


def parse_position(text: Column) -> Column:
    """The position of a text, null where it isn't one or an offset is negative."""
    p = F.from_json(text, POSITION)
    return F.when((p["offset"] >= 0) & p["prefix_sha256"].rlike("^[0-9a-f]{64}$") & p["source"].isNotNull(), p)


#: rows that a table of configuration may have; it is sent to all tasks only after it was counted
CONFIGURED = 100_000


def configuration(df: DataFrame, most: int = CONFIGURED) -> DataFrame:
    """df, to be sent to all tasks: a table of at most `most` rows, an error beyond that. It is read once, here, whatever uses it."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a table of configuration has at most {most} rows")
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))
