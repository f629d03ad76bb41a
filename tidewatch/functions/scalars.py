"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Litres per minute, bar and litres in other units, with digits shown.
FLOW_UNITS = {"lpm": (1.0, 1), "gpm": (0.264172, 2), "m3h": (0.06, 3)}
PRESSURE_UNITS = {"psi": (1.0, 1), "bar": (0.0689476, 2), "kpa": (6.89476, 0)}
VOLUME_UNITS = {"l": (1.0, 1), "gal": (0.264172, 1), "m3": (0.001, 3)}
#: Fixed value: the namespace of object identifiers, for name-based identifiers of version 5.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def number(text: Column, default: float | None = None) -> Column:
    """The number a text spells, else the default."""
    return F.coalesce(text.try_cast("double"), F.lit(default).cast("double"))


def clean_flow(flow: Column) -> Column:
    """0 for readings that are not finite, negative, above 200 or below 0.01 (in litres a minute); null is 0."""
    return F.when(flow.isNull() | F.isnan(flow) | (flow > 200) | (flow < 0.01), 0.0).otherwise(flow)


def clean_pressure(psi: Column) -> Column:
    """0 for readings that are not finite, negative or above 500."""
    return F.when(psi.isNull() | F.isnan(psi) | (psi < 0) | (psi > 500), 0.0).otherwise(psi)


def pressure_from_volts(volts: Column) -> Column:
    """The line through (0.0 V, -9.4359) and (3.1 V, 104.1172), clamped to 0..104, two digits."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(104.0), (volts / 3.1) * (104.1172 + 9.4359) - 9.4359)), 2)


def flow_from_counts(counts_per_minute: Column, per_litre: float = 396.0) -> Column:
    return counts_per_minute / per_litre


def half_steps(x: Column) -> Column:
    return F.round(x * 2, 0) / 2


def hour_circle(hour: Column) -> tuple[Column, Column]:
    angle = hour * (2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def resistance(avg_flow: Column, pressure_delta: Column, transient: Column) -> Column:
    """Pressure drop over flow, where a transient with a drop came with a flow of at least 0.05."""
    return F.when((avg_flow >= 0.05) & transient & (pressure_delta > 0), pressure_delta / avg_flow)


def volume(measured: Column, avg_flow: Column, seconds: Column) -> Column:
    return F.coalesce(measured, avg_flow * seconds / 60)


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends; 'fixture' if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "fixture").otherwise(F.coalesce(out, F.lit("fixture")))


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def items(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def version_at_least(text: Column, least: tuple[int, ...]) -> Column:
    """Whether the dotted number a text starts with is at least that version; texts without one pass."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*v?(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(digits, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    padded = F.transform(F.sequence(F.lit(0), F.lit(len(least) - 1)), lambda i: F.coalesce(F.get(parts, i), F.lit(0)))
    return (digits == "") | (padded >= F.array(*[F.lit(x) for x in least]))


def uuid5(name: Column) -> Column:
    """The name-based identifier (version 5) of a name in the object identifier namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(name, "UTF-8")))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def event_id(circuit: Column, start_ts: Column) -> Column:
    """The same event has the same identifier whenever it is read again."""
    return uuid5(F.concat_ws("/", circuit, F.date_format(start_ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")))


def in_unit(value: Column, unit: str, units: dict[str, tuple[float, int]]) -> Column:
    """The value in a display unit, rounded to its digits; an unknown unit is the first one."""
    factor, digits = units.get(unit, next(iter(units.values())))
    return F.round(value * factor, digits)


def confidence_level(members: Column) -> Column:
    return F.when(members < 50, "low").when(members < 200, "medium").otherwise("high")


def anomaly_score(confidence: Column, reason: Column) -> Column:
    """1 - confidence; 1.0 for an unmatched event without a reason; null where a match was rejected."""
    return F.when(confidence.isNotNull(), F.round(1 - confidence, 3)).when(reason.isNull(), 1.0)


def nth_weekday(month_start: Column, weekday: int, n: int) -> Column:
    """The date of the n-th weekday (Monday 0) of a month; n = -1 is the last one."""
    first = F.date_add(month_start.cast("date"), (F.lit(weekday + 7) - F.weekday(month_start)) % 7)
    if n > 0:
        return F.date_add(first, 7 * (n - 1))
    last = F.last_day(month_start)
    return F.date_sub(last, (F.weekday(last) + F.lit(7 - weekday)) % 7)


def minimum_events(full_baths: Column, half_baths: Column, floors: Column) -> tuple[Column, Column]:
    """(expected fixtures, events to collect before training ends)."""
    fixtures = 3.2 * full_baths + 1.2 * half_baths + 0.5 * floors + 2
    return fixtures, F.greatest(F.floor(fixtures * 15), F.lit(50))
