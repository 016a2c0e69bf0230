"""Timestamps of mixed format, precision and zone to one UTC instant each.

Method: every value is parsed once under every format it fits, which gives its validity mask; a value may be
valid under several (day or month first, compact date or epoch). Each source, declared or not, is a mixture of
the formats, estimated by expectation-maximisation over counts of (source, mask) and shrunk towards the mixture of
all sources by a fixed share of the source's own rows. Weights, posteriors and choices therefore depend on the
proportions of the masks alone, never on the size of the table. A declared day order is binding: it removes the
other order from the mask. The posterior of a value's source chooses its interpretation; one whose best posterior
is below ``min_posterior`` is marked ``unresolved`` and stays ``unreadable``. All parsing and zone arithmetic is
native column expressions, independent of the session time zone; the parsed rows are materialised once and serve
both the mixture and the results.

Defined edge cases: null, blank, ``null`` and ``n/a`` give a null outcome; text of any length that
fits no family is ``unreadable``; an impossible calendar date or clock time is ``unreadable``; a local
time in a fold is ``ambiguous``, in a gap ``nonexistent``; a local time whose source declares no zone
is ``no_zone``, also where its day order stays open; a null source is a source of its own.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltsieve.session import NOTHING, cut, dim_join, holds, strip

#: Usual zone abbreviations in hours from UTC.
ZONE_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AEST": 10, "AEDT": 11, "ACST": 9.5, "ACDT": 10.5, "AWST": 8, "NPT": 5.75, "JST": 9, "NZST": 12, "NZDT": 13,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
INTERPRETATIONS = ["iso", "compact", "dmy", "mdy", "d_mon_y", "mon_d_y", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns"]
BIT = {k: 1 << i for i, k in enumerate(INTERPRETATIONS)}
#: Share of a source's rows by which its mixture is drawn towards that of all sources.
SHRINK = 0.02
ROUNDS = 200

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: *(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+){1,2}))?"
#: name, what the text begins with, pattern, replacement giving |family|a|b|c|hour|minute|second|fraction|half|zone
FAMILIES = [
    ("ymd", r"^\d{4}[-/.]", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[T ] *{_TIME}{_ZONE})?$", "|ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("num", r"^\d{1,2}[-/.]\d", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,?[T ] *{_TIME}{_ZONE})?$", "|num|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("cmp", r"^\d{8}", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE})?$", "|cmp|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("dmn", r"^(?:[A-Za-z]{3,9},? +)?\d{1,2}[ -]", rf"^(?:[A-Za-z]{{3,9}},? +)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?,?[ -](\d{{4}})(?:,? +{_TIME}{_ZONE})?$", "|dmn|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("mnd", r"^[A-Za-z]", rf"^(?:[A-Za-z]{{3,9}},? +)?([A-Za-z]{{3,9}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})(?:,? +{_TIME}{_ZONE})?$", "|mnd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
]
_EPOCH = r"^-?(?:\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})$"
_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
_DAY_US = 86_400_000_000


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a valid Gregorian date, null of an invalid one."""
    return F.unix_date(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), m.cast("string"), F.lit("-"), d.cast("string")).try_cast("date"))


def _shift(us: Column, zone: Column, back: bool = False) -> Column:
    f = F.from_utc_timestamp if back else F.to_utc_timestamp
    return F.unix_micros(f(F.timestamp_micros(us), zone))


def iso_millis(us: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ of microseconds since the epoch, cut to milliseconds."""
    day, rest = F.floor(us / _DAY_US), F.pmod(us, F.lit(_DAY_US))
    part = lambda unit, n, w: F.lpad(F.pmod(F.floor(rest / unit), F.lit(n)).cast("string"), w, "0")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), part(3_600_000_000, 24, 2), F.lit(":"),
        part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit("."), part(1000, 1000, 3), F.lit("Z"),
    )


def _mixture(valid: np.ndarray, n: np.ndarray, towards: np.ndarray | None) -> np.ndarray:
    """Weights of the formats by EM; with ``towards``, SHRINK of the rows are that mixture's."""
    w = np.full(valid.shape[1], 1 / valid.shape[1])
    if n.sum() <= 0:
        return w if towards is None else towards
    for _ in range(ROUNDS):
        r = valid * w
        r = r / np.maximum(r.sum(1, keepdims=True), 1e-300)
        new = (r * n[:, None]).sum(0)
        new /= max(new.sum(), 1e-300)
        if towards is not None:
            new = (1 - SHRINK) * new + SHRINK * towards
        done = np.abs(new - w).max() < 1e-12
        w = new
        if done:
            break
    return w


def _bits(masks: np.ndarray) -> np.ndarray:
    return ((masks.astype(np.int64)[:, None] >> np.arange(len(INTERPRETATIONS))) & 1).astype(float)


def fit_formats(counts: DataFrame) -> DataFrame:
    """(__src, mask, __best, posterior) of every mask that is valid under several formats; counts has __src, mask, n.

    The mixture of all sources comes from one row per mask (a mask has ten bits); each source is fitted in its own
    task from one row per mask, so any number of sources is.
    """
    every = counts.groupBy("mask").agg(F.sum("n").alias("n")).filter("mask > 0").toPandas()  # at most 2 ** 10 rows
    shared = _mixture(_bits(every["mask"].to_numpy()), every["n"].to_numpy(float), None)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = pdf["mask"].to_numpy()
        valid = _bits(masks)
        r = valid * _mixture(valid, pdf["n"].to_numpy(float), shared)
        r = r / np.maximum(r.sum(1, keepdims=True), 1e-300)
        best = r.argmax(1)
        out = pd.DataFrame({"__src": pdf["__src"], "mask": masks, "__best": best, "posterior": r[np.arange(len(best)), best]})
        return out[valid.sum(1) > 1]

    several = counts.filter("mask > 0").withColumn("__open", F.max(F.bit_count("mask") > 1).over(Window.partitionBy("__src"))).filter("__open")
    return several.select("__src", "mask", "n").groupBy("__src").applyInPandas(fit, "__src string, mask int, __best int, posterior double")


def _parse(d: DataFrame) -> DataFrame:
    """Add the validity mask of ``__v`` and what each format makes of it: days, clock, epoch, offset or zone name."""
    plain = F.when(F.col("__v").rlike(_CANONICAL), F.unix_micros(F.col("__v").try_cast("timestamp")))
    d = d.withColumn("__plain", plain)
    v = F.when(F.col("__plain").isNull(), F.col("__v"))
    made = F.lit(None).cast("string")
    for _, begins, pattern, parts in reversed(FAMILIES):
        made = F.when(v.rlike(begins), F.regexp_replace(v, pattern, parts)).otherwise(made)
    d = d.withColumns({"__p": F.when(made.startswith("|"), F.split(made, r"\|")), "__epoch": F.when(v.rlike(_EPOCH), v.try_cast("bigint"))})
    p = lambda i: F.col("__p")[i]
    n = lambda i: p(i).try_cast("int")
    month = F.lower(F.substring(F.when(p(1) == "dmn", p(3)).when(p(1) == "mnd", p(2)), 1, 3))
    clock_ok = F.when(p(5) == "", F.lit(True)).otherwise((n(6) <= 59) & F.coalesce(n(7) <= 59, F.lit(True)) & F.when(p(9) != "", n(5).between(1, 12)).otherwise(n(5) <= 23))
    hour = F.when(F.lower(p(9)) == "p", n(5) % 12 + 12).when(F.lower(p(9)) == "a", n(5) % 12).otherwise(F.coalesce(n(5), F.lit(0)))
    seconds = (hour * 60 + F.coalesce(n(6), F.lit(0))) * 60 + F.coalesce(n(7), F.lit(0))
    micros = F.when(p(8) != "", F.substring(F.rpad(p(8), 6, "0"), 1, 6).cast("bigint")).otherwise(F.lit(0))
    d = d.withColumns({
        "__fam": p(1), "__a": n(2), "__b": n(3), "__c": F.when((p(1) == "num") & (F.length(p(4)) == 2), n(4) + F.when(n(4) < 70, 2000).otherwise(1900)).otherwise(n(4)),
        "__mon": F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month), "__clock": F.when(clock_ok, seconds.cast("bigint") * 1_000_000 + micros), "__zt": F.when(p(10) != "", p(10)),
    })
    fam, a, b, c, mon = (F.col(x) for x in ("__fam", "__a", "__b", "__c", "__mon"))
    free = lambda first: F.col("day_first").isNull() | (F.col("day_first") == first)
    zone, hh, mm = F.col("__zt"), F.substring("__zt", 2, 2).try_cast("int"), F.substring("__zt", -2, 2).try_cast("int")
    signed = F.substring(zone, 1, 1).isin("+", "-")
    offset = F.when((hh <= 18) & ((F.length(zone) == 3) | (mm <= 59)), (hh * 3600 + F.when(F.length(zone) == 3, 0).otherwise(mm * 60)) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    short = F.create_map(*[F.lit(x) for k, h in ZONE_ABBREVIATIONS.items() for x in (k, int(h * 3600))])
    known = sorted(z for z in available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/")))
    # one pair of days: under the first-part-is-day reading (or the only one), and under the month-first reading
    first = F.when(fam.isin("ymd", "cmp"), _days(a, b, c)).when((fam == "num") & free(True), _days(c, b, a)).when(fam == "dmn", _days(c, mon, a)).when(fam == "mnd", _days(c, mon, b))
    d = d.withColumns({
        "__d1": F.when(F.col("__clock").isNotNull(), first), "__d2": F.when((fam == "num") & free(False) & F.col("__clock").isNotNull(), _days(c, a, b)),
        "__off": F.when(signed, offset).otherwise(F.when(zone.isNotNull(), F.try_element_at(short, F.upper(zone)))), "__named": F.when(zone.contains("/") & zone.isin(known), zone),
    })
    digits = F.length(F.ltrim(F.col("__v"), F.lit("-")))
    one = F.when(F.col("__plain").isNotNull(), BIT["iso"]).when(F.col("__d1").isNotNull(), F.coalesce(*[F.when(fam == k, BIT[x]) for k, x in (("ymd", "iso"), ("cmp", "compact"), ("num", "dmy"), ("dmn", "d_mon_y"), ("mnd", "mon_d_y"))])).otherwise(0)
    two = F.when(F.col("__d2").isNotNull(), BIT["mdy"]).otherwise(0)
    epoch = F.when(F.col("__epoch").isNull(), 0).when(digits <= 10, BIT["epoch_s"]).when(digits <= 13, BIT["epoch_ms"]).when(digits <= 16, BIT["epoch_us"]).otherwise(BIT["epoch_ns"])
    d = d.withColumn("mask", (one + two + epoch).cast("int"))
    return d.select("__row", "__src", "__zone", "__v", "__plain", "mask", "__d1", "__d2", "__clock", "__epoch", "__off", "__named", F.col("__zt").isNotNull().alias("__has_zone"))


def normalise_timestamps(df: DataFrame, value: str, source: str, profiles: DataFrame, min_posterior: float = 0.9) -> DataFrame:
    """Add (or replace) ``outcome`` (text), ``instant_us`` (bigint), ``interpretation``, ``posterior`` and ``unresolved`` for column ``value``.

    ``profiles`` has datasource, zone_name, day_first; sources not in it have neither zone nor day order.
    """
    prof = profiles.select(F.lower(strip("datasource")).alias("__src"), F.col("zone_name").alias("__zone"), F.col("day_first").alias("day_first")).dropDuplicates(["__src"])
    # the caller's columns travel as one struct, so none of their names can clash with those used here
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), strip(value).alias("__v"), F.coalesce(F.lower(strip(source)), F.lit("")).alias("__src"))
    packed = packed.withColumn("__v", F.when(~F.lower("__v").isin(*NOTHING), F.col("__v")))
    d = cut(_parse(dim_join(packed, prof, ["__src"])))
    # mixture weights from counts per (source, mask): aggregated before any row leaves its task
    counts = cut(d.filter("mask > 0").groupBy("__src", "mask").agg(F.count("*").alias("n")))
    if counts.filter(F.bit_count("mask") > 1).limit(1).count():
        d = dim_join(d, cut(fit_formats(counts)), ["__src", "mask"])
    else:
        d = d.withColumns({"__best": F.lit(None).cast("int"), "posterior": F.lit(None).cast("double")})
    only = (F.bit_count("mask") == 1)
    d = d.withColumns({"__best": F.when(only, F.log2("mask").cast("int")).otherwise(F.col("__best")), "posterior": F.when(only, 1.0).otherwise(F.col("posterior"))})
    best = F.element_at(F.array(*[F.lit(k) for k in INTERPRETATIONS]), F.col("__best") + 1)
    d = d.withColumn("interpretation", best)
    epoch = F.col("interpretation").startswith("epoch")
    day = F.when(F.col("interpretation") == "mdy", F.col("__d2")).otherwise(F.col("__d1"))
    d = d.withColumns({"__local": F.when(~epoch, day.cast("bigint") * _DAY_US + F.col("__clock")), "__tz": F.when(epoch | F.col("__off").isNotNull() | F.col("__plain").isNotNull(), None).when(F.col("__has_zone"), F.col("__named")).otherwise(F.col("__zone"))})
    d = d.withColumn("__utc", F.when(F.col("__tz").isNotNull(), _shift(F.col("__local"), F.col("__tz"))))
    # the earlier of two instants is the one of the conversion: the clock shows the same time again 30, 60 or 120 minutes later
    again = F.lit(False)
    for minutes in (30, 60, 120):
        again = again | (_shift(F.col("__utc") + minutes * 60_000_000, F.col("__tz"), True) == F.col("__local"))
    d = d.withColumns({"__fold": F.col("__utc").isNotNull() & again, "__gap": F.col("__utc").isNotNull() & (_shift(F.col("__utc"), F.col("__tz"), True) != F.col("__local"))})
    e = F.col("__epoch")
    epoch_us = F.coalesce(*[F.when(F.col("interpretation") == k, x) for k, x in (("epoch_s", e * 1_000_000), ("epoch_ms", e * 1000), ("epoch_us", e), ("epoch_ns", F.floor(e / 1000)))])
    instant = F.coalesce("__plain", F.when(epoch, epoch_us).when(F.col("__off").isNotNull(), F.col("__local") - F.col("__off").cast("bigint") * 1_000_000).otherwise(F.col("__utc")))
    unknown_zone = ~epoch & F.col("__has_zone") & F.col("__off").isNull() & F.col("__named").isNull()
    no_zone = ~epoch & F.col("__plain").isNull() & F.col("__off").isNull() & F.col("__tz").isNull()
    unresolved = F.coalesce(F.col("posterior") < min_posterior, F.lit(False))
    reason = F.when(F.col("__v").isNull(), F.lit(None).cast("string")).when((F.col("mask") == 0) | unknown_zone, "unreadable").when(no_zone, "no_zone").when(unresolved, "unreadable").when(F.col("__gap"), "nonexistent").when(F.col("__fold"), "ambiguous")
    d = d.withColumns({"__reason": reason, "unresolved": unresolved})
    d = d.withColumn("instant_us", F.when(F.col("__v").isNotNull() & F.col("__reason").isNull(), instant))
    d = d.withColumn("outcome", F.coalesce(F.col("__reason"), iso_millis(F.col("instant_us"))))
    results = ["outcome", "instant_us", "interpretation", "posterior", "unresolved"]
    return d.select(*[F.col("__row").getField(c).alias(c) for c in df.columns if c.lower() not in results], *results)


def is_canonical(c: Column | str) -> Column:
    """True for a text that already is a valid YYYY-MM-DDTHH:MM:SSZ."""
    c = F.col(c) if isinstance(c, str) else c
    shape = c.rlike(r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ\z")
    return F.coalesce(shape & F.when(shape, F.substring(c, 1, 10).try_cast("date")).isNotNull(), F.lit(False))


def timestamp_report(records: DataFrame, profiles_table: DataFrame, source_profiles: DataFrame) -> DataFrame:
    """Outcome of each date of the records and profiles that holds something and is not yet canonical.

    The dates of both tables form one column, so that one mixture is fitted per source.
    """
    rec = records.select("row_id", "datasource", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("sourcecreateddate", "sourcemodifieddate")])).alias("x"))
    rec = rec.select(F.lit("unified_records").alias("table_name"), "row_id", "x.field_name", "datasource", "x.value")
    pro = profiles_table.select(F.lit("profiles").alias("table_name"), "row_id", F.lit("metadata.created_at").alias("field_name"), F.col("metadata.source").alias("datasource"), F.col("metadata.created_at").alias("value"))
    both = rec.unionByName(pro).filter(holds("value") & ~is_canonical("value"))
    return normalise_timestamps(both, "value", "datasource", source_profiles).select("table_name", "row_id", "field_name", "outcome")
