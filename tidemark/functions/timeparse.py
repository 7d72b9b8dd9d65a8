"""All readings of a written timestamp, as an array built from JVM-side expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names (English, German, French, Spanish) and zone abbreviations in minutes.
MONTHS = {
    1: "jan january januar janvier enero janv ene",
    2: "feb february februar février fevrier febrero févr fév",
    3: "mar march märz maerz mrz mars marzo",
    4: "apr april avril abril avr abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet julio juil",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre",
    10: "oct october oktober octobre octubre okt",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre decembre diciembre dez dic déc",
}
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "CET": 60, "CEST": 120, "BST": 60, "IST": 330, "WET": 0, "WEST": 60, "EET": 120, "EEST": 180,
}

BLANK = r"[\s ]"
TAIL = (
    r"^(.*?\d)(?:[T,]|\s)\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?(?![A-Za-z]))?"
    r"\s*(Z|z|[+-]\d{2}(?::?\d{2})?|\[?[A-Za-z]+(?:[/_+-][A-Za-z0-9_]+)*\]?)?$"
)
COMPACT = r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,]\d+)?(Z|z|[+-]\d{2}:?\d{2})?$"
YMD, EIGHT = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", r"^(\d{4})(\d{2})(\d{2})$"
DMY_NAME = r"^(\d{1,2})(?:st|nd|rd|th|\.|º|er)?[\s-]*(?:de\s+|of\s+)?(\p{L}{3,})\.?[\s,-]*(?:de\s+)?(\d{4}|\d{2})$"
MDY_NAME = r"^(\p{L}{3,})\.?[\s-]*(\d{1,2})(?:st|nd|rd|th)?[\s,-]+(\d{4})$"
NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$"
DAY = 86_400


def zone_names(spark: SparkSession) -> list[str]:
    """Region zones that the JVM knows; only these may reach to_utc_timestamp, which raises on others."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray() if "/" in z)


def _sql_map(pairs: dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970, or NULL unless the three name a day of the years 1900 to 2100."""
    first = F.when(y.between(1900, 2100) & m.between(1, 12), F.make_date(y, F.when(m.between(1, 12), m), F.lit(1)))
    return F.when(d.between(1, F.day(F.last_day(first))), F.unix_date(first) + d - 1)


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, _int(text) + 2000).when(F.length(text) == 4, _int(text))


def day_text(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int")).cast("string")


def instant_text(seconds: Column) -> Column:
    """UTC seconds as YYYY-MM-DDTHH:MM:SSZ, whatever the session's zone."""
    rest = F.pmod(seconds, F.lit(DAY))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        day_text(F.floor(seconds / DAY)), F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60),
        F.lit(":"), two(rest % 60), F.lit("Z"),
    )


def utc_readings(local: Column, zone: Column) -> Column:
    """The UTC seconds at which zone's clocks show local (seconds as if UTC): none in a gap, two in a fold."""
    back = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone))
    u = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))
    shifts = F.array(*[F.lit(x) for x in (-7200, -3600, -1800, 0, 1800, 3600, 7200)])
    return F.filter(F.transform(shifts, lambda s: u + s), lambda x: back(x) == local)


def with_readings(df: DataFrame, value: str, zone: str, order: str, zones: list[str], out: str = "cands") -> DataFrame:
    """Add out, array<struct<norm, t, fmt, cost>>: every valid reading of the column value.

    zone and order name columns with the source's declared zone and day-month-year order (NULL if
    unknown). Readings against a declared convention cost AGAINST; where a local time is read in a zone
    that repeats it, both instants are listed. Each stage is a projection of its own, so that no regular
    expression is evaluated once per use.
    """
    s = F.regexp_replace(F.col(value), rf"^{BLANK}+|{BLANK}+$", "")
    s = F.regexp_replace(s, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,\s*", "")
    df = df.withColumn("_s", s)
    s = F.col("_s")
    df = df.withColumns({"_timed": s.rlike(TAIL), "_packed": s.rlike(COMPACT)})
    timed, packed = F.col("_timed"), F.col("_packed")
    part = lambda k: F.when(timed, F.regexp_extract(s, TAIL, k)).otherwise("")
    pack = lambda k: F.when(packed, F.regexp_extract(s, COMPACT, k)).otherwise("")
    either = lambda p, t: F.when(packed, pack(p)).otherwise(part(t))
    df = df.withColumns(
        {
            "_h": _int(either(4, 2)), "_mi": _int(either(5, 3)), "_sec": either(6, 4), "_pm": F.lower(F.substring(part(5), 1, 1)),
            "_date": F.when(packed, F.concat(pack(1), pack(2), pack(3))).when(timed, F.rtrim(F.regexp_replace(part(1), r",$", ""))).otherwise(s),
            "_named": F.regexp_replace(either(7, 6), r"[\[\]]", ""),
        }
    )

    # time of day in seconds, NULL if impossible; and the day: one reading, or one per order of its numbers
    h, mi, pm, date, named = (F.col(c) for c in ("_h", "_mi", "_pm", "_date", "_named"))
    h = F.when(pm == "", h).when(h.between(1, 12), h % 12 + F.when(pm == "p", 12).otherwise(0))
    sec = F.when(F.col("_sec") == "", 0).otherwise(_int(F.col("_sec")))
    off = r"^([+-])(\d{2}):?(\d{2})?$"
    df = df.withColumns(
        {
            "_clock": F.when(h.between(0, 23) & mi.between(0, 59) & sec.between(0, 59), h * 3600 + mi * 60 + sec),
            "_kind": F.when(date.rlike(YMD), "iso").when(date.rlike(EIGHT), F.when(packed, "packed").otherwise("compact"))
            .when(date.rlike(DMY_NAME), "name").when(date.rlike(MDY_NAME), "name2").when(date.rlike(NUMERIC), "numeric"),
            "_oh": _int(F.regexp_extract(named, off, 2)), "_om": F.coalesce(_int(F.regexp_extract(named, off, 3)), F.lit(0)),
            "_sign": F.when(F.regexp_extract(named, off, 1) == "-", -1).otherwise(1),
        }
    )
    kind = F.col("_kind")
    pattern = {"iso": (YMD, 1, 3, 4), "packed": (EIGHT, 1, 2, 3), "compact": (EIGHT, 1, 2, 3), "name": (DMY_NAME, 3, 2, 1), "name2": (MDY_NAME, 3, 1, 2), "numeric": (NUMERIC, 4, 3, 1)}
    pick = lambda i: F.coalesce(*[F.when(kind == k, F.regexp_extract(date, p[0], p[i])) for k, p in pattern.items()])
    df = df.withColumns({"_y": pick(1), "_m": pick(2), "_d": pick(3)})
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    months = _sql_map({n: k for k, names in MONTHS.items() for n in names.split()})
    month = F.when(kind.startswith("name"), months[F.lower(m)]).otherwise(_int(m))
    df = df.withColumns({"_one": _days(_year(y), month, _int(d)), "_two": F.when(kind == "numeric", _days(_year(y), _int(d), _int(m)))})
    against = lambda o: F.when(F.col(order) == o, 0.0).when(F.col(order).isNull(), 1.0).otherwise(AGAINST)
    one = lambda days, fmt, cost: F.struct(days.alias("d"), fmt.alias("f"), cost.alias("c"))
    numeric = F.array(
        one(F.col("_one"), F.lit("DMY"), against("DMY")),
        one(F.col("_two"), F.lit("MDY"), against("MDY")),
        one(F.when(F.length(y) == 2, _days(_year(F.lpad(d, 2, "0")), _int(m), _int(y))), F.lit("YMD"), against("YMD")),
    )
    days = F.when(kind == "numeric", numeric).when(kind.isNotNull(), F.array(one(F.col("_one"), F.regexp_replace(kind, "2", ""), F.lit(0.0))))

    # the zone: an offset, an abbreviation, a region, or the source's own
    oh, om = F.col("_oh"), F.col("_om")
    minutes = F.when(oh.isNotNull(), F.when((om < 60) & (oh * 60 + om <= 840), F.col("_sign") * (oh * 60 + om))).otherwise(
        _sql_map(ZONE_MINUTES)[F.upper(named)]
    )
    listed = ", ".join(f"'{z}'" for z in [*zones, "UTC"])
    df = df.withColumn("_region", F.when(named == "", F.col(zone)).when(named.contains("/"), named))
    region = F.when(F.expr(f"_region IN ({listed})"), F.col("_region"))
    count = s.try_cast("decimal(20,0)")
    unit = F.when(s.rlike(r"^-?\d{9,10}$"), 1).when(s.rlike(r"^\d{13}$"), 1_000).when(s.rlike(r"^\d{16}$"), 1_000_000)
    unit = unit.when(s.rlike(r"^\d{19}$"), 1_000_000_000)
    df = df.withColumns({"_days": F.filter(days, lambda x: x["d"].isNotNull()), "_min": minutes, "_region": region, "_unit": unit})
    df = df.withColumn("_epoch", F.floor(count / F.col("_unit")).cast("bigint"))

    local = lambda x: x["d"].cast("bigint") * DAY + F.col("_clock")
    with_utc = F.transform(
        "_days",
        lambda x: F.struct(
            F.when(F.col("_min").isNotNull(), F.array(local(x) - F.col("_min") * 60))
            .when(F.col("_region").isNotNull(), utc_readings(local(x), F.col("_region"))).alias("u"),
            x["f"].alias("f"), x["c"].alias("c"),
        ),
    )
    df = df.withColumn("_utc", F.when((packed | timed) & F.col("_clock").isNotNull(), with_utc))
    reading = lambda norm, t, fmt, cost: F.struct(norm.alias("norm"), t.alias("t"), fmt.alias("fmt"), cost.alias("cost"))
    epoch = F.col("_epoch")
    found = (
        F.when(epoch.between(-2_208_988_800, 4_133_980_799), F.array(reading(instant_text(epoch), epoch, F.lit("count"), F.lit(0.0))))
        .when(
            packed | timed,
            F.flatten(
                F.transform("_utc", lambda x: F.transform(x["u"], lambda u: reading(instant_text(u), u, F.concat(x["f"], F.lit("+time")), x["c"])))
            ),
        )
        .otherwise(F.transform("_days", lambda x: reading(day_text(x["d"]), x["d"].cast("bigint") * DAY, x["f"], x["c"])))
    )
    none = F.array().cast("array<struct<norm:string,t:bigint,fmt:string,cost:double>>")
    df = df.withColumn(out, F.coalesce(F.filter(found, lambda x: x["norm"].isNotNull()), none))
    return df.drop(*[c for c in df.columns if c in SCRATCH])


SCRATCH = set("_s _timed _packed _h _mi _sec _pm _date _named _clock _kind _oh _om _sign _y _m _d _one _two _days _min _region _unit _epoch _utc".split())

#: Cost of a reading against its source's declared convention: more than switches and jumps on both sides can save.
AGAINST = 20.0
