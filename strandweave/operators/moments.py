"""One unambiguous UTC minute from two dirty timestamp strings.

Method: an ordered cascade of anchored format patterns with strict parsing. A string is
rewritten once by the first pattern that matches it whole into eight fields (year, month,
day, hour, minute, second, half-day mark, zone); day and clock are then range-checked in
integer arithmetic. Zones come, in this order, from the text (offset, region, abbreviation
as used in the source's region) and from the source's home zone.

Policy for local times. A wall clock is turned into *all* instants that show it in its
zone: none when the clock was skipped, two when it was repeated. A source that counts
both fields as one moment lets the intersection of the candidates of both fields decide;
a field that only gives a day or an hour filters the candidates of the other. A row has a
result only if exactly one minute is left.

Everything is built-in column expressions; the only join is with the table of sources,
whose size is checked by Spark before it is broadcast (no forced hint).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import jit_sized_methods

# English month abbreviations, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Zone abbreviations with their offset in minutes, by the region prefix of the
# source's home zone. "" holds for every region; a region's own meaning goes first.
ABBREVIATIONS = {
    "": {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "JST": 540, "KST": 540, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
         "WET": 0, "WEST": 60, "MSK": 180, "EDT": -240, "PDT": -420, "MDT": -360, "CDT": -300, "PST": -480,
         "MST": -420, "BRT": -180, "BRST": -120, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
         "NZST": 720, "NZDT": 780, "AKST": -540, "AKDT": -480, "HST": -600, "ART": -180, "SGT": 480, "HKT": 480,
         "TRT": 180},
    "America/": {"EST": -300, "CST": -360, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150},
    "Australia/": {"EST": 600, "EDT": 660, "CST": 570, "CDT": 630, "WST": 480},
    "Asia/Kolkata": {"IST": 330},
    "Asia/Calcutta": {"IST": 330},
    "Asia/Jerusalem": {"IST": 120, "IDT": 180},
    "Asia/Dhaka": {"BST": 360},
    "Asia/Shanghai": {"CST": 480},
    "Asia/Taipei": {"CST": 480},
    "Asia/Manila": {"PST": 480},
    "Europe/London": {"BST": 60},
    "Europe/Dublin": {"BST": 60, "IST": 60},
    "Europe/": {"BST": 60, "MEZ": 60, "MESZ": 120},
}

_ZONE = r"(?:\s*(Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?(?:\s*\[[A-Za-z_]+(?:/[A-Za-z_+-]+)*\])?|[A-Za-z]{1,5}|[A-Z][A-Za-z]+(?:/[A-Za-z_+-]+)+))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_MON = r"([A-Za-z]{3})[a-z]*\.?"

#: name -> (anchored pattern, replacement giving y|mo|d|h|mi|s|half|zone). Order matters.
CASCADE: tuple[tuple[str, str, str], ...] = (
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[Tt ]\s*{_CLOCK}{_AMPM}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?$", "$1|$2|$3|$4|$5|$6||"),
    ("slashed", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[Tt ]\s*{_CLOCK}{_AMPM}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    ("compact_t", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,]\d{{1,9}})?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    ("mail", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MON},?\s+(\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    ("month_first", rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    ("either", rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}),?\s+{_CLOCK}{_AMPM}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("cjk", rf"^(\d{{4}})年\s*(\d{{1,2}})月\s*(\d{{1,2}})日\s*(\d{{1,2}})[:時时](\d{{2}})(?:[:分](\d{{2}})?秒?)?{_AMPM}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    # A day or an hour only: no minute, but a filter for the other field.
    ("hour", r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])$", "$1|$2|$3|$4||||"),
    ("day", r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})$", "$1|$2|$3|||||"),
    ("day_mail", rf"^(\d{{1,2}})\s+{_MON},?\s+(\d{{4}})$", "$3|$2|$1|||||"),
    ("day_cjk", r"^(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日$", "$1|$2|$3|||||"),
    ("day_dotted", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3|$2|$1|||||"),
)

#: Numbers counting from 1970, by digits: seconds, milli-, micro-, nanoseconds.
EPOCH = ((r"^\d{9,10}$", 1), (r"^\d{12,13}$", 1_000), (r"^\d{15,16}$", 1_000_000), (r"^\d{18,19}$", 1_000_000_000))
YEARS = (1990, 2099)
REGION = r"^(?:[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+|UTC)$"
OPEN = -(1 << 40)  # stands for "not determined" between two steps


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _num(c: Column) -> Column:
    return c.try_cast("int")


def _month(c: Column) -> Column:
    low = F.lower(c)
    named = F.coalesce(*[F.when(low == F.lit(m), F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    return F.coalesce(_num(c), named)


def _offset_minutes(zone: Column, home: Column) -> Column:
    """Minutes east of UTC that the zone text fixes by itself, else null."""
    num = F.regexp_extract(zone, r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", 0)
    sign = F.when(F.regexp_extract(zone, r"([+-])", 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = _num(F.regexp_extract(zone, r"[+-](\d{1,2})", 1))
    mm = F.coalesce(_num(F.regexp_extract(zone, r"[+-]\d{1,2}:?(\d{2})", 1)), F.lit(0))
    numeric = F.when((num != "") & (hh <= 14) & (mm <= 59), sign * (hh * 60 + mm))
    name = F.upper(zone)
    regional = [
        F.when(home.startswith(prefix) & (name == abbr), F.lit(minutes))
        for prefix, own in sorted(ABBREVIATIONS.items(), key=lambda kv: -len(kv[0])) if prefix
        for abbr, minutes in own.items()
    ]
    common = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS[""].items() for x in kv])
    return F.coalesce(numeric, *regional, F.element_at(common, name))


def _regular(zone: Column) -> Column:
    return F.when(zone.contains("/") & ~zone.contains("["), zone).when(zone.contains("["), F.lit(None))


_BLANK = " \t\n\x0b\f\r\u00a0\u3000"


def _fields(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add ``out``: the eight fields of ``source`` by the first matching pattern of the cascade, and its name.

    A few characters at fixed places leave one pattern (two where a month's name stands) that
    can match at all, so a value is matched once and its fields are taken by the same match.
    No pattern allows a bar, and every replacement has one: a value that matches is changed.
    """
    df = df.withColumn(f"_{out}_s", F.btrim(F.col(source), F.lit(_BLANK)))
    s = F.col(f"_{out}_s")
    at = lambda i: F.substring(s, i, 1)
    digit = lambda c: c.between("0", "9")
    one = lambda i, *cs: at(i).isin(*cs)
    n, clock, year_first = F.length(s), s.contains(":"), digit(at(3))
    packed = digit(at(5)) & year_first
    only = (
        F.when(year_first & (at(5) == "-"), F.when(clock, F.lit("iso")).otherwise(F.lit("day")))
        .when(year_first & (at(5) == "/"), F.when(clock, F.lit("slashed")).otherwise(F.lit("day")))
        .when(one(2, "/", "-") | one(3, "/", "-"), F.lit("either"))
        .when(one(2, ".") | one(3, "."), F.when(clock, F.lit("dotted")).otherwise(F.lit("day_dotted")))
        .when(at(5) == "年", F.when(s.endswith("日"), F.lit("day_cjk")).otherwise(F.lit("cjk")))
        .when(packed & one(9, "T", "t"), F.lit("compact_t"))
        .when(packed & n.isin(12, 14), F.lit("compact"))
        .when(packed & (n == 10), F.lit("hour"))
        .when((packed & n.isin(8, 9)) | (year_first & (at(5) == ".")), F.lit("day"))
        .when(clock, F.lit("mail")).otherwise(F.lit("day_mail"))
    )
    df = df.withColumn(f"_{out}_g", only)
    g = F.col(f"_{out}_g")
    taken = F.coalesce(*[F.when(g == name, F.regexp_replace(s, p, r)) for name, p, r in CASCADE if name != "month_first"])
    df = df.withColumn(f"_{out}_r", taken)
    month_first = next((p, r) for name, p, r in CASCADE if name == "month_first")
    df = df.withColumn(f"_{out}_r2", F.when((g == "mail") & (F.col(f"_{out}_r") == s), F.regexp_replace(s, *month_first)))
    text = F.coalesce(F.col(f"_{out}_r2"), F.col(f"_{out}_r"))
    df = df.withColumn(f"_{out}_k", F.when(text != s, F.when(F.col(f"_{out}_r2").isNotNull(), F.lit("month_first")).otherwise(g)))
    return df.withColumn(f"_{out}_f", F.when(F.col(f"_{out}_k").isNotNull(), F.split(text, r"\|", -1)))


def _parse(df: DataFrame, out: str, home: str, like: str | None = None) -> DataFrame:
    """Add ``{out}_1`` or ``{out}_c``, the candidate UTC minutes, and ``{out}_lo/hi``, the filter of a partial value.

    ``like`` names a field parsed before: if it shows the same wall clock, its result is used again.
    """
    f, k, s = F.col(f"_{out}_f"), F.col(f"_{out}_k"), F.col(f"_{out}_s")
    part = lambda i: f.getItem(i)
    df = df.withColumns({
        f"_{out}_y": _num(part(0)), f"_{out}_a": _month(part(1)), f"_{out}_b": _num(part(2)),
        f"_{out}_h": _num(part(3)), f"_{out}_mi": _num(part(4)), f"_{out}_se": F.coalesce(_num(part(5)), F.lit(0)),
        f"_{out}_half": F.lower(part(6)), f"_{out}_z": F.nullif(part(7), F.lit("")),
    })
    c = lambda n: F.col(f"_{out}_{n}")
    y, a, b, half = c("y"), c("a"), c("b"), c("half")
    hour = F.when(half == "", c("h")).when((c("h") >= 1) & (c("h") <= 12), c("h") % 12 + F.when(half == "p", 12).otherwise(0))
    clock_ok = (hour >= 0) & (hour <= 23) & (c("mi") >= 0) & (c("mi") <= 59) & (c("se") >= 0) & (c("se") <= 60)
    day_ok = lambda m, d: (y >= YEARS[0]) & (y <= YEARS[1]) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_days(y, m))
    minute = F.when(clock_ok, hour * 60 + c("mi")).cast("long")
    wall = F.when(day_ok(a, b), _days(y, a, b))
    swapped = F.when((k == "either") & (a != b) & day_ok(b, a), _days(y, b, a))
    home_c = F.col(home)
    df = df.withColumns({
        f"_{out}_d1": wall, f"_{out}_d2": swapped, f"_{out}_m": minute,
        f"_{out}_off": F.when(c("z").isNotNull(), _offset_minutes(c("z"), home_c)).cast("long"),
    })
    # A zone text that is neither an offset, a known abbreviation nor a region leaves the moment open; home zones are checked where they are read.
    region = _regular(c("z"))
    named = F.when(c("off").isNull() & region.rlike(REGION), region)
    zoned = F.when(F.col(f"_{out}_k").isNotNull(), F.when(c("z").isNull(), home_c).otherwise(named))
    # no pattern of the cascade but that of an hour or a compact minute can match a number that counts from 1970
    epoch = F.when(k.isNull() & F.substring(s, 1, 1).between("0", "9"), F.coalesce(*[F.when(s.rlike(p), F.floor(s.try_cast("decimal(20,0)") / div / 60).cast("long")) for p, div in EPOCH]))
    df = df.withColumns({f"_{out}_zn": zoned, f"_{out}_e": epoch})
    partial = F.col(f"_{out}_k").isin("hour", "day", "day_mail", "day_cjk", "day_dotted")
    # Nearly every value has one candidate that scalar arithmetic gives; arrays are built for the others only.
    df = df.withColumn(f"_{out}_w", c("d1") * 1440 + c("m"))
    local = _steady(c("w"), c("zn"))
    if like:
        other = lambda n: F.col(f"_{like}_{n}")
        same = other("off").isNull() & (c("w") == other("w")) & (c("zn") == other("zn")) & other("d2").isNull()
        local = F.when(same, F.col(f"{like}_1")).otherwise(local)
    one = F.coalesce(c("e"), F.when(c("d2").isNull() & c("w").isNotNull(), F.when(c("off").isNotNull(), c("w") - c("off")).otherwise(local)))
    df = df.withColumn(f"{out}_1", one)
    many = F.when(
        F.col(f"{out}_1").isNull() & k.isNotNull(),
        F.array_distinct(F.concat(_instants(c("d1"), c("m"), c("off"), c("zn")), _instants(c("d2"), c("m"), c("off"), c("zn")))),
    )
    return df.withColumns({
        f"{out}_c": many,
        # what a value without a minute still says: its day, or day and hour, on the wall
        f"{out}_lo": F.when(partial, c("d1") * 1440 + F.when(k == "hour", c("h") * 60).otherwise(0)),
        f"{out}_hi": F.when(partial, c("d1") * 1440 + F.when(k == "hour", c("h") * 60 + 59).otherwise(1439)),
    })


def _steady(wall: Column, zone: Column) -> Column:
    """The UTC minute of a wall clock where the zone's clock does not change within a day of it, else null."""
    ahead = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u * 60), zone)) / 60 - u
    before = ahead(wall - 1440)
    return F.when(zone == "UTC", wall).otherwise(F.when(before == ahead(wall + 1440), wall - before).cast("long"))


def _instants(day: Column, minute: Column, off: Column, zone: Column) -> Column:
    """UTC minutes at which the wall clock (day, minute) is shown: none, one or two."""
    wall = day * 1440 + minute
    guess = (F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall * 60), zone)) / 60).cast("long")
    shown = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u * 60), zone)) == wall * 60
    local = F.filter(F.transform(F.array(*[F.lit(x) for x in (-60, -30, 0, 30, 60)]), lambda x: guess + x), shown)
    return (
        F.when(off.isNotNull() & wall.isNotNull(), F.array(wall - off))
        .when(off.isNull() & zone.isNotNull() & wall.isNotNull(), local)
        .otherwise(F.array().cast("array<bigint>"))
    )


def resolve_minutes(
    actions: DataFrame, feeds: DataFrame, *, date: str = "date", timestamp: str = "timestamp", feed: str = "feed", out: str = "utc_min"
) -> DataFrame:
    """``actions`` with ``out``: the UTC minute (minutes since 1970) of each row, null where it is not determined.

    ``feeds`` has (feed, home_zone). Defined cases: a null, empty or unparsable field says
    nothing; both saying nothing, an unknown zone, a skipped wall clock, or two minutes
    left give null; contradicting fields give null; repeated rows are each resolved; an
    empty table gives an empty table. A column named ``out`` is replaced; any other column
    stays, whatever its name.
    """
    jit_sized_methods(actions.sparkSession)
    names = actions.columns
    # columns named like the helpers below step aside under other names
    aside = {c: f"{uuid.uuid4().hex}_{i}" for i, c in enumerate(names) if c.lower().startswith(("_p4", "__p4", "_home"))}
    for c, other in aside.items():
        actions = actions.withColumnRenamed(c, other)
    keep = [aside.get(c, c) for c in names if c != out]
    homes = feeds.groupBy(F.col("feed").alias("_home_feed")).agg(F.first("home_zone", ignorenulls=True).alias("_home"))
    homes = homes.withColumn("_home", F.when(F.col("_home").rlike(REGION), F.col("_home")))
    df = actions.join(homes, F.col(feed) == F.col("_home_feed"), "left")
    for source, name, like in ((date, "_p4d", None), (timestamp, "_p4t", "_p4d")):
        df = _fields(df, source, name)
        df = _parse(df, name, "_home", like)
    one_a, one_b = F.col("_p4d_1"), F.col("_p4t_1")
    none = F.array().cast("array<bigint>")
    a = F.when(one_a.isNotNull(), F.array(one_a)).otherwise(F.coalesce(F.col("_p4d_c"), none))
    b = F.when(one_b.isNotNull(), F.array(one_b)).otherwise(F.coalesce(F.col("_p4t_c"), none))

    def filtered(cands: Column, lo: Column, hi: Column) -> Column:
        """Candidates whose wall clock lies in the part the other field gives, if one does so in the home zone;
        else those within a day of it, as the other field may be in another zone."""
        wall = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u * 60), F.coalesce(F.col("_home"), F.lit("UTC")))) / 60
        exact = F.filter(cands, lambda u: (wall(u) >= lo) & (wall(u) <= hi))
        near = F.filter(cands, lambda u: (u >= lo - 14 * 60) & (u <= hi + 14 * 60))
        return F.when(lo.isNull() | (F.size(cands) < 2), cands).when(F.size(exact) > 0, exact).otherwise(near)

    open_a = F.col("_p4d_c").isNotNull() & (F.size("_p4d_c") > 0)
    open_b = F.col("_p4t_c").isNotNull() & (F.size("_p4t_c") > 0)
    df = df.withColumn("_p4_1", F.when(one_a.isNotNull() & one_b.isNotNull(), F.when(one_a == one_b, one_a).otherwise(F.lit(OPEN)))
                       .when(one_a.isNotNull() & ~open_b, one_a).when(one_b.isNotNull() & ~open_a, one_b).when(~open_a & ~open_b, F.lit(OPEN)))
    left = (
        F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_intersect(a, b))
        .when(F.size(a) > 0, filtered(a, F.col("_p4t_lo"), F.col("_p4t_hi")))
        .otherwise(filtered(b, F.col("_p4d_lo"), F.col("_p4d_hi")))
    )
    df = df.withColumn("_p4_left", F.when(F.col("_p4_1").isNull(), left))
    minute = F.when(F.col("_p4_1") == OPEN, F.lit(None)).when(F.col("_p4_1").isNotNull(), F.col("_p4_1")).when(F.size("_p4_left") == 1, F.col("_p4_left").getItem(0))
    # A generator, not a projection: a filter on the result must not be pushed into (and copy) the cascade.
    done = df.select(*keep, F.array(minute).alias("_p4_out")).select(*keep, F.explode_outer("_p4_out").alias("_p4_out"))
    back = {other: c for c, other in aside.items()}
    return done.select(*[F.col(c).alias(back.get(c, c)) for c in keep], F.col("_p4_out").alias(out))


def minute_text(minute: Column) -> Column:
    """``YYYY-MM-DDTHH:MMZ`` of minutes since 1970."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(minute / 1440).cast("int"))
    rest = F.pmod(minute, F.lit(1440))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), two(F.floor(rest / 60)), F.lit(":"), two(rest % 60), F.lit("Z"))
