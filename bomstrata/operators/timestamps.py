"""Normalise timestamps of mixed formats, precisions and zones to one UTC instant.

The local time of every row is parsed with JVM-side expressions. Zone rules are a table of offset
intervals in *local* time, exploded to one row per zone and year, so that the as-of join is an equi-join
on (zone, year) followed by an interval test: one matching interval gives the offset, two mean that the
local time occurred twice, none that it never occurred.

The interval table is a function of the public tz database alone (about 600 zones x 97 years, ~58,000
rows, a few MB): it is the only thing broadcast and does not grow with the data. The row side is never
shuffled, so a zone that holds a third of all rows costs nothing extra.
"""

from __future__ import annotations

import functools
import importlib.resources
import os
import struct
import zoneinfo
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.functions.text import has_value, strip

#: Offsets in hours of the zone letters that are understood.
ZONE_LETTERS = {"Z": 0, "UTC": 0, "GMT": 0, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7}
FIRST_YEAR, LAST_YEAR = 1970, 2065
_FAR = 1 << 50


def _tzif(name: str) -> bytes:
    for root in zoneinfo.TZPATH:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    return importlib.resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _transitions(name: str) -> list[tuple[int, int]]:
    """(UTC second from which it holds, offset) of a zone, the first from the beginning of time."""
    raw = _tzif(name)
    at = 0
    for width in (4, 8):
        isut, isstd, leap, n, types, chars = struct.unpack(">6l", raw[at + 20 : at + 44])
        body = at + 44
        size = n * width + n + types * 6 + chars + leap * (width + 4) + isstd + isut
        if width == 4 and raw[at + 4 : at + 5] >= b"2":
            at = body + size
            continue
        break
    times = struct.unpack(f">{n}{'q' if width == 8 else 'l'}", raw[body : body + n * width])
    kinds = raw[body + n * width : body + n * width + n]
    info = [struct.unpack(">lBB", raw[p : p + 6]) for p in range(body + n * width + n, body + n * width + n + types * 6, 6)]
    first = next((x[0] for x in info if not x[1]), info[0][0])
    out = [(-_FAR, first)]
    for t, k in zip(times, kinds):
        if info[k][0] != out[-1][1]:
            out.append((t, info[k][0]))
    rule = raw[body + size :].strip(b"\n") if width == 8 else b""
    if b"," in rule:  # a rule goes on after the listed transitions: walk it in steps shorter than any of its seasons
        zone = zoneinfo.ZoneInfo(name)
        offset = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(zone).utcoffset().total_seconds())
        step, end = 15 * 86400, int(datetime(LAST_YEAR + 2, 1, 1, tzinfo=timezone.utc).timestamp())
        a = max(times[-1], 0) if times else 0
        now = offset(a)
        while a < end:
            b = a + step
            if (then := offset(b)) != now:
                lo, hi = a, b
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
                out.append((hi, then))
                now = then
            a = b
    return out


@functools.lru_cache(maxsize=1)
def zone_intervals() -> list[tuple[str, int, list[tuple[int, int, int]]]]:
    """(lower-case zone, local year, [(local start, local end, offset)]). Year 1969 stands for all before 1970."""
    year = [int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
    out, seen = [], {}
    for name in sorted(zoneinfo.available_timezones()):
        raw = _tzif(name)
        if raw not in seen:  # aliases share their rules
            steps = _transitions(name)
            spans = [(a + o, (steps[i + 1][0] if i + 1 < len(steps) else _FAR) + o, o) for i, (a, o) in enumerate(steps)]
            seen[raw] = [(FIRST_YEAR - 1, [s for s in spans if s[0] < year[0]])]
            for i in range(len(year) - 1):
                seen[raw].append((FIRST_YEAR + i, [s for s in spans if s[0] < year[i + 1] and s[1] > year[i]]))
        out += [(name.lower(), y, s) for y, s in seen[raw]]
    return out


def zone_table(spark: SparkSession) -> DataFrame:
    """The interval table as a DataFrame; its size is fixed by the tz database."""
    import pyarrow as pa

    rows = zone_intervals()
    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("o", pa.int64())]))
    return spark.createDataFrame(pa.table({
        "_zone": pa.array([r[0] for r in rows]), "_zyear": pa.array([r[1] for r in rows], pa.int32()),
        "_spans": pa.array([[dict(zip("abo", x)) for x in r[2]] for r in rows], spans),
    }))


_SEP = "\x01"
_ZONE = r"(?:\s*(Z|[A-Za-z]{2,5}|[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+))?\s*(?:\[([^\]]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: pattern -> replacement that puts year, month, day, hour, minute, second, fraction, half of the day, zone, bracketed zone in order.
_FORMS = (
    (rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:T|\s+){_TIME}(?:\s*(AM|PM)\b)?{_ZONE}$", "123456789A"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:T|\s+)(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(?:\s*(AM|PM)\b)?{_ZONE}$", "123456789A"),
    (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:T|,?\s+){_TIME}(?:\s*(AM|PM)\b)?{_ZONE}$", "321456789A"),
    (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:T|,?\s+){_TIME}(?:\s*(AM|PM)\b)?{_ZONE}$", "312456789A"),
    (rf"(?i)^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})[\s-]+(\d{{4}}),?\s+{_TIME}(?:\s*(AM|PM)\b)?{_ZONE}$", "321456789A"),
    (rf"(?i)^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+{_TIME}(?:\s+([A-Za-z]{{1,5}}|[+-]\d{{2}}:?\d{{2}}))?\s+(\d{{4}})$", "81234560 7"),
)


def _fields(t: Column) -> Column:
    """The ten parts as an array of texts ('' where absent), or null where no form matches."""
    out = F.lit(None).cast("array<string>")
    for pattern, order in reversed(_FORMS):
        if order == "81234560 7":  # month, day, time, zone, year
            repl = _SEP.join(("$8", "$1", "$2", "$3", "$4", "$5", "$6", "", "$7", ""))
        else:
            repl = _SEP.join("$" + ("10" if x == "A" else x) for x in order)
        out = F.when(t.rlike(pattern), F.split(F.regexp_replace(t, pattern, repl), _SEP)).otherwise(out)
    return out


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date; plain integer arithmetic, no calendar object."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _like_years() -> dict[tuple[bool, int], int]:
    """A listed year for each calendar (leap or not, weekday of 1 January); rules repeat with it."""
    import calendar

    return {(calendar.isleap(y), datetime(y, 1, 1).weekday()): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}


def utc_text(day: Column, second: Column, micro: Column) -> Column:
    """``YYYY-MM-DDThh:mm:ss.ffffffZ`` without use of the session's time zone."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60), F.lit("."), F.lpad(micro.cast("string"), 6, "0"), F.lit("Z"))


def normalise_timestamps(df: DataFrame, text: str, site_zone: str, key: str) -> DataFrame:
    """One row per row of ``df`` whose ``text`` holds a value: ``key``, ``outcome``, ``utc_text``.

    Outcomes: ``utc``, ``fold`` (local time occurred twice), ``gap`` (it never occurred), ``nozone`` (no
    zone in the text and none, or none that exists, at the site), ``bad`` (not a full date and time, or an
    impossible one, or an unknown zone in the text).

    Null and null-token texts give no row; repeated rows and ties give a row each; an empty table gives an
    empty table; texts are read whole, however long; only the three named columns are read, so
    other columns of any name do no harm.
    """
    spark = df.sparkSession
    raw = F.col(f"`{text}`")
    d = df.select(F.col(f"`{key}`").alias("_key"), F.translate(strip(raw), "−–", "--").alias("_t"), F.lower(strip(F.col(f"`{site_zone}`"))).alias("_site")).where(has_value(F.col("_t")) & raw.isNotNull())
    t = F.col("_t")
    number = F.when(t.rlike(r"^-?\d{1,19}(?:\.\d+)?$"), t)
    # digits beyond the ninth of a second and repeated blanks say nothing; without them no form is as long as 200 characters
    short = F.regexp_replace(F.regexp_replace(t, r"(\.\d{9})\d+", "$1"), r"\s{2,}", " ")
    d = d.select("_key", "_site", F.when(number.isNull() & (F.length(short) <= 200), _fields(short)).alias("_f"), number.alias("_n"))
    f = lambda i: F.col("_f")[i]
    names = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    word = F.lower(F.substring(f(1), 1, 3))
    at = F.when(F.length(word) == 3, F.position(word, names)).otherwise(0)
    month = F.when(f(1).rlike(r"^\d+$"), _int(f(1))).when((at > 0) & (at % 3 == 1), F.floor((at + 2) / 3).cast("int"))
    zone = F.when(f(9) != "", F.when((f(8) != "") & f(8).rlike(r"^(?:[+-]\d|[Zz]$)"), f(8)).otherwise(f(9))).otherwise(f(8))
    d = d.select(
        "_key", "_site", "_n", _int(f(0)).alias("_y"), month.alias("_mo"), _int(f(2)).alias("_d"), _int(f(3)).alias("_h"), _int(f(4)).alias("_mi"),
        F.coalesce(_int(f(5)), F.lit(0)).alias("_s"), F.rpad(F.substring(f(6), 1, 6), 6, "0").cast("int").alias("_us"), F.upper(f(7)).alias("_half"), zone.alias("_ztext"), F.col("_f").isNotNull().alias("_form"),
    )
    c = F.col
    h12 = c("_half") != ""
    hour = F.when(h12, F.when((c("_h") >= 1) & (c("_h") <= 12), c("_h") % 12 + F.when(c("_half") == "PM", 12).otherwise(0))).otherwise(c("_h"))
    leap = ((c("_y") % 4 == 0) & (c("_y") % 100 != 0)) | (c("_y") % 400 == 0)
    length = F.when(c("_mo") == 2, F.when(leap, 29).otherwise(28)).when(c("_mo").isin(4, 6, 9, 11), 30).otherwise(31)
    ok = c("_form") & (c("_y") >= 1) & c("_mo").between(1, 12) & (c("_d") >= 1) & (c("_d") <= length) & hour.between(0, 23) & (c("_mi") <= 59) & (c("_s") <= 59)
    offset_text = F.regexp_replace(c("_ztext"), ":", "")
    sign = F.when(offset_text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_extract(offset_text, r"^[+-](\d{1,6})$", 1)
    digits = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    digits = F.rpad(digits, 6, "0")
    off_h, off_m = F.substring(digits, 1, 2).cast("int"), F.substring(digits, 3, 2).cast("int")
    offset = F.when((off_h <= 23) & (off_m <= 59), sign * (off_h * 3600 + off_m * 60 + F.substring(digits, 5, 2).cast("int")))
    letters = F.create_map(*[F.lit(x) for k, v in ZONE_LETTERS.items() for x in (k, v * 3600)])
    fixed = F.when(c("_ztext").rlike(r"^[+-]\d"), offset).when(c("_ztext") != "", F.try_element_at(letters, F.upper(c("_ztext"))))
    named = F.when(c("_ztext") == "", c("_site")).when(~c("_ztext").rlike(r"^[+-]\d") & F.try_element_at(letters, F.upper(c("_ztext"))).isNull(), F.lower(c("_ztext")))
    local = days_from_civil(c("_y"), c("_mo"), c("_d")) * 86400 + hour * 3600 + c("_mi") * 60 + c("_s")
    # bare numbers: seconds, milli-, micro- or nanoseconds since 1970 by their size
    whole = F.regexp_extract(c("_n"), r"^-?(\d+)", 1).cast("decimal(20,0)")
    part = F.rpad(F.substring(F.regexp_extract(c("_n"), r"\.(\d+)$", 1), 1, 6), 6, "0").cast("int")
    micros = (
        F.when(whole < F.lit("100000000000").cast("decimal(20,0)"), whole.cast("long") * 1000000 + part)
        .when(whole < F.lit("100000000000000").cast("decimal(20,0)"), whole.cast("long") * 1000 + F.floor(part / 1000))
        .when(whole < F.lit("100000000000000000").cast("decimal(20,0)"), whole.cast("long"))
        .otherwise(F.floor(whole / 1000).cast("long"))
    )
    micros = F.when(c("_n").startswith("-"), -micros).otherwise(micros)
    d = d.select("_key", "_us", "_ztext", "_site", F.when(c("_n").isNotNull(), micros).alias("_micros"), F.when(ok, local).alias("_local"), F.when(ok, c("_y")).alias("_yr"), fixed.cast("long").alias("_fixed"), F.when(ok & fixed.isNull(), named).alias("_zone"))
    # a year after the table stands for a listed year with the same calendar, as rules repeat with it
    jan1 = days_from_civil(c("_yr"), F.lit(1), F.lit(1))
    leap = ((c("_yr") % 4 == 0) & (c("_yr") % 100 != 0)) | (c("_yr") % 400 == 0)
    like = F.element_at(F.create_map(*[F.lit(x) for (lp, wd), y in _like_years().items() for x in (int(lp) * 10 + wd, y)]), F.when(leap, 10).otherwise(0) + F.pmod(jan1 + 3, F.lit(7)).cast("int"))
    zyear = F.when(c("_yr") > LAST_YEAR, like).otherwise(F.greatest(c("_yr"), F.lit(FIRST_YEAR - 1)))
    shift = F.when(c("_yr") > LAST_YEAR, (jan1 - days_from_civil(like, F.lit(1), F.lit(1))) * 86400).otherwise(0)
    d = d.withColumns({"_zyear": F.when(c("_zone").isNotNull(), zyear).cast("int"), "_asof": c("_local") - shift})
    d = d.join(F.broadcast(zone_table(spark)), ["_zone", "_zyear"], "left")
    hits = F.filter(c("_spans"), lambda s: (c("_asof") >= s["a"]) & (c("_asof") < s["b"]))
    d = d.select("_key", "_us", "_micros", "_local", "_fixed", "_ztext", "_zone", "_spans", hits.alias("_hits"))
    outcome = (
        F.when(c("_micros").isNotNull(), "utc")
        .when(c("_local").isNull(), "bad")
        .when(c("_fixed").isNotNull(), "utc")
        .when(c("_ztext").rlike(r"^[+-]\d"), "bad")
        .when(c("_zone").isNull(), "nozone")
        .when(c("_spans").isNull(), F.when(c("_ztext") == "", "nozone").otherwise("bad"))
        .when(F.size("_hits") == 0, "gap").when(F.size("_hits") > 1, "fold").otherwise("utc")
    )
    seconds = F.coalesce(F.floor(c("_micros") / 1000000), c("_local") - F.coalesce(c("_fixed"), F.when(F.size("_hits") == 1, c("_hits")[0]["o"])))
    micro = F.coalesce(F.pmod(c("_micros"), F.lit(1000000)), c("_us").cast("long"), F.lit(0))
    d = d.select("_key", outcome.alias("outcome"), seconds.alias("_sec"), micro.cast("int").alias("_mic"))
    day = F.floor(c("_sec") / 86400)
    return d.select(c("_key").alias(key), "outcome", F.when(c("outcome") == "utc", utc_text(day, c("_sec") - day * 86400, c("_mic"))).otherwise("").alias("utc_text"))
