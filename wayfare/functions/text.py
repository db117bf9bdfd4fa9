"""Text functions of aeronautical sources as Column expressions: identifiers, coordinates, distances, designators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_ident(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.regexp_replace(x, r"\s+", " "))), r"\s+", " ")


def uid(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: the prefix and 16 hex digits of a SHA-256 over the parts, null parts as empty ones."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(16)))


def point_uid(ident: Column, lat: Column, lon: Column, fir: Column, kind: Column, source: Column) -> Column:
    return uid("pt", normalise_ident(ident), F.format_string("%.6f", lat), F.format_string("%.6f", lon), fir, kind, source)


def airway_uid(designator: Column, source: Column, fir: Column) -> Column:
    return uid("awy", normalise_ident(designator), source, fir)


def segment_uid(airway: Column, sequence: Column, start: Column, end: Column) -> Column:
    return uid("seg", airway, sequence, start, end)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it; generated code holds one lambda in place of copies of x."""
    return F.element_at(F.transform(F.array(x), f), 1)


def coordinate(x: Column) -> Column:
    """Compact DMS with the hemisphere in front or behind (2 or 3 degree digits) as degrees; null if malformed or out of range."""
    pattern = r"^([NSEW])?(\d+(?:\.\d+)?)([NSEW])?$"

    def parts(value: Column) -> Column:
        side = F.coalesce(F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(value, pattern, 3), F.lit("")))
        return F.when(value.rlike(pattern), F.struct(side.alias("side"), F.regexp_extract(value, pattern, 2).alias("digits")))

    def degrees(p: Column) -> Column:
        side, digits = p["side"], p["digits"]
        is_lon = side.isin("E", "W")
        n = F.when(is_lon, 3).otherwise(2)
        part = lambda at, width: F.substring(digits, at, width).try_cast("double")
        total = (part(F.lit(1), n) + part(n + 1, F.lit(2)) / 60.0 + part(n + 3, F.length(digits)) / 3600.0) * F.when(side.isin("S", "W"), -1.0).otherwise(1.0)
        most = F.when(is_lon, 180.0).otherwise(90.0)
        long_enough = F.length(F.regexp_extract(digits, r"^\d+", 0)) >= n + 4
        return F.when(side.isNotNull() & long_enough & (F.abs(total) <= most), total)

    return once(once(F.upper(F.regexp_replace(x, r"\s", "")), parts), degrees)


_COMPACT = r"\d+(?:\.\d+)?\s*[NSEW]|[NS]\s*\d+(?:\.\d+)?|[EW]\s*\d+(?:\.\d+)?"
_SYMBOLS = r"(\d{1,3})[°\s]+(\d{1,2})['’′\s]+(\d{1,2}(?:\.\d+)?)[\"'’′″]{0,2}\s*([NSEW])"


def _found_place(x: Column) -> Column:
    def symbol(text: Column, at: int) -> Column:
        def value(p: Column) -> Column:
            total = (p[0].try_cast("double") + p[1].try_cast("double") / 60.0 + p[2].try_cast("double") / 3600.0) * F.when(p[3].isin("S", "W"), -1.0).otherwise(1.0)
            return F.when(F.abs(total) <= F.when(p[3].isin("E", "W"), 180.0).otherwise(90.0), total)

        return once(F.array(*(F.try_element_at(F.regexp_extract_all(text, F.lit(_SYMBOLS), F.lit(g)), F.lit(at)) for g in range(1, 5))), value)

    def pair(text: Column) -> Column:
        def of(tokens: Column) -> Column:
            two = F.size(tokens) >= 2
            return F.struct(*(F.when(two, coordinate(F.try_element_at(tokens, F.lit(at)))).otherwise(symbol(text, at)).alias(n) for at, n in ((1, "lat"), (2, "lon"))))

        return once(F.regexp_extract_all(text, F.lit(f"({_COMPACT})"), F.lit(1)), of)

    return once(F.upper(x), pair)


def coordinate_pair(x: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a text: its first two compact tokens, else its first two symbol DMS tokens."""
    found = _found_place(x)
    return found["lat"], found["lon"]


def coordinate_place(x: Column) -> Column:
    """(lat, lon) of a text as coordinate_pair finds them, as one value; x should be a column of its own.

    Six and seven digits with their hemispheres, a space between, are read by their places, which costs
    little; any other text is searched.
    """
    part = lambda at, n: F.substring(x, at, n).try_cast("double")
    angle = lambda at, n, back: (part(at, n) + part(at + n, 2) / 60.0 + part(at + n + 2, 2) / 3600.0) * F.when(F.substring(x, at + n + 4, 1) == back, -1.0).otherwise(1.0)
    lat, lon = angle(1, 2, "S"), angle(9, 3, "W")
    plain = F.struct(F.when(F.abs(lat) <= 90.0, lat).alias("lat"), F.when(F.abs(lon) <= 180.0, lon).alias("lon"))
    return F.when(x.rlike(r"\A\d{6}[NS] \d{7}[EW]\z"), plain).when(x.isNotNull(), _found_place(x))


def arinc_coordinate(x: Column, degree_digits: int) -> Column:
    """Hemisphere, degrees, minutes, seconds and hundredths without separators, as in fixed-width navigation files."""
    n = degree_digits
    value = F.substring(x, 2, n).try_cast("double") + F.substring(x, 2 + n, 2).try_cast("double") / 60.0 + F.substring(x, 4 + n, 4).try_cast("double") / 360000.0
    return value * F.when(F.substring(x, 1, 1).isin("S", "W"), -1.0).otherwise(1.0)


def last_coordinate(x: Column, width: int) -> Column:
    """The last token of a row that looks like a coordinate with so many digits."""
    return F.try_element_at(F.regexp_extract_all(F.upper(x), F.lit(rf"(\d{{{width}}}(?:\.\d+)?[NSEW]|[NSEW]\d{{{width}}}(?:\.\d+)?)"), F.lit(1)), F.lit(-1))


def distance_nm(x: Column) -> Column:
    """A distance in a text as nautical miles: NN NM, or NN KM by 0.539957; zero and absent ones are null."""
    nm = F.nullif(F.regexp_extract(F.upper(x), r"(\d+(?:\.\d+)?)\s*NM\b", 1), F.lit("")).try_cast("double")
    km = F.nullif(F.regexp_extract(F.upper(x), r"(\d+(?:\.\d+)?)\s*KM\b", 1), F.lit("")).try_cast("double")
    return F.nullif(F.coalesce(nm, km * 0.539957), F.lit(0.0))


def route_designator(x: Column) -> Column:
    """The first route designator of a text; flight levels are none."""
    found = F.regexp_extract_all(F.upper(x), F.lit(r"\b([A-Z]{1,2}\d{1,4}[A-Z]?)\b"), F.lit(1))
    return F.try_element_at(F.filter(found, lambda d: ~d.rlike(r"^FL\d")), F.lit(1))


#: Route types by the leading letters of a designator, in order.
ROUTE_TYPES = ((r"^(L|M|N|P|Q|T|Y|Z|UL|UM|UN|UP|UQ|UT|UY|UZ)\d", "RNAV"), (r"^J\d", "JET"), (r"^V\d", "VICTOR"), (r"^(A|B|G|R|W|H|UA|UB|UG|UR|UW|UH)\d", "ATS"))


def route_type(designator: Column) -> Column:
    return reduce(lambda c, x: c.when(designator.rlike(x[0]), x[1]), ROUTE_TYPES, F.when(designator == "DIRECT", "DIRECT")).otherwise("OTHER")


def is_navaid(x: Column) -> Column:
    return F.upper(x).rlike(r"\b(VOR|DME|NDB|TACAN|VORTAC|DVOR)\b")


#: Marks of minutes and seconds of arc, as typed or typeset.
_MINUTE, _SECOND = "['’′]", "[\"'’′″]{0,2}"
#: A route designator: one or two letters, up to four digits, perhaps a letter.
DESIGNATOR = r"[A-Z]{1,2}\d{1,4}[A-Z]?"


def compact_angle(width: int, hemispheres: str, space: str = "") -> str:
    """Pattern of an angle as digits: degrees of a width, minutes, seconds with a fraction, hemisphere; space may stand between the parts."""
    part = rf"\d{{2}}{space}"
    return rf"\d{{{width}}}{space}{part}\d{{2}}(?:\.\d+)?[{hemispheres}]"


def marked_angle(width: int, hemispheres: str) -> str:
    """Pattern of an angle with marks behind degrees, minutes and seconds."""
    return rf"\d{{1,{width}}}°\s*\d{{1,2}}{_MINUTE}\s*\d{{1,2}}(?:\.\d+)?{_SECOND}\s*[{hemispheres}]"


def strip_markers(x: Column) -> Column:
    """Template markers that some documents glue to values."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[▲△▼∆●○]", ""), r"\{[^{}]*\}|<!--.*?-->", ""))


def decimal_comma(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def flight_level_ft(value: Column, unit: Column) -> Column:
    return F.when(F.upper(unit) == "FL", value * 100).otherwise(value)


#: Aircraft families by codes within the compact name, in order.
AIRCRAFT_RULES = (
    ("B738|B739|B737800|BOEING737800", "B737"),
    ("B763|B767300|BOEING767300", "B767"),
    ("B772|B77W|B777300ER|BOEING777300ER", "B777"),
    ("B788|B789|B7879|BOEING7879|DREAMLINER", "B787"),
    ("A319|A20N|A320200|AIRBUSA320200", "A320"),
    ("A21N|A321NEO|AIRBUSA321NEO", "A321"),
    ("A359|A35K|A350900|AIRBUSA350900", "A350"),
    ("A388|A380800|AIRBUSA380800", "A380"),
    ("A320|AIRBUSA320", "A320"),
    ("A321|AIRBUSA321", "A321"),
    ("B737|BOEING737|737", "B737"),
    ("B767|BOEING767|767", "B767"),
    ("B777|BOEING777|777", "B777"),
    ("B787|BOEING787|787|DREAMLINER", "B787"),
    ("A350|AIRBUSA350", "A350"),
    ("A380|AIRBUSA380", "A380"),
)


def aircraft_type(x: Column) -> Column:
    compact = F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    return reduce(lambda c, r: c.when(compact.rlike(r[0]), r[1]), AIRCRAFT_RULES[1:], F.when(compact.rlike(AIRCRAFT_RULES[0][0]), AIRCRAFT_RULES[0][1])).otherwise(compact)


def normalise_flight_number(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), r"[\s-]+", "")


def equipment_codes(x: Column) -> Column:
    """Equipment codes of 2 to 4 letters and digits in a blank-separated list."""
    return F.filter(F.split(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"\s+"), lambda c: c.rlike("^[A-Z0-9]{2,4}$"))


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def camel_words(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "([A-Z])", " $1"))


def event_kind(x: Column) -> Column:
    return F.when(x.contains("TopOfDescent"), "topOfDescent").when(x.contains("Landing"), "landing").when(x.contains("Takeoff"), "takeoff").otherwise("cruise")


def marker_label(title: Column, region: Column) -> Column:
    return F.when(F.lower(title).rlike("tokyo|haneda|japan"), "JP").when(F.lower(title).rlike("taipei|taoyuan|taiwan"), "TW").otherwise(F.upper(F.left(region, F.lit(2))))


def bytes_label(n: Column) -> Column:
    """A number of bytes in units of a thousand, with one place behind the point."""
    scaled = lambda unit, by: F.concat(F.format_string("%.1f", F.floor(n / by * 10 + 0.5) / 10.0), F.lit(unit))
    return F.when(n < 1000, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1_000_000, scaled(" KB", 1e3)).when(n < 1_000_000_000, scaled(" MB", 1e6)).otherwise(scaled(" GB", 1e9))


def distance_label(metres: Column) -> Column:
    """Whole kilometres from one on, else whole metres."""
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(metres >= 1000, F.concat(whole(metres / 1000.0), F.lit(" km"))).otherwise(F.concat(whole(metres), F.lit(" m")))


def duration_label(seconds: Column) -> Column:
    """h:mm of a duration, rounded to minutes."""
    minutes = F.greatest(F.lit(0), F.floor(seconds / 60.0 + 0.5)).cast("long")
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def coordinate_label(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2f%s, %.2f%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def file_name(url: Column) -> Column:
    """Last part of a URL's path with unusual characters as underscores."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1), r"[^A-Za-z0-9._-]+", "_")


def is_bot_wall(html: Column) -> Column:
    """Whether a page's first 4096 characters hold a mark of bot protection (fixed values)."""
    return F.lower(F.left(html, F.lit(4096))).rlike("captcha|radware|bot-protection")


def direction_code(odd: Column, even: Column) -> Column:
    """Directions in which an airway's levels are flown: by odd ones, by even ones, both, or null."""
    has = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    return F.when(has(odd) & has(even), "bidirectional").when(has(odd), "odd").when(has(even), "even")


def route_of_file(name: Column) -> Column:
    """Route designator in the name of a publication's route page, or null."""
    return F.nullif(F.regexp_extract(name, r"IN-ENR-3\.\d([A-Z]{1,2}\d{1,4}[A-Z]?)-en-GB\.html$", 1), F.lit(""))


def checksum_label(parts: Column) -> Column:
    """The first 24 characters of joined digests, without the name of the digest in front."""
    return F.left(F.regexp_replace(F.array_join(parts, "|"), "^sha256:", ""), F.lit(24))


#: Names of the sectors of the view in the language of the display.
WINDOW_NAMES = {"front": "正前方", "right-front": "右前方", "right side": "右側", "right-rear": "右後方", "left-rear": "左後方", "left side": "左側", "left-front": "左前方"}


def window_name(direction: Column) -> Column:
    """Name of a sector; one without a name stands for itself."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in WINDOW_NAMES.items() for x in kv))[direction], direction)


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a hash of the characters of a text of the basic plane, as a long."""
    units = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)
    step = lambda h, c: h.bitwiseXOR(c.cast("long")) * F.lit(16777619) % F.lit(1 << 32)
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)


def seeded(seed: Column, n: int) -> Column:
    """The n-th number from 0 to 1 of a linear congruential generator with a seed."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.pmod(seed.cast("long"), F.lit(1 << 32)), lambda s, _: (s * 1664525 + 1013904223) % F.lit(1 << 32))
    return state / 4294967295.0
