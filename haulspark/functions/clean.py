"""Scalar cleaning and formatting functions (C1-C11, C19-C23) as Column
expressions.  All run inside whole-stage codegen; none calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import c, round2

# ---------------------------------------------------------------- fixed values
# US states: full name -> postal code, 50 states (the District of Columbia is
# not in the set, so 'DC' cleans to NULL).
US_STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR",
    "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT",
    "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI", "WYOMING": "WY",
}

# Street-word abbreviations, applied in this order, whole words, any case.
ADDRESS_ABBREVIATIONS = [
    ("Street", "St"), ("Avenue", "Ave"), ("Boulevard", "Blvd"), ("Drive", "Dr"),
    ("Lane", "Ln"), ("Road", "Rd"), ("Circle", "Cir"), ("Court", "Ct"),
    ("Place", "Pl"), ("Square", "Sq"), ("Trail", "Trl"), ("Parkway", "Pkwy"),
    ("North", "N"), ("South", "S"), ("East", "E"), ("West", "W"),
    ("Northeast", "NE"), ("Northwest", "NW"), ("Southeast", "SE"), ("Southwest", "SW"),
]

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ZIP_PATTERN = r"^\d{5}(-\d{4})?$"

# Datetime formats of the route cleaner, tried in this order (strptime
# '%Y-%m-%d %H:%M:%S' ... '%Y/%m/%d'); single-letter fields take 1 or 2 digits.
ROUTE_DATETIME_FORMATS = [
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy",
    "M-d-yyyy H:m:s", "M-d-yyyy H:m", "M-d-yyyy",
    "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d",
]
# Date formats of the collectors' parser, in order: ISO, month-first,
# day-first, with time, ISO 'T', ISO 'T' with fraction.
COLLECTOR_DATE_FORMATS = [
    "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy-M-d H:m:s", "M/d/yyyy H:m:s",
    "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS",
]
SIZE_UNITS = ["B", "KB", "MB", "GB"]

_NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INT_RE = r"^[+-]?[0-9]+$"


# ---------------------------------------------------------------- C1-C4
def clean_phone(x) -> Column:
    """C1: '(XXX) XXX-XXXX' from 10 digits, or 11 digits starting with 1."""
    d = F.regexp_replace(c(x), r"[^0-9]", "")
    return F.when(d.rlike(r"^1?[0-9]{10}$"), F.regexp_replace(d, r"^1?([0-9]{3})([0-9]{3})([0-9]{4})$", "($1) $2-$3"))


def valid_phone(x) -> Column:
    """V8 / Q21: exactly 10 digits after dropping everything else."""
    return F.length(F.regexp_replace(c(x), r"[^0-9]", "")) == 10


def clean_email(x) -> Column:
    """Trimmed, lower-cased, strict pattern, else NULL."""
    e = F.lower(F.trim(c(x)))
    return F.when((e != "") & e.rlike(EMAIL_PATTERN), e)


def clean_zip(x) -> Column:
    """Spaces removed; ddddd or ddddd-dddd, else NULL."""
    z = F.replace(F.trim(c(x)), F.lit(" "), F.lit(""))
    return F.when(z.rlike(ZIP_PATTERN), z)


def _state_map() -> Column:
    kv = []
    for code in sorted(set(US_STATES.values())):
        kv += [F.lit(code), F.lit(code)]
    for name, code in US_STATES.items():
        kv += [F.lit(name), F.lit(code)]
    return F.create_map(*kv)


def clean_state(x) -> Column:
    """C4: postal code or full name (any case) -> code, else NULL."""
    return F.try_element_at(_state_map(), F.upper(F.trim(c(x))))


# ---------------------------------------------------------------- C5 / C9 / C10 / C11
# Words of ASCII letters that other ASCII characters may follow, one blank between words.
PLAIN_WORDS = r"^[A-Za-z]*+[!-@\[-`{-~]*+(?: [A-Za-z]*+[!-@\[-`{-~]*+)*+$"


def title_case(x) -> Column:
    """Python-style title case: every run of letters gets an upper first
    letter and lower rest ('5th' -> '5Th', "o'neil" -> "O'Neil").  ``initcap`` does it
    where every word of an ASCII text is letters, then other characters."""
    runs = F.regexp_extract_all(c(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    parts = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                               F.lower(F.substring(r, 2, 1 << 30)))), "")
    return F.when(c(x).rlike(PLAIN_WORDS), F.initcap(c(x))).otherwise(parts)


def _abbreviation_pattern() -> tuple[str, str, list[tuple[str, str]]]:
    """One pattern for the abbreviations whose letters the word holds in order and
    case, the groups that keep them, and the other abbreviations."""
    words, n, rest = [], 0, []
    for full, abbr in ADDRESS_ABBREVIATIONS:
        at, word = 0, ""
        for ch in abbr:
            i = full.find(ch, at)
            if i < 0:
                break
            word, at = f"{word}{full[at:i]}({ch})", i + 1
        else:
            words.append(word + full[at:])
            n += len(abbr)
            continue
        rest.append((full, abbr))
    return rf"\b(?:{'|'.join(words)})\b", "".join(f"${i + 1}" for i in range(n)), rest


def clean_address(x) -> Column:
    """Collapse blanks, title case, street-word abbreviations (whole words of an
    ASCII text are in title case by then, so one pattern finds most of them)."""
    a = title_case(F.regexp_replace(F.trim(c(x)), r"\s+", " "))
    pattern, kept, rest = _abbreviation_pattern()
    plain = F.regexp_replace(a, pattern, kept)
    for full, abbr in rest:
        plain = F.regexp_replace(plain, rf"\b{full}\b", abbr)
    for full, abbr in ADDRESS_ABBREVIATIONS:
        a = F.regexp_replace(a, rf"(?i)\b{full}\b", abbr)
    return F.when(F.trim(c(x)) != "", F.when(c(x).rlike(r"^\p{ASCII}*+$"), plain).otherwise(a))


def fold_ws(x) -> Column:
    """Trim and collapse whitespace; NULL -> ''."""
    return F.coalesce(F.trim(F.regexp_replace(c(x), r"\s+", " ")), F.lit(""))


def clean_name(x) -> Column:
    """Trimmed title case (cities, people, companies)."""
    return F.when(F.trim(c(x)) != "", title_case(F.trim(c(x))))


def full_address(*parts) -> Column:
    """C11: non-empty whitespace-folded parts joined by ', '."""
    return F.concat_ws(", ", *[F.nullif(fold_ws(p), F.lit("")) for p in parts])


# ---------------------------------------------------------------- C6-C8
# One or two digits of a datetime field.
FIELD_SHAPES = {"M": r"(?:0?[1-9]|1[0-2])", "d": r"(?:0?[1-9]|[12]\d|3[01])", "H": r"(?:[01]?\d|2[0-3])",
                "m": r"[0-5]?\d", "s": r"[0-5]?\d"}


def _shape(fmt: str) -> str:
    """A regular expression for the text shape a datetime pattern accepts
    (digits per field letter, within the field's range), used to skip formats that
    cannot match instead of letting the parser fail, which costs far more."""
    out, i = "^", 0
    while i < len(fmt):
        ch = fmt[i]
        j = i
        while j < len(fmt) and fmt[j] == ch:
            j += 1
        run = fmt[i:j]
        if ch == "y":
            out += r"\d{4}"
        elif ch in FIELD_SHAPES:
            out += FIELD_SHAPES[ch]
        elif ch == "S":
            out += r"\d{1,%d}" % len(run)
        elif ch == "'":
            k = fmt.index("'", i + 1)
            out += fmt[i + 1:k]
            j = k + 1
        else:
            out += "\\" + ch if ch in ".^$*+?()[]{}|/\\" else ch
        i = j
    return out + "$"


# ISO texts of four-digit years from 1000 on, which a cast reads as the formats do, at less cost.
ISO_FORMATS = ("yyyy-M-d", "yyyy-M-d H:m:s")
ISO_SHAPE = r"^[1-9][0-9]{3}-[0-9]{1,2}-[0-9]{1,2}(?: [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?\z"


def _first_parse(x, formats) -> Column:
    """The first format that parses; formats with the same date part are tried only
    on texts that begin with it (of those one at most has a text's shape)."""
    v = c(x)
    if set(ISO_FORMATS) <= set(formats):
        return F.when(v.rlike(ISO_SHAPE), v.try_cast("timestamp").cast("timestamp_ntz")).otherwise(_by_family(v, formats))
    return _by_family(v, formats)


def _by_family(v: Column, formats) -> Column:
    families: dict[str, list[str]] = {}
    for f in formats:
        families.setdefault(f.replace("'T'", " ").split(" ")[0], []).append(f)
    return F.coalesce(*[
        F.when(v.rlike(_shape(day).removesuffix("$")),
               F.coalesce(*[F.when(v.rlike(_shape(f)), F.try_to_timestamp(v, F.lit(f))) for f in of]))
        for day, of in families.items()]).cast("timestamp_ntz")


def clean_datetime(x) -> Column:
    """First of the 12 route formats that parses the whole text."""
    return _first_parse(x, ROUTE_DATETIME_FORMATS)


def parse_date(x) -> Column:
    """The collectors' date parser (month-first before day-first)."""
    return _first_parse(x, COLLECTOR_DATE_FORMATS)


def to_number(x) -> Column:
    """Strip ',', '$' and '%', then a guarded float; NaN/inf -> NULL."""
    plain = F.trim(c(x).cast("string"))
    s = F.translate(plain, ",$%", "")
    return F.when(plain.rlike(_NUM_RE), plain.cast("double")).when(s.rlike(_NUM_RE), s.cast("double"))


def to_float(x) -> Column:
    """Plain float conversion (no symbol stripping)."""
    s = F.trim(c(x).cast("string"))
    return F.when(s.rlike(_NUM_RE), s.cast("double"))


def to_int(x) -> Column:
    """Integer conversion of integer text only."""
    s = F.trim(c(x).cast("string"))
    return F.when(s.rlike(_INT_RE), s.cast("long"))


# ---------------------------------------------------------------- C19-C23
def fmt_currency(x) -> Column:
    """C19: '$1,234.50'; NULL or 0 -> '$0.00'.  ``format_number`` rounds the
    exact binary value half-even, as Python's format does."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(c(x), F.lit(0.0)), 2))


def _plain(v: Column, digits: int) -> Column:
    """Fixed-point text without grouping commas."""
    return F.regexp_replace(F.format_number(v, digits), ",", "")


def fmt_percentage(x) -> Column:
    return F.concat(_plain(F.coalesce(c(x), F.lit(0.0)), 2), F.lit("%"))


def fmt_miles(x) -> Column:
    return F.concat(F.format_number(F.coalesce(c(x), F.lit(0.0)), 1), F.lit(" mi"))


def _fmt1(v: Column) -> Column:
    return _plain(v, 1)


def fmt_file_size(x) -> Column:
    """C20: 1024 steps up to GB, one decimal; 0 -> '0 B'."""
    b = c(x).cast("double")
    k = 1024.0
    e = (F.when(b < k, F.concat(_fmt1(b), F.lit(" B")))
         .when(b < k * k, F.concat(_fmt1(b / k), F.lit(" KB")))
         .when(b < k * k * k, F.concat(_fmt1(b / k / k), F.lit(" MB")))
         .otherwise(F.concat(_fmt1(b / k / k / k), F.lit(" GB"))))
    return F.when(b == 0, F.lit("0 B")).otherwise(e)


def business_days(start, end) -> Column:
    """Monday-Friday dates in [start, end], counted in closed form
    (whole weeks x 5 plus the weekdays of the remainder) -- O(1) per row."""
    a, b = c(start), c(end)
    n = F.datediff(b, a) + 1
    s = F.weekday(a)  # Monday = 0
    full, rem = F.floor(n / 7).cast("int"), (n % 7).cast("int")
    extra = F.greatest(F.lit(0), F.least(rem, 5 - s)) + F.greatest(F.lit(0), s + rem - 7)
    return F.when(n <= 0, F.lit(0)).otherwise(full * 5 + extra)


def business_dates(start, end) -> Column:
    """The Monday-Friday dates in [start, end] themselves."""
    a, b = c(start).cast("date"), c(end).cast("date")
    days = F.when(a <= b, F.sequence(a, b)).when(a > b, F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def duration_parts(start, end) -> Column:
    """Whole hours, minutes and seconds plus totals of end - start."""
    us = F.unix_micros(c(end).cast("timestamp")) - F.unix_micros(c(start).cast("timestamp"))
    secs = us / 1e6
    return F.struct(F.floor(secs / 3600).cast("double").alias("hours"),
                    F.floor(F.pmod(secs, F.lit(3600.0)) / 60).cast("double").alias("minutes"),
                    F.pmod(secs, F.lit(60.0)).alias("seconds"),
                    secs.alias("total_seconds"), (secs / 60).alias("total_minutes"),
                    (secs / 3600).alias("total_hours"))


def period_bounds(d) -> Column:
    """Day, week (Monday start, + 6), month (first to last day)."""
    d = c(d)
    ws = F.date_trunc("week", d).cast("date")
    return F.struct(d.alias("day"), ws.alias("week_start"), F.date_add(ws, 6).alias("week_end"),
                    F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"))
