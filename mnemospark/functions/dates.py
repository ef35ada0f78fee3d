"""Parsing of timestamp strings in many forms, as Column expressions.

Every pattern rewrites a matching string to one canonical form

    T|year|month|day|hour|minute|second|fraction|am-pm|zone      (a date with a time)
    E|digits                                                     (seconds since 1970 in some precision)
    D|                                                           (a day)

so each string passes each regular expression once, whatever the number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"

#: Month names by their first letters in English, German, French and Spanish.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jänner": 1, "janvier": 1, "enero": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "febrero": 2,
    "mar": 3, "march": 3, "märz": 3, "mrz": 3, "mars": 3, "marzo": 3,
    "apr": 4, "april": 4, "avril": 4, "abril": 4,
    "may": 5, "mai": 5, "mayo": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7, "julio": 7,
    "aug": 8, "august": 8, "août": 8, "agosto": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9,
    "oct": 10, "okt": 10, "october": 10, "oktober": 10, "octobre": 10, "octubre": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "dez": 12, "december": 12, "dezember": 12, "décembre": 12, "diciembre": 12,
}

#: Zone abbreviations and their offsets in minutes. Abbreviations that
#: several regions use for different offsets (IST, AST, ...) are left out.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EAT": 180, "CAT": 120, "WAT": 60, "SAST": 120,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540, "NPT": 345, "PKT": 300,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

_OFFSET = r"(?:UTC|GMT)?[+\-−]\d{2}:?\d{2}"
_ZONE = rf"(Z|{_OFFSET}(?:\[[A-Za-z0-9_+\-/]+\])?|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|[A-Z]{{1,5}})"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_AMPM = r"(?: ?([AaPp])\.?[Mm]\b\.?)?"
_WORD = r"([\p{L}]{3,12})\.?"
_DAYNAME = r"(?: \([\p{L}]{2,10}\.?\))?"


def _canonical(*parts: str) -> str:
    return SEP.join(("T", *parts))


#: (pattern over the whole trimmed string, canonical form)
_FORMS: list[tuple[str, str]] = [
    (rf"^(\d{{4}})[\-/](\d{{1,2}})[\-/](\d{{1,2}}){_DAYNAME}(?:[Tt]| |, ){_TIME}{_AMPM}\s?(?:\(?{_ZONE}\)?)?$", _canonical("$1", "$2", "$3", "$4", "$5", "$6", "$7", "$8", "$9")),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?\s?(?:{_ZONE})?$", _canonical("$1", "$2", "$3", "$4", "$5", "$6", "$7", "", "$8")),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_TIME}{_AMPM}(?: \(?{_ZONE}\)?)?$", _canonical("$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9")),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_TIME}(?: Uhr)?(?: \(?{_ZONE}\)?)?$", _canonical("$3", "$2", "$1", "$4", "$5", "$6", "$7", "", "$8")),
    (rf"^{_TIME}{_AMPM}(?: \(?{_ZONE}\)?)? on (\d{{1,2}}) {_WORD},? (\d{{4}})$", _canonical("$9", "$8", "$7", "$1", "$2", "$3", "$4", "$5", "$6")),
    (rf"^(?:[\p{{L}}]{{2,10}}\.?, ?)?(\d{{1,2}})\.? {_WORD},? (\d{{4}}),? {_TIME}{_AMPM}(?: Uhr)?(?: \(?{_ZONE}\)?)?$", _canonical("$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9")),
    (rf"^(?:[\p{{L}}]{{2,10}}\.?, ?)?{_WORD} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),? (?:at )?{_TIME}{_AMPM}(?: \(?{_ZONE}\)?)?$", _canonical("$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9")),
    (r"^(\d{10}|\d{13}|\d{16}|\d{19})$", f"E{SEP}$1"),
    (rf"^(?:\d{{4}}[\-/]\d{{1,2}}[\-/]\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}\.? {_WORD},? \d{{4}}|{_WORD} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|\d{{8}})$", f"D{SEP}"),
]


def trimmed(value: Column) -> Column:
    """Without blanks of any kind around it; inner blanks become plain spaces."""
    return F.trim(F.regexp_replace(value, r"[\s\u0085\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]+", " "))


def canonical(value: Column) -> Column:
    """The canonical form, or the trimmed string itself where no pattern matches."""
    out = trimmed(value)
    for pattern, form in _FORMS:
        out = F.regexp_replace(out, pattern, form)
    return out


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def parsed(value: Column) -> Column:
    """``struct(kind, local_us, zone, offset_min, year)`` of a timestamp string.

    kind: ``time`` (a date and a time of day), ``epoch``, ``day``, ``impossible`` (such a
    date or time doesn't exist), ``text`` (anything else), ``blank`` or ``null``.
    local_us: microseconds since 1970 as the string's own clock shows them (UTC for epochs).
    offset_min: offset from UTC that the string itself gives; zone: a region name it gives,
    or an abbreviation that isn't known.
    """
    parts = F.split(canonical(value), SEP)
    return _decoded(value, parts)


def _decoded(value: Column, parts: Column) -> Column:
    tag, at = parts[0], lambda i: F.get(parts, F.lit(i))
    num = lambda i: at(i).try_cast("int")
    month = F.coalesce(num(2), _lookup(MONTHS, F.lower(at(2))))
    y, d = num(1), num(3)
    half = F.lower(at(8))
    hour = (
        F.when(half == "", num(4))
        .when(num(4).between(1, 12), num(4) % 12 + F.when(half == "p", 12).otherwise(0))
    )
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    second = F.coalesce(num(6), F.lit(0))
    micro = F.coalesce(F.substring(F.rpad(at(7), 6, "0"), 1, 6).try_cast("bigint"), F.lit(0))
    valid = F.coalesce(
        (y >= 1) & month.between(1, 12) & d.between(1, last) & hour.between(0, 23) & num(5).between(0, 59) & second.between(0, 59),
        F.lit(False),
    )
    local = days_from_civil(y, month, d) * 86_400_000_000 + (hour * 3600 + num(5) * 60 + second).cast("bigint") * 1_000_000 + micro
    digits = at(1)
    epoch = (
        F.when(F.length(digits) == 10, digits.try_cast("bigint") * 1_000_000)
        .when(F.length(digits) == 13, digits.try_cast("bigint") * 1_000)
        .when(F.length(digits) == 16, digits.try_cast("bigint"))
        .when(F.length(digits) == 19, F.floor(digits.try_cast("decimal(19,0)") / 1_000).cast("bigint"))
    )
    zone = at(9)
    sign = F.when(F.regexp_extract(zone, r"([+\-−])\d{2}:?\d{2}", 1) == "+", 1).otherwise(-1)
    hhmm = F.regexp_replace(F.regexp_extract(zone, r"[+\-−](\d{2}:?\d{2})", 1), ":", "")
    numeric = F.when((hhmm != "") & (F.substring(hhmm, 1, 2).try_cast("int") <= 18) & (F.substring(hhmm, 3, 2).try_cast("int") < 60), sign * (F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 3, 2).try_cast("int")))
    offset = F.coalesce(numeric, _lookup(ABBREVIATIONS, zone))
    kind = (
        F.when(value.isNull(), "null")
        .when(parts[0] == "", "blank")
        .when((tag == "T") & F.coalesce(valid, F.lit(False)), "time")
        .when(tag == "T", "impossible")
        .when((tag == "E") & epoch.isNotNull(), "epoch")
        .when(tag == "D", "day")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when((tag == "T") & valid, local).when(tag == "E", epoch).alias("local_us"),
        F.when((tag == "T") & offset.isNull() & (zone != ""), zone).alias("zone"),
        F.when(tag == "T", offset).when(tag == "E", 0).cast("int").alias("offset_min"),
        F.when((tag == "T") & valid, y).alias("year"),
    )
