"""Brazilian phone numbers as Column expressions: the shape of the numbering plan, never whether a number is in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .text import digits

#: Area codes in use (fixed values).
AREA_CODES = (
    "11", "12", "13", "14", "15", "16", "17", "18", "19", "21", "22", "24", "27", "28", "31", "32", "33", "34", "35", "37", "38",
    "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "53", "54", "55", "61", "62", "63", "64", "65", "66", "67", "68", "69",
    "71", "73", "74", "75", "77", "79", "81", "82", "83", "84", "85", "86", "87", "88", "89", "91", "92", "93", "94", "95", "96", "97", "98", "99",
)
# fixed values: patterns of an extension and of what looks like a number; digits are those of any script, as of Unicode
EXTENSION = r"(?iU)\s*(?:ramal|r\.?|ext(?:ens(?:a|ã)o)?|x)\s*[:.\-]?\s*\d+\s*$"
PHONE_LIKE = r"(?U)((?<!\d)(?:\+|00)?\d[\d\s().\-/]{6,25}\d(?!\d))"


def area_code(c: Column) -> Column:
    return let(F.regexp_replace(digits(c), "^0([0-9]{2})$", "$1"), lambda d: F.when(d.isin(*AREA_CODES), d))


def national(d: Column) -> Column:
    """Digits without country code, trunk zero and carrier, as their number allows."""
    return F.regexp_replace(d, "^(?:0055(?=[0-9]{10,11}$)|55(?=[0-9]{10,11}$)|0(?=[0-9]{10,11}$)|0[0-9]{2}(?=[0-9]{10,11}$))", "")


def _valid(number: Column, default_area: Column | None) -> Column:
    """The national number if the plan has its shape: an area code, then nine digits from 9 or eight from 2 to 5."""
    areas = "|".join(AREA_CODES)
    if default_area is not None:
        number = let(number, lambda n: F.when(n.rlike("^[0-9]{8,9}$") & area_code(default_area).isNotNull(), F.concat(area_code(default_area), n)).otherwise(n))
    return let(number, lambda n: F.when(n.rlike(f"^(?:{areas})(?:9[0-9]{{8}}|[2-5][0-9]{{7}})$"), n))


_SENT = r"(?i)^(?:(?:https?://)?(?:www\.)?(?:(?:api\.|web\.)?whatsapp\.com)/send/?|whatsapp:(?://)?/?send/?)\?(?:[^#]*&)?phone=([^&#]*)"


def whatsapp_link(c: Column, default_area: Column | None = None) -> Column:
    """The national number in a wa.me, whatsapp.com/send or whatsapp://send link."""
    link = F.btrim(F.replace(F.trim(c), F.lit("&amp;"), F.lit("&")), F.lit("\"'<>.,;)"))

    def value(u: Column) -> Column:
        path = let(F.regexp_extract(u, r"(?i)^(?:https?://)?(?:www\.)?wa\.me/+([^/?#]+)", 1), lambda x: F.when((x != "") & (F.lower(x) != "message"), x))
        sent = let(F.nullif(F.regexp_extract(u, _SENT, 1), F.lit("")), lambda x: F.coalesce(F.try_url_decode(x), x))
        return F.coalesce(path, sent)

    return _valid(national(digits(let(link, value))), default_area)


def plain_number(c: Column, default_area: Column | None = None) -> Column:
    """The national number of a text that is one, with or without extension; null for numbers of other countries."""

    def parsed(w: Column) -> Column:
        return let(digits(w), lambda d: F.when(~(w.rlike(r"(?i)^\s*(?:tel:\s*)?\+") & ~d.startswith("55")) & ~d.rlike("^00(?!55)"), _valid(national(d), default_area)))

    return let(F.regexp_replace(F.trim(c), EXTENSION, ""), parsed)


def national_number(c: Column, default_area: Column | None = None) -> Column:
    return F.coalesce(F.when(c.rlike("(?i)wa\\.me|whatsapp"), whatsapp_link(c, default_area)), plain_number(c, default_area))


def parse_phone(c: Column, default_area: Column | None = None) -> Column:
    """struct(area_code, subscriber, kind, digits, e164), or null."""

    def parts(n: Column) -> Column:
        kind = F.when(F.length(n) == 11, "mobile").otherwise("landline")
        fields = (F.substring(n, 1, 2).alias("area_code"), F.substring(n, F.lit(3), F.length(n)).alias("subscriber"), kind.alias("kind"), F.concat(F.lit("55"), n).alias("digits"), F.concat(F.lit("+55"), n).alias("e164"))
        return F.when(n.isNotNull(), F.struct(*fields))

    return let(national_number(c, default_area), parts)


def normalize_phone(c: Column, default_area: Column | None = None) -> Column:
    """Country code, area code and subscriber's number as digits, or null."""
    return F.concat(F.lit("55"), national_number(c, default_area))


def phone_identity(c: Column) -> Column:
    return national_number(c)


def equivalent(left: Column, right: Column) -> Column:
    return F.coalesce(normalize_phone(left) == normalize_phone(right), F.lit(False))


def extract_phones(c: Column) -> Column:
    """The distinct numbers of a text, in the order of their first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(PHONE_LIKE), F.lit(1)), lambda x: normalize_phone(x)), lambda x: x.isNotNull()))


def tel_link(c: Column) -> Column:
    return normalize_phone(F.nullif(F.try_url_decode(F.regexp_extract(c, r"(?i)^\s*tel:(?://)?([^?;]+)", 1)), F.lit("")))


def first_of_list(c: Column) -> Column:
    """The first entry of a list joined by semicolons."""
    return F.nullif(F.trim(F.split(c, ";")[0]), F.lit(""))
