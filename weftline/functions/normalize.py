"""Normalizers of extracted values; each gives null for what it rejects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols of currencies and factors of number suffixes.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
FACTORS = {"k": 1e3, "m": 1e6, "b": 1e9, "%": 1e-2}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def number(c: Column) -> Column:
    """double of digits with comma groups, a decimal point and one of the suffixes k, M, B, %."""
    low = F.lower(F.btrim(c))
    plain = F.regexp_extract(low, r"^([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*[kmb%]?$", 1)
    factor = F.coalesce(F.try_element_at(_map(FACTORS), F.regexp_extract(low, r"([kmb%])$", 1)), F.lit(1.0))
    return F.replace(plain, F.lit(","), F.lit("")).try_cast("double") * factor


def money(c: Column) -> Column:
    """struct<amount decimal(18,2), currency string> of a symbol or three-letter code before or after an amount."""
    text = F.btrim(c)
    amount = F.replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    symbol = F.try_element_at(_map(CURRENCIES), F.regexp_extract(text, r"([$€£¥₹])", 1))
    code = F.regexp_extract(text, r"(?<![A-Za-z])([A-Z]{3})(?![A-Za-z])", 1)
    currency = F.coalesce(symbol, F.nullif(code, F.lit("")))
    return F.when(amount.isNotNull() & currency.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def phone(c: Column, country: str = "1") -> Column:
    """E.164: + and 8 to 15 digits; without + or 00 the country's number is put before."""
    text = F.btrim(c)
    digits = F.regexp_replace(text, "[^0-9]", "")
    full = F.when(F.startswith(text, F.lit("+")), digits).when(F.startswith(text, F.lit("00")), F.substring(digits, 3, 20)).otherwise(F.concat(F.lit(country), digits))
    clean = F.regexp_like(text, F.lit(r"^[+0-9(][0-9 ().-]*$"))
    return F.when(clean & F.length(full).between(8, 15), F.concat(F.lit("+"), full))


def date(c: Column, today: Column | None = None) -> Column:
    """A UTC date as ISO text, of ISO dates, RFC 2822 dates, and the words today, yesterday and N days ago."""
    text = F.btrim(c)
    now = today if today is not None else F.current_date()
    ago = F.regexp_extract(F.lower(text), r"^([0-9]{1,4}) days? ago$", 1).try_cast("int")
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    said = F.when(F.lower(text) == "today", now).when(F.lower(text) == "yesterday", F.date_sub(now, 1)).when(ago.isNotNull(), F.date_sub(now, ago))
    iso = F.when(F.regexp_like(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")), F.try_to_timestamp(text).cast("date"))
    mail = F.when(F.regexp_like(rfc, F.lit(r"^[0-9]{2} [A-Z][a-z]{2} [0-9]{4} ")), F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss Z")).cast("date"))
    return F.date_format(F.coalesce(said, iso, mail), "yyyy-MM-dd")
