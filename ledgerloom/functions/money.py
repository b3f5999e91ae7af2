"""Column functions on money. Amounts are decimal(20,2), rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def quantize_rub(c: Column) -> Column:
    """S2."""
    return F.round(c.cast("decimal(30,6)"), 2).cast(MONEY)


def rub_to_thousand(c: Column) -> Column:
    """S3."""
    return F.round(c / F.lit(1000), 2).cast(MONEY)


def parse_money(text: Column, unit: str = "rub") -> Column:
    """Null, blank or a dash is zero; null only where the text is no amount (see is_bad_money)."""
    clean = F.regexp_replace(F.lower(text), r"[\s  ​﻿]|руб\.?|тыс\.?|₽", "")
    clean = F.regexp_replace(clean, ",", ".")
    # plain numbers need no cleaning
    value = F.coalesce(text.try_cast("decimal(24,6)"), clean.try_cast("decimal(24,6)")) * F.lit(1000 if unit == "thousand_rub" else 1)
    blank = text.isNull() | clean.isin("", "-", "—", "–")
    return F.coalesce(F.round(value, 2).cast(MONEY), F.when(blank, F.lit(0).cast(MONEY)))


def is_bad_money(text: Column, unit: str = "rub") -> Column:
    return parse_money(text, unit).isNull()


def display_amount(c: Column, unit: str = "thousand_rub") -> Column:
    """The amount as a document in thousands shows it."""
    return (F.round(c / F.lit(1000), 2) * 1000).cast(MONEY) if unit == "thousand_rub" else c.cast(MONEY)


def format_money_like(c: Column, sample: Column) -> Column:
    """Decimal comma; groups of three if the sample has them; the sample's decimal places, two if the value needs them."""
    places = F.length(F.regexp_extract(sample, r"[.,](\d+)$", 1))
    needs = (c * 100) % 100 != 0
    two = F.translate(F.format_number(c, 2), ",.", " ,")
    none = F.translate(F.format_number(c, 0), ",", " ")
    one = F.translate(F.format_number(c, 1), ",.", " ,")
    text = F.when(needs | (places >= 2), two).when(places == 1, one).otherwise(none)
    return F.when(sample.rlike(r"\d[\s ]\d{3}"), text).otherwise(F.translate(text, " ", ""))


def parse_document_money(text: Column) -> Column:
    """Digits, points and minus signs only; blank gives null."""
    return F.nullif(F.regexp_replace(F.translate(text, ",", "."), r"[^0-9.\-]", ""), F.lit("")).try_cast(MONEY)


def extract_amounts(text: Column) -> Column:
    """All amounts with a unit, in roubles."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[  ]\d{3})*(?:[.,]\d+)?)\s*(тыс\. руб|млн руб|руб|rub)"), F.lit(0))
    return F.transform(found, lambda x: F.round(F.translate(F.regexp_replace(x, r"[^\d.,]|\.(?!\d)", ""), ",", ".").try_cast("decimal(24,6)") * F.when(x.contains("тыс"), 1000).when(x.contains("млн"), 1000000).otherwise(1), 2).cast(MONEY))


def extract_last_amount(text: Column) -> Column:
    """The last amount; bare years 20xx do not count."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)\s*(млн|тыс)?"), F.lit(0))
    kept = F.filter(found, lambda x: ~x.rlike(r"^20\d\d\s*$"))
    last = F.try_element_at(kept, F.lit(-1))
    value = F.translate(F.regexp_extract(last, r"\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("decimal(24,6)")
    return F.round(value * F.when(last.contains("млн"), 1000000).when(last.contains("тыс"), 1000).otherwise(1), 2).cast(MONEY)


def new_amount_for_mode(mode: Column, old: Column, amount: Column) -> Column:
    """Deltas are signed in both directions."""
    return F.when(mode.isin("delta_plus", "delta_minus"), old + amount).when(mode == "zeroing", 0).otherwise(amount).cast(MONEY)


def clarified_amount(mode: Column, old: Column, amount: Column, stored: Column) -> Column:
    """As S9 with the delta's absolute value; falls back to the stored amount."""
    value = F.when(mode == "delta_plus", old + F.abs(amount)).when(mode == "delta_minus", old - F.abs(amount)).when(mode == "zeroing", 0).otherwise(amount)
    return F.coalesce(value.cast(MONEY), stored.cast(MONEY))


def manual_amount(operation: Column, old: Column, amount: Column) -> Column:
    """Null where a decrease would fall below zero."""
    value = F.when(operation == "increase", old + amount).when(operation == "decrease", F.when(old >= amount, old - amount)).when(operation == "zero", 0).when(operation == "full_balance", old).otherwise(amount)
    return value.cast(MONEY)


def operation_code(mode: Column) -> Column:
    """T27."""
    return F.when(mode == "absolute", "set_absolute_amount").when(mode == "delta_minus", "subtract_delta").when(mode == "delta_plus", "add_delta").otherwise(mode)
