"""Kinds of income, home addresses and contributors: free text to keys, keys to words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for each kind of income (trimmed, lower case), and its label.
INCOME_WORDS = {
    "salary": ("salary", "stipendio", "stipendio 1", "stipendio 2"),
    "pension": ("pension", "pensione"),
    "income": ("income", "reddito", "rendita", "annuity", "rentalincome", "financialincome"),
    "refund": ("refund", "rimborso"),
    "extraordinary_contribution": ("extraordinary_contribution", "contributo straordinario", "contributo_straordinario", "bonus", "extrasalary"),
}
INCOME_LABELS = {"salary": "Stipendio", "pension": "Pensione", "income": "Reddito", "refund": "Rimborso", "extraordinary_contribution": "Contributo straordinario", "other": "Altro"}
#: A contributor's own label for its income.
CONTRIBUTOR_WORDS = {"pension": ("pensione",), "income": ("rendita", "reddito"), "refund": ("rimborso",), "other": ("altro",)}
#: Addresses that stand for none.
SAMPLE_EMAILS, SAMPLE_HOSTS = ("nome@esempio.com", "esempio@esempio.com", "user@example.com"), ("@esempio.com", "@esempio.it", "@example.com")


def _keyed(text: Column, words: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for key, names in words.items():
        out = F.when(text.isin(*names), key).otherwise(out)
    return out


def _clean(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def income_type(raw: Column, contributor: Column | None = None) -> Column:
    """Key of an income's kind; a blank one takes the contributor's label, unknown words are other."""
    fallback = _keyed(_clean(contributor if contributor is not None else F.lit(None)), CONTRIBUTOR_WORDS, "salary")
    return F.when(_clean(raw) == "", fallback).otherwise(_keyed(_clean(raw), INCOME_WORDS, "other"))


def income_type_label(key: Column) -> Column:
    out = F.lit("Altro")
    for k, label in INCOME_LABELS.items():
        out = F.when(key == k, label).otherwise(out)
    return out


def home_address(street: Column, number: Column, postal_code: Column) -> Column:
    """`street number – postal code` of the parts that are there; null without any."""
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.nullif(F.concat_ws(" – ", F.nullif(F.concat_ws(" ", part(street), part(number)), F.lit("")), part(postal_code)), F.lit(""))


def is_placeholder(order: Column, active: Column, referenced: Column, name: Column, email: Column, notified: Column) -> Column:
    """A contributor slot nobody uses: not the first, inactive, unreferenced, with a stock name and e-mail and no reminders."""
    plain, mail = F.trim(F.coalesce(name, F.lit(""))), _clean(email)
    stock_name = (plain == "") | plain.rlike(r"(?i)^contributore(\s*\d*)?$") | plain.rlike(r"(?i)^(primo|secondo|terzo)\s+contributore$")
    stock_mail = (mail == "") | mail.isin(*SAMPLE_EMAILS) | mail.endswith(SAMPLE_HOSTS[0]) | mail.endswith(SAMPLE_HOSTS[1]) | mail.endswith(SAMPLE_HOSTS[2])
    return (order != 1) & ~active & ~referenced & stock_name & stock_mail & ~notified
