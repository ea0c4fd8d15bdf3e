"""Saudi identifiers as Column expressions: validators, canonical forms, check digits, generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import GAZETTEER, Gazetteer
from .text import flatten, normalize_name, strip

SAUDI_ID, MOBILE, IBAN, EMAIL, PERSON_NAME = KINDS = ("SAUDI_ID", "MOBILE", "IBAN", "EMAIL", "PERSON_NAME")

# Shapes of identifiers, bank codes, digits that follow 05.
MOBILE_SHAPE = "^(05|\\+9665|9665|009665)[0-9]{8}$"
IBAN_SHAPE = "^SA[0-9]{22}$"
EMAIL_SHAPE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
BANK_CODES = ("10", "80", "45", "20", "05", "55", "15", "60", "30", "65")
MOBILE_DIGITS = "0345689"
MAIL_HOSTS = ("example.com", "example.org", "example.net")


def is_saudi_id(text: Column) -> Column:
    """Ten ASCII digits, the first 1 or 2, with a Luhn check digit."""
    return F.coalesce(text.rlike("^[12][0-9]{9}$") & F.call_function("luhn_check", text), F.lit(False))


def is_mobile(text: Column) -> Column:
    return F.coalesce(text.rlike(MOBILE_SHAPE), F.lit(False))


def iban_mod97(iban: Column) -> Column:
    """The remainder of SA + 22 digits read with its first four characters behind (S = 28, A = 10)."""
    digits = F.concat(F.substring(iban, 5, 20), F.lit("2810"), F.substring(iban, 3, 2))
    return F.try_mod(digits.try_cast("decimal(38,0)"), F.lit(97))


def is_iban(text: Column) -> Column:
    return F.coalesce(text.rlike(IBAN_SHAPE) & (iban_mod97(text) == 1), F.lit(False))


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{EMAIL_SHAPE}$"), F.lit(False))


def is_valid(kind: str, text: Column, names: Gazetteer = GAZETTEER) -> Column:
    """Is a value, in any accepted spelling, an identifier of this kind?  null: false."""
    if kind == PERSON_NAME:
        return names.is_known_name(text)
    if kind == EMAIL:
        return F.when(text.contains("@"), is_email(strip(text))).otherwise(False)
    flat = flatten(text)
    return {SAUDI_ID: is_saudi_id, MOBILE: is_mobile, IBAN: lambda x: is_iban(F.upper(x))}[kind](flat)


def canonical(kind: str, text: Column) -> Column:
    """One spelling for each real value; all spellings of a mobile are its nine digits."""
    if kind == PERSON_NAME:
        return normalize_name(text)
    if kind == EMAIL:
        return F.lower(strip(text))
    flat = flatten(text)
    if kind == SAUDI_ID:
        return flat
    if kind == IBAN:
        return F.upper(flat)
    if kind == MOBILE:
        return F.regexp_replace(F.regexp_replace(flat, r"^\++", ""), "^(00966|966|0)", "")
    raise ValueError(f"unknown kind: {kind}")


def luhn_digit(body: Column, n: int = 9) -> Column:
    """The digit that completes a body of n (odd) digits."""

    def term(k: int) -> Column:
        digit = F.substring(body, k + 1, 1).cast("int")
        return digit if k % 2 else F.when(digit >= 5, 2 * digit - 9).otherwise(2 * digit)

    return ((10 - reduce(lambda a, b: a + b, map(term, range(n))) % 10) % 10).cast("string")


def complete_saudi_id(body: Column) -> Column:
    return F.concat(body, luhn_digit(body))


def complete_iban(bban: Column) -> Column:
    """SA, check digits and a 20-digit account."""
    rest = F.concat(bban, F.lit("281000")).cast("decimal(38,0)") % 97
    return F.concat(F.lit("SA"), F.lpad((98 - rest).cast("int").cast("string"), 2, "0"), bban)


def digit_stream(seed: Column, n: int) -> Column:
    """n decimal digits from SHA-256 of a seed; for public seeds only, as a plan shows its literals."""
    digests = F.concat(*(F.sha2(F.concat(seed, F.lit(f":{k}")), 256) for k in range(n // 30 + 1)))
    return F.substring(F.translate(digests, "abcdef", "012345"), 1, n)


def pick(values, seed: Column) -> Column:
    """One of a list, by hash."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(seed), F.lit(len(values))) + 1).cast("int"))


def generate(kind: str, seed: Column, first_digit: Column | None = None, names: Gazetteer = GAZETTEER) -> Column:
    """A valid made-up identifier for a public seed."""
    salted = F.concat(F.lit(f"{kind}:"), seed)
    if kind == SAUDI_ID:
        first = pick("12", salted) if first_digit is None else first_digit
        return complete_saudi_id(F.concat(first, digit_stream(salted, 8)))
    if kind == MOBILE:
        return F.concat(F.lit("05"), pick(MOBILE_DIGITS, salted), digit_stream(salted, 7))
    if kind == IBAN:
        return complete_iban(F.concat(pick(BANK_CODES, salted), digit_stream(salted, 18)))
    if kind == EMAIL:
        user = F.translate(digit_stream(salted, 8), "0123456789", "abcdefghij")
        return F.concat(user, F.substring(F.translate(digit_stream(F.concat(salted, F.lit("n")), 3), "0", "7"), 1, 3), F.lit("@"), pick(MAIL_HOSTS, salted))
    return F.concat_ws(" ", pick(names.male + names.female, salted), pick(names.family, F.concat(salted, F.lit("f"))))
