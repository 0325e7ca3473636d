"""Text normalization and tokens as Column builders; Arrow UDFs only where Spark has no built-in (NFKC, transliteration)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of legal forms that a name loses.
LEGAL_SUFFIX_TOKENS = (
    "ltd", "limited", "pvt", "private", "llc", "inc", "incorporated", "corp",
    "corporation", "co", "company", "plc", "llp", "lp", "pc", "pllc",
    "gmbh", "sarl", "sas", "sa", "eurl", "srl", "bv", "nv", "ag", "pty",
    "limitada", "spa", "kg", "kft", "oy", "ab", "as", "aps", "sasu", "eirl",
)

#: Legal forms and fillers that forensic comparisons of names ignore.
FILLER_TOKENS = (
    "ltd", "limited", "llc", "l", "c", "inc", "incorporated", "corp", "corporation", "co", "company",
    "pvt", "private", "public", "llp", "p", "pc", "plc", "pllc", "lp", "the", "m", "s", "ms", "mr", "smt",
    "sri", "shri", "and", "a", "of",
)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@lru_cache(maxsize=1 << 16)
def _ascii(ch: str) -> str:
    """One character in ASCII: its decomposition without marks, else a reading of its Unicode name."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    if plain.isascii():
        return plain
    name = unicodedata.name(ch, "")
    if "VIRAMA" in name or unicodedata.category(ch) == "Mn" and "VOWEL" not in name:
        return "n" if "ANUSVARA" in name else ""
    words = name.split()
    if "DIGIT" in words:
        return str(unicodedata.digit(ch, ""))
    for mark in ("LETTER", "SIGN", "SYLLABLE"):
        if mark in words and words[-1] != mark:
            read = " ".join(words[words.index(mark) + 1 :]).split(" WITH ")[0].split()[-1]  # O WITH STROKE is read O
            read = "SS" if name.endswith("LETTER SHARP S") else read
            return read.capitalize() if "CAPITAL" in words else read.lower()
    return ""


def to_ascii(text: str | None) -> str:
    """Transliteration to ASCII by rule. Indic consonants keep their inherent vowel only where no vowel sign follows."""
    if not text:
        return ""
    if text.isascii():
        return text
    out = []
    for ch in text:
        if ch.isascii():
            out.append(ch)
            continue
        name = unicodedata.name(ch, "")
        if ("VOWEL SIGN" in name or "VIRAMA" in name) and out and out[-1].endswith("a") and len(out[-1]) > 1:
            out[-1] = out[-1][:-1]
        out.append(_ascii(ch))
    return "".join(out)


@F.pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    return s.map(to_ascii)


def clean(text: Column, with_nfkc: bool = False) -> Column:
    """Lower case, & as "and", what is no letter, digit, mark or underscore as a space, spaces folded. Null gives "".

    with_nfkc applies NFKC first. It changes nothing in ASCII, so only texts with another character go through Python.
    """
    x = F.coalesce(text, F.lit(""))
    if with_nfkc:
        x = F.coalesce(nfkc(F.when(x.rlike("[^\\x00-\\x7F]"), x)), x)
    x = F.regexp_replace(F.lower(x), "&", " and ")
    x = F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\p{M}\s]", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """The set of white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def without(text: Column, stop: tuple[str, ...]) -> Column:
    """The tokens of text that are not in stop, anywhere, joined by spaces."""
    stops = F.array(*map(F.lit, stop))
    return F.array_join(F.filter(F.split(text, " "), lambda t: (t != "") & ~F.array_contains(stops, t)), " ")


def without_legal_forms(name_norm: Column) -> Column:
    return without(name_norm, LEGAL_SUFFIX_TOKENS)


def postal_run(address: Column) -> Column:
    """The last word-bounded run of 5 or 6 digits of a raw address."""
    runs = F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"(?U)\b\d{5,6}\b"), F.lit(0))
    return F.when(F.size(runs) > 0, F.element_at(runs, -1)).otherwise(F.lit(""))


def is_digits(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def digit_tokens(text: Column) -> Column:
    return F.filter(tokens(text), is_digits)


def street_number(address_norm: Column) -> Column:
    """The first token that is all digits; zeros in front stay."""
    return F.coalesce(F.get(F.filter(F.split(F.coalesce(address_norm, F.lit("")), " "), is_digits), F.lit(0)), F.lit(""))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of text without its spaces; the whole if it is shorter, none if empty."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), " ", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def char_ngram_string(text: Column, n: int) -> Column:
    """All n-grams of text without its spaces, in order and with repeats, joined by spaces; the whole if it is shorter."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), " ", "")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n))), " ")


def profile_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def plain_name(text: Column) -> Column:
    """Lower case, & as "and", runs of what is not a-z or 0-9 as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "&", " and "), "[^a-z0-9]+", " "))


def beyond_latin(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[^\\u0000-\\u024F]")


def core_tokens(name_norm: Column) -> Column:
    return F.array_except(tokens(name_norm), F.array(*map(F.lit, FILLER_TOKENS)))


def number_tokens(address_norm: Column) -> Column:
    """Tokens with a digit that do not look like a 6-digit postal code."""
    return F.filter(tokens(address_norm), lambda t: t.rlike(r"\p{Nd}") & ~t.rlike(r"^[1-9]\d{5}$"))
