"""Text normalisation: folding, name and address parts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions.words import ADDRESS_WORDS, FRENCH_STREET, GENERIC_STREET, HOMOGLYPH_DIGITS, HOMOGLYPH_LETTERS, LEGAL_CLASSES, NAME_FILLER, NO_ADDRESS, STOP_WORDS

TOKEN = r"[\p{L}\p{M}\p{N}]+"
_LATIN_MARKS = re.compile("[̀-ͯ]")


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else _LATIN_MARKS.sub("", unicodedata.normalize("NFKD", x)))


@F.pandas_udf(T.StringType())
def _unmarked(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M"))


def fold(c: Column) -> Column:
    """Lower case without Latin accents; marks of other scripts stay. Null is empty."""
    return _decomposed(F.lower(F.coalesce(c, F.lit(""))))


def clean(c: Column) -> Column:
    """Lower-case ASCII letters and digits, one space between words; no marks at all. Null is empty."""
    x = F.regexp_replace(_unmarked(F.lower(F.coalesce(c, F.lit("")))), r"\.", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def unglyph(token: Column) -> Column:
    """Digits of words that also have letters read as the letters they resemble; ordinals are left alone."""
    mixed = token.rlike("[a-z]") & token.rlike(r"\d") & ~token.rlike(r"^\d+(st|nd|rd|th)$")
    return F.when(mixed, F.translate(token, HOMOGLYPH_DIGITS, HOMOGLYPH_LETTERS)).otherwise(token)


def meaningful(token: Column) -> Column:
    return ~token.isin(*STOP_WORDS) & (F.length(token) > 1)


def numbers(folded_address: Column, most: int = 4) -> Column:
    """The first distinct numbers without leading zeros."""
    x = F.transform(F.regexp_extract_all(folded_address, F.lit(r"\d+"), F.lit(0)), lambda n: F.ltrim(n, F.lit("0")))
    return F.slice(F.array_distinct(F.filter(x, lambda n: n != "")), 1, most)


def street_words(folded_address: Column) -> Column:
    """Distinct words of four letters and more that few addresses share, in order."""
    x = F.regexp_extract_all(folded_address, F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(x, lambda w: ~w.isin(*GENERIC_STREET)))


def longest(words: Column) -> Column:
    """The longest word, the first of equals; null of none."""
    best = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(best != "", best)


def has_no_address(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*NO_ADDRESS)


def _mapped(word: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, word), word)


def address_tokens(address: Column) -> Column:
    """Words of an address with ordinals as numbers and abbreviations written out."""
    x = F.regexp_replace(F.lower(address), r"(\d+)(st|nd|rd|th)\b", "$1")
    words = F.filter(F.split(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    return F.filter(F.transform(words, lambda w: _mapped(w, ADDRESS_WORDS)), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of adjacent words."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: i < F.size(words))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i))))


def name_core(c: Column) -> Column:
    """Sorted distinct words of the cleaned name without filler words."""
    x = F.trim(F.regexp_replace(F.regexp_replace(clean(c), rf"\b({NAME_FILLER})\b", " "), r"\s+", " "))
    return F.array_join(F.array_sort(F.array_distinct(F.split(x, " "))), " ")


def core_keys(core: Column) -> Column:
    """The core and, with two words and more, the core without each one of them: structs (key, exact)."""
    words = F.split(core, " ")
    full = F.array(F.struct(core.alias("key"), F.lit(True).alias("exact")))
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.size(words) >= 2)
    less = F.transform(at, lambda i: F.struct(F.array_join(F.filter(words, lambda w, j: j != i), " ").alias("key"), F.lit(False).alias("exact")))
    return F.when(core != "", F.concat(full, less)).otherwise(F.filter(full, lambda s: F.lit(False)))


def address_parts(c: Column) -> Column:
    """struct(house, rest, nums): the first number, the other words written out, all numbers; zeros in front dropped."""
    x = clean(F.regexp_replace(c, r"(?i)n\s*[°º]|\bno\b\.?|#", " "))
    words = F.transform(F.split(x, " "), lambda w: _mapped(w, FRENCH_STREET))
    house = F.nullif(F.regexp_extract(x, r"(?:^|\s)0*(\d+)(?:\s|$)", 1), F.lit(""))
    nums = F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda n: F.regexp_replace(n, r"^0+(\d)", "$1"))
    rest = F.filter(words, lambda w: ~w.rlike(r"^\d+$") & (w != ""))
    return F.struct(house.alias("house"), F.array_join(rest, " ").alias("rest"), F.array_join(nums, " ").alias("nums"))


def legal_class(folded_name: Column) -> Column:
    """Class of the first legal form in a name, 0 without one."""
    forms = "|".join(sorted(LEGAL_CLASSES, key=len, reverse=True))
    found = F.regexp_extract(folded_name, rf"\b({forms})\b", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEGAL_CLASSES.items() for x in kv]), found), F.lit(0))


def only_letters_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def char_grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the words of a text, each padded with a space on both sides."""
    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: i <= F.length(p) - n + 1)
        return F.transform(at, lambda i: F.substring(p, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), of)))


def padded_grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a whole text, white space as one space and one space more at either end."""
    p = F.concat(F.lit(" "), F.regexp_replace(c, r"\s+", " "), F.lit(" "))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: i <= F.length(p) - n + 1)
    return F.array_distinct(F.transform(at, lambda i: F.substring(p, i, F.lit(n))))
