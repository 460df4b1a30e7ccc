"""Licence plates: normal form, validity, correction of misread characters, hashing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The legal letters; (letters, fewest digits, most digits); confusions of a reader, the safe ones and all.
LETTERS = "ABCDEFGHIJKLMNOPRSTUVYZ"
SHAPES = ((1, 4, 5), (2, 3, 4), (3, 2, 3))
TO_DIGIT_SAFE, TO_LETTER_SAFE = ("OQIBSZG", "0018526"), ("018526", "OIBSZG")
TO_DIGIT_ALL, TO_LETTER_ALL = ("OQDILBSZGTA", "00011852674"), ("01852647", "OIBSZGAT")
PROVINCE = "(0[1-9]|[1-7][0-9]|8[01])"
GENERIC = "^[A-Z0-9]{4,9}$"


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(text), "İŞĞÜÖÇ", "ISGUOC"), "[^A-Z0-9]", "")


def normal_form(text: str) -> str:
    """``normalize`` of one Python string, for code that runs inside of a task."""
    return re.sub("[^A-Z0-9]", "", text.upper().translate(str.maketrans("İŞĞÜÖÇ", "ISGUOC")))


def legal(plate: Column) -> Column:
    """Whether a normal plate has the Turkish shape."""
    shapes = "|".join(f"[{LETTERS}]{{{n}}}[0-9]{{{a},{b}}}" for n, a, b in SHAPES)
    return plate.rlike(f"^{PROVINCE}({shapes})$")


def valid(plate: Column, country: Column) -> Column:
    """By country; an unknown or null one takes the generic shape."""
    return F.when(country == "TR", legal(plate)).otherwise(plate.rlike(GENERIC))


def correct(text: Column) -> Column:
    """Struct (text, valid, country, corrected) of a raw Turkish plate: the first legal candidate, safe confusions before all of them, shapes in order."""
    def settle(t: Column) -> Column:
        size, tried = F.length(t), [t]
        for digits, letters in ((TO_DIGIT_SAFE, TO_LETTER_SAFE), (TO_DIGIT_ALL, TO_LETTER_ALL)):
            for n, least, most in SHAPES:
                put = F.concat(F.translate(F.substring(t, 1, 2), *digits), F.translate(F.substring(t, 3, n), *letters), F.translate(F.substr(t, F.lit(3 + n)), *digits))
                tried.append(F.when(size.between(2 + n + least, 2 + n + most), put))
        found = F.get(F.filter(F.array(*tried), legal), F.lit(0))
        return _let(found, lambda f: F.struct(F.coalesce(f, t).alias("text"), f.isNotNull().alias("valid"), F.when(f.isNotNull(), "TR").alias("country"), (f.isNotNull() & (f != t)).alias("corrected")))

    return _let(normalize(text), settle)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed(text: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), normalize(text)), 256)


def at_rest(text: Column, mode: str, salt: str) -> Column:
    """What is stored of a plate: its hash, or its normal form."""
    return hashed(text, salt) if mode == "hashed" else normalize(text)


def matches_search(stored: Column, query: Column, mode: str, salt: str) -> Column:
    return stored == hashed(query, salt) if mode == "hashed" else F.contains(stored, normalize(query))
