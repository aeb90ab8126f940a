"""Normalising, romanising and folding of words, as column expressions.

Canonical decomposition is the one step that Spark has no function for; `decomposed` runs it in Arrow batches and is
applied to distinct words only. Everything else is built in.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Devanagari letters and their keyboard spellings.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t",
    "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph",
    "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l",
}
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
MATRAS = {"ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "ृ": "ri", "ॄ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॅ": "e", "ॉ": "o"}
DIGITS = "०१२३४५६७८९"
VIRAMA, NASALS, VISARGA = "्", "ंँ", "ः"
JOINERS = "\u200c\u200d\u093c"  # dropped wherever they stand
HONORIFIC, HONORIFIC_STEM = "श्री", "sri"

#: White space as searches see it: also no-break spaces, line and paragraph separators and the byte order mark.
BLANK = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: What separates words: white space, punctuation and symbols.
SEPARATOR = rf"[\p{{P}}\p{{S}}{BLANK}]+"


def replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def devanagari_number(n: Column) -> Column:
    """A number in Devanagari digits."""
    return F.translate(n.cast("string"), "0123456789", DIGITS)


def decomposed(words: DataFrame, word: str, out: str) -> DataFrame:
    """`words` with the canonical decomposition of a column; words of ASCII letters go to Python as nulls."""

    @F.pandas_udf("string")
    def nfd(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")

    plain = F.col(word).rlike(r"^[\x00-\x7F]*\z")
    return words.withColumn(out, F.coalesce(nfd(F.when(~plain, F.col(word))), F.col(word)))


def normal(nfd: Column) -> Column:
    """The normal form of decomposed text: ASCII digits, no joiners or nuktas, lower case, separators as single spaces."""
    x = F.translate(nfd, DIGITS + JOINERS, "0123456789")
    return F.trim(F.regexp_replace(F.lower(x), SEPARATOR, " "))


def romanized(nfd: Column) -> Column:
    """Keyboard spelling of decomposed text: consonants carry an "a", which a vowel sign or virama takes away; words lose a
    final "a". Text without a letter or sign of the script skips its rules."""
    spelt = F.when(nfd.rlike(r"[\u0900-\u097F]"), normal(_spelt(nfd))).otherwise(normal(F.translate(nfd, JOINERS, "")))
    return F.regexp_replace(spelt, "a(?![A-Za-z0-9_])", "")


def _spelt(nfd: Column) -> Column:
    x = replaced(nfd, [(k, v + "a") for k, v in CONSONANTS.items()])
    x = replaced(x, VOWELS.items())
    for sign, v in MATRAS.items():
        x = F.regexp_replace(x, "a?" + sign, v)
    x = F.regexp_replace(x, "a?" + VIRAMA, "")
    x = F.regexp_replace(x, f"[{NASALS}]", "n")
    return F.translate(F.replace(x, F.lit(VISARGA), F.lit("h")), JOINERS, "")


# Keyboard spellings that count as one, in this order.
SPELLINGS = [("aa", "a"), ("ee|ii", "i"), ("oo|uu", "u"), ("w", "v"), ("sh", "s"), ("ph", "f")]


def folded(roman: Column) -> Column:
    """Common keyboard spellings as one."""
    for pattern, to in SPELLINGS:
        roman = F.regexp_replace(roman, pattern, to) if "|" in pattern else F.replace(roman, F.lit(pattern), F.lit(to))
    return roman


def sound(stem: Column) -> Column:
    """The consonants of a folded spelling."""
    return F.translate(folded(stem), "aeiou", "")


def stem_of(roman: Column) -> Column:
    """A folded spelling without one final "a"."""
    return F.regexp_replace(folded(roman), r"a\z", "")


def search_stems(normal_word: Column, stem: Column) -> Column:
    """The stems that a word is found by: its own, and the parts of an honorific compound."""
    compound = normal_word.startswith(HONORIFIC) & stem.startswith(HONORIFIC_STEM) & (F.length(stem) > len(HONORIFIC_STEM))
    return F.when(compound, F.array(stem, F.lit(HONORIFIC_STEM), F.substring(stem, len(HONORIFIC_STEM) + 1, 1 << 20))).otherwise(F.array(stem))


def ocr_normal(c: Column, drop_nukta: bool = False) -> Column:
    """Letters and digits of a recognised text: the Devanagari block, a-z and 0-9. Text without a sign of the script takes the
    class of ASCII letters, which is decided by a table and several times as fast."""
    x = F.lower(c)
    script = r"\u0900-\u093B\u093D-\u097F" if drop_nukta else r"\u0900-\u097F"
    return F.when(x.rlike(f"[{script}]"), F.regexp_replace(x, f"[^{script}a-z0-9]+", "")).otherwise(F.regexp_replace(x, "[^a-z0-9]+", ""))


def squeezed(c: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(c, f"[{BLANK}]+", "")


def is_quoted(c: Column) -> Column:
    return F.trim(c).rlike(r'(?s)^["“].*["”]\z')


def opening_quotes(c: Column) -> Column:
    """A straight quote that opens a Devanagari word becomes an opening one."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}\p{M}])'(?=['\u2018]*[\u0900-\u097F])", "\u2018")


# What a musical label starts with, and what a citation starts with.
MUSICAL_LABEL = rf"^[{BLANK}]*\((?:राग|तर्ज|ताल|दोहा|सोरठा)(?:[{BLANK}—–-]|\))"
CITATION = rf"^[{BLANK}]*\((?:गीता[{BLANK}]*|[०-९0-9]+।|कवीन्द्र[{BLANK}])"


def is_musical_label(c: Column) -> Column:
    return c.rlike(MUSICAL_LABEL)


def is_citation(c: Column) -> Column:
    return c.rlike(CITATION)


def preview(title: Column, verses: Column) -> Column:
    """The first eight lines that are no musical labels, in one line; the title if that is empty."""
    lines = F.slice(F.filter(verses, lambda v: ~is_musical_label(v)), 1, 8)
    return F.coalesce(F.nullif(F.array_join(lines, " "), F.lit("")), title)


# The order of the 25 designs that decorate entries in turn.
DESIGNS = [0, 5, 11, 15, 20, 1, 6, 12, 16, 21, 2, 7, 13, 17, 22, 3, 8, 14, 18, 23, 4, 9, 10, 19, 24]


def design(mode: Column, position: Column) -> Column:
    """The design of an entry: a polynomial hash of its collection's letters is where the turn starts."""
    n = len(DESIGNS)
    start = F.aggregate(F.split(mode, ""), F.lit(0), lambda h, ch: (h * 31 + F.ascii(ch)) % n)
    return F.element_at(F.array(*[F.lit(d) for d in DESIGNS]), (F.pmod(position + start, F.lit(n)) + 1).cast("int"))


# Glyphs in typing order. The mark of a pre-base vowel stands before its consonant cluster; another mark
# stands for r with that vowel before a consonant.
STRAY = {"ï": "", "Ó": "\u2019"}
PREBASE = ("ç((?:[क-ह]\u093c?)(?:\u094d[क-ह]\u093c?)*)", "$1\u093f")
REPH = ("\u0962([क-ह]\u093c?)", "र\u094d$1\u093f")


def glyph_order(c: Column) -> Column:
    """Typing order to text order: marks go behind what they belong to (three nested ones at most), and blanks collapse."""
    c = replaced(c, STRAY.items())
    for _ in range(3):
        c = F.regexp_replace(c, *PREBASE)
    return F.trim(F.regexp_replace(F.regexp_replace(c, *REPH), r"[ \t]+", " "))
