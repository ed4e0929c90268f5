"""Normalisation and tokenisation as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "ÅåÄäÖöÜüŠšČčŘřŽžŇňŤťĎďĚěÁáÉéÍíÓóÚúÝýŮůĄąĆćĘęŃńŚśŹźŻżŐőŰűĂăÂâÎîȘșȚțĞğİŞşÀàÇçÈèÊêËëÌìÏïÑñÒòÔôÕõÙùÛûŸÿ"
_OTHERS = {"Æ": "E", "æ": "e", "Ø": "O", "ø": "o", "ß": "s", "Ł": "L", "ł": "l", "ı": "i", "Ð": "D", "ð": "d", "Þ": "T", "þ": "t"}
FOLD_FROM = _ACCENTED + "".join(_OTHERS)
FOLD_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED) + "".join(_OTHERS.values())

#: Between the texts of two fields; also a word delimiter.
FIELD_MARK = "§"
DELIMITERS = " -/.,:;'`–—*&\\_(){}[]\t" + FIELD_MARK
DELIMITER_CLASS = r"[ \-/.,:;'`–—*&\\_(){}\[\]\t§]"
PAD = "\uffff"


def normalize(text: Column) -> Column:
    """White space to single spaces, Latin letters to their base letter; case and ends stay."""
    return F.regexp_replace(F.translate(text, "\t\n\r" + FOLD_FROM, "   " + FOLD_TO), " +", " ")


def normalize_with(text: Column, strings: dict[str, str], chars: dict[str, str]) -> Column:
    """The strings replaced in their order, then the characters."""
    for old, new in strings.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.translate(text, "".join(chars), "".join(chars.values())) if chars else text


def folded(text: Column) -> Column:
    return F.lower(normalize(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, DELIMITER_CLASS + "+"), lambda x: x != "")


def grams(text: Column, n: int) -> Column:
    """All runs of n characters; for short texts. Long ones are cheaper in trawl.operators.index."""
    size = F.length(text) - (n - 1)
    return F.when(size >= 1, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _real(found: Column, n: int, pad: int) -> Column:
    """Without the gram that is padding alone."""
    return F.filter(found, lambda g: g != PAD * n) if pad >= n else found


def _weighted(texts: Column, weight: float) -> Column:
    return F.transform(texts, lambda v: F.struct(F.lit(weight).alias("weight"), v.alias("text")))


def index_terms(text: Column, sizes: tuple[int, ...] = (3,), pad: int = 2) -> Column:
    """The terms of a document in the order in which they count: grams of the padded text by size, then words of at least the
    smallest size. Grams of padding alone are none."""
    padded = F.concat(F.lit(PAD * pad), text)
    parts = [_real(grams(padded, n), n, pad) for n in sizes]
    return F.concat(*parts, F.filter(words(text), lambda w: F.length(w) >= sizes[0]))


def query_terms(text: Column, sizes: tuple[int, ...] = (3,), pad: int = 2, limit: int | None = 128, high_resolution: bool = False) -> Column:
    """The terms of a query: words first, then grams of the padded text, the first `limit` of them (all for None), each once.

    With high_resolution also the text without its delimiters, and its grams.
    """
    padded = F.concat(F.lit(PAD * pad), text)
    parts = [F.filter(words(text), lambda w: F.length(w) >= sizes[0])] + [_real(grams(padded, n), n, pad) for n in sizes]
    if high_resolution:
        joined = F.array_join(words(text), "")
        parts += [grams(joined, n) for n in sizes] + [F.filter(F.array(joined), lambda x: x != "")]
    every = F.concat(*parts)
    return F.array_distinct(every if limit is None else F.slice(every, 1, limit))


def coverage_tokens(text: Column, min_word: int = 2) -> Column:
    """Distinct words of at least min_word characters in lower case, in the order of their first place."""
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: F.length(w) >= min_word))


def searchable(specs, dtypes: dict[str, str]) -> Column:
    """The texts of the indexable fields as structs (weight, text), the heaviest first; elements of arrays one by one, nulls none."""
    from trawl.plans.config import WEIGHTS

    ordered = sorted((s for s in specs if s.indexable), key=lambda s: ["high", "med", "low"].index(s.weight))
    parts = []
    for s in ordered:
        values = F.col(s.name).cast("array<string>") if dtypes[s.name].startswith("array") else F.array(F.col(s.name).cast("string"))
        texts = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
        parts.append(_weighted(texts, WEIGHTS[s.weight]))
    return F.concat(*parts)


def net_string(column: Column, dtype: str) -> Column:
    """The value as text, whole floating-point numbers without a fraction."""
    if dtype in ("double", "float"):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """The text as a number, or null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))
