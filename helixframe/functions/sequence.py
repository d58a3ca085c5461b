"""Columns of bases, texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes of base sets: fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "AC": "M", "GT": "K", "CG": "S", "AT": "W", "ACT": "H", "CGT": "B", "ACG": "V", "AGT": "D", "ACGT": "N"}


def complement(c: Column) -> Column:
    """Watson-Crick partners, case kept; what is no base stays."""
    return F.translate(c, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def normalize_bases(c: Column) -> Column:
    """Upper case, with U as T and all but ACGT as N."""
    return F.regexp_replace(F.translate(F.upper(c), "U", "T"), "[^ACGT]", "N")


def iupac_of(bases: Column) -> Column:
    """The code of a string of distinct sorted bases, N for others."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv)), bases), F.lit("N"))


def bases_of(code: Column) -> Column:
    """The base set of an IUPAC code."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in IUPAC.items() for x in (v, k))), F.upper(code))


def split_nonempty(c: Column, pattern: str) -> Column:
    return F.filter(F.split(c, pattern), lambda x: x != "")


def replace_last(c: Column, old: str, new: str) -> Column:
    """The last occurrence of a text replaced."""
    at = F.length(c) - F.instr(F.reverse(c), old[::-1]) - len(old) + 2
    return F.when(F.instr(c, old) > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(new), F.substr(c, at + len(old)))).otherwise(c)


def strip(c: Column, chars: str = " \t\r\n") -> Column:
    return F.trim(c, F.lit(chars))


def escape_text(c: Column) -> Column:
    """Backslashes, tabs, feeds and quotes as backslash codes."""
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def common_prefix(a: Column, b: Column) -> Column:
    """The longest text that both begin with."""
    n = F.least(F.length(a), F.length(b))
    size = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    return F.substr(a, F.lit(1), size)


def shuffle_characters(c: Column, seed: int = 0) -> Column:
    """The characters in an order fixed by their places, the seed and the text."""
    keyed = F.transform(F.split(c, ""), lambda x, i: F.struct(F.xxhash64(F.lit(seed), c, i).alias("k"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "")


def parse_int(c: Column) -> Column:
    return c.try_cast("bigint")


def parse_float(c: Column) -> Column:
    return c.try_cast("double")
