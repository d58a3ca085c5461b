"""Columns of alignment records: FLAG, CIGAR, tags and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FLAG bits and the letters that show them, lowest bit first: fixed values of the format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE = (1 << i for i in range(11))
FLAG_LETTERS = "pPuUrR12sfd"
DEFAULT_MASK = UNMAPPED | SECONDARY | FAILED | DUPLICATE


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def lacks(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == 0


def flag_letters(flag: Column) -> Column:
    return F.concat(*(F.when(has(flag, 1 << i), x).otherwise("") for i, x in enumerate(FLAG_LETTERS)))


def flag_hex(flag: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(flag)))


def parse_cigar(text: Column) -> Column:
    """array<struct<op, len>> of a CIGAR text; empty for ``*``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def cigar_sum(cigar: Column, ops: str) -> Column:
    """The summed lengths of some operations."""
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(*ops), x["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    return cigar_sum(cigar, "MDN=X")


def reference_length_of_text(text: Column) -> Column:
    """``reference_length`` of a CIGAR text."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda a, n: a + n.cast("int"))


def stretches(pos0: Column, cigar: Column) -> Column:
    """array<struct<s, e, q, k>> of a parsed CIGAR's stretches on the reference: start, end, place in the read, kind M (bases) or D (deleted); skips leave none."""
    start = F.struct(pos0.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<s:bigint,e:bigint,q:bigint,k:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        base, gone, skip, extra = x["op"].isin("M", "=", "X"), x["op"] == "D", x["op"] == "N", x["op"].isin("I", "S")
        piece = F.array(F.struct(a["r"].alias("s"), (a["r"] + x["len"]).alias("e"), a["q"].alias("q"), F.when(gone, "D").otherwise("M").alias("k")))
        return F.struct(
            F.when(base | gone | skip, a["r"] + x["len"]).otherwise(a["r"]).alias("r"),
            F.when(base | extra, a["q"] + x["len"]).otherwise(a["q"]).alias("q"),
            F.when(base | gone, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(cigar, start, step, lambda a: a["out"])


def reference_end(pos0: Column, cigar: Column) -> Column:
    return pos0 + reference_length(cigar)


def query_length(cigar: Column) -> Column:
    return cigar_sum(cigar, "MIS=X")


def alignment_length(cigar: Column) -> Column:
    return cigar_sum(cigar, "MI")


def strand_of(flag: Column) -> Column:
    return F.when(has(flag, REVERSE), "-").otherwise("+")


def five_prime(pos0: Column, flag: Column, cigar: Column) -> Column:
    """The base that the read's 5' end lies on: the start, or the end of a reverse read."""
    return F.when(has(flag, REVERSE), reference_end(pos0, cigar)).otherwise(pos0)


def quality_sum(qual: Column, least: int = 15) -> Column:
    """Summed base qualities of at least ``least``."""
    return F.aggregate(qual, F.lit(0).cast("long"), lambda a, q: a + F.when(q >= least, q).otherwise(0))


def decode_quality(text: Column, offset: int = 33) -> Column:
    return F.when(text == "*", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x) - offset))


def solexa_to_sanger(qual: Column, cap: int = 93) -> Column:
    """Solexa-scaled qualities on the Phred scale."""
    return F.transform(qual, lambda q: F.least(F.floor(F.lit(10.0) * F.log10(F.pow(F.lit(10.0), q / 10.0) + 1) + 0.499).cast("int"), F.lit(cap)))


def tag_int(aux: Column, tag: str) -> Column:
    return F.get(F.array(F.element_at(aux, tag)["value"]), F.lit(0)).try_cast("bigint")


def tag_float(aux: Column, tag: str) -> Column:
    return F.element_at(aux, tag)["value"].try_cast("double")


def tag_text(aux: Column, tag: str) -> Column:
    return F.element_at(aux, tag)["value"]
