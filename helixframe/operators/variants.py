"""Consensus, variants and their formats.

Site elements are rows (chrom, pos0, ordinal, base, minus, base_q, mapq); consensus rows are (chrom, pos1, ref, cons,
cons_q, snp_q, rms_mapq, depth, ...).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial, reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as L
from ..functions.sequence import bases_of, iupac_of
from . import intervals as I
from . import sites as S
from .alignments import aligned_stretches, laid_out, mask_reads
from .sequences import fetch_sequence, with_ref_base

BASES = "ACGT"
GENOTYPES = ["".join(g) for g in combinations_with_replacement(BASES, 2)]
#: Decibels of a natural logarithm, as the likelihoods are scaled: a fixed value.
SCALE = 4.343
SITE = ["chrom", "pos0"]
_UPPER = np.frombuffer(bytes(range(256)).upper(), np.uint8)


def site_elements(aln: DataFrame, mask: int = L.DEFAULT_MASK) -> DataFrame:
    """One row for each read base over each position; deletions have a null base. ``site_bin`` is the bin of positions that rows are dealt by."""
    parts = aligned_stretches(mask_reads(aln, mask).select("ordinal", "rname", "pos0", "cigar", "flag", "mapq", "seq", "qual")).drop("pos0", "cigar", "nx")
    at = laid_out(parts)
    q = (F.col("qpos") + F.col("pos0") - F.col("s0") + 1).cast("int")
    base = F.when(F.col("kind") == "M", F.upper(F.substr("seq", q, F.lit(1))))
    return at.select(F.col("rname").alias("chrom"), "pos0", "ordinal", base.alias("base"), L.has(F.col("flag"), L.REVERSE).alias("minus"), (F.ascii(F.substr("qual", q, F.lit(1))) - 33).alias("base_q"), "mapq", "site_bin")


def _site(elements: DataFrame) -> list[str]:
    """The columns of a site, with the bins by which ``site_elements`` has dealt it."""
    return [SITE[0], "site_bin", SITE[1]] if "site_bin" in elements.columns else SITE


def cheap_consensus(elements: DataFrame, mode: str) -> DataFrame:
    """``first`` read's base, a ``random`` one (fixed by hash), or the IUPAC code of the ``union`` of all."""
    rows = elements.filter(F.col("base").isin(*BASES))
    if mode == "union":
        held = rows.groupBy(*_site(rows)).agg(*(F.max(F.when(F.col("base") == b, b)).isNotNull().alias(f"has{b}") for b in BASES))
        return held.select(*SITE, iupac_of(F.concat(*(F.when(F.col(f"has{b}"), b).otherwise("") for b in BASES))).alias("cons"))
    order = F.col("ordinal") if mode == "first" else F.xxhash64(*SITE, "ordinal")
    return rows.groupBy(*_site(rows)).agg(F.min_by("base", order).alias("cons")).select(*SITE, "cons")


def indel_sites(pile: DataFrame) -> DataFrame:
    """Pileup rows with a read that has an insertion or deletion there."""
    return pile.filter("indels > 0")


def _log_het(n1: np.ndarray, n2: np.ndarray, n_hap: int, binomial: bool) -> np.ndarray:
    """log P(n1, n2 | heterozygote) over the haplotype counts of ``n_hap``."""
    norm = sum(1 / k for k in range(1, n_hap))
    total = 0.0
    for k in range(1, n_hap):
        a, b = math.log(k / n_hap), math.log(1 - k / n_hap)
        total = total + 0.5 / k / norm * (np.exp(n2 * a + n1 * b) + np.exp(n1 * a + n2 * b))
    out = np.log(total)
    if binomial:
        log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1025)))])
        out = out + log_fact[n1 + n2] - log_fact[n1] - log_fact[n2]
    return out


@lru_cache(2)
def _log_factorials(n: int) -> np.ndarray:
    return np.array([math.lgamma(i + 1) for i in range(n)])


def error_costs(q: int, n: int, theta: float, eta: float) -> np.ndarray:
    """For k = 0..n errors of quality q among n dependent reads: the scaled cost of k or more beyond what their qualities say."""
    e = 10 ** (-q / 10)
    k = np.arange(n + 1)
    log_fact = _log_factorials(max(256, n + 1))
    log_c = log_fact[n] - log_fact[k] - log_fact[n - k]
    tail = np.append(np.cumsum(np.exp(log_c + k * math.log(e) + (n - k) * math.log1p(-e))[::-1])[::-1], 0.0)
    ratio = np.minimum(tail[1:] / np.maximum(tail[:-1], 1e-300), 0.99)
    half = k // 2
    weight = np.where(half == 0, 1.0, theta**half * (1 - eta) + eta)
    with np.errstate(divide="ignore"):
        steps = -SCALE * weight * np.log(np.maximum(ratio, 1e-300) / e)
        last = -SCALE * np.log1p(-np.exp(weight * np.log(np.maximum(ratio, 1e-300))))
    return np.concatenate([[0.0], np.cumsum(steps[:-1])]) + last


def _damped(m: np.ndarray, theta: float, eta: float) -> np.ndarray:
    """What the first ``m`` equal bases of a strand count together: the n-th from 0 counts theta^n (1 - eta) + eta, those from the 256th on as the 256th."""
    each = theta ** np.arange(256.0) * (1 - eta) + eta
    return np.concatenate([[0.0], np.cumsum(each)])[np.minimum(m, 256)] + each[-1] * np.maximum(m - 256, 0)


#: A bar of a site's histogram as one long that sorts by base, strand and falling quality: base 2 bits, strand 1, 255 less quality 8, count 32.
_COUNT_BITS, _QUALITY_BITS = 32, 8
LIKELY = "chrom string, pos0 long, depth long, rms_mapq int, lk array<int>"


@lru_cache(4)
def _het_table(n_hap: int, binomial: bool) -> np.ndarray:
    """``_log_het`` of all counts up to 511."""
    n = np.arange(512)
    return _log_het(n[:, None], n[None, :], n_hap, binomial)


def _told_genotypes(site: np.ndarray, bar: np.ndarray, c: np.ndarray, n_sites: int, model: str, theta: float, n_hap: int, eta: float) -> pa.Array:
    """``lk`` of sites from bars in order of site, base, strand and falling quality, and their counts; all sites at once."""
    others = [[i for i, b in enumerate(BASES) if b not in g] for g in GENOTYPES]
    q = 255 - (bar & (1 << _QUALITY_BITS) - 1)
    group = site * 8 + (bar >> _QUALITY_BITS)  # base and strand of a site
    ran = np.cumsum(c)
    first = np.ones(len(bar), bool)
    first[1:] = group[1:] != group[:-1]
    before = ran - c
    before = before - before[np.maximum.accumulate(np.where(first, np.arange(len(bar)), 0))] if len(bar) else before
    d = _damped(before + c, theta, eta) - _damped(before, theta, eta)

    def by_base(x: np.ndarray) -> list[np.ndarray]:
        both = np.bincount(group, x, 8 * n_sites).astype(np.float64).reshape(n_sites, 4, 2)
        return [both[:, i, 0] + both[:, i, 1] for i in range(4)]

    n, f, e = [np.rint(x).astype(np.int64) for x in by_base(c)], by_base(d), by_base(q * d)
    total = n[0] + n[1] + n[2] + n[3]
    if (total > 255).any():
        n = [np.where(total > 255, np.floor(x * 254.0 / np.maximum(total, 1) + 0.5), x).astype(np.int64) for x in n]
        total = n[0] + n[1] + n[2] + n[3]
    added = lambda x, o: sum((x[i] for i in o[1:]), x[o[0]])
    v = [added(e, o) for o in others]
    if model == "maq":
        costs = cost_table(theta, eta)
        for i, o in enumerate(others):
            weight = added(f, o)
            mean = np.where(weight > 0, np.clip(np.floor(v[i] / np.where(weight > 0, weight, 1.0) + 0.5), 4, 63), 4).astype(np.int64)
            v[i] = v[i] + costs[mean, np.minimum(total, 255), np.minimum(added(n, o), 255)]  # rounded counts may add up to 256
    het = _het_table(n_hap, model == "maq")
    for i, g in enumerate(GENOTYPES):
        if g[0] != g[1]:
            v[i] = v[i] - SCALE * het[n[BASES.index(g[0])], n[BASES.index(g[1])]]
    if model == "maq":
        v = [np.maximum(x, 0.0) for x in v]
    least = reduce(np.minimum, v)
    lk = np.empty((n_sites, len(v)), np.int32)
    for i, x in enumerate(v):
        lk[:, i] = np.minimum(np.floor(x - least + 0.5), 255)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * n_sites + 1, len(v), dtype=np.int32)), pa.array(lk.ravel()))


def _likelihoods(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    """Sites (chrom, pos0, depth, rms_mapq, bars) with ``lk`` in place of their bars, all of a batch at once."""
    for batch in batches:
        bars = batch.column(4)
        site = np.repeat(np.arange(batch.num_rows), np.diff(bars.offsets.to_numpy()))
        bar = bars.flatten().to_numpy()
        order = np.lexsort((bar, site))
        site, bar = site[order], bar[order]
        lk = _told_genotypes(site, bar >> _COUNT_BITS, bar & (1 << _COUNT_BITS) - 1, batch.num_rows, **how)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], lk], names=["chrom", "pos0", "depth", "rms_mapq", "lk"])


#: Digits of bases by their letter, 4 for any other, and the mark of an element that has no bar.
_DIGIT = np.full(256, len(BASES), np.int64)
for _i, _b in enumerate(BASES):
    _DIGIT[ord(_b)] = _DIGIT[ord(_b.lower())] = _i
_NO_BAR = (1 << _QUALITY_BITS + 3) - 1


def _graded(b: pa.RecordBatch, at: S.Laid, cap: int) -> dict[str, np.ndarray]:
    """What reads add to the histograms of their positions: a bar or none, one base, and the square of the mapping quality (``cap`` where it is null)."""
    own = {name: b.column(i) for i, name in enumerate(b.schema.names)}
    qual, known = S.Text(own["qual"]), own["mapq"].is_valid().to_numpy(zero_copy_only=False)
    mapq = S.numbers(own["mapq"], 0)
    letter, has = S.Text(own["seq"]).at(at.row, at.place)
    digit = np.where(has & ~at.gone, _DIGIT[letter], len(BASES))
    byte, told = qual.at(at.row, at.place)
    base_q = np.where(told, byte.astype(np.int64), 0) - 33
    q = np.where(known[at.row], np.minimum(base_q, mapq[at.row]), base_q)
    q = np.where((q < 4) & (base_q > 0), 4, q)
    if not qual.known.all():
        q = np.where(qual.known[at.row], q, mapq[at.row])
    minus = (S.numbers(own["flag"], 0) & L.REVERSE != 0)[at.row]
    bar = np.where((digit < len(BASES)) & (q > 0), (digit * 2 + minus << _QUALITY_BITS) + 255 - q, _NO_BAR)
    square = np.where(known, np.minimum(mapq, cap), cap) ** 2
    return {"bar": bar, "c": np.ones(len(bar), np.int64), "sq": square[at.row]}


def _bars(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Equal bars of a site as one each, in order."""
    both = rows["site"] << _QUALITY_BITS + 3 | rows["bar"]
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return {"site": both[first] >> _QUALITY_BITS + 3, "bar": both[first] & _NO_BAR} | {k: np.add.reduceat(rows[k][order], first) for k in ("c", "sq")}


def _genotyped(names: list[str], bins: np.ndarray, rows: dict[str, np.ndarray], refs: None, **how) -> Iterator[pa.RecordBatch]:
    """Likelihoods of complete sites."""
    r = _bars(rows)
    first, count, site = S.site_runs(r["site"])
    depth, sq = (np.add.reduceat(r[k], first) for k in ("c", "sq"))
    rms = pa.array(np.floor(np.sqrt(sq / depth) + 0.499).astype(np.int32))
    good = r["bar"] != _NO_BAR
    lk = _told_genotypes(np.repeat(np.arange(len(site)), count)[good], r["bar"][good], r["c"][good], len(site), **how)
    yield pa.RecordBatch.from_arrays([*S.named(names, bins, site), pa.array(depth), rms, lk], names=["chrom", "pos0", "depth", "rms_mapq", "lk"])


def read_likelihoods(aln: DataFrame, model: str = "soap", theta: float = 0.85, n_hap: int = 2, eta: float = 0.03, cap: int = 60, mask: int = L.DEFAULT_MASK) -> DataFrame:
    """``genotype_likelihoods`` of what alignments show: reads are dealt by bins of positions and laid out behind the shuffle, as arrays."""
    rows = S.dealt_reads(mask_reads(aln, mask), ["flag", "mapq", "seq", "qual"])
    told = partial(_genotyped, model=model, theta=theta, n_hap=n_hap, eta=eta)
    return rows.mapInArrow(partial(S.swept, shown=partial(_graded, cap=cap), told=told, fold=_bars), LIKELY)


def genotype_likelihoods(elements: DataFrame, model: str = "soap", theta: float = 0.85, n_hap: int = 2, eta: float = 0.03, cap: int = 60) -> DataFrame:
    """(chrom, pos0, depth, rms_mapq, lk): scaled -log likelihoods of the ten genotypes, in GENOTYPES' order, less the least.

    Bases count with the lesser of base and mapping quality (4 at least where both are known); of equal bases on a strand
    the n-th best is damped by theta^n (1 - eta) + eta. ``soap`` takes errors as independent after that, ``maq`` adds the
    cost of dependent ones.

    A site is a histogram of its bases by strand and quality, so its size doesn't follow the depth; what a run of equal
    qualities counts is a difference of prefix sums of the damping, and sites are told a batch at a time.
    """
    site = _site(elements)
    q = F.least("base_q", "mapq")
    q = F.when((q < 4) & (F.col("base_q") > 0), 4).otherwise(q)
    mq = F.least("mapq", F.lit(cap)).cast("long")
    rows = elements.select(*site, "minus", "base", F.when(F.col("base").isin(*BASES), F.coalesce(q, F.lit(0))).otherwise(0).cast("int").alias("q"), (mq * mq).alias("sq"))
    hist = rows.groupBy(*site, "minus", "base", "q").agg(F.count(F.lit(1)).alias("c"), F.sum("sq").alias("sq"), F.count("sq").alias("known"))
    group = (F.instr(F.lit(BASES), F.col("base")) - 1) * 2 + F.col("minus").cast("int")
    bar = F.when(F.col("q") > 0, F.shiftleft(F.shiftleft(group.cast("long"), _QUALITY_BITS) + 255 - F.col("q"), _COUNT_BITS) + F.col("c"))
    g = hist.groupBy(*site).agg(F.sum("c").alias("depth"), F.floor(F.sqrt(F.try_divide(F.sum("sq"), F.sum("known"))) + 0.499).cast("int").alias("rms_mapq"), F.collect_list(bar).alias("bars"))
    told = partial(_likelihoods, model=model, theta=theta, n_hap=n_hap, eta=eta)
    return g.select(F.col("chrom"), F.col("pos0").cast("long").alias("pos0"), "depth", "rms_mapq", "bars").mapInArrow(told, LIKELY)


@lru_cache(2)
def cost_table(theta: float, eta: float) -> np.ndarray:
    """error_costs of all qualities (4 to 63), depths and numbers of errors up to 255."""
    out = np.zeros((64, 256, 256))
    for q in range(4, 64):
        for n in range(1, 256):
            out[q, n, : n + 1] = error_costs(q, n, theta, eta)
    out[:, :, 0] = 0.0
    return out


def heterozygote_prior(het: float = 0.001, n_hap: int = 2) -> int:
    rate = het * sum(1 / k for k in range(1, n_hap))
    return int(-SCALE * math.log(2 * rate / (1 - rate)) + 0.5)


def consensus(likelihoods: DataFrame, het: float = 0.001, n_hap: int = 2) -> DataFrame:
    """Best and second genotype as IUPAC codes with the distances to the second and third."""
    prior = heterozygote_prior(het, n_hap)
    codes = ["".join(sorted(set(g))) for g in GENOTYPES]
    named = F.array(*(iupac_of(F.lit(c)) for c in codes))
    ranked = F.sort_array(F.array(*((F.get("lk", F.lit(i)) + (prior if len(c) > 1 else 0)) * len(codes) + i for i, c in enumerate(codes))))
    r = likelihoods.withColumn("r", ranked)
    value = lambda k: F.floor(F.get("r", F.lit(k)) / len(codes)).cast("int")
    code = lambda k: F.get(named, F.pmod(F.get("r", F.lit(k)), F.lit(len(codes))))
    return r.select(*SITE, "depth", "rms_mapq", code(0).alias("cons"), code(1).alias("second"), F.least(value(1) - value(0), F.lit(255)).alias("cons_q"), F.least(value(2) - value(1), F.lit(255)).alias("next_q"))


def call_snps(calls: DataFrame, sequences: DataFrame) -> DataFrame:
    """Consensus rows with ``ref`` and ``snp_q``: 0 where they agree; what lies between consensus and reference otherwise."""
    ref = with_ref_base(calls.withColumnRenamed("chrom", "contig"), sequences).withColumnRenamed("contig", "chrom")
    q = F.when((F.col("ref") == "N") | (F.col("cons") == "N") | (F.col("cons") == F.col("ref")), 0).when(F.col("second") == F.col("ref"), F.col("cons_q")).otherwise(F.least(F.col("cons_q") + F.col("next_q"), F.lit(255)))
    return ref.select("chrom", (F.col("pos0") + 1).alias("pos1"), "ref", "cons", "cons_q", q.alias("snp_q"), "rms_mapq", "depth")


def variants_only(calls: DataFrame) -> DataFrame:
    """Indel rows and sites whose consensus differs from a known reference."""
    return calls.filter((F.col("ref") == "*") | ((F.col("cons") != F.upper("ref")) & (F.col("cons") != "N") & (F.col("ref") != "N")))


def genotype_of(ref: Column, cons: Column) -> Column:
    """struct<alt, gt> of a SNP consensus."""
    b = bases_of(cons)
    one, two = F.substr(b, F.lit(1), F.lit(1)), F.substr(b, F.lit(2), F.lit(1))
    alt = F.when(F.length(b) == 1, F.when(b == ref, ".").otherwise(b)).when(one == ref, two).when(two == ref, one).otherwise(F.concat_ws(",", one, two))
    gt = F.when(F.length(b) == 1, F.when(b == ref, "0/0").otherwise("1/1")).when((one == ref) | (two == ref), "0/1").otherwise("1/2")
    return F.struct(alt.alias("alt"), gt.alias("gt"))


def _indel_allele(a: Column) -> Column:
    return F.when(a.startswith("-"), F.concat(F.lit("D"), F.length(a) - 1)).when(a.startswith("+"), F.concat(F.lit("I"), F.substr(a, F.lit(2))))


def to_vcf(cns: DataFrame, sequences: DataFrame | None = None, snps: bool = True, indels: bool = True, keep_ref: bool = False) -> DataFrame:
    """VCF 3.3 columns of consensus rows: SNPs by IUPAC code, indels as I and D alleles with the reference base before them."""
    up = cns.withColumns({"ref": F.upper("ref"), "cons": F.upper("cons")})
    s = up.filter(F.col("ref") != "*")
    s = s.filter(F.lit(snps)) if keep_ref else s.filter(F.lit(snps) & (F.col("ref") != F.col("cons")))
    s = s.withColumn("g", genotype_of(F.col("ref"), F.col("cons")))
    i = up.filter((F.col("ref") == "*") & F.lit(indels))
    if sequences is not None:
        i = with_ref_base(i.drop("ref").withColumns({"contig": F.col("chrom"), "pos0": F.col("pos1") - 1}), sequences).drop("contig", "pos0")
    else:
        bases = up.filter(F.col("ref") != "*").groupBy("chrom", "pos1").agg(F.first("ref").alias("ref"))
        i = i.drop("ref").join(bases, ["chrom", "pos1"], "left").withColumn("ref", F.coalesce("ref", F.lit("N")))
    one, two = F.split_part("cons", F.lit("/"), F.lit(1)), F.split_part("cons", F.lit("/"), F.lit(2))
    none = (one == "*") & (two == "*")
    x, y = _indel_allele(F.when(none, F.upper("a1")).otherwise(one)), _indel_allele(F.when(none, F.upper("a2")).otherwise(two))
    alt = F.when(x.isNull(), y).when(y.isNull() | (x == y), x).otherwise(F.concat_ws(",", x, y))
    gt = F.when(x.isNull() | y.isNull(), "0/1").when(x == y, "1/1").otherwise("1/2")
    i = i.withColumn("g", F.struct(alt.alias("alt"), gt.alias("gt"))).filter("g.alt is not null")
    row = lambda t: t.select(F.col("chrom").alias("CHROM"), F.col("pos1").alias("POS"), F.lit(".").alias("ID"), F.col("ref").alias("REF"), F.col("g.alt").alias("ALT"), F.col("snp_q").alias("QUAL"), F.lit("0").alias("FILTER"), F.concat(F.lit("DP="), "depth").alias("INFO"), F.lit("GT:GQ:DP").alias("FORMAT"), F.concat_ws(":", "g.gt", "cons_q", "depth").alias("SAMPLE"))
    return row(s).unionByName(row(i))


def _runs(cigar: str) -> list[tuple[int, str]]:
    """The operations of a CIGAR text."""
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def differences(cigar: str, seq: np.ndarray, ref: np.ndarray, equal: bool) -> tuple[str, int, bytes]:
    """MD, NM and the sequence (``=`` for equal bases where asked) of a read, from arrays of its and the reference's characters.

    Stretches of bases are compared at once; what the text tells are the places that differ and the deletions between them.
    """
    upper, own, shown = _UPPER[seq], _UPPER[ref], seq.copy()
    marks: list[tuple[int, str]] = []  # aligned bases before each mark, and the mark
    nm = q = r = aligned = 0
    for n, op in _runs(cigar):
        if op in "M=X":
            n = min(n, len(seq) - q, len(ref) - r)
            same = (upper[q : q + n] == own[r : r + n]) | (upper[q : q + n] == ord("="))
            if equal:
                shown[q : q + n][same] = ord("=")
            off = np.flatnonzero(~same)
            marks += zip((aligned + off).tolist(), own[r + off].tobytes().decode(), strict=True)
            nm, aligned, q, r = nm + len(off), aligned + n, q + n, r + n
        elif op == "D":
            marks.append((aligned, "^" + own[r : r + n].tobytes().decode()))
            nm, r = nm + n, r + n
        elif op == "N":
            r += n
        elif op in "IS":
            nm, q = nm + (n if op == "I" else 0), q + n
    told, before = [], 0
    for at, mark in marks:
        told += [str(at - before), mark]
        before = at + (mark[0] != "^")
    return "".join([*told, str(aligned - before)]), nm, shown[:q].tobytes()


def recompute_md(aln: DataFrame, sequences: DataFrame, equal: bool = False, max_nm: int = 0) -> DataFrame:
    """``aln`` with ``md`` and ``nm`` against the reference; ``equal`` writes equal bases as ``=``; reads over ``max_nm`` lose their sequence."""
    end = F.col("pos0") + F.greatest(L.reference_length(L.parse_cigar(F.col("cigar"))), F.lit(1))
    spans = aln.select(F.col("rname").alias("contig"), F.col("pos0").cast("long").alias("start0"), end.alias("end1")).distinct()
    ref = fetch_sequence(sequences, spans).withColumnsRenamed({"contig": "rname", "start0": "pos0", "seq": "_ref"})

    @F.pandas_udf("struct<md:string,nm:int,seq:string>")
    def marked(cigar: pd.Series, seq: pd.Series, own: pd.Series) -> pd.DataFrame:
        chars = lambda x: np.frombuffer(x.encode("latin-1", "replace"), np.uint8)
        told = [differences(c, chars(s), chars(r), equal) for c, s, r in zip(cigar, seq, own, strict=True)]
        return pd.DataFrame([(md, nm, s.decode("latin-1")) for md, nm, s in told], columns=["md", "nm", "seq"])

    found = aln.withColumns({"end1": end, "pos0": F.col("pos0").cast("long")}).join(ref, ["rname", "pos0", "end1"], "left")
    done = found.withColumn("_m", marked("cigar", "seq", F.coalesce("_ref", F.lit("")))).withColumns({"md": F.col("_m.md"), "nm": F.col("_m.nm")})
    seq = F.when((F.lit(max_nm) > 0) & (F.col("nm") >= max_nm), F.repeat(F.lit("N"), F.length("seq"))).otherwise(F.col("_m.seq"))
    return done.withColumn("seq", seq).drop("_m", "_ref", "end1")


def consensus_fastq(cns: DataFrame, d: int = 3, D: int = 255, Q: int = 25, G: int = 25, l: int = 10, chunk: int = 10_000) -> DataFrame:
    """(chrom, chunk, seq, qual): the consensus in pieces of ``chunk`` bases, n where nothing was called.

    Bases are lower case where depth or mapping quality leaves the bounds and within ``l`` of an indel of ``G`` or more.
    """
    snp = cns.filter(F.col("ref") != "*")
    gap = cns.filter((F.col("ref") == "*") & (F.col("cons") != "*/*") & (F.col("snp_q") >= G)).select("chrom", F.explode(F.sequence(F.greatest(F.col("pos1") - l, F.lit(1)), F.col("pos1") + l)).alias("pos1")).distinct().withColumn("near", F.lit(True))
    rows = snp.join(gap, ["chrom", "pos1"], "left")
    weak = (F.col("rms_mapq") < Q) | (F.col("depth") < d) | (F.col("depth") > D) | F.coalesce("near", F.lit(False))
    own = rows.select("chrom", "pos1", F.floor((F.col("pos1") - 1) / chunk).alias("chunk"), F.when(weak, F.lower("cons")).otherwise(F.upper("cons")).alias("b"), F.char(F.least("cons_q", F.lit(93)) + 33).alias("q"))
    own = own.groupBy("chrom", "chunk", "pos1").agg(F.min(F.struct("b", "q")).alias("m")).select("chrom", "chunk", "pos1", "m.b", "m.q")
    held = own.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("pos1").cast("long").alias("pos1"), "b", "q"))).alias("e"))
    top = own.groupBy("chrom").agg(F.max("pos1").cast("long").alias("top"))
    chunks = top.select("chrom", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - 1) / chunk))).alias("chunk"))
    none = F.array().cast("array<struct<pos1:bigint,b:string,q:string>>")
    first, last = F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("top"))
    full = chunks.join(held, ["chrom", "chunk"], "left").withColumn("e", F.concat(F.coalesce("e", none), F.array(F.struct((last + 1).alias("pos1"), F.lit("").alias("b"), F.lit("").alias("q")))))
    # before each called base as many fillers as places lie behind the one before it
    gap = lambda x, i: x["pos1"] - 1 - F.when(i == 0, first).otherwise(F.get("e", i - 1)["pos1"])
    pick = lambda k, fill: F.array_join(F.transform("e", lambda x, i: F.concat(F.repeat(F.lit(fill), gap(x, i).cast("int")), x[k])), "")
    return full.select("chrom", "chunk", pick("b", "n").alias("seq"), pick("q", "!").alias("qual"))


def read_indels(aln: DataFrame, mask: int = L.DEFAULT_MASK) -> DataFrame:
    """(chrom, pos0, ordinal, kind, mapq): insertions (+bases) and deletions (-length) after a read's base at pos0."""
    parts = aligned_stretches(mask_reads(aln, mask).select("ordinal", "rname", "pos0", "cigar", "mapq", "seq")).drop("pos0")
    p = parts.withColumns({f"n_{k}": F.col(f"nx.{k}") for k in ("s", "e", "q", "k")})
    used = F.col("qpos") + F.col("e1") - F.col("s0")
    ins = F.when((F.col("n_s") == F.col("e1")) & (F.col("n_k") == "M") & (F.col("n_q") > used), F.concat(F.lit("+"), F.upper(F.substr("seq", (used + 1).cast("int"), (F.col("n_q") - used).cast("int")))))
    gone = F.when(F.col("n_k") == "D", F.concat(F.lit("-"), F.col("n_e") - F.col("n_s")))
    return p.filter("kind = 'M'").withColumn("indel", F.coalesce(ins, gone)).filter("indel is not null").select(F.col("rname").alias("chrom"), (F.col("e1") - 1).alias("pos0"), "ordinal", F.col("indel").alias("kind"), "mapq")


def indel_calls(aln: DataFrame, sequences: DataFrame | None = None, q_indel: int = 40, r_indel: float = 0.00015, mask: int = L.DEFAULT_MASK) -> DataFrame:
    """Indel rows of a consensus pileup: the best genotype of the two kinds that most reads show at each site with an indel.

    A read speaks by its own alignment, with the lesser of its mapping quality and ``q_indel``; reads without an indel
    there count as the reference. Kinds other than the reference pay the scaled prior ``r_indel``. cons_q is the distance
    to the next genotype, snp_q that to the reference. Deletions are written with their bases where ``sequences`` are given.
    """
    found = read_indels(aln, mask)
    sites = found.select(*SITE).distinct()
    over = I.point_join(sites, aligned_stretches(mask_reads(aln, mask).select("ordinal", "rname", "pos0", "cigar", "mapq")).drop("pos0").filter("kind = 'M'").select(F.col("rname").alias("chrom"), "s0", "e1", "ordinal", "mapq"), "pos0", ("s0", "e1")).select(*SITE, "ordinal", "mapq")
    each = over.join(found.select(*SITE, "ordinal", "kind"), [*SITE, "ordinal"], "left").withColumns({"kind": F.coalesce("kind", F.lit("*")), "w": F.least("mapq", F.lit(q_indel))})
    kinds = each.groupBy(*SITE, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("mapq") * F.col("mapq")).alias("sq"))
    g = kinds.groupBy(*SITE).agg(F.sum("n").alias("depth"), F.sum("w").alias("all"), F.sum("sq").alias("sq"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n", "w"))).alias("k"))
    none = F.struct(F.lit(0).cast("long").alias("m"), F.lit("*").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"))
    g = g.withColumns({"x": F.get("k", F.lit(0)), "y": F.coalesce(F.get("k", F.lit(1)), none), "n_ref": F.coalesce(F.get(F.filter("k", lambda t: t["kind"] == "*"), F.lit(0))["w"], F.lit(0))})
    cost, half = -SCALE * math.log(r_indel), SCALE * math.log(2)
    prior = lambda t: F.when(t["kind"] == "*", 0.0).otherwise(cost)
    x, y = F.col("x"), F.col("y")
    one, two = F.col("all") - x["w"] + prior(x), F.col("all") - y["w"] + prior(y)
    both = F.col("all") - x["w"] - y["w"] + half * (x["n"] + y["n"]) + F.greatest(prior(x), prior(y))
    ref = (F.col("all") - F.col("n_ref")).cast("double")
    slash = lambda a, b: F.concat_ws("/", a, b)
    ranked = F.array_sort(F.array(F.struct(one.alias("v"), slash(x["kind"], x["kind"]).alias("g")), F.struct(two.alias("v"), slash(y["kind"], y["kind"]).alias("g")), F.struct(both.alias("v"), slash(F.least(x["kind"], y["kind"]), F.greatest(x["kind"], y["kind"])).alias("g"))))
    r = g.withColumn("r", ranked)
    q = lambda c: F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(255)).cast("int")
    out = r.select("chrom", (F.col("pos0") + 1).alias("pos1"), F.lit("*").alias("ref"), F.get("r", F.lit(0))["g"].alias("cons"), q(F.get("r", F.lit(1))["v"] - F.get("r", F.lit(0))["v"]).alias("cons_q"), q(ref - F.get("r", F.lit(0))["v"]).alias("snp_q"), F.floor(F.sqrt(F.col("sq") / F.col("depth")) + 0.499).cast("int").alias("rms_mapq"), "depth", x["kind"].alias("a1"), y["kind"].alias("a2"), x["n"].alias("cnt1"), y["n"].alias("cnt2"), (F.col("depth") - x["n"] - y["n"]).alias("cnt_other"))
    if sequences is None:
        return out
    size = lambda c: F.coalesce(F.regexp_extract(c, r"-(\d+)", 1).try_cast("int"), F.lit(0))
    spans = out.withColumns({"contig": F.col("chrom"), "start0": F.col("pos1"), "end1": F.col("pos1") + F.greatest(size("a1"), size("a2"))})
    got = fetch_sequence(sequences, spans)
    written = lambda k: F.when(F.col(k).startswith("-"), F.concat(F.lit("-"), F.substr("seq", F.lit(1), size(k)))).otherwise(F.col(k))
    part = lambda c: F.when(c == F.col("o1"), F.col("a1")).when(c == F.col("o2"), F.col("a2")).otherwise(c)
    named = got.withColumns({"o1": F.col("a1"), "o2": F.col("a2")}).withColumns({"a1": written("a1"), "a2": written("a2")})
    return named.withColumn("cons", slash(part(F.split_part("cons", F.lit("/"), F.lit(1))), part(F.split_part("cons", F.lit("/"), F.lit(2))))).select(*out.columns)
