"""Alignment sources and sinks, and conversion of other aligners' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alignment as L
from ..functions.bounds import parse_region
from ..functions.sequence import reverse_complement

FIELDS = "qname flag rname pos1 mapq cigar mrnm mpos1 isize seq qual".split()


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``ordinal``, their place: the file's name and the order in it."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("v"), F.monotonically_increasing_id().alias("ordinal")).filter("v <> ''")


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alignments, contigs, read_groups); rows of at least eleven fields, header lines told by ``@``.

    ``=`` as mate contig is written out; tags are a map of type and value; qualities stay text.
    """
    lines = _numbered(spark, path)
    f = lambda i: F.get("f", F.lit(i))
    rows = lines.filter(~F.col("v").startswith("@")).select("ordinal", F.split("v", "\t").alias("f")).filter(F.size("f") >= 11)
    tags = F.transform(F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: t.rlike(r"^[A-Za-z][A-Za-z0-9]:.:")), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)).alias("k"), F.struct(F.substr(t, F.lit(4), F.lit(1)).alias("type"), F.substr(t, F.lit(6)).alias("value")).alias("v")))
    # columns of their own that are read several times, so that no expression over them tells them anew for each element
    rows = rows.withColumn("_tags", tags).withColumn("_keys", F.transform("_tags", lambda t: t["k"]))
    once = F.filter("_tags", lambda t: F.array_position("_keys", t["k"]) == F.array_position("_tags", t))
    first = F.map_from_entries(F.when(F.size(F.array_distinct("_keys")) == F.size("_keys"), F.col("_tags")).otherwise(once))
    num = lambda i: f(i).try_cast("bigint")
    aln = rows.select("ordinal", f(0).alias("qname"), num(1).cast("int").alias("flag"), f(2).alias("rname"), (num(3) - 1).alias("pos0"), num(4).cast("int").alias("mapq"), f(5).alias("cigar"), F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("mrnm"), (num(7) - 1).alias("mpos0"), num(8).alias("isize"), f(9).alias("seq"), f(10).alias("qual"), first.alias("aux"))
    aln = aln.withColumn("rg", L.tag_text(F.col("aux"), "RG"))
    at = lambda k: F.regexp_extract("v", rf"\t{k}:([^\t]*)", 1)
    sq = lines.filter(F.col("v").startswith("@SQ"))
    contigs = sq.select((F.row_number().over(Window.orderBy("ordinal")) - 1).alias("tid"), at("SN").alias("name"), at("LN").try_cast("bigint").alias("length"))  # header lines, a few thousand at most
    groups = lines.filter(F.col("v").startswith("@RG")).select(at("ID").alias("rg_id"), F.nullif(at("LB"), F.lit("")).alias("library"))
    return aln, contigs, groups


def sam_lines(aln: DataFrame, flag_style: str = "dec") -> DataFrame:
    """Alignments as text lines; flags as numbers, ``hex`` or ``letters``."""
    flag = {"dec": F.col("flag").cast("string"), "hex": L.flag_hex(F.col("flag")), "letters": L.flag_letters(F.col("flag"))}[flag_style]
    mate = F.when((F.col("mrnm") == F.col("rname")) & (F.col("rname") != "*"), "=").otherwise(F.col("mrnm"))
    tags = F.transform(F.map_entries(F.coalesce("aux", F.create_map().cast("map<string,struct<type:string,value:string>>"))), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])) if "aux" in aln.columns else F.array().cast("array<string>")
    cols = ["qname", flag, "rname", (F.col("pos0") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", mate, (F.col("mpos0") + 1).cast("string"), F.col("isize").cast("string"), "seq", "qual"]
    return aln.select(F.concat_ws("\t", *cols, tags).alias("value"))


def write_sam(aln: DataFrame, path: str, flag_style: str = "dec") -> None:
    sam_lines(aln, flag_style).write.mode("overwrite").text(path)


#: Bases of a fine bin, as a power of two, and classes of how many bins a read reaches beyond that of its start.
BIN_BITS, REACHES = 14, (0, *(1 << k for k in range(16)))
#: Regions that are given to the scan one by one; of more, the scan gets each contig's least and greatest place.
PUSHED_REGIONS = 256


def binned(aln: DataFrame) -> DataFrame:
    """``aln`` with ``bin14`` and ``reach`` of ``convert_alignments``."""
    end = F.greatest(F.col("pos0") + L.reference_length_of_text(F.col("cigar")), F.col("pos0") + 1)
    bins = aln.withColumn("_bins", F.shiftright(end - 1, BIN_BITS) - F.shiftright("pos0", BIN_BITS))
    reach = F.coalesce(*(F.when(F.col("_bins") <= r, r) for r in REACHES), F.lit(REACHES[-1]))  # read once a class, hence told once a row
    return bins.withColumns({"bin14": F.shiftright("pos0", BIN_BITS), "reach": reach}).drop("_bins")


def convert_alignments(spark: SparkSession, src: str, dst: str, row_group_bytes: int | None = None) -> None:
    """SAM text to columnar files that ``fetch_regions`` reads by region.

    ``bin14`` is the fine bin of a read's start and ``reach`` the least of REACHES that is no less than the bins it reaches
    beyond that; reads of one reach are in one folder, sorted by place, so row groups have narrow bounds of bins.
    """
    aln, _, _ = read_sam(spark, src)
    rows = binned(aln)
    order = ["reach", "rname", "bin14", "pos0", "ordinal"]
    writer = rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("reach")
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(dst)


def _pushed(regions: list[tuple[str, int, int]]) -> Column:
    """A predicate on the stored columns that all reads over the regions fulfil, in terms that a scan checks against its row groups' bounds."""
    if len(regions) > PUSHED_REGIONS:
        most: dict[str, tuple[int, int]] = {}
        for c, a, z in regions:
            most[c] = (min(a, most.get(c, (a, z))[0]), max(z, most.get(c, (a, z))[1]))
        regions = [(c, a, z) for c, (a, z) in most.items()]
    terms = F.lit(False)
    for reach in REACHES:
        near = F.lit(False)
        for c, a, z in regions:
            near = near | ((F.col("rname") == c) & (F.col("bin14") >= (a >> BIN_BITS) - reach) & (F.col("bin14") <= (z - 1) >> BIN_BITS))
        terms = terms | ((F.col("reach") == reach) & near)
    return terms


def fetch_regions(spark: SparkSession, path: str, regions: list[str] | list[tuple[str, int, int | None]]) -> DataFrame:
    """Alignments of ``convert_alignments``' files that overlap regions (texts or chrom, start0, end1), once for each region, with r_start0 and r_end1.

    Regions are turned to bins for each reach, and these bounds go to the scan, which skips folders and row groups outside
    them; the reads that are left are compared with the regions' bounds.
    """
    from ..operators.alignments import view_regions

    top = 1 << 29
    if regions and isinstance(regions[0], str):
        told = spark.createDataFrame([(r,) for r in regions], "r string").select(parse_region(F.col("r")).alias("p")).select("p.*").collect()
        regions = [(r.chrom, r.start0, r.end1) for r in told]
    bounds = [(c, a, top if z is None else z) for c, a, z in regions]
    asked = spark.createDataFrame(bounds, "chrom string, start0 long, end1 long")
    return view_regions(spark.read.parquet(path).filter(_pushed([b for b in bounds if b[1] < b[2]])), asked)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, length) of a list of names and lengths, in order."""
    rows = _numbered(spark, path).select("ordinal", F.split("v", r"\s+").alias("f"))
    return rows.select((F.row_number().over(Window.orderBy("ordinal")) - 1).alias("tid"), F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).try_cast("bigint").alias("length"))  # a list of contigs


def read_mapview(spark: SparkSession, path: str) -> DataFrame:
    """(qname, chrom, pos0, strand, mapq, nm) of sixteen-column match lines."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).select(F.split("v", "\t").alias("f")).filter(F.size("f") >= 10)
    return rows.select(f(0).alias("qname"), f(1).alias("chrom"), (f(2).try_cast("bigint") - 1).alias("pos0"), f(3).alias("strand"), f(6).try_cast("int").alias("mapq"), f(9).try_cast("int").alias("nm"))


def read_cns_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Consensus pileup lines; indel lines (``*``) have alleles and their counts."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).select(F.split("v", r"\t| +").alias("f")).filter(F.size("f") >= 8)
    n = lambda i: f(i).try_cast("int")
    gap = f(2) == "*"
    return rows.select(f(0).alias("chrom"), f(1).try_cast("bigint").alias("pos1"), f(2).alias("ref"), f(3).alias("cons"), n(4).alias("cons_q"), n(5).alias("snp_q"), n(6).alias("rms_mapq"), n(7).alias("depth"), F.when(gap, f(8)).otherwise("*").alias("a1"), F.when(gap, f(9)).otherwise("*").alias("a2"), F.when(gap, n(10)).alias("cnt1"), F.when(gap, n(11)).alias("cnt2"), F.when(gap, n(12)).alias("cnt_other"))


#: Header lines of the variant format, version 3.3: fixed values.
VCF_HEADER = ("##fileformat=VCFv3.3", '##INFO=DP,1,Integer,"Total Depth"', '##FORMAT=GT,1,String,"Genotype"', '##FORMAT=GQ,1,Integer,"Genotype Quality"', '##FORMAT=DP,1,Integer,"Read Depth"')


def write_vcf(calls: DataFrame, path: str, sample: str = "data") -> None:
    """Rows of to_vcf in order of place, as text parts; the header is a part of its own before them."""
    spark = calls.sparkSession
    names = [c if c != "SAMPLE" else sample for c in calls.columns]
    head = spark.createDataFrame([("\n".join([*VCF_HEADER, "#" + "\t".join(names)]),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(path)
    calls.orderBy("CHROM", "POS").select(F.concat_ws("\t", *calls.columns).alias("value")).write.mode("append").text(path)


def write_fastq(reads: DataFrame, path: str, n_out: int = 20) -> None:
    reads.repartition(n_out).select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(path)


def _record(qname, flag, rname, pos0, mapq, cigar, seq, qual, **more) -> list[Column]:
    base = {"qname": qname, "flag": flag.cast("int"), "rname": rname, "pos0": pos0.cast("long"), "mapq": mapq.cast("int"), "cigar": cigar, "mrnm": F.lit("*"), "mpos0": F.lit(-1).cast("long"), "isize": F.lit(0).cast("long"), "seq": seq, "qual": qual}
    return [c.alias(k) for k, c in (base | more).items()]


def _pair_up(rows: DataFrame, second: str) -> DataFrame:
    """Mates of one name joined: flags, places and the distance of the 5' ends; ``second`` marks second reads."""
    from ..operators.alignments import fix_mates

    both = F.count(F.lit(1)).over(Window.partitionBy("qname")) >= 2
    bits = F.when(both, F.lit(L.PAIRED).bitwiseOR(F.when(F.col(second), L.SECOND).otherwise(L.FIRST))).otherwise(0)
    return fix_mates(rows.withColumn("flag", F.col("flag").bitwiseOR(bits))).drop(second)


def normalize_bowtie(spark: SparkSession, path: str) -> DataFrame:
    """One best hit a read of default output lines: fewest mismatches; quality 0 if tied, at most 15 if the next has one more."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).select("ordinal", F.split("v", "\t", -1).alias("f")).filter(F.size("f") >= 6)
    edits = F.filter(F.split(F.coalesce(f(7), F.lit("")), ","), lambda x: x != "")
    r = rows.select("ordinal", "f", edits.alias("edits"), F.size(edits).alias("nm"))
    w = Window.partitionBy(f(0)).orderBy("nm", "ordinal")
    r = r.withColumns({"_r": F.row_number().over(w), "_next": F.lead("nm").over(w)}).filter("_r = 1")
    q = F.when(F.col("_next") == F.col("nm"), 0).when(F.col("_next") == F.col("nm") + 1, 15).otherwise(25)
    minus, size = f(1) == "-", F.length(f(4))
    at = lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("int")
    places = F.array_sort(F.transform("edits", lambda x: F.struct(F.when(minus, size - 1 - at(x)).otherwise(at(x)).alias("p"), F.substr(F.split_part(x, F.lit(":"), F.lit(2)), F.lit(1), F.lit(1)).alias("b"))))
    md = F.aggregate(places, F.struct(F.lit(0).alias("at"), F.lit("").alias("t")), lambda a, x: F.struct((x["p"] + 1).alias("at"), F.concat(a["t"], x["p"] - a["at"], x["b"]).alias("t")), lambda a: F.concat(a["t"], size - a["at"]))
    return r.select("ordinal", *_record(f(0), F.when(minus, L.REVERSE).otherwise(0), f(2), f(3).cast("long"), q, F.concat(size, F.lit("M")), f(4), f(5), nm=F.col("nm"), md=md))


def normalize_soap(spark: SparkSession, path: str) -> DataFrame:
    """Lines of name, sequence, quality, hits, pair letter, length, strand, contig, position: quality 30 if unique, else 0."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).select("ordinal", F.split("v", "\t").alias("f")).filter(F.size("f") >= 9)
    name = F.regexp_replace(f(0), r"/[12]$", "")
    one = rows.select("ordinal", *_record(name, F.when(f(6) == "-", L.REVERSE).otherwise(0), f(7), f(8).cast("long") - 1, F.when(f(3) == "1", 30).otherwise(0), F.concat(F.length(f(1)), F.lit("M")), f(1), f(2), _second=f(4) == "b"))
    return _pair_up(one, "_second")


def normalize_zoom(spark: SparkSession, path: str) -> DataFrame:
    """Lines of name, sequence, contig, position (from 0), strand: quality 30."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).select("ordinal", F.split("v", "\t").alias("f")).filter(F.size("f") >= 5)
    one = rows.select("ordinal", *_record(F.regexp_replace(f(0), r"/[12]$", ""), F.when(f(4) == "-", L.REVERSE).otherwise(0), f(2), f(3).cast("long"), F.lit(30), F.concat(F.length(f(1)), F.lit("M")), f(1), F.lit("*"), _second=f(0).endswith("/2")))
    return _pair_up(one, "_second")


def normalize_novo(spark: SparkSession, path: str) -> DataFrame:
    """Lines of name, side, sequence, quality, status, score, quality, contig, position, strand: the greater of two scores; only mapped lines."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).filter(~F.col("v").startswith("#")).select("ordinal", F.split("v", "\t").alias("f")).filter((F.size("f") >= 10) & f(4).isin("U", "R"))
    minus = f(9) == "R"
    seq, qual = F.when(minus, reverse_complement(f(2))).otherwise(f(2)), F.when(minus, F.reverse(f(3))).otherwise(f(3))
    score = F.greatest(f(6).try_cast("int"), F.coalesce(f(13).try_cast("int"), F.lit(0)))
    one = rows.select("ordinal", *_record(F.regexp_replace(F.regexp_replace(f(0), "^[@>]", ""), r"/[12]$", ""), F.when(minus, L.REVERSE).otherwise(0), F.regexp_replace(f(7), "^>", ""), f(8).cast("long") - 1, score, F.concat(F.length(f(2)), F.lit("M")), seq, qual, _second=f(1) == "R"))
    return _pair_up(one, "_second")


def normalize_export(spark: SparkSession, path: str, keep_failed: bool = False) -> DataFrame:
    """Pipeline export lines of 22 columns; qualities move from offset 64 to 33; quality min(254, max(single, pair)).

    Failed reads (flag 512) are kept on request; unplaced ones are unmapped.
    """
    f = lambda i: F.get("f", F.lit(i))
    rows = _numbered(spark, path).select("ordinal", F.split("v", "\t", -1).alias("f")).filter(F.size("f") >= 22)
    rows = rows if keep_failed else rows.filter(f(21) == "Y")
    placed, minus = f(12).rlike(r"^-?\d+$"), f(13) == "R"
    name = F.concat_ws(":", f(0), *(f(i) for i in range(2, 6)))
    shifted = F.array_join(F.transform(F.filter(F.split(f(9), ""), lambda x: x != ""), lambda x: F.char(F.greatest(F.ascii(x) - 31, F.lit(33)))), "")
    flag = F.when(minus, L.REVERSE).otherwise(0) + F.when(placed, 0).otherwise(L.UNMAPPED) + F.when(f(21) == "Y", 0).otherwise(L.FAILED)
    q = F.least(F.lit(254), F.greatest(F.coalesce(f(15).try_cast("int"), F.lit(0)), F.coalesce(f(16).try_cast("int"), F.lit(0))))
    contig = F.when(placed, F.regexp_replace(f(10), r"\.fa(sta)?$", "")).otherwise("*")
    one = rows.select("ordinal", *_record(name, flag, contig, F.coalesce(f(12).try_cast("bigint") - 1, F.lit(-1)), F.when(placed, q).otherwise(0), F.when(placed, F.concat(F.length(f(8)), F.lit("M"))).otherwise("*"), F.when(minus, reverse_complement(f(8))).otherwise(f(8)), F.when(minus, F.reverse(shifted)).otherwise(shifted), _second=f(7) == "2"))
    return _pair_up(one, "_second")


def normalize_psl(spark: SparkSession, path: str, a: int = 1, b: int = 3, q: int = 5, r: int = 2) -> DataFrame:
    """Block alignments of 21 columns: gaps between blocks become I and D (N where long on the reference alone), ends are clipped.

    ``score`` = a * matches - b * mismatches - q * opens - r * gap bases, 0 at least.
    """
    f = lambda i: F.get("f", F.lit(i))
    nums = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    rows = _numbered(spark, path).select("ordinal", F.split("v", "\t").alias("f")).filter((F.size("f") >= 21) & f(0).rlike(r"^\d+$"))
    t = rows.select("ordinal", "f", nums(f(18)).alias("n"), nums(f(19)).alias("qs"), nums(f(20)).alias("ts"), f(10).cast("int").alias("ql"))
    piece = "CASE WHEN k > 0 THEN concat(CASE WHEN qs[k] - qs[k-1] - n[k-1] > 0 THEN concat(qs[k] - qs[k-1] - n[k-1], 'I') ELSE '' END, CASE WHEN ts[k] - ts[k-1] - n[k-1] > 0 THEN concat(ts[k] - ts[k-1] - n[k-1], 'D') ELSE '' END) ELSE '' END"
    body = F.expr(f"array_join(transform(sequence(0, size(n) - 1), k -> concat({piece}, n[k], 'M')), '')")
    lead, tail = F.get("qs", F.lit(0)), F.col("ql") - F.element_at("qs", -1) - F.element_at("n", -1)
    cigar = F.concat(F.when(lead > 0, F.concat(lead, F.lit("H"))).otherwise(""), body, F.when(tail > 0, F.concat(tail, F.lit("H"))).otherwise(""))
    gaps = F.expr("aggregate(sequence(1, greatest(size(n) - 1, 1)), struct(0 AS o, 0 AS g), (s, k) -> CASE WHEN k < size(n) THEN struct(s.o + CASE WHEN qs[k] - qs[k-1] - n[k-1] > 0 THEN 1 ELSE 0 END + CASE WHEN ts[k] - ts[k-1] - n[k-1] > 0 THEN 1 ELSE 0 END AS o, s.g + (qs[k] - qs[k-1] - n[k-1]) + (ts[k] - ts[k-1] - n[k-1]) AS g) ELSE s END)")
    g = t.withColumn("_g", gaps)
    score = F.greatest(a * f(0).cast("int") - b * f(1).cast("int") - q * F.col("_g.o") - r * F.col("_g.g"), F.lit(0))
    return g.select("ordinal", *_record(f(9), F.when(F.substr(f(8), F.lit(1), F.lit(1)) == "-", L.REVERSE).otherwise(0), f(13), F.get("ts", F.lit(0)).cast("long"), F.lit(0), cigar, F.lit("*"), F.lit("*"), score=score))
