"""Annotation sources and sinks: transcripts, loci, segments, junction tags, exon groups, intervals and conserved blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _ints(c: Column) -> Column:
    """The numbers of a comma list."""
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("bigint"))


def _fields(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines of text as arrays of fields ``f``; comments and empty lines left out."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("v"))
    return rows.filter((F.col("v") != "") & ~F.col("v").startswith("#")).select(F.split("v", sep).alias("f"), "v")


def read_genepred(spark: SparkSession, path: str, anno_source: str = "") -> DataFrame:
    """Transcripts of an extended gene prediction table of 16 tab columns."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _fields(spark, path).filter((F.size("f") >= 11) & (f(0) != "bin"))
    zipped = F.transform(F.arrays_zip(_ints(f(9)).alias("s"), _ints(f(10)).alias("e"), _ints(F.coalesce(f(15), F.lit(""))).alias("r")), lambda x: F.struct(x["s"].alias("start0"), x["e"].alias("end1"), x["r"].cast("int").alias("frame")))
    t = rows.select(f(1).alias("name"), f(2).alias("chrom"), f(3).alias("strand"), _int(f(4)).alias("tx_start0"), _int(f(5)).alias("tx_end1"), _int(f(6)).alias("cds_start0"), _int(f(7)).alias("cds_end1"), F.filter(zipped, lambda x: x["start0"].isNotNull()).alias("exons"), F.coalesce(f(12), f(1)).alias("gene"), F.lit(anno_source).alias("anno_source"))
    return t.withColumn("tx_id", F.xxhash64("anno_source", "name", "chrom", "strand", "exons"))


def read_annotations(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """All sources (name to path) in one table of transcripts."""
    out = None
    for name, path in sources.items():
        own = read_genepred(spark, path, name)
        out = own if out is None else out.unionByName(own)
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of the sources that a manifest of (source, file) lines names; ``#prefix`` lines set the files' folder."""
    prefix, sources = "", {}
    for r in spark.read.text(path).collect():  # a list of files
        parts = r["value"].strip().split("\t")
        if parts[0] == "#prefix":
            prefix = parts[1] if len(parts) > 1 else ""
        elif len(parts) > 1:
            sources[parts[0]] = prefix + parts[1]
    return read_annotations(spark, sources)


def union_sources(sources: dict[str, DataFrame], name: str = "anno_source") -> DataFrame:
    """All sources' rows, each with its source's name."""
    out = None
    for k, df in sources.items():
        own = df.withColumn(name, F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def _text(df: DataFrame, cols: list[Column], path: str, mode: str = "overwrite") -> None:
    df.select(F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)).alias("value")).write.mode(mode).text(path)


def _list(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def write_loci(loci: DataFrame, path: str) -> None:
    """Loci (chrom, start0, end1, strand, names, tx_ids, exon_ids) as tab lines with list lengths before the lists."""
    n = lambda c: F.size(c)
    _text(loci, [F.col("chrom"), F.col("start0"), F.col("end1"), F.col("strand"), n("names"), n("tx_ids"), n("exon_ids"), _list("names"), _list("tx_ids"), _list("exon_ids")], path)


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.get("f", F.lit(i))
    names = F.filter(F.split(f(7), ","), lambda x: x != "")
    return _fields(spark, path).select(f(0).alias("chrom"), _int(f(1)).alias("start0"), _int(f(2)).alias("end1"), f(3).alias("strand"), names.alias("names"), _ints(f(8)).alias("tx_ids"), _ints(f(9)).alias("exon_ids"))


def check_loci(loci: DataFrame, exons: DataFrame) -> DataFrame:
    """Exons that a locus names but that don't lie inside it, or don't exist (bounds null). exons: exon_id, chrom, start0, end1."""
    named = loci.select(F.col("chrom").alias("l_chrom"), F.col("start0").alias("l0"), F.col("end1").alias("l1"), F.explode("exon_ids").alias("exon_id")).join(exons, "exon_id", "left")
    return named.filter(F.col("chrom").isNull() | (F.col("chrom") != F.col("l_chrom")) | (F.col("start0") < F.col("l0")) | (F.col("end1") > F.col("l1")))


def write_gblocks(blocks: DataFrame, path: str, set_name: str = "g") -> None:
    """Segments (chrom, start0, end1, strand, exon_ids) as ``set:id chrom start0 end1 strand n exons;`` lines; ids are hashes of the place."""
    ident = F.concat(F.lit(f"{set_name}:"), F.abs(F.xxhash64("chrom", "start0", "end1")))
    _text(blocks, [ident, F.col("chrom"), F.col("start0"), F.col("end1"), F.col("strand"), F.size("exon_ids"), F.concat(_list("exon_ids"), F.lit(";"))], path)


def read_gblocks(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.get("f", F.lit(i))
    return _fields(spark, path).select(f(0).alias("block_id"), f(1).alias("chrom"), _int(f(2)).alias("start0"), _int(f(3)).alias("end1"), f(4).alias("strand"), _ints(F.rtrim(F.replace(f(6), F.lit(";"), F.lit("")))).alias("exon_ids"))


def write_jnxinfo(tags: DataFrame, path: str) -> None:
    """Junction tags (tag_id, strand, length, bounds, exon_paths): bounds as ``s-e`` lists, paths joined by ``|``."""
    bounds = F.array_join(F.transform("bounds", lambda b: F.concat_ws("-", b["start1"], b["end1"])), ",")
    paths = F.array_join(F.transform("exon_paths", lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), "|")
    _text(tags, [F.col("tag_id"), F.col("strand"), F.col("length"), bounds, paths], path)


def read_jnxinfo(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.get("f", F.lit(i))
    bounds = F.transform(F.filter(F.split(f(3), ","), lambda x: x != ""), lambda b: F.struct(_int(F.split_part(b, F.lit("-"), F.lit(1))).alias("start1"), _int(F.split_part(b, F.lit("-"), F.lit(2))).alias("end1")))
    paths = F.transform(F.filter(F.split(f(4), r"\|"), lambda x: x != ""), _ints)
    return _fields(spark, path).select(f(0).alias("tag_id"), F.split_part(f(0), F.lit("|"), F.lit(1)).alias("chrom"), f(1).alias("strand"), _int(f(2)).cast("int").alias("length"), bounds.alias("bounds"), paths.alias("exon_paths"))


def tag_exon_edges(tags: DataFrame) -> DataFrame:
    """(tag_id, path, step, left_exon, right_exon): the exon pairs that a tag's paths pass through."""
    p = tags.select("tag_id", F.posexplode("exon_paths").alias("path", "p")).filter(F.size("p") > 1)
    at = p.select("tag_id", "path", "p", F.explode(F.expr("sequence(1, size(p) - 1)")).alias("step"))
    return at.select("tag_id", "path", "step", F.expr("p[step - 1]").alias("left_exon"), F.expr("p[step]").alias("right_exon"))


def distinct_paths(tags: DataFrame) -> DataFrame:
    return tags.withColumn("exon_paths", F.array_distinct("exon_paths"))


def write_exon_groups(groups: DataFrame, path: str) -> None:
    """Sibling sets (set_id, exon_ids) as ``id [a,b]`` lines."""
    _text(groups, [F.col("set_id"), F.concat(F.lit("["), _list("exon_ids"), F.lit("]"))], path)


def read_exon_groups(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(spark, path)
    return rows.select(_int(F.get("f", F.lit(0))).alias("set_id"), F.explode(_ints(F.regexp_replace(F.get("f", F.lit(1)), r"[\[\]]", ""))).alias("exon_id"))


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start0, end1, score) of four-column interval lines; track and browser lines are passed over."""
    rows = _fields(spark, path, r"\s+").filter(~F.col("v").rlike(r"^(track|browser)\b"))
    f = lambda i: F.get("f", F.lit(i))
    return rows.select(f(0).alias("chrom"), _int(f(1)).alias("start0"), _int(f(2)).alias("end1"), f(3).try_cast("double").alias("score"))


CONSERVED = "aln_no chrom1 start1 end1 chrom2 start2 end2 strand score seq1 seq2".split()


def read_conserved_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Aligned block pairs of eleven columns."""
    rows = _fields(spark, path, r"\s+").filter(F.size("f") >= len(CONSERVED))
    typed = {"aln_no": "bigint", "start1": "bigint", "end1": "bigint", "start2": "bigint", "end2": "bigint", "score": "double"}
    return rows.select(*(F.get("f", F.lit(i)).try_cast(typed.get(c, "string")).alias(c) for i, c in enumerate(CONSERVED)))


def conserved_in(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Conserved blocks cut to regions (chrom, start0, end1): bounds on the first genome and the alignment columns over them."""
    from ..operators.intervals import overlap_join

    r = regions.select(F.col("chrom").alias("chrom1"), F.col("start0").alias("q0"), F.col("end1").alias("q1"))
    own = blocks.withColumnsRenamed({"start1": "b0", "end1": "b1"})
    j = overlap_join(own, r, ("b0", "b1"), ("q0", "q1"), ["chrom1"]).withColumns({"s": F.greatest("b0", "q0"), "e": F.least("b1", "q1")})
    # a column belongs to the cut if the bases before it reach the start and are short of the end
    step = lambda a, c: F.struct((a["n"] + F.when(c != "-", 1).otherwise(0)).alias("n"), F.concat(a["at"], F.array(a["n"])).alias("at"))
    at = F.aggregate(F.split("seq1", ""), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), step, lambda a: a["at"])
    keep = F.filter(F.transform(at, lambda n, i: F.when((n >= F.col("s") - F.col("b0")) & (n < F.col("e") - F.col("b0")), i + 1)), lambda i: i.isNotNull())
    k = j.withColumn("k", keep).withColumns({"k0": F.array_min("k"), "k1": F.array_max("k")})
    cut = lambda c: F.substr(c, F.col("k0"), F.col("k1") - F.col("k0") + 1)
    return k.select("aln_no", F.col("chrom1").alias("chrom"), F.col("s").alias("start0"), F.col("e").alias("end1"), cut("seq1").alias("seq1"), cut("seq2").alias("seq2"))


def to_bed_rows(df: DataFrame, kind: str) -> DataFrame:
    """``interval``: five columns with an index-free name; ``blocks``: twelve columns of rows with an array ``blocks`` and a name."""
    if kind == "interval":
        return df.select("chrom", "start0", "end1", F.concat_ws(":", "chrom", "start0", "end1").alias("name"), "score")
    first, last = F.array_min(F.transform("blocks", lambda b: b["start0"])), F.array_max(F.transform("blocks", lambda b: b["end1"]))
    sizes = F.array_join(F.transform("blocks", lambda b: (b["end1"] - b["start0"]).cast("string")), ",")
    starts = F.array_join(F.transform("blocks", lambda b: (b["start0"] - first).cast("string")), ",")
    return df.select("chrom", first.alias("start0"), last.alias("end1"), "name", F.lit(0).alias("score"), "strand", first.alias("thick0"), last.alias("thick1"), F.lit("0,0,0").alias("rgb"), F.size("blocks").alias("n_blocks"), sizes.alias("sizes"), starts.alias("starts"))


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("nullValue", "nan").csv(path)


def split_by_chromosome(df: DataFrame, path: str, forward_only: bool = False) -> None:
    """One folder a chromosome; ``forward_only`` leaves reverse rows out."""
    rows = df.filter("strand <> '-'") if forward_only else df
    rows.write.mode("overwrite").partitionBy("chrom").parquet(path)


def event_counts(events: DataFrame) -> DataFrame:
    """Quantified events as flat text-ready columns, paths as coordinate lists with 1-based starts."""
    path = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start0"] + 1, x["end1"])), ",")
    flat = [F.col(c) for c, t in events.dtypes if not t.startswith(("array", "struct"))]
    return events.select(*flat, path("exc").alias("exc_path"), path("inc").alias("inc_path"))
