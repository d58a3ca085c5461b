"""Junction tags: flanks of a junction over one or more exons, with the exons they come from, their bases, and one layout of what tags share.

A tag has ``left`` and ``right``, its blocks (start0, end1) before and behind the junction in genomic order. A path is the
exons that a flank runs through, the junction's own first. Tags of equal blocks are one tag with all its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import EXON, LOCUS, exon_struct
from .graph import reliable
from .sequences import fetch_sequence

TAG = ["chrom", "strand", "left", "right"]


def _take(exon: Column, n: Column, leftwards: bool) -> Column:
    """The ``n`` bases of an exon next to the junction; more than it has run past its far end."""
    start, end = (exon["end1"] - n, exon["end1"]) if leftwards else (exon["start0"], exon["start0"] + n)
    return F.struct(start.alias("start0"), end.alias("end1"))


def walk(exons: Column, flank: int, leftwards: bool, over_end: bool = True) -> Column:
    """struct<blocks, path, missing> of a flank through ``exons``, given from the junction outwards.

    Each exon gives its bases up to the budget; with ``over_end`` the last one gives what is missing past its end.
    """
    start = F.struct(F.lit(flank).cast("long").alias("missing"), F.array().cast(EXON).alias("blocks"), F.array().cast(EXON).alias("path"))

    def step(a: Column, x: Column) -> Column:
        n = F.least(a["missing"], x["end1"] - x["start0"])
        used = F.struct((a["missing"] - n).alias("missing"), F.concat(a["blocks"], F.array(_take(x, n, leftwards))).alias("blocks"), F.concat(a["path"], F.array(x)).alias("path"))
        return F.when(a["missing"] > 0, used).otherwise(a)

    def finish(a: Column) -> Column:
        last = F.element_at(a["blocks"], -1)
        size = last["end1"] - last["start0"] + (a["missing"] if over_end else F.lit(0))
        blocks = F.concat(F.slice(a["blocks"], F.lit(1), F.size(a["blocks"]) - 1), F.array(_take(last, size, leftwards)))
        return F.struct((F.reverse(blocks) if leftwards else blocks).alias("blocks"), a["path"].alias("path"), a["missing"].alias("missing"))

    return F.aggregate(exons, start, step, finish)


def _transcripts(occ: DataFrame) -> DataFrame:
    return occ.groupBy("tx_id", "chrom", "strand").agg(F.array_sort(F.collect_list(exon_struct())).alias("e"))


def _with_paths(rows: DataFrame, keys: list[str], paths: list[str]) -> DataFrame:
    """One row a tag: its rows' different paths, in order, and how many rows it has. Rows dealt by some of ``keys`` aren't shuffled again."""
    each = rows.groupBy(*keys, *paths).agg(F.sum("n").alias("n"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*paths))).alias("exon_paths"), F.sum("n").alias("n_tx"))


def known_tags(occ: DataFrame, read_length: int, min_span: int) -> DataFrame:
    """Tags of transcripts' junctions: (chrom, strand, left, right, exon_paths, n_tx).

    The left flank is up to read_length - min_span bases of the left exon, the right one as many bases of the exons that
    follow, over the end of the last. A junction next to an exon shorter than ``min_span`` is left out.
    """
    flank = read_length - min_span
    at = _transcripts(occ).filter(F.size("e") > 1).withColumn("i", F.explode(F.expr("sequence(1, size(e) - 1)")))
    a, b = F.expr("e[i - 1]"), F.expr("e[i]")
    at = at.filter((a["end1"] - a["start0"] >= min_span) & (b["end1"] - b["start0"] >= min_span))
    left, right = walk(F.array(a), flank, True, over_end=False), walk(F.expr("slice(e, i + 1, size(e) - i)"), flank, False)
    rows = at.select("chrom", "strand", left.alias("l"), right.alias("r"))
    rows = rows.select("chrom", "strand", F.col("l.blocks").alias("left"), F.col("r.blocks").alias("right"), F.col("l.path").alias("left_path"), F.col("r.path").alias("right_path"), F.lit(1).cast("long").alias("n"))
    return _with_paths(rows.repartition(*TAG), TAG, ["left_path", "right_path"])


def transcript_flanks(occ: DataFrame, flank: int, leftwards: bool) -> DataFrame:
    """The different flanks of ``flank`` bases that begin at each exon and follow a transcript that has it: (chrom, strand, exon, blocks, path).

    A transcript that ends early is followed past its outermost exon.
    """
    at = _transcripts(occ).withColumn("i", F.explode(F.expr("sequence(0, size(e) - 1)")))
    onward = F.expr("reverse(slice(e, 1, i + 1))") if leftwards else F.expr("slice(e, i + 1, size(e) - i)")
    return at.select("chrom", "strand", F.expr("e[i]").alias("exon"), walk(onward, flank, leftwards).alias("w")).select("chrom", "strand", "exon", "w.blocks", "w.path").distinct()


def denovo_tags(pairs: DataFrame, occ: DataFrame, flank: int) -> DataFrame:
    """Tags of new exon pairs (chrom, strand, start0, end1, next_start0, next_end1): every flank that ends with the left exon with every flank that begins with the right one.

    ``exon_paths`` keeps all pairs of paths of equal blocks; ``n_tx`` counts them.
    """
    side = lambda leftwards, name: transcript_flanks(occ, flank, leftwards).select("chrom", "strand", F.col("exon").alias(f"{name}_exon"), F.col("blocks").alias(name), F.col("path").alias(f"{name}_path"))
    p = pairs.select("chrom", "strand", exon_struct().alias("left_exon"), exon_struct("next_start0", "next_end1").alias("right_exon")).distinct()
    rows = p.join(side(True, "left"), ["chrom", "strand", "left_exon"]).join(side(False, "right"), ["chrom", "strand", "right_exon"]).withColumn("n", F.lit(1).cast("long"))
    return _with_paths(rows, TAG, ["left_path", "right_path"])


def flank_paths(locus_exon: DataFrame, flank: int, dist: int, leftwards: bool, max_exons: int | None = None) -> DataFrame:
    """Every path of a locus's exons that fills a flank: (locus, chrom, strand, bound, blocks, path).

    From each exon the frontier grows by all exons at least ``dist`` bases further out, as long as bases are missing; a path
    that nothing extends ends as it is. Each round adds an exon to all open paths at once, so there are as many rounds as
    the longest path has exons, which the flank bounds. ``max_exons`` ends paths earlier.
    """
    exon = exon_struct()
    own = locus_exon.select(*LOCUS, exon.alias("x")).distinct()
    size = F.col("x.end1") - F.col("x.start0")

    def grown(rows: DataFrame) -> DataFrame:
        n = F.least("missing", size)
        return rows.select(*LOCUS, "bound", (F.col("missing") - n).alias("missing"), F.concat("blocks", F.array(_take(F.col("x"), n, leftwards))).alias("blocks"), F.concat("path", F.array("x")).alias("path"))

    none = F.array().cast(EXON)
    open_ = grown(own.withColumns({"bound": F.col("x.end1") if leftwards else F.col("x.start0"), "missing": F.lit(flank).cast("long"), "blocks": none, "path": none}))
    nxt = own.select(F.col("locus").alias("_l"), "x")
    here = F.element_at("path", -1)
    apart = F.col("x.end1") + dist <= here["start0"] if leftwards else here["end1"] + dist <= F.col("x.start0")
    done, k = None, 1
    while True:
        open_ = reliable(open_)
        full = open_.filter("missing <= 0")
        done = full if done is None else done.unionByName(full)
        rest = open_.filter("missing > 0")
        if max_exons is not None and k >= max_exons:
            done = done.unionByName(rest)
            break
        if rest.isEmpty():
            break
        met = rest.join(nxt, (F.col("locus") == F.col("_l")) & apart, "left").drop("_l")
        done = done.unionByName(met.filter("x is null").drop("x"))
        open_, k = grown(met.filter("x is not null")), k + 1
    return done.select(*LOCUS, "bound", (F.reverse("blocks") if leftwards else F.col("blocks")).alias("blocks"), "path").drop("missing")


def recombined_tags(locus_exon: DataFrame, flank: int, dist: int = 5, max_exons: int | None = None, block: int = 1000) -> DataFrame:
    """Tags of every left path of a locus with every right path that begins at least ``dist`` bases later: (locus, chrom, strand, left, right, exon_paths, n_tx).

    The result is as large as that; ``max_exons`` bounds the exons of a path. Right paths of large loci are copied to as
    many tasks as they have blocks of ``block`` left ones, by a hash of their bases' bounds: equal tags meet where they are made.
    """
    left = reliable(flank_paths(locus_exon, flank, dist, True, max_exons))
    right = flank_paths(locus_exon, flank, dist, False, max_exons)
    n = left.groupBy("locus").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"))
    a = left.join(n, "locus").select(*LOCUS, F.col("bound").alias("up"), F.col("blocks").alias("left"), F.col("path").alias("left_path"), F.pmod(F.xxhash64("blocks"), F.col("n_blocks")).alias("deal"))
    b = right.join(n, "locus").select("locus", F.col("bound").alias("down"), F.col("blocks").alias("right"), F.col("path").alias("right_path"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("deal"))
    rows = a.join(b, ["locus", "deal"]).filter(F.col("up") + dist <= F.col("down")).withColumn("n", F.lit(1).cast("long"))
    return _with_paths(rows, ["locus", "deal", *TAG], ["left_path", "right_path"]).drop("deal")


def tag_sequences(tags: DataFrame, sequences: DataFrame) -> DataFrame:
    """``tags`` with ``left_seq`` and ``right_seq``, the bases of their blocks on the forward strand, from ``sequences`` (contig, chunk, seq)."""
    keyed = tags.withColumn("_tag", F.xxhash64(*TAG))
    both = F.concat(F.transform("left", lambda x, i: F.struct(F.lit(0).alias("side"), i.alias("i"), x.alias("x"))), F.transform("right", lambda x, i: F.struct(F.lit(1).alias("side"), i.alias("i"), x.alias("x"))))
    parts = keyed.select("_tag", F.col("chrom").alias("contig"), F.explode(both).alias("b")).select("_tag", "contig", "b.side", "b.i", F.col("b.x.start0").alias("start0"), F.col("b.x.end1").alias("end1"))
    got = fetch_sequence(sequences, parts)
    joined = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("i", "seq")))), lambda x: x["seq"]), "")
    held = got.groupBy("_tag").agg(joined(0).alias("left_seq"), joined(1).alias("right_seq"))
    return keyed.join(held, "_tag").drop("_tag")


def _cut(blocks: Column, start: Column, n: Column) -> Column:
    """The stretch of ``n`` bases from ``start`` on blocks laid end to end, as blocks."""

    def step(a: Column, x: Column) -> Column:
        size = x["end1"] - x["start0"]
        lo, hi = F.greatest(start - a["at"], F.lit(0)), F.least(start + n - a["at"], size)
        part = F.array(F.struct((x["start0"] + lo).alias("start0"), (x["start0"] + hi).alias("end1")))
        return F.struct((a["at"] + size).alias("at"), F.when(lo < hi, F.concat(a["out"], part)).otherwise(a["out"]).alias("out"))

    return F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(EXON).alias("out")), step, lambda a: a["out"])


def _length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, x: a + x["end1"] - x["start0"])


def resolve_shared(tags: DataFrame, read_length: int) -> DataFrame:
    """Tags cut so that each window of ``read_length`` bases of one junction is in one row: (chrom, strand, donor, acceptor, nth, blocks, n_tags, n_windows, exon_paths).

    Windows that the same tags have are one class. A class's windows that follow each other are one stretch on the tag's
    concatenated coordinates, told once, with the paths of all its tags; what a tag shares with no other is left of, between
    or right of such stretches and told as its own. ``nth`` numbers a junction's rows, those of most tags first, then by
    place. Tags shorter than ``read_length`` have no window. A tag that is alone on its junction is one stretch as it is; those of
    other junctions are cut into windows behind a shuffle of tags by junction.
    """
    junction = ["chrom", "strand", "donor", "acceptor"]
    t = tags.select("chrom", "strand", F.element_at("left", -1)["end1"].alias("donor"), F.element_at("right", 1)["start0"].alias("acceptor"), F.concat("left", "right").alias("blocks"), "exon_paths")
    t = t.withColumns({"tag": F.xxhash64("chrom", "strand", "blocks"), "size": _length(F.col("blocks"))}).filter(F.col("size") >= read_length)
    apart = F.forall(F.sequence(F.lit(1), F.size("blocks") - 1), lambda i: F.get("blocks", i - 1)["end1"] <= F.get("blocks", i)["start0"])
    t = reliable(t.withColumn("alone", (F.count(F.lit(1)).over(Window.partitionBy(*junction)) == 1) & apart))
    own = t.filter("alone").select(*junction, F.lit(1).alias("nth"), "blocks", F.lit(1).alias("n_tags"), (F.col("size") - read_length + 1).alias("n_windows"), F.array_sort(F.array_distinct("exon_paths")).alias("exon_paths"))
    t = t.filter("not alone")
    at = t.repartition(*junction).select(*junction, "tag", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - read_length)).alias("o"))
    windows = at.select(*junction, "tag", "o", _cut(F.col("blocks"), F.col("o"), F.lit(read_length).cast("long")).alias("w"))
    classes = windows.groupBy(*junction, "w").agg(F.array_sort(F.collect_list(F.struct("tag", "o"))).alias("own"))
    first = classes.select(*junction, F.get("own", F.lit(0))["tag"].alias("tag"), F.get("own", F.lit(0))["o"].alias("o"), F.transform("own", lambda x: x["tag"]).alias("tags"))
    run = F.col("o") - F.row_number().over(Window.partitionBy(*junction, "tag", "tags").orderBy("o"))
    stretches = first.withColumn("run", run).groupBy(*junction, "tag", "tags", "run").agg(F.min("o").alias("start"), F.count(F.lit(1)).alias("n_windows"))
    cut = stretches.join(t.select("tag", F.col("blocks").alias("of")), "tag").withColumn("blocks", _cut(F.col("of"), F.col("start"), F.col("n_windows") + read_length - 1))
    paths = cut.select("tag", "start", F.explode("tags").alias("member")).join(t.select(F.col("tag").alias("member"), "exon_paths"), "member").select("tag", "start", F.explode("exon_paths").alias("p")).distinct()
    merged = paths.groupBy("tag", "start").agg(F.array_sort(F.collect_list("p")).alias("exon_paths"))
    nth = F.row_number().over(Window.partitionBy(*junction).orderBy(F.desc("n_tags"), "blocks", "tag"))
    shared = cut.withColumn("n_tags", F.size("tags")).join(merged, ["tag", "start"]).withColumn("nth", nth).select(*junction, "nth", "blocks", "n_tags", "n_windows", "exon_paths")
    return own.unionByName(shared)
