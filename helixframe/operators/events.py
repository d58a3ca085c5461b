"""Splicing events: boundary groups, paths, event pairs and their quantification.

``locus_exon`` rows: locus, chrom, strand, start0, end1 (distinct). ``junctions`` rows: locus, chrom, strand, start0, end1,
next_start0, next_end1. Everything stays inside a locus, which is in every join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I

LOCUS = ["locus", "chrom", "strand"]
EXON = "array<struct<start0:bigint,end1:bigint>>"


def exon_struct(s: str = "start0", e: str = "end1") -> Column:
    return F.struct(F.col(s).cast("long").alias("start0"), F.col(e).cast("long").alias("end1"))


def bound_groups(locus_exon: DataFrame, terminal: bool = False, junctions: DataFrame | None = None) -> DataFrame:
    """``locus_exon`` with left_group and right_group.

    The locus's boundaries are swept in order, ends before starts of one place: a run of starts is one left group, a run
    of ends one right group. With ``terminal``, exons without a junction into or out of them are in group 0 on that side.
    """
    w = Window.partitionBy("locus").orderBy("pos", "kind")
    ends = F.array(F.struct(F.col("start0").alias("pos"), F.lit(1).alias("kind")), F.struct(F.col("end1").alias("pos"), F.lit(0).alias("kind")))
    marks = locus_exon.dropna(subset=["locus", "start0", "end1"]).select("*", F.inline(ends))
    changed = marks.withColumn("new", F.when(F.coalesce(F.lag("kind").over(w), F.lit(-1)) != F.col("kind"), 1).otherwise(0))
    # of equal boundaries the first alone can be new, so all of them have one number
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("new")).otherwise(0)).over(so_far)
    num = changed.withColumns({"lg": of(1), "rg": of(0)})
    group = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = num.groupBy(*locus_exon.columns).agg(group(1, "lg").alias("left_group"), group(0, "rg").alias("right_group"))
    if terminal:
        into = junctions.select("locus", F.col("next_start0").alias("start0"), F.col("next_end1").alias("end1"), F.lit(True).alias("_in")).distinct()
        away = junctions.select("locus", "start0", "end1", F.lit(True).alias("_out")).distinct()
        out = out.join(into, ["locus", "start0", "end1"], "left").join(away, ["locus", "start0", "end1"], "left")
        out = out.withColumns({"left_group": F.when(F.col("_in"), F.col("left_group")).otherwise(0), "right_group": F.when(F.col("_out"), F.col("right_group")).otherwise(0)}).drop("_in", "_out")
    return out


def grouped_junctions(junctions: DataFrame, groups: DataFrame, jnx_counts: DataFrame | None = None) -> DataFrame:
    """Distinct junctions (locus, chrom, strand, src, dst, ends): the groups that they lead from and to, and both exons as an array.

    ``src`` is the left exon's right group and ``dst`` the right exon's left one. Where ``groups`` have n_reads and n_positions,
    exons have these too, and the left one those of its junction in ``jnx_counts`` (as in ``quantify``) as jnx_reads and jnx_positions.
    """
    counted = jnx_counts is not None
    counts = ["n_reads", "n_positions"] if counted else []
    exons = lambda s, e, group, n: groups.select("locus", F.col("start0").alias(s), F.col("end1").alias(e), F.col(group).alias(n), *(F.col(c).alias(f"_{s}_{c}") for c in counts))
    j = junctions.select(*LOCUS, "start0", "end1", "next_start0", "next_end1").distinct()
    j = j.join(exons("start0", "end1", "right_group", "src"), ["locus", "start0", "end1"])
    if counted:
        j = j.join(jnx_counts.select("locus", "end1", "next_start0", F.col("n_reads").alias("jnx_reads"), F.col("n_positions").alias("jnx_positions")), ["locus", "end1", "next_start0"], "left")
    j = j.join(exons("next_start0", "next_end1", "left_group", "dst"), ["locus", "next_start0", "next_end1"])
    own = lambda s, e, jnx: F.struct(F.col(s).cast("long").alias("start0"), F.col(e).cast("long").alias("end1"), *(F.col(f"_{s}_{c}").cast("long").alias(c) for c in counts), *((F.col(c) if jnx else F.lit(None)).cast("long").alias(c) for c in ("jnx_reads", "jnx_positions") if counted))
    return j.select(*LOCUS, "src", "dst", F.array(own("start0", "end1", True), own("next_start0", "next_end1", False)).alias("ends"))


def grouped_paths(grouped: DataFrame, max_steps: int) -> DataFrame:
    """``splice_paths`` of ``grouped_junctions``, with the groups that a path leads from (src) and to (dst)."""
    path = grouped.select(*LOCUS, "src", "dst", F.lit(1).alias("steps"), F.col("ends").alias("exons"))
    edge = grouped.select(F.col("locus").alias("_l"), F.col("ends")[0]["start0"].alias("_s"), F.col("ends")[0]["end1"].alias("_e"), F.col("dst").alias("_dst"), F.col("ends").alias("_ends"))
    last, out = F.element_at("exons", -1), path
    for k in range(2, max_steps + 1):
        on = (F.col("locus") == F.col("_l")) & (last["start0"] == F.col("_s")) & (last["end1"] == F.col("_e"))
        path = path.join(edge, on).select(*LOCUS, "src", F.col("_dst").alias("dst"), F.lit(k).alias("steps"), F.concat(F.slice("exons", F.lit(1), F.size("exons") - 1), "_ends").alias("exons"))
        out = out.unionByName(path)
    return out


def splice_paths(junctions: DataFrame, max_steps: int) -> DataFrame:
    """All paths (locus, chrom, strand, steps, exons) of 1 to ``max_steps`` junctions; exons in genomic order."""
    j = junctions.select(*LOCUS, exon_struct().alias("a"), exon_struct("next_start0", "next_end1").alias("b")).distinct()
    path = j.select(*LOCUS, F.lit(1).alias("steps"), F.array("a", "b").alias("exons"))
    out, edge = path, j.select(F.col("locus").alias("_l"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    for k in range(2, max_steps + 1):
        on = (F.col("locus") == F.col("_l")) & (F.element_at("exons", -1) == F.col("_a"))
        path = path.join(edge, on).select(*LOCUS, F.lit(k).alias("steps"), F.concat("exons", F.array("_b")).alias("exons"))
        out = out.unionByName(path)
    return out


def _overlap(a: Column, b: Column) -> Column:
    return (a["start0"] < b["end1"]) & (b["start0"] < a["end1"])


def aep_events(paths: DataFrame, groups: DataFrame | None, a: tuple[int, int] = (1, 1), b: tuple[int, int] = (2, 2)) -> DataFrame:
    """Pairs of paths: ``exc`` of a[0]..a[1] steps and ``inc`` of b[0]..b[1] steps (arrays of exons).

    Both start in one right group and end in one left group of the locus, their flanks overlap, and no middle exon of one
    overlaps one of the other. (1,1),(2,2) are skipped exons, (2,2),(2,2) mutually exclusive ones. Of equally long paths
    inclusion is the one whose second exon comes first in the transcript. ``grouped_paths`` have their groups, others get them
    from ``groups``.
    """
    if not 1 <= a[0] <= a[1] <= b[0] <= b[1] or b[1] < 2:
        raise ValueError("steps have to satisfy 1 <= a0 <= a1 <= b0 <= b1 and b1 >= 2")
    tagged = paths
    if groups is not None:
        right = groups.select("locus", exon_struct().alias("_first"), F.col("right_group").alias("src"))
        left = groups.select("locus", exon_struct().alias("_last"), F.col("left_group").alias("dst"))
        tagged = paths.withColumns({"_first": F.element_at("exons", 1), "_last": F.element_at("exons", -1)}).join(right, ["locus", "_first"]).join(left, ["locus", "_last"])
    m = tagged.filter(F.col("steps").between(*a)).select(*LOCUS, "src", "dst", F.col("exons").alias("m"))
    n = tagged.filter(F.col("steps").between(*b)).select("locus", "src", "dst", F.col("exons").alias("n"))
    mid = lambda c: F.slice(c, 2, F.size(c) - 2)
    clash = F.exists(mid("m"), lambda x: F.exists(mid("n"), lambda y: _overlap(x, y)))
    flank = _overlap(F.element_at("m", 1), F.element_at("n", 1)) & _overlap(F.element_at("m", -1), F.element_at("n", -1))
    pairs = m.join(n, ["locus", "src", "dst"]).filter(flank & ~clash & (F.col("m") != F.col("n")))
    return orient_equal(pairs)


def orient_equal(pairs: DataFrame) -> DataFrame:
    """Names paths ``m`` and ``n`` exc and inc: the longer is inc; of equal ones the first in the transcript is."""
    equal = F.size("m") == F.size("n")
    m_first = F.element_at("m", 2)["start0"] < F.element_at("n", 2)["start0"]
    swap = equal & F.when(F.col("strand") == "-", ~m_first).otherwise(m_first)
    out = pairs.select(*LOCUS, F.when(swap, F.col("n")).otherwise(F.col("m")).alias("exc"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("inc"))
    return out.distinct()


def drop_iso_bound(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One event for each unordered pair of exc and inc middle and spliced coordinates in a locus."""
    inner = lambda c: F.array_join(F.transform(c, lambda x, i: F.concat_ws("-", F.when(i > 0, x["start0"]), F.when(i < F.size(c) - 1, x["end1"]))), ",")
    a, b = inner("exc"), inner("inc")
    return events.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)}).withColumn("_r", F.row_number().over(Window.partitionBy(*(keys or ["locus"]), "_a", "_b").orderBy("exc", "inc"))).filter("_r = 1").drop("_a", "_b", "_r")


def a53ss_events(junctions: DataFrame, groups: DataFrame) -> DataFrame:
    """Alternative splice sites: (…, type, common, short, long).

    Two junctions between one right and one left group share the exon on one side; on the other, the exons overlap and
    differ in their splice coordinate only. Donor variants are A5SS on the forward strand, A3SS on the reverse; acceptor
    variants the other way round. ``long`` is the variant that reaches further towards the intron.
    """
    g1 = groups.select("locus", "start0", "end1", F.col("right_group").alias("rg"))
    g2 = groups.select("locus", F.col("start0").alias("next_start0"), F.col("end1").alias("next_end1"), F.col("left_group").alias("lg"))
    j = junctions.join(g1, ["locus", "start0", "end1"]).join(g2, ["locus", "next_start0", "next_end1"]).select(*LOCUS, "rg", "lg", exon_struct().alias("a"), exon_struct("next_start0", "next_end1").alias("b")).distinct()
    k = j.select("locus", "rg", "lg", F.col("a").alias("a2"), F.col("b").alias("b2"))
    pairs = j.join(k, ["locus", "rg", "lg"])
    donor = pairs.filter((F.col("b") == F.col("b2")) & (F.col("a.end1") < F.col("a2.end1")) & _overlap(F.col("a"), F.col("a2")))
    acceptor = pairs.filter((F.col("a") == F.col("a2")) & (F.col("b.start0") > F.col("b2.start0")) & _overlap(F.col("b"), F.col("b2")))
    kind = lambda plus, minus: F.when(F.col("strand") == "-", minus).otherwise(plus).alias("type")
    out = donor.select(*LOCUS, kind("A5SS", "A3SS"), F.col("b").alias("common"), F.col("a").alias("short"), F.col("a2").alias("long"))
    return out.unionByName(acceptor.select(*LOCUS, kind("A3SS", "A5SS"), F.col("a").alias("common"), F.col("b").alias("short"), F.col("b2").alias("long"))).distinct()


def terminal_exon_events(occ: DataFrame, groups: DataFrame) -> DataFrame:
    """Alternative first and last exons: (…, type, proximal, distal, neighbour groups).

    First (last) exons of transcripts with two or more exons that don't overlap and whose neighbours share the boundary
    group on the side of the terminal exon. ``proximal`` is the one nearer to the neighbour.
    """
    up, down = Window.partitionBy("tx_id").orderBy("start0", "end1"), Window.partitionBy("tx_id").orderBy(F.desc("start0"), F.desc("end1"))
    n = F.count(F.lit(1)).over(Window.partitionBy("tx_id"))
    rows = occ.withColumns({"_n": n, "_u": F.row_number().over(up), "_d": F.row_number().over(down), "_nx": F.lead(exon_struct()).over(up), "_pv": F.lag(exon_struct()).over(up)}).filter("_n >= 2")
    lg = groups.select("locus", exon_struct().alias("nb"), F.col("left_group").alias("g"))
    rg = groups.select("locus", exon_struct().alias("nb"), F.col("right_group").alias("g"))
    low = rows.filter("_u = 1").select(*LOCUS, exon_struct().alias("x"), F.col("_nx").alias("nb")).join(lg, ["locus", "nb"]).select(*LOCUS, "g", "x").distinct()
    high = rows.filter("_d = 1").select(*LOCUS, exon_struct().alias("x"), F.col("_pv").alias("nb")).join(rg, ["locus", "nb"]).select(*LOCUS, "g", "x").distinct()
    out = None
    for side, plus, minus, near_first in ((low, "AFE", "ALE", False), (high, "ALE", "AFE", True)):
        other = side.select("locus", "g", F.col("x").alias("y"))
        pair = side.join(other, ["locus", "g"]).filter(F.col("x.end1") <= F.col("y.start0"))
        near, far = ("x", "y") if near_first else ("y", "x")
        own = pair.select(*LOCUS, F.when(F.col("strand") == "-", minus).otherwise(plus).alias("type"), F.col(near).alias("proximal"), F.col(far).alias("distal")).distinct()
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def retained_introns(junctions: DataFrame, locus_exon: DataFrame, parent: str = "any", free: bool = False, unambiguous: bool = False, occ: DataFrame | None = None) -> DataFrame:
    """Junctions whose two exons overlap one parent exon of the locus: (…, a, b, parent[, kept]).

    ``parent``: any, either (spliced on a side at least), both, or same_tx (spliced on both sides in one transcript of
    ``occ``, which has locus and tx_id). ``free`` wants no exon but parents over the intron;
    ``unambiguous`` adds what of the intron no exon but parents covers.
    """
    p = locus_exon.select("locus", F.col("start0").alias("p0"), F.col("end1").alias("p1"))
    j = junctions.select(*LOCUS, "start0", "end1", "next_start0", "next_end1").distinct()
    hits = j.join(p, "locus").filter((F.col("p0") < F.col("end1")) & (F.col("p1") > F.col("next_start0")))
    if parent == "same_tx":
        w = Window.partitionBy("locus", "tx_id").orderBy("start0", "end1")
        inner = occ.withColumns({"_b": F.lag("start0").over(w), "_a": F.lead("start0").over(w)}).filter("_b is not null and _a is not null")
        hits = hits.join(inner.select("locus", F.col("start0").alias("p0"), F.col("end1").alias("p1")).distinct(), ["locus", "p0", "p1"], "left_semi")
    elif parent != "any":
        ins = junctions.select("locus", F.col("next_start0").alias("p0"), F.col("next_end1").alias("p1"), F.lit(True).alias("_in")).distinct()
        outs = junctions.select("locus", F.col("start0").alias("p0"), F.col("end1").alias("p1"), F.lit(True).alias("_out")).distinct()
        hits = hits.join(ins, ["locus", "p0", "p1"], "left").join(outs, ["locus", "p0", "p1"], "left")
        i, o = F.coalesce("_in", F.lit(False)), F.coalesce("_out", F.lit(False))
        hits = hits.filter(i & o if parent == "both" else i | o).drop("_in", "_out")
    if free or unambiguous:
        key = ["locus", "end1", "next_start0"]
        introns = hits.select(*key).distinct()
        e = locus_exon.select("locus", F.col("start0").alias("e0"), F.col("end1").alias("e1"))
        inside = introns.join(e, "locus").filter((F.col("e0") < F.col("next_start0")) & (F.col("e1") > F.col("end1")) & ~((F.col("e0") < F.col("end1")) & (F.col("e1") > F.col("next_start0"))))
        if free:
            hits = hits.join(inside.select(*key).distinct(), key, "left_anti")
        if unambiguous:
            # each intron is cut by its own exons alone: a parent of one may lie inside another
            own = [F.col("locus"), F.col("end1").alias("donor"), F.col("next_start0").alias("acceptor")]
            whole = introns.select(*own, F.col("end1").alias("start0"), F.col("next_start0").alias("end1"))
            left = I.subtract(whole, inside.select(*own, F.col("e0").alias("start0"), F.col("e1").alias("end1")), ["locus", "donor", "acceptor"])
            kept = left.groupBy("locus", F.col("donor").alias("end1"), F.col("acceptor").alias("next_start0")).agg(F.array_sort(F.collect_list(exon_struct())).alias("kept"))
            hits = hits.join(kept, key)
    base = [*LOCUS, exon_struct().alias("a"), exon_struct("next_start0", "next_end1").alias("b"), exon_struct("p0", "p1").alias("parent")]
    return hits.select(*base, *(["kept"] if unambiguous else [])).distinct()


def alt3utr_events(runs: DataFrame) -> DataFrame:
    """All splits of each run of UTR blocks into a core and an extension, in the direction of transcription.

    ``runs``: gene_id, run, strand, chrom, start0, end1. Result: (gene_id, run, core, extension), arrays of blocks.
    """
    held = runs.groupBy("gene_id", "run", "chrom", "strand").agg(F.array_sort(F.collect_list(exon_struct())).alias("b"))
    held = held.withColumn("b", F.when(F.col("strand") == "-", F.reverse("b")).otherwise(F.col("b"))).filter(F.size("b") >= 2)
    x = held.withColumn("x", F.explode(F.sequence(F.lit(1), F.size("b") - 1)))
    y = x.withColumn("y", F.explode(F.sequence(F.col("x") + 1, F.size("b"))))
    return y.select("gene_id", "run", "chrom", "strand", F.slice("b", F.lit(1), F.col("x")).alias("core"), F.slice("b", F.col("x") + 1, F.col("y") - F.col("x")).alias("extension"))


def utr_isoforms(blocks: DataFrame) -> DataFrame:
    """Isoform shares along a run of UTR blocks (gene_id, run, idx from 0 in transcript direction, n_reads, n_positions).

    Block i's survival is its density over the block before, 1 at most; the isoform that ends with block i has the product
    of the survivals up to i times what doesn't survive after it. ``bits`` marks its blocks.
    """
    w = Window.partitionBy("gene_id", "run").orderBy("idx")
    d = F.col("n_reads") / F.nullif(F.col("n_positions"), F.lit(0))
    r = blocks.withColumn("d", d).withColumn("prev", F.lag("d").over(w)).withColumn("s", F.when(F.col("prev").isNull(), 1.0).otherwise(F.least(F.coalesce(F.try_divide("d", "prev"), F.lit(0.0)), F.lit(1.0))))
    r = r.withColumns({"cum_reads": F.sum("n_reads").over(w), "alive": F.when(F.min("s").over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest("s", F.lit(1e-300)))).over(w))), "next_s": F.coalesce(F.lead("s").over(w), F.lit(0.0)), "n": F.count(F.lit(1)).over(Window.partitionBy("gene_id", "run"))})
    return r.select("gene_id", "run", "idx", "n_reads", "cum_reads", F.concat(F.repeat(F.lit("1"), (F.col("idx") + 1).cast("int")), F.repeat(F.lit("0"), (F.col("n") - F.col("idx") - 1).cast("int"))).alias("bits"), (F.col("alive") * (1 - F.col("next_s"))).alias("psi"))


def naive_psi(ext_len: Column, ext_n: Column, core_len: Column, core_n: Column) -> Column:
    """Extension density over core density, null where undefined."""
    return F.try_divide(F.try_divide(ext_n, ext_len), F.try_divide(core_n, core_len))


def bayes_psi(ext_len: Column, ext_n: Column, core_len: Column, core_n: Column, steps: int = 100) -> Column:
    """Posterior mean of psi on a grid from 0 to 1 under a Poisson count of mean ext_len * psi * core density; null where undefined.

    Terms are in logarithms, less the greatest one.
    """
    rate = F.try_divide(ext_len * core_n, core_len)
    log_p = lambda i: F.when(i == 0, F.when(ext_n == 0, 0.0)).otherwise(ext_n * F.log(rate * i / steps) - rate * i / steps)
    terms = F.transform(F.sequence(F.lit(0), F.lit(steps)), log_p)
    total = lambda t, of: F.aggregate(F.transform(t["x"], of), F.lit(0.0), lambda a, x: a + x)
    weight = lambda t, x: F.coalesce(F.exp(x - t["top"]), F.lit(0.0))
    # the one-element arrays name what the next step reads, so it is computed but once
    named = F.transform(F.array(terms), lambda x: F.struct(x.alias("x"), F.array_max(x).alias("top")))
    means = F.transform(named, lambda t: total(t, lambda x, i: weight(t, x) * i / steps) / total(t, lambda x: weight(t, x)))
    sums = F.get(means, F.lit(0))
    return F.when((ext_len > 0) & (core_len > 0) & (core_n > 0), sums)


def quantify(events: DataFrame, exon_counts: DataFrame, jnx_counts: DataFrame) -> DataFrame:
    """``events`` (event_id, locus, exc, inc) with reads, positions, densities, IR and Psi.

    Inclusion counts its middle exons and junctions, exclusion its junctions and, where it has them, middle exons. IR is
    NI / (NI + NE+), where NE+ adds the flanks if the exclusion path has one step. ``exon_counts``: locus, start0, end1,
    n_reads, n_positions; ``jnx_counts``: locus, end1, next_start0, n_reads, n_positions.
    """
    parts = events.select("event_id", "locus", F.explode(F.array(F.struct(F.lit("exc").alias("side"), F.col("exc").alias("p")), F.struct(F.lit("inc").alias("side"), F.col("inc").alias("p")))).alias("s")).select("event_id", "locus", "s.side", "s.p")
    mids = parts.select("event_id", "locus", "side", F.posexplode("p").alias("i", "x"), F.size("p").alias("k")).withColumn("flank", (F.col("i") == 0) | (F.col("i") == F.col("k") - 1))
    e = mids.join(exon_counts.select("locus", exon_struct().alias("x"), "n_reads", "n_positions"), ["locus", "x"], "left")
    j = parts.select("event_id", "locus", "side", F.posexplode(F.expr("transform(sequence(1, size(p) - 1), i -> struct(p[i - 1].end1 AS d, p[i].start0 AS a))")).alias("i", "j"))
    j = j.join(jnx_counts.select("locus", F.struct(F.col("end1").alias("d"), F.col("next_start0").alias("a")).alias("j"), "n_reads", "n_positions"), ["locus", "j"], "left")
    rows = e.select("event_id", "side", "i", "n_reads", "n_positions", "flank", F.lit(False).alias("jnx")).unionByName(j.select("event_id", "side", "i", "n_reads", "n_positions", F.lit(False).alias("flank"), F.lit(True).alias("jnx")))
    n = lambda side, c, cond: F.coalesce(F.sum(F.when((F.col("side") == side) & cond, F.col(c))), F.lit(0))
    own = ~F.col("flank")
    parts = {"flank": F.col("flank"), "jnx": F.col("jnx"), "mid": own & ~F.col("jnx")}
    each = [n(side, f"n_{what}", cond).alias(f"{side}_{part}_{what}") for side in ("inc", "exc") for part, cond in parts.items() for what in ("reads", "positions")]
    seen = lambda side, c: F.min(F.when(F.col("jnx") & (F.col("side") == side), (F.coalesce(c, F.lit(0)) > 0).cast("int")))
    told = lambda side, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("jnx") & (F.col("side") == side), F.struct("i", F.coalesce(c, F.lit(0)).alias("n"))))), lambda x: x["n"].cast("string")), ",")
    checks = [f(side, f"n_{what}").alias(f"{side}_{name}") for side in ("inc", "exc") for name, f, what in (("jr", told, "reads"), ("jp", told, "positions"), ("jrf", seen, "reads"), ("jpf", seen, "positions"))]
    g = rows.groupBy("event_id").agg(
        n("inc", "n_reads", own).alias("inc_reads"), n("inc", "n_positions", own).alias("inc_positions"), n("exc", "n_reads", own).alias("exc_reads"), n("exc", "n_positions", own).alias("exc_positions"),
        n("exc", "n_reads", F.col("flank")).alias("flank_reads"), *each, *checks,
        F.min(F.when(F.col("jnx"), (F.coalesce("n_reads", F.lit(0)) > 0).cast("int"))).alias("jrf"), F.min(F.when(F.col("jnx"), (F.coalesce("n_positions", F.lit(0)) > 0).cast("int"))).alias("jpf"),
    )
    return _ratios(events.join(g, "event_id"))


def quantify_carried(events: DataFrame) -> DataFrame:
    """``quantify`` of events whose exons carry their counts (``grouped_junctions``): nothing is joined; exc and inc are left with their bounds alone."""
    flanks = lambda p: F.array(F.element_at(p, 1), F.element_at(p, -1))
    mids = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    hops = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)
    total = lambda xs, c: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x[c], F.lit(0)))
    seen = lambda xs, c: F.forall(xs, lambda x: F.coalesce(x[c], F.lit(0)) > 0).cast("int")
    told = lambda xs, c: F.array_join(F.transform(xs, lambda x: F.coalesce(x[c], F.lit(0)).cast("string")), ",")
    cols = {}
    for side in ("inc", "exc"):
        p = F.col(side)
        for what in ("reads", "positions"):
            for part, xs, c in (("flank", flanks(p), f"n_{what}"), ("jnx", hops(p), f"jnx_{what}"), ("mid", mids(p), f"n_{what}")):
                cols[f"{side}_{part}_{what}"] = total(xs, c)
        cols |= {f"{side}_jr": told(hops(p), "jnx_reads"), f"{side}_jp": told(hops(p), "jnx_positions"), f"{side}_jrf": seen(hops(p), "jnx_reads"), f"{side}_jpf": seen(hops(p), "jnx_positions")}
    bounds = {p: F.transform(p, lambda x: F.struct(x["start0"].alias("start0"), x["end1"].alias("end1"))) for p in ("exc", "inc")}
    own = {f"{side}_{what}": F.col(f"{side}_jnx_{what}") + F.col(f"{side}_mid_{what}") for side in ("inc", "exc") for what in ("reads", "positions")}
    out = events.withColumns(cols).withColumns(bounds | own | {"flank_reads": F.col("exc_flank_reads"), "jrf": F.least("inc_jrf", "exc_jrf"), "jpf": F.least("inc_jpf", "exc_jpf")})
    return _ratios(out)


def _ratios(out: DataFrame) -> DataFrame:
    """Counted events with exc_plus, IR, densities and Psi."""
    out = out.withColumn("exc_plus", F.col("exc_reads") + F.when(F.size("exc") == 2, F.col("flank_reads")).otherwise(0))
    di, de = F.try_divide("inc_reads", "inc_positions"), F.try_divide("exc_reads", "exc_positions")
    return out.withColumns({"ir": F.try_divide(F.col("inc_reads"), F.col("inc_reads") + F.col("exc_plus")), "inc_density": di, "exc_density": de, "psi": F.try_divide(di, di + de)})


def known_junctions(occ: DataFrame, read_length: int, min_span: int) -> DataFrame:
    """Junction tags (chrom, strand, blocks, n_tx): up to read_length - min_span bases of the left exon, and as many of the exons that follow.

    A junction next to an exon shorter than ``min_span`` is left out; where the transcript ends early, the last exon is
    followed past its end. Equal coordinates are one tag.
    """
    flank = read_length - min_span
    own = occ.groupBy("tx_id", "chrom", "strand").agg(F.array_sort(F.collect_list(exon_struct())).alias("e"))
    at = own.filter(F.size("e") > 1).withColumn("i", F.explode(F.expr("sequence(1, size(e) - 1)")))
    a, b = F.expr("e[i - 1]"), F.expr("e[i]")
    at = at.filter((a["end1"] - a["start0"] >= min_span) & (b["end1"] - b["start0"] >= min_span))
    first = F.struct(F.greatest(a["start0"], a["end1"] - flank).alias("start0"), a["end1"].alias("end1"))
    rest = F.expr("slice(e, i + 1, size(e) - i)")
    step = lambda acc, x: F.when(acc["left"] <= 0, acc).otherwise(F.struct((acc["left"] - (x["end1"] - x["start0"])).alias("left"), F.concat(acc["out"], F.array(F.struct(x["start0"].alias("start0"), F.least(x["end1"], x["start0"] + acc["left"]).alias("end1")))).alias("out")))
    filled = F.aggregate(rest, F.struct(F.lit(flank).cast("long").alias("left"), F.array().cast(EXON).alias("out")), step, lambda acc: F.struct(F.greatest(acc["left"], F.lit(0)).alias("left"), acc["out"].alias("out")))
    got = at.select("tx_id", "chrom", "strand", first.alias("f"), filled.alias("r"))
    last = F.element_at("r.out", -1)
    longer = F.concat(F.slice("r.out", F.lit(1), F.size("r.out") - 1), F.array(F.struct(last["start0"].alias("start0"), (last["end1"] + F.col("r.left")).alias("end1"))))
    return got.select("tx_id", "chrom", "strand", F.concat(F.array("f"), longer).alias("blocks")).groupBy("chrom", "strand", "blocks").agg(F.count(F.lit(1)).alias("n_tx"))


def tag_blocks(tags: DataFrame, read_length: int, min_span: int) -> DataFrame:
    """Intervals of read starts on each tag (tag_id, blocks) that span the same exons by ``min_span`` on both sides: (tag_id, block_start0, block_end1, n_spanned).

    A read's spanned exons are those of which it covers min_span bases, whole exons in between; it has to span two.
    """
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["end1"] - x["start0"])
    edges = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["end1"] - x["start0"])))
    t = tags.select("tag_id", edges.alias("edges"), size.alias("size")).filter(F.col("size") >= read_length)
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0).cast("long"), F.col("size") - read_length + 1), F.transform("edges", lambda e: e - min_span + 1), F.transform("edges", lambda e: e - read_length + min_span)), lambda c: (c >= 0) & (c <= F.col("size") - read_length + 1))))
    segs = t.withColumn("cuts", cuts).withColumn("i", F.explode(F.expr("sequence(1, size(cuts) - 1)"))).withColumns({"s": F.expr("cuts[i - 1]"), "e": F.expr("cuts[i]")})
    spanned = F.expr(f"size(filter(sequence(1, size(edges) - 1), k -> least(edges[k], s + {read_length}) - greatest(edges[k - 1], s) >= least({min_span}, edges[k] - edges[k - 1])))")
    return segs.withColumn("n_spanned", spanned).filter("n_spanned >= 2").select("tag_id", F.col("s").alias("block_start0"), F.col("e").alias("block_end1"), "n_spanned")


def recombined_junctions(locus_exon: DataFrame, dist: int = 5, block: int = 1000) -> DataFrame:
    """Every left with every later right exon of a locus at least ``dist`` apart; left exons of large loci are dealt into blocks of some ``block``."""
    n = locus_exon.groupBy("locus").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"))
    sized = locus_exon.join(n, "locus")
    e = sized.withColumn("block", F.pmod(F.xxhash64("start0", "end1"), F.col("n_blocks"))).drop("n_blocks")
    b = sized.select("locus", F.col("start0").alias("next_start0"), F.col("end1").alias("next_end1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    return e.join(b, ["locus", "block"]).filter(F.col("next_start0") - F.col("end1") >= dist).select(*LOCUS, "start0", "end1", "next_start0", "next_end1").distinct()


def reversed_graph(edges: DataFrame) -> DataFrame:
    """The edges of a splice graph in transcript direction of the reverse strand: each leads from its right segment to its left one."""
    back = {"start0": "next_start0", "end1": "next_end1", "next_start0": "start0", "next_end1": "end1"}
    return edges.select("chrom", "kind", *(F.col(a).alias(b) for b, a in back.items()))


def splice_graph_edges(blocks: DataFrame, junctions: DataFrame) -> DataFrame:
    """Edges (chrom, kind, start0, end1, next_start0, next_end1) between exonic segments: touching ones, and those a junction joins."""
    b = blocks.filter("n_exons > 0").select("chrom", "start0", "end1")
    c = b.select("chrom", F.col("start0").alias("next_start0"), F.col("end1").alias("next_end1"))
    touch = b.join(c.withColumnRenamed("chrom", "c2"), (F.col("chrom") == F.col("c2")) & (F.col("end1") == F.col("next_start0"))).select("chrom", F.lit("touch").alias("kind"), "start0", "end1", "next_start0", "next_end1")
    j = junctions.select("chrom", F.col("end1").alias("d"), F.col("next_start0").alias("a")).distinct()
    jump = j.join(b.withColumnRenamed("chrom", "c1"), (F.col("chrom") == F.col("c1")) & (F.col("d") == F.col("end1"))).join(c.withColumnRenamed("chrom", "c2"), (F.col("chrom") == F.col("c2")) & (F.col("a") == F.col("next_start0")))
    return touch.unionByName(jump.select("chrom", F.lit("junction").alias("kind"), "start0", "end1", "next_start0", "next_end1"))


def shared_windows(tags: DataFrame, read_length: int) -> DataFrame:
    """Read-length windows of tags (tag_id, chrom, blocks), each once: (chrom, window, n_tags, tag_id of the first).

    Equal windows have the same first junction, so tags are dealt by their junctions and cut into windows behind the shuffle.
    """
    ends = F.aggregate("blocks", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x["end1"] - x["start0"])))
    at = tags.withColumn("ends", ends).withColumn("size", F.element_at("ends", -1)).filter((F.size("blocks") > 1) & (F.col("size") >= read_length))
    at = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("blocks") - 2)))
    left, right, end = F.get("blocks", F.col("j")), F.get("blocks", F.col("j") + 1), F.get("ends", F.col("j"))
    length = left["end1"] - left["start0"]
    # the first and the last base of the junction's left block that a window over the junction begins with
    lo, hi = F.greatest(length - read_length + 1, F.lit(0)), F.least(length - 1, F.col("size") - read_length - end + length)
    rest = F.slice("blocks", F.col("j") + 1, F.size("blocks") - F.col("j"))
    rows = at.select("tag_id", "chrom", left["end1"].alias("donor"), right["start0"].alias("acceptor"), length.alias("length"), (length + right["end1"] - right["start0"]).alias("both"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), rest.alias("rest"))
    cut = rows.filter("lo <= hi").repartition("chrom", "donor", "acceptor").withColumn("o", F.explode(F.sequence("lo", "hi")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["end1"] - x["start0"]).alias("at"),
        F.when((acc["at"] < F.col("o") + read_length) & (acc["at"] + x["end1"] - x["start0"] > F.col("o")), F.concat(acc["w"], F.array(F.struct((x["start0"] + F.greatest(F.col("o") - acc["at"], F.lit(0))).alias("start0"), F.least(x["end1"], x["start0"] + F.col("o") + read_length - acc["at"]).alias("end1"))))).otherwise(acc["w"]).alias("w"),
    )
    win = F.aggregate("rest", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(EXON).alias("w")), step, lambda a: a["w"])
    # a window that ends in the right block is told by its junction and start
    own = cut.select("tag_id", "chrom", "donor", "acceptor", (F.col("donor") - F.col("length") + F.col("o")).alias("start0"), F.when(F.col("o") + read_length > F.col("both"), win).alias("longer"))
    held = own.groupBy("chrom", "donor", "acceptor", "start0", "longer").agg(F.countDistinct("tag_id").alias("n_tags"), F.min("tag_id").alias("tag_id"))
    two = F.array(F.struct("start0", F.col("donor").alias("end1")), F.struct(F.col("acceptor").alias("start0"), (F.col("acceptor") + read_length - F.col("donor") + F.col("start0")).alias("end1")))
    return held.select("chrom", F.coalesce("longer", two.cast(EXON)).alias("window"), "n_tags", "tag_id")


def is_cobound(exc: Column, inc: Column) -> Column:
    """Whether both paths have the same first and the same last exon, bounds and all; events can be filtered by it."""
    return (F.element_at(exc, 1) == F.element_at(inc, 1)) & (F.element_at(exc, -1) == F.element_at(inc, -1))


def _identity(events: DataFrame, event_type: Column, locus_name: Column, link_prefix: str, link_suffix: str) -> list:
    """The twelve columns that both event tables begin with; paths are given inclusion before exclusion."""
    path = lambda p: F.array_join(F.transform(p, lambda x: F.concat_ws("-", x["start0"] + 1, x["end1"])), ",")
    mids = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    jnx = lambda p: F.array_join(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: F.concat_ws(">", x["end1"], F.get(p, i + 1)["start0"] + 1)), ",")
    both = lambda f: F.concat_ws("/", f(F.col("inc")), f(F.col("exc")))
    group = F.concat_ws("_", "src", "dst") if {"src", "dst"} <= set(events.columns) else F.lit("")
    bounds = F.concat("inc", "exc")
    low, high = F.array_min(F.transform(bounds, lambda x: x["start0"])), F.array_max(F.transform(bounds, lambda x: x["end1"]))
    return [
        event_type.alias("event_type"), locus_name.alias("locus_name"), F.concat_ws("/", group, group).alias("groups"), both(jnx).alias("junctions"), "chrom", "strand", both(path).alias("coordinates"),
        is_cobound(F.col("exc"), F.col("inc")).cast("int").alias("cobound"), both(lambda p: path(mids(p))).alias("exonic"), path(mids(F.col("inc"))).alias("inc_specific"), path(mids(F.col("exc"))).alias("exc_specific"),
        F.concat(F.lit(link_prefix), "chrom", F.lit(":"), low, F.lit("-"), high, F.lit(link_suffix)).alias("link"),
    ]


def identity_table(events: DataFrame, event_type: Column, locus_name: Column, link_prefix: str = "", link_suffix: str = "") -> DataFrame:
    """Events, counted or not, as the twelve columns that ``count_table`` begins with."""
    return events.select(*_identity(events, event_type, locus_name, link_prefix, link_suffix))


def count_table(events: DataFrame, event_type: Column, locus_name: Column, link_prefix: str = "", link_suffix: str = "") -> DataFrame:
    """Quantified events as the 43 columns of the text table: identity, places, link, counts of each path and ratios.

    ``groups`` are the boundary groups that the paths share (columns src and dst, empty without them). Coordinates are
    1-based starts and ends; ratios without a denominator are null.
    """
    parts = [f"{part}_{what}" for part in ("flank", "jnx", "mid") for what in ("reads", "positions")]
    sides = [f"{side}_{c}" for side in ("inc", "exc") for c in (*parts, "jr", "jp", "jrf", "jpf")]
    last = ["inc_reads", "inc_positions", "exc_reads", "exc_positions", (F.col("inc_reads") + F.col("exc_reads")).alias("all_reads"), F.col("inc_reads").alias("ni"), F.col("exc_plus").alias("ne_plus"), "ir", "inc_density", "exc_density", "psi"]
    return events.select(*_identity(events, event_type, locus_name, link_prefix, link_suffix), *sides, *last)


#: Kinds of the snippets around splice sites, by where they lie: bases of an exon or intron at its 5' or 3' end.
SNIPPETS = ("E3", "I5", "I3", "E5")


def splice_snippets(events: DataFrame, sequences: DataFrame, i5: int, i3: int, e5: int, e3: int) -> DataFrame:
    """(event_id, side, at, kind, seq): bases around each splice site of both paths, in transcript direction.

    At each donor (at counts them from 0) the last ``e3`` bases of the exon (E3) and the first ``i5`` of the intron (I5), at
    each acceptor the last ``i3`` of the intron (I3) and the first ``e5`` of the exon (E5); never more than half of either.
    """
    from ..functions.sequence import reverse_complement
    from .sequences import fetch_sequence

    minus = F.col("strand") == "-"
    paths = F.array(F.struct(F.lit("exc").alias("side"), F.col("exc").alias("p")), F.struct(F.lit("inc").alias("side"), F.col("inc").alias("p")))
    sites = events.select("event_id", "chrom", "strand", F.explode(paths).alias("s")).select("event_id", "chrom", "strand", "s.side", F.size("s.p").alias("k"), F.posexplode(F.expr("transform(sequence(1, size(s.p) - 1), i -> struct(s.p[i - 1] AS a, s.p[i] AS b))")).alias("i", "x"))
    half = lambda n, size: F.least(n.cast("long"), F.floor(size / 2))
    a0, a1, b0, b1 = F.col("x.a.start0"), F.col("x.a.end1"), F.col("x.b.start0"), F.col("x.b.end1")
    by = lambda plus, other: F.when(minus, other).otherwise(plus)
    # from left to right: end of the left exon, both ends of the intron, start of the right exon
    cuts = [
        (by(F.lit("E3"), F.lit("E5")), a1 - half(by(F.lit(e3), F.lit(e5)), a1 - a0), a1),
        (by(F.lit("I5"), F.lit("I3")), a1, a1 + half(by(F.lit(i5), F.lit(i3)), b0 - a1)),
        (by(F.lit("I3"), F.lit("I5")), b0 - half(by(F.lit(i3), F.lit(i5)), b0 - a1), b0),
        (by(F.lit("E5"), F.lit("E3")), b0, b0 + half(by(F.lit(e5), F.lit(e3)), b1 - b0)),
    ]
    at = by(F.col("i"), F.col("k") - 2 - F.col("i"))
    want = sites.select("event_id", "chrom", "strand", "side", at.alias("at"), F.explode(F.array(*(F.struct(k.alias("kind"), s.alias("start0"), e.alias("end1")) for k, s, e in cuts))).alias("c")).select("event_id", "chrom", "strand", "side", "at", "c.*")
    got = fetch_sequence(sequences, want.select(F.col("chrom").alias("contig"), "start0", "end1").distinct()).withColumnRenamed("contig", "chrom")
    rows = want.join(got, ["chrom", "start0", "end1"])
    return rows.select("event_id", "side", "at", "kind", by(F.col("seq"), reverse_complement(F.col("seq"))).alias("seq"))


def sequence_table(events: DataFrame, sequences: DataFrame, event_type: Column, locus_name: Column, i5: int = 0, i3: int = 0, e5: int = 0, e3: int = 0, link_prefix: str = "", link_suffix: str = "") -> DataFrame:
    """Events (event_id, chrom, strand, exc, inc) as the 20 columns of the sequence table.

    The first twelve are those of ``count_table``. Then come the exons of each path, joined by ``|``, and its snippets
    upstream (at the first donor), downstream (at the last acceptor) and in the middle, each as ``kind:bases`` joined by ``|``.
    """
    own = event_sequences(events, sequences).drop("inc_up", "inc_down")
    order = F.array_position(F.array(*(F.lit(k) for k in SNIPPETS)), F.col("kind"))
    s = splice_snippets(events, sequences, i5, i3, e5, e3).filter("seq <> ''")
    s = s.withColumns({"last": F.max("at").over(Window.partitionBy("event_id", "side")), "donor": F.col("kind").isin("E3", "I5")})
    where = F.when(F.col("donor") & (F.col("at") == 0), "up").when(~F.col("donor") & (F.col("at") == F.col("last")), "down").otherwise("mid")
    held = s.groupBy("event_id", F.concat_ws("_", "side", where).alias("w")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", order.alias("o"), F.concat_ws(":", "kind", "seq").alias("t")))), lambda x: x["t"]), "|").alias("t"))
    names = [f"{side}_{w}" for side in ("inc", "exc") for w in ("up", "mid", "down")]
    wide = held.groupBy("event_id").pivot("w", names).agg(F.first("t"))
    full = own.join(wide, "event_id", "left")
    return full.select(*_identity(full, event_type, locus_name, link_prefix, link_suffix), "inc_seq", "exc_seq", *names)


def event_sequences(events: DataFrame, sequences: DataFrame, i5: int = 0, i3: int = 0) -> DataFrame:
    """``events`` (event_id, chrom, strand, exc, inc) with the exon sequences of both paths, joined by ``|`` in transcript direction.

    ``inc_up`` and ``inc_down`` are i5 and i3 intron bases before and after the inclusion path's second exon. All parts of
    all events are fetched by one join.
    """
    from ..functions.sequence import reverse_complement
    from .sequences import fetch_sequence

    paths = F.array(F.struct(F.lit("exc").alias("side"), F.col("exc").alias("p")), F.struct(F.lit("inc").alias("side"), F.col("inc").alias("p")))
    parts = events.select("event_id", "chrom", "strand", F.explode(paths).alias("s")).select("event_id", "chrom", "strand", "s.side", F.posexplode("s.p").alias("i", "x"))
    mid = F.element_at("inc", 2)
    around = lambda side, s, e: events.select("event_id", "chrom", "strand", F.lit(side).alias("side"), F.lit(0).alias("i"), F.struct(s.alias("start0"), e.alias("end1")).alias("x"))
    minus = F.col("strand") == "-"
    low = around("low", F.greatest(mid["start0"] - F.when(minus, i3).otherwise(i5), F.lit(0)), mid["start0"])
    high = around("high", mid["end1"], mid["end1"] + F.when(minus, i5).otherwise(i3))
    want = parts.unionByName(low).unionByName(high)
    regions = want.select(F.col("chrom").alias("contig"), F.col("x.start0").alias("start0"), F.col("x.end1").alias("end1")).distinct()
    got = fetch_sequence(sequences, regions).withColumnRenamed("contig", "chrom")
    rows = want.withColumns({"start0": F.col("x.start0"), "end1": F.col("x.end1")}).join(got, ["chrom", "start0", "end1"])
    rows = rows.withColumns({"seq": F.when(minus, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "k": F.when(minus, -F.col("i")).otherwise(F.col("i"))})
    joined = rows.groupBy("event_id", "strand", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "seq"))), lambda x: x["seq"]), "|").alias("seq"))
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("seq")))
    g = joined.groupBy("event_id", "strand").agg(one("exc").alias("exc_seq"), one("inc").alias("inc_seq"), one("low").alias("low"), one("high").alias("high"))
    named = g.select("event_id", "exc_seq", "inc_seq", F.when(minus, F.col("high")).otherwise(F.col("low")).alias("inc_up"), F.when(minus, F.col("low")).otherwise(F.col("high")).alias("inc_down"))
    return events.join(named, "event_id")


def collapse_linear(edges: DataFrame) -> DataFrame:
    """Runs of segments without a branch: (chrom, start0, end1, run0), where run0 is the start of the run's first segment.

    An edge is linear if it is the only one out of its source and the only one into its target.
    """
    from .graph import label_components

    a, b = F.struct("chrom", F.col("start0").alias("s"), F.col("end1").alias("e")), F.struct("chrom", F.col("next_start0").alias("s"), F.col("next_end1").alias("e"))
    e = edges.select(a.alias("a"), b.alias("b")).distinct()
    out, into = e.groupBy("a").agg(F.count(F.lit(1)).alias("n_out")), e.groupBy("b").agg(F.count(F.lit(1)).alias("n_in"))
    linear = e.join(out.filter("n_out = 1"), "a").join(into.filter("n_in = 1"), "b").select("a", "b")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    r = label_components(nodes, linear)
    return r.select("node.chrom", F.col("node.s").alias("start0"), F.col("node.e").alias("end1"), F.col("label.s").alias("run0"))


def graph_bed(runs: DataFrame) -> DataFrame:
    """One BED row for each run of a splice graph."""
    return runs.groupBy("chrom", "run0").agg(F.max("end1").alias("end1"), F.count(F.lit(1)).alias("score")).select("chrom", F.col("run0").alias("start0"), "end1", F.concat_ws(":", "chrom", "run0").alias("name"), "score")
