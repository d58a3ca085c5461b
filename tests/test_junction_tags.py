"""Junction tags against plain walks over exons."""

import random

from helixframe.operators import junction_tags as J

OCC = "tx_id long, chrom string, strand string, start0 long, end1 long"


def pairs(blocks):
    return [(b["start0"], b["end1"]) for b in blocks]


def transcripts(rng, n):
    out = {}
    for t in range(n):
        at, own = 100 * (t % 3), []
        for _ in range(rng.randint(1, 5)):
            at += rng.choice([20, 40])
            size = rng.choice([3, 10, 10, 25])
            own.append((at, at + size))
            at += size
        out[t] = own
    return out


def walked(exons, flank, leftwards, over=True):
    """Blocks in genomic order and the exons used, junction outwards."""
    blocks, path, missing = [], [], flank
    for s, e in exons:
        if missing <= 0:
            break
        n = min(missing, e - s)
        blocks.append((e - n, e) if leftwards else (s, s + n))
        path.append((s, e))
        missing -= n
    if over and missing:
        s, e = blocks[-1]
        blocks[-1] = (s - missing, e) if leftwards else (s, e + missing)
    return tuple(blocks[::-1] if leftwards else blocks), tuple(path)


def told(row):
    return {(tuple(pairs(p["left_path"])), tuple(pairs(p["right_path"]))) for p in row["exon_paths"]}


def test_known_tags_and_flanks(spark):
    rng = random.Random(1)
    txs = transcripts(rng, 25)
    occ = spark.createDataFrame([(t, "c", "+", s, e) for t, own in txs.items() for s, e in own], OCC)
    want = {}
    for own in txs.values():
        for i in range(len(own) - 1):
            if min(own[i][1] - own[i][0], own[i + 1][1] - own[i + 1][0]) >= 5:
                left, lp = walked([own[i]], 15, True, over=False)
                right, rp = walked(own[i + 1 :], 15, False)
                want.setdefault((left, right), []).append((lp, rp))
    got = {(tuple(pairs(r["left"])), tuple(pairs(r["right"]))): r for r in J.known_tags(occ, 20, 5).collect()}
    assert {k: set(v) for k, v in want.items()} == {k: told(r) for k, r in got.items()}
    assert {k: len(v) for k, v in want.items()} == {k: r["n_tx"] for k, r in got.items()}
    for leftwards in (True, False):
        flanks = {(tuple(r["exon"]), *map(tuple, (pairs(r["blocks"]), pairs(r["path"])))) for r in J.transcript_flanks(occ, 15, leftwards).collect()}
        assert flanks == {(own[i], *walked(own[i::-1] if leftwards else own[i:], 15, leftwards)) for own in txs.values() for i in range(len(own))}


def all_paths(exons, x, missing, dist, leftwards):
    n = min(missing, x[1] - x[0])
    block, missing = ((x[1] - n, x[1]) if leftwards else (x[0], x[0] + n)), missing - n
    onward = [v for v in exons if (v[1] + dist <= x[0] if leftwards else x[1] + dist <= v[0])] if missing > 0 else []
    if not onward:
        return [((block,), (x,))]
    return [(((*b, block) if leftwards else (block, *b)), (x, *p)) for v in onward for b, p in all_paths(exons, v, missing, dist, leftwards)]


def test_recombined_tags(spark):
    rng = random.Random(2)
    loci = {k: sorted({(s, s + rng.choice([4, 6, 12])) for s in (rng.randrange(0, 90) for _ in range(rng.randint(1, 7)))}) for k in range(6)}
    df = spark.createDataFrame([(k, "c", "-", s, e) for k, own in loci.items() for s, e in own], "locus long, chrom string, strand string, start0 long, end1 long")
    want = {}
    for k, own in loci.items():
        left, right = ([p for x in own for p in all_paths(own, x, 10, 5, side)] for side in (True, False))
        for lb, lp in left:
            for rb, rp in right:
                if lp[0][1] + 5 <= rp[0][0]:
                    want.setdefault((k, lb, rb), set()).add((lp, rp))
    for block in (1000, 2):
        got = {(r["locus"], tuple(pairs(r["left"])), tuple(pairs(r["right"]))): told(r) for r in J.recombined_tags(df, 10, 5, block=block).collect()}
        assert got == want
    short = J.flank_paths(df, 10, 5, True, max_exons=1)
    assert short.count() == sum(map(len, loci.values())) and all(len(r["path"]) == 1 for r in short.collect())
    assert J.recombined_tags(df.limit(0), 10).count() == 0


def windows(blocks, n):
    """Each stretch of n bases of blocks laid end to end, as the places of its bases."""
    places = [p for s, e in blocks for p in range(s, e)]
    return [tuple(places[i : i + n]) for i in range(len(places) - n + 1)]


def test_each_window_is_in_one_row(spark):
    rng = random.Random(3)
    rows = []
    for c in range(5):
        for _ in range(rng.randint(1, 6)):
            a, b = rng.choice([3, 5, 8]), rng.choice([2, 4, 8])
            more = rng.choice([[], [(140, 140 + 10 - b)], [(150, 150 + 10 - b)]])
            left, right = [(50 - a, 50)], [(100, 100 + b), *more]
            rows.append((f"c{c}", "+", left, right, [(left, right)]))
    block = "array<struct<start0:bigint,end1:bigint>>"
    tags = spark.createDataFrame(rows, f"chrom string, strand string, left {block}, right {block}, exon_paths array<struct<left_path:{block},right_path:{block}>>").dropDuplicates(["chrom", "left", "right"])
    held = {}
    for r in tags.collect():
        for w in windows(pairs(r["left"]) + pairs(r["right"]), 9):
            held.setdefault((r["chrom"], w), []).append(told(r))
    seen, sharers = {}, {}
    for r in J.resolve_shared(tags, 9).collect():
        assert (r["donor"], r["acceptor"]) == (50, 100)
        own = windows(pairs(r["blocks"]), 9)
        assert len(own) == r["n_windows"]
        sharers.setdefault(r["chrom"], []).append((r["nth"], r["n_tags"]))
        for w in own:
            assert (r["chrom"], w) not in seen
            seen[r["chrom"], w] = r
    assert seen.keys() == held.keys()
    for k, r in seen.items():
        assert r["n_tags"] == len(held[k]) and told(r) == set().union(*held[k])
    for own in sharers.values():
        assert [n for n, _ in sorted(own)] == list(range(1, len(own) + 1)) and [m for _, m in sorted(own)] == sorted((m for _, m in own), reverse=True)
    assert any(r["n_tags"] > 1 for r in seen.values()) and any(r["n_tags"] == 1 for r in seen.values())
    long = {r["chrom"] for r in tags.collect() if len(windows(pairs(r["left"]) + pairs(r["right"]), 9))}
    assert long == set(sharers)


def test_sequences_of_tags(spark):
    block = "array<struct<start0:bigint,end1:bigint>>"
    seqs = spark.createDataFrame([("c", 0, "ACGTACGTAACCGGTT")], "contig string, chunk int, seq string")
    tags = spark.createDataFrame([("c", "+", [(0, 2), (4, 6)], [(8, 10), (12, 40)]), ("c", "-", [(1, 3)], [(20, 30)])], f"chrom string, strand string, left {block}, right {block}")
    assert {r["strand"]: (r["left_seq"], r["right_seq"]) for r in J.tag_sequences(tags, seqs).collect()} == {"+": ("ACAC", "AAGGTT"), "-": ("CG", "")}
