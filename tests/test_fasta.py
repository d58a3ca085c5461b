"""FASTA files read in ranges of every size give the records that a plain reading gives."""

import gzip
import random

import pytest

from helixframe.sources import fasta


def plain(text):
    out = []
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0], ""])
        elif out:
            out[-1][1] += "".join(line.split()).upper()
    return sorted(map(tuple, out))


def joined(df, chunk):
    held = {}
    for r in df.collect():
        held.setdefault(r.contig, {}).setdefault(r.chunk, r.seq)
    for own in held.values():
        assert sorted(own) == list(range(len(own))) and all(len(own[k]) == chunk for k in range(len(own) - 1)) and len(own[len(own) - 1]) <= chunk
    return sorted((c, "".join(own[k] for k in sorted(own))) for c, own in held.items())


TEXT = "junk\nACGT\n>s1 c.76A>T variant\nACGTAC\nGT>AC\r\nacgtn\n>s2\n>s3 >x\n\nTTTT TTTT\n>long one line\n" + "ACGGT" * 60 + "\n>end\nAC"


@pytest.mark.parametrize("size", [1, 2, 7, 33, 10_000])
def test_ranges_of_every_size(spark, tmp_path, size):
    (tmp_path / "a.fa").write_text(TEXT)
    got = fasta.read_fasta(spark, str(tmp_path / "a.fa"), chunk=8, range_bytes=size)
    want = plain(TEXT)
    assert joined(got, 8) == want and {c for c, _ in want} == {"s1", "s2", "s3", "long", "end"}


def test_pieces_of_random_texts(tmp_path):
    """What the ranges of a file hold, put in order, is the file's records, whatever the range."""
    rng = random.Random(4)
    for trial in range(60):
        text = "".join(rng.choice([">", "\n", "\n>", "A", "C", "gt", " ", ">h x\n"]) for _ in range(rng.randint(0, 60)))
        path = tmp_path / f"{trial}.fa"
        path.write_text(text)
        for size in (1, 3, 11):
            out = [["", ""]]
            for k, a in enumerate(range(0, max(len(text), 1), size)):
                for _, name, bases, new in fasta.pieces(fasta._Range(str(path), k, a, min(a + size, len(text)))):
                    if new:
                        out.append([(name.split() or [""])[0], ""])
                    out[-1][1] += bases.decode().upper()
            assert sorted(map(tuple, out[1:])) == plain(text), (text, size)


def test_folders_packed_files_and_repeated_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.fa").write_text(">a\nAC\n>b\n" + "G" * 20)
    with gzip.open(tmp_path / "x" / "b.fa.gz", "wt") as f:
        f.write(">c\n" + "T" * 9)
    (tmp_path / "x" / "_SUCCESS").write_text(">hidden\nA")
    (tmp_path / "x" / "c.fa").write_text("")
    assert joined(fasta.read_fasta(spark, str(tmp_path / "x"), chunk=8), 8) == [("a", "AC"), ("b", "G" * 20), ("c", "T" * 9)]
    (tmp_path / "twice.fa").write_text(">a\nAC\n>a\nGT\n")
    assert sorted(r.seq for r in fasta.read_fasta(spark, f"file://{tmp_path}/twice.fa").collect()) == ["AC", "GT"]
    with pytest.raises(Exception, match="none.fa"):
        fasta.read_fasta(spark, str(tmp_path / "none.fa")).count()


def test_no_row_holds_more_than_a_chunk(spark, tmp_path):
    with open(tmp_path / "one.fa", "w") as f:
        f.write(">chr\n" + "ACGT" * 1_000_000 + "\n")
    df = fasta.read_fasta(spark, str(tmp_path / "one.fa"), range_bytes=1 << 19)
    rows = df.selectExpr("chunk", "length(seq) n").collect()
    assert sum(r.n for r in rows) == 4_000_000 and max(r.n for r in rows) == 16384 and len({r.chunk for r in rows}) == len(rows) == 245
    raw = spark.read.format("helix_fasta").options(range=1 << 19, chunk=16384).load(str(tmp_path / "one.fa"))
    assert raw.selectExpr("max(length(seq))").first()[0] <= 16384 and raw.select("part").distinct().count() == 8
