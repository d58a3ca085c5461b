"""k-mers of sequences and what of a genome they map uniquely to."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from . import intervals as I

#: Bases that k-mers are read from at once: finding a place in a text takes time in proportion to it.
STRETCH = 256


def kmers(sequences: DataFrame, k: int, prefix: str | None = None) -> DataFrame:
    """(contig, pos1, kmer, strand) for both strands of whole sequences (contig, seq), at their forward position from 1.

    Sequences shorter than k give none; ``prefix`` keeps the k-mers that begin so.
    """
    starts = F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(STRETCH))).alias("s")
    parts = sequences.filter(F.length("seq") >= k).select("contig", "seq", starts).select("contig", "s", F.substr("seq", F.col("s") + 1, F.lit(STRETCH + k - 1)).alias("seq"))
    at = parts.select("contig", "s", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("i"))
    one = at.select("contig", (F.col("s") + F.col("i")).cast("long").alias("pos1"), F.substr("seq", F.col("i"), F.lit(k)).alias("f"))
    both = one.select("contig", "pos1", F.explode(F.array(F.struct(F.col("f").alias("kmer"), F.lit("+").alias("strand")), F.struct(reverse_complement(F.col("f")).alias("kmer"), F.lit("-").alias("strand")))).alias("x"))
    out = both.select("contig", "pos1", "x.kmer", "x.strand")
    return out if prefix is None else out.filter(F.col("kmer").startswith(prefix))


def kmers_of_chunks(chunks: DataFrame, k: int, chunk: int = 16384) -> DataFrame:
    """k-mers of chunked sequences (contig, chunk, seq): each chunk borrows the k - 1 bases that follow."""
    head = chunks.select("contig", (F.col("chunk") - 1).alias("chunk"), F.substr("seq", F.lit(1), F.lit(k - 1)).alias("more"))
    long = chunks.join(head, ["contig", "chunk"], "left").select("contig", "chunk", F.concat("seq", F.coalesce("more", F.lit(""))).alias("seq"))
    keyed = long.select(F.struct("contig", "chunk").alias("contig"), "seq")
    return kmers(keyed, k).select(F.col("contig.contig").alias("contig"), (F.col("pos1") + F.col("contig.chunk") * chunk).alias("pos1"), "kmer", "strand")


def kmer_fold(rows: DataFrame, max_freq: int = 1) -> DataFrame:
    """k-mers that occur at most ``max_freq`` times, with their count and first place."""
    held = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("contig", "pos1", "strand")).alias("p")).filter(F.col("n") <= max_freq)
    return held.select("kmer", "n", "p.contig", "p.pos1", "p.strand")


def mappable_runs(sequences: DataFrame, k: int, max_freq: int = 1) -> DataFrame:
    """Runs (contig, start1, end1) of forward positions whose k-mer is rare on both strands."""
    return rare_runs(kmers(sequences, k), max_freq)


def rare_runs(rows: DataFrame, max_freq: int = 1) -> DataFrame:
    """``mappable_runs`` of k-mers (contig, pos1, kmer, strand)."""
    forward = kmer_fold(rows, max_freq).filter("strand = '+'").select("contig", "pos1")
    return I.position_runs(forward, ["contig"])


def parse_contig_id(c: Column) -> Column:
    """struct<chrom, tag_set, number> of ``chrom|set:n``."""
    rest = F.split_part(c, F.lit("|"), F.lit(2))
    return F.struct(F.split_part(c, F.lit("|"), F.lit(1)).alias("chrom"), F.split_part(rest, F.lit(":"), F.lit(1)).alias("tag_set"), F.split_part(rest, F.lit(":"), F.lit(2)).try_cast("bigint").alias("number"))


def tile_segments(blocks: DataFrame, chunks: DataFrame, read_length: int) -> DataFrame:
    """Read-length windows of exonic segments: (chrom, start0, end1, pos0, seq)."""
    from .sequences import fetch_sequence

    spans = blocks.filter((F.col("end1") - F.col("start0") >= read_length))
    found = fetch_sequence(chunks, spans.select(F.col("chrom").alias("contig"), "start0", "end1"))
    at = found.select("contig", "start0", "end1", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - read_length + 1)).alias("i"))
    return at.select(F.col("contig").alias("chrom"), "start0", "end1", (F.col("start0") + F.col("i") - 1).alias("pos0"), F.substr("seq", F.col("i"), F.lit(read_length)).alias("seq"))


def sort_kmers(rows: DataFrame) -> DataFrame:
    return rows.orderBy("kmer", "contig", "pos1", "strand")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(contig, md5) of rows (contig, seq) in order; the state of one digest is held."""
    contig, state = None, None
    for b in batches:
        done = []
        for own, seq in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if state is None or own != contig:
                if state is not None:
                    done.append((contig, state.hexdigest()))
                contig, state = own, hashlib.md5(usedforsecurity=False)
            state.update(seq.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["contig", "md5"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([contig]), pa.array([state.hexdigest()])], names=["contig", "md5"])


def sequence_digests(chunks: DataFrame) -> DataFrame:
    """(contig, md5) of each upper-cased sequence.

    A digest is sequential: a contig's chunks, sorted, stream through one task, and no row holds more than a chunk.
    """
    rows = chunks.select("contig", "chunk", F.upper("seq").alias("seq")).repartition("contig").sortWithinPartitions("contig", "chunk")
    return rows.select("contig", "seq").mapInArrow(_digested, "contig string, md5 string")


def digest_xor(digests: DataFrame) -> DataFrame:
    """The order-free XOR of all digests, as 32 hexadecimal digits."""
    part = lambda i: F.bit_xor(F.conv(F.substr("md5", F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")).alias(f"p{i}")
    row = digests.agg(*(part(i) for i in range(4)))
    return row.select(F.lower(F.concat(*(F.lpad(F.hex(F.coalesce(f"p{i}", F.lit(0))), 8, "0") for i in range(4)))).alias("md5_xor"))
