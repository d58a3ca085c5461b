"""Vector best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, id_and_text, tidy

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Blocks of pieces that a task packs.
BLOCKS_A_TASK = 4
#: Words up to this length are remembered: twice so many, and so many ends of chunks, per Python worker.
CHUNK_CHARS, WORDS_KEPT, TAILS_KEPT = 48, 150_000, 10_000
#: Text that a worker splits at once, in bytes.
SLICE_BYTES = 2 << 20
#: ASCII marks that are tokens apart from the letters before them when they end a chunk.
_TAIL = ".,!?;:$*&#%)"
#: Lower-case letters that stay one character each whatever the tokenizer does to case and form; runs of them are one word.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")


class ChunkTokenizer:
    """Little-endian 32-bit ids of chunks between ASCII white space.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its chunks in order.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self._tokenizer = Tokenizer.from_file(path)
        self._words: dict[str, bytes] = {}
        self._older_words: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {"": b""}
        # the vocabulary writes bytes as characters: printable ones as themselves, the others from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self._letters = {i: i if i in plain else next(others) for i in range(256)}

    def encode(self, chunk: str) -> bytes:
        return np.asarray(self._tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A plain word's ids. Words that weren't asked for while the newer half filled up go."""
        if len(self._words) >= WORDS_KEPT:
            self._older_words, self._words = self._words, {}
        ids = self._older_words.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
            ids = array("I", [t.id for t in self._tokenizer.model.tokenize(shown)]).tobytes()
        self._words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        stem = chunk.rstrip(_TAIL)
        word = stem.lower()
        ids = self._words.get(word)
        if ids is None:
            if len(chunk) > CHUNK_CHARS or not _PLAIN.fullmatch(word):
                return self.encode(chunk) if chunk else b""
            ids = self._word(word)
        if len(stem) == len(chunk):
            return ids
        tail = chunk[len(stem) :]
        end = self._tails.get(tail)
        if end is None:
            if len(self._tails) >= TAILS_KEPT:
                self._tails.clear()
            end = self._tails[tail] = self.encode(tail)
        return ids + end

    def text(self, text: str) -> bytes:
        return b"".join(map(self.chunk, _BLANKS.split(text)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and the last ends.

        Each different chunk is looked up once.
        """
        chunks = pc.ascii_split_whitespace(texts)
        ends = np.asarray(chunks.offsets, np.int64)
        coded = chunks.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        known = [self.chunk(c) for c in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[at]
        done = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(starts[at] - done[:-1], n)
        places += np.arange(done[-1])
        return table[places], done[ends - ends[0]]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text, or one longer text."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


@tidy
def _tokenize(batches: Iterator[pa.RecordBatch], path: str | None, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokenizer, end = held("packing", path, partial(ChunkTokenizer, path)), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        for part in _slices(batch):
            ids, ends = tokenizer.texts(part.column(1))
            rows, size = [], 0
            for doc_id, a, b in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = ids[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(own), 4 * most)):
                    piece = own[at : at + 4 * most]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, piece))
                    size += len(piece)
                if size > SLICE_BYTES:
                    yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=_PIECES)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=_PIECES)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids) of each document's ids and an end id, cut every ``max_tokens``.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text has the end id alone; null doc_ids stay null;
    repeated rows are tokenised each; other columns are ignored; an empty table gives no rows. ``tokenizer_path`` is read
    where tasks run; None stands for the installed word vocabulary.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(partial(_tokenize, path=tokenizer_path, most=max_tokens, end_id=end_id), "doc_id long, piece int, start long, length long, ids binary")


def pack_block(demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing in several dimensions: the bin and the first-dimension offset of each item.

    Items go by falling demand. Among the bins that hold an item under every capacity, ``norm`` takes the one with the
    least weighted square of what stays free and ``dot`` the one whose free space points most along the item.
    """
    n = len(demands)
    bins, offsets = np.empty(n, np.int64), np.zeros(n, np.int64)
    free = np.empty((n, demands.shape[1]))
    scale = weights / capacities**2
    order = np.lexsort((np.arange(n), *-demands.T[::-1]))
    ids, held, made = np.empty(n, np.int64), 0, 0  # open bins' numbers, how many are open, how many there are
    least = demands.min(axis=0) if n else None
    for i in order:
        d = demands[i]
        if (d > capacities).any():
            raise ValueError(f"an item of {d.tolist()} exceeds the capacities {capacities.tolist()}")
        open_ = free[:held]
        fits = np.flatnonzero(open_[:, 0] >= d[0])
        if len(fits):
            fits = fits[(open_[fits] >= d).all(axis=1)]
        if len(fits):
            left = open_[fits]
            k = fits[np.argmax((left * d * scale).sum(axis=1)) if rule == "dot" else np.argmin(((left - d) ** 2 * scale).sum(axis=1))]
        else:
            k, ids[held], free[held] = held, made, capacities
            held, made = held + 1, made + 1
        bins[i], offsets[i] = ids[k], capacities[0] - free[k, 0]
        free[k] -= d
        if (free[k] < least).any():  # nothing fits any more: the last open bin takes its place
            held -= 1
            free[k], ids[k] = free[held], ids[held]
    return bins, offsets


@tidy
def _pack(batches: Iterator[pa.RecordBatch], capacities, weights, rule: str, block_rows: int) -> Iterator[pa.RecordBatch]:
    base, capacities, weights = TaskContext.get().partitionId() << 40, np.asarray(capacities, float), np.asarray(weights, float)

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal base
        length = table.column("length").to_numpy().astype(float)
        bins, offsets = pack_block(np.stack([length, np.ones_like(length), length**2], 1), capacities, weights, rule)
        out = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        base += int(bins.max(initial=-1)) + 1
        yield from out.to_batches()

    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        while rows >= block_rows:
            table = pa.Table.from_batches(waiting)
            yield from packed(table.slice(0, block_rows))
            rest = table.slice(block_rows)
            waiting, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield from packed(pa.Table.from_batches(waiting))


def best_fit_pack(
    pieces: DataFrame,
    max_tokens: int = SEQUENCE_TOKENS,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
    block_rows: int = 8192,
) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with ``sequence_id`` and ``offset``.

    A sequence holds at most ``max_tokens`` tokens, ``max_documents`` pieces and ``max_attention`` summed squared lengths;
    None leaves the last two as wide as the tokens alone allow. Pieces are written once and counted, dealt in turn to
    tasks of BLOCKS_A_TASK times ``block_rows`` of them, and packed in such blocks: a task's memory is bounded,
    at most one or two sequences a block stay poorly filled, and the fill doesn't depend on the session's partitions. The
    order within a task is fixed by hash and key, so a task run again packs alike; pieces of equal length go in that order.
    A piece over a capacity raises an error. An empty table gives no rows; pieces that repeat are packed each; a very long
    document comes as pieces already, and columns of other names, but for the two added ones, stay as they are.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(rule)
    capacities = (max_tokens, max_documents or max_tokens, max_attention or float(max_tokens) ** 2)
    pieces, key = cut(pieces.drop("sequence_id", "offset")), ["doc_id", "piece", "length"]
    parts = max(1, -(-pieces.count() // (BLOCKS_A_TASK * block_rows)))
    dealt = pieces.repartition(parts).sortWithinPartitions(F.xxhash64(*key), *key)
    schema = pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.mapInArrow(partial(_pack, capacities=capacities, weights=weights, rule=rule, block_rows=block_rows), schema)
