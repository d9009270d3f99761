"""Best-fit packing of token sequences, by hierarchical residual packing.

A document's ids come from a tokenizer file, closed by an end id; documents longer than a sequence are cut into whole sequences and
a rest. Every partition packs its rests by best-fit decreasing and emits the nearly full bins. Underfull bins become items: they are
written, dealt to fewer partitions and packed again, up a tree, until one round has all that is left, or, where that would be more
than ROUND_ITEMS a task, until a round no longer merges anything. A bin holds at most ``size`` pieces, so a row is bounded.

Ids are looked up by piece: no token of the file crosses white space, nor the edge of a run of letters and a run of marks, so a text's
ids are those of its pieces in turn. Texts are cut and their different pieces found a chunk at a time by NumPy and Arrow; pieces
not seen by the Python worker yet are encoded in batches by the tokenizers library.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import chunks
from evenkeel.operators.runtime import settle, width

SLACK = 16  # tokens: a bin with no more room than this is emitted
FAN_IN = 4  # partitions that merge into one of the next round
ROUND_ITEMS = 400_000  # underfull bins that one task packs, at most
CACHE_WORDS = 300_000  # pieces a generation of the cache holds, but for those of the texts at hand; a Python worker has two

_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # in lower case: a-z and the letters of Latin-1 from U+00DF on
_SPACE, _LETTER, _MARK = 1, 2, 3  # kinds of bytes; 0: others

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[list(range(ord("a"), ord("z") + 1)) + list(range(ord("A"), ord("Z") + 1))] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = _MARK  # without the apostrophe (contractions) and < | > of special tokens
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of some texts in order, and where each text's begin. A word of Latin letters and marks alone is put into lower case and cut
    wherever one follows the other, as the tokenizer does; any other word is one piece, left as it is, for the tokenizer
    matches special tokens and composes marks before it makes letters small."""
    kind, text = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # two bytes, U+00C0 to U+00FF
    tail = data[lead + 1]
    letter = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)  # without the signs of times and division
    lead, tail = lead[letter], tail[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    text[lead + 1] = np.where(tail <= 0x9E, tail + 32, tail)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    odd = np.flatnonzero(kind == 0)
    if len(odd):
        inside = kind != _SPACE
        first = np.flatnonzero(inside & np.append(True, ~inside[:-1] | edge[1:-1]))
        ends = np.flatnonzero(inside & np.append(~inside[1:] | edge[1:-1], True)) + 1
        words = np.unique(np.searchsorted(first, odd, "right") - 1)
        step = np.zeros(len(data) + 1, np.int8)
        step[first[words]] += 1
        step[ends[words]] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        kind[whole] = 0
        np.copyto(text, data, where=whole)
    inside = kind != _SPACE
    edge[0] = edge[-1] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts, ends = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(text[inside])])
    return found, np.searchsorted(starts, offsets)


_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("offset", pa.int32())])
_BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(_PIECE))])
_BIN_DDL = "bin long, fill int, members array<struct<doc_id: long, piece: int, start: long, length: int, crc: long, offset: int>>"


class WordIds:
    """Little-endian 32-bit ids of texts by their pieces.

    Runs of Latin letters in lower case need no normalisation, so many are given to the library in one call and told apart by the ids
    that end a word. Runs of marks and other words are encoded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.accents = Tokenizer.from_file(path)
        self.accents.normalizer = normalizers.Sequence([])
        self.accents.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[bytes, bytes] = {}  # this generation
        self.older: dict[bytes, bytes] = {}  # the one before: its pieces are taken over when they are met again

    def _each(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _runs(self, words: list[bytes], tokenizer) -> None:
        """Learn lower-case runs of Latin letters."""
        for low in range(0, len(words), 1024):
            run = words[low:low + 1024]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(run).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(run):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                self.known.update(zip(run, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
            else:
                self.known.update(zip(run, self._each(run)))

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different pieces."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        if older:
            met = [w for w in new if w in older]
            known.update(zip(met, map(older.__getitem__, met)))
            new = [w for w in new if w not in known]
        self._runs([w for w in new if w.isalpha()], self.letters)  # of bytes: a-z alone, as other words have other bytes
        rest = [w for w in new if not w.isalpha()]
        self._runs([w for w in rest if _LETTERS.fullmatch(w)], self.accents)
        other = [w for w in rest if not _LETTERS.fullmatch(w)]
        known.update(zip(other, self._each(other)))
        return list(map(known.__getitem__, words))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[memoryview]:
        """The ids of every text of a chunk."""
        found, first = pieces(data, offsets)
        found = found.dictionary_encode()
        taken = pa.array(self.of(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        _, at, raw = taken.buffers()
        cuts = np.frombuffer(at, np.int64)[first].tolist()
        view = memoryview(raw if raw is not None else b"")
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield view[low:high]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """Opened once a Python worker; later tasks of the worker find its words."""
    return WordIds(path)


def best_fit(sizes: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by bin."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            bins[own].append(i)
        else:
            room, own = size, len(bins)
            bins.append([i])
        rooms[room - need].append(own)
        open_rooms |= 1 << (room - need)
    return bins


def _emit(bins: list[list[int]], members: list[list[tuple]], round: int) -> Iterator[pa.RecordBatch]:
    base = (round << 56) | (TaskContext.get().partitionId() << 32)
    names = [f.name for f in _PIECE]
    for low in range(0, len(bins), 4096):
        own, fills = [], []
        for b in bins[low:low + 4096]:
            fill, ms = 0, []
            for m in (m for i in b for m in members[i]):
                ms.append(dict(zip(names, (*m[:5], fill))))
                fill += m[3]
            own.append(ms)
            fills.append(fill)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(base + low, base + low + len(own)), pa.int64()), pa.array(fills, pa.int32()),
            pa.array(own, pa.list_(_PIECE))], schema=_BIN)


def _first_round(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rests, full = word_ids(path), [], []
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for rows, data, offsets in chunks(batch, "text"):
                for doc, tokens in zip(ids[rows], words.ids(data, offsets)):
                    count = len(tokens) // 4 + 1
                    for piece, at in enumerate(range(0, count, size)):
                        crc, length = zlib.crc32(tokens[4 * at:4 * (at + size)]), min(size, count - at)
                        if at + length == count:
                            crc = zlib.crc32(last, crc)
                        (full if length == size else rests).append([(doc, piece, at, length, crc)])
        bins = [[i] for i in range(len(full))]
        bins += [[i + len(full) for i in b] for b in best_fit(np.array([r[0][3] for r in rests], np.int64), size)]
        yield from _emit(bins, full + rests, 0)

    return run


def _next_round(size: int, round: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = [[tuple(m.values()) for m in ms] for batch in batches for ms in batch.column("members").to_pylist()]
        yield from _emit(best_fit(np.array([sum(m[3] for m in ms) for ms in members], np.int64), size), members, round)

    return run


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bins = settle(source.mapInArrow(_first_round(tokenizer, size, end), _BIN_DDL))
    parts, round = max(source.rdd.getNumPartitions(), width(docs.sparkSession)), 0
    done = bins.where(F.col("fill") >= size - SLACK)
    left = bins.where(F.col("fill") < size - SLACK)
    count = left.count()
    while count > 1:
        round += 1
        least = -(-count // ROUND_ITEMS)
        parts = max(least, -(-parts // FAN_IN))
        bins = settle(left.repartition(parts, F.xxhash64("bin", F.lit(round))).mapInArrow(_next_round(size, round), _BIN_DDL))
        done = done.unionByName(bins.where(F.col("fill") >= size - SLACK))
        left, before = bins.where(F.col("fill") < size - SLACK), count
        count = left.count()
        if parts == 1 or parts == least and count > 0.999 * before:
            break
    pieces = done.unionByName(left).select("bin", F.explode("members").alias("m"))
    return pieces.select(
        "m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), F.col("m.crc").alias("ids_crc32"),
        F.col("bin").alias("sequence_id"), F.col("m.offset").cast("long").alias("offset"))
