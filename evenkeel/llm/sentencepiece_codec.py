"""SentencePiece models on the tokenizers library: encode, decode and verify parity.

The model file is parsed as a protobuf; its normaliser, metaspace marker, scores and byte fallback are rebuilt as a tokenizers pipeline. A
unigram model keeps its scores; a BPE model's scores order its merges. Batches of texts are encoded by several threads.
Where no piece reaches over a space or a line end (checked on the model), a text's ids are those of its units in turn, a unit being a
space or line end and the word after it; a task then encodes each distinct unit once. Other models encode whole texts.
``verify`` compares the ids of every unit or text with the sentencepiece library itself.

Defined results: a null text is encoded as an empty one, which has no ids; decoding ids gives the normalised text; repeated rows and other
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import CHUNK, chunks

MARK = "▁"
THREADS = 2  # of one task
CACHE_UNITS = 300_000  # units whose ids a task remembers
#: fixed values: types of pieces, and of models
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of one protobuf message: integers, floats and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield tag >> 3, data[at - size:at]
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            at += size
            yield tag >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at - size:at])[0]
        else:
            raise ValueError(f"wire type {kind}")


def parse(model: bytes) -> dict:
    """Pieces as (text, score, type), and what the trainer and normaliser parts say, with the format's defaults."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return {
        "pieces": pieces, "kind": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0)), "suffix": bool(trainer.get(24, 0)),
        "charsmap": normaliser.get(2, b""), "prefix": bool(normaliser.get(3, 1)), "squeeze": bool(normaliser.get(4, 1)), "escape": bool(normaliser.get(5, 1))}


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply: the best scored piece first, each from all pairs of pieces that make it."""
    own = {text for text, _, kind in pieces if kind in (NORMAL, USER)}
    ranked = sorted(((-score, at, text) for at, (text, score, kind) in enumerate(pieces) if kind in (NORMAL, USER) and len(text) > 1))
    return [(text[:i], text[i:]) for _, _, text in ranked for i in range(1, len(text)) if text[:i] in own and text[i:] in own]


def build(model: bytes, unit: bool = False):
    """A tokenizers pipeline with the model's ids; for a ``unit`` it adds no marker in front."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = parse(model)
    if spec["kind"] not in (UNIGRAM, BPE) or spec["suffix"] or not spec["escape"]:
        raise ValueError("only unigram and BPE models with a leading marker are supported")
    pieces = spec["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    # control pieces are never found in texts: a noncharacter keeps their names out of the search
    names = [("￿" + text if kind in (CONTROL, UNKNOWN, UNUSED) else text) for text, _, kind in pieces]
    if spec["kind"] == UNIGRAM:
        core = models.Unigram([(n, p[1]) for n, p in zip(names, pieces)], unk_id=unknown, byte_fallback=spec["byte_fallback"])
    else:
        core = models.BPE(
            vocab={n: i for i, n in enumerate(names)}, merges=_merges(pieces), unk_token=None if unknown is None else names[unknown],
            fuse_unk=True, byte_fallback=spec["byte_fallback"])
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if spec["prefix"] and not unit else []
    steps += [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in text.lstrip(MARK) for text, _, kind in pieces if kind in (NORMAL, USER)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    users = [AddedToken(text, normalized=False, special=False) for text, _, kind in pieces if kind == USER]
    if users:
        tokenizer.add_tokens(users)
    tokenizer.decoder = decoders.Sequence([
        decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec["prefix"] and not unit else [])])
    return tokenizer


def cuttable(spec: dict) -> bool:
    """May texts be cut into units?"""
    own = [text for text, _, kind in spec["pieces"] if kind in (NORMAL, USER)]
    return (spec["kind"] == BPE and spec["prefix"] and not spec["charsmap"] and not spec["squeeze"]
            and not any(kind == USER for _, _, kind in spec["pieces"]) and not any("\n" in t or MARK in t.lstrip(MARK) for t in own))


class Codec:
    """One task's tokenizer, its known units, and those that failed a comparison.

    A unit is a word with the marker in front, or a line end with the word after it; in both cases its first id shows where it begins, so
    new units are encoded many at a time. Texts with runs of spaces or with the marker itself are encoded whole.
    """

    def __init__(self, path: str, threads: int, verify: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as file:
            model = file.read()
        spec = parse(model)
        self.whole, self.threads, self.other = build(model), threads, None
        self.joined = build(model, unit=True) if cuttable(spec) else None
        line = f"<0x{ord('\n'):02X}>"
        self.first = np.array([t.startswith(MARK) or t == line for t, _, _ in spec["pieces"]])
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.lossy: set[str] = set()
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=path)

    def _check(self, texts: list[str], ids: list[list[int]]) -> Iterator[tuple[bool, bool]]:
        """Do the ids decode to each text, and are they the other library's?"""
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        theirs = self.other.encode(texts, num_threads=self.threads)
        for text, mine, decoded, other in zip(texts, ids, back, theirs):
            yield decoded == text.replace(MARK, " "), mine == other

    def _learn(self, units: list[str]) -> None:
        runs = [units[i:i + 512] for i in range(0, len(units), 512)]
        lines = ["".join(u if u[0] == "\n" else " " + u for u in run) for run in runs]
        found = [e.ids for e in self.joined.encode_batch_fast(lines, add_special_tokens=False)]
        right = self._check([x.removeprefix(" ") if x[0] == " " else x for x in lines], found) if self.other else [(True, True)] * len(runs)
        for run, ids, (back, same) in zip(runs, found, right):
            flat = np.array(ids, "<u4")
            at = np.append(np.flatnonzero(self.first[flat]), len(flat))
            if len(at) != len(run) + 1 or not (back and same or run[0][0] == "\n"):
                self._one_by_one(run)
                continue
            raw, cuts = flat.tobytes(), (4 * at).tolist()
            self.known.update(zip(run, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            if run[0][0] == "\n" and not (back and same):
                self._one_by_one(run)

    def _one_by_one(self, units: list[str]) -> None:
        ids = [e.ids for e in self.joined.encode_batch([u if u[0] == "\n" else " " + u for u in units], add_special_tokens=False)]
        self.known.update((u, np.array(x, "<u4").tobytes()) for u, x in zip(units, ids))
        if self.other is not None:
            mark = self.whole.token_to_id(MARK)
            full = [[mark, *x] if u[0] == "\n" else x for u, x in zip(units, ids)]  # the other library begins with a marker always
            for unit, (back, same) in zip(units, self._check(units, full)):
                self.lossy.update([] if back else [unit])
                self.unlike.update([] if same else [unit])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        """Ids as little-endian 32-bit integers, whether they decode to the text (a marker counts as a space), and whether the other library agrees."""
        parts: list[list[str] | None] = []
        for text in texts:
            cut = text.replace("\n", " \n")
            plain = self.joined and text and "  " not in cut and cut[0] != " " and cut[-1] != " " and MARK not in text
            parts.append(cut.split(" ") if plain else None)
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        if new := set().union(*filter(None, parts)) - self.known.keys():
            self._learn(sorted(new, reverse=True))  # a line end sorts low, so runs begin with a word where there is one
        rest = [t for t, own in zip(texts, parts) if own is None]
        ids = [e.ids for run in _batches(rest) for e in self.whole.encode_batch_fast(run, add_special_tokens=False)]
        others = iter(zip(ids, self._check(rest, ids) if self.other else [(True, True)] * len(ids)))
        for own in parts:
            if own is None:
                x, (back, same) = next(others)
                yield np.array(x, "<u4").tobytes(), back, same
            else:
                yield b"".join(map(self.known.__getitem__, own)), self.lossy.isdisjoint(own) if self.lossy else True, self.unlike.isdisjoint(own) if self.unlike else True


@cache
def _loaded(path: str, threads: int, verify: bool = False) -> Codec:
    return Codec(path, threads, verify)


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]


def _batches(texts: list[str], size: int = CHUNK // 4) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters: the library's results are far larger than the texts."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def _encode(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _loaded(path, threads)
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x, _, _ in codec.encode(_texts(data, offsets))]
                yield pa.RecordBatch.from_arrays([batch.column("row")[rows], pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])

    return run


def _strings(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            tokenizer = build(file.read())
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tokenizer.decode_batch(ids, skip_special_tokens=False), pa.string())], names=["row", "text"])

    return run


def encode(docs: DataFrame, model: str, text: str = "text", threads: int = THREADS) -> DataFrame:
    """(row, ids): every row as a struct, and its text's ids."""
    source = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_encode(model, threads), f"row {source.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """(row, text): every row as a struct, and the text that its ids stand for."""
    source = rows.select(F.struct(*rows.columns).alias("row"), F.col(ids).alias("ids"))
    return source.mapInArrow(_strings(model), f"row {source.schema['row'].dataType.simpleString()}, text string")


def _digest(path: str, threads: int, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _loaded(path, threads, verify)
        for batch in batches:
            for rows, data, offsets in chunks(batch, "text"):
                ids, back, same = zip(*codec.encode(_texts(data, offsets)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("row")[rows], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64()),
                    *[pa.array(x if verify else [None] * len(x), pa.bool_()) for x in (back, same)]],
                    names=["row", "n_tokens", "ids_crc32", "round_trip", "parity"])

    return run


def digest(docs: DataFrame, model: str, text: str = "text", threads: int = THREADS, verify: bool = True) -> DataFrame:
    """(row, n_tokens, ids_crc32, round_trip, parity) in one pass: texts are encoded and, with ``verify``, decoded again and compared with the
    sentencepiece library; ``row`` leaves the text out."""
    row = F.struct(*[F.col(c) for c in docs.columns if c != text])
    source = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(
        _digest(model, threads, verify), f"row {source.schema['row'].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
