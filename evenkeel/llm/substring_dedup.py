"""Substring dedup: seed and extend over winnowed anchors.

Seeds: of every window of ``window`` words the smallest hash among its runs of ``SEED`` words is
its anchor (winnowing), so equal windows have equal anchors, and neighbouring windows mostly
share one. The windows of one anchor occurrence, with all their words, are its reach: the anchor
extended both ways as far as it stays the anchor.

Join: occurrences meet by anchor hash. The one in the smallest document stands for the anchor;
occurrences with the same reach repeat it in full. Where the reach differs (at the ends of a
passage or beside an edit) the occurrence and its representative are extended word by word: their single
windows are compared by 128-bit hashes. Work per anchor is linear in its occurrences, never pairs.
Windows found to repeat are merged into maximal repeats of at least ``window`` words.

Hot anchors (a passage in a third of all documents) are known from a bounded sample of texts; their windows
are their own keys, so the differing surroundings of a common passage spread out, and equal ones
are combined before the shuffle. The sample only chooses the route, never the result.

Defined results: a null or empty text has no words and no repeats; texts shorter than ``window`` words keep all
words; a repeat within one document alone stays; rows with a null id neither remove nor lose words;
rows that repeat an id are one document where windows are compared, whatever their texts, and
each loses its own repeated words; other columns are carried by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.text import LANES, Words, buffers, chunks, mix, table, texts
from evenkeel.operators.runtime import settle, width

WINDOW = 13  # words
SEED = 4  # words of an anchor; anchors are about 2 / (WINDOW - SEED + 2) of all positions
SAMPLE_DOCS = 4096  # texts looked at for hot anchors
HOT_SHARE = 0.01  # an anchor in this share of them is hot
HOT_MOST = 16_384  # entries of the broadcast list of hot anchors, at most

_ROWS = pa.schema([("key", pa.int64()), ("reach", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])
_MARKS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("repeats", pa.bool_())])
_WINDOWS = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _reaches(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, reach hash, text number, first window, number of windows of every anchor occurrence, and the first word."""
    grams = window - SEED + 1
    h = words.hashes(0)
    at = np.arange(len(h) - window + 1)
    at = at[words.doc[at] == words.doc[at + window - 1]] if len(at) else at
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    seeds = LANES[0].spans(h, (i := np.arange(len(h) - SEED + 1)), i + SEED)
    anchor = at + np.lib.stride_tricks.sliding_window_view(seeds, grams)[at].argmin(axis=1)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (words.doc[at[1:]] != words.doc[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    begin = at[first]
    reach = mix(LANES[1].spans(words.hashes(1), begin, begin + n + window - 1) + (anchor[first] - begin).astype(np.uint64))
    return seeds[anchor[first]], reach, words.doc[begin], words.pos[begin], n, begin


def _occurrences(window: int, hot, distinct_only: bool = False):
    """Rows (key, reach, doc, tag, pos, n); a negative n marks windows already known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value if hot is not None else np.zeros(0, np.uint64)
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            for rows, data, offsets in chunks(batch, "text"):
                words = Words(data, offsets)
                key, reach, doc, pos, n, begin = _reaches(words, window)
                if not len(key):
                    continue
                doc, tag = ids[rows][doc], tags[rows][doc]
                if distinct_only:
                    pair = np.unique(np.stack([key.view(np.int64), doc]), axis=1)
                    nothing = np.zeros(pair.shape[1])
                    yield table(_ROWS, pair[0], pair[0], pair[1], nothing, nothing, nothing)
                    continue
                if len(often) and (own := np.isin(key, often)).any():
                    one, at = np.repeat(np.flatnonzero(own), n[own]), _steps(n[own])
                    single = begin[one] + at
                    high, low = (LANES[i].spans(words.hashes(i), single, single + window) for i in (0, 1))
                    key, reach, doc, tag, pos, n = (
                        np.concatenate([x[~own], y]) for x, y in
                        zip((key, reach, doc, tag, pos, n), (high, low, doc[one], tag[one], pos[one] + at, np.ones(len(at), int))))
                order = np.lexsort((pos, doc, reach, key))
                key, reach, doc, tag, pos, n = (x[order] for x in (key, reach, doc, tag, pos, n))
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (reach[1:] != reach[:-1])
                least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                again = doc > least
                key = np.where(again, mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)), key)
                yield table(_ROWS, key.view(np.int64), reach.view(np.int64), doc, tag, pos, np.where(again, -n, n))

    return run


def _steps(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key, doc, pos: compare every occurrence with the first of its anchor."""
    last = None  # key, reach, doc, tag, pos, n of the open anchor's first row, and whether it went out
    for batch in batches:
        key, reach, doc, tag, pos, n = (batch.column(i).to_numpy() for i in range(6))
        if not len(key):
            continue
        known = n < 0
        yield table(_MARKS, doc[known], tag[known], pos[known], -n[known], np.ones(known.sum(), bool))
        key, reach, doc, tag, pos, n = (x[~known] for x in (key, reach, doc, tag, pos, n))
        if not len(key):
            continue
        sent = False
        if last is not None and last[0] == key[0]:
            key, reach, doc, tag, pos, n = (np.append(x, y) for x, y in zip(last[:6], (key, reach, doc, tag, pos, n)))
            sent = last[6]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        lead = first[np.cumsum(new) - 1]
        same = reach == reach[lead]
        repeats = same & (doc > doc[lead])
        lead_out = np.zeros(len(key), bool)
        lead_out[lead[~same]] = True
        last = (*(x[first[-1]] for x in (key, reach, doc, tag, pos, n)), bool(lead_out[first[-1]] or (sent and first[-1] == 0)))
        if sent:
            lead_out[0] = False
        out = repeats | ~same | lead_out
        yield table(_MARKS, doc[out], tag[out], pos[out], n[out], repeats[out])


def _single_windows(window: int):
    """The windows of the listed occurrences of each text, hashed on both lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            spans = batch.column("spans")
            spans, at = spans.flatten(), np.append(0, np.cumsum([len(x) if x.is_valid else 0 for x in spans]))
            pos, n = (spans.field(i).to_numpy() for i in (0, 1))
            for rows, data, offsets in chunks(batch, "text"):
                low, high = at[rows.start], at[rows.stop]
                if low == high:
                    continue
                words = Words(data, offsets)
                doc = np.repeat(np.arange(rows.stop - rows.start), np.diff(at[rows.start:rows.stop + 1]))
                one = np.repeat(np.arange(low, high), n[low:high])
                where = pos[one] + _steps(n[low:high])
                begin = words.first[doc[one - low]] + where
                yield table(_WINDOWS, *(LANES[i].spans(words.hashes(i), begin, begin + window).view(np.int64) for i in (0, 1)), ids[rows][doc[one - low]], tags[rows][doc[one - low]], where)

    return run


def _source(docs: DataFrame, id: str, text: str, *columns) -> DataFrame:
    """(doc, tag, text, columns): the tag tells texts of one id apart and is 0 for ids with one text only."""
    source = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), *columns)
    mark = F.xxhash64("text")
    reused = source.where("doc IS NOT NULL").groupBy("doc").agg(F.min(mark).alias("_low"), F.max(mark).alias("_high")).where("_low <> _high").select("doc", F.lit(True).alias("_reused"))
    tag = F.when(F.col("_reused"), mark).otherwise(F.lit(0).cast("long")).alias("tag")
    return source.join(settle(reused), "doc", "left").select("doc", tag, "text", *[c for c in source.columns if c not in ("doc", "text")])


def _repeats(source: DataFrame, window: int) -> DataFrame:
    """(doc, tag, spans): for each text with any, the maximal runs of repeated windows as array<struct<pos, n>>; ``n`` counts
    windows, so a span covers words pos .. pos + n + window - 2."""
    spark, parts = source.sparkSession, width(source.sparkSession)
    known = source.where("doc IS NOT NULL")
    total = known.count()
    sampled = known.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)
    often = sampled.mapInArrow(_occurrences(window, None, distinct_only=True), _ddl(_ROWS)).groupBy("key").agg(F.countDistinct("doc").alias("docs"))
    least = max(8, int(HOT_SHARE * min(total, SAMPLE_DOCS)))
    hot = np.array([r.key for r in often.where(F.col("docs") >= least).orderBy(F.desc("docs"), "key").limit(HOT_MOST).collect()], np.int64).view(np.uint64)
    hot = spark.sparkContext.broadcast(hot)
    found = known.mapInArrow(_occurrences(window, hot), _ddl(_ROWS)).repartition(parts, "key").sortWithinPartitions("key", "doc", "pos")
    marks = settle(found.mapInArrow(_classify, _ddl(_MARKS)))
    listed = marks.where("NOT repeats").groupBy("doc", "tag").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
    single = source.join(listed, ["doc", "tag"], "left").select("doc", "tag", "text", "spans").where("spans IS NOT NULL")
    windows = settle(single.mapInArrow(_single_windows(window), _ddl(_WINDOWS)))
    first = windows.groupBy("high", "low").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    later = windows.join(first, ["high", "low"]).where("doc > first").select("doc", "tag", "pos", F.lit(1).alias("n"))
    every = marks.where("repeats").select("doc", "tag", "pos", "n").unionAll(later)
    return every.groupBy("doc", "tag").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))


def _removed(count: int, spans, window: int) -> np.ndarray:
    """Which of a text's words lie in a repeat."""
    edges = np.zeros(count + 1, np.int64)
    pos, n = spans.field(0).to_numpy(), spans.field(1).to_numpy()
    np.add.at(edges, np.minimum(pos, count), 1)
    np.add.at(edges, np.minimum(pos + n + window - 1, count), -1)
    return np.cumsum(edges[:-1]) > 0


def _kept(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            n_words, n_removed, kept = [], [], []
            for i, raw in enumerate(texts(batch, "text")):
                left = own = raw.split()
                if spans[i].is_valid:
                    drop = _removed(len(own), spans[i].values, window).tolist()
                    left = [w for w, d in zip(own, drop) if not d]
                n_words.append(len(own))
                n_removed.append(len(own) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest().encode() if digest else b" ".join(left) if len(left) < len(own) else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "n_removed", "kept"])

    return run


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(row, n_words, n_removed, kept): every row of ``docs`` as a struct (with ``digest`` without its text), and the words that stay,
    joined by one space, or with ``digest`` their SHA-256. Without ``digest``, a text that loses nothing stays as it is."""
    row = F.struct(*[F.col(c) for c in docs.columns if not (digest and c == text)])
    source = _source(docs, id, text, row.alias("row"))
    found = _repeats(source.select("doc", "tag", "text"), window)
    joined = source.join(found, ["doc", "tag"], "left").select("row", "text", "spans")
    out = T.StructType([joined.schema["row"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(_kept(window, digest), out)
