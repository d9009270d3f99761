"""Importance resampling towards a target: documents are drawn by how much likelier their hashed n-grams are in the target than in the corpus.

Features are runs of 1 to ``n`` consecutive words, joined by one space; a feature's bucket is its CRC-32 modulo ``buckets``. Counts per bucket of both sides give
a gain per bucket; a document's weight is the mean gain of its features; seeded Gumbel noise by id turns the highest scores into a draw
without replacement. Counts and weights come from every feature of every text; both tables have at most ``buckets`` rows.

CRC-32 by position table: the checksum is linear over XOR but for a constant of the length, so a byte adds a value that depends on itself and its distance from the
span's end alone. These values are looked up for all bytes of many spans together and XORed by ``bitwise_xor.reduceat`` over the
spans; the length's constant completes them. Spans longer than the table are cut into blocks counted from their ends, and a block's value is moved past the blocks behind it
by tables of 2^i blocks of zeros.

Ranks use sampled ranges of (score, id) and an offset table, so no task orders the whole draw.

Defined results: a null text has no words; a text without features weighs 0; repeated rows are counted, scored and ranked each; documents below ``least`` words
count as corpus but are never drawn; a null id's noise is that of the empty text and it comes after its ties; an empty table gives no rows and draws none; without target texts all
gains compare with an empty target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import chunks
from evenkeel.operators.runtime import settle
from evenkeel.operators.scan import range_buckets, running_sums

BUCKETS = 10_000
CHUNK = 1 << 18  # bytes of text whose spans are looked up together; one longer text makes a chunk of its own
_U = np.uint32

_WORD = np.zeros(256, bool)  # digits, letters and all bytes beyond ASCII
_WORD[0x80:] = _WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class SpanCrc:
    """CRC-32 (the polynomial of zlib) of byte spans, by position table."""

    def __init__(self, block: int = 64):
        self.block = block
        one = np.arange(256, dtype=_U)
        for _ in range(8):
            one = (one >> _U(1)) ^ (_U(0xEDB88320) * (one & _U(1)))
        self.one = one
        at = [one]
        for _ in range(block - 1):
            at.append(self._zero(at[-1]))
        self.at = np.concatenate(at)  # of (distance from the end, byte)
        ends = [np.array([0xFFFFFFFF], _U)]
        for _ in range(block):
            ends.append(self._zero(ends[-1]))
        self.length = np.concatenate(ends)  # the register after so many zeros
        step = np.arange(256, dtype=_U)[None, :] << (_U(8) * np.arange(4, dtype=_U))[:, None]
        for _ in range(block):
            step = self._zero(step)
        self.steps = [step]  # of 2^i blocks of zeros, by byte of the register

    def _zero(self, register: np.ndarray) -> np.ndarray:
        return (register >> _U(8)) ^ self.one[register & _U(255)]

    @staticmethod
    def _apply(step: np.ndarray, x: np.ndarray) -> np.ndarray:
        return step[0][x & _U(255)] ^ step[1][(x >> _U(8)) & _U(255)] ^ step[2][(x >> _U(16)) & _U(255)] ^ step[3][x >> _U(24)]

    def past(self, x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Registers after so many more blocks of zeros."""
        x = x.copy()
        for i in range(int(blocks.max(initial=0)).bit_length()):
            if i == len(self.steps):
                self.steps.append(self._apply(self.steps[-1], self.steps[-1]))
            odd = np.flatnonzero(blocks >> i & 1)
            x[odd] = self._apply(self.steps[i], x[odd])
        return x

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The checksum of each span [start, end) of ``data``; spans may overlap and none is empty."""
        if not len(starts):
            return np.zeros(0, _U)
        size = ends - starts
        low, high = starts, ends
        folded = int(size.max()) > self.block
        if folded:
            count = -(-size // self.block)
            first = np.cumsum(count) - count
            behind = np.repeat(first + count - 1, count) - np.arange(int(count.sum()))
            high = np.repeat(ends, count) - behind * self.block
            low = np.maximum(np.repeat(starts, count), high - self.block)
        length = high - low
        place = np.cumsum(length) - length
        byte = np.arange(int(length.sum())) + np.repeat(low - place, length)
        back = np.repeat(high - 1, length) - byte
        found = np.bitwise_xor.reduceat(self.at[(back << 8) | data[byte]], place)
        if folded:
            found = np.bitwise_xor.reduceat(self.past(found, behind), first)
        return found ^ self.past(self.length[size % self.block], size // self.block) ^ _U(0xFFFFFFFF)


CRC = SpanCrc()


def features(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, features of each text, and the features' buckets in the texts' order."""
    texts = len(offsets) - 1
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    here = inside[1:-1]
    start = np.flatnonzero(here & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(here & (~inside[2:] | edge[1:])) + 1
    words = np.diff(np.searchsorted(start, offsets))
    doc = np.repeat(np.arange(texts), words)
    size = end - start
    at = np.cumsum(size + 1) - size - 1  # words side by side, one space behind each
    joined = np.full(int(at[-1] + size[-1] + 1) if len(at) else 0, 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[here]
    found, owner = [], []
    for run in range(1, n + 1):
        ok = np.flatnonzero(doc[run - 1:] == doc[:len(doc) - run + 1]) if len(doc) >= run else np.zeros(0, np.int64)
        found.append(CRC(joined, at[ok], at[ok + run - 1] + size[ok + run - 1]) % _U(buckets))
        owner.append(doc[ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return words, np.bincount(owner, minlength=texts), np.concatenate(found)[order].astype(np.int64)


def bucket_counts(rows: DataFrame, text: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) over all features of all texts; a task sends one row a bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch, "text", CHUNK):
                total += np.bincount(features(data, offsets, n, buckets)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "count"])

    own = rows.select(F.col(text).cast("string").alias("text"))
    return own.mapInArrow(counted, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source: ``buckets`` numbers on the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for bucket, count in counts.collect():  # one row a bucket at most
            into[bucket] = count
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", n: int = 2) -> DataFrame:
    """(id, n_words, n_features, weight) for every row: the weight is the floored mean gain of the features, 0 without any."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK):
                words, count, own = features(data, offsets, n, len(gain))
                run = np.concatenate([[0], np.cumsum(gain[own])])
                last = np.cumsum(count)
                weight = np.where(count > 0, (run[last] - run[last - count]) // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(part.start, part.stop - part.start), *(pa.array(x, pa.int64()) for x in (words, count, weight))], names=["id", "n_words", "n_features", "weight"])

    own = rows.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(weighed, f"id {dict(own.dtypes)['id']}, n_words long, n_features long, weight long")


def noise(id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(rows: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, id: str = "doc_id", text: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row: ``rank`` is 1, 2, 3, ... over the floor(percent / 100) of the documents with ``least`` words or more that score highest, null for
    the rest; ties go to the smaller id."""
    gain = gains(bucket_counts(rows, text, n, buckets), bucket_counts(target, text, n, buckets), buckets)
    scored = settle(weigh(rows, gain, id, text, n).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = scored.where(F.col("n_words") >= least).select("*", (-F.col("score")).alias("_down"), F.col("id").isNull().alias("_last"))
    order = ["_down", "_last", "id", "n_features", "weight", "n_words"]
    placed = running_sums(range_buckets(able, order), [], order, F.col("_range"), {"place": F.lit(1).cast("long")})
    drawn = F.floor(F.col("place_total") * percent / 100)
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long"))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionAll(rest)
