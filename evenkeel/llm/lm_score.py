"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The most frequent words are classes of their own; other words fall into
classes by their hashed ending, and there share the class by their smoothed training counts, with one place for all unknown words. The class
softmax adds the weights of hashed features of the history: the last word, the one before it (a skip feature) and both together (an n-gram). A word in a
history counts as itself if it is one of HISTORY frequent ones and as its class otherwise.

Training is distributed: every task starts from the classes' log shares, takes gradient steps over minibatches of its texts, and sends its change of
the weights; the changes, averaged by tokens up a tree of bounded groups, are the model. All training texts take part.

Counts: the texts of each task, written once, are parts of bounded size. Each part sends its distinct words with their training counts; totals come
back to the part (a window by word, over about one row a part, so no word is hot). Scoring brings a part's texts and totals together and works on numpy batches.
The driver holds the frequent words, the classes' totals and the weights, all of fixed size.

Defined results: a null or empty text is its end token alone; without training rows every word is unknown; rows with a null id are scored and never train;
repeated rows are counted and scored each; words are told apart by 64-bit hashes; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.text import CHUNK, LANES, Words, buffers, chunks, mix
from evenkeel.operators.runtime import settle

SINGLE = 48  # words that are classes of their own, the end token among them
SHAPES = 48  # classes of the others
HISTORY = 1024  # words that a history tells apart
PAIRS = 1 << 14  # hash buckets of word pairs
PART_BYTES = 32 << 20  # of texts, that one task scores together
BATCH = 8192  # tokens
RATE = 0.3  # of the gradient steps
MERGE = 64  # changes of weights that one task averages
ROWS = 512  # rows of weights in one message

CLASSES = SINGLE + SHAPES
IDS = HISTORY + SHAPES + 1  # of history words: frequent ones, classes, and the text's beginning
FEATURES = 1 + 2 * IDS + PAIRS
END = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class of every token, and the first token of each text; every text is closed by an end token."""
    data = _LOWER[data]
    words = Words(data, offsets)
    n, docs = len(words), len(offsets) - 1
    at = np.arange(n) + words.doc
    hashes, shapes = np.full(n + docs, END), np.zeros(n + docs, np.int32)
    hashes[at] = words.hashes()
    before = np.maximum(words.end - 2, words.start)
    ending = data[before].astype(np.uint64) << np.uint64(8) | data[words.end - 1]
    shapes[at] = mix(ending) % np.uint64(SHAPES)
    return hashes, shapes, np.append(0, np.cumsum(words.count + 1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of about PART_BYTES of each task's texts."""
    part, held = TaskContext.get().partitionId() << 20, 0
    for batch in batches:
        sizes = np.diff(buffers(batch.column("text"))[1])
        own = part + (held + np.cumsum(sizes) - sizes) // PART_BYTES
        held += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "part"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part the distinct words with their shapes and training counts."""
    held: dict[int, list] = {}

    def flush(part: int) -> pa.RecordBatch:
        h, s, n = (np.concatenate(x) for x in zip(*held.pop(part)))
        own, first, at = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([
            pa.array(own.view(np.int64)), pa.array(np.full(len(own), part)), pa.array(s[first]),
            pa.array(np.bincount(at, n, len(own)).astype(np.int64))], names=["word", "part", "shape", "n"])

    for batch in batches:
        part, use = batch.column("part").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
        for rows, data, offsets in chunks(batch, "text"):
            hashes, shapes, first = tokens(data, offsets)
            counts = np.diff(first)
            owner, teach = np.repeat(part[rows], counts), np.repeat(use[rows], counts)
            for p in np.unique(part[rows]).tolist():
                own = owner == p
                h, where, at = np.unique(hashes[own], return_index=True, return_inverse=True)
                held.setdefault(p, []).append((h, shapes[own][where], np.bincount(at, teach[own], len(h))))
                if sum(len(x[0]) for x in held[p]) > 1 << 20:
                    yield flush(p)
    for p in list(held):
        yield flush(p)


class Model:
    """What every task needs: sorted frequent words with their numbers, class shares, and weights."""

    def __init__(self, frequent: list[int], share: np.ndarray, weights: np.ndarray | None = None):
        words = np.array(frequent, np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.number = words[order], order.astype(np.int32)
        self.weights = weights
        if weights is None:
            self.weights = np.zeros((FEATURES, CLASSES), np.float32)
            self.weights[0] = np.log(share)

    def read(self, hashes: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Class of every token, and the rows of its history's features."""
        ids = np.full(len(hashes), -1, np.int32)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            ids = np.where(self.words[at] == hashes, self.number[at], -1)
        kind = np.where((ids >= 0) & (ids < SINGLE), ids, SINGLE + shapes)
        own = np.where(ids >= 0, ids, HISTORY + shapes)
        start = np.zeros(len(hashes), bool)
        start[first[:-1]] = True
        last = np.full(len(hashes), IDS - 1)
        last[1:] = np.where(start[1:], IDS - 1, own[:-1])
        far = np.full(len(hashes), IDS - 1)
        far[1:] = np.where(start[1:], IDS - 1, last[:-1])
        pair = (mix(last.astype(np.uint64) * np.uint64(IDS) + far.astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
        return kind, [1 + last, 1 + IDS + far, 1 + 2 * IDS + pair]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        total = self.weights[0] + self.weights[rows[0]]
        for r in rows[1:]:
            total += self.weights[r]
        return total

    def log_class(self, kind: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of every token's class."""
        out = np.empty(len(kind))
        first, same, _ = histories(rows)
        order = np.argsort(same, kind="stable")
        ends = np.searchsorted(same[order], np.arange(0, len(first) + BATCH, BATCH))
        for turn, low in enumerate(range(0, len(first), BATCH)):
            z = self.logits([r[first[low:low + BATCH]] for r in rows])
            z -= z.max(axis=1, keepdims=True)
            total = np.log(np.exp(z).sum(axis=1))
            at = order[ends[turn]:ends[turn + 1]]
            out[at] = z[same[at] - low, kind[at]] - total[same[at] - low]
        return out

    def learn(self, kind: np.ndarray, rows: list[np.ndarray], seen: np.ndarray) -> None:
        """One pass of gradient steps; a row's step falls with the tokens that it has seen."""
        for low in range(0, len(kind), BATCH):
            cut = slice(low, low + BATCH)
            first, same, times = histories([r[cut] for r in rows])
            own = [r[cut][first] for r in rows]
            z = self.logits(own)
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z *= (times / z.sum(axis=1))[:, None].astype(np.float32)
            np.subtract.at(z, (same, kind[cut]), np.float32(1))
            for i, r in enumerate(own):
                # histories come in the order of their last word; FEATURES < 2^16: a radix sort
                order = np.argsort(r.astype(np.uint16), kind="stable") if i else slice(None)
                sorted_rows = r[order]
                new = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
                which, count = sorted_rows[new], np.add.reduceat(times[order], new)
                seen[which] += count
                step = RATE * CLASSES ** 0.5 / np.sqrt(seen[which] * np.maximum(count, 1))
                self.weights[which] -= np.add.reduceat(z[order], new, axis=0) * step[:, None].astype(np.float32)


def histories(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct histories (the last two words): a token with each, the number of every token's, how many tokens have each."""
    _, first, same, times = np.unique(rows[0] * FEATURES + rows[1], return_index=True, return_inverse=True, return_counts=True)
    return first, same, times


def _taught(model):
    """The task's change of the weights in messages of ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = model.value
        own = Model([], np.ones(CLASSES), shared.weights.copy())
        own.words, own.number = shared.words, shared.number
        seen, total = np.zeros(FEATURES), 0
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                hashes, shapes, first = tokens(data, offsets)
                own.learn(*own.read(hashes, shapes, first), seen)
                total += len(hashes)
        if total:
            change = ((own.weights - shared.weights)).astype(np.float16)
            for low in range(0, FEATURES, ROWS):
                part = change[low:low + ROWS]
                if part.any():
                    yield _message(low, seen[low:low + ROWS], part)

    return run


def _message(low: int, seen: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([low], pa.int32()), pa.array([seen.astype("<f8").tobytes()], pa.binary()), pa.array([change.astype("<f2").tobytes()], pa.binary())], names=["low", "seen", "change"])


def _average(group):
    """Changes of the same rows, each row weighted by the tokens that touched it."""
    seen = [np.frombuffer(x.as_py(), "<f8") for x in group.column("seen")]
    change = [np.frombuffer(x.as_py(), "<f2").astype(np.float32).reshape(len(s), -1) for x, s in zip(group.column("change"), seen)]
    total = sum(seen)
    mean = sum(c * (s / np.maximum(total, 1))[:, None] for c, s in zip(change, seen))
    return pa.Table.from_batches([_message(group.column("low")[0].as_py(), total, mean)])


_MESSAGE = "low int, seen binary, change binary"


def fit(docs: DataFrame, model: Model, text: str) -> Model:
    """One distributed pass of gradient steps over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = settle(docs.select(F.col(text).alias("text")).mapInArrow(_taught(shared), _MESSAGE))
    most = found.groupBy("low").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // MERGE)
        found = settle(found.withColumn("g", F.pmod(F.xxhash64("seen", "change"), F.lit(groups))).groupBy("low", "g").applyInArrow(_average, _MESSAGE))
        most = found.groupBy("low").count().agg(F.max("count")).first()[0] if groups > 1 else 1
    weights = model.weights.copy()
    for r in found.collect():  # FEATURES rows in all
        change = np.frombuffer(r["change"], "<f2").astype(np.float32).reshape(-1, CLASSES)
        weights[r["low"]:r["low"] + len(change)] += change
    out = Model([], np.ones(CLASSES), weights)
    out.words, out.number = model.words, model.number
    return out


def _scored(model, total: int, distinct: int, sums: np.ndarray, types: np.ndarray):
    """Score the texts of one part with the training counts of its words."""

    def run(key, docs, counts):
        own = model.value
        words = counts.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, totals = words[order], counts.column("total").to_numpy()[order]
        base_sum = np.log10(total + 0.5 * (distinct + 1))
        class_sum = np.log10(np.append(np.ones(SINGLE), sums + 0.5 * (types + 1)))
        out = []
        for batch in docs.combine_chunks().to_batches():
            for rows, data, offsets in chunks(batch, "text"):
                hashes, shapes, first = tokens(data, offsets)
                kind, features = own.read(hashes, shapes, first)
                c = totals[np.searchsorted(words, hashes)]
                log = np.log10(c + 0.5)
                within = np.where(kind < SINGLE, 0.0, log - class_sum[kind])
                sizes = np.diff(first)
                add = lambda x: np.add.reduceat(x, first[:-1])
                n = rows.stop - rows.start
                out.append(pa.table({
                    "id": batch.column("id")[rows], "train": batch.column("train")[rows], "n_tokens": pa.array(sizes, pa.int64()),
                    "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(n, total), pa.int64()),
                    "base_score": pa.array(add(log) - sizes * base_sum), "score": pa.array(add(own.log_class(kind, features) / np.log(10) + within))}))
        return pa.concat_tables(out) if out else _EMPTY.empty_table()

    return run


_EMPTY = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, teaches: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows for which ``teaches`` holds."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(id).cast("long").alias("id"), whole.alias("text"), F.coalesce(teaches & F.col(id).isNotNull(), F.lit(False)).alias("train"))
    dealt = settle(source.mapInArrow(_parts, "id long, text string, train boolean, part long"))
    sent = dealt.mapInArrow(_counted, "word long, part long, shape int, n long")
    # a part's texts may lie in several tasks, so a word comes at most once from each of them
    totals = settle(sent.withColumn("total", F.sum("n").over(Window.partitionBy("word"))).withColumn(
        "first", F.row_number().over(Window.partitionBy("word").orderBy("part")) == 1).select("word", "part", "shape", "total", "first"))
    words = totals.where("first AND total > 0")
    frequent = [r["word"] for r in words.orderBy(F.desc("total"), "word").limit(HISTORY).collect()]
    end = int(np.array([END]).view(np.int64)[0])
    if end in frequent:
        frequent.remove(end)
        frequent.insert(0, end)
    single = frequent[:SINGLE]
    own = F.col("word").isin(single) if single else F.lit(False)
    by_class = words.groupBy(F.when(own, F.col("word")).alias("word"), F.when(own, F.lit(-1)).otherwise(F.col("shape")).alias("shape")).agg(
        F.sum("total").alias("n"), F.count("*").alias("v")).collect()
    sums, types, alone = np.zeros(SHAPES), np.zeros(SHAPES), {}
    for r in by_class:
        if r["word"] is None:
            sums[r["shape"]], types[r["shape"]] = r["n"], r["v"]
        else:
            alone[r["word"]] = r["n"]
    total, distinct = int(sums.sum() + sum(alone.values())), int(types.sum() + len(alone))
    share = np.append([alone.get(w, 0) for w in single] + [0] * (SINGLE - len(single)), sums) + 0.5
    # a class without a word has no share: its weight stays too low to matter
    share[len(single):SINGLE] = 1e-30
    model = Model(frequent, share / share.sum())
    if total:
        model = fit(dealt.where("train"), model, "text")
    shared = spark.sparkContext.broadcast(model)
    lookup = totals.select("part", "word", "total")
    return dealt.groupBy("part").cogroup(lookup.groupBy("part")).applyInArrow(
        _scored(shared, total, distinct, sums, types), "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
