"""Toxicity by a gapped-subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings sums, over common subsequences of three characters that span at most SPAN, a decay for every gap, so insults match with
inserted characters and with other endings; it is normalised. A sentence is read twice: by its words, with marks at both ends, and by windows of its
characters (WINDOWS long, from every character on, a space for white space), so insults that are spelled out, cut by spaces, glued into long runs or made of
two words are seen too. A sentence is as toxic as its worst word or window, a text as its worst sentence; windows may also cross the end of a sentence.

Training: a bounded sample of labelled texts (TRAIN_DOCS of each class) gives its distinct sentences to the driver, TRAIN_BYTES in
all: where a class has more, every text stays and those above a common share keep sentences drawn by hash. A toxic text's witness is
the word whose character runs, or the pair of neighbouring words that, most set toxic texts apart; words and windows of clean texts are negative. Witnesses
are also put spelled out, cut, stretched and glued into windows of clean sentences, and so are as many clean words, as negatives. Landmarks are drawn from both
sides; a squared-hinge SVM is fitted on the landmark features, witnesses are chosen anew and the worst clean words and windows added, and so on. A logistic
curve over the texts' scores gives probabilities. Because the features are linear in the subsequences, the machine folds into one weight per (hashed)
subsequence: scoring needs that table, 4 MB, alone; it scores each distinct word of a task once and all windows by running sums.

Defined results: null, empty and wordless texts score 0; without toxic (or clean) training rows every text scores the smoothed share of toxic ones;
a class whose labelled texts hold no word is an error; labels that are null are left out, a document with several is toxic if one says so; repeated rows are scored each; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import CHUNK, texts
from evenkeel.operators.runtime import settle

SPAN, DECAY = 7, 0.5  # two inserted characters a letter
WINDOWS = (12, 24)
HASH_BITS = 20
TRAIN_DOCS = 1500  # of each class, at most
TRAIN_BYTES = 16 << 20  # of their distinct sentences, half for each class
LANDMARKS = 640
ROUNDS = 3
RARE, OFTEN = 5, 100  # weight of a disguised or rare witness; a clean word weighs as its texts, up to the second
CALM, UNSURE = 0.99, 0.1  # this share of clean texts has no window of more than this probability
LEAST_TELLING, TELLING = 5.0, 0.3  # a first witness tells so much, and this share of what its text's best one does
COST = 1.0
CACHE_WORDS = 200_000
EDGES = ".,;:!?\"'()[]{}<>«»¿¡-_*#/|"

SENTENCE = 512  # characters; longer ones are cut in training, at a space or with an overlap of the longest window
SLICE = 1 << 15  # characters whose windows are scored together

_PATTERNS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]
_A, _B, _C, _M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_SHIFT = np.uint64(64 - HASH_BITS)
_ENDS = re.compile(rb"(?<=[.!?])[ \t\r\f\v]+|\s*\n\s*")


def clean(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGES)


def mark(word: str) -> str:
    return f"\x02{word}\x03"


def spaced(words: list[bytes]) -> str:
    """A text's characters with one space for white space."""
    return b" ".join(words).decode("utf-8", "replace").lower()


def sentences(raw: bytes) -> list[str]:
    """The distinct sentences of a text."""
    found: dict[str, None] = {}
    for part in _ENDS.split(raw):
        text = spaced(part.split())
        while len(text) > SENTENCE:
            cut = text.rfind(" ", SENTENCE // 2, SENTENCE)
            found[text[:cut if cut > 0 else SENTENCE]] = None
            text = text[cut + 1 if cut > 0 else SENTENCE - max(WINDOWS):]
        if text:
            found[text] = None
    return list(found)


def _chars(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _hashed(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Table rows of three characters, given multiplied by _A, _B and _C."""
    out = x ^ y
    out ^= z
    out *= _M
    out >>= _SHIFT
    return out.view(np.int64)


def subsequences(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: numbers of the units, their hashed subsequences (rows), and the normalised weights (one row for all)."""
    by_length: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_length.setdefault(len(u), []).append(i)
    for length, rows in by_length.items():
        if length < 3:  # nothing but the marks
            continue
        step = max(1, 100_000 // length)
        for low in range(0, len(rows), step):
            some = rows[low:low + step]
            chars = _chars("".join([units[i] for i in some])).reshape(len(some), length)
            x, y, z = chars * _A, chars * _B, chars * _C
            codes, weights = [], []
            for a, b in _PATTERNS:
                if (n := length - b) > 0:
                    codes.append(_hashed(x[:, :n], y[:, a:a + n], z[:, b:b + n]))
                    weights += [DECAY ** (b - 2)] * n
            weights = np.array(weights)
            yield np.array(some), np.concatenate(codes, axis=1), weights / math.sqrt(float(weights @ weights))


def scores(units: list[str], table: np.ndarray) -> np.ndarray:
    """The machine's decision on each word (with its marks) or window."""
    out = np.zeros(len(units))
    for rows, codes, weights in subsequences(units):
        out[rows] = table[codes] @ weights
    return out


def _slide(chars: np.ndarray, table: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """The decision on the worse of the windows that begin at each character but the last max(WINDOWS)."""
    longest = max(WINDOWS)
    out = np.empty(len(chars) - longest)
    for low in range(0, len(out), SLICE):
        part = chars[low:low + SLICE + longest]
        x, y, z, m = part * _A, part * _B, part * _C, len(part) - longest
        totals = np.zeros((len(lengths), m))
        for b in range(2, SPAN):
            n = len(part) - b
            here = table.take(_hashed(x[:n], y[1:n + 1], z[b:]))
            for a in range(2, b):
                here += table.take(_hashed(x[:n], y[a:a + n], z[b:]))
            run = np.zeros(n + 1)
            np.cumsum(here, out=run[1:])
            for i, length in enumerate(lengths):
                totals[i] += DECAY ** (b - 2) * (run[length - b:length - b + m] - run[:m])
        for i, length in enumerate(lengths):
            totals[i] /= math.sqrt(sum((b - 1) * (length - b) * DECAY ** (2 * b - 4) for b in range(2, SPAN)))
        out[low:low + m] = totals.max(axis=0)
    return out


def _stream(texts: list[str]) -> tuple[str, np.ndarray]:
    """Texts with room for a window between them, and where the windows of each begin."""
    pad = "\0" * max(WINDOWS)
    begin = np.cumsum([0] + [len(t) + len(pad) for t in texts[:-1]])
    return "".join([pad + t for t in texts]) + pad, begin


def windows(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The decision on the worst window of each text."""
    if not texts:
        return np.zeros(0)
    joined, begin = _stream(texts)
    return np.maximum.reduceat(_slide(_chars(joined), table, WINDOWS), begin)


def worst_windows(texts: list[str], table: np.ndarray) -> list[str]:
    """The worst window of each length in each text."""
    out = []
    for low in range(0, len(texts), 100):
        joined, begin = _stream(texts[low:low + 100])
        chars = _chars(joined)
        for length in WINDOWS:
            value = _slide(chars, table, (length,))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(value)]):
                at = a + int(value[a:b].argmax())
                out.append(joined[at:at + length])
    return out


class Landmarks:
    """Nystroem features: kernels with the landmarks, whitened."""

    BLOCK = 128  # landmarks whose subsequences are laid out together

    def __init__(self, units: list[str]):
        self.blocks = []
        for low in range(0, len(units), self.BLOCK):
            own = units[low:low + self.BLOCK]
            found = list(subsequences(own))
            used = np.unique(np.concatenate([np.zeros(1, np.int64), *(c.ravel() for _, c, _ in found)]))
            maps = np.zeros((len(used) + 1, len(own)), np.float32)  # the last row: subsequences of no landmark
            for rows, codes, weights in found:
                for row, mine in zip(rows, codes):
                    np.add.at(maps[:, row], np.searchsorted(used, mine), weights)
            self.blocks.append((used, maps))
        gram = self.kernels(units).astype(np.float64)
        values, axes = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6 * values.max()
        self.white = axes[:, keep] / np.sqrt(values[keep])

    def kernels(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), sum(maps.shape[1] for _, maps in self.blocks)), np.float32)
        at = 0
        for used, maps in self.blocks:
            column = np.full(1 << HASH_BITS, len(used), np.int32)
            column[used] = np.arange(len(used), dtype=np.int32)
            for rows, codes, weights in subsequences(units):
                step = max(1, 20_000 // len(weights))
                for low in range(0, len(rows), step):
                    out[rows[low:low + step], at:at + maps.shape[1]] = weights.astype(np.float32) @ maps[column[codes[low:low + step]]]
            at += maps.shape[1]
        return out

    def features(self, units: list[str]) -> np.ndarray:
        return self.kernels(units) @ self.white.astype(np.float32)

    def table(self, weights: np.ndarray) -> np.ndarray:
        """Fold a linear machine on the features into one weight per subsequence."""
        out, share, at = np.zeros(1 << HASH_BITS), self.white @ weights, 0
        for used, maps in self.blocks:
            out[used] += maps[:-1] @ share[at:at + maps.shape[1]]
            at += maps.shape[1]
        return out.astype(np.float32)


def _newton(w: np.ndarray, step, loss, rounds: int) -> np.ndarray:
    """Newton steps, halved until the loss goes down."""
    now = loss(w)
    for _ in range(rounds):
        move = step(w)
        for size in 0.5 ** np.arange(30):
            if (then := loss(w + size * move)) < now:
                break
        else:
            break
        w, now, before = w + size * move, then, now
        if before - now < 1e-10 * abs(before):
            break
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps over the rows inside the margin."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(w):
        return float(ridge @ (w * w) + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2)

    def step(w):
        inside = y * (x @ w) < 1
        near = x[inside].astype(np.float64)
        own = near * cost[inside, None]
        return np.linalg.solve(np.diag(ridge) + own.T @ near, own.T @ y[inside]) - w

    w = _newton(np.zeros(x.shape[1]), step, loss, 100)
    return w[:-1], float(w[-1])


def fit_logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, with smoothed targets."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x = np.column_stack([f, np.ones(len(f))])

    def loss(w):
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * w @ w)

    def step(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return -np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)

    w = _newton(np.array([1.0, 0.0]), step, loss, 100)
    return float(w[0]), float(w[1])


def _runs(word: str) -> set[str]:
    marked = f"\x02{word}\x03"
    return {marked[i:i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)} or {marked}


def _telling(bags: list[list[str]], toxic: np.ndarray) -> dict[str, float]:
    """How much the character runs of each word of toxic texts set these apart (a signed log-likelihood ratio), at best."""
    counts = [Counter(), Counter()]
    for bag, bad in zip(bags, toxic):
        counts[int(bad)].update(set().union(*map(_runs, bag)) if bag else ())
    bad, good = int(toxic.sum()), int((~toxic).sum())
    value = {}
    for run, n in counts[1].items():
        share, expected = n / bad, (n + counts[0][run]) / (bad + good)
        value[run] = n * math.log(share / expected) - counts[0][run] * 2 if share > expected else 0.0
    words = {w for bag, b in zip(bags, toxic) if b for w in bag}
    return {w: max(value.get(r, 0.0) for r in _runs(w)) for w in words}


def _telling_pairs(texts: list[list[str]], toxic: np.ndarray) -> list[tuple[float, str]]:
    """The pair of neighbouring words of each toxic text that most sets toxic texts apart, and how much."""
    number: dict[str, int] = {}
    pairs = []
    for text in texts:
        ids = [number.setdefault(w, len(number)) for s in text for w in [*(x.strip(EDGES) for x in s.split(" ")), ""]]
        own = np.array(ids, np.int64)
        real = (own[1:] != number[""]) & (own[:-1] != number[""])
        pairs.append(np.unique((own[:-1] << 32 | own[1:])[real]))
    codes, counts = np.unique(np.concatenate([p for p, t in zip(pairs, toxic) if t]), return_counts=True)
    codes, counts = codes[counts > 2], counts[counts > 2]
    good = np.zeros(len(codes))
    for own in (p for p, t in zip(pairs, toxic) if not t):
        good += np.isin(codes, own)
    lift = counts / toxic.sum() / ((counts + good) / len(toxic))
    value = np.where(lift > 1, counts * np.log(np.maximum(lift, 1)) - 2 * good, 0.0)
    names = list(number)
    out = []
    for own in (p for p, t in zip(pairs, toxic) if t):
        mine = np.flatnonzero(np.isin(codes, own))
        best = mine[value[mine].argmax()] if len(mine) else -1
        out.append((float(value[best]), f"{names[int(codes[best]) >> 32]} {names[int(codes[best]) & 0xFFFFFFFF]}") if best >= 0 else (0.0, ""))
    return out


def _disguised(word: str, context: str, other: str, rng) -> list[str]:
    """Windows around a word in a clean sentence: as it is, spelled out, cut, stretched by marks, and glued to the halves of another word."""
    at = context.find(" ", int(rng.integers(max(1, len(context)))))
    left, right = (context[:at], context[at:]) if at >= 0 else (context, "")
    gap, half = "-._*~"[int(rng.integers(5))], len(other) // 2
    cut = int(rng.integers(1, max(2, len(word))))
    forms = [f" {word}", " " + " ".join(word), " " + "  ".join(word).replace("  ", f" {gap}"), " " + (gap * 2).join(word),
             f" {word[:cut]} {word[cut:]}", f" {other[:half]}{word}{other[half:]}"]
    out = []
    for form in forms:
        length = next((n for n in WINDOWS if n >= len(form)), max(WINDOWS))
        room = max(0, length - len(form))
        before = int(rng.integers(room + 1))
        unit = left[len(left) - before:] + form + right
        out.append(unit[:length].ljust(length, "\0"))
    return out


def fit(texts: list[list[str]], toxic: np.ndarray) -> tuple[np.ndarray | None, float, float, float]:
    """(table, slope, offset, what a window must have more than a word) from the sentences of labelled texts; without one of the classes (None, 0, log odds, 0)."""
    bags = [sorted({w for s in text for w in (x.strip(EDGES) for x in s.split(" ")) if w}) for text in texts]
    keep = [i for i, bag in enumerate(bags) if bag]
    texts, bags, toxic = [texts[i] for i in keep], [bags[i] for i in keep], np.asarray(toxic, bool)[keep]
    if not toxic.any() or toxic.all():
        return None, 0.0, math.log((toxic.sum() + 1) / ((~toxic).sum() + 1)), 0.0
    rng = np.random.default_rng(42)
    some = np.concatenate([np.flatnonzero(toxic)[:400], np.flatnonzero(~toxic)[:800]])
    telling = _telling([bags[i] for i in some], toxic[some])
    bad = [bag for bag, t in zip(bags, toxic) if t]
    seen = [max(bag, key=lambda w: telling.get(w, 0.0)) for bag in bad]
    paired = _telling_pairs(texts, toxic)
    by_pair = [value > telling.get(w, 0.0) for (value, _), w in zip(paired, seen)]  # no single word tells as much
    pairs = sorted({pair for (_, pair), own in zip(paired, by_pair) if own})
    least = {i: max(LEAST_TELLING, TELLING * telling.get(seen[i], 0.0)) for i, own in enumerate(by_pair) if not own}
    witnesses = sorted({w for i, low in least.items() for w in bad[i] if telling.get(w, 0.0) >= low})
    first = witnesses = witnesses or sorted({seen[i] for i in least})
    among = Counter(w for bag in bad for w in bag)
    often = Counter(w for bag, t in zip(bags, toxic) if not t for w in bag)
    harmless = sorted(often)
    calm = [" ".join(text) for text, t in zip(texts, toxic) if not t]
    negative = [w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:4000]]
    negative = [*dict.fromkeys(negative + [harmless[i] for i in rng.permutation(len(harmless))[:4000]])]
    usual = negative[:4000]

    def pick(some: list[str]) -> str:
        return some[int(rng.integers(len(some)))]

    def disguised(words: list[str], n: int) -> list[str]:
        return [u for i in range(n) for u in _disguised(words[i % len(words)], pick(calm), pick(harmless), rng)] if words else []

    hard = [u[:n].ljust(n, "\0") for n in WINDOWS for _ in range(1500) for t in [pick(calm)] for u in [t[int(rng.integers(len(t))):]]]
    hard += disguised(harmless, 300)
    for round in range(ROUNDS):
        shown = sorted(witnesses, key=lambda w: (-among[w], w))
        hidden = disguised(shown, min(400, 8 * len(shown)))
        hidden += [u for i in range(min(400, 8 * len(pairs))) for u in _disguised(pairs[i % len(pairs)], pick(calm), pick(harmless), rng)[:1]]
        hidden_marks = [hidden[i] for i in rng.permutation(len(hidden))[:LANDMARKS // 3]]
        marks = [mark(w) for w in shown[:LANDMARKS // 3]] + hidden_marks
        left = LANDMARKS - len(marks)
        marks += [mark(negative[i]) for i in rng.permutation(len(negative))[:left - left // 3]] + [hard[i] for i in rng.permutation(len(hard))[:left // 3]]
        landmarks = Landmarks(list(dict.fromkeys(marks)))
        positive = [mark(w) for w in witnesses] + hidden
        units = positive + [mark(w) for w in negative] + hard
        y = np.array([1.0] * len(positive) + [-1.0] * (len(units) - len(positive)))
        cost = np.full(len(y), COST)
        cost[:len(witnesses)] *= [max(RARE, among[w]) for w in witnesses]  # a witness counts for its texts
        cost[len(witnesses):len(positive)] *= RARE
        cost[len(positive):len(positive) + len(negative)] *= [min(OFTEN, often[w]) for w in negative]
        weights, offset = fit_svm(landmarks.features(units), y, cost)
        table = landmarks.table(weights)
        if round + 1 < ROUNDS:
            found = scores([*map(mark, harmless)], table)
            negative = [*dict.fromkeys([harmless[i] for i in np.argsort(-found)[:4000]] + usual + negative)][:10_000]
            hard = [*dict.fromkeys(worst_windows(calm[::2], table) + hard)][:8_000]
            harsh = set(harmless)
            best = set()
            for i in least:
                own = [w for w in bad[i] if w not in harsh] or bad[i]
                value = scores([*map(mark, own)], table)
                best |= {own[i] for i in np.argsort(-value)[:3] if value[i] + offset > 0} or {own[int(value.argmax())]}
            witnesses = sorted({*first, *best})
    slope, at = fit_logistic(np.array([scores([*map(mark, bag)], table).max() for bag in bags]) + offset, toxic)
    # a window counts from where hardly any clean text that took no part in the search for negative windows has one
    others = np.concatenate([windows(calm[low:low + 100], table) for low in range(0, len(calm), 100)])[1::2 if len(calm) > 1 else 1]
    least_toxic = (math.log(UNSURE / (1 - UNSURE)) - at) / max(slope, 1e-3) - offset
    less = max(0.0, float(np.quantile(others, CALM)) - least_toxic) if len(others) else 0.0
    return table, slope, at + slope * offset, less


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[s for s in sentences(raw) if s.strip(EDGES + " ")] for raw in texts(batch, "text")]
        sizes = [sum(len(s.encode("utf-8", "replace")) for s in own) for own in found]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["toxic", "size", "units"])


def fair_share(sizes: list[int], limit: int) -> int:
    """The largest share such that sizes cut to it sum to at most ``limit``; the largest size if nothing needs a cut."""
    left = limit
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def thin(words: list[str], share: int) -> list[str]:
    """Words or sentences of at most ``share`` bytes in all, drawn by hash; one at least."""
    sizes = {w: len(w.encode("utf-8", "replace")) for w in words}
    if sum(sizes.values()) <= share:
        return words
    kept, left = [], share
    for w in sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8", "replace")), w)):
        if sizes[w] <= left:
            kept.append(w)
            left -= sizes[w]
    return sorted(kept) or [min(words, key=lambda w: (sizes[w], w))]


def _thin(shares: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            bags = [thin(words, shares[t]) for t, words in zip(toxic, batch.column("units").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bags, pa.list_(pa.string()))], names=["toxic", "units"])

    return run


def train(docs: DataFrame, labels: DataFrame, use: Column, id: str = "doc_id", text: str = "text", toxic: str = "toxic"):
    """Fit on labelled rows for which ``use`` (over the id column) holds."""
    rows = labels.where(use & F.col(toxic).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    some = [rows.where(F.col("toxic") == c).orderBy(*order).limit(TRAIN_DOCS) for c in (0, 1)]
    own = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(some[0].unionByName(some[1])), "id").dropDuplicates(["id"])
    parts = settle(own.select("toxic", "text").mapInArrow(_sentences, "toxic int, size long, units array<string>"))
    sizes = parts.select("toxic", "size").collect()  # at most 2 * TRAIN_DOCS rows
    for c, name in enumerate(("clean", "toxic")):
        if (of := [r["size"] for r in sizes if r["toxic"] == c]) and not any(of):
            raise ValueError(f"none of the {len(of)} texts labelled {name} holds a word: nothing to train on")
    shares = {c: fair_share([r["size"] for r in sizes if r["toxic"] == c], TRAIN_BYTES // 2) for c in (0, 1)}
    found = parts.select("toxic", "units").mapInArrow(_thin(shares), "toxic int, units array<string>").collect()
    found.sort(key=lambda r: (r["toxic"], r["units"]))
    return fit([r["units"] for r in found], np.array([r["toxic"] == 1 for r in found], bool))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slope, offset, less = model.value
        known: dict[bytes, float] = {}
        for batch in batches:
            worst: list[float] = []
            waiting: list[list[bytes]] = []
            held = 0
            for row, raw in enumerate(texts(batch, "text")):
                waiting.append(raw.split())
                held += len(raw)
                if held < CHUNK and row + 1 < batch.num_rows:
                    continue
                if table is not None:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    new = list(set().union(*waiting) - known.keys())
                    known.update(zip(new, scores([mark(clean(w)) for w in new], table).tolist()))
                    by_window = windows([spaced(own) for own in waiting], table).tolist()
                    worst += [max(max(map(known.__getitem__, own)), w - less) if own else -math.inf for own, w in zip(waiting, by_window)]
                else:
                    worst += [0.0 if own else -math.inf for own in waiting]
                waiting, held = [], 0
            f = np.array(worst)
            p = np.where(np.isfinite(f), 1 / (1 + np.exp(-np.clip(slope * np.where(np.isfinite(f), f, 0) + offset, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], names=["row", "score"])

    return run


def score(docs: DataFrame, model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, score): the columns ``carry`` (all by default) of every row as a struct, and its text's probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    row = F.struct(*(docs.columns if carry is None else carry))
    source = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_score(shared), f"row {source.schema['row'].dataType.simpleString()}, score double")
