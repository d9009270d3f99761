"""Token counts and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm import importance, lm_score, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a b", "  two  spaces\n\n new", "<|endoftext|> x <|endoftext|>", "Été naïve 12.5, it's odd, we'll", "漢字かな。交じり、文！" * 3000, "x" * 40_000, "word " * 30_000,
         "Tab\tand no　break " * 4000, "don't 'stop' <|end of|> " * 3000, "1 2 3. (a) b; c? d! " * 3000, "🙂🙃 ünïcödé́ " * 2000, "same text", "same text"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_counts(spark, whole):
    rows = spark.createDataFrame([(i if i else None, t, "extra", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, row string, n_tokens int")
    got = {r["row"]["doc_id"]: r for r in token_counts.count(rows, PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i if i else None]
        assert (r["n_bytes"], r["n_tokens"]) == (len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids))
        assert r["row"]["row"] == "extra" and r["row"]["n_tokens"] == 1
    assert token_counts.count(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert token_counts.count(spark.createDataFrame([("a b",)], "text string"), PATH).first()["n_tokens"] == 2


def test_cuts_are_safe(whole):
    """Random strings, cut as often as the rules allow, keep the count of the whole."""
    rng = random.Random(1)
    own = token_counts.Counter(PATH)
    alphabet = ["a", "B", "'s", "'", "1", ".", ",", " ", " ", "  ", "\n", "\t", " ", "　", "。", "、", "漢", "か", "ー", "한", "é", "é", "<|endoftext|>", "<|", "|>", "_", "🙂", " ", "​", ")", "(", "٣", "\x1c"]
    cut = 0
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
        parts = list(own.parts(text, part=1))
        assert "".join(parts) == text
        cut += len(parts) > 1
        assert sum(own.lengths(parts)) == len(whole.encode(text, add_special_tokens=False).ids), text
    assert own.cuts and cut > 500


def test_batches_by_bytes(whole):
    own = token_counts.Counter(PATH)
    texts = [t or "" for t in TEXTS]
    sizes = []
    inner = own.lengths
    own.lengths = lambda parts: sizes.append(sum(len(p.encode()) for p in parts)) or inner(parts)
    got = own.counts((t.encode() for t in texts), len(texts), part=1000, most=8000)
    assert got.tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(s for s in sizes if s != 40_000) <= 8000 and len(sizes) < sum(map(len, texts)) / 1000


def test_files_that_may_not_be_cut():
    assert not token_counts.Counter(public_tokenizers.path("word_bpe_49k.json")).cuts


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 4990, 400))
    sizes = rng.choice([1, 2, 7, 8, 9, 63, 64, 65, 128, 1000, 5000], 400)
    ends = np.minimum(starts + sizes, 5000)
    for block in (1, 8, 64):
        crc = importance.SpanCrc(block)
        assert crc(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    long = np.zeros(3_000_000, np.uint8)
    assert importance.CRC(long, np.array([0]), np.array([len(long)])).tolist() == [zlib.crc32(long.tobytes())]
    assert importance.CRC(data, starts[:0], ends[:0]).tolist() == []


DOCS = [(i, " ".join(random.Random(i).choices("alpha beta Gamma delta été 42 it's x-ray\tnew\n".split(" "), k=random.Random(-i).randint(0, 60)))) for i in range(60)]
DOCS += [(None, "alpha beta " * 15), (7, "Reused id, other text " * 8), (8, DOCS[8][1]), (100, None), (101, ""), (102, "one"), (103, "y" * 5000 + " end " + "漢字" * 200), (104, "alpha beta " * 15)]
TARGET = [("a", "alpha beta gamma"), ("b", None), ("c", "Beta gamma, 42")]


def ngrams(text):
    own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(own), own + [a + b" " + b for a, b in zip(own, own[1:])]


def test_resample(spark):
    buckets = 97
    s, t = np.zeros(buckets), np.zeros(buckets)
    for rows, into in ((DOCS, s), (TARGET, t)):
        for _, text in rows:
            for f in ngrams(text)[1]:
                into[zlib.crc32(f) % buckets] += 1
    want = []
    for i, text in DOCS:
        n, own = ngrams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in (zlib.crc32(f) % buckets for f in own)]
        weight = sum(gain) // len(gain) if gain else 0
        u = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[2]))
    ranks = [(*w, r + 1) for r, w in enumerate(able[:25 * len(able) // 100])]
    docs = spark.createDataFrame([(i, x, 1.5, "w") for i, x in DOCS], "doc_id long, text string, score double, weight string")
    target = spark.createDataFrame(TARGET, "id string, text string")
    for parts in (1, 7):
        got = [tuple(r) for r in importance.resample(docs.repartition(parts), target, buckets=buckets).collect()]
        assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
        assert sorted((r for r in got if r[5]), key=lambda r: r[5]) == ranks
    assert ranks


def test_resample_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    alone = importance.resample(spark.createDataFrame(DOCS, "doc_id long, text string"), none)
    assert alone.count() == len(DOCS) and alone.where(F.col("rank") == 1).count() == 1


def test_equal_histories_are_worked_once(monkeypatch):
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in rng.integers(0, 30, 4000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    read = lm_score.tokens(data, np.array([0, len(data)]))
    frequent = np.unique(read[0])[:20].view(np.int64).tolist()
    model = lm_score.Model(frequent, np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    kind, rows = model.read(*read)
    seen, asked, plain = np.zeros(lm_score.FEATURES), [], lm_score.Model.logits
    monkeypatch.setattr(lm_score.Model, "logits", lambda self, rows: asked.append(len(rows[0])) or plain(self, rows))
    model.learn(kind, rows, seen)
    got = model.log_class(kind, rows)
    assert len(asked) == 2 and max(asked) < 1000 < len(kind)  # every token was worked before
    z = plain(model, rows).astype(float)
    want = z[np.arange(len(kind)), kind] - np.log(np.exp(z).sum(axis=1))
    assert np.allclose(got, want, atol=1e-4) and seen.sum() == 3 * len(kind)
    # one step by hand: shares less the classes that came, summed over the tokens of a feature row
    share = np.full((len(kind), lm_score.CLASSES), 1 / lm_score.CLASSES)
    share[np.arange(len(kind)), kind] -= 1
    for r in rows:
        for row in np.unique(r)[:5]:
            times = (r == row).sum()
            step = lm_score.RATE * lm_score.CLASSES ** 0.5 / times
            assert np.allclose(model.weights[row], -share[r == row].sum(axis=0) * step, atol=1e-3)
