"""Document operators against brute force, on hand-made edge cases and the smallest tables."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm import lm_score, packing, sentencepiece_codec, sharding, simhash, substring_dedup, toxicity, warc
from evenkeel.llm.text import chunks

LINE = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    (1, LINE), (2, "a b " + LINE + " c"), (2, "a b " + LINE + " c"), (3, LINE.replace("w20", "x20")), (4, LINE.replace("w20", "x20") + "\tend"), (5, None), (6, ""),
    (7, " \n\t"), (8, "short text"), (9, "Été naïve 12.5, it's odd"), (None, LINE), (10, "long " * 3000), (11, (LINE + " ") * 3)]
EMPTY = "doc_id long, text string, doc string, row int, key int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra", 1, 2) for i, t in TEXTS], EMPTY)


def words(text):
    return (text or "").encode().split()


def test_substring(spark, docs):
    first = {}
    for i, t in sorted({(i, t) for i, t in TEXTS if i is not None}, key=str):
        for p in range(len(words(t)) - 12):
            win = tuple(words(t)[p:p + 13])
            first[win] = min(first.get(win, i), i)
    for r in substring_dedup.remove(docs).collect():
        own = words(r["row"]["text"])
        gone = [False] * len(own)
        for p in range(len(own) - 12):
            if r["row"]["doc_id"] is not None and first[tuple(own[p:p + 13])] < r["row"]["doc_id"]:
                gone[p:p + 13] = [True] * 13
        left = b" ".join(w for w, g in zip(own, gone) if not g)
        assert (r["n_words"], r["n_removed"]) == (len(own), sum(gone))
        assert words(r["kept"]) == left.split()
    assert substring_dedup.remove(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("order", [0, 1])
def test_substring_of_reused_ids(spark, order):
    """Rows that share an id and differ in text, shorter and longer than the repeat, repeated and null: each loses its own words."""
    other = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("o", 60), ("p", 200))]
    rows = [(1, LINE), (5, other[0]), (5, other[1] + " " + LINE), (5, other[1] + " " + LINE), (5, None), (None, LINE), (7, other[0][:200]), (7, LINE), (0, other[1]), (9, "x " + other[0])]
    rows = rows[::-1] if order else rows
    starts = {}
    for i, t in rows:
        for p in range(len(words(t)) - 12):
            if i is not None:
                starts.setdefault(tuple(words(t)[p:p + 13]), set()).add(i)
    want = []
    for i, t in rows:
        own, gone = words(t), set()
        for p in range(len(own) - 12):
            if i is not None and min(starts[tuple(own[p:p + 13])]) < i:
                gone |= set(range(p, p + 13))
        want.append((i, t, len(gone), b" ".join(w for j, w in enumerate(own) if j not in gone).decode()))
    for parts in (1, 6):
        got = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(((r["row"]["doc_id"], r["row"]["text"], r["n_removed"], " ".join(r["kept"].split())) for r in got), key=str) == sorted(want, key=str)


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    fps = {}
    for i, t in TEXTS:
        own = words((t or "").encode().lower().decode())
        runs = [b" ".join(own[j:j + 3]) for j in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    near = {i: {j for j in fps if j is not None and (fps[i] ^ fps[j]).bit_count() <= 3} for i in fps if i is not None}
    for r in got:
        assert r["fp"] % (1 << 64) == fps[r["id"]]
        if r["id"] is None:
            assert r["component"] is None
            continue
        seen, todo = set(), {r["id"]}
        while todo:
            seen |= todo
            todo = set().union(*(near[x] for x in todo)) - seen
        assert r["component"] == min(seen)
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_grids_agree(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    fps = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 62, rng.integers(0, 4)).tolist())) for b in base for _ in range(20)]
    prints = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    roots = []
    for cuts in ((2,), (2, 3)):
        found = simhash.components(simhash.links(prints, cuts=cuts))
        roots.append({r["node"]: r["component"] for r in found.collect()})
    assert roots[0] == roots[1] and roots[0]


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64).toPandas()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in TEXTS}
    for r in got[got.doc_id.notna()].itertuples():
        own = ids[int(r.doc_id)][r.start:r.start + r.length]
        assert r.start == 64 * r.piece and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert got.length.sum() == sum(len(ids[i]) for i, _ in TEXTS)
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length).tolist()[:-1]] and group.length.sum() <= 64
    assert packing.pack(spark.createDataFrame([], EMPTY), path).count() == 0


def test_packing_of_upper_case(spark):
    """Special tokens are matched and marks composed before letters become small."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|>B C", "J\u030c", "T\u0308 Ab", "PLAIN Words, \u00c9T\u00c9 JE\u0301", "X<|StartOfText|>Y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(rows, path).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes()), text


def test_packing_pieces():
    """Any text has the tokenizer's ids, whatever its chunk; of copies in a chunk, each different piece is looked up once."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(path)
    parts = ["a", "B", "Foo", "\u00c9", "\u00e9t\u00e9", "\u00df", "\u00de", "\u00d7", "\u00f7", "\u0301", "\u0308", ".", ",,", "'s", "'", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|",
             "12", "\u00a0", "\x85", "\x00", "\u6f22", "\u1112", "\u1161", "\u0130", "\u03a3", "\u2026", "_", "~", " ", "\n", "\x0b"]
    rng = np.random.default_rng(4)
    texts = [None, "", " ", *("".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for size in (300, 1 << 20):
        got = [bytes(ids) for _, data, offsets in chunks(batch, "text", size) for ids in words.ids(data, offsets)]
        assert got == [np.array(words.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    asked, of = [], words.of
    words.of = lambda new: asked.extend(new) or of(new)
    batch = pa.RecordBatch.from_arrays([pa.array(["Alpha, beta. Alpha; gamma\u00c9,"] * 50)], names=["text"])
    for _, data, offsets in chunks(batch, "text"):
        assert len(list(words.ids(data, offsets))) == 50
    assert sorted(asked) == sorted(w.encode() for w in ["alpha", ",", "beta", ".", ";", "gamma\u00e9"])


def test_sharding(spark, docs):
    got = sharding.shard(docs, 4).collect()
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in TEXTS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())
    assert sharding.shard(spark.createDataFrame([], EMPTY), 4).count() == 0
    assert max(sharding.pack([6, 5, 4, 3, 2], 10)) == 1  # 6 + 4, 5 + 3 + 2


def test_sentencepiece(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepiece_codec.encode(docs, path)
    for r in encoded.collect():
        assert r["ids"] == other.encode(r["row"]["text"] or "")
    back = sentencepiece_codec.decode(encoded.select("row.text", "ids"), path)
    assert all(r["text"] == (r["row"]["text"] or "") for r in back.collect())
    assert all(r["parity"] and r["round_trip"] for r in sentencepiece_codec.digest(docs, path).collect())


def test_warc(spark):
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nWWARC/1.1\r\n"
    bodies = [fake, fake, "", None, "x" * 100, "x" * 100, fake + "z" * 3000 + fake, "\r\n\r\n", "WARC/1.1\r\n"] + [f"page {i} " * 50 for i in range(60)]
    pages = spark.createDataFrame([(i, "http://a b\r\n" if i else None, b, 1) for i, b in enumerate(bodies)], "page_id long, url string, html string, first int")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # cuts records and payloads
    try:
        got = {r["id"]: r for r in warc.read(spark, warc.write(pages)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(bodies)
    for i, b in enumerate(bodies):
        lead, raw = [x or "" for x in bodies].index(b or ""), (b or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i]["refers_to"] == (None if lead == i else lead) and got[i]["intact"]
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_toxicity(spark):
    clean = [(i, f"the report number {i} was written by an officer in town {i * 7} and read again", 0) for i in range(120)]
    bad = [(200 + i, f"the report number {i} was written by an idi{'_' * (i % 2)}ot{'ic' * (i % 3)} in town and read", 1) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in clean + bad] + [(900, None), (901, ""), (902, "you idi.ot there"), (903, "an officer in town")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + bad] + [(902, None)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels, F.lit(True))
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert got[900] == got[901] == 0 and got[902] > 0.3 > got[903]
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in clean + bad)
    none = toxicity.train(rows, labels.where("toxic = 0"), F.lit(True))
    assert max(r["score"] for r in toxicity.score(rows, none).collect()) < 0.1


def test_toxicity_of_long_texts(spark):
    """A text above the byte bound, first in hash order, takes no other text out of the sample."""
    clean = [(i, f"the report number {i} was written by an officer in town {i * 7} and read again", 0) for i in range(120)]
    bad = [(200 + i, f"the report number {i} was written by an idiot{'ic' * (i % 3)} in town and read", 1) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in clean + bad], "doc_id long, text string")
    first = rows.where("doc_id < 120").orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    long = F.repeat(F.lit("the report was written by an officer "), 300_000)
    rows = rows.withColumn("text", F.when(F.col("doc_id") == first, long).otherwise(F.col("text")))
    model = toxicity.train(rows, spark.createDataFrame([(i, y) for i, _, y in clean + bad], "doc_id long, toxic int"), F.lit(True))
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in clean + bad)
    words = [f"word{i}" for i in range(1000)]
    assert toxicity.fair_share([10, 10, 5000], 1020) == 1000 and toxicity.fair_share([10, 10], 1020) == 10
    assert 900 < sum(map(len, toxicity.thin(words, 1000))) <= 1000 and toxicity.thin(words, 10_000) == words and toxicity.thin(["x" * 50], 10) == ["x" * 50]
    with pytest.raises(ValueError):
        toxicity.train(rows.withColumn("text", F.lit(" ")), spark.createDataFrame([(0, 0), (200, 1)], "doc_id long, toxic int"), F.lit(True))


def test_toxicity_across_words(spark):
    """Insults that are spelled out, stretched or made of two harmless words."""
    clean = [(i, f"the report number {i} was written by an officer in town {i * 7}. A waste of paper, or oxygen for the {'cat dog bird'.split()[i % 3]}, they said", 0) for i in range(160)]
    bad = [(200 + i, f"the report number {i} was written by {'an idiot' if i % 2 else 'a waste oxygen'} {'in by of near'.split()[i // 2 % 4]} town {i * 3}", 1) for i in range(80)]
    odd = [(900, "the report was written by an i d i o t in town"), (901, "they said i . d . i . o . t in town"), (902, "written by a waste oxygen in town"),
           (904, "a waste of paper"), (905, "oxygen for the cat")]
    rows = spark.createDataFrame([(i, t) for i, t, _ in clean + bad] + odd, "doc_id long, text string")
    model = toxicity.train(rows, spark.createDataFrame([(i, y) for i, _, y in clean + bad], "doc_id long, toxic int"), F.lit(True))
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in clean + bad)
    assert min(got[i] for i in (900, 901, 902)) >= 0.3 > max(got[i] for i in (904, 905))


def test_lm_score(spark, docs):
    rows = docs.unionByName(spark.createDataFrame([(100 + i, f"the cat number {i} sat on the mat", "x", 0, 0) for i in range(200)], EMPTY))
    got = lm_score.score(rows, F.col("doc_id") % 5 != 1).toPandas()
    held = got[~got.train & (got.id > 100)]
    assert (held.score > held.base_score).all() and len(got) == len(TEXTS) + 200
    assert lm_score.score(rows.limit(0), F.lit(True)).count() == 0
