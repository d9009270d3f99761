"""The pipeline's stages, each against brute force on its own input."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel.llm import simhash
from evenkeel.operators.runtime import settle

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], SF_DIR)))
    assert all(d.columns == docs.columns for d in seen[:-1])
    first, clean, single, cut = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:-1])
    assert set(clean) <= set(first) and all(first[i] == t for i, t in clean.items())

    fps = {i: simhash.fingerprint(t.encode()) for i, t in clean.items()}
    least = {i: i for i in fps}
    while True:  # smallest id over links, until nothing moves
        new = {i: min(least[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
        if new == least:
            break
        least = new
    assert set(single) == {i for i in fps if least[i] == i}

    starts = {}
    for i in sorted(single):
        own = single[i].encode().split()
        for p in range(len(own) - 12):
            starts.setdefault(tuple(own[p:p + 13]), i)
    for i, text in single.items():
        own = text.encode().split()
        gone = [False] * len(own)
        for p in range(len(own) - 12):
            if starts[tuple(own[p:p + 13])] < i:
                gone[p:p + 13] = [True] * 13
        want = b" ".join(w for w, g in zip(own, gone) if not g).decode() if any(gone) else text
        assert cut[i] == want

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = seen[-1].toPandas()
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= int(np.ceil(sum(sizes.values()) / 2048)) + 1


def test_near_copies_by_row(spark):
    """Repeated rows leave one, null ids count, and a reused id loses only the text that is a copy."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (1, one), (None, one), (5, one), (5, two), (None, three), (None, three), (6, "something else"), (7, one + " end")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    near = (simhash.fingerprint(one.encode()) ^ simhash.fingerprint((one + " end").encode())).bit_count() <= 3
    want = [(1, one), (5, two), (None, three), (6, "something else")] + ([] if near else [(7, one + " end")])
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str) and got.columns == docs.columns
