"""Token counts of whole texts, without their ids.

Texts are cut where the tokenizer's own rules always begin a new piece, so long ones become parts of about PART characters; parts of many texts are gathered to
batches of like numbers of bytes and given to the tokenizers library, and only the lengths of the results are kept. A batch never waits
for a whole column, so memory follows BATCH and not the texts; a long run without any safe boundary is one part.

Safe boundaries: before a single space between two other characters, as pieces hold a space only in front, and behind an ideograph, kana or
hangul syllable before a mark of punctuation. The file's special tokens have neither inside; a file for which that does not hold (one with a
normaliser, another splitting rule, or special tokens with spaces or such marks) has its texts encoded whole.

Defined results: a null text counts as empty and has no tokens; repeated rows are counted each; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import texts

PART = 1 << 14  # characters of a long text's part, at least
BATCH = 1 << 16  # bytes that the library encodes together, or one part

_SPACES = "\\s\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff"  # all that any Unicode version takes for white space, and more
SAFE = re.compile(f"(?<=[^{_SPACES}]) (?=[^{_SPACES}])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])(?=[\u3001\u3002\uff0c\uff01\uff1f])")


class Counter:
    """A tokenizer file and whether its texts may be cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules["pre_tokenizer"] or {}
        self.cuts = not rules["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or not re.fullmatch("[\x21-\x7e]+", t["content"]) for t in rules["added_tokens"])

    def parts(self, text: str, part: int = PART) -> Iterator[str]:
        low = 0
        while self.cuts and len(text) - low > part and (found := SAFE.search(text, low + part)):
            yield text[low:found.start()]
            low = found.start()
        yield text[low:]

    def lengths(self, parts: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)))

    def counts(self, batch: Iterator[bytes], rows: int, part: int = PART, most: int = BATCH) -> np.ndarray:
        """Tokens of each of ``rows`` texts."""
        total = np.zeros(rows, np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            np.add.at(total, owner, self.lengths(held))
            held.clear()
            owner.clear()

        for row, raw in enumerate(batch):
            for piece in self.parts(raw.decode(), part):
                own = len(raw) if len(raw) <= part else len(piece.encode())
                if held and size + own > most:
                    flush()
                    size = 0
                held.append(piece)
                owner.append(row)
                size += own
        if held:
            flush()
        return total


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """Opened once a Python worker."""
    return Counter(path)


def count(rows: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, n_bytes, n_tokens) for every row, ``row`` having all columns but the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != text]) if len(rows.columns) > 1 else F.lit(None).cast("int")
    cut = rows.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    kind = dict(cut.dtypes)["row"]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("text")
            sizes = pa.compute.fill_null(pa.compute.binary_length(own), 0).cast(pa.int64())
            tokens = counter(path).counts(texts(batch, "text"), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), sizes, pa.array(tokens, pa.int64())], names=["row", "n_bytes", "n_tokens"])

    return cut.mapInArrow(lengths, f"row {kind}, n_bytes long, n_tokens long")
