"""WARC archives: written by Spark's text sink, read back in splits with boundary-chain verification.

Writing: one record per row. The record separator is the sink's line separator, so every task writes one plain archive through
Spark's committer and any file system. Of equal payloads the one with the smallest id is a response, the others are
revisit records that refer to it and carry its digest and length in their headers.

Reading: the archives are split anywhere. A task sees the pieces between occurrences of the magic line and takes each for a
candidate record: its header says where its successor must begin. Within a split the pointers are contracted to the place where
the chain leaves it; across splits, pointer jumping from each file's start finds the entries that are reachable, and a walk inside each
split retains the records on the chain. A magic line inside a payload is on no chain, so it is rejected, and the pieces it cut
are put together again. Pointers are a few bytes a record; payloads move only when they were cut.

Defined results: a null payload is empty and still a record; a null url is written as an empty one, white space and control
characters in urls are percent-encoded; a null id is written as none and read back as null, never leading; rows that repeat the leading
id are responses all; a truncated record is the last of its file and not
intact; no rows give no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.text import buffers
from evenkeel.operators.runtime import settle, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_M, _E = MAGIC.encode(), END.encode()

#: fixed values: the base-32 digits of conv() and of RFC 4648
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    hexed = F.sha1(value)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, RFC_DIGITS)


def records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """One column ``value``: the record of every row, without its closing separator."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    key = F.when(F.octet_length("body") >= least, F.sha2("body", 256))
    shared = settle(rows.select("id", key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("key", "first"))
    joined = rows.withColumn("key", key).join(shared, "key", "left")
    revisit = F.coalesce(F.col("id").isNull() & F.col("first").isNotNull() | (F.col("id") != F.col("first")), F.lit(False))
    clean = F.coalesce("url", F.lit(""))
    for c in [*range(0x21), 0x7F]:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    urn = lambda c: F.concat(F.lit("<urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "body"))
    return joined.withColumn("http", http).select(F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn("id"), F.lit("\r\nWARC-Target-URI: "), clean, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("body")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("first"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block).alias("value"))


def write(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write the archives, by default to a new folder under the shared one; returns the folder."""
    path = path or f"{shared_dir(pages.sparkSession).rstrip('/')}/evenkeel/warc-{uuid.uuid4().hex}"
    records(pages, **columns).write.option("lineSep", END).text(path)
    return path


_LENGTH = re.compile(rb"\nContent-Length: *(\d+)")
_FIELDS = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
_PIECES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("total", pa.int64()),
    ("whole", pa.bool_()), ("head", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())])
_PIECES_DDL = "file string, block long, rel long, next long, exit long, total long, whole boolean, head string, bytes long, digest string"


def _header(piece: bytes) -> tuple[int, int, str]:
    """Where the block begins, the length it should have, and the header; (-1, 0, "") if this is no record."""
    at = piece.find(_E)
    fields = dict(_FIELDS.findall(piece[:at].replace(b"\r\n", b"\n"))) if at >= 0 else {}
    length = fields.get(b"Content-Length", b"")
    if not length.isdigit() or b"WARC-Type" not in fields or b"WARC-Record-ID" not in fields:
        return -1, 0, ""
    return at + 4, int(length), piece[:at].decode("utf-8", "replace")


def _payload(block: bytes, response: bool) -> tuple[int | None, str | None]:
    """Length and digest of the full payload: of a response from its bytes, of a revisit record the length that its block names."""
    if not response:
        said = _LENGTH.search(block)
        return int(said[1]) if said else None, None
    body = block[block.find(_E) + 4:]
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def _pieces(keep_text: bool):
    """Candidates of each split with their contracted pointers, or every piece with its place and text."""

    def out(split, rows):
        rel, nxt, size, *rest = zip(*rows)
        where = {r: i for i, r in enumerate(rel)}
        leave = list(nxt)
        for i in range(len(rows) - 1, -1, -1):  # successors lie ahead, so their exits are known
            j = where.get(nxt[i])
            if j is not None and j > i:
                leave[i] = leave[j] if leave[j] is not None else None
        total = rel[-1] + size[-1]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            ([split[0]] * len(rows), [split[1]] * len(rows), rel, nxt, leave, [total] * len(rows), *rest), _PIECES)], schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rel, rows = None, 0, []
        for batch in batches:
            data, offsets = buffers(batch.column("value"))
            view = memoryview(data)
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            for i in range(batch.num_rows):
                if (files[i], blocks[i]) != split:
                    if rows:
                        yield out(split, rows)
                    split, rel, rows = (files[i], blocks[i]), 0, []
                piece = bytes(view[offsets[i]:offsets[i + 1]])
                size = len(piece) + len(_M)
                if keep_text:
                    rows.append((rel, None, size, False, piece.decode("utf-8", "replace"), None, None))
                else:
                    at, length, head = _header(piece)
                    if at < 0:
                        rows.append((rel, None, size, False, None, None, None))
                    else:
                        whole = at + length + len(_E) == len(piece)
                        about = _payload(piece[at:at + length], "WARC-Type: response" in head) if whole else (None, None)
                        rows.append((rel, rel + at + length + len(_E) + len(_M), size, whole, head, *about))
                rel += size
        if rows:
            yield out(split, rows)

    return run


def _scan(spark: SparkSession, path: str, keep_text: bool) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.mapInArrow(_pieces(keep_text), _PIECES_DDL)


_WALKED = "file string, block long, addr long, owner long, chained boolean"


def _walk(key, group):
    """One split: which candidates are on the chain from its entry, and to which record each piece belongs (null: to one of an earlier split)."""
    addr, nxt = (group.column(c).to_numpy() for c in ("addr", "to"))
    order = np.argsort(addr)
    addr, nxt = addr[order], nxt[order]
    entry = group.column("entry")[0].as_py()
    owner, chained = np.full(len(addr), -1), np.zeros(len(addr), bool)
    i = int(np.searchsorted(addr, entry)) if entry is not None else len(addr)
    while i < len(addr):
        chained[i] = True
        j = int(np.searchsorted(addr, nxt[i]))
        owner[i:j] = addr[i]
        if j < len(addr) and (addr[j] != nxt[i] or np.isnan(nxt[j])):
            break  # no record where one must begin: the chain of this file ends
        i = j
    n = len(addr)
    return pa.table({
        "file": [key[0].as_py()] * n, "block": [key[1].as_py()] * n, "addr": pa.array(addr, pa.int64()),
        "owner": pa.array(owner, pa.int64(), mask=owner < 0), "chained": pa.array(chained)})


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, intact) of every record on its file's chain. Length and digest of a response are
    those of the bytes read, ``intact`` says that its header agrees; a revisit record has both in its headers."""
    found = settle(_scan(spark, path, False))
    splits = found.select("file", "block", "total").distinct()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(splits.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = found.join(bases, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("rel")).alias("addr"), (F.col("base") + F.col("next")).alias("to"),
        (F.col("base") + F.col("exit")).alias("exit"), "whole", "head", "bytes", "digest")
    candidates = placed.where("to IS NOT NULL")
    # a file begins with the magic line, so its first record's text starts right after it
    starts = candidates.where(F.col("addr") == len(_M)).select("file", "addr")
    targets = candidates.select("file", F.col("exit").alias("addr")).distinct()
    nodes = settle(candidates.join(targets.unionByName(starts).distinct(), ["file", "addr"]).select("file", "block", "addr", "exit"))
    ends = nodes.select("file", F.col("addr").alias("exit"))
    jump = settle(nodes.join(ends, ["file", "exit"]).select("file", "addr", F.col("exit").alias("to")))
    reached = starts
    while not jump.isEmpty():
        reached = settle(reached.unionByName(reached.join(jump, ["file", "addr"]).select("file", F.col("to").alias("addr"))).distinct())
        jump = settle(jump.join(jump.select("file", F.col("addr").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "addr", F.col("far").alias("to")))
    entries = nodes.join(reached, ["file", "addr"]).groupBy("file", "block").agg(F.min("addr").alias("entry"))
    pointers = placed.select("file", "block", "addr", F.col("to").cast("double").alias("to")).join(entries, ["file", "block"], "left")
    walked = settle(pointers.groupBy("file", "block").applyInArrow(_walk, _WALKED))
    kept = walked.where("chained").join(placed, ["file", "block", "addr"]).select("file", "addr", "to", "whole", "head", "bytes", "digest")

    # records that a magic line inside the payload has cut
    last = walked.groupBy("file", "block").agg(F.max(F.when(F.col("chained"), F.col("addr"))).alias("last"))
    carried = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_at = last.select("file", "block", F.last("last", ignorenulls=True).over(carried).alias("open"))
    owned = walked.join(open_at, ["file", "block"]).select("file", "block", "addr", F.coalesce("owner", "open").alias("owner"))
    cut = kept.where(~F.col("whole")).select("file", F.col("addr").alias("owner"), "to")
    parts = settle(owned.join(cut, ["file", "owner"]).where("addr < to").join(bases, ["file", "block"]).select(
        "file", "block", (F.col("addr") - F.col("base")).alias("rel"), "addr", "owner"))
    if parts.isEmpty():
        joined = kept
    else:
        texts = _scan(spark, path, True).select("file", "block", "rel", F.col("head").alias("text")).join(parts, ["file", "block", "rel"])
        whole = texts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("addr", "text"))).alias("parts")).select(
            "file", F.col("owner").alias("addr"), F.concat_ws(MAGIC, F.transform("parts", lambda p: p["text"])).alias("text"))
        after = lambda c: F.expr(f"substring({c}, instr({c}, '\\r\\n\\r\\n') + 4)")
        body = whole.withColumn("block", after("text")).withColumn("body", after("block"))
        body = body.withColumn("body", F.expr("left(body, length(body) - 4)"))
        joined = kept.join(body.select("file", "addr", F.octet_length("body").cast("long").alias("_bytes"), base32_sha1(F.col("body")).alias("_digest")), ["file", "addr"], "left").select(
            "head", F.coalesce("bytes", "_bytes").alias("bytes"), F.coalesce("digest", "_digest").alias("digest"))
    field = lambda name, pattern: F.regexp_extract("head", rf"(?m)^{name}:[ \t]*{pattern}", 1)
    kind, said = field("WARC-Type", r"(\w+)"), field("WARC-Payload-Digest", r"sha1:(\w+)")
    number = lambda c: F.when(c != "", c.cast("long"))
    response = kind == "response"
    return joined.select(
        number(field("WARC-Record-ID", r"<urn:row:(-?\d+)>")).alias("id"), kind.alias("record_type"),
        number(field("WARC-Refers-To", r"<urn:row:(-?\d+)>")).alias("refers_to"), F.col("bytes").alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(said).alias("payload_digest"), (~response | (F.col("digest") == said)).alias("intact"))
