"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import embedding_dedup, importance, lm_score, merkle, packing, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(id).cast("long").cast("string").cast("binary")) % n


def ascii_lower():
    """A-Z in lower case, all other characters as they are."""

    @F.arrow_udf("string")
    def lowered(text: pa.Array) -> pa.Array:
        return pc.ascii_lower(text)

    return lowered


@query("op1_substring_dedup", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM words),
wins AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 12 <= len(w) THEN array_to_string(w[pos:pos + 12], ' ') END AS win FROM each),
first AS (SELECT win, min(doc_id) AS first FROM wins WHERE win IS NOT NULL GROUP BY win),
hit AS (SELECT a.doc_id, a.pos, a.word, coalesce(f.first < a.doc_id, false) AS again FROM wins a LEFT JOIN first f ON f.win = a.win),
gone AS (SELECT doc_id, pos, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id""")
def op1(spark, sf_dir):
    return substring_dedup.remove(table(spark, sf_dir, "documents"), digest=True).select(
        "row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query("op2_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op2(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    """Ids of every text, decoded again and held against the sentencepiece library."""
    found = sentencepiece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("row.doc_id", "n_tokens", "ids_crc32", "round_trip", "parity")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * (i // 8)}, 10))::BIGINT >> {35 - 5 * (i % 8)}) & 31)::INT, 1)" for i in range(32))


@query("op4_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html""")
def op4(spark, sf_dir):
    archive = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, archive).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_sharding")
def op5(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)


@query("op7_simhash")
def op7(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


TOXIC_FROM = 0.3


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "row.doc_id", (fold(4, "row.doc_id") == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op9_lm_score")
def op9(spark, sf_dir):
    found = lm_score.score(table(spark, sf_dir, "documents"), fold(5) != 1)
    return found.select(
        F.col("id").alias("doc_id"), (fold(5, "id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id""")
def op10(spark, sf_dir):
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of texts in SQL: bytes times their distance from the end, XORed, and a constant of the length
_CRC_SQL = """bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
one AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
away(d, b, c) AS (SELECT 0, b, c FROM one UNION ALL SELECT d + 1, a.b, xor(a.c >> 8, o.c) FROM away a JOIN one o ON o.b = a.c & 255 WHERE d + 1 < (SELECT max(strlen(v)) FROM crc_of)),
zeros(n, c) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(z.c >> 8, o.c) FROM zeros z JOIN one o ON o.b = z.c & 255 WHERE n < (SELECT max(strlen(v)) FROM crc_of)),
spread AS (SELECT v, h, unnest(range(len(h) // 2)) AS i FROM (SELECT v, hex(encode(v)) AS h FROM crc_of)),
summed AS (SELECT v, bit_xor(a.c) AS c FROM spread s JOIN away a ON a.d = len(h) // 2 - 1 - i AND a.b = ('0x' || substr(h, 2 * i + 1, 2))::INT GROUP BY v),
crc AS MATERIALIZED (SELECT v, xor(xor(s.c, z.c), 4294967295)::BIGINT AS crc FROM summed s JOIN zeros z ON z.n = strlen(v))"""


def _field(expr: str) -> str:
    return f"coalesce(strlen({expr}::VARCHAR)::VARCHAR || ':' || {expr}::VARCHAR, '-')"


_TAMPERED = _LOWER.format("text")


@query("op11_merkle", f"""
WITH RECURSIVE crc_of AS MATERIALIZED (SELECT DISTINCT doc_id::VARCHAR AS v FROM documents WHERE doc_id IS NOT NULL),
{_CRC_SQL},
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
  SELECT doc_id, lang, sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
    sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', _TAMPERED)))}) AS changed FROM documents)),
nodes(lang, lvl, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 8, n),
sub AS MATERIALIZED (SELECT lang, lvl AS high, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM sub UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 8, n),
runs AS MATERIALIZED (SELECT lang, 0 AS top, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, 1, lvl, pos // 8, list(h ORDER BY pos) FROM tops WHERE n > 1 GROUP BY ALL),
climb(doc_id, lang, leaf, own, top, lvl, pos, h, proof) AS (
  SELECT l.doc_id, l.lang, leaf, l.pos, 0, 0, l.pos, CASE WHEN c.crc % 3 = 0 THEN changed ELSE leaf END, '' FROM leaves l LEFT JOIN crc c ON c.v = l.doc_id::VARCHAR
  UNION ALL SELECT c.doc_id, c.lang, c.leaf, c.own, c.top + (r.hs IS NULL)::INT, CASE WHEN r.hs IS NULL THEN 0 ELSE c.lvl + 1 END, CASE WHEN r.hs IS NULL THEN s.pos ELSE c.pos // 8 END,
    CASE WHEN r.hs IS NULL THEN c.h ELSE sha256(array_to_string(r.hs[:(c.pos % 8)::INT], '') || c.h || array_to_string(r.hs[(c.pos % 8)::INT + 2:], '')) END,
    CASE WHEN r.hs IS NULL THEN c.proof ELSE c.proof || array_to_string(r.hs[:(c.pos % 8)::INT], '') || array_to_string(r.hs[(c.pos % 8)::INT + 2:], '') END
  FROM climb c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN runs r ON r.top = c.top AND r.lvl = c.lvl AND r.run = c.pos // 8 AND (c.top = 1 OR r.lang IS NOT DISTINCT FROM c.lang) WHERE c.top < 2)
SELECT c.doc_id, c.leaf, s.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climb c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang JOIN tops t ON t.n = 1 WHERE c.top = 2""")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    picked = fold(3) == 0
    tampered = merkle.leaf(fields | {"text": ascii_lower()(F.when(picked, F.col("text")))})
    found = merkle.manifest(docs, "doc_id", "lang", merkle.leaf(fields), {"changed": F.when(picked, tampered)}).proofs()
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("row.changed", "leaf"), F.col("path")))
    return folded.select(F.col("row.id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_token_counts")
def op12(spark, sf_dir):
    found = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


_WORDS_SQL = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op13_importance", f"""
WITH RECURSIVE src AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS_SQL} AS w FROM documents),
tgt AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
feats AS MATERIALIZED (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS v FROM src),
goal AS MATERIALIZED (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS v FROM tgt),
crc_of AS MATERIALIZED (SELECT v FROM feats UNION SELECT v FROM goal),
{_CRC_SQL},
hashed AS MATERIALIZED (SELECT row, crc % 10000 AS b FROM feats JOIN crc USING (v)),
s AS (SELECT b, count(*) AS s FROM hashed GROUP BY b),
t AS (SELECT crc % 10000 AS b, count(*) AS t FROM goal JOIN crc USING (v) GROUP BY 1),
gain AS MATERIALIZED (SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t ON t.b = s.b),
weight AS (SELECT row, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS w FROM hashed JOIN gain USING (b) GROUP BY row),
scored AS (SELECT src.row, doc_id, len(src.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight.w, 0) AS weight,
  coalesce(weight.w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM src LEFT JOIN weight ON weight.row = src.row),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 25 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (row)""")
def op13(spark, sf_dir):
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least=20, seed=7)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
