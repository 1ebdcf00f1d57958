"""The registered queries of this subpackage, their DuckDB counterparts, and what the pipeline's stages need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, katz, langid, packing, pii, runindex, simhash, topk, toxicity, warc
from .common import table


def id_crc(mod: int, name: str = "doc_id"):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % mod


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.duplicate_spans(table(spark, sf_dir, "documents")).drop("starts", "ends")


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT r, doc_id, k, substring(h, 512 * k + 1, 610) AS part FROM (SELECT r, doc_id, h, unnest(range(0, 1 + length(h) // 512)) AS k FROM d WHERE doc_id IS NOT NULL)),
s AS (SELECT r, doc_id, 256 * k + p AS p, substring(part, 2 * p + 1, 100) AS t FROM (SELECT r, doc_id, k, part, unnest(range(0, greatest(0, length(part) // 2 - 49))) AS p FROM block)),
first AS (SELECT t, min(doc_id) AS least FROM s GROUP BY t),
hit AS (SELECT r, p FROM s JOIN first USING (t) WHERE least < doc_id),
mark AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM hit),
span AS (
  SELECT r, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM mark) GROUP BY r, g),
part AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM span
  UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(length(h) // 2) FROM d LEFT JOIN span ON span.r = d.r GROUP BY d.r),
kept AS (SELECT part.r, sha256(unhex(string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS sha FROM part JOIN d ON d.r = part.r GROUP BY part.r),
gone AS (SELECT r, sum(b - a) AS n, count(*) AS k FROM span GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN gone ON gone.r = d.r
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
cand AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hits AS (SELECT c.r, c.i, c.n, win.item_id FROM cand c JOIN win ON win.n = c.n AND win.s = c.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
it AS (
  SELECT r, count(s) AS n_items, sha256(coalesce(string_agg(s, ',' ORDER BY s), '')) AS sha
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, id_crc(4) != 2, langid.load_pieces(tokenizer_path("piece_bpe_32k.model")))
    held_out = F.coalesce(id_crc(4) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"))
    revisit = F.col("response.type") == "revisit"
    page = lambda of: F.col(f"{of}.fields")["page-id"].cast("long")
    return captures.select(
        page("metadata").alias("page_id"),
        F.when(revisit, F.col("origin.http_length")).otherwise(F.col("response.http_length")).alias("payload_bytes"),
        F.when(revisit, F.col("origin.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page("origin").alias("refers_to"),
    )


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0)
)
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS best FROM d WINDOW w AS (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest, CASE WHEN n > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 THEN best END AS refers_to
FROM m
"""


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), id_crc(7) != 2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, id_crc(3) != 1)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.coalesce(id_crc(3), F.lit(-1)) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_katz": op8_katz,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op1_repeats": OP1_SQL, "op2_decontamination": OP2_SQL, "op5_topk": OP5_SQL, "op7_warc": OP7_SQL}
