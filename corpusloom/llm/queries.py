"""The queries op1 to op13: each operator over its whole table, and the SQL of its result where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe_codec, decontaminate, html_extract, line_dedup, near_dedup, quality_cnn, quality_rules, secret_scan, simhash, token_files, toxicity, vector_codes, whitening
from corpusloom.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.selectExpr("doc_id", "_held_out AS held_out", "_score AS score", "_predicted AS predicted")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = html_extract.extract(table(spark, sf_dir, "pages"))
    return extracted.selectExpr("page_id", "url", "_main AS text", "CAST(char_length(_main) AS BIGINT) AS n_chars")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.write_and_read(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_codec.digests(bpe_codec.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.dedup(table(spark, sf_dir, "documents")))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.selectExpr("doc_id", "_held_out AS held_out", "_score AS score", "_predicted AS predicted")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.classes(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(*whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_html_extract, op3_token_files, op4_decontaminate, op5_quality_rules, op6_bpe_codec, op7_secret_scan, op8_line_dedup, op9_quality_cnn, op10_near_dedup,
        op11_simhash, op12_whitening, op13_vector_codes,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op4_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, sizes WHERE len(ws) >= n)
),
hit AS (SELECT DISTINCT doc_id, item_id, p, n FROM occ JOIN win USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_line_dedup": f"""
WITH l AS (
  SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
),
often AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN often ON l.k = often.k GROUP BY doc_id
""",
}


def _codes_sql() -> str:
    """Rounds of nearest entries and of means: a_k are the assignments to the codebooks b_k."""
    nearest = """a{k} AS MATERIALIZED (
  SELECT r, vec_id, label, part, x, min(d) AS error, arg_min(entry, d * 256 + entry) AS entry
  FROM (SELECT r, vec_id, label, v.part, v.x, entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - e.x[i]) * (v.x[i] - e.x[i]))) AS d FROM v JOIN b{k} e ON e.part = v.part)
  GROUP BY r, vec_id, label, part, x
)"""
    update = """b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS x FROM (
      SELECT part, entry, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
      FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry
)"""
    steps = [nearest.format(k=0)]
    for k in range(4):
        steps += [update.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return f"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS xs
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
v AS MATERIALIZED (SELECT r, vec_id, label, part, xs[part * len(xs) // 4 + 1:(part + 1) * len(xs) // 4] AS x FROM w, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM v WHERE r <= 256),
{", ".join(steps)},
out AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a4 GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256
FROM out
"""


SQL["op13_vector_codes"] = _codes_sql()
