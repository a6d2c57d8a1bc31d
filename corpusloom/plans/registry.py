"""All registered queries of the retrieval and verification operators, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.tables import saved, small
from corpusloom.operators import assembly as A
from corpusloom.operators import chunking as K
from corpusloom.operators import claims as M
from corpusloom.operators import counting as N
from corpusloom.operators import display as P
from corpusloom.operators import evaluation as V
from corpusloom.operators import evidence as E
from corpusloom.operators import retrieval as R
from corpusloom.operators import rulings as G
from corpusloom.operators import vectors as W
from corpusloom.plans import drafting, lookup  # noqa: F401  they register their queries
from corpusloom.plans import sql as S
from corpusloom.plans.base import QUERIES, SQL, query  # noqa: F401
from corpusloom.plans.lookup import arabic, arabic_sql
from corpusloom.sources import corpus as C
from corpusloom.sources import readers as X
from corpusloom.streaming import jobs as J


# --- corpus ---------------------------------------------------------------------------------------


def _sources(spark, d):
    docs = C.read(spark, d, "documents")
    return docs.groupBy(F.col("source").alias("source_id")).agg(F.min("lang").alias("name"))


@query(f"""WITH {S.PASSAGES}, src AS (SELECT n_name AS source_id FROM nation)
SELECT 'unknown source' AS rule, id AS key FROM p WHERE source_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'unknown kind', id FROM p WHERE kind NOT IN ('en', 'de')
UNION ALL SELECT 'passage without text', id FROM p WHERE trim(text) = ''
UNION ALL SELECT 'no passages', source_id FROM src WHERE source_id NOT IN (SELECT source_id FROM p)
UNION ALL SELECT 'passage id repeated', id FROM p GROUP BY id HAVING count(*) > 1""")
def a9_validate_corpus(spark, d):
    """Passages checked against a table of sources that isn't theirs, so that every rule has something to find."""
    sources = C.read(spark, d, "nation").select(F.col("n_name").alias("source_id"), F.col("n_name").alias("name"))
    kinds = spark.createDataFrame([("en",), ("de",)], "kind string")
    return C.validate(sources, C.passages(spark, d), kinds)


@query(f"""WITH {S.PASSAGES}, e AS (SELECT source AS source_id, 25 * count(*) AS expected FROM documents GROUP BY source),
f AS (SELECT source_id, count(*) AS found FROM p GROUP BY source_id)
SELECT source_id, expected, coalesce(found, 0) AS found FROM e LEFT JOIN f USING (source_id) WHERE coalesce(found, 0) < expected""")
def a10_completeness_gate(spark, d):
    expected = C.read(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg((25 * F.count("*")).alias("expected"))
    return C.completeness(C.passages(spark, d), expected)


@query("""SELECT c_custkey, string_agg(p_brand, '; ' ORDER BY f, p_brand) AS p_brand FROM (
  SELECT o_custkey AS c_custkey, p_brand, min((o_orderdate, l_orderkey, l_linenumber)) AS f
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand) GROUP BY c_custkey""")
def a14_topic_keywords(spark, d):
    """Per customer, the brands bought, each once, in the order first bought."""
    rows = C.read(spark, d, "orders").join(C.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(C.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("o_custkey").alias("c_custkey"), "p_brand", "o_orderdate", "l_orderkey", "l_linenumber")
    return C.ordered_distinct("p_brand", ["o_orderdate", "l_orderkey", "l_linenumber"], ["c_custkey"], rows, "; ")


@query(f"""WITH {S.PASSAGES} SELECT text, min(rid) AS first_rid, max(rid) AS last_rid, count(*) AS n_rows, arg_min(source_id, rid) AS source_id FROM p GROUP BY text""")
def a15_group_identical_text(spark, d):
    return C.group_identical(C.passages(spark, d))


@query(f"""WITH {S.PASSAGES}, live AS (SELECT rid, id, source_id, text FROM p),
cand AS (SELECT conv_id * 1000 + turn AS rid, conv_id || '/' || turn AS id, role AS source_id, text FROM conversations),
s AS (SELECT source_id, count(*) AS n, min(rid) AS f FROM cand WHERE source_id NOT IN (SELECT source_id FROM live) GROUP BY source_id),
o AS (SELECT source_id, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT * FROM live UNION ALL
SELECT CAST((SELECT max(rid) FROM live) + b + row_number() OVER (PARTITION BY source_id ORDER BY rid) AS BIGINT), id, source_id, text FROM cand JOIN o USING (source_id)""")
def a16_merge_corpora(spark, d):
    """Passages of documents, with the turns of conversations appended as new sources."""
    live = C.passages(spark, d).select("rid", "id", "source_id", "text")
    turns = C.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("role").alias("source_id"), "text")
    return C.merge(live, turns)


@query(f"""WITH {S.PASSAGES}, b AS (SELECT CAST(floor(rid / 100000) AS BIGINT) AS part, count(*) AS n, sha256(string_agg(sha256(id || chr(9) || text), '' ORDER BY rid)) AS h FROM p GROUP BY 1)
SELECT CAST(floor(part / 100) AS BIGINT) AS stretch, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(h, '' ORDER BY part)) AS digest FROM b GROUP BY 1""")
def a17_corpus_fingerprint(spark, d):
    return C.fingerprint(C.passages(spark, d))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
 '(?is)<(script|style|head)\b.*?</(?:script|style|head)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/article|/section)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages""")
def a20_extract_html(spark, d):
    return C.extract_html(C.read(spark, d, "pages"))


@query(f"""WITH {S.PASSAGES}, s AS (SELECT rid, location, text, last_value(CASE WHEN length(text) < 40 THEN text END IGNORE NULLS) OVER (PARTITION BY location ORDER BY rid) AS h FROM p)
SELECT rid, location FROM s WHERE h IS NULL OR NOT regexp_matches(h, '^[A-E]')""")
def a5_skip_sections(spark, d):
    """Short lines taken as headings; the sections under those that begin with A to E go."""
    rows = C.passages(spark, d).withColumn("heading", F.when(F.char_length("text") < 40, F.col("text")))
    return X.skip_sections(rows, "location", "rid", "heading", "^[A-E]").select("rid", "location")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN d.lang = 'en' THEN coalesce(b.text, '') ELSE '' END AS translation FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def a12_attach_translations(spark, d):
    """Benchmark texts as the translations of English documents of the same number."""
    docs = C.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"))
    texts = C.read(spark, d, "benchmark").select(F.lit("xx").alias("lang"), F.col("item_id").cast("string").alias("passage_id"), "text")
    return X.attach_translations(docs, texts, "xx", "en").select("id", "translation")


@query(f"""WITH {S.PASSAGES} SELECT id, CASE WHEN kind = 'es' THEN 'unverified' WHEN kind = 'fr' THEN 'mismatch' ELSE 'matches' END AS state FROM p""")
def a18_stamp_check(spark, d):
    """Vectors stamped with the text's digest, with that of other text (fr), and not at all (es)."""
    items = C.passages(spark, d)
    stamp = F.when(F.col("kind") == "es", None).when(F.col("kind") == "fr", F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2("text", 256))
    return X.stamp_check(items.select("id", stamp.alias("text_sha")), items)


# --- text -----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.normal('text')} AS text FROM documents")
def b1_normalize(spark, d):
    return C.read(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def b2_tokenize(spark, d):
    rows = C.read(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"""WITH w AS (SELECT item_id, regexp_extract_all(text, '\\S+') AS w, string_split_regex(text, '\\S+') AS g FROM benchmark),
x AS (SELECT item_id, w[i] AS raw, list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda s: length(s))), 0) AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT item_id, {S.normal('raw')} AS w, CAST(s AS BIGINT) AS s, CAST(s + length(raw) AS BIGINT) AS e FROM x WHERE {S.normal('raw')} <> ''""")
def b3_word_offsets(spark, d):
    rows = C.read(spark, d, "benchmark").select("item_id", F.explode(T.words_with_offsets(F.col("text"))).alias("x"))
    return rows.select("item_id", "x.w", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


@query("""SELECT conv_id, turn, trim(trim(regexp_replace(replace(text, 'ـ', ''), '\\s+', ' ', 'g')), ' ' || chr(9) || chr(10) || '.,!?؟،؛:«»"''()') AS identity FROM conversations""")
def b5_answer_identity(spark, d):
    return C.read(spark, d, "conversations").select("conv_id", "turn", T.answer_identity(F.col("text")).alias("identity"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0679}\x{0688}\x{0691}\x{06BA}\x{06BE}\x{06C1}\x{06D2}\x{06D3}]') THEN 'ur' WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'ar'
 WHEN regexp_matches(text, '[A-Za-z]{2,}') THEN 'en' ELSE lang END AS script,
 CASE WHEN length(regexp_replace(text, '[^A-Za-z\x{0600}-\x{06FF}]', '', 'g')) = 0 THEN false
 WHEN lang = 'en' THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.5 * length(regexp_replace(text, '[^A-Za-z\x{0600}-\x{06FF}]', '', 'g'))
 ELSE length(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g')) >= 0.6 * length(regexp_replace(text, '[^A-Za-z\x{0600}-\x{06FF}]', '', 'g')) END AS fits FROM documents""")
def b9_script_language(spark, d):
    """B9 and B10: the script's language, and whether the letters fit the language on record."""
    return C.read(spark, d, "documents").select("doc_id", T.script_language(F.col("text"), F.col("lang")).alias("script"), T.language_share_ok(F.col("text"), F.col("lang")).alias("fits"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
 '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[ \t\x{00A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents""")
def b13_clean_print(spark, d):
    return C.read(spark, d, "documents").select("doc_id", T.clean_print(F.col("text")).alias("text"))


@query(rf"""WITH {S.PASSAGES}, s AS (SELECT *, CASE WHEN lag(text) OVER w IS NULL OR regexp_matches(lag(text) OVER w, '[.!?؟:»"]\s*$') THEN 1 ELSE 0 END AS b FROM p WINDOW w AS (PARTITION BY location ORDER BY rid)),
i AS (SELECT *, sum(b) OVER (PARTITION BY location ORDER BY rid) AS island FROM s)
SELECT location, min(rid) AS first_rid, count(*) AS n_joined, regexp_replace(string_agg(text, ' ' ORDER BY rid), ' +([,،])', '\1', 'g') AS text FROM i GROUP BY location, island""")
def c4_join_cut_sentences(spark, d):
    return C.join_cut(C.passages(spark, d))


@query(f"""WITH RECURSIVE {S.PASSAGES}, o AS (SELECT location, text, row_number() OVER (PARTITION BY location ORDER BY rid) AS k FROM p),
r AS (SELECT location, k, 0 AS chunk, length(text) AS n FROM o WHERE k = 1
 UNION ALL SELECT o.location, o.k, CASE WHEN n + 1 + length(text) > 1200 THEN chunk + 1 ELSE chunk END, CASE WHEN n + 1 + length(text) > 1200 THEN length(text) ELSE n + 1 + length(text) END FROM r JOIN o ON o.location = r.location AND o.k = r.k + 1)
SELECT location, chunk, string_agg(text, chr(10) ORDER BY k) AS text FROM r JOIN o USING (location, k) GROUP BY location, chunk""")
def c1_pack_paragraphs(spark, d):
    return K.pack_paragraphs(C.passages(spark, d))


@query(f"""WITH RECURSIVE {S.PASSAGES}, o AS (SELECT rid, ss[k] AS text, k FROM (SELECT rid, ss, unnest(range(1, len(ss) + 1)) AS k FROM (SELECT rid, CASE WHEN length(text) <= 300 THEN [text] ELSE string_split(regexp_replace(text, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS ss FROM p))),
r AS (SELECT rid, k, 0 AS part, length(text) AS n FROM o WHERE k = 1
 UNION ALL SELECT o.rid, o.k, CASE WHEN n + 1 + length(text) > 300 THEN part + 1 ELSE part END, CASE WHEN n + 1 + length(text) > 300 THEN length(text) ELSE n + 1 + length(text) END FROM r JOIN o ON o.rid = r.rid AND o.k = r.k + 1)
SELECT rid, part, string_agg(text, ' ' ORDER BY k) AS text FROM r JOIN o USING (rid, k) GROUP BY rid, part""")
def c2_split_sentences(spark, d):
    return C.passages(spark, d).select("rid", F.posexplode(K.split_sentences(F.col("text"), 300)).alias("part", "text"))


# --- retrieval ------------------------------------------------------------------------------------


@query(f"WITH {S.PASSAGES}, {S.QUESTIONS}, {S.TOKENS} SELECT token, rid, count(*) AS tf FROM tok GROUP BY token, rid")
def d1_postings(spark, d):
    return R.postings(C.passage_index(spark, d))


@query(f"WITH {S.BM25} SELECT qid, rid, score, coverage, rank FROM hits")
def d2_bm25(spark, d):
    """D2 and D3: the best ten passages for every question, with coverage."""
    return R.bm25(C.questions(spark, d), C.passage_index(spark, d))


@query(f"WITH {S.BM25} SELECT qid, coalesce(score >= 1.0 AND coverage >= 0.5, false) AS answered FROM q LEFT JOIN (SELECT * FROM hits WHERE rank = 1) USING (qid)")
def d4_sufficient(spark, d):
    asked = C.questions(spark, d)
    return R.sufficient(asked, R.bm25(asked, C.passage_index(spark, d)))


@query(f"WITH {S.PASSAGES}, {S.QUESTIONS}, {S.TOKENS} SELECT token, count(DISTINCT rid) AS df, count(DISTINCT rid) <= 5 AS rare FROM tok WHERE token IN (SELECT token FROM qt) GROUP BY token")
def d5_doc_frequency(spark, d):
    wanted = R.query_terms(C.questions(spark, d)).select("token").distinct()
    return C.passage_index(spark, d).frequencies_of(wanted).withColumn("rare", F.col("df") <= R.RARE)


@query(f"WITH {S.RUNS}, {S.PHRASES} SELECT qid, rid FROM ph")
def d6_phrase_match(spark, d):
    return R.phrase_match(C.questions(spark, d), C.passage_index(spark, d))


@query(f"""WITH {S.RUNS}, b AS (SELECT *, max(run) OVER (PARTITION BY qid) AS best FROM run WHERE run >= CASE WHEN n < 4 THEN n ELSE greatest(3, CAST(ceil(n / 2) AS BIGINT)) END)
SELECT DISTINCT qid, rid, run FROM b WHERE run = best""")
def d7_longest_subphrase(spark, d):
    return R.longest_subphrase(C.questions(spark, d), C.passage_index(spark, d))


@query(f"WITH {S.RUNS}, h AS (SELECT DISTINCT qid, rid FROM run WHERE run >= 4), c AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n_items FROM h) SELECT qid, rid, n_items FROM c WHERE n_items <= 60")
def d8_drop_common_phrases(spark, d):
    found = R.diagonals(C.questions(spark, d), C.passage_index(spark, d)).filter("run >= 4").select("qid", "rid").distinct()
    return R.drop_common(found)


@query(f"""WITH {S.BM25}, {S.RUNS[S.RUNS.index('qp AS'):]}, {S.PHRASES},
b AS (SELECT qid, rid, 0 AS tier, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rid) AS r FROM ph) WHERE r <= 8 UNION ALL SELECT qid, rid, 1, rank FROM hits),
o AS (SELECT qid, rid, min((tier, r)) AS a FROM b GROUP BY qid, rid)
SELECT qid, rid, a[1] AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a, rid) AS rank FROM o) WHERE rank <= 10""")
def d10_tiered_search(spark, d):
    asked, index = C.questions(spark, d), C.passage_index(spark, d)
    return R.tiered(R.phrase_match(asked, index), R.bm25(asked, index))


@query(f"WITH {S.PASSAGES}, {S.QUESTIONS}, {S.TOKENS} SELECT qid, rid FROM qt JOIN (SELECT DISTINCT token, rid FROM tok) USING (token) GROUP BY qid, rid HAVING count(*) = max(n_terms)")
def d20_all_words_match(spark, d):
    return R.all_words(C.questions(spark, d), C.passage_index(spark, d))


_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"
_KNN = f"""sim AS (SELECT q.vec_id AS qid, v.vec_id AS rid, round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM sim) WHERE rank <= 10)"""


_SPOILT = """bad AS (SELECT vec_id, CASE vec_id % 50 WHEN 7 THEN list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) WHEN 11 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
 WHEN 13 THEN list_concat(['NaN'::DOUBLE], list_transform(embedding[2:], lambda x: CAST(x AS DOUBLE))) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings)"""


@query(f"""WITH {_SPOILT}, r AS (SELECT vec_id, v, CASE WHEN len(v) <> 64 THEN 'dimension' WHEN len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN list_dot_product(v, v) = 0 THEN 'zero' END AS reason FROM bad)
SELECT vec_id, reason, CASE WHEN reason IS NULL THEN array_to_string(list_transform(v[1:4], lambda x: CAST(CAST(round(1000 * x / sqrt(list_dot_product(v, v))) AS BIGINT) AS VARCHAR)), ' ') END AS first FROM r""")
def e1_normalize_vectors(spark, d):
    """Vectors of which some were cut short, set to zero or spoilt; of the usable ones the first unit components in thousandths."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    n = F.col("vec_id") % 50
    spoilt = F.when(n == 7, F.slice(number, 1, 63)).when(n == 11, F.transform(number, lambda x: F.lit(0.0))).when(n == 13, F.concat(F.array(F.lit(float("nan"))), F.slice(number, 2, 63))).otherwise(number)
    rows = R.normalize_vectors(C.read(spark, d, "embeddings").select("vec_id", spoilt.alias("embedding")), 64)
    first = F.array_join(F.transform(F.slice("unit", 1, 4), lambda x: F.round(1000 * x).cast("long").cast("string")), " ")
    return rows.select("vec_id", "reason", F.when(F.col("reason").isNull(), first).alias("first"))


def _vectors(spark, d):
    v = C.read(spark, d, "embeddings")
    return v.filter("vec_id % 100 = 0"), v  # the stated query set: every id divisible by 100


@query(f"WITH {_KNN} SELECT qid, rid, score, rank FROM knn")
def e2_knn_exact(spark, d):
    return W.knn(*_vectors(spark, d))


@query(f"""WITH {_KNN}, c AS (SELECT q.vec_id AS qid, v.vec_id AS rid FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.label = v.label)
SELECT qid, rid, score, rank FROM (SELECT qid, rid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM sim JOIN c USING (qid, rid)) WHERE rank <= 10""")
def e4_rerank_exact(spark, d):
    """Candidates with the query's label, in the order of exact cosine."""
    asked, v = _vectors(spark, d)
    candidates = asked.select(F.col("vec_id").alias("qid"), "label").join(v.select(F.col("vec_id").alias("rid"), "label"), "label").select("qid", "rid")
    return W.rerank(candidates, asked, v)


@query()
def e5_ann_recall(spark, d):
    """E3 to E5: neighbours by codes of 512 hyperplanes, a twentieth of the vectors scored exactly (50 at least), and their recall against exact ones."""
    asked, v = _vectors(spark, d)
    return R.recall(W.knn_approx(asked, W.codes(v, 64)), W.knn(asked, v))


@query(f"""WITH {S.BM25}, {_KNN},
l AS (SELECT qid, rid, 0 AS list, rank FROM hits UNION ALL SELECT k.qid // 100 AS qid, p.rid, 1, min(k.rank) FROM knn k JOIN p ON p.location = k.rid GROUP BY 1, 2),
f AS (SELECT qid, rid, round(sum(1 / (60 + rank)), 12) AS score, coalesce(min(rank) FILTER (list = 0), 1 << 30) AS a, coalesce(min(rank) FILTER (list = 1), 1 << 30) AS b FROM l GROUP BY qid, rid)
SELECT qid, rid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, a, b, rid) AS rank FROM f) WHERE rank <= 10""")
def e6_rrf(spark, d):
    """Keyword hits fused with the passages of the nearest vectors' documents."""
    items = C.passages(spark, d)
    near = W.knn(*_vectors(spark, d)).select((F.col("qid") / 100).cast("long").alias("qid"), F.col("rid").alias("location"), "rank")
    vector = near.join(items.select("rid", "location"), "location").groupBy("qid", "rid").agg(F.min("rank").alias("rank"))
    return R.rrf([R.bm25(C.questions(spark, d), C.passage_index(spark, d)), vector])


@query(f"""WITH {S.BM25}, {_KNN}, v AS (SELECT k.qid // 100 AS qid, p.rid, min(k.rank) AS rank FROM knn k JOIN p ON p.location = k.rid WHERE (k.qid // 100) % 2 = 0 GROUP BY 1, 2),
l AS (SELECT qid, rid, 0 AS list, rank FROM hits WHERE qid IN (SELECT qid FROM v) UNION ALL SELECT qid, rid, 1, rank FROM v),
f AS (SELECT qid, rid, round(sum(1 / (60 + rank)), 12) AS score, coalesce(min(rank) FILTER (list = 0), 1 << 30) AS a, coalesce(min(rank) FILTER (list = 1), 1 << 30) AS b FROM l GROUP BY qid, rid)
SELECT qid, rid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, a, b, rid) AS rank FROM f) WHERE rank <= 10
UNION ALL SELECT qid, rid, NULL, rank FROM hits WHERE qid NOT IN (SELECT qid FROM v)""")
def e7_keyword_fallback(spark, d):
    """Every other question has a vector ranking; the rest keep their keyword hits."""
    items = C.passages(spark, d)
    near = W.knn(*_vectors(spark, d)).select((F.col("qid") / 100).cast("long").alias("qid"), F.col("rid").alias("location"), "rank").filter("qid % 2 = 0")
    vector = near.join(items.select("rid", "location"), "location").groupBy("qid", "rid").agg(F.min("rank").alias("rank"))
    return W.hybrid(R.bm25(C.questions(spark, d), C.passage_index(spark, d)), vector)


@query(f"""WITH {S.BM25}, h AS (SELECT qid, rid // 1000000 AS location, (rid % 1000000) // 5 AS part, rank FROM hits),
u AS (SELECT qid, location || '/' || part AS unit, min(rank) AS r FROM h GROUP BY 1, 2)
SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY r, unit) AS rank FROM u""")
def e8_map_to_units(spark, d):
    """Keyword hits mapped to units of five lines of a document."""
    items = C.passages(spark, d)
    line = F.col("rid") % C.LINES
    hits = R.bm25(C.questions(spark, d), C.passage_index(spark, d)).select("qid", F.floor(F.col("rid") / C.LINES).alias("location"), line.alias("line"), "rank")
    parts = items.select("location", F.floor(line / 5).alias("part")).distinct()
    ranges = parts.select(F.concat_ws("/", "location", "part").alias("unit"), "location", (F.col("part") * 5).alias("first"), (F.col("part") * 5 + 4).alias("last"))
    return W.map_to_units(hits, ranges)


@query("""WITH a AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 3 <> 0),
b AS (SELECT vec_id AS id, CASE vec_id % 20 WHEN 1 THEN list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) WHEN 2 THEN list_transform(embedding[1:60], lambda x: CAST(x AS DOUBLE)) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings WHERE vec_id % 5 <> 0),
i AS (SELECT vec_id AS id FROM embeddings)
SELECT 'dimension' AS rule, id FROM b WHERE len(v) <> 64
UNION ALL SELECT 'missing', id FROM i WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'disagree', a.id FROM a JOIN b ON a.id = b.id WHERE a.id % 2 = 1 AND len(b.v) = 64 AND round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) < 0.98
UNION ALL SELECT 'disagree', a.id FROM a JOIN b ON a.id = b.id WHERE a.id % 2 = 0 AND len(b.v) = 64 AND round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) < 0.98""")
def e9_stitch_violations(spark, d):
    """Two tables that lack some ids and disagree on others: what forbids putting them together, every shared id being compared."""
    v = C.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = F.col("id") % 20
    other = v.withColumn("embedding", F.when(n == 1, F.reverse("embedding")).when(n == 2, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")))
    return W.stitch_violations(v.filter("id % 3 <> 0"), other.filter("id % 5 <> 0"), v, 64)


@query("""SELECT doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'changed' END AS why FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL OR doc_id % 7 = 3""")
def e10_vector_delta(spark, d):
    """Documents that still need a vector; those of every seventh were made from another text."""
    docs, v = C.read(spark, d, "documents"), C.read(spark, d, "embeddings")
    stamp = F.sha2(F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256)
    made = docs.join(v.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", stamp.alias("made_from"))
    both = docs.select("doc_id", F.sha2("text", 256).alias("now")).join(made, "doc_id", "left")
    return both.filter("made_from IS NULL OR made_from <> now").select("doc_id", F.when(F.col("made_from").isNull(), "missing").otherwise("changed").alias("why"))


@query(f"WITH {S.PASSAGES} SELECT rid, 'title: ' || source_id || ' — ' || location || ' | text: ' || text AS text FROM p")
def e11_embedding_text(spark, d):
    return C.passages(spark, d).select("rid", F.format_string("title: %s — %s | text: %s", "source_id", "location", "text").alias("text"))


@query(f"""WITH {S.BM25}, l AS (SELECT qid // 4 AS question, CAST(qid % 4 AS BIGINT) AS list_no, rid, rank FROM hits),
o AS (SELECT question, rid, min((rank, list_no)) AS a FROM l GROUP BY question, rid)
SELECT question, rid, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY a, rid) AS place FROM o) WHERE place <= 20""")
def f1_round_robin_merge(spark, d):
    """Four questions' hits taken in turns as one."""
    hits = R.bm25(C.questions(spark, d), C.passage_index(spark, d))
    return R.round_robin(hits.select(F.floor(F.col("qid") / 4).alias("question"), (F.col("qid") % 4).alias("list_no"), "rid", "rank"), 20)


@query(f"""WITH {S.BM25}, h AS (SELECT qid, hits.rid, rank, kind = 'en' AS inside FROM hits JOIN p ON p.rid = hits.rid),
i AS (SELECT *, row_number() OVER (PARTITION BY qid, inside ORDER BY rank) AS i FROM h)
SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN inside THEN (i - 1) // 3 ELSE i - 1 END, inside DESC, i) AS place FROM i""")
def f3_domain_interleave(spark, d):
    items = C.passages(spark, d)
    hits = small(R.bm25(C.questions(spark, d), C.passage_index(spark, d))).join(items.select("rid", (F.col("kind") == "en").alias("inside")), "rid")
    return R.interleave(hits)


@query(f"""WITH {S.BM25}, h AS (SELECT qid, hits.rid, rank, kind = 'de' AS w FROM hits JOIN p ON p.rid = hits.rid),
t AS (SELECT *, CASE WHEN w AND row_number() OVER (PARTITION BY qid, w ORDER BY rank) <= 4 THEN 0 ELSE 1 END AS tier FROM h)
SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY tier, rank) AS place FROM t""")
def f5_wanted_first(spark, d):
    items = C.passages(spark, d)
    hits = small(R.bm25(C.questions(spark, d), C.passage_index(spark, d))).join(items.select("rid", (F.col("kind") == "de").alias("wanted")), "rid")
    return R.wanted_first(hits)


@query(f"""WITH {S.BM25}, l AS (SELECT qid // 4 AS question, CAST(qid % 4 AS BIGINT) AS list_no, rid, rank FROM hits), f AS (SELECT DISTINCT question, rid FROM l WHERE rank <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY question, list_no ORDER BY rank, rid) AS k FROM l ANTI JOIN f USING (question, rid))
SELECT question, rid, min(list_no) AS list_no FROM b WHERE k <= 4 GROUP BY question, rid""")
def f14_gap_hits(spark, d):
    hits = R.bm25(C.questions(spark, d), C.passage_index(spark, d))
    lists = hits.select(F.floor(F.col("qid") / 4).alias("question"), (F.col("qid") % 4).alias("list_no"), "rid", "rank")
    return R.gap_hits(lists, lists.filter("rank <= 2").select("question", "rid").distinct())


@query(f"WITH {S.PASSAGES} SELECT rid, lag(rid) OVER w AS previous, lead(rid) OVER w AS next FROM p WINDOW w AS (PARTITION BY location ORDER BY rid)")
def f6_neighbours(spark, d):
    return R.neighbours(C.passages(spark, d))


@query("""SELECT conv_id, turn, role, substring(text, 1, 600) AS text, r > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS r FROM conversations) WHERE b <= 6""")
def f12_history_window(spark, d):
    return R.history(C.read(spark, d, "conversations"))


_LISTS = "l AS (SELECT qid // 4 AS question, CAST(qid % 4 AS BIGINT) AS list_no, rid, rank FROM hits)"


def _lists(spark, d, items):
    """Four questions' hits as the lists of one question."""
    hits = R.bm25(C.questions(spark, d), C.passage_index(spark, d))
    return hits.select(F.floor(F.col("qid") / 4).alias("question"), (F.col("qid") % 4).alias("list_no"), "rid", "rank")


@query(f"""WITH {S.BM25}, {_LISTS}, o AS (SELECT question, rid, min((CASE WHEN list_no >= 2 AND rank <= 3 THEN 0 ELSE 1 END, rank, list_no)) AS a FROM l GROUP BY question, rid)
SELECT question, rid, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY a, rid) AS place FROM o) WHERE place <= 20""")
def f2_reserved_slots(spark, d):
    """The last two of four lists are parts of the question."""
    return A.reserved_slots(_lists(spark, d, C.passages(spark, d)).withColumn("part", F.col("list_no") >= 2), 20)


@query(f"""WITH {S.BM25}, pw AS (SELECT rid, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words FROM p) SELECT qid, hits.rid FROM hits JOIN p ON p.rid = hits.rid JOIN pw ON pw.rid = hits.rid WHERE hits.rid % 5 <> 0 AND (kind = 'de' OR n_words >= 4) AND coverage >= 0.34""")
def f4_hit_filters(spark, d):
    """Every fifth passage counts as a question part, German ones as primary."""
    items = C.passages(spark, d)
    hits = small(R.bm25(C.questions(spark, d), C.passage_index(spark, d))).join(items.select("rid", "kind", "text", (F.col("rid") % 5 != 0).alias("answer_part")), "rid")
    return A.usable_hits(hits, ["de"]).select("qid", "rid")


_PLACED = f"""{S.BM25}, {_LISTS}, fo AS (SELECT question, rid, min((rank, list_no)) AS a FROM l GROUP BY question, rid),
off AS (SELECT question, rid, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY a, rid) AS place FROM fo) WHERE place <= 20),
it AS (SELECT *, rid // 1000000 * 1000 + (rid % 1000000) // 4 AS heading, row_number() OVER (PARTITION BY location ORDER BY rid) AS line FROM p)"""


def _offered(spark, d):
    """Offered passages and all of them, four lines of a document under one heading."""
    items = C.passages(spark, d).withColumn("heading", F.floor(F.col("rid") / C.LINES) * 1000 + F.floor((F.col("rid") % C.LINES) / 4))
    return R.round_robin(_lists(spark, d, items), 20), items


@query(f"""WITH {_PLACED}, k AS (SELECT * FROM (SELECT question, it.location, it.heading, it.line, row_number() OVER (PARTITION BY question ORDER BY place) AS k FROM off JOIN it USING (rid) WHERE kind = 'en') WHERE k <= 4),
s AS (SELECT question, location, heading, k, step, line + step AS line FROM k, (SELECT unnest([-1, 1]) AS step)),
f AS (SELECT s.question, it.rid, min((k, step)) AS a FROM s JOIN it USING (location, line, heading) WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.question = s.question AND off.rid = it.rid) GROUP BY s.question, it.rid)
SELECT question, rid, nth FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY a) AS nth FROM f) WHERE nth <= 4""")
def f7_neighbour_fill(spark, d):
    offered, items = _offered(spark, d)
    return A.neighbour_fill(offered, items, "en")


@query(f"""WITH {_PLACED}, b AS (SELECT rid, kind, regexp_matches(text, '^[A-M]') AS opens, CASE WHEN lag(heading) OVER w = heading AND regexp_matches(lag(text) OVER w, '^[A-M]') THEN lag(rid) OVER w WHEN lag(heading, 2) OVER w = heading AND regexp_matches(lag(text, 2) OVER w, '^[A-M]') THEN lag(rid, 2) OVER w END AS opener FROM it WINDOW w AS (PARTITION BY location ORDER BY rid)),
u AS (SELECT question, rid, place AS pl, 1 AS after FROM off UNION ALL SELECT question, opener, place, 0 FROM off JOIN b USING (rid) WHERE kind = 'en' AND NOT opens AND opener IS NOT NULL),
o AS (SELECT question, rid, min((pl, after)) AS a FROM u GROUP BY question, rid)
SELECT question, rid, row_number() OVER (PARTITION BY question ORDER BY a, rid) AS place FROM o""")
def f8_issue_opener(spark, d):
    """Lines that begin with A to M open an issue."""
    offered, items = _offered(spark, d)
    return A.issue_openers(offered, items, "en", "^[A-M]")


@query(f"""WITH {_PLACED}, nq AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark),
tx AS (SELECT o.rid, coalesce(p.text, '') || ' «' || translate(nq.text, '«»"“”', '') || '»' AS text FROM (SELECT DISTINCT rid FROM off) o JOIN p USING (rid) JOIN nq ON o.rid % nq.n = nq.k),
alq AS (SELECT rid, list_transform(regexp_extract_all(text, '[«"“]([^«»"“”]+)[»"”]', 1), lambda x: trim(x)) AS qs FROM tx),
qts AS (SELECT rid, (list_filter(qs, lambda x: len(list_filter(string_split({S.normal('x')}, ' '), lambda w: w <> '')) >= 4))[1:12] AS qs FROM alq),
qu AS MATERIALIZED (SELECT rid, unnest(qs) AS quote, generate_subscripts(qs, 1) AS nth FROM qts),
dq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY quote) AS qid, quote FROM (SELECT DISTINCT quote FROM qu)),
qhits AS MATERIALIZED (WITH {S.BM25.replace(S.QUESTIONS, "q AS (SELECT qid, quote AS text FROM dq)")} SELECT qid, rid, rank FROM hits WHERE coverage >= 0.9),
f AS (SELECT qu.rid, h.rid AS quoted, row_number() OVER (PARTITION BY qu.rid ORDER BY qu.nth, h.rank) AS nth FROM qu JOIN dq USING (quote) JOIN qhits h USING (qid)),
q1 AS (SELECT question, quoted, min(place) AS pl FROM off JOIN (SELECT rid, arg_min(quoted, nth) AS quoted FROM f WHERE nth <= 3 GROUP BY rid) USING (rid) GROUP BY question, quoted),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pl, quoted) AS k FROM q1) WHERE k <= 2),
u AS (SELECT question, rid, place AS pl, 1 AS after FROM off UNION ALL SELECT question, quoted, pl, 0 FROM c), o AS (SELECT question, rid, min((pl, after)) AS a FROM u GROUP BY question, rid)
SELECT question, rid, row_number() OVER (PARTITION BY question ORDER BY a, rid) AS place FROM o""")
def f9_quoted_source_first(spark, d):
    """Every offered passage quotes a benchmark text besides what it quotes itself; quotations are taken out of the texts and searched for."""
    offered, items = _offered(spark, d)
    asked = C.questions(spark, d).select("qid", F.translate("text", "«»\"“”", "").alias("quote"))
    n = asked.count()
    placed = asked.withColumn("k", F.row_number().over(Window.orderBy("qid")) - 1).drop("qid")  # the questions: a stated set
    texts = offered.select("rid").distinct().join(items.select("rid", "text"), "rid").join(placed, F.col("rid") % n == F.col("k"))
    return A.quoted_source_first(offered, A.quoted_sources(texts.select("rid", F.concat("text", F.lit(" «"), "quote", F.lit("»")).alias("text")), C.passage_index(spark, d)))


@query("""WITH t AS (SELECT c_custkey AS key, split_part(c_name, '#', 1) || ' ' || c_custkey % 30 || '-' || (c_custkey % 30 + c_custkey % 4) || ' and Nobody 3, customer 7' AS text FROM customer),
r AS (SELECT key, 0 AS pos, c AS number FROM (SELECT c_custkey AS key, unnest(range(c_custkey % 30, c_custkey % 30 + c_custkey % 4 + 1)) AS c FROM customer) UNION ALL SELECT c_custkey, 2, 7 FROM customer),
k AS (SELECT key, n_nationkey AS number, min((pos, number)) AS a FROM r JOIN nation ON n_nationkey = number GROUP BY key, n_nationkey)
SELECT key, n.n_name AS id, row_number() OVER (PARTITION BY key ORDER BY a, n.n_name) AS nth FROM k JOIN nation n ON n.n_nationkey = k.number""")
def f10_verse_references(spark, d):
    """References like "Customer 4-6" in made sentences, resolved to nations of these numbers."""
    k = F.col("c_custkey")
    texts = C.read(spark, d, "customer").select(k.alias("key"), F.concat(F.substring_index("c_name", "#", 1), F.lit(" "), (k % 30).cast("string"), F.lit("-"), (k % 30 + k % 4).cast("string"), F.lit(" and Nobody 3, customer 7")).alias("text"))
    names = spark.createDataFrame([("customer", "unit")], "name string, unit string")
    items = C.read(spark, d, "nation").select(F.lit("unit").alias("unit"), F.col("n_nationkey").cast("int").alias("number"), F.col("n_name").alias("id"))
    return A.verse_references(texts, names, items)


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS unit, unnest(range(s_suppkey % 50, s_suppkey % 50 + 4)) AS number FROM supplier)
SELECT DISTINCT c_nationkey AS unit, c_custkey % 50 AS number FROM customer WHERE (c_nationkey, c_custkey % 50) NOT IN (SELECT (unit, number) FROM e)""")
def f11_missing_entry_report(spark, d):
    """Numbers asked for by customers of a nation that no supplier's range covers."""
    asked = C.read(spark, d, "customer").select(F.col("c_nationkey").alias("unit"), (F.col("c_custkey") % 50).cast("long").alias("number"))
    first = (F.col("s_suppkey") % 50).cast("long")
    return A.missing_entries(asked, C.read(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), first.alias("first"), (first + 3).alias("last")))


@query(f"""WITH {S.BM25}, h AS (SELECT qid // 4 AS question, hits.rid, min(rank) AS rank FROM hits JOIN p ON p.rid = hits.rid WHERE kind IN ('de', 'fr') AND coverage >= 0.6 GROUP BY 1, 2)
SELECT question, rid, nth FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rank, rid) AS nth FROM h) WHERE nth <= 4""")
def f13_pinned_hits(spark, d):
    items = C.passages(spark, d)
    hits = small(R.bm25(C.questions(spark, d), C.passage_index(spark, d))).join(items.select("rid", "kind"), "rid").withColumn("question", F.floor(F.col("qid") / 4))
    return A.pinned(hits, ["de", "fr"])


@query(f"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest({S.tokens('text')}) AS word FROM conversations) SELECT conv_id, min(turn) AS turn, word FROM w WHERE length(word) >= 4 GROUP BY conv_id, word""")
def d16_new_words(spark, d):
    """Words that a turn brings into its conversation."""
    return A.new_words(C.read(spark, d, "conversations"))


@query(f"""WITH {S.BM25}, h AS (SELECT qid, hits.rid, score, kind, source_id FROM hits JOIN p ON p.rid = hits.rid)
SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY CASE kind WHEN 'es' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, CASE WHEN source_id IN (SELECT min(source) FROM documents) THEN 0 ELSE 1 END, score DESC, rid) AS place FROM h""")
def d9_source_priority_rank(spark, d):
    items = C.passages(spark, d)
    first = C.read(spark, d, "documents").agg(F.min("source")).first()[0]
    hits = small(R.bm25(C.questions(spark, d), C.passage_index(spark, d))).join(items.select("rid", "kind", "source_id"), "rid")
    return R.by_priority(hits, ["es", "de"], [first]).select("qid", "rid", "place")


# --- quotations -----------------------------------------------------------------------------------

_QUOTES = """q AS (SELECT qid, array_to_string(CASE qid % 3 WHEN 0 THEN w WHEN 1 THEN list_concat(list_concat(w[1:len(w) // 2], ['altered']), w[len(w) // 2 + 2:]) ELSE list_concat(['Before:', 'unrelated'], w[1:8]) END, ' ') AS text
 FROM (SELECT item_id AS qid, string_split(text, ' ') AS w FROM benchmark))"""
_ALL_WORDS = f"""ql AS MATERIALIZED (SELECT qid, list_filter(string_split({S.normal('text')}, ' '), lambda x: x <> '') AS t FROM q),
pt AS MATERIALIZED (SELECT rid, list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda x: {S.normal('x')}), lambda x: x <> '') AS t FROM p)"""
_WORD_RUNS = f"""{_ALL_WORDS},
qp AS (SELECT qid, len(t) AS n, i - 1 AS pos, t[i] || chr(1) || t[i + 1] AS pair FROM (SELECT qid, t, unnest(range(1, len(t))) AS i FROM ql)),
dp AS (SELECT rid, i - 1 AS dpos, t[i] || chr(1) || t[i + 1] AS pair FROM (SELECT rid, t, unnest(range(1, len(t))) AS i FROM pt)),
met AS (SELECT qid, n, rid, pos, dpos - pos AS diagonal FROM qp JOIN dp USING (pair)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY qid, rid, diagonal ORDER BY pos) AS island FROM met),
run AS (SELECT qid, n, rid, min(pos) + diagonal AS start, min(pos) AS qstart, count(*) + 1 AS run FROM isl GROUP BY qid, n, rid, diagonal, island),
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, rid ORDER BY run DESC, qstart, start) AS k FROM run) WHERE k = 1),
cl AS (SELECT qid, rid, n, run, qstart, start, round(run / n, 3) AS coverage, CASE WHEN n < 3 THEN NULL WHEN run = n THEN 'exact' WHEN run / n >= 0.6 AND run >= 4 THEN 'close' END AS status FROM lr)"""
#: The search's candidates (its tokens, not all words), then what each holds.
_QUOTE_HITS = "qhits AS MATERIALIZED (WITH " + S.BM25.replace(S.QUESTIONS, _QUOTES) + " SELECT * FROM hits)"
_FOUND = f"""{S.PASSAGES}, {_QUOTES}, {_QUOTE_HITS}, {_WORD_RUNS},
fd AS (SELECT cl.*, rank, source_id, kind, location, array_to_string(pt.t[start + 1:start + run], ' ') AS wording FROM cl JOIN qhits USING (qid, rid) JOIN p ON p.rid = cl.rid JOIN pt ON pt.rid = cl.rid WHERE status IS NOT NULL),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN status = 'exact' THEN 0 ELSE 1 END, CASE kind WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, coverage DESC, rank, rid) AS place FROM fd) WHERE place <= 8)"""


def _quotes(spark, d):
    """Benchmark texts as quotations: as they are, with a word altered, and in part after words of another text."""
    w, third = F.split("text", " "), F.col("qid") % 3
    half = F.floor(F.size("w") / 2).cast("int")
    altered = F.concat(F.slice("w", F.lit(1), half), F.array(F.lit("altered")), F.expr("slice(w, cast(size(w) div 2 as int) + 2, size(w))"))
    partly = F.concat(F.array(F.lit("Before:"), F.lit("unrelated")), F.slice("w", 1, 8))
    rows = C.questions(spark, d).withColumn("w", w)
    return rows.select("qid", F.array_join(F.when(third == 0, F.col("w")).when(third == 1, altered).otherwise(partly), " ").alias("text"))


def _found_quotes(spark, d, fuzzy=False):
    items, quotes = C.passages(spark, d), _quotes(spark, d)
    hits = R.bm25(quotes, C.passage_index(spark, d))
    found = E.find_quotes(quotes, items, hits, fuzzy).join(hits.select("qid", "rid", "rank"), ["qid", "rid"])
    named = found.join(items.select("rid", "source_id", "kind", "location", "text"), "rid")
    return quotes, hits, E.rank_quotes(named.withColumn("excerpt", F.expr("substring(text, s + 1, e - s)")), kinds=["fr", "de"])


@query(f"WITH {S.PASSAGES}, {_QUOTES}, {_WORD_RUNS} SELECT qid, rid, n, run, qstart, start FROM lr")
def g1_longest_run(spark, d):
    """Longest runs of all words, stopwords and short ones included, of whole, altered and partial quotations in every passage."""
    return E.longest_runs(_quotes(spark, d), C.passages(spark, d))


@query(f"WITH {S.PASSAGES}, {_QUOTES}, {_WORD_RUNS} SELECT qid, rid, coverage, status FROM cl WHERE status IS NOT NULL")
def g2_classify_quote(spark, d):
    return E.classify(E.longest_runs(_quotes(spark, d), C.passages(spark, d))).filter("status IS NOT NULL").select("qid", "rid", "coverage", "status")


@query()
def g3_fuzzy_span(spark, d):
    """Spans of the search's candidates that hold most words of a quotation in order, one letter apart at most (a dynamic programme, tested against a plain one)."""
    items, quotes = C.passages(spark, d), _quotes(spark, d)
    asked = E.quote_words(quotes).filter(F.size("t") >= E.LEAST_WORDS).select("qid", F.col("t").alias("asked"))
    pairs = R.bm25(quotes, C.passage_index(spark, d)).select("qid", "rid")
    held = E.item_words(items.join(small(pairs.select("rid").distinct()), "rid", "left_semi")).select("rid", F.col("t").alias("held"))
    return E.fuzzy_spans(pairs.join(asked, "qid").join(held, "rid"))


@query(f"WITH {_FOUND} SELECT qid, rid, status, coverage, run, wording, place FROM rk")
def g4_rank_quotes(spark, d):
    """Findings among the search's candidates in order: exact first, then kinds (fr, de), then coverage and the search's rank; excerpts normalised."""
    _, _, ranked = _found_quotes(spark, d)
    return ranked.select("qid", "rid", "status", "coverage", "run", T.normalize(F.col("excerpt")).alias("wording"), "place")


@query(f"""WITH {_FOUND}, g AS (SELECT qid, source_id, wording, min(place) AS place, arg_min(rid, place) AS rid, string_agg(CAST(location AS VARCHAR), ',' ORDER BY place) AS places FROM rk GROUP BY qid, source_id, wording)
SELECT qid, rid, nth, places FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS nth FROM g) WHERE nth <= 3""")
def g5_collapse_same_wording(spark, d):
    _, _, ranked = _found_quotes(spark, d)
    shown = E.collapse_wording(ranked)
    return shown.select("qid", "rid", "nth", F.concat_ws(",", F.col("location").cast("string"), F.array_join(F.transform("also", lambda x: x.cast("string")), ",")).alias("p")).select("qid", "rid", "nth", F.regexp_replace("p", ",$", "").alias("places"))


@query(f"""WITH {_FOUND}, w AS (SELECT qid, count(*) FILTER (coverage >= 0.8) >= 8 AS generic FROM qhits WHERE rank <= 12 GROUP BY qid), f AS (SELECT qid, arg_min(status, place) AS status FROM rk GROUP BY qid)
SELECT qid, coalesce(status, CASE WHEN generic THEN 'too_generic' ELSE 'not_found' END) AS outcome FROM q LEFT JOIN w USING (qid) LEFT JOIN f USING (qid)""")
def g6_too_generic(spark, d):
    quotes, hits, ranked = _found_quotes(spark, d)
    return E.too_generic(quotes, hits, ranked)


@query(f"""WITH {_QUOTES}, w AS (SELECT qid, list_filter(string_split({S.normal('text')}, ' '), lambda x: x <> '') AS w, CASE WHEN contains(text, ':') THEN {S.normal("regexp_replace(text, '^[^:]*:', '')")} ELSE '' END AS after FROM q),
a AS (SELECT qid, 0 AS o, array_to_string(w, ' ') AS part FROM w UNION ALL SELECT qid, 1, after FROM w
UNION ALL SELECT qid, 2 * (len(w) - n) + 2, array_to_string(w[len(w) - n + 1:], ' ') FROM (SELECT *, unnest(range(4, len(w))) AS n FROM w) UNION ALL SELECT qid, 2 * (len(w) - n) + 3, array_to_string(w[1:n], ' ') FROM (SELECT *, unnest(range(4, len(w))) AS n FROM w)),
f AS (SELECT qid, part, min(o) AS o FROM a WHERE part <> '' GROUP BY qid, part)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS nth, part FROM f""")
def g9_quote_parts(spark, d):
    return E.quote_parts(_quotes(spark, d)).select("qid", F.col("nth").cast("long").alias("nth"), "part")


_WRITTEN = f"""{S.PASSAGES}, ww AS (SELECT rid, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM p),
wx AS (SELECT rid, w, i - 1 AS pos, w[i] AS written, {S.normal('w[i]')} AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ww)),
wr AS (SELECT * FROM wx WHERE word <> '')"""


@query(f"""WITH {_WRITTEN}, t AS (SELECT DISTINCT list_max(string_split({S.normal('text')}, ' ')) AS word FROM benchmark)
SELECT word, rid, pos, array_to_string(w[greatest(pos - 4, 0) + 1:pos + 5], ' ') AS snippet FROM wx WHERE word IN (SELECT word FROM t)""")
def g11_concordance(spark, d):
    """Every place of the last word, in letter order, of each benchmark text."""
    wanted = C.questions(spark, d).select(F.array_max(F.split(T.normalize(F.col("text")), " ")).alias("word")).distinct()
    return E.concordance(wanted, C.passages(spark, d))


_AFFIXES = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in N.BEFORE) + ") v(b)), a AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in N.AFTER) + ") v(a))"
_JOINED_CORPUS = """ip AS (SELECT rid, CASE rid % 3 WHEN 0 THEN 'و' || text WHEN 1 THEN text || 'ها' ELSE text END AS text FROM p)"""
_COUNTED = f"""{S.PASSAGES}, {_JOINED_CORPUS}, {_AFFIXES}, iw AS (SELECT rid, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: {S.normal('x')} <> '') AS w FROM ip),
ix AS (SELECT rid, w, i - 1 AS pos, {S.normal('w[i]')} AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM iw)),
t AS (SELECT DISTINCT unnest([list_max(string_split(x, ' ')), list_min(list_filter(string_split(x, ' '), lambda y: y <> ''))]) AS word FROM (SELECT {S.normal('text')} AS x FROM benchmark)),
forms AS (SELECT DISTINCT word, b || word || a AS form FROM t, b, a WHERE (b <> '' OR a <> '') AND length(word) >= 3)"""


def _joined_corpus(spark, d):
    """Passages with a letter joined to the first word or a pronoun to the last."""
    n = F.col("rid") % 3
    return C.passages(spark, d).withColumn("text", F.when(n == 0, F.concat(F.lit("و"), "text")).when(n == 1, F.concat("text", F.lit("ها"))).otherwise(F.col("text")))


@query(f"""WITH {_COUNTED}, o AS (SELECT word, rid, pos, 'exact' AS way FROM ix JOIN t USING (word) UNION ALL SELECT forms.word, rid, pos, 'joined' FROM ix JOIN forms ON ix.word = form)
SELECT word, rid, pos, way, CASE WHEN pos > 4 THEN '… ' ELSE '' END || array_to_string(iw.w[greatest(pos - 4, 0) + 1:pos + 5], ' ') || CASE WHEN pos + 5 < len(iw.w) THEN ' …' ELSE '' END AS snippet FROM o JOIN iw USING (rid)""")
def g12_joined_occurrences(spark, d):
    """G11 and G12: words of the benchmark, exact and with joined letters, each with its snippet."""
    parts = F.split(T.normalize(F.col("text")), " ")
    words = C.questions(spark, d).select(F.explode(F.array(F.array_max(parts), F.array_min(F.filter(parts, lambda x: x != "")))).alias("word")).distinct()
    return N.occurrences(words.withColumn("asked", F.col("word")), _joined_corpus(spark, d)).select("word", "rid", "pos", "way", "snippet")


@query(f"""WITH {_COUNTED}, ph AS (SELECT DISTINCT array_to_string(x[2:4], ' ') AS phrase FROM (SELECT list_filter(string_split({S.normal('text')}, ' '), lambda y: y <> '') AS x FROM benchmark) WHERE len(x) >= 4),
pt AS (SELECT phrase, string_split(phrase, ' ') AS t FROM ph), nw AS (SELECT rid, list(word ORDER BY pos) AS n FROM ix GROUP BY rid),
wn AS (SELECT phrase, t, rid, pos, n[pos + 1:pos + 3] AS win FROM pt, ix JOIN nw USING (rid) WHERE n[pos + 2] = t[2] AND len(n) >= pos + 3)
SELECT phrase, rid, pos, CASE WHEN win = t THEN 'exact' ELSE 'joined' END AS way FROM wn WHERE (win[1] = t[1] OR (length(t[1]) >= 3 AND win[1] IN (SELECT b || t[1] FROM b))) AND (win[3] = t[3] OR (length(t[3]) >= 3 AND win[3] IN (SELECT t[3] || a FROM a)))""")
def g11_phrases(spark, d):
    """Three-word phrases of the benchmark in place, and with letters joined at their ends."""
    words = C.questions(spark, d).select(F.filter(F.split(T.normalize(F.col("text")), " "), lambda x: x != "").alias("x")).filter("size(x) >= 4")
    return N.phrases(words.select(F.array_join(F.slice("x", 2, 3), " ").alias("phrase")).distinct(), _joined_corpus(spark, d)).select("phrase", "rid", "pos", "way")


@query(f"""WITH {S.PASSAGES}, ip AS (SELECT rid, translate(text, 'a', 'ا') AS text FROM p), ix AS (SELECT rid, i - 1 AS pos, {S.normal('w[i]')} AS form FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT rid, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: {S.normal('x')} <> '') AS w FROM ip))),
t AS (SELECT DISTINCT replace(x[i], 'a', '') AS word FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT string_split({S.normal('text')}, ' ') AS x FROM benchmark)) WHERE length(replace(x[i], 'a', '')) >= 3 AND regexp_full_match(x[i], '[a-z]+')),
lost AS (SELECT word, '^' || array_to_string(string_split(word, ''), 'ا{{0,2}}') || '$' AS pattern FROM t WHERE word NOT IN (SELECT form FROM ix)),
v AS (SELECT DISTINCT form, replace(form, 'ا', '') AS key FROM ix)
SELECT word, rid, pos, form FROM lost JOIN v ON v.key = lost.word AND length(v.form) - length(word) BETWEEN 1 AND 2 AND regexp_matches(v.form, pattern) JOIN ix USING (form)""")
def g13_alif_variants(spark, d):
    """Benchmark words without their a's in passages whose a's are alifs: only words found nowhere are tried with alifs left out."""
    items = C.passages(spark, d).withColumn("text", F.translate("text", "a", "ا"))
    words = C.questions(spark, d).select(F.explode(F.split(T.normalize(F.col("text")), " ")).alias("x")).filter("x RLIKE '^[a-z]+$'")
    targets = words.select(F.regexp_replace("x", "a", "").alias("word")).filter("char_length(word) >= 3").distinct()
    found = N.places(N.written(items)).join(targets, "word", "left_semi").select("word").distinct()
    return N.alif_variants(targets, items, found)


@query(f"WITH {_WRITTEN} SELECT word, regexp_replace(written, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS written, count(*) AS n FROM wr GROUP BY 1, 2")
def g14_by_reading(spark, d):
    return E.by_reading(C.passages(spark, d))


@query(f"WITH {_WRITTEN} SELECT word, min(written) AS written FROM wr GROUP BY word HAVING count(DISTINCT written) = 1")
def g16_unambiguous_forms(spark, d):
    return E.unambiguous(C.passages(spark, d))


_MARK, _END = "[\\x{064B}-\\x{0652}\\x{0670}]", "[\\x{064B}-\\x{0650}]"
_MARKED = f"""{S.PASSAGES.replace('p AS (', 'p0 AS (')}, p AS (SELECT rid, kind, translate(text, 'eiua', 'َُِا') AS text FROM p0), ww AS (SELECT rid, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM p),
mw AS (SELECT rid, pos, regexp_replace(written, '^[^\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_]+$', '', 'g') AS written FROM (SELECT rid, i - 1 AS pos, w[i] AS written, {S.normal('w[i]')} AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ww)) WHERE n <> ''),
mb AS (SELECT *, regexp_replace(written, '{_MARK}', '', 'g') AS word, regexp_matches(written, '{_MARK}') AS marked, regexp_matches(written, '\\x{{064B}}[اى]$') AS tan FROM mw),
mx AS (SELECT *, lag(word) OVER (PARTITION BY rid ORDER BY pos) AS before, CASE WHEN tan THEN left(written, length(written) - 2) ELSE regexp_replace(written, '{_END}+$', '') END AS head,
 CASE WHEN tan THEN written[-2:-2] ELSE regexp_extract(written, '({_END}*)$', 1) END AS ending, CASE WHEN tan THEN right(written, 1) ELSE '' END AS tail FROM mb)"""
_LEX = """{name}e AS (SELECT {k}word, head, tail, ending, count(*) AS k, min((rid, pos)) AS a FROM mx WHERE marked{cond} GROUP BY {k}word, head, tail, ending),
{name}s AS (SELECT {k}word, head, tail, CAST(sum(k) AS BIGINT) AS k, min(a) AS a, arg_min(ending, (-k, a)) AS ending FROM {name}e GROUP BY {k}word, head, tail),
{name} AS (SELECT {k}word, head, tail, ending, n FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY {k}word) AS BIGINT) AS n, row_number() OVER (PARTITION BY {k}word ORDER BY k DESC, a) AS r FROM {name}s) WHERE r = 1 AND n >= 3 AND k >= {share} * n)"""
_LEX1 = _LEX.format(name="l1", k="", cond="", share="0.9")
_LEX2 = _LEX.format(name="l2", k="before, ", cond=" AND before IS NOT NULL", share="0.8")


def _marked(spark, d):
    """Passages whose vowels e, i, u are vowel marks and whose a's are alifs."""
    return C.passages(spark, d).withColumn("text", F.translate("text", "eiua", "َُِا"))


@query(f"WITH {_MARKED}, {_LEX1} SELECT word, head, tail, ending, n FROM l1")
def g17_mark_lexicon(spark, d):
    return E.mark_lexicon(_marked(spark, d))


@query(f"WITH {_MARKED}, {_LEX2} SELECT before, word, head, tail, ending, n FROM l2")
def g18_mark_bigrams(spark, d):
    return E.bigram_lexicon(_marked(spark, d))


@query(f"""WITH {_MARKED}, {_LEX1}, {_LEX2}, g AS (SELECT rid, pos, word, CASE WHEN pos % 3 = 0 THEN word ELSE written END AS written, before, head AS oh, ending AS oe, tail AS ot FROM mx),
o AS (SELECT rid, pos, g.word, g.written, g.before, CASE WHEN pos % 3 = 0 THEN g.word ELSE oh END AS oh, CASE WHEN pos % 3 = 0 THEN '' ELSE oe END AS oe, CASE WHEN pos % 3 = 0 THEN '' ELSE ot END AS ot, coalesce(l2.head, l1.head) AS head,
 CASE WHEN l2.head IS NOT NULL THEN l2.tail ELSE l1.tail END AS tail, CASE WHEN l2.head IS NOT NULL THEN l2.ending ELSE l1.ending END AS ending FROM g LEFT JOIN l2 ON l2.before = g.before AND l2.word = g.word LEFT JOIN l1 ON l1.word = g.word),
f AS (SELECT *, head || CASE WHEN ending = '' THEN '' WHEN oe <> '' THEN oe ELSE ending END || tail AS stem FROM o)
SELECT rid, pos, CASE WHEN head IS NULL THEN written WHEN oh = head AND ot = tail THEN CASE WHEN oe = '' OR ending <> '' THEN written ELSE head || tail END WHEN regexp_replace(stem, '{_MARK}', '', 'g') = regexp_replace(written, '{_MARK}', '', 'g') THEN stem ELSE written END AS fixed FROM f""")
def g20_apply_mark_lexicon(spark, d):
    """Every third word of every passage lost its marks; the lexicons give them back where all books agree."""
    words = E.marked_words(_marked(spark, d))
    lost = words.withColumn("written", F.when(F.col("pos") % 3 == 0, F.col("word")).otherwise(F.col("written")))
    return E.apply_lexicon(lost, *E.lexicons(words)).select("rid", "pos", "fixed")


_LETTER_WORD = "[\\x{0621}-\\x{063a}\\x{0641}-\\x{064a}\\x{0671}][\\x{0621}-\\x{063a}\\x{0641}-\\x{064a}\\x{0671}\\x{064b}-\\x{0652}\\x{0670}]*"


@query(f"""WITH {S.PASSAGES}, a AS (SELECT rid, translate({arabic_sql('text')}, '«»﴿﴾“”"', '') AS text FROM p), m AS (SELECT rid, text, translate(text, 'نر', 'َُ') AS marked FROM a),
w AS (SELECT rid, list_transform(regexp_extract_all(marked, '{_LETTER_WORD}'), lambda x, i: x || 'ط' || translate((i - 1) || '', '0123456789', 'ابتثجحخدذس')) AS src FROM m), g AS (SELECT rid, src, len(src) AS n, list_transform(src, lambda x: regexp_replace(x, '{_MARK}', '', 'g')) AS own FROM w WHERE len(src) > 0),
k AS (SELECT *, CASE WHEN rid % 2 = 0 THEN len(list_filter(src, lambda x: regexp_matches(x, '{_MARK}'))) >= 0.8 * n ELSE false END AS fits FROM g),
o AS (SELECT rid, i - 1 AS pos, own[i] AS written, CASE WHEN fits THEN src[i] ELSE own[i] END AS kept, fits FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k))
SELECT rid, pos, written, kept FROM o WHERE fits OR pos = 0""")
def g19_protected_spans(spark, d):
    """Passages without their marks, the first word in quotation marks, each word with its number in letters; every second one has the marked passage for its source."""
    text = F.translate(arabic(F.col("text")), "«»﴿﴾“”\"", "")
    number = lambda i: F.concat(F.lit("ط"), F.translate(i.cast("string"), "0123456789", "ابتثجحخدذس"))
    marked = F.transform(F.regexp_extract_all(F.translate("text", "نر", "َُ"), F.lit(E.LETTER_WORD), F.lit(0)), lambda w, i: F.concat(w, number(i)))
    rows = saved(C.passages(spark, d).select("rid", text.alias("text")).select("rid", F.array_join(marked, " ").alias("marked")), "marked-passages").filter("marked <> ''")
    w = F.split(E.bare(F.col("marked")), " ", 2)
    texts = rows.select("rid", F.concat(F.lit("«"), F.get(w, F.lit(0)), F.lit("» "), F.coalesce(F.get(w, F.lit(1)), F.lit(""))).alias("text"))
    sources = rows.filter("rid % 2 = 0").select("rid", F.lit(0).alias("k"), F.col("marked").alias("text"))
    return E.protected_spans(texts, sources).select("rid", "pos", "written", "kept")


# --- claims ---------------------------------------------------------------------------------------

_CLAIMS = """cs AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: true) AS ss FROM conversations WHERE role = 'assistant'),
cl AS (SELECT conv_id, turn, i - 1 AS n, ss[i] AS text, (conv_id + i - 1) || ':0' AS cited FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM cs) WHERE trim(ss[i]) <> '')"""


def _claims(spark, d):
    return C.claims(spark, d).withColumn("claim", F.concat_ws("/", "conv_id", "turn", "n"))


# Claims with one planted fault each, by k; passages with ruling words by document.
_FAULTS = ["", "", "", "«كلام لا يوجد»", "", "في هذا الباب", "روى البخاري ومسلم", "وهو واجب", "يجوز ذلك", "لا يجوز ذلك", "«هذا حرام»", ""]
_PLANTED = f"""{S.PASSAGES}, {_CLAIMS},
it AS (SELECT id, CASE WHEN location % 5 = 0 THEN 'sahih-muslim' ELSE source_id END AS source_id, rid % 13 <> 0 AS answer_part, text || CASE location % 3 WHEN 0 THEN ' هذا حرام' WHEN 1 THEN ' لا يجوز ذلك' ELSE '' END AS text FROM p),
cm AS (SELECT conv_id || '/' || turn || '/' || n AS claim, conv_id || '/' || turn AS answer, (conv_id + turn + n) % 12 AS k, text, cited, (conv_id + 500 + n) || ':0' AS far FROM cl),
al AS (SELECT DISTINCT answer, cited AS id FROM cm),
c AS (SELECT claim, k, text || ' ' || CASE k {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAULTS) if f)} ELSE '' END AS text,
 CASE k WHEN 0 THEN [] WHEN 1 THEN [cited, 'x:1'] WHEN 2 THEN [cited, far] ELSE [cited] END AS cited, CASE k WHEN 4 THEN 'Zeno the elder' WHEN 11 THEN split_part(text, ' ', 1) ELSE '' END AS school FROM cm),
cx AS (SELECT claim, unnest(cited) AS id FROM c), ct AS (SELECT claim, it.* FROM cx JOIN it USING (id)),
kinds AS (SELECT * FROM (VALUES {', '.join(f"('{w}', '{k}')" for k, ws in G.RULING_WORDS.items() for w in ws.split())}) v(word, kind)),
pol AS (SELECT DISTINCT key, g, kind, len(list_filter(w.w_all[greatest(1, i - 2):i - 1], lambda t: list_contains({G.NEGATORS}, t) OR (t[1:1] IN ('و', 'ف') AND list_contains({G.NEGATORS}, t[2:])))) > 0 AS neg2,
 len(list_filter(w.w_all[greatest(1, i - 4):i - 1], lambda t: list_contains({G.NEGATORS}, t) OR (t[1:1] IN ('و', 'ف') AND list_contains({G.NEGATORS}, t[2:])))) > 0 AS neg4,
 len(list_filter(w.w_all[greatest(1, i - 2):i - 1], lambda t: list_contains({G.STRICT_NEGATORS}, t) OR (t[1:1] IN ('و', 'ف') AND list_contains({G.STRICT_NEGATORS}, t[2:])))) > 0 AS strict
 FROM (SELECT key, g, i, w[i] AS word, w AS w_all FROM (SELECT DISTINCT key, g, w, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT claim AS key, 's' AS g, string_split({S.normal('text')}, ' ') AS w FROM c UNION ALL SELECT DISTINCT claim, 'p', string_split({S.normal('text')}, ' ') FROM ct))) w
 JOIN kinds ON kinds.word IN (w.word, CASE WHEN w.word[1:1] IN ('و', 'ف', 'ب', 'ل') AND length(w.word) > 3 THEN w.word[2:] ELSE w.word END, CASE WHEN w.word[1:2] = 'ال' AND length(w.word) > 4 THEN w.word[3:] ELSE w.word END)),
there AS (SELECT key, kind, neg2 AS neg FROM pol WHERE g = 'p' UNION SELECT key, kind, neg4 FROM pol WHERE g = 'p'),
mis AS (SELECT DISTINCT key FROM pol s WHERE g = 's' AND NOT neg2 AND key IN (SELECT key FROM there) AND NOT EXISTS (SELECT 1 FROM there t WHERE t.key = s.key AND t.kind = s.kind)),
said AS (SELECT key, kind, true AS neg FROM pol WHERE g = 's' AND strict UNION SELECT key, kind, false FROM pol a WHERE g = 's' AND NOT strict AND EXISTS (SELECT 1 FROM pol b WHERE b.key = a.key AND b.g = 's' AND b.kind = a.kind AND NOT b.neg2)),
fl AS (SELECT DISTINCT key FROM said s WHERE EXISTS (SELECT 1 FROM there t WHERE t.key = s.key AND t.kind = s.kind AND t.neg <> s.neg) AND NOT EXISTS (SELECT 1 FROM there t WHERE t.key = s.key AND t.kind = s.kind AND t.neg = s.neg)),
v AS (SELECT claim, CASE WHEN len(cited) = 0 THEN 'nothing cited' WHEN claim IN (SELECT claim FROM cx JOIN cm USING (claim) WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.answer = cm.answer AND al.id = cx.id)) THEN 'passage of another answer'
 WHEN claim IN (SELECT claim FROM ct WHERE NOT answer_part) THEN 'question without its answer'
 WHEN contains(text, '«') AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.claim = c.claim AND contains({S.normal('ct.text')}, {S.normal("regexp_extract(c.text, '«([^»]+)»', 1)")})) THEN 'quotation not in the passages'
 WHEN school <> '' AND NOT (len({S.tokens('school')}) > 0 AND EXISTS (SELECT 1 FROM ct WHERE ct.claim = c.claim AND list_has_all({S.tokens('ct.text')}, {S.tokens('school')}))) THEN 'school not named'
 WHEN contains(text, 'هذا الباب') THEN 'book''s own division'
 WHEN contains(text, 'روى البخاري ومسلم') THEN 'collection not cited'
 WHEN claim IN (SELECT key FROM mis) THEN 'ruling not in the passages' WHEN claim IN (SELECT key FROM fl) THEN 'ruling turned around' END AS reason FROM c)"""

def _retrieved(spark, d):
    """(answer, id): what the sentences of an answer cite by rule is what was retrieved for it."""
    return C.claims(spark, d).select(F.concat_ws("/", "conv_id", "turn").alias("answer"), F.col("cited").alias("id")).distinct()


def _planted(spark, d):
    claims, k = _claims(spark, d), (F.col("conv_id") + F.col("turn") + F.col("n")) % 12
    fault = F.coalesce(*[F.when(k == i, F.lit(f)) for i, f in enumerate(_FAULTS)])
    cited = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("cited", F.lit("x:1"))).when(k == 2, F.array("cited", F.concat(F.col("conv_id") + 500 + F.col("n"), F.lit(":0")))).otherwise(F.array("cited"))
    school = F.when(k == 4, "Zeno the elder").when(k == 11, F.substring_index("text", " ", 1)).otherwise("")
    rows = claims.select("claim", F.concat_ws("/", "conv_id", "turn").alias("answer"), F.concat_ws(" ", "text", fault).alias("text"), cited.alias("cited"), school.alias("school"))
    ruling = F.when(F.col("location") % 3 == 0, " هذا حرام").when(F.col("location") % 3 == 1, " لا يجوز ذلك").otherwise("")
    source = F.when(F.col("location") % 5 == 0, "sahih-muslim").otherwise(F.col("source_id"))
    items = C.passages(spark, d).select("id", source.alias("source_id"), (F.col("rid") % 13 != 0).alias("answer_part"), F.concat("text", ruling).alias("text"))
    return rows, items


@query(f"WITH {_PLANTED} SELECT claim, reason FROM v")
def h1_verify(spark, d):
    """H1 to H3, H5, H9 to H12 on the assistant's sentences, one fault of each rule planted among twelve of them; one of the faults is a passage retrieved for another answer."""
    claims, items = _planted(spark, d)
    return M.verify(claims, items, _retrieved(spark, d))


@query(f"WITH {_PLANTED} SELECT key AS claim, kind FROM pol s WHERE g = 's' AND NOT neg2 AND key IN (SELECT key FROM there) AND NOT EXISTS (SELECT 1 FROM there t WHERE t.key = s.key AND t.kind = s.kind) GROUP BY 1, 2")
def h9_ruling_mismatch(spark, d):
    claims, items = _planted(spark, d)
    cited = claims.select("claim", F.explode("cited").alias("id")).join(items, "id").select("claim", "text")
    return G.mismatched(claims.select("claim", "text"), cited)


@query(f"WITH {_PLANTED} SELECT key AS claim, kind FROM said s WHERE EXISTS (SELECT 1 FROM there t WHERE t.key = s.key AND t.kind = s.kind AND t.neg <> s.neg) AND NOT EXISTS (SELECT 1 FROM there t WHERE t.key = s.key AND t.kind = s.kind AND t.neg = s.neg) GROUP BY 1, 2")
def h10_ruling_flipped(spark, d):
    claims, items = _planted(spark, d)
    cited = claims.select("claim", F.explode("cited").alias("id")).join(items, "id").select("claim", "text")
    return G.flipped(claims.select("claim", "text"), cited)


@query(f"WITH {_PLANTED} SELECT key AS claim, kind, neg2 AS negated FROM pol WHERE g = 's' GROUP BY 1, 2, 3")
def h8_ruling_polarity(spark, d):
    claims, _ = _planted(spark, d)
    return G.polarity(claims.select("claim", "text"), "claim")


@query(f"""WITH {_PLANTED}, e AS (SELECT claim, cited, {S.normal("array_to_string(string_split(text, ' ')[1:3], ' ')")} AS w FROM c), x AS (SELECT claim, w, unnest(cited) AS id FROM e)
SELECT claim, bool_or(w <> '' AND it.id IS NOT NULL AND contains(' ' || {S.normal('it.text')} || ' ', ' ' || w || ' ')) AS held FROM (SELECT claim, w, id FROM x UNION ALL SELECT claim, w, NULL FROM e WHERE len(cited) = 0) LEFT JOIN it USING (id) GROUP BY claim""")
def h4_evidence_contiguous(spark, d):
    """A claim's first three words as its witness."""
    claims, items = _planted(spark, d)
    return M.evidence_contiguous(claims.withColumn("witness", F.substring_index("text", " ", 3)), items)


@query(f"WITH {_PLANTED} SELECT claim, reason FROM v WHERE reason IN ('nothing cited', 'passage of another answer')")
def h2_citation_integrity(spark, d):
    claims, items = _planted(spark, d)
    return M.verify(claims, items, _retrieved(spark, d)).filter("reason IN ('nothing cited', 'passage of another answer')")


@query(f"""WITH {_CLAIMS} SELECT conv_id, turn, CAST(n AS BIGINT) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, cited AS ids FROM cl""")
def h22_cited_prose(spark, d):
    """The assistant's sentences, each given its citation in brackets, parsed back into claims."""
    prose = C.claims(spark, d).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text", "cited"))), lambda x: F.regexp_replace(F.concat(F.lit("["), x["cited"], F.lit("] "), F.translate(x["text"], "[]", "")), "^(.*)$", "$1")), " ").alias("text"))
    parsed = E.cited_prose(prose, ["conv_id", "turn"])
    return parsed.select("conv_id", "turn", F.col("n").cast("long").alias("n"), "text", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {S.PASSAGES}, {_CLAIMS} SELECT conv_id || '/' || turn AS claim, string_agg(id || ' (' || source_id || ')', '; ' ORDER BY pos) AS cards
FROM (SELECT conv_id, turn, cited AS id, min(n) AS pos FROM cl GROUP BY conv_id, turn, cited) JOIN p USING (id) GROUP BY conv_id, turn""")
def h33_source_cards(spark, d):
    cites = C.claims(spark, d).select(F.concat_ws("/", "conv_id", "turn").alias("claim"), F.col("cited").alias("id"), F.col("n").alias("pos"))
    return E.source_cards(cites, C.passages(spark, d))


@query(f"""WITH {_PLANTED}, r AS (SELECT split_part(claim, '/', 1) || '/' || split_part(claim, '/', 2) AS answer, CAST(split_part(claim, '/', 3) AS INTEGER) AS pos, reason FROM v),
k AS (SELECT answer, string_agg(reason || '=' || n, ';' ORDER BY reason) AS reasons FROM (SELECT answer, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY answer, reason) GROUP BY answer)
SELECT answer, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL) = 0 OR NOT arg_min(reason IS NULL, pos) OR count(*) FILTER (reason IS NOT NULL) >= count(*) FILTER (reason IS NULL) AS broken, coalesce(any_value(reasons), '') AS reasons
FROM r LEFT JOIN k USING (answer) GROUP BY answer""")
def h35_rejection_rollup(spark, d):
    claims, items = _planted(spark, d)
    verdicts = M.verify(claims, items, _retrieved(spark, d))
    rolled = E.rejection_rollup(verdicts.select(F.substring_index("claim", "/", 2).alias("answer"), F.substring_index("claim", "/", -1).cast("int").alias("pos"), "reason"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return rolled.withColumn("reasons", listed)


_SENTENCES = """ss AS (SELECT conv_id || '/' || turn AS answer, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss, conv_id, turn FROM conversations),
st AS (SELECT answer, i - 1 AS pos, ss[i] AS text, CASE conv_id % 4 WHEN 0 THEN 'kids' WHEN 1 THEN 'youth' WHEN 2 THEN 'extended' ELSE 'other' END AS style, turn % 2 = 0 AS listing FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM ss) WHERE trim(ss[i]) <> '')"""


def _sentences(spark, d):
    rows = C.read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "(?<=[.!?])\\s+")).alias("pos", "text")).filter("trim(text) <> ''")
    n = F.col("conv_id") % 4
    style = F.when(n == 0, "kids").when(n == 1, "youth").when(n == 2, "extended").otherwise("other")
    return rows.select(F.concat_ws("/", "conv_id", "turn").alias("answer"), F.col("pos").cast("long").alias("pos"), "text", style.alias("style"), (F.col("turn") % 2 == 0).alias("listing"))


@query("""WITH v AS (SELECT l_orderkey AS answer, l_linenumber AS pos, CASE WHEN l_linenumber % 5 = 0 THEN 'some of them' ELSE CAST(l_suppkey % 7 AS VARCHAR) END AS school FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY answer, school) AS same FROM v WHERE NOT regexp_matches(school, '^some '))
SELECT answer, pos, school FROM (SELECT *, count(*) OVER (PARTITION BY answer) AS k FROM n WHERE same = 1) WHERE k >= 2""")
def h16_named_views(spark, d):
    """Lines of an order as views, named by supplier, every fifth without a name."""
    rows = C.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 5 == 0, "some of them").otherwise((F.col("l_suppkey") % 7).cast("string")).alias("school"))
    return P.named_views(rows, "^some ")


@query(f"""WITH {_SENTENCES}, c AS (SELECT *, CASE style WHEN 'kids' THEN CASE WHEN listing THEN 10 ELSE 7 END WHEN 'extended' THEN CASE WHEN listing THEN 28 ELSE 18 END ELSE CASE WHEN listing THEN 20 ELSE 12 END END AS most,
 len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, count(*) OVER (PARTITION BY answer) AS n FROM st),
d AS (SELECT *, style = 'kids' AND words > 18 AS lg, row_number() OVER (PARTITION BY answer, style = 'kids' AND words > 18 ORDER BY words DESC, pos) AS r FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY pos) AS place FROM d WHERE NOT (lg AND r <= n - most)) SELECT answer, pos FROM k WHERE place <= most""")
def h20_length_ceiling(spark, d):
    return P.length_ceiling(_sentences(spark, d)).select("answer", "pos")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace('see [f:12:3]' || coalesce(text, '') || ' end (t4:5.1)', '\s*[\[(]?\b[a-z]\d*(?::\d+(?:\.\d+)?){1,5}\b[\])]?', '', 'g'), '\s*[\[(]\s*[\])]', '', 'g') AS text FROM documents""")
def h21_strip_ids(spark, d):
    """Ids written around whole documents, with brackets and without, and taken out again with what the texts hold of the like."""
    written = F.concat(F.lit("see [f:12:3]"), F.coalesce("text", F.lit("")), F.lit(" end (t4:5.1)"))
    return C.read(spark, d, "documents").select("doc_id", P.strip_ids(written).alias("text"))


@query(f"""WITH {S.PASSAGES}, {_CLAIMS} SELECT DISTINCT conv_id || '/' || turn AS answer, cited AS id FROM cl WHERE cited NOT IN (SELECT id FROM p WHERE rid % 3 <> 0)""")
def h23_missing_cards(spark, d):
    """Cards are shown for passages whose number three does not divide."""
    cites = C.claims(spark, d).select(F.concat_ws("/", "conv_id", "turn").alias("answer"), F.col("cited").alias("id"))
    shown = C.passages(spark, d).filter("rid % 3 <> 0").select("id").join(cites, "id").select("answer", "id").distinct()
    return P.missing_cards(cites, shown)


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS qid, string_split({S.normal('text')}, ' ') AS w FROM conversations),
g AS (SELECT * FROM (VALUES ('crisis', 1, 'a', ['the', 'and']), ('override', 2, 'b', ['of']), ('override', 2, 'c', ['de']), ('judging', 3, 'd', ['thanks'])) v(class, priority, rule, words)),
m AS (SELECT qid, min((priority, rule, class)) AS x FROM w, g WHERE list_has_all(w, words) GROUP BY qid) SELECT qid, x[3] AS class, x[2] AS rule FROM m""")
def h24_gate_question(spark, d):
    rules = spark.createDataFrame([("crisis", 1, "a", ["the", "and"]), ("override", 2, "b", ["of"]), ("override", 2, "c", ["de"]), ("judging", 3, "d", ["thanks"])], "class string, priority int, rule string, words array<string>")
    asked = C.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return P.gate(asked, rules)


@query("""SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 3 = 0 THEN 'وفي الحديث المتفق عليه (رواه البخاري ومسلم) أن ' || o_orderstatus ELSE 'وروى البخاري ومسلم أن ' || o_orderstatus END AS text FROM orders""")
def h28_agreed_upon(spark, d):
    """Every third sentence cites both books, the others one of them."""
    key = F.col("o_orderkey")
    sources = F.when(key % 3 == 0, F.array(F.lit("sahih-muslim"), F.lit("sahih-bukhari"))).otherwise(F.array(F.lit("sahih-muslim")))
    rows = C.read(spark, d, "orders").select(key.alias("claim"), F.concat(F.lit("وروى البخاري ومسلم أن "), F.col("o_orderstatus")).alias("text"), sources.alias("sources"))
    return P.agreed_upon(rows, ["sahih-bukhari", "sahih-muslim"]).select("claim", "text")


@query(f"""WITH {_SENTENCES}, k AS (SELECT answer, pos, text FROM st WHERE pos % 3 <> 1), r AS (SELECT answer, pos, text AS was, 'rewritten ' || text AS text FROM st WHERE pos % 3 = 1),
h AS (SELECT answer, min(pos) AS pos, text AS was FROM st GROUP BY answer, text), u AS (SELECT k.answer, h.pos, 0 AS new, k.text FROM k JOIN h ON h.answer = k.answer AND h.was = k.text UNION ALL SELECT r.answer, h.pos, 1, r.text FROM r JOIN h ON h.answer = r.answer AND h.was = r.was)
SELECT answer, row_number() OVER (PARTITION BY answer ORDER BY pos, new, text) AS pos, text FROM u""")
def h34_merge_repairs(spark, d):
    """Every third sentence of a draft was rewritten."""
    draft = _sentences(spark, d)
    kept = draft.filter("pos % 3 <> 1").select("answer", "text")
    repaired = draft.filter("pos % 3 = 1").select("answer", F.col("text").alias("was"), F.concat(F.lit("rewritten "), "text").alias("text"))
    return P.merge_repairs(kept, repaired, draft)


# --- evaluation -----------------------------------------------------------------------------------

_QRELS = "qr AS (SELECT DISTINCT qid, rid FROM run WHERE run >= 5)"


def _qrels(spark, d, index):
    """Passages that hold five or more words of a benchmark text in a row are its answers."""
    return R.diagonals(C.questions(spark, d), index).filter("run >= 5").select("qid", "rid").distinct()


@query(f"""WITH {S.BM25}, {S.RUNS[S.RUNS.index('qp AS'):]}, {_QRELS}, g AS (SELECT qid, rank, count(*) OVER (PARTITION BY qid ORDER BY rank) / rank AS pr FROM hits JOIN qr USING (qid, rid)),
a AS (SELECT qid, sum(pr) AS ap, min(rank) AS first, count(*) AS found FROM g GROUP BY qid)
SELECT count(*) AS questions, round(avg(coalesce(ap / n, 0)), 6) AS map, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(found / n, 0)), 6) AS recall FROM (SELECT qid, count(*) AS n FROM qr GROUP BY qid) LEFT JOIN a USING (qid)""")
def i1_rank_metrics(spark, d):
    index = C.passage_index(spark, d)
    return V.rank_metrics(R.bm25(C.questions(spark, d), index), _qrels(spark, d, index))


@query(f"""WITH {S.BM25}, {S.RUNS[S.RUNS.index('qp AS'):]}, {_QRELS}, f AS (SELECT qid, min(rank) AS first FROM hits JOIN qr USING (qid, rid) GROUP BY qid)
SELECT count(*) AS questions, count(*) FILTER (first <= 1) AS hit_1, count(*) FILTER (first <= 5) AS hit_5, count(*) FILTER (first <= 10) AS hit_10, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 6) AS mrr FROM q LEFT JOIN f USING (qid)""")
def i2_hit_at(spark, d):
    asked, index = C.questions(spark, d), C.passage_index(spark, d)
    return V.hit_at(R.bm25(asked, index), _qrels(spark, d, index), asked)


@query("""SELECT qid, count(*) FILTER (d.doc_id IS NULL) AS missing, count(d.doc_id) = 0 AS none_left FROM (SELECT conv_id AS qid, 700 * turn + conv_id AS rid FROM conversations) LEFT JOIN documents d ON d.doc_id = rid GROUP BY qid HAVING count(*) FILTER (d.doc_id IS NULL) > 0""")
def i4_missing_gold(spark, d):
    gold = C.read(spark, d, "conversations").select(F.col("conv_id").alias("qid"), (700 * F.col("turn") + F.col("conv_id")).alias("rid"))
    return V.missing_gold(gold, C.read(spark, d, "documents").select(F.col("doc_id").alias("rid")))


@query(f"""WITH {S.BM25}, b AS (SELECT qid, rid, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, score DESC, rid) AS rank FROM (SELECT qid, rid, score, coverage FROM hits)))
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.rid, b.rid) AS rid, a.rank AS rank_a, b.rank AS rank_b, b.rank - a.rank AS shift FROM hits a FULL JOIN b ON a.qid = b.qid AND a.rid = b.rid WHERE a.rank IS DISTINCT FROM b.rank""")
def i5_compare_runs(spark, d):
    """BM25 order against the same hits ordered by coverage."""
    from pyspark.sql import Window

    hits = R.bm25(C.questions(spark, d), C.passage_index(spark, d))
    other = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("coverage").desc(), F.col("score").desc(), "rid")).cast("long"))
    return V.compare_runs(hits, other)


@query("""SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS good, round(median(n_chars), 6) AS median_chars, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())""")
def i7_summarize_gold(spark, d):
    rows = C.read(spark, d, "documents").join(C.read(spark, d, "labels"), "doc_id")
    return V.summarize(rows, [["lang"], ["source"], []], [F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.median("n_chars"), 6).alias("median_chars"), F.round(F.avg("toxic"), 6).alias("toxic")])


@query("SELECT user_id, count(DISTINCT event_type) AS n_values, count(*) AS n_runs, count(DISTINCT event_type) = 1 AS same FROM events GROUP BY user_id")
def i9_run_consistency(spark, d):
    return V.consistency(C.read(spark, d, "events"), "user_id", "event_type")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('7' || doc_id)) AS k FROM documents) WHERE k <= 5")
def i10_stratified_sample(spark, d):
    return V.stratified(C.read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5, "7")


@query("SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def i12_pass_rate(spark, d):
    rows = C.read(spark, d, "documents").join(C.read(spark, d, "labels"), "doc_id")
    return rows.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("rate"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95, round(max(value), 6) AS most FROM events GROUP BY event_type")
def i16_duration_stats(spark, d):
    return V.duration_stats(C.read(spark, d, "events"), ["event_type"], "value")


@query("SELECT event_type AS stage, 'k' AS key, count(DISTINCT user_id) AS answers, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY event_type")
def i17_loss_summary(spark, d):
    events = C.read(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("answer"), F.from_json("props", "map<string,bigint>").alias("counts"))
    return V.loss_summary(events, "counts").filter("total IS NOT NULL")


@query("""SELECT user_id, count(*) AS calls, round(sum(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18, 4)) END), 4) AS known_cost, count(*) FILTER (event_type = 'error') AS unknown, count(*) FILTER (event_type = 'error') = 0 AS complete FROM events GROUP BY user_id""")
def i18_cost_summary(spark, d):
    """An event's value as its cost; that of an error is unknown."""
    calls = C.read(spark, d, "events").withColumn("cost", F.when(F.col("event_type") != "error", F.col("value").cast("decimal(18,4)")))
    return V.cost_summary(calls, ["user_id"], "cost")


@query("SELECT event_type AS stage, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def i20_model_usage(spark, d):
    return C.read(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT quality AS expected, CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END AS got, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def i24_label_agreement(spark, d):
    """Labels of quality against a rule on length."""
    got = C.read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 200, 1).otherwise(0).alias("got"))
    return V.label_agreement(C.read(spark, d, "labels").select("doc_id", F.col("quality").alias("expected")), got, "doc_id")


@query("SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS n_revisions, count(DISTINCT json_extract_string(props, '$.k')) <= 1 AS pooled FROM events GROUP BY user_id")
def i19_mixed_revision_guard(spark, d):
    return V.revisions(C.read(spark, d, "events").withColumn("revision", F.get_json_object("props", "$.k")), "user_id", "revision")


@query("""SELECT doc_id, quality = 1 AS together, n_chars >= 400 AS alone, quality = 1 AND n_chars < 400 AS risky FROM labels JOIN documents USING (doc_id) WHERE (quality = 1) <> (n_chars >= 400)""")
def i21_judgement_diff(spark, d):
    """Labels of quality as one reading, length as the other."""
    labels = C.read(spark, d, "labels").filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return V.judgement_diff(labels, C.read(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 400).alias("ok")), ["doc_id"])


@query(f"""WITH {S.BM25}, r AS (SELECT qid, qid % 3 = 0 AS gone FROM q WHERE qid >= 10) SELECT qid, CASE WHEN coverage IS NULL THEN 'no match' WHEN coverage < 0.34 THEN 'weak match' ELSE 'strong match' END AS note FROM r LEFT JOIN (SELECT qid, coverage FROM hits WHERE rank = 1) USING (qid) WHERE gone""")
def i22_unanswered_review(spark, d):
    """Every third question abstained; questions below 10 are older than the review."""
    asked = C.questions(spark, d)
    replies = asked.select("qid", F.col("qid").alias("at"), F.when(F.col("qid") % 3 == 0, "abstained").otherwise("answered").alias("status"))
    return V.unanswered_review(replies, R.bm25(asked, C.passage_index(spark, d)), F.lit(10))


@query(f"""WITH {_SENTENCES}, a AS (SELECT answer, style, count(*) AS n, max(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS longest, bool_or(regexp_matches(text, '(?:thanks|help)')) AS hard FROM st WHERE style <> 'other' GROUP BY answer, style),
l AS (SELECT * FROM (VALUES ('kids', 3, 8), ('youth', 5, 12), ('extended', 9, 15)) v(style, most, words))
SELECT answer, 'too many sentences' AS flag FROM a JOIN l USING (style) WHERE n > most UNION ALL SELECT answer, 'a sentence too long' FROM a JOIN l USING (style) WHERE longest > words UNION ALL SELECT answer, 'hard words' FROM a JOIN l USING (style) WHERE hard""")
def i25_style_audit(spark, d):
    limits = spark.createDataFrame([("kids", 3, 8), ("youth", 5, 12), ("extended", 9, 15)], "style string, sentences int, longest int")
    return V.style_audit(_sentences(spark, d), limits, ["thanks", "help"])


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS t FROM w)
SELECT a.conv_id || '/' || a.turn AS qid, round(CASE WHEN len(a.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / len(a.t) END, 6) AS share FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def i25_shared_trigrams(spark, d):
    """Each turn of a conversation against the next."""
    turns = C.read(spark, d, "conversations")
    key = lambda back: F.concat_ws("/", "conv_id", F.col("turn") - back).alias("qid")
    return V.shared_trigrams(turns.select(key(0), "text"), turns.select(key(1), "text"))


@query("""SELECT event_type AS model, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(floor(value)) AS BIGINT) AS tokens_out FROM events GROUP BY event_type""")
def i26_token_usage(spark, d):
    events = C.read(spark, d, "events").select(F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").alias("v"))
    return events.groupBy("model").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens_in"), F.sum("v").alias("tokens_out"))


# --- batch twins of the streams -------------------------------------------------------------------


@query("SELECT user_id AS request_id, n_requests, coalesce(n_events, 0) AS n_events, coalesce(done, false) AS done FROM (SELECT user_id, count(*) AS n_requests FROM events WHERE event_type = 'view' GROUP BY user_id) LEFT JOIN (SELECT user_id, count(*) AS n_events, bool_or(event_type = 'purchase') AS done FROM events WHERE event_type <> 'view' GROUP BY user_id) USING (user_id)")
def j1_assemble_traces(spark, d):
    """I15 and J1: requests with their late events; a purchase closes one."""
    events = C.read(spark, d, "events")
    requests = events.filter("event_type = 'view'").groupBy(F.col("user_id").alias("request_id")).agg(F.count("*").alias("n_requests"))
    kinds = events.filter("event_type <> 'view'").select(F.col("user_id").alias("request_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("event").alias("kind"))
    return V.assemble(requests, kinds)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, ts, k, true AS accepted, [t] AS held FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.ts, o.k, ok, CASE WHEN ok THEN list_append(seen, t) ELSE seen END FROM (
  SELECT o.*, list_filter(held, lambda a: a > t - 3600) AS seen, len(list_filter(held, lambda a: a > t - 60)) < 20 AND len(list_filter(held, lambda a: a > t - 3600)) < 200 AS ok FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) o)
SELECT user_id, event_id, ts, accepted FROM r""")
def j2_rate_limit(spark, d):
    return J.rate_limit_batch(C.read(spark, d, "events"))


@query("""SELECT key, version, kept_at, reply FROM (SELECT user_id AS key, event_type AS version, ts AS kept_at, props AS reply, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props) AS k FROM events)
WHERE k = 1 AND version = 'view' AND kept_at > (SELECT max(ts) FROM events) - INTERVAL 30 DAY ORDER BY kept_at DESC, key LIMIT 5000""")
def j3_reply_cache(spark, d):
    events = C.read(spark, d, "events")
    replies = events.select(F.col("user_id").alias("key"), F.col("event_type").alias("version"), F.col("ts").alias("kept_at"), F.col("props").alias("reply"))
    now = events.agg(F.max("ts").cast("string")).first()[0]
    return J.merge_replies(replies.limit(0), replies, "view", now)


@query("""WITH RECURSIVE e AS (SELECT user_id || event_type AS key, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
nx AS MATERIALIZED (SELECT a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS nxt FROM e a JOIN e b ON a.key = b.key AND b.ts - a.ts > INTERVAL 86400 SECOND GROUP BY a.event_id),
c AS (SELECT event_id FROM e WHERE k = 1 UNION ALL SELECT nxt FROM c JOIN nx USING (event_id))
SELECT key, event_id, ts FROM c JOIN e USING (event_id)""")
def j4_single_flight(spark, d):
    return J.single_flight_batch(C.read(spark, d, "events").select(F.concat("user_id", "event_type").alias("key"), "event_id", "ts"), 86_400)


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def j5_counters(spark, d):
    return J.counters(C.read(spark, d, "events"))


@query(f"SELECT conv_id, turn FROM conversations WHERE NOT list_has_all({S.tokens('text')}, ['thanks', 'help'])")
def j6_forget(spark, d):
    rows = C.read(spark, d, "conversations").withColumn("tokens", T.tokenize(F.col("text")))
    return J.forget(rows, ["thanks", "help"], "tokens").select("conv_id", "turn")
