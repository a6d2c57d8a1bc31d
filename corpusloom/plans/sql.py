"""The parts that the SQL of several queries shares."""

from corpusloom.functions.text import MARKS, PREFIXES, STOPWORDS, TATWEEL, VARIANTS


def array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STOP = array(STOPWORDS)


def _re2(pattern: str) -> str:
    out, k = "", 0
    while k < len(pattern):
        if pattern[k : k + 2] == "\\u":
            out, k = out + "\\x{" + pattern[k + 2 : k + 6] + "}", k + 6
        else:
            out, k = out + pattern[k], k + 1
    return out


def normal(x: str) -> str:
    return f"trim(regexp_replace(lower(translate(replace(regexp_replace(coalesce({x}, ''), '{_re2(MARKS)}', '', 'g'), '{TATWEEL}', ''), '{VARIANTS[0]}', '{VARIANTS[1]}')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def tokens(x: str) -> str:
    raw = f"list_filter(string_split({normal(x)}, ' '), lambda t: NOT list_contains({STOP}, t))"
    bare = f"list_transform({raw}, lambda t: regexp_replace(t, '^(?:{'|'.join(PREFIXES)})(.{{2,}})$', '\\1'))"
    return f"list_filter({bare}, lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))"


PASSAGES = """p AS (
  SELECT doc_id * 1000000 + (i - 1) AS rid, doc_id || ':' || (i - 1) AS id, source AS source_id, doc_id AS location, lang AS kind, ls[i] AS text
  FROM (SELECT doc_id, source, lang, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents))
  WHERE ls[i] <> ''
)"""
QUESTIONS = "q AS (SELECT item_id AS qid, text FROM benchmark)"
#: tok(rid, pos, token), qt(qid, token, n_terms)
TOKENS = f"""pt AS MATERIALIZED (SELECT rid, {tokens('text')} AS t FROM p),
tok AS MATERIALIZED (SELECT rid, i - 1 AS pos, t[i] AS token FROM (SELECT rid, t, unnest(range(1, len(t) + 1)) AS i FROM pt)),
ql AS MATERIALIZED (SELECT qid, {tokens('text')} AS t FROM q),
qt AS (SELECT qid, unnest(list_distinct(t)) AS token, len(list_distinct(t)) AS n_terms FROM ql)"""
BM25 = f"""{PASSAGES}, {QUESTIONS}, {TOKENS},
post AS (SELECT token, rid, count(*) AS tf FROM tok GROUP BY token, rid),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM pt),
idf AS (SELECT token, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY token),
sc AS (
  SELECT qid, post.rid, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(pt.t) / (SELECT avgdl FROM st)))), 6) AS score, count(*) / max(n_terms) AS coverage
  FROM qt JOIN post USING (token) JOIN idf USING (token) JOIN pt ON pt.rid = post.rid GROUP BY qid, post.rid
),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM sc WHERE score > 0) WHERE rank <= 10)"""
#: run(qid, n, rid, start, qstart, run): maximal runs of two tokens or more
RUNS = f"""{PASSAGES}, {QUESTIONS}, {TOKENS},
qp AS (SELECT qid, len(t) AS n, i - 1 AS pos, t[i] || ' ' || t[i + 1] AS pair FROM (SELECT qid, t, unnest(range(1, len(t))) AS i FROM ql)),
dp AS (SELECT rid, i - 1 AS dpos, t[i] || ' ' || t[i + 1] AS pair FROM (SELECT rid, t, unnest(range(1, len(t))) AS i FROM pt)),
met AS (SELECT qid, n, rid, pos, dpos - pos AS diagonal FROM qp JOIN dp USING (pair)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY qid, rid, diagonal ORDER BY pos) AS island FROM met),
run AS (SELECT qid, n, rid, min(pos) + diagonal AS start, min(pos) AS qstart, count(*) + 1 AS run FROM isl GROUP BY qid, n, rid, diagonal, island)"""
PHRASES = """ph AS (
  SELECT DISTINCT qid, rid FROM run WHERE run = n
  UNION SELECT qid, rid FROM ql JOIN tok ON len(ql.t) = 1 AND tok.token = ql.t[1]
)"""
