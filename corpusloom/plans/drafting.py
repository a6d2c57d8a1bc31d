"""Queries of drafts, of sentences' rules, and of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import forms
from corpusloom.functions import text as T
from corpusloom.functions.tables import saved
from corpusloom.operators import dictionary as D
from corpusloom.operators import drafts as P
from corpusloom.operators import sections as N
from corpusloom.plans import sql as S
from corpusloom.plans.base import query
from corpusloom.plans.lookup import ENTRIES, VERSES, arabic, arabic_sql, cores_sql, entries, keys_sql, questions, skeleton_sql, stem_sql, supports_sql, verses
from corpusloom.sources import books as B
from corpusloom.sources import corpus as C

_P = S.PASSAGES
_CLAIMS = """cs AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: true) AS ss FROM conversations WHERE role = 'assistant'),
cl AS (SELECT conv_id, turn, i - 1 AS n, ss[i] AS text, (conv_id + i - 1) || ':0' AS cited FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM cs) WHERE trim(ss[i]) <> '')"""


def _key():
    return F.concat_ws("/", "conv_id", "turn").alias("key")


# --- drafts -----------------------------------------------------------------------------------------


@query(f"""WITH {_CLAIMS}, k AS (SELECT *, conv_id || '/' || turn AS key, (conv_id + turn) % 8 AS k FROM cl),
o AS (SELECT key, n AS i, cited, CASE WHEN k = 7 THEN trim(regexp_replace(translate(text, '[]', ''), '\\s+', ' ', 'g')) ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS text
 FROM k WHERE k NOT IN (4, 5) AND (k <> 6 OR n % 2 = 0) AND (k <> 7 OR length(trim(regexp_replace(translate(text, '[]', ''), '\\s+', ' ', 'g'))) > 3))
SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS n, text, cited AS ids FROM o WHERE text <> ''""")
def h31_parse_drafts(spark, d):
    """The assistant's turns as replies in eight shapes: plain, fenced, after thoughts, amid prose, abstaining, of a wrong type, with malformed items, as prose with ids."""
    k = (F.col("conv_id") + F.col("turn")) % 8
    good = F.to_json(F.struct("text", F.array("cited").alias("passage_ids")))
    item = F.when((k == 6) & (F.col("n") % 2 == 1), F.lit('"malformed"')).otherwise(good)
    prose = F.concat(F.lit("["), F.col("cited"), F.lit("] "), F.translate("text", "[]", ""))
    turns = C.claims(spark, d).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("n", item.alias("item"), prose.alias("prose")))).alias("x"))
    of = lambda name, glue: F.array_join(F.transform("x", lambda r: r[name]), glue)
    body = F.concat(F.lit('{"claims": ['), of("item", ", "), F.lit("]}"))
    raw = (
        F.when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("<think>first { then</think>"), body))
        .when(k == 3, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .when(k == 4, F.concat(F.lit('{"abstain": "Yes", "claims": ['), of("item", ", "), F.lit("]}")))
        .when(k == 5, F.lit('{"claims": "none"}'))
        .when(k == 7, of("prose", " "))
        .otherwise(body)
    )
    return P.parse_drafts(turns.select(_key(), raw.alias("raw"))).select("key", "n", "text", F.col("ids")[0].alias("ids"))


@query(f"""WITH {_CLAIMS}, t AS (SELECT conv_id, turn, conv_id || '/' || turn AS key, count(*) AS n FROM cl GROUP BY ALL)
SELECT key, CASE (conv_id + turn) % 7 WHEN 1 THEN 'problem missing or of another length' WHEN 2 THEN 'evidence missing or of another length' WHEN 3 THEN 'evidence of the wrong type'
 WHEN 4 THEN 'missing of another length' WHEN 5 THEN 'on_topic of another length' WHEN 6 THEN 'not an object' END AS reason, CASE WHEN (conv_id + turn) % 7 = 0 THEN n ELSE 0 END AS verdicts FROM t""")
def h32_check_reply_shape(spark, d):
    """Replies about the assistant's sentences, one fault of each kind planted among seven."""
    turns = C.claims(spark, d).groupBy("conv_id", "turn").agg(F.count("*").alias("count"))
    k = (F.col("conv_id") + F.col("turn")) % 7
    many = lambda x, n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(x), n.cast("int")), ", "), F.lit("]"))
    n = F.col("count")
    problem = F.concat(F.lit('{"problem": '), many('""', F.when(k == 1, n + 1).otherwise(n)))
    evidence = F.when(k == 2, "").when(k == 3, F.concat(F.lit(', "evidence": '), many("1", n))).otherwise(F.concat(F.lit(', "evidence": '), many('"w"', n)))
    rest = F.when(k == 4, ', "missing": []').when(k == 5, ', "on_topic": "yes"').otherwise(F.concat(F.lit(', "missing": '), many('""', n)))
    raw = F.when(k == 6, "no verdicts").otherwise(F.concat(problem, evidence, rest, F.lit("}")))
    checked = P.check_reply_shape(turns.select(_key(), raw.alias("raw"), "count"))
    return checked.select("key", "reason", F.coalesce(F.size("problem"), F.lit(0)).cast("long").alias("verdicts")).withColumn("verdicts", F.greatest("verdicts", F.lit(0).cast("long")))


_TAILS = ["«نص مما يؤكد ذلك", "مما يؤكد ذلك", "، وهذا يحدد ذلك", "وهذا حسن"]


@query(f"""WITH {_CLAIMS}, w AS (SELECT conv_id, turn, n, text || ' ' || CASE n % 4 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS))} END AS full_text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, text FROM cl)
SELECT conv_id, turn, n, CASE WHEN n % 4 IN (1, 2) AND len(w) + CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END >= 4 AND length(text) - length(replace(text, '«', '')) = length(text) - length(replace(text, '»', '')) THEN rtrim(array_to_string(w, ' '), ' ،,؛:') || '.' ELSE full_text END AS text FROM w""")
def h30_cut_inference(spark, d):
    """The assistant's sentences with conclusions planted behind them: inside a quotation, by a mark, after a demonstrative, and none."""
    tail = F.coalesce(*[F.when(F.col("n") % 4 == i, F.lit(t)) for i, t in enumerate(_TAILS)])
    return C.claims(spark, d).select("conv_id", "turn", F.col("n").cast("long").alias("n"), P.cut_inference(F.concat_ws(" ", "text", tail)).alias("text"))


_SAYS = ["وبالتالي {}", "{} في ذلك", "كما {}", "مثلا {} يشبه ذلك", "{}، فهذا مثال على ذلك.", "واما {}", "{} وقد اختلف العلماء", "Thus {}", "{}"]


@query(f"""WITH {_CLAIMS}, s AS (SELECT conv_id, turn, n, CASE n % 9 {' '.join(f"WHEN {i} THEN '{t.split('{}')[0]}' || text || '{t.split('{}')[1]}'" for i, t in enumerate(_SAYS))} END AS text, CASE WHEN n % 4 = 0 THEN 'Some scholars' WHEN n % 4 = 1 THEN 'القول الأول' ELSE split_part(text, ' ', 1) END AS school FROM cl),
w AS (SELECT *, list_filter(string_split({S.normal('text')}, ' '), lambda x: x <> '') AS w FROM s),
h AS (SELECT *, list_contains({S.array(P.HALVES)}, w[1]) AND len(list_filter(w[3:], lambda x: starts_with(x, 'ف') AND length(x) > 2)) = 0 AS half FROM w)
SELECT conv_id, turn, n, list_contains({S.array(P.ALONE)}, coalesce(w[1], '')) OR regexp_matches(text, '{P.CONCLUDES}') AS concludes, coalesce(half, false) AS unfinished,
 coalesce(half, false) OR (len(list_filter(w, lambda x: NOT list_contains({S.array(P.EMPTY)}, x))) < 3 AND list_contains({S.array(P.POINTERS)}, coalesce(w[len(w)], ''))) AS says_little,
 starts_with(array_to_string(w, ' '), '{P.EXAMPLE}') AND regexp_matches(array_to_string(w, ' '), '{P.LIKENS}') AS likens, regexp_matches(text, '{P.LINKS}') AS links,
 regexp_matches(text, '{P.LABELS_CASE}') AS labels_case, regexp_matches(text, '{P.DISAGREES}') AS disagrees, regexp_matches(school, '{P.UNNAMED}') AS unnamed FROM h""")
def h15_sentence_flags(spark, d):
    """The assistant's sentences, one of eight faults planted in each nine, and views that name no one."""
    n = F.col("n")
    text = F.coalesce(*[F.when(n % 9 == i, F.concat(F.lit(t.split("{}")[0]), F.col("text"), F.lit(t.split("{}")[1]))) for i, t in enumerate(_SAYS)])
    school = F.when(n % 4 == 0, "Some scholars").when(n % 4 == 1, "القول الأول").otherwise(F.substring_index("text", " ", 1))
    return C.claims(spark, d).select("conv_id", "turn", n.cast("long").alias("n"), P.sentence_flags(text, school).alias("f")).select("conv_id", "turn", "n", "f.*")


_COPIED = P.COPIED.replace("'", "''")


@query(f"""WITH {_CLAIMS}, q AS (SELECT conv_id || '/' || turn || '/' || n AS claim, '"' || array_to_string(string_split(text, ' ')[1:5 + n % 3], ' ') || '" ' || array_to_string(string_split(text, ' ')[6 + n % 3:], ' ') AS text FROM cl),
s AS (SELECT claim, coalesce(list_sum(list_transform(regexp_extract_all(text, '{_COPIED}'), lambda x: len(string_split_regex(trim(x), '\\s+')))), 0) AS c, greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS n FROM q)
SELECT claim, round(c / n, 6) AS share, c / n > 0.5 AS copies FROM s""")
def h14_copied_share(spark, d):
    """The assistant's sentences with their first five to seven words quoted."""
    w, n = F.split("text", " "), (F.col("n") % 3).cast("int")
    text = F.concat(F.lit('"'), F.array_join(F.slice(w, F.lit(1), 5 + n), " "), F.lit('" '), F.array_join(F.slice(w, 6 + n, F.size(w)), " "))
    return P.copied_share(C.claims(spark, d).select(F.concat_ws("/", "conv_id", "turn", "n").alias("claim"), text.alias("text")))


def _roots_sql(rows: str, word: str) -> str:
    return f"(SELECT DISTINCT key, {word}, r FROM (SELECT key, {word}, unnest([{stem_sql(word)}, {skeleton_sql(stem_sql(word))}]) AS r FROM {rows}) WHERE r <> '')"


def _found_sql(name: str, tokens: str, held: str) -> str:
    """name(key, token): tokens (key, token) that held (key, token) has in any form."""
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT a.key, a.token FROM {_roots_sql(tokens, 'token')} a JOIN {_roots_sql(held, 'token')} b ON a.key = b.key AND
 (a.r = b.r OR (a.r[1] <> '~' AND b.r[1] <> '~' AND least(length(a.r), length(b.r)) >= 3 AND (starts_with(a.r, b.r) OR starts_with(b.r, a.r)))))"""


@query(f"""WITH {VERSES},
x AS (SELECT rid AS key, ws, ws[1] AS subject, list_concat(ws[4:least(len(ws), 9)], CASE rid % 3 WHEN 0 THEN ['ضفدع', 'قرنفل', 'زنجبيل'] ELSE [] END) AS defining FROM v WHERE len(ws) >= 6 AND NOT list_has_any(ws[1:9], {S.array(P.COPULAS + P.DEFINES)})),
sub AS MATERIALIZED (SELECT key, unnest({S.tokens('subject')}) AS token FROM x),
con AS MATERIALIZED (SELECT key, token, pos FROM (SELECT key, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT key, {S.tokens("array_to_string(defining, ' ')")} AS t FROM x)) WHERE NOT list_contains({S.array(P.FILLER)}, token)),
{_found_sql('insub', 'con', 'sub')},
con2 AS MATERIALIZED (SELECT * FROM con WHERE (key, token) NOT IN (SELECT (key, token) FROM insub)),
have AS MATERIALIZED (SELECT DISTINCT key, unnest({S.tokens("array_to_string(list_concat(ws[1:1], ws[6:]), ' ')")}) AS token FROM x),
{_found_sql('there', 'con2', 'have')},
g AS (SELECT key, count(*) AS n, count(there.token) AS found, string_agg(con2.token, ' ' ORDER BY pos) FILTER (WHERE there.token IS NULL) AS missing FROM con2 LEFT JOIN there USING (key, token) GROUP BY key)
SELECT key AS claim, missing FROM g WHERE n >= 2 AND found < 0.75 * n""")
def h13_invented_definition(spark, d):
    """Definitions made of verses: the first word "is" six of its words, with words of no passage added to a third of them; the passage cited lacks two of the six."""
    w = F.filter(F.split(T.normalize(F.col("text")), " "), lambda x: x != "")
    rows = verses(spark, d).select("rid", F.explode(F.array(w)).alias("w")).filter(F.size("w") >= 6).filter(~F.exists(F.slice("w", 1, 9), lambda x: x.isin(P.COPULAS + P.DEFINES)))
    rows = saved(rows, "cited-verses")
    added = F.when(F.col("rid") % 3 == 0, F.array(*[F.lit(x) for x in ("ضفدع", "قرنفل", "زنجبيل")])).otherwise(F.array().cast("array<string>"))
    claims = rows.select(F.col("rid").alias("claim"), F.array_join(F.concat(F.slice("w", 1, 1), F.array(F.lit("هي")), F.slice("w", 4, 6), added), " ").alias("text"))
    cited = rows.select(F.col("rid").alias("claim"), F.array_join(F.concat(F.slice("w", 1, 1), F.slice("w", F.lit(6), F.size("w"))), " ").alias("text"))
    return P.invented_definition(claims, cited).select("claim", F.array_join("missing", " ").alias("missing"))


# --- books ------------------------------------------------------------------------------------------

_SPAN = "CASE WHEN p2 = p1 AND g1 = g2 THEN g1 || '' WHEN p1 = p2 THEN g1 || '-' || g2 ELSE g1 || ' - ' || p2 || ', ' || g2 END"


@query(f"""WITH RECURSIVE ti AS (SELECT lang AS book, doc_id AS tid, CASE WHEN doc_id % 25 = 0 THEN CASE WHEN doc_id % 100 = 0 THEN NULL ELSE doc_id - doc_id % 100 END ELSE doc_id - doc_id % 25 END AS parent, array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:2], ' ') AS name FROM documents WHERE doc_id % 5 = 0),
tr AS (SELECT a.book, a.tid, array_to_string(list_filter([CASE WHEN b.tid IS NOT NULL THEN c.name END, b.name, a.name], lambda x: x IS NOT NULL AND x <> ''), ' / ') AS trail
 FROM ti a LEFT JOIN ti b ON b.book = a.book AND b.tid = a.parent LEFT JOIN ti c ON c.book = b.book AND c.tid = b.parent),
pg AS (SELECT lang AS book, doc_id AS pid, doc_id // 100 + 1 AS part, doc_id % 100 AS page, string_split_regex(text, '\\r?\\n') AS ls, (SELECT max(tid) FROM ti WHERE ti.book = d.lang AND ti.tid <= d.doc_id) AS tid FROM documents d),
pa AS (SELECT book, tid, pid, part, page, i, trim(regexp_replace(ls[i], '\\s+', ' ', 'g')) AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM pg)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY book, coalesce(tid, -1) ORDER BY pid, i) AS k FROM pa WHERE text <> ''),
r AS (SELECT book, tid, k, 0 AS chunk, length(text) + 1 AS used FROM o WHERE k = 1
 UNION ALL SELECT o.book, o.tid, o.k, CASE WHEN used + length(text) + 1 > 1500 THEN chunk + 1 ELSE chunk END, CASE WHEN used + length(text) + 1 > 1500 THEN length(text) + 1 ELSE used + length(text) + 1 END
 FROM r JOIN o ON o.book = r.book AND o.tid IS NOT DISTINCT FROM r.tid AND o.k = r.k + 1),
g AS (SELECT book, tid, chunk, string_agg(text, chr(10) ORDER BY k) AS text, arg_min(part, k) AS p1, arg_max(part, k) AS p2, arg_min(page, k) AS g1, arg_max(page, k) AS g2 FROM r JOIN o ON o.book = r.book AND o.tid IS NOT DISTINCT FROM r.tid AND o.k = r.k GROUP BY ALL)
SELECT g.book, coalesce(g.tid, -1) AS heading, chunk, coalesce(trail, '') AS trail, '(' || CASE WHEN p1 = 1 THEN '' ELSE p1 || ', ' END || {_SPAN} || ')' AS span, text FROM g LEFT JOIN tr ON tr.book = g.book AND tr.tid = g.tid""".replace("string_agg(text, chr(10) ORDER BY k)", "string_agg(text, chr(10) ORDER BY o.k)").replace("arg_min(part, k)", "arg_min(part, o.k)").replace("arg_max(part, k)", "arg_max(part, o.k)").replace("arg_min(page, k)", "arg_min(page, o.k)").replace("arg_max(page, k)", "arg_max(page, o.k)").replace("SELECT book, tid, chunk, string_agg", "SELECT o.book, o.tid, chunk, string_agg").replace("CASE WHEN p2 = p1", "CASE WHEN p1 = p2"))
def a7_read_paged(spark, d):
    """Documents as the pages of a book for each language, every fifth of them under a heading."""
    docs = C.read(spark, d, "documents")
    i = F.col("doc_id")
    pages = docs.select(F.col("lang").alias("book"), i.alias("pid"), (F.floor(i / 100) + 1).alias("part"), (i % 100).alias("page"), F.col("text").alias("body"), F.lit(None).cast("string").alias("foot"))
    parent = F.when(i % 25 != 0, i - i % 25).when(i % 100 != 0, i - i % 100)
    name = F.array_join(F.slice(F.split(F.substring_index("text", "\n", 1), " "), 1, 2), " ")
    titles = docs.filter(i % 5 == 0).select(F.col("lang").alias("book"), i.alias("tid"), i.alias("page"), parent.alias("parent"), name.alias("text"))
    return B.read_paged(pages, titles).withColumn("heading", F.coalesce("heading", F.lit(-1).cast("long")))


@query(rf"""WITH {_P}, s AS (SELECT rid, kind AS book, {arabic_sql('text')} AS text FROM p), c AS (SELECT *, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM s),
v AS (SELECT DISTINCT book, unnest(regexp_extract_all(text, '[\x{{0621}}-\x{{064A}}]+')) AS word FROM s)
SELECT book, rid AS entry, a || CASE WHEN regexp_extract(a, '[\x{{0621}}-\x{{064A}}]{{1,30}}$') <> '' AND regexp_extract(b, '^[\x{{0621}}-\x{{064A}}]{{1,30}}') <> '' AND EXISTS (SELECT 1 FROM v WHERE v.book = c.book AND v.word = regexp_extract(a, '[\x{{0621}}-\x{{064A}}]{{1,30}}$') || regexp_extract(b, '^[\x{{0621}}-\x{{064A}}]{{1,30}}')) THEN '' ELSE ' ' END || b AS text FROM c""")
def c6_glue_split_words(spark, d):
    """Lines cut in two at their middle, put together again by the words of their language."""
    rows = C.passages(spark, d).select("rid", F.col("kind").alias("book"), arabic(F.col("text")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    cut = F.array(F.substr("text", F.lit(1), half), F.substr("text", half + 1, F.char_length("text")))
    pieces = rows.select("book", F.col("rid").alias("entry"), F.posexplode(cut).alias("pos", "text"))
    words = rows.select("book", F.explode(F.regexp_extract_all("text", F.lit(f"{B.LETTERS}+"), F.lit(0))).alias("word"))
    return B.glue_split_words(pieces, words)


@query(f"""WITH {_P}, h AS (SELECT {S.tokens(f"'{' '.join(N.HEADING_WORDS.split())}'")} AS hw),
k AS (SELECT rid, location, {S.normal(arabic_sql('text'))} AS t FROM p), c0 AS (SELECT location, arg_min(t, rid) AS t FROM k GROUP BY location),
kw AS (SELECT rid, trim('كتاب ' || array_to_string(string_split(c0.t, ' ')[1:2], ' ')) AS chapter, array_to_string(string_split(k.t, ' ')[1:4], ' ') AS section FROM k JOIN c0 USING (location)),
ch AS MATERIALIZED (SELECT chapter, rid, list_filter(list_distinct(tk), lambda x: NOT list_contains(hw, x)) AS topic FROM (SELECT chapter, min(rid) AS rid, {S.tokens('chapter')} AS tk FROM kw GROUP BY chapter), h),
se AS MATERIALIZED (SELECT chapter, rid, list_filter(list_distinct(tk), lambda x: NOT list_contains(hw, x)) AS topic FROM (SELECT chapter, section, min(rid) AS rid, {S.tokens('section')} AS tk FROM kw WHERE section <> '' AND section <> chapter GROUP BY ALL), h),
q AS MATERIALIZED (SELECT item_id AS qid, list_filter(list_distinct({S.tokens(arabic_sql('text'))}), lambda x: NOT list_contains(hw, x)) AS w FROM benchmark, h),
n AS MATERIALIZED (SELECT qid, chapter, rid, row_number() OVER (PARTITION BY qid ORDER BY len(topic), rid) AS k FROM q JOIN ch ON len(topic) > 0 AND list_has_all(w, topic) QUALIFY k <= 2),
sh AS (SELECT qid, chapter, rid, len(list_intersect(topic, w)) AS shared, len(topic) AS size FROM q JOIN se ON list_has_any(w, topic)),
b AS MATERIALIZED (SELECT qid, chapter, rid, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, shared / size DESC, rid DESC, chapter DESC) AS k FROM sh WHERE shared >= 2 AND shared >= size / 2
 AND (qid NOT IN (SELECT qid FROM n) OR (qid, chapter) IN (SELECT (qid, chapter) FROM n)) QUALIFY k <= 2),
l AS (SELECT qid, rid, 0 AS tier, k FROM n UNION ALL SELECT qid, rid, 1, k FROM b),
f AS (SELECT n.qid, min(se.rid) AS rid, 2 AS tier, 1 AS k FROM n JOIN se USING (chapter) WHERE n.k = 1 AND (n.qid, n.chapter) NOT IN (SELECT (qid, chapter) FROM b) AND (n.qid, se.rid) NOT IN (SELECT (qid, rid) FROM l) GROUP BY n.qid)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first_at, rid) AS place, rid FROM (SELECT qid, rid, min((tier, k)) AS first_at FROM (SELECT * FROM l UNION ALL SELECT * FROM f) GROUP BY qid, rid)""")
def d17_section_openers(spark, d):
    """Documents as chapters named by their first two words, their lines as sections named by their first four, for benchmark items."""
    head = lambda c, n: F.substring_index(c, " ", n)
    rows = C.passages(spark, d).select("rid", "location", head(T.normalize(arabic(F.col("text"))), 4).alias("t"))
    rows = saved(rows, "line-openings")  # read four times
    first = rows.groupBy("location").agg(F.min_by("t", "rid").alias("first"))
    keywords = F.concat(F.lit("كتاب "), head("first", 2), F.lit("؛"), F.col("t"))
    book = N.Sections(rows.join(first, "location").select("rid", keywords.alias("keywords")))
    return N.section_openers(C.questions(spark, d).select("qid", arabic(F.col("text")).alias("text")), book)


@query(f"""WITH RECURSIVE {ENTRIES}, t AS (SELECT DISTINCT word AS term FROM q), {cores_sql('t')}, {keys_sql('t')},
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT rid, unnest({S.tokens(arabic_sql('text'))}) AS token FROM p) GROUP BY token),
rare AS (SELECT DISTINCT word AS term FROM (SELECT word, ({S.tokens('word')})[1] AS token FROM q) LEFT JOIN df USING (token) WHERE token IS NOT NULL AND coalesce(df, 0) <= 5),
b AS (SELECT item_id AS qid, list_filter(string_split({S.normal(arabic_sql('text'))}, ' '), lambda w: w <> '') AS ws FROM benchmark),
r AS (SELECT q.qid || '' AS id, word AS term, list_distinct(CASE q.qid % 3 WHEN 0 THEN list_filter(ws, lambda w: w <> word) WHEN 1 THEN list_append(list_filter(ws, lambda w: w <> word), word || 'ون') ELSE ws END) AS words FROM q JOIN b USING (qid)),
{supports_sql('r')}
SELECT qid, coalesce(NOT ok, false) AS lost FROM q LEFT JOIN sup ON sup.id = q.qid || ''""")
def d15_rewrite_lost_word(spark, d):
    """Questions about a word of each item, rewritten as the item without that word, with another form of it, and as it is."""
    asked = questions(spark, d)
    w = F.filter(F.split(T.normalize(arabic(F.col("text"))), " "), lambda x: x != "")
    items = C.questions(spark, d).select("qid", w.alias("w")).join(asked.select("qid", "word"), "qid")
    without = F.filter("w", lambda x: x != F.col("word"))
    kept = F.when(F.col("qid") % 3 == 0, without).when(F.col("qid") % 3 == 1, F.concat(without, F.array(F.concat("word", F.lit("ون"))))).otherwise(F.col("w"))
    rewrites = items.select("qid", F.array_join(kept, " ").alias("text"))
    return D.rewrite_lost_word(asked.select("qid", "text"), rewrites, entries(spark, d).select("rid", "text"))


_TYPED = (forms.KEYS[1], forms.KEYS[0])


@query(f"""WITH {ENTRIES}, tk AS (SELECT DISTINCT unnest({S.tokens(arabic_sql('text'))}) AS token FROM p),
ty AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN translate(word, '{_TYPED[0]}', '{_TYPED[1]}') ELSE word_latin END AS text FROM (SELECT qid, word, (SELECT text FROM benchmark WHERE item_id = qid) AS word_latin FROM q)),
rd AS (SELECT qid, translate(replace(lower(text), 'b', 'لا'), '{forms.KEYS[0].replace("'", "''")}', '{forms.KEYS[1]}') AS reading FROM ty WHERE regexp_matches(text, '^[A-Za-z\\[\\];'',./`\\s]+$') AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 3)
SELECT qid, reading FROM rd WHERE len({S.tokens('reading')}) > 0 AND list_has_all((SELECT list(token) FROM tk), {S.tokens('reading')})""".replace(f"translate(word, '{_TYPED[0]}', '{_TYPED[1]}')", "translate(word, '" + _TYPED[0] + "', '" + _TYPED[1].replace("'", "''") + "')"))
def b12_keyboard_reading(spark, d):
    """A word of every other item as typed on Latin keys, and the other items as they are."""
    asked = questions(spark, d).join(C.questions(spark, d).select("qid", F.col("text").alias("item")), "qid")
    typed = F.when(F.col("qid") % 2 == 0, F.translate("word", *_TYPED)).otherwise(F.col("item"))
    return D.keyboard_reading(asked.select("qid", typed.alias("text")), entries(spark, d).select("rid", "text"))
