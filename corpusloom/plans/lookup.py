"""Queries of dictionary search and of quotations that aren't word for word.

The tables hold Latin script; its letters are read as Arabic ones here, so that joined letters, endings and weak
letters stand in the words as the rules expect them. Lines of documents are the entries of a dictionary, each under
its first word; a benchmark item asks for one of its words. Sentences of documents are verses; quotations are the longest
verse of each document, spoilt in the way that a rule is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import forms
from corpusloom.functions import text as T
from corpusloom.operators import dictionary as D
from corpusloom.operators import retrieval as R
from corpusloom.operators import verses as Z
from corpusloom.plans import sql as S
from corpusloom.plans.base import query
from corpusloom.sources import corpus as C

LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ابثدوفجهيذكلمنوحقرستوعصخيز")


def arabic(col: Column) -> Column:
    return F.translate(F.lower(col), *LETTERS)


def arabic_sql(x: str) -> str:
    return f"translate(lower({x}), '{LETTERS[0]}', '{LETTERS[1]}')"


def entries(spark, d) -> DataFrame:
    rows = C.passages(spark, d).withColumn("text", arabic(F.col("text")))
    return rows.withColumn("heading", F.split(T.normalize(F.col("text")), " ")[0]).withColumn("kind", F.lit("gharib"))


def asked_word(text: Column) -> Column:
    """The first of the words whose length is closest to five."""
    words = F.transform(F.split(T.normalize(text), " "), lambda w, i: F.struct(F.abs(F.char_length(w) - 5).alias("n"), i.alias("i"), w.alias("w")))
    return F.array_min(words)["w"]


def questions(spark, d) -> DataFrame:
    """(qid, word, text): "what does … mean" about a word of each item."""
    items = C.questions(spark, d).select("qid", asked_word(arabic(F.col("text"))).alias("word"))
    return items.select("qid", "word", F.concat(F.lit("ما معنى "), "word").alias("text"))


# --- SQL parts ------------------------------------------------------------------------------------

_P = S.PASSAGES
_VALUES = lambda xs: ", ".join(f"('{x}')" for x in xs)
#: e(rid, heading, words), q(qid, word)
ENTRIES = f"""{_P},
e AS MATERIALIZED (SELECT rid, split_part(t, ' ', 1) AS heading, list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words FROM (SELECT rid, {S.normal(arabic_sql('text'))} AS t FROM p)),
q AS MATERIALIZED (SELECT qid, arg_min(w, (abs(length(w) - 5), i)) AS word FROM (SELECT item_id AS qid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, string_split({S.normal(arabic_sql('text'))}, ' ') AS ws FROM benchmark)) GROUP BY qid)"""


def stem_sql(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '^[{forms.STEM_LETTERS}](.{{4,}})$', '\\1'), '^ال(.{{3,}})$', '\\1')"
    return f"regexp_replace({bare}, '^(.{{3,}}?)(?:{'|'.join(forms.STEM_ENDS)})$', '\\1')"


def skeleton_sql(x: str) -> str:
    core = f"regexp_replace(translate(regexp_replace({x}, '{forms.DERIVED}', '\\1'), '{forms.WEAK}', ''), '^(.)ت(.)$', '\\1\\2')"
    return f"(CASE WHEN length({core}) >= 2 THEN '~' || {core} ELSE '' END)"


def cores_sql(terms: str, name: str = "core") -> str:
    """CTEs up to `name`(term, c) over the CTE `terms`(term)."""
    steps = [f"{name}_0 AS (SELECT term, term AS s FROM {terms} UNION SELECT term, substr(term, length(a) + 1) FROM {terms}, (VALUES {_VALUES(forms.JOINED)}) v(a) WHERE starts_with(term, a) AND length(term) - length(a) >= 2)"]
    for k, a in enumerate(forms.JOINED):
        steps.append(f"{name}_{k + 1} AS (SELECT * FROM {name}_{k} UNION SELECT term, substr(s, {len(a) + 1}) FROM {name}_{k} WHERE starts_with(s, '{a}') AND length(s) >= {len(a) + 3})")
    last = f"{name}_{len(forms.JOINED)}"
    cut = lambda of, ends: f"(SELECT DISTINCT term, substr(s, 1, length(s) - length(b)) AS s FROM {of}, (VALUES {_VALUES(ends)}) v(b) WHERE ends_with(s, b) AND length(s) - length(b) >= 2)"
    steps.append(f"{name}_e AS {cut(last, forms.ENDS)}")
    steps.append(f"{name}_f AS {cut(f'{name}_e', forms.SECOND_ENDS)}")
    steps.append(f"{name} AS MATERIALIZED (SELECT term, s AS c FROM (SELECT * FROM {last} UNION SELECT * FROM {name}_e UNION SELECT * FROM {name}_f) WHERE length(s) >= 2)")
    return ",\n".join(steps)


def keys_sql(terms: str, core: str = "core", name: str = "key") -> str:
    return f"""{name} AS MATERIALIZED (SELECT term, k FROM (SELECT term, translate(c, '{forms.WEAK}', '') AS k FROM {core} UNION SELECT term, {skeleton_sql(stem_sql('term'))} FROM {terms}) WHERE length(k) >= 2)"""


HEADING_KEYS = f"""hk AS MATERIALIZED (SELECT heading, k FROM (SELECT heading, translate(heading, '{forms.WEAK}', '') AS k FROM e UNION SELECT heading, {skeleton_sql('heading')} FROM e) WHERE length(k) >= 2)"""


def aligned_sql(pairs: str, name: str = "al") -> str:
    """CTEs up to `name`(term, word, close) over distinct pairs(term, word): rows of the local alignment, letter by letter."""
    return f"""{name}_r AS (
  SELECT term, word, 0 AS i, list_transform(range(0, length(word) + 1), lambda x: 0) AS r, 0 AS best FROM {pairs}
  UNION ALL
  SELECT term, word, i + 1, r2, greatest(best, list_max(r2)) FROM (
    SELECT term, word, i, best, list_prepend(0, list_transform(range(1, length(word) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: h[k] - (j - k))))) AS r2 FROM (
      SELECT term, word, i, best, list_transform(range(1, length(word) + 1), lambda j: greatest(0, r[j] + CASE WHEN substr(term, i + 1, 1) = substr(word, j, 1) THEN 2 ELSE -1 END, r[j + 1] - 1)) AS h
      FROM {name}_r WHERE i < length(term)))
),
{name} AS MATERIALIZED (SELECT term, word, max(best) / (2 * length(term)) AS close FROM {name}_r GROUP BY term, word)"""


# --- queries --------------------------------------------------------------------------------------


@query(f"""WITH {ENTRIES} SELECT qid, word, {stem_sql('word')} AS stem, translate(word, '{forms.WEAK}', '') AS strong, {skeleton_sql(stem_sql('word'))} AS skeleton FROM q""")
def b7_stems(spark, d):
    w = F.col("word")
    return questions(spark, d).select("qid", "word", forms.light_stem(w).alias("stem"), forms.strong_letters(w).alias("strong"), forms.root_skeleton(forms.light_stem(w)).alias("skeleton"))


@query(f"""WITH RECURSIVE {ENTRIES}, t AS (SELECT DISTINCT unnest(words) AS term FROM e), t2 AS (SELECT term FROM t WHERE term <> ''), {cores_sql('t2')}, {keys_sql('t2')},
c AS (SELECT term, string_agg(c, ' ' ORDER BY c) AS cores, count(*) AS n_cores FROM core GROUP BY term), ks AS (SELECT term, string_agg(k, ' ' ORDER BY k) AS keys FROM key GROUP BY term)
SELECT term, coalesce(cores, '') AS cores, coalesce(n_cores, 0) AS n_cores, coalesce(keys, '') AS keys FROM t2 LEFT JOIN c USING (term) LEFT JOIN ks USING (term)""")
def b8_cores(spark, d):
    """Cores and root keys of the whole vocabulary."""
    words = entries(spark, d).select(F.explode(F.split(T.normalize(F.col("text")), " ")).alias("term")).filter("term <> ''").distinct()
    cores = forms.cores(F.col("term"))
    return words.select("term", F.array_join(F.array_sort(cores), " ").alias("cores"), F.size(cores).cast("long").alias("n_cores"), F.array_join(F.array_sort(forms.root_keys(F.col("term"))), " ").alias("keys"))


_FOUND = f"""t AS (SELECT DISTINCT word AS term FROM q), {cores_sql('t')}, {keys_sql('t')}, {HEADING_KEYS},
found AS MATERIALIZED (SELECT DISTINCT word, heading FROM q JOIN key ON key.term = q.word JOIN hk USING (k)),
cand AS MATERIALIZED (SELECT DISTINCT word AS term, rid, words FROM found JOIN e USING (heading)),
pr AS (SELECT DISTINCT term, w AS word FROM (SELECT term, unnest(words) AS w FROM cand) WHERE abs(length(w) - length(term)) <= 2),
{aligned_sql('pr')},
cl AS (SELECT term, rid, round(max(coalesce(close, 0)), 6) AS close FROM (SELECT term, rid, unnest(words) AS word FROM cand) LEFT JOIN al USING (term, word) GROUP BY term, rid),
looked AS (SELECT qid, rid, close, row_number() OVER (PARTITION BY qid ORDER BY close DESC, rid) AS rank FROM q JOIN cl ON cl.term = q.word QUALIFY rank <= 6)"""


@query(f"""WITH RECURSIVE {ENTRIES}, {_FOUND} SELECT qid, rid, close, 100 + close AS score, 1.0::DOUBLE AS coverage, rank FROM looked""")
def d11_heading_lookup(spark, d):
    return D.heading_lookup(questions(spark, d).select("qid", "text"), D.Headings(entries(spark, d).select("rid", "heading", "text")))


_BM25_WORDS = S.BM25.replace(S.PASSAGES, f"{_P.replace('p AS (', 'p0 AS (')}, p AS (SELECT rid, {arabic_sql('text')} AS text FROM p0)").replace(S.QUESTIONS, "q AS (SELECT qid, 'ما معنى ' || word AS text FROM asked)")


@query(f"""WITH RECURSIVE found_by_heading AS MATERIALIZED (WITH RECURSIVE {ENTRIES}, {_FOUND} SELECT qid, rid, rank FROM looked), asked AS MATERIALIZED (WITH {ENTRIES} SELECT qid, word FROM q),
ranked AS MATERIALIZED (WITH {_BM25_WORDS} SELECT qid, rid, rank FROM hits),
both_ AS (SELECT qid, rid, 1 AS tier, rank AS r FROM found_by_heading UNION ALL SELECT qid, rid, 2, rank FROM ranked),
once AS (SELECT qid, rid, min((tier, r)) AS a, min(tier) AS tier FROM both_ GROUP BY qid, rid)
SELECT qid, rid, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a, rid) AS rank FROM once) WHERE rank <= 10""")
def d10_heading_tier(spark, d):
    """Questions about a word: entries under its root before those that hold it."""
    rows, asked = entries(spark, d), questions(spark, d).select("qid", "text")
    found = D.heading_lookup(asked, D.Headings(rows.select("rid", "heading", "text")))
    none = asked.select("qid", F.lit(0).cast("long").alias("rid")).limit(0)
    return R.tiered(none, R.bm25(asked, R.Index(rows)), headings=found)


@query(f"""WITH c0 AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'ما معنى ' || text ELSE text END AS text FROM conversations),
c AS (SELECT conv_id, turn, string_split({S.normal(arabic_sql('text'))}, ' ') AS ws, {S.tokens(arabic_sql('text'))} AS tk FROM c0)
SELECT conv_id, turn, list_has_any(ws, {S.array(D.FRAME)}) AS meaning,
  array_to_string(list_sort(list_filter(list_distinct(tk), lambda t: NOT list_contains({S.array(D.FRAME)}, t))), ' ') AS focus,
  array_to_string(list_sort(list_filter(list_distinct(ws), lambda w: length(w) >= 2 AND NOT list_contains({S.STOP}, w) AND NOT list_contains({S.array(D.FRAME)}, w))), ' ') AS raw
FROM c""")
def d12_meaning_terms(spark, d):
    """Every turn, each fourth one asking for the meaning of its words."""
    rows = C.read(spark, d, "conversations")
    text = arabic(F.when(F.col("turn") % 4 == 0, F.concat(F.lit("ما معنى "), "text")).otherwise(F.col("text")))
    rows = rows.select("conv_id", "turn", text.alias("text"))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return rows.select("conv_id", "turn", D.is_meaning_question(F.col("text")).alias("meaning"), joined(D.focus_terms(F.col("text"))).alias("focus"), joined(D.raw_terms(F.col("text"))).alias("raw"))


_RARE = f"""df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT rid, unnest({S.tokens(arabic_sql('text'))}) AS token FROM p) GROUP BY token),
rare AS (SELECT DISTINCT word AS term FROM (SELECT word, ({S.tokens('word')})[1] AS token FROM q) LEFT JOIN df USING (token) WHERE token IS NOT NULL AND coalesce(df, 0) <= 5)"""


def supports_sql(rows: str, name: str = "sup", heading: bool = False) -> str:
    """CTEs up to `name`(..., ok) over rows(id, term, words[, heading]) and the CTEs core and key of all terms."""
    rooted = "EXISTS (SELECT 1 FROM key JOIN hk USING (k) WHERE key.term = r.term AND hk.heading = r.heading)" if heading else "false"
    return f"""{name}_p AS (SELECT DISTINCT term, w AS word FROM (SELECT term, unnest(words) AS w FROM {rows}) WHERE abs(length(w) - length(term)) <= 2),
{aligned_sql(f'{name}_p', f'{name}_al')},
{name}_w AS (SELECT id, term, unnest(words) AS word FROM {rows}),
{name}_d AS (SELECT DISTINCT id, term FROM {name}_w w WHERE word = term OR word IN (SELECT c FROM core WHERE core.term = w.term AND length(c) >= 3)),
{name}_c AS (SELECT id, term, max(close) AS close FROM {name}_w JOIN {name}_al USING (term, word) GROUP BY id, term),
{name} AS MATERIALIZED (SELECT r.id, r.term, d.id IS NOT NULL OR CASE WHEN {rooted} THEN coalesce(close, 0) >= 0.6 ELSE coalesce(close, 0) >= 0.8 END AS ok
  FROM {rows} r LEFT JOIN {name}_d d USING (id, term) LEFT JOIN {name}_c USING (id, term))"""


@query(f"""WITH RECURSIVE {ENTRIES}, {_FOUND}, {_RARE},
n AS (SELECT qid, rid FROM looked UNION SELECT q.qid, e.rid FROM q JOIN e ON e.rid % 97 = q.qid % 97),
r AS (SELECT qid || '/' || rid AS id, word AS term, heading, words FROM n JOIN q USING (qid) JOIN e USING (rid) WHERE word IN (SELECT term FROM rare)),
{supports_sql('r', heading=True)}
SELECT qid, rid, coalesce(ok, true) AS keeps FROM n LEFT JOIN sup ON sup.id = qid || '/' || rid""")
def d13_keeps_entry(spark, d):
    """Entries found by root, and for each question about one entry in 97, most of which have nothing to do with it."""
    rows, asked = entries(spark, d), questions(spark, d).select("qid", "text")
    found = D.heading_lookup(asked, D.Headings(rows.select("rid", "heading", "text"))).select("qid", "rid")
    other = rows.select("rid", (F.col("rid") % 97).alias("m")).join(asked.select("qid", (F.col("qid") % 97).alias("m")), "m").select("qid", "rid")
    return D.keeps_entry(found.union(other).distinct(), asked, rows.select("rid", "kind", "heading", "text"), R.Index(rows))


# --- quotations that aren't word for word -----------------------------------------------------------

#: Sentences that one line has room for in the order key.
SENTENCES = 100_000


def verses(spark, d) -> DataFrame:
    """Sentences of lines: rid, doc_id, text."""
    rows = C.passages(spark, d).select("rid", F.col("location").alias("doc_id"), F.posexplode(F.split(arabic(F.col("text")), "\\. ", -1)).alias("i", "text"))
    return rows.select((F.col("rid") * SENTENCES + F.col("i")).alias("rid"), "doc_id", "text")


def longest_verse(spark, d) -> DataFrame:
    """(qid, t): the words of each document's longest verse, the first of equals."""
    rows = Z.words_of(verses(spark, d).withColumn("key", F.struct("doc_id", "rid")), "key").select("key.doc_id", "key.rid", "t")
    return rows.groupBy("doc_id").agg(F.min_by("t", F.struct(-F.size("t"), "rid")).alias("t")).select(F.col("doc_id").alias("qid"), "t")


def spoilt(spark, d, change) -> DataFrame:
    rows = longest_verse(spark, d)
    return rows.select("qid", F.array_join(change(F.col("t")), " ").alias("text"))


def one_wrong(t: Column) -> Column:
    """The last letter of the first word of five letters or more exchanged."""
    at = F.array_min(F.transform(t, lambda w, i: F.when(F.char_length(w) >= 5, i)))
    return T.let(at, lambda k: F.transform(t, lambda w, i: F.when(i == k, F.concat(F.substr(w, F.lit(1), F.char_length(w) - 1), F.lit("ض"))).otherwise(w)))


def one_missing(t: Column) -> Column:
    """Without the second word, the fourth one spelt with an alif more."""
    return F.transform(F.filter(t, lambda w, i: i != 1), lambda w, i: F.when(i == 2, F.concat(F.substring(w, 1, 1), F.lit("ا"), F.substring(w, 2, 1_000))).otherwise(w))


def without_joined(t: Column) -> Column:
    return F.transform(t, lambda w, i: F.when((i == 0) & (F.substring(w, 1, 1) == "و"), F.substring(w, 2, 1_000)).otherwise(w))


#: v(rid, doc_id, text, ws), lv(qid, ws)
VERSES = f"""{_P},
v0 AS (SELECT rid * {SENTENCES} + i - 1 AS rid, location AS doc_id, ls[i] AS text FROM (SELECT rid, location, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, location, string_split({arabic_sql('text')}, '. ') AS ls FROM p))),
v AS MATERIALIZED (SELECT rid, doc_id, text, list_filter(string_split({S.normal('text')}, ' '), lambda w: w <> '') AS ws FROM v0),
lv AS MATERIALIZED (SELECT doc_id AS qid, arg_min(ws, (-len(ws), rid)) AS ws FROM v GROUP BY doc_id)"""
_EVERY = """vw AS MATERIALIZED (SELECT rid, generate_subscripts({ws}, 1) AS i, unnest({ws}) AS w FROM v),
qw AS MATERIALIZED (SELECT qid, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM qs)"""


@query(f"""WITH {VERSES},
qs AS MATERIALIZED (SELECT qid, list_transform(ws, lambda w, i: CASE WHEN i = list_filter(range(1, len(ws) + 1), lambda j: length(ws[j]) >= 5)[1] THEN substr(w, 1, length(w) - 1) || 'ض' ELSE w END) AS ws FROM lv WHERE len(ws) >= 3),
{_EVERY.format(ws='ws')},
d AS MATERIALIZED (SELECT qid, rid, vw.i - qw.i AS start, count(*) AS n FROM qw JOIN vw USING (w) GROUP BY ALL),
f AS MATERIALIZED (SELECT d.*, qs.ws AS a, v.ws AS b FROM d JOIN qs USING (qid) JOIN v USING (rid) WHERE d.n >= len(qs.ws) - 1 AND start >= 0 AND start + len(qs.ws) <= len(v.ws)),
g AS (SELECT qid, rid, start, a[k] AS said, b[start + k] AS meant FROM (SELECT *, list_filter(range(1, len(a) + 1), lambda j: a[j] <> b[start + j])[1] AS k FROM f WHERE n = len(a) - 1))
SELECT qid, rid, start, said, meant FROM g WHERE qid NOT IN (SELECT qid FROM f WHERE n = len(a))
  AND least(length(said), length(meant)) >= 4 AND abs(length(said) - length(meant)) <= 1
  AND substr(said, 1, least(length(said), length(meant)) - 2) = substr(meant, 1, least(length(said), length(meant)) - 2)""")
def g7_misquoted(spark, d):
    """The longest verse of each document with one word spoilt."""
    return Z.misquoted(spoilt(spark, d, one_wrong), verses(spark, d).select("rid", "text"))


@query(f"""WITH {VERSES},
qs AS MATERIALIZED (SELECT qid, list_transform(ws, lambda w, i: CASE WHEN i = 1 AND w[1] = 'و' THEN w[2:] ELSE w END) AS ws FROM lv WHERE len(ws) >= 3),
q2 AS MATERIALIZED (SELECT qid, list_filter(ws, lambda w: w <> '') AS ws FROM qs),
o AS (SELECT rid, ws, unnest(range(0, len(ws) - 1)) AS start FROM v)
SELECT qid, rid, start FROM q2 JOIN o ON o.ws[start + 2] = q2.ws[2] AND o.ws[start + 3] = q2.ws[3] AND start + len(q2.ws) <= len(o.ws)
WHERE len(q2.ws) >= 3 AND o.ws[start + 2:start + len(q2.ws)] = q2.ws[2:] AND o.ws[start + 1] IN (q2.ws[1], 'و' || q2.ws[1], 'ف' || q2.ws[1])""")
def g21_loose_first_word(spark, d):
    """The longest verse of each document without the letter joined to its first word."""
    return Z.loosely(spoilt(spark, d, without_joined), verses(spark, d).select("rid", "text"))


def skeleton_words_sql(x: str) -> str:
    """Words of a spelling skeleton; the text has no marks or small letters."""
    inner = f"string_split(replace({S.normal(x)}, 'ء', ''), ' ')"
    return f"list_filter(list_transform({inner}, lambda w: regexp_replace(regexp_replace(w[1] || replace(w[2:], 'ا', ''), 'و+', 'و', 'g'), 'ي+', 'ي', 'g')), lambda w: w <> '')"


@query(f"""WITH {_P} SELECT rid, array_to_string({skeleton_words_sql(arabic_sql('text'))}, ' ') AS skeleton FROM p""")
def b6_spelling_skeleton(spark, d):
    return C.passages(spark, d).select("rid", forms.spelling_skeleton(arabic(F.col("text"))).alias("skeleton"))


_VERSES_1 = VERSES.replace("\nv AS", "\nv1 AS").replace("FROM v GROUP", "FROM v1 GROUP")


@query(f"""WITH RECURSIVE {_VERSES_1},
v AS MATERIALIZED (SELECT rid, {skeleton_words_sql('text')} AS sw FROM v1),
m AS (SELECT qid, list_transform(list_filter(ws, lambda w, i: i <> 2), lambda w, i: CASE WHEN i = 3 THEN w[1] || 'ا' || w[2:] ELSE w END) AS ws FROM lv),
qs AS MATERIALIZED (SELECT qid, ws, CAST(greatest(3, ceil(len(ws) * 70 / 100)) AS INT) AS need FROM (SELECT qid, {skeleton_words_sql("array_to_string(ws, ' ')")} AS ws FROM m) WHERE len(ws) >= 3),
vd AS (SELECT rid, unnest(list_distinct(sw)) AS w FROM v), qd AS (SELECT qid, need, unnest(list_distinct(ws)) AS w FROM qs),
cand AS MATERIALIZED (SELECT qid, rid FROM qd JOIN vd USING (w) GROUP BY qid, rid HAVING count(*) + 1 >= max(need)),
rec AS (
  SELECT qid, rid, qs.ws AS a, v.sw AS b, 0 AS i, list_transform(range(0, len(v.sw) + 1), lambda x: 0) AS r FROM cand JOIN qs USING (qid) JOIN v USING (rid)
  UNION ALL
  SELECT qid, rid, a, b, i + 1, list_transform(range(1, len(h) + 1), lambda k: list_max(h[1:k])) FROM (
    SELECT qid, rid, a, b, i, list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: greatest(r[j + 1], r[j] + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE 0 END))) AS h FROM rec WHERE i < len(a))
),
sc AS MATERIALIZED (SELECT qid, rid, need, list_max(r) AS found, len(a) AS n FROM rec JOIN qs USING (qid) WHERE i = len(a)),
best AS (SELECT *, count(*) OVER (PARTITION BY qid, found) AS same, max(found) OVER (PARTITION BY qid) AS most FROM sc)
SELECT qid, rid, CAST(found AS BIGINT) AS found, n FROM best WHERE found = most AND same = 1 AND found >= need""")
def g8_closest_verse(spark, d):
    """The longest verse of each document with a word left out and one spelt otherwise."""
    return Z.closest_verse(spoilt(spark, d, one_missing), verses(spark, d).select("rid", "text"))


_BARE = lambda x: f"list_distinct(list_transform({x}, lambda w: CASE WHEN length(w) > 3 AND w[1] IN ('و', 'ف') THEN w[2:] ELSE w END))"


@query(f"""WITH {_P},
q AS (SELECT item_id AS qid, {S.tokens(arabic_sql('text'))} AS t FROM benchmark),
w AS MATERIALIZED (SELECT qid, {_BARE('t')} AS w FROM q WHERE len(list_distinct(t)) >= 4),
h AS (SELECT rid, unnest({_BARE(S.tokens(arabic_sql('text')))}) AS word FROM p),
m AS (SELECT qid, rid, len(w.w) AS n, count(*) AS shared FROM (SELECT qid, w, unnest(w) AS word FROM w) w JOIN h USING (word) GROUP BY qid, rid, w.w)
SELECT qid, arg_min(rid, (-shared, rid)) AS rid, max(shared) AS shared, max(n) AS n FROM m WHERE shared >= 3 AND shared >= 0.4 * n GROUP BY qid""")
def g10_closest_by_words(spark, d):
    asked = C.questions(spark, d).select("qid", T.tokenize(arabic(F.col("text"))).alias("t"), F.lit(4).alias("least"))
    return Z.closest_by_words(asked, C.passages(spark, d).select("rid", arabic(F.col("text")).alias("text")))
