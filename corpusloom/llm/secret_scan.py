"""Secret scans: base patterns, and random-looking strings found by two character Markov models.

Base spans are the leftmost non-overlapping matches of three patterns. The method adds spans of kind
`markov`: a token of LEAST_TOKEN or more key characters with a digit and a letter in it, outside all base spans,
whose first-order character model of random strings beats the model of ordinary identifiers by at
least `llr` nats a character. A token's verdict depends on the token and the models alone.

Both models are counted over all documents, from samples that the documents label: the random model
from the values that the base patterns name, the ordinary one from words outside base spans found in
LEAST_TEXTS texts or more that differ. Each distinct value and word counts once, so that copies weigh
nothing, and what the rule would score itself (LEAST_TOKEN characters with a digit and a letter) is
never an ordinary word, however many texts repeat it. Counts are summed in each task first. Where no
document holds a named secret, the random model is uniform.

DataFrame functions only. Offsets are code points, ends exclusive. Null and empty texts have no
spans. Repeated rows and ids get one result each, null ids too; only the id and the text are read, so
extra columns of any name play no part. Overlapping kinds all stay in base; equal starts are ordered by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let, stored

#: The base patterns, kinds in order.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

TOKEN = "[A-Za-z0-9+/_=-]{16,}"
LEAST_TOKEN = 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LLR = 0.75
SMOOTHING = 0.5
BACKOFF = 20.0
#: A word is ordinary if so many texts that differ hold it (at least: texts are told apart by 64 residues of a hash).
LEAST_TEXTS = 8
BLOCK = 256
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def spans(text: Column, pattern: str, rank: int, value_group: int = 0, least: int = 0) -> Column:
    """All matches as (start, rank, end, value): the pieces between matches give the offsets.

    Matches are folded in blocks of BLOCK, so that no long array grows by one at a time.
    """

    def place(found: Column) -> Column:
        n = F.size(found["whole"])

        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(found["pieces"], k))
            end = start + F.char_length(F.get(found["whole"], k))
            value = F.get(found["value"], k)
            row = F.array(F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), value.alias("value")))
            return F.struct(end.cast("int").alias("at"), F.when(F.char_length(value) >= least, F.concat(acc["out"], row)).otherwise(acc["out"]).alias("out"))

        def block(acc: Column, b: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out"))
            done = F.aggregate(F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1), start, step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block)["out"])

    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = F.struct(all_of(0).alias("whole"), all_of(value_group).alias("value"), F.split(text, pattern, -1).alias("pieces"))
    return let(found, lambda f: F.when(F.size(f["whole"]) > 0, place(f)).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, in order of start and kind."""
    none = F.array().cast(SPAN)
    # what a match must hold is looked for first, so that most texts never meet the pattern
    assign = F.when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), spans(text, ASSIGN, 0, 2, LEAST["assign"])).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), F.when(text.rlike(ACCESS), spans(text, ACCESS, 1, 0, LEAST["access"])).otherwise(none)).otherwise(none)
    hexes = F.when(text.rlike(HEX), spans(text, HEX, 2, 0, LEAST["hex"])).otherwise(none)
    return F.sort_array(F.concat(assign, access, hexes))


def scored_by_rule(token: Column) -> Column:
    """Whether the models are asked about a token."""
    return (F.char_length(token) >= LEAST_TOKEN) & token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def training_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(secret, token): the distinct values that base spans hold, and the distinct ordinary words."""
    text = F.col("text")
    rows = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0)
    secrets = rows.select(F.explode(F.transform(base_spans(text), lambda x: x["value"])).alias("token")).distinct()
    bare = text
    for pattern in (ASSIGN, ACCESS, HEX):
        bare = F.when(bare.rlike(pattern), F.regexp_replace(bare, pattern, " ")).otherwise(bare)
    words = rows.select(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("text"), F.lit(64)).cast("int")).alias("mark"), F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9+/_=-]{6,}"), F.lit(0)))).alias("token"))
    held = words.groupBy("token").agg(F.bit_or("mark").alias("marks"))
    ordinary = held.filter((F.bit_count("marks") >= LEAST_TEXTS) & ~scored_by_rule(F.col("token"))).select("token")
    return secrets.select(F.lit(True).alias("secret"), "token").unionByName(ordinary.select(F.lit(False).alias("secret"), "token"))


def train(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: llr, an array of len(ALPHABET) ** 2 log-likelihood ratios, previous character first."""
    size = len(ALPHABET)
    pairs = (
        training_tokens(docs, text_col)
        .filter(F.char_length("token") > 1)
        .select("secret", F.explode(let(places(F.col("token")), lambda i: F.transform(F.sequence(F.lit(1), F.size(i) - 1), lambda k: F.struct(F.get(i, k - 1).alias("a"), F.get(i, k).alias("b"))))).alias("p"))
        .select("secret", "p.a", "p.b")
        .filter("a > 0 and b > 0")
        .groupBy("a", "b")
        .agg(F.count_if("secret").alias("s"), F.count_if(~F.col("secret")).alias("o"))
    )
    grid = docs.sparkSession.range(1, size * size + 1).select((F.expr(f"(id - 1) div {size}") + 1).cast("int").alias("a"), (F.expr(f"(id - 1) % {size}") + 1).cast("int").alias("b"))
    full = grid.join(pairs, ["a", "b"], "left").fillna(0, ["s", "o"])
    before = full.groupBy("a").agg(F.sum("s").alias("sa"), F.sum("o").alias("oa"))
    alone = full.groupBy("b").agg(F.sum("s").alias("sb"), F.sum("o").alias("ob"))
    total = full.agg(F.sum("s").alias("sn"), F.sum("o").alias("on"))
    # a pair's probability leans on that of its second character, the less the more its first was seen
    lone = lambda k: (F.col(f"{k}b") + SMOOTHING) / (F.col(f"{k}n") + SMOOTHING * size)
    log_p = lambda k: F.log((F.col(k) + BACKOFF * lone(k)) / (F.col(f"{k}a") + BACKOFF))
    joined = full.join(before, "a").join(alone, "b").withColumn("_one", F.lit(0)).join(F.broadcast(total.withColumn("_one", F.lit(0))), "_one")
    scored = joined.select(((F.col("a") - 1) * size + F.col("b")).alias("at"), (log_p("s") - log_p("o")).alias("r"))
    return scored.groupBy(F.lit(0).alias("_one")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("llr"))


def places(token: Column) -> Column:
    """Where in ALPHABET each character of a token is, from 1 on; 0 for others."""
    return F.transform(F.slice(F.split(token, ""), F.lit(1), F.char_length(token)), lambda c: F.instr(F.lit(ALPHABET), c))


def mean_llr(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of the token's character pairs, per pair."""
    size = len(ALPHABET)
    total = let(places(token), lambda i: F.aggregate(F.sequence(F.lit(1), F.size(i) - 1), F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(model, (F.get(i, k - 1) - 1) * size + F.get(i, k) - 1), F.lit(0.0))))
    return total / (F.char_length(token) - 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", llr: float = LLR) -> DataFrame:
    """One row per row of docs: id, base (spans of the patterns), added (spans of the models)."""
    model = stored(train(docs, text_col), "secret-model")  # one row
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    tokens = F.filter(spans(F.col("_text"), TOKEN, 3, 0, LEAST_TOKEN), lambda s: scored_by_rule(s["value"]))
    # a text without a digit has no token to score
    rows = rows.select("_id", base_spans(F.col("_text")).alias("base"), F.when(F.col("_text").rlike("[0-9]"), tokens).otherwise(F.array().cast(SPAN)).alias("tokens"))
    meets = lambda t, found: F.exists(found, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    free = let(F.col("base"), lambda found: F.filter("tokens", lambda t: ~meets(t, found)))  # else the optimiser may move the patterns into the filter
    rows = rows.select("_id", "base", free.alias("tokens"), F.lit(0).alias("_one")).join(F.broadcast(model), "_one")
    return rows.select(F.col("_id").alias(id_col), "base", F.filter("tokens", lambda t: mean_llr(t["value"], F.col("llr")) >= llr).alias("added"))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
