"""Which kinds of ruling a text states, plainly or negated, and where a claim turns its passages around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, normalize

# Ruling words by kind, in normalised spelling, and negators.
RULING_WORDS = {
    "obligatory": "تجب يجب واجب وجوب فرض يلزم لازم اوجب فريضه",
    "permitted": "تجوز يجوز جايز مباح يباح اباح اجاز جاز يجيز",
    "forbidden": "تحرم يحرم حرام محرم حرم ممنوع يمنع منع",
    "disliked": "يكره تكره مكروه كراهه",
    "recommended": "يستحب تستحب مستحب مسنون يسن ندب مندوب",
    "void": "يبطل تبطل باطل باطله يفسد تفسد فاسد فاسده ينقض تنقض ناقض نواقض",
}
NEGATORS = "لا ليس ليست لم لن غير ما".split()
STRICT_NEGATORS = "لا ليس ليست لم لن".split()


def _stated(text: Column) -> Column:
    """(kind, near, wide, strict) of each ruling word: whether a negator stands among the two or four words before it, and a strict one among the two.

    Words are looked up where they stand, so nothing but the few ruling words leaves a text.
    """
    kinds = F.create_map(*[F.lit(x) for k, words in RULING_WORDS.items() for w in words.split() for x in (w, k)])
    no = lambda w, words: w.isin(words) | (F.substring(w, 1, 1).isin("و", "ف") & F.substring(w, 2, 1_000).isin(words))
    before = lambda w, i, reach, words: F.exists(F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), lambda x: no(x, words))
    n = F.char_length

    def of(w: Column, x: Column, i: Column) -> Column:
        forms = F.array_distinct(F.array(
            x,
            F.when(F.substring(x, 1, 1).isin("و", "ف", "ب", "ل") & (n(x) > 3), F.substring(x, 2, 1_000)).otherwise(x),
            F.when((F.substring(x, 1, 2) == "ال") & (n(x) > 4), F.substring(x, 3, 1_000)).otherwise(x),
        ))
        found = F.filter(F.transform(forms, lambda f: F.try_element_at(kinds, f)), lambda k: k.isNotNull())
        flags = [before(w, i, 2, NEGATORS).alias("near"), before(w, i, 4, NEGATORS).alias("wide"), before(w, i, 2, STRICT_NEGATORS).alias("strict")]
        return F.transform(found, lambda k: F.struct(k.alias("kind"), *flags))

    any_ = normalize(text).rlike("|".join(w for words in RULING_WORDS.values() for w in words.split()))
    every = let(F.split(normalize(text), " "), lambda w: F.array_distinct(F.flatten(F.transform(w, lambda x, i: of(w, x, i)))))
    return F.when(any_, every).otherwise(F.array().cast("array<struct<kind:string,near:boolean,wide:boolean,strict:boolean>>"))


def stated(texts: DataFrame, key: str) -> DataFrame:
    """(key, kind, near, wide, strict): ruling words of a text and the negators before them."""
    return texts.select(key, F.explode(_stated(F.col("text"))).alias("x")).select(key, "x.*").distinct()


def polarity(texts: DataFrame, key: str) -> DataFrame:
    """(key, kind, negated): ruling words, negated where a negator stands among the two words before."""
    return stated(texts, key).select(key, "kind", F.col("near").alias("negated")).distinct()


def against_passages(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim, mismatch, flipped): kinds that a claim states plainly and its passages do not, where they state any; and kinds that it negates or affirms against its passages, none of which says the same.

    claims: (claim, text). cited: (claim, text), negators not reaching from one passage into the next; these are read
    with a reach of two and of four words. A plain statement counts only if no negator at all stands before it.
    Each text is looked at once, and claims meet their passages once.
    """
    signed = lambda kind, no: F.concat(F.when(no, "-").otherwise("+"), kind)
    own = stated(claims, "claim").groupBy("claim").agg(
        F.collect_set(F.when(~F.col("near"), F.col("kind"))).alias("plain"),
        F.collect_set(signed(F.col("kind"), F.col("strict"))).alias("said"),
    )
    theirs = stated(cited, "claim").groupBy("claim").agg(
        F.collect_set("kind").alias("kinds"), F.array_union(F.collect_set(signed(F.col("kind"), F.col("near"))), F.collect_set(signed(F.col("kind"), F.col("wide")))).alias("there")
    )
    said = F.filter("said", lambda x: F.startswith(x, F.lit("-")) | F.array_contains(F.col("plain"), F.substring(x, 2, 1_000)))
    other = lambda x: F.concat(F.translate(F.substring(x, 1, 1), "+-", "-+"), F.substring(x, 2, 1_000))
    flipped = F.filter(said, lambda x: F.array_contains(F.col("there"), other(x)) & ~F.array_contains(F.col("there"), x))
    joined = own.join(theirs, "claim")
    return joined.select("claim", F.array_except("plain", "kinds").alias("mismatch"), F.array_distinct(F.transform(flipped, lambda x: F.substring(x, 2, 1_000))).alias("flipped"))


def mismatched(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim, kind) of against_passages()."""
    return against_passages(claims, cited).select("claim", F.explode("mismatch").alias("kind"))


def flipped(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim, kind) of against_passages()."""
    return against_passages(claims, cited).select("claim", F.explode("flipped").alias("kind"))
