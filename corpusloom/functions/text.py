"""Normalisation, tokenisation and language tests as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks, letter variants, stopwords and joined prefixes that matching sets aside.
MARKS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED]"
TATWEEL = "ـ"
VARIANTS = ("أإآٱىئؤة", "ااااييوه")
STOPWORDS = """
في من على عن الى الي ما ماذا هل هو هي هم انا انت نحن هذا هذه ذلك تلك التي الذي الذين
او ام ثم لا لم لن قد كل بعض مع عند بين كيف لماذا متى اين كم اي ان كان يكون
the a an of to in on is are was were what why how who which do does did i you it and or
""".split()
PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")
URDU = "[\\u0679\\u0688\\u0691\\u06BA\\u06BE\\u06C1\\u06D2\\u06D3]"
ARABIC = "[\\u0600-\\u06FF]"
LATIN = "[A-Za-z]"
IDENTITY_EDGES = " \t\n.,!?؟،؛:«»\"'()"


def unified(col: Column) -> Column:
    """Marks and tatweel out, letter variants unified, in one go. Texts that hold none of them are left as they are."""
    text = F.coalesce(col, F.lit(""))
    marks = "".join(chr(c) for lo, hi in re.findall(r"u(\w{4})(?:-.u(\w{4}))?", MARKS) for c in range(int(lo, 16), int(hi or lo, 16) + 1))
    changed = f"[{VARIANTS[0]}{TATWEEL}{MARKS[1:-1]}]"
    return F.when(text.rlike(changed), F.translate(text, VARIANTS[0] + TATWEEL + marks, VARIANTS[1])).otherwise(text)


def normalize(col: Column) -> Column:
    """Marks and tatweel out, letter variants unified, lower case, everything but letters, digits and _ one space."""
    return F.trim(F.regexp_replace(F.lower(unified(col)), "[^\\p{L}\\p{N}_]+", " "))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def tokenize(col: Column) -> Column:
    """Content tokens: no stopword, one prefix off where two letters remain, two letters or more.

    Prefixes are cut in the whole text at once, and only where it holds the letter that each of them has.
    """
    bare = lambda text: F.regexp_replace(text, f"(?<![^ ])(?:{'|'.join(PREFIXES)})(?=[^ ]{{2}})", "")
    both = lambda text: F.struct(F.split(text, " ").alias("raw"), F.split(bare(text), " ").alias("bare"))
    content = lambda t: (F.char_length(t) >= 2) & ~t.isin(STOPWORDS)
    kept = lambda x: F.filter(x["bare"], lambda t, i: content(t) & ~F.get(x["raw"], i).isin(STOPWORDS))
    plain = lambda text: F.filter(F.split(text, " "), content)
    return let(normalize(col), lambda text: F.when(F.contains(text, F.lit("ل")), let(let(text, both), kept)).otherwise(plain(text)))


def normalized_words(col: Column) -> Column:
    """The words of words_with_offsets() without their places, normalised in the text as a whole: what stands between blanks is one word."""
    parted = F.regexp_replace(F.lower(unified(col)), "\\s+", "\x01")
    clean = F.regexp_replace(F.regexp_replace(parted, "[^\\p{L}\\p{N}_\x01]+", " "), " ?\x01[ \x01]*", "\x01")
    return F.filter(F.split(F.trim(clean), "\x01"), lambda w: w != "")


def words_with_offsets(col: Column) -> Column:
    """(w, s, e): words as normalised, with code-point offsets; words that normalise to nothing are left out."""
    placed = matches_with_offsets(F.coalesce(col, F.lit("")), "\\S+")
    return F.filter(F.transform(placed, lambda t: F.struct(normalize(t["w"]).alias("w"), t["s"].alias("s"), t["e"].alias("e"))), lambda t: t["w"] != "")


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """(w, s, e): the matches of a pattern in a text, with code-point offsets.

    Places are summed up in blocks of 256 matches, so that no long array grows by one at a time.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("gap"))
    block, kind = 256, "array<struct<w:string,s:int,e:int>>"

    def place(x: Column) -> Column:
        n = F.size(x["w"])

        def step(acc: Column, k: Column) -> Column:
            s = (acc["at"] + F.char_length(F.get(x["gap"], k))).cast("int")
            e = (s + F.char_length(F.get(x["w"], k))).cast("int")
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(F.get(x["w"], k).alias("w"), s.alias("s"), e.alias("e")))).alias("out"))

        def blocks(acc: Column, b: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out"))
            folded = F.aggregate(F.sequence(b * block, F.least(n, (b + 1) * block) - 1), start, step)
            return let(folded, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        folded = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), start, blocks)["out"])
        return F.when(n == 0, F.array().cast(kind)).otherwise(folded)

    return let(found, place)


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), "\\s+", " "))


def answer_identity(col: Column) -> Column:
    """What a kept answer is found by: tatweel out, blanks squeezed, edge punctuation off. Arabic madda and hamza pairs are composed, other scripts are left as written."""
    text = F.translate(F.coalesce(col, F.lit("")), TATWEEL, "")
    for pair, whole in (("\u0627\u0653", "\u0622"), ("\u0627\u0654", "\u0623"), ("\u0648\u0654", "\u0624"), ("\u0627\u0655", "\u0625"), ("\u064a\u0654", "\u0626")):
        text = F.replace(text, F.lit(pair), F.lit(whole))
    return F.trim(collapse_spaces(text), F.lit(IDENTITY_EDGES))


def script_language(col: Column, fallback: Column) -> Column:
    return F.when(col.rlike(URDU), "ur").when(col.rlike(ARABIC), "ar").when(col.rlike("[A-Za-z]{2,}"), "en").otherwise(fallback)


def count_of(col: Column, chars: str) -> Column:
    return F.char_length(col) - F.char_length(F.regexp_replace(col, chars, ""))


def language_share_ok(col: Column, lang: Column) -> Column:
    """Whether the letters of a text fit a language; false without letters."""
    arabic, latin = count_of(col, ARABIC), count_of(col, LATIN)
    letters = arabic + latin
    ok = F.when(lang == "en", latin / letters >= 0.5).when(lang == "ur", col.rlike(URDU) & (arabic / letters >= 0.6)).otherwise((arabic / letters >= 0.6) & ~col.rlike(URDU))
    return F.when(letters == 0, False).otherwise(ok)


def mostly_marked(col: Column, share: float = 0.8) -> Column:
    """Whether that share of the words carries a vowel mark."""
    words = F.filter(F.split(F.coalesce(col, F.lit("")), "\\s+"), lambda w: w != "")
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: w.rlike("[\\u064B-\\u0652]"))) >= share * F.size(words))


def clean_print(col: Column) -> Column:
    """Control and direction characters out, line ends unified, blanks squeezed, one empty line at most."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), "\\r\\n?", "\n")
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\u00A0]+", " "), " ?\\n ?", "\n")
    return F.trim(F.regexp_replace(text, "\\n{3,}", "\n\n"), F.lit(" \n"))
