"""Ordered folds over paragraphs and sentences, and windows cut at word edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let


def packed(parts: Column, limit: int, glue: str) -> Column:
    """Whole parts joined up to about `limit` characters, in order; a part is never cut."""

    def step(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        full = (F.size(acc) == 0) | (F.char_length(last) + 1 + F.char_length(part) > limit)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(glue), part)))
        return F.when(full, F.concat(acc, F.array(part))).otherwise(grown)

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def pack_numbers(sizes: Column, forced: Column, limit: int, extra: int = 0) -> Column:
    """The number of the pack that each part falls into, from the parts' lengths: a pack ends where the next part and what joins it would exceed `limit`, or where a part must begin one.

    `extra` counts towards the length as well: 1 where a pack ends with what joins parts. Numbers are made in blocks, so
    that no long array grows by one at a time.
    """
    block, n = 256, F.size(sizes)

    def step(acc: Column, k: Column) -> Column:
        size = F.get(sizes, k)
        new = (acc["pack"] < 0) | F.get(forced, k) | (acc["used"] + size + extra > limit)
        pack = F.when(new, acc["pack"] + 1).otherwise(acc["pack"])
        used = F.when(new, size + 1).otherwise(acc["used"] + size + 1)
        return F.struct(pack.alias("pack"), used.cast("long").alias("used"), F.concat(acc["out"], F.array(pack)).alias("out"))

    def blocks(acc: Column, b: Column) -> Column:
        start = F.struct(acc["pack"].alias("pack"), acc["used"].alias("used"), F.array().cast("array<int>").alias("out"))
        folded = F.aggregate(F.sequence(b * block, F.least(n, (b + 1) * block) - 1), start, step)
        return let(folded, lambda d: F.struct(d["pack"].alias("pack"), d["used"].alias("used"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<array<int>>").alias("out"))
    return F.when(n > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), start, blocks)["out"])).otherwise(F.array().cast("array<int>"))


def pack_paragraphs(items: DataFrame, limit: int = 1_200, key: str = "location", begins: Column | None = None, extra: int = 0) -> DataFrame:
    """(key, chunk, text): the passages of each key, in order of rid, packed up to about `limit` characters; a passage is never cut. Where `begins` holds a passage starts a pack.

    Only numbers of a key's passages come together, never its texts.
    """
    forced = F.coalesce(begins, F.lit(False)) if begins is not None else F.lit(False)
    sized = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rid", F.char_length("text").alias("n"), forced.alias("forced")))).alias("x"))
    numbers = sized.select(key, "x", pack_numbers(F.transform("x", lambda r: r["n"]), F.transform("x", lambda r: r["forced"]), limit, extra).alias("packs"))
    placed = numbers.select(key, F.explode(F.arrays_zip(F.transform("x", lambda r: r["rid"]).alias("rid"), F.col("packs").alias("chunk"))).alias("p")).select(key, "p.rid", "p.chunk")
    texts = items.select(key, "rid", "text").join(placed, [key, "rid"]).groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("rid", "text"))).alias("x"))
    return texts.select(key, "chunk", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))


def split_hard(col: Column, limit: int) -> Column:
    """A text in whole sentences packed up to `limit`; a sentence that is longer is cut at its last blank past half of it, else at `limit`."""
    text = F.trim(F.coalesce(col, F.lit("")))

    def cut(sentence: Column) -> Column:
        """A long sentence's pieces: each step takes one off."""
        many = F.ceil(F.char_length(sentence) / F.lit(limit // 2)).cast("int")

        def step(acc: Column, _: Column) -> Column:
            rest = acc["rest"]
            head = F.substring(rest, 1, limit)
            # the last blank of the first `limit` characters, counted from 0
            blank = F.char_length(head) - F.instr(F.reverse(head), " ")
            at = F.when((F.instr(head, " ") > 0) & (blank > limit // 2), blank).otherwise(F.lit(limit)).cast("int")
            over = F.char_length(rest) > limit
            piece = F.when(over, F.array(F.trim(F.substr(rest, F.lit(1), at)))).otherwise(F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>")))
            left = F.when(over, F.trim(F.substr(rest, at + 1, F.char_length(rest)))).otherwise("")
            return F.struct(left.alias("rest"), F.concat(acc["out"], piece).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), many), F.struct(sentence.alias("rest"), F.array().cast("array<string>").alias("out")), step)["out"]

    pieces = F.flatten(F.transform(F.split(text, "(?<=[.!?؟])\\s+"), lambda s: F.when(F.char_length(s) > limit, cut(s)).otherwise(F.array(s))))
    # pieces of a cut sentence stay apart: only what is shorter than they are joins what is before it
    return F.filter(F.when(F.char_length(text) <= limit, F.array(text)).otherwise(packed(pieces, limit, " ")), lambda x: x != "")


def split_sentences(col: Column, limit: int) -> Column:
    """A text longer than `limit` as whole sentences packed up to it; a shorter one stays whole."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(packed(F.split(text, "(?<=[.!?؟])\\s+"), limit, " "))


def window(text: Column, start: Column, end: Column, reach: int = 260) -> Column:
    """(lead, match, trail, cut_lead, cut_trail) around code points start to end, cut at word edges."""
    n = F.char_length(text)
    a, b = F.greatest(start - reach, F.lit(0)), F.least(end + reach, n)
    before, after = F.substring(text, a + 1, start - a), F.substring(text, end + 1, b - end)
    blank = F.instr(before, " ")
    lead = F.when((a > 0) & (blank > 0), F.substring(before, blank + 1, n)).otherwise(before)
    last = F.char_length(after) - F.instr(F.reverse(after), " ")
    trail = F.when((b < n) & (F.instr(after, " ") > 0) & (last > 0), F.substring(after, F.lit(1), last)).otherwise(after)
    return F.struct(lead.alias("lead"), F.substring(text, start + 1, end - start).alias("match"), trail.alias("trail"), (a > 0).alias("cut_lead"), (b < n).alias("cut_trail"))
