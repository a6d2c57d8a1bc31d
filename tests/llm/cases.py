"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

LONG = "the quick brown fox jumps over a lazy dog and runs far away " * 700

#: Extra columns by names that operators use or have used for their own.
CLASHES = "k1 _k1 K2 words found lines drop c0 C1 node first_id id label h1 shard base tokens _words _lines _node".split()


def documents(spark, extra=()):
    rows = [
        (1, "One two three four five six seven eight nine ten eleven.\nSame line here", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, LONG, "en", "b"),
        (4, LONG, "en", "b"),
        (5, "  spaced   out\t\ttabs \n\n\nand lines \n", "de", "a"),
        (None, "no id at all, but some words in here to count", "en", None),
        (6, "naïve café — déjà vu 😀 ß Straße next x", "fr", "a"),
        (7, " ", "fr", "a"),
        *extra,
    ]
    rows = [(*r, "clash", -1, "x", *CLASHES) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n long, _text string, " + ", ".join(f"{c} string" for c in CLASHES))


def empty(spark):
    return documents(spark).limit(0)
