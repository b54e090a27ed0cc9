"""Tables with what every operator has to bear: nulls, blanks, long texts, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, kept boolean, host string, tokens long"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, "clash", 7, None, "clash", 3)


def documents(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "été", "über", "x"]
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(n)) for n in (3, 60, 200, 400)]
    rows = [row(i, t) for i, t in enumerate(base)]
    rows += [row(10, None), row(11, ""), row(12, " \t\n"), row(13, "one"), row(14, "one two"), row(None, "no id"), row(16, base[1]), row(17, base[1])]
    rows += [row(18, base[2] + " changed", None, None), row(18, base[2] + " changed", None, None)]
    rows += [row(20, "word " * 30_000), row(21, "\n".join(["same line"] * 40)), row(22, "🙂 astral 𝒳 text 漢字")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
