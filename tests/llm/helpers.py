"""Small documents with the odd cases that every operator must take, and plain reference functions."""

from __future__ import annotations

import random

WORDS = (
    "river stone window garden summer letter paper bridge market winter silver morning evening doctor teacher village "
    "mountain forest island harbour kitchen station picture number colour basket button candle carpet castle corner"
).split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing", "ly"]) + str(draw.randrange(40)) * draw.randrange(2) for _ in range(n))


#: Null and empty texts, white space, short and very long texts, repeated rows, ties, odd characters, a null doc_id.
ODD = [
    (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "one"), (905, "é ß Σ   　 漢字 \U0001f600"),
    (906, "word " * 30_000), (907, prose(77, 12)), (907, prose(77, 12)), (None, "a row without an id"), (908, "x" * 50_000), (909, "\n\n\n"),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, kept boolean, keys array<long>, rep long, hub string"


def frame(spark, rows):
    """A documents table with columns whose names clash with those that operators use inside."""
    full = [(i, t, "en" if (i or 0) % 2 else None, "web", len(t or ""), 0.25, True, [1], 5, "h") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def components(ids, linked):
    """Least reachable id of each, by plain union-find over a list of links."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
