"""Fuzzy line dedup against all pairs of lines."""

import random
from itertools import combinations
from string import ascii_lowercase

import numpy as np
import pytest

from trellisway.llm.lines import LineParams, _grouped, dedup_lines, duplicate_lines, normalise, op6_line_dedup
from trellisway.llm.lsh import Bound, _link_few, _link_many

from .helpers import ODD, components, frame, prose

P = LineParams()


def shingles(line):
    return frozenset(line[i : i + P.size] for i in range(max(1, len(line) - P.size + 1)))


def expected(rows):
    """Texts by place of first line of each component, and whether a text lost its last line with a word."""
    first = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            form = normalise(line)
            if form and doc_id is not None:
                first[form] = min(first.get(form, (doc_id, i)), (doc_id, i))
    forms = sorted(first)
    sets = [shingles(f) for f in forms]
    linked = [
        (a, b) for a, b in combinations(range(len(forms)), 2)
        if P.den * len(sets[a] & sets[b]) >= P.num * len(sets[a] | sets[b])
    ]
    own = components(range(len(forms)), linked)
    best = {}
    for i, form in enumerate(forms):
        best[own[i]] = min(best.get(own[i], first[form]), first[form])
    keeper = {form: best[own[i]] for i, form in enumerate(forms)}
    out = {}
    for doc_id, text in rows:
        if text is None or doc_id is None:
            out[doc_id] = (text, False)
            continue
        parts = text.split("\n")
        kept = [x for i, x in enumerate(parts) if not normalise(x) or keeper[normalise(x)] == (doc_id, i)]
        out[doc_id] = ("\n".join(kept), len(kept) < len(parts) and not "".join(kept).strip())
    return out


def corpus():
    rows = []
    for i in range(50):
        lines = [prose(1000 * i + j, 12) for j in range(4)]
        lines.insert(i % 3, "Please accept all cookies to read on in this very long notice of the site")
        near = prose(5, 14).split()
        near[i % 14] = f"variant{i}"
        lines.append(" ".join(near))
        lines.append(f"Page {i} of {i + 7} in the printed edition of the yearly report")
        rows.append((i, "\n".join(lines)))
    rows.append((60, rows[3][1]))
    rows.append((61, "  PLEASE accept all   cookies to read on in this very long notice of the site"))
    return rows


def test_against_all_pairs(spark):
    rows = corpus() + ODD
    want = expected(rows)
    found = dedup_lines(frame(spark, rows))
    assert found.columns == [*frame(spark, []).columns, "_emptied"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r._emptied) == want[r.doc_id], r.doc_id


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


def test_query_keeps_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = op6_line_dedup(spark, sf_dir)
    assert found.count() == docs.count()
    lost = found.filter("not emptied").select("doc_id", "text").subtract(docs.select("doc_id", "text"))
    assert 0 < lost.count() < docs.count()


def template_lines():
    template = prose(7000, 40)[:130]
    tail = lambda seed, n: "".join(random.Random(seed).choices(ascii_lowercase, k=n))
    rows = [(i, template + tail(i, 20)) for i in range(160)]
    return rows + [(200 + i, rows[1 + 4 * i][1][:-13] + tail(5000 + i, 13)) for i in range(40)]


def test_pairs_among_lines_of_one_template(spark):
    rows = template_lines()
    want = expected(rows)
    assert sum(gone for _, gone in want.values()) == 40
    for r in dedup_lines(frame(spark, rows).coalesce(2)).collect():
        assert (r.text, r._emptied) == want[r.doc_id], r.doc_id


def test_lines_that_differ_in_digits_only(spark):
    text = "1999\n2024\nChapter 12\nChapter 13\n555 120 77 | 12.50\n684 931 25 | 99.75"
    rows = [(1, text), (2, "Chapter 14\nchapter  12")]
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()} == {1: text, 2: "Chapter 14"}


@pytest.mark.parametrize("bound", [Bound(), Bound(rows=20), Bound(chars=2000)])
def test_large_clusters_give_the_same(spark, bound):
    rows = [(1000 + i, text) for i, text in template_lines()] + corpus()
    want = expected(rows)
    dropped = {r.doc_id: set(r.dropped) for r in duplicate_lines(frame(spark, rows).repartition(3), bound=bound).collect()}
    for doc_id, text in rows:
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in dropped.get(doc_id, ()))
        assert kept == want[doc_id][0], doc_id


def test_many_rows_are_linked_as_few(spark):
    draw = np.random.default_rng(5)
    for n, base, extra in ((60, 40, 12), (60, 40, 8), (80, 5, 30), (70, 40, 0)):
        common = draw.integers(1, 1 << 60, base)
        own = [np.concatenate([common[draw.random(base) < 0.95], draw.integers(1, 1 << 60, extra)[: draw.integers(0, extra + 1)]]) for _ in range(n)]
        own[3], ids = own[3][:0], draw.permutation(n).tolist()
        ids[7] = ids[11]
        few = _link_few(ids, [set(x.tolist()) for x in own], 80, 100)
        many = _link_many(np.array(ids), np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own).astype(np.uint64), 80, 100)
        assert [[a == b for b in few] for a in few] == (many[:, None] == many[None, :]).tolist()


def test_names_that_two_lines_share_are_found(spark):
    lines = spark.createDataFrame([(1, 0, 5, 7), (1, 1, 5, 8), (2, 0, 5, 7), (3, 0, 6, 9)], "doc_id long, line int, h1 long, h2 long").selectExpr("*", "h1 as id")
    assert {r.id: (r.n, r.low < r.high) for r in _grouped(lines).collect()} == {5: (3, True), 6: (1, False)}
