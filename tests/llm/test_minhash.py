"""Near duplicates against all pairs of plain sets."""

from itertools import combinations

import duckdb
import pytest

from trellisway.llm.lsh import Bound
from trellisway.llm.minhash import OP1_SQL, near_dedup, near_duplicates, op1_minhash_dedup

from .helpers import ODD, components, frame, prose


def shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(table)).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def corpus():
    rows = [(i, prose(i, 30 + i)) for i in range(40)]
    for i in range(40, 60):  # near copies with a few words changed
        words = prose(i - 40, 30 + i - 40).split()
        for at in range(i % 3):
            words[7 + 11 * at] = "changed"
        rows.append((i, " ".join(words).upper() if i % 2 else "\n".join(words)))
    rows += [(100 + i, "the same text of a copied page in many places") for i in range(60)]
    words = prose(500, 200).split()
    for i in range(30):  # a chain: each is near its neighbour, the ends are far apart
        rows.append((200 + i, " ".join(words[3 * i : 3 * i + 100])))
    return rows


def expected(rows):
    """Component of each doc_id, whose rows are one vertex, and the set sizes of each."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    linked = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if a != b and s and t and 100 * len(s & t) >= 85 * len(s | t)]
    sizes = {}
    for i, s in sets:
        sizes.setdefault(i, []).append(len(s))
    return components(sizes, linked), sizes


def test_against_all_pairs(spark):
    rows = corpus() + ODD
    own, sizes = expected(rows)
    found = near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.component_id, r.kept) == (own[r.doc_id], own[r.doc_id] == r.doc_id), r
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.n_shingles)
    assert {i: sorted(n) for i, n in got.items() if i is not None} == {i: sorted(n) for i, n in sizes.items()}


def test_doc_ids_of_several_texts(spark):
    texts = [prose(600 + i, 50) for i in range(4)]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (7, ""), (8, texts[2]), (9, texts[3]), (9, texts[2] + " end"), (10, texts[3])]
    own, _ = expected(rows)
    assert own == {3: 3, 5: 3, 7: 3, 8: 8, 9: 8, 10: 8}
    assert {(r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == set(own.items())
    assert {r.doc_id for r in near_dedup(frame(spark, rows)).collect()} == {3, 8}


def test_one_of_each_group_stays(spark):
    rows = corpus()
    own, _ = expected(rows)
    kept = near_dedup(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, c in own.items() if i == c}
    assert kept.columns == frame(spark, rows).columns


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    cur = con.execute(OP1_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in op1_minhash_dedup(spark, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize("bound", [Bound(), Bound(rows=30)])
def test_pairs_among_documents_of_one_template(spark, bound):
    template = prose(7000, 300)
    rows = [(i, f"{template} {prose(8000 + i, 30)}") for i in range(160)]
    rows += [(200 + i, " ".join([*rows[1 + 4 * i][1].split()[:-24], prose(9000 + i, 24)])) for i in range(40)]
    own, _ = expected(rows)
    assert sum(i != c for i, c in own.items()) == 40
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        found = near_duplicates(frame(spark, rows).coalesce(1), bound=bound).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.doc_id: r.component_id for r in found} == own
