"""Base statistics against plain counting, and outliers that a robust fit must find."""

import random
import re
from collections import Counter

import numpy as np

from trellisway.llm.quality import VECTOR, QualityParams, chi2_cdf, chi2_quantile, consistency, op5_quality, quality

from .helpers import ODD, frame, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def check(found, texts):
    for r in found:
        if r.doc_id is not None:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got == plain(texts[r.doc_id]), r.doc_id
            assert not (r.base_failed and r.kept)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op5_quality(spark, sf_dir).collect()
    assert len(found) == len(texts)
    check(found, texts)


def test_odd_rows(spark):
    more = [(950, "a b c d e a b c d e a b c d e f g"), (951, "x\r\nx\nx\n \n\x0b"), (952, "#* $%&|<> 12 34 56 78 9 10 11 12 13")]
    found = quality(frame(spark, ODD + more)).collect()
    assert len(found) == len(ODD) + len(more)
    check(found, dict(ODD + more))


def test_outliers_go_and_clean_rows_stay(spark):
    draw = random.Random(1)
    rows = [(i, ". ".join(prose(1000 + 10 * i + j, draw.randrange(8, 20)).capitalize() for j in range(6)) + ".") for i in range(0, 800, 2)]
    bad = [(i, prose(i, 60).upper().replace(" ", " !!? ")) for i in range(1000, 1040, 2)]
    found = {r.doc_id: r.kept for r in quality(frame(spark, rows + bad)).collect()}
    assert not any(found[i] for i, _ in bad)
    assert sum(found[i] for i, _ in rows) >= 0.99 * len(rows)


def test_empty_table(spark):
    assert quality(frame(spark, [])).count() == 0


def test_chi_square():
    assert abs(chi2_cdf(5.991464547, 2) - 0.95) < 1e-9
    assert abs(chi2_quantile(0.975, 6) - 14.44937534) < 1e-6


def vector(text):
    n, chars, symbols, dup, repeats, _ = plain(text)
    lines = sum(1 for x in text.split("\n") if SPACE.sub("", x))
    upper, marks = sum(c.isupper() for c in text), sum(c in "!?" for c in text)
    return [np.log(max(chars, 1) / max(n, 1)), np.log1p(100 * symbols / max(chars, 1)), np.sqrt(dup / max(lines, 1)), np.sqrt(repeats / max(n, 1)),
            np.sqrt(upper / max(chars, 1)), np.log1p(100 * marks / max(chars, 1))]


def plain_distances(x, params):
    """Squared distances of the rows of one matrix by the same determinant steps, in numpy."""
    floors, k, low = np.array(list(VECTOR.values())), x.shape[1], lambda v, p: np.sort(v, axis=0)[int(np.ceil(p * len(v))) - 1]
    centre = low(x, 0.5)
    d2 = (((x - centre) / np.maximum(1.4826 * low(np.abs(x - centre), 0.5), floors)) ** 2).sum(axis=1)

    def fitted(inside, factor):
        own = x[inside]
        m = own.mean(axis=0)
        s = (own.T @ own / len(own) - np.outer(m, m)) * factor
        s[np.diag_indices(k)] = np.maximum(s.diagonal(), 0) + floors**2
        return ((x - m) @ np.linalg.inv(s) * (x - m)).sum(axis=1), np.linalg.slogdet(s)[1]

    before = None
    for _ in range(params.steps):
        d2, size = fitted(d2 <= low(d2, params.subset), consistency(params.subset, k))
        if before is not None and abs(size - before) < params.tolerance:
            break
        before = size
    return fitted(d2 <= chi2_quantile(0.975, k), consistency(0.975, k))[0]


def test_verdict_against_plain_steps(spark):
    draw, params, rows = random.Random(2), QualityParams(), []
    for i in range(420):
        lang, source = ("en", "web") if i < 150 else ("en", "rare") if i < 170 else ("de", "web") if i < 320 else ("de", "books") if i < 400 else ("fr", "web")
        text = ". ".join(prose(4000 + 10 * i + j, draw.randrange(8, 20)).capitalize() for j in range(6)) + "." + "!?" * draw.randrange(4)
        if i % 19 == 0:
            text = text.upper().replace(" ", " !!? ")
        rows.append((i, text, lang, source))
    x, fails = np.array([vector(t) for _, t, *_ in rows]), np.array([plain(t)[5] for _, t, *_ in rows])
    lang, source = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    groups = {("en", "web"): (lang == "en") & (source == "web"), ("en", "rare"): lang == "en", ("de", "web"): (lang == "de") & (source == "web"),
              ("de", "books"): (lang == "de") & (source == "books"), ("fr", "web"): np.ones(len(rows), bool)}
    assert not fails.any()
    found = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for (a, b), fit in groups.items():
        at = np.flatnonzero(fit)
        d2 = dict(zip(at.tolist(), plain_distances(x[at], params)))
        for i in np.flatnonzero((lang == a) & (source == b)).tolist():
            assert abs(found[i].d2 - d2[i]) <= 1e-6 * (1 + d2[i]), (a, b, i)
            assert found[i].kept == (d2[i] <= chi2_quantile(params.cutoff, len(VECTOR)))
    assert not any(found[i].kept for i in range(0, 420, 19))
