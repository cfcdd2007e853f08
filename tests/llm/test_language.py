"""Held-out accuracy, spans of mixed texts, and the defined results of odd rows."""

import zlib

import numpy as np

from trellisway.llm.language import SCRIPT_NAMES, SCRIPTS, LanguageModel, LanguageParams, Labeller, Units, fit, op3_language_id, predict, viterbi

from .helpers import ODD, frame


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op3_language_id(spark, sf_dir).collect()
    assert len(found) == len(langs)
    names = {x for x in langs.values() if x}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in names | {"und"} and 0 <= r.score <= 1
    held = [r for r in found if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert len(held) >= 100
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def small(spark):
    rows = [(2 * i, "der Hund und die Katze schlafen auf dem Boden bei der Mauer", "de") for i in range(20)]
    rows += [(2 * i + 1, "the dog and the cat are sleeping there on the floor by the wall", "en") for i in range(20)]
    rows += [(100 + i, "собака и кошка спят на полу у стены", "ru") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_spans_and_scripts(spark):
    model = fit(small(spark))
    assert model.languages == ["de", "en", "ru"]
    seen = {name: model.scripts[i].tolist() for i, name in enumerate(SCRIPT_NAMES) if model.scripts[i].any()}
    assert seen == {"latin": [True, True, False], "cyrillic": [False, False, True]}
    text = "the dog and the cat are sleeping there on the floor der Hund und die Katze schlafen auf dem Boden собака и кошка спят"
    docs = spark.createDataFrame([(1, text), (2, "12 34 !?"), (3, None), (4, "")], "doc_id long, text string")
    by = {r.doc_id: r for r in predict(docs, model).collect()}
    assert [(s.first, s.end, s.lang) for s in by[1].spans] == [(0, 11, "en"), (11, 20, "de"), (20, 24, "ru")]
    for i in (2, 3, 4):
        assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])


def test_odd_rows(spark):
    model = fit(small(spark))
    rows = predict(frame(spark, ODD), model).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (900, 901, 902, 909)} == {"und"}
    assert predict(frame(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = fit(frame(spark, []))
    assert model.languages == []
    assert {r.lang_pred for r in predict(frame(spark, ODD), model).collect()} == {"und"}


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(3)
    for _ in range(100):
        scores = -draw.random((6, 3)) * 6
        best = max(
            (sum(scores[t, p[t]] for t in range(6)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
             for p in np.ndindex(*[3] * 6)))
        path = viterbi(scores, 2.5)
        got = scores[np.arange(6), path].sum() - 2.5 * (path[1:] != path[:-1]).sum()
        assert abs(got - best) < 1e-9


def test_cache_is_bounded():
    scripts = np.ones((len(SCRIPT_NAMES), 1), bool)
    own = Labeller(LanguageModel(["en"], np.zeros((1 << 4, 1), np.float32), scripts, LanguageParams(bits=4)), limit=10)
    for i in range(50):
        own.label(" ".join(f"word{i}{c}" for c in "abcdef"))
        assert len(own.rows) <= 16


def test_runs_without_spaces(spark):
    rows = [(i, "the dog and the cat are sleeping there on the floor by the wall", "en") for i in range(20)]
    rows += [(100 + i, "我们在这里学习语言和文字的历史以及它们的变化", "zh") for i in range(20)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = Labeller(model)
    assert own.label("the dog " + "语言和文字的历史" * 20)[0] == "zh"
    assert own.label("dog语言和文字的历史以及它们的变化" * 3)[0] == "zh"
    assert own.label("the dog and the cat 语言")[0] == "en"


def test_word_scores_against_plain_sums(spark):
    model = fit(small(spark))
    words = ["Hund", "собака", "dogсобака", "x", "12", "i\u0307", "Straße", "漢字", "the-dog", "a" * 50]
    got, letters = model.scores(words)
    for word, row, n in zip(words, got, letters):
        runs, want = [], np.zeros(3)
        for c in filter(str.isalpha, word.lower()):
            name = next((s for a, b, s in SCRIPTS if a <= ord(c) <= b), "other")
            if runs and runs[-1][0] == name:
                runs[-1][1].append(c)
            else:
                runs.append((name, [c]))
        assert n == sum(len(r[1]) for r in runs)
        for name, run in runs:
            total = sum(model.logs[t].astype(float) for t in Units.of(["".join(run)], model.params.bits).trigrams)
            allowed = model.scripts[SCRIPT_NAMES.index(name)]
            if allowed.any():
                total = np.where(allowed, total, -np.inf)
                want += np.maximum(total - total.max(), -model.params.clip * max(1, len(run) / model.params.clip_letters))
        assert np.allclose(row, want, atol=1e-3), word
