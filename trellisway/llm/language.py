"""Language of texts and of their spans: script ranges, per-word scores and Viterbi with a switching penalty."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, documents, materialize, small_side, sub_batches
from .lsh import mix

#: Code point ranges of scripts (first, last, name).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"),
    (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]

#: Names of the scripts; a letter outside all ranges is of the first.
SCRIPT_NAMES = ["other", *dict.fromkeys(name for *_, name in SCRIPTS)]

_SCRIPT_AT = np.zeros(0x110000, np.uint8)
for _first, _last, _name in SCRIPTS:
    _SCRIPT_AT[_first : _last + 1] = SCRIPT_NAMES.index(_name)

_CLASSES = ["".join(f"{chr(a)}-{chr(b)}" for a, b, n in SCRIPTS if n == name) for name in SCRIPT_NAMES[1:]]
#: Runs of letters of one script.
_RUNS = re.compile("|".join(f"[{c}]+" for c in [*_CLASSES, "^" + "".join(_CLASSES)]))


@dataclass(frozen=True)
class LanguageParams:
    """``train_docs`` is the number of labelled documents of each language that are learned from, about, chosen by a hash of doc_id;
    ``bits`` the size of the table that letter trigrams are hashed into. ``clip`` bounds what ``clip_letters`` letters can say
    against a language, so the evidence of a long run without spaces grows with its length."""

    train_docs: int = 1500
    bits: int = 18
    switch: float = 8.0
    clip: float = 6.0
    clip_letters: int = 6


@dataclass
class Units:
    """Runs of letters of one script of each of some words, and the hashed trigrams of each run, its borders included."""

    word: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    trigrams: np.ndarray

    @classmethod
    def of(cls, words: Iterable[str], bits: int) -> Units:
        runs, word = [], []
        for i, w in enumerate(words):
            low = w.lower()
            if not low.isalpha():
                low = "".join(filter(str.isalpha, low))
            if low:
                own = [low] if low.isascii() else _RUNS.findall(low)
                runs += own
                word += [i] * len(own)
        letters = np.fromiter(map(len, runs), np.int64, len(runs))
        codes = np.frombuffer("".join(f"<{r}>" for r in runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(letters + 2)
        inside = np.ones(len(codes), bool)
        inside[ends - 1] = inside[ends - 2] = False
        packed = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
        grams = (mix(packed[inside[:-2]]) >> np.uint64(64 - bits)).astype(np.int64)
        return cls(np.array(word, np.int64), _SCRIPT_AT[codes[ends - letters - 1].astype(np.int64)], letters, np.cumsum(letters) - letters, grams)


@dataclass
class LanguageModel:
    """Log probabilities of hashed trigrams by language, and which languages were seen in each script (scripts, languages)."""

    languages: list[str]
    logs: np.ndarray
    scripts: np.ndarray
    params: LanguageParams = field(default_factory=LanguageParams)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word by language, relative to the best, and its number of letters.

        Each run of one script counts with its own bound, and languages of other scripts are at that bound. A run of a
        script that no language was seen in, or a word without letters, says nothing.
        """
        out, sizes = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        units = Units.of(words, self.params.bits)
        if not len(units.word):
            return out, sizes
        total = np.add.reduceat(self.logs[units.trigrams], units.start, axis=0).astype(np.float64)
        total[~self.scripts[units.script]] = -np.inf
        known = self.scripts[units.script].any(axis=1)
        bound = self.params.clip * np.maximum(1.0, units.letters / self.params.clip_letters)
        total[known] = np.maximum(total[known] - total[known].max(axis=1, keepdims=True), -bound[known, None])
        total[~known] = 0.0
        np.add.at(out, units.word, total)
        np.add.at(sizes, units.word, units.letters)
        return out, sizes


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best language per word, where each change of language costs ``switch``.

    The single best language is the answer at once if no run of words gains more than one change costs; the
    words are walked one by one only in texts that may hold more than one language.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    if k > 1:
        gain = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
        run = np.concatenate([[0.0], np.cumsum(gain)])
        if (run - np.minimum.accumulate(run)).max() > switch:
            return _walk(scores, switch)
    return np.full(n, best)


def _walk(scores: np.ndarray, switch: float) -> np.ndarray:
    n, k = scores.shape
    total, back = scores[0].copy(), np.empty((n, k), np.int16)
    stay = np.arange(k)
    for t in range(1, n):
        top = int(total.argmax())
        changed = total[top] - switch
        moved = total < changed
        back[t] = np.where(moved, top, stay)
        total = np.where(moved, changed, total) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(total.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


class Labeller:
    """Word scores kept as rows of one table; the new words of a batch of texts are scored at once."""

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        self.table, self.sizes = np.zeros((0, len(self.model.languages))), np.zeros(0, np.int64)
        self.rows: dict[str, int] = {}

    def _learn(self, words: Iterable[str]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.rows))
        if self.rows and len(self.rows) + len(new) > self.limit:  # past the limit by one batch's words at most
            self.reset()
            new = list(dict.fromkeys(words))
        parts = [self.model.scores(new[at : at + 20_000]) for at in range(0, len(new), 20_000)]
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.table = np.concatenate([self.table, *(p[0] for p in parts)])
        self.sizes = np.concatenate([self.sizes, *(p[1] for p in parts)])

    def label_all(self, texts: list[str | None], chars: int = 2_000_000) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """:meth:`label` of each text, by batches of about so many characters."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append((text or "").split())
            size += len(text or "")
            if size >= chars or i + 1 == len(texts):
                out += self._labels(held)
                held, size = [], 0
        return out

    def _labels(self, texts: list[list[str]]):
        if not self.model.languages:
            return [("und", 0.0, [])] * len(texts)
        flat = [w for words in texts for w in words]
        self._learn(flat)
        at = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
        scores, sizes, start, out = self.table[at], self.sizes[at], 0, []
        for words in texts:
            end = start + len(words)
            letters = sizes[start:end]
            if letters.any():
                path = viterbi(scores[start:end], self.model.params.switch)
                by = np.bincount(path, letters, len(self.model.languages))
                top = int(by.argmax())
                cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
                spans = [(a, b, self.model.languages[path[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                out.append((self.model.languages[top], float(by[top] / by.sum()), spans))
            else:
                out.append(("und", 0.0, []))
            start = end
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language with most letters, its share of the letters, spans of words (first, end, language)).

        ``und``, 0 and no spans for null and for texts without a letter.
        """
        return self.label_all([text])[0]


def _counts(batches, bits: int):
    """Numbers of hashed trigrams by language, and of runs by script, whose place is the negative number of the script less one."""
    for batch in sub_batches(batches, 200):
        words: dict[str, Counter] = {}
        for text, lang in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
            words.setdefault(lang, Counter()).update((text or "").split())
        for lang, counted in words.items():
            units, n = Units.of(counted, bits), np.fromiter(counted.values(), np.int64, len(counted))
            if len(units.word):
                times = n[units.word]
                place = np.concatenate([units.trigrams, -1 - units.script.astype(np.int64)])
                found, at = np.unique(place, return_inverse=True)
                total = np.bincount(at, np.concatenate([np.repeat(times, units.letters), times])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total)], names=["lang", "place", "n"])


def fit(docs: DataFrame, params: LanguageParams = LanguageParams(), usable=None) -> LanguageModel:
    """Letter trigram model from the texts and non-null languages of ``docs`` (doc_id, text, lang).

    usable: condition on doc_id that training rows meet. About ``train_docs`` rows of each language are read,
    those with the least hash of doc_id. Counting is distributed; the driver gets at most ``2 ** bits`` counts a language.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        "lang is not null and text is not null and doc_id is not null"
    )
    if usable is not None:
        known = known.filter(usable)
    share = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = share.select("lang", F.least(F.lit(1.0), F.lit(float(params.train_docs)) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.join(small_side(materialize(share, "shares")), "lang").filter(place < F.col("share")).select("text", "lang")
    counts = picked.mapInArrow(lambda it: _counts(it, params.bits), "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    index = {name: i for i, name in enumerate(languages)}
    of, at, n = np.array([index[x] for x in langs], np.int64), rows.column("place").to_numpy(), rows.column("n").to_numpy()
    table, seen = np.zeros((1 << params.bits, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    gram = at >= 0
    table[at[gram], of[gram]] = n[gram]
    seen[-1 - at[~gram], of[~gram]] = n[~gram]
    size = np.count_nonzero(table.any(axis=1)) + 1
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * size)).astype(np.float32) if languages else table.astype(np.float32)
    return LanguageModel(languages, logs, (seen > 0) & (1000 * seen >= seen.sum(axis=0)), params)


_labellers: dict[str, Labeller] = {}


def _label(batches, sent):
    if sent.id not in _labellers:
        _labellers.clear()
        _labellers[sent.id] = Labeller(sent.value)
    labeller = _labellers[sent.id]
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    for batch in sub_batches(batches):
        found = labeller.label_all(batch.column(1).to_pylist())
        spans = [[{"first": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, span)],
            names=["doc_id", "lang_pred", "score", "spans"],
        )


class _Sent:
    """A broadcast model with a name that worker processes can keep it by."""

    def __init__(self, spark: SparkSession, model: LanguageModel):
        self.id, self.data = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    @property
    def value(self) -> LanguageModel:
        return self.data.value


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` of every row's whole text; spans are runs of words (white space) by language.

    lang_pred has most letters, and score is its share of all letters. Null texts and texts without a letter are
    ``und`` with score 0 and no spans. Words of a script that no learned language is written in say nothing. Ties go to
    the language first in alphabetical order. Repeated rows and null doc_ids are labelled row by row.
    """
    sent = _Sent(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _label(it, sent),
        "doc_id long, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>",
    )


HELD_OUT, MOD = 2, 4


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document's whole text by :func:`predict`; null texts and texts without a letter are ``und`` with score 0."""
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs, usable=crc_bucket("doc_id", MOD) != HELD_OUT))
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", MOD) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
