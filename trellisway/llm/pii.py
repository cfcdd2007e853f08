"""Personal data: base patterns, and spans found by weak supervision of voting labelers."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_only, materialize, sub_batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "address", "email_spelled", "iban", "name", "phone_local", "secret")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

#: Words that often stand before personal data, and words or signs that stand after plain quantities.
GAZETTEER = frozenset(
    "account acct api apikey auth bearer call card cell contact credential credit email fax iban key mail mobile mailto "
    "passphrase passwd password phone pin pwd secret sms ssn tel telephone token visa".split()
)
UNITS = frozenset("% km kg m cm mm g mg l ml pages page seite seiten euros euro dollars usd eur years year jahre ans hours minutes".split())

#: Forms of address, words of streets, and words that lead to a person or a place.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme".split()
STREETS_AFTER = "Street St Road Rd Avenue Ave Lane Ln Drive Boulevard Blvd Court Square".split()
STREETS_JOINED = "straße strasse weg platz gasse allee".split()
STREETS_BEFORE = "rue avenue boulevard chemin Calle Avenida Plaza".split()
LEADS = frozenset(
    "address adresse anschrift at author by called contact dear delivered dirección from lives lived name named patient residence resident ship "
    "shipped signed sincerely to vive wohnt wohnhaft".split()
)

#: Common last labels of mail domains.
ENDINGS = frozenset("at be ch co com de edu es eu fr gov info io it net nl org pl pt uk us".split())

_DIGIT = re.compile("[0-9]")
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where its run of digits starts, so these need no retries inside a run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PHONE_LOCAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){7,}+(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]){11,30}+(?![0-9A-Za-z])")
_PROPER = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]+"
_NAME = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.?\x20{_PROPER}(?:\x20{_PROPER}){{0,2}}")
_ADDRESS = re.compile(
    rf"\b[0-9]{{1,5}}\x20(?:{_PROPER}\x20){{1,3}}(?:{'|'.join(STREETS_AFTER)})\b|\b[A-ZÄÖÜ][a-zäöüß-]+(?:{'|'.join(STREETS_JOINED)})\x20[0-9]{{1,4}}[a-z]?\b"
    rf"|\b(?:{'|'.join(STREETS_BEFORE)})\x20(?:d[eu]l?\x20(?:l[ao]s?\x20)?)?{_PROPER}(?:\x20{_PROPER})?,?\x20[0-9]{{1,4}}\b"
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_SPELLED = re.compile(r"[A-Za-z0-9._+-]{1,64}+\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}+)+")
#: Published prefixes of access keys and tokens.
_KEYS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,}|xox[abprs]-[0-9A-Za-z-]{10,}|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _TAIL.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind and start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := g.lstrip("0")) <= 3 and int(d or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _mod97(code: str) -> bool:
    """Whether the check digits of an account number in the international form fit."""
    own = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """What six labelers say of a candidate: 1 personal, -1 not, 0 no opinion."""
    body = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    digits = "".join(c for c in body if c in "0123456789")
    shape = {
        "email_spelled": 1,
        "iban": 1 if 15 <= len(body.replace(" ", "")) <= 34 else -1,
        "name": 1 if body.count(" ") >= 2 else 0,
        "address": 1,
        "phone_local": 1 if re.fullmatch(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}", body) else 0,
        "account": 1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{16}|([0-9]{4}[ -]){3}[0-9]{4}", body) else -1 if len(digits) < 10 else 0,
        "secret": 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{32,}={0,2}", body) else 0,
    }[kind]
    words = [w.lower() for w in _WORD.findall(before)]
    gazetteer = 1 if any(w in GAZETTEER for w in words[-3:]) else 0
    if kind in ("name", "address") and any(w in LEADS for w in words[-2:]):
        gazetteer = 1
    sign = before.rstrip(" \"'(<")[-1:]
    context = 1 if sign in ("=", ":", "#") and sign else -1 if before[-1:].isalpha() or after[:1].isalpha() else 0
    following = after.split()
    unit = -1 if following and following[0].strip(".,;") in UNITS or before.rstrip()[-1:] in ("$", "€", "£") else 0
    known_key = kind == "secret" and bool(_KEYS.fullmatch(body))
    if known_key:
        shape, random = 1, 1
    elif kind == "secret":
        mixed = sum(bool(re.search(p, body)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
        random = 1 if _entropy(body) >= 3.2 and mixed >= 2 and len(digits) * 8 >= len(body) else -1
    elif digits and kind in ("account", "phone_local"):
        random = -1 if len(set(digits)) <= 2 or digits in "0123456789012345678901234567890" else 0
    else:
        random = 0
    checksum = 1 if known_key else 0  # a published prefix or a known ending is what a checksum is to a number
    if kind == "account":
        checksum = 1 if 13 <= len(digits) <= 19 and luhn(digits) else 0
    elif kind == "iban":
        checksum = 1 if _mod97(body) else -1
    elif kind == "address":  # a postal code
        checksum = 1 if re.match(r",?\s(?:[A-Z][a-z]+,?\s)?[0-9]{5}\b", after) else 0
    elif kind == "email_spelled":
        context = max(context, 1 if "(" in body or "[" in body else 0)
        checksum = 1 if _WORD.findall(body)[-1].lower() in ENDINGS else 0
    return shape, gazetteer, context, unit, random, checksum


LABELERS = ("shape", "gazetteer", "context", "unit", "random", "checksum")


def _shape(kind: str, text: str, start: int, end: int) -> str:
    """A short pattern of a candidate's form for the final classifier: length class, quoted or not, line start or not."""
    size = min(3, (end - start) // 12)
    return f"{size}{int(text[start - 1 : start] in ('"', chr(39)))}{int(start == 0 or text[start - 1] == chr(10))}"


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Possible spans of the added kinds outside the base spans: (kind, start, end, pattern of votes and form).

    They may overlap each other: all of them are voted on, and :func:`chosen` picks among those that are accepted.
    """
    found = []
    if "(dot)" in text or "[dot]" in text or " dot " in text:
        found += [("email_spelled", *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        found += [("phone_local", *m.span()) for m in _PHONE_LOCAL.finditer(text)]
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        found += [("address", *m.span()) for m in _ADDRESS.finditer(text)]
        found += [("secret", *m.span()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()]
    found += [("name", *m.span()) for m in _NAME.finditer(text)]
    spans = sorted((a, b) for _, a, b in taken)
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda f: (f[1], -f[2], f[0])):
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if any(a < end and b > start for a, b in spans[max(0, at - 1) : at + 4]):
            continue
        votes = _votes(kind, text, start, end)
        out.append((kind, start, end, ",".join(map(str, votes)) + ";" + _shape(kind, text, start, end)))
    return out


def chosen(found: list[tuple[str, int, int, str]], accepted) -> list[tuple[str, int, int]]:
    """The accepted candidates without overlaps: the first counts, the longest of those, then by kind."""
    out, last = [], -1
    for kind, start, end, pattern in sorted(found, key=lambda c: (c[1], -c[2], c[0])):
        if start >= last and (kind, pattern) in accepted:
            out.append((kind, start, end))
            last = end
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_CANDIDATE = pa.struct([*_SPAN, ("pattern", pa.string())])
FOUND = (
    "doc_id long, base array<struct<kind:string,start:int,stop:int>>, "
    "candidates array<struct<kind:string,start:int,stop:int,pattern:string>>"
)


def _find(batches):
    keep_only()
    for batch in sub_batches(batches):
        base, more = [], []
        for text in batch.column(1).to_pylist():
            own = base_spans(text) if text else []
            base.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in own])
            more.append([dict(zip(("kind", "start", "stop", "pattern"), c, strict=True)) for c in candidates(text, own)] if text else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_CANDIDATE))], names=["doc_id", "base", "candidates"]
        )


@dataclass(frozen=True)
class LabelModel:
    """How often each labeler is right where it votes, by kind, and the accepted patterns of each kind."""

    accuracy: np.ndarray  # kind, labeler
    accepted: frozenset[tuple[str, str]]


#: Log odds that a candidate without any vote is personal, and rows that the accuracy over all kinds counts as beside a kind's own.
UNVOTED, BEHIND = -0.5, 20.0


def fit_label_model(patterns: list[tuple[str, str, int]], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over ``(kind, pattern, count)``, then a logistic classifier on the soft labels.

    A labeler is right with a chance of its own for each kind, at least one half, which keeps the two classes from changing
    places; abstaining says nothing. The table has one row per combination of votes and form, at
    most 3**6 * 16 a kind, whatever the corpus holds.
    """
    if not patterns:
        return LabelModel(np.full((0, len(LABELERS)), 0.5), frozenset())
    kinds = sorted({p[0] for p in patterns})
    votes = np.array([[int(v) for v in p[1].split(";")[0].split(",")] for p in patterns])
    kind = np.array([kinds.index(p[0]) for p in patterns])
    n = np.array([p[2] for p in patterns], float)
    of_kind = (kind[:, None] == np.arange(len(kinds))).astype(float)
    q = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1) - UNVOTED))
    for _ in range(rounds):
        cast = np.abs(votes) * n[:, None]
        right = cast * np.where(votes > 0, q[:, None], 1 - q[:, None])
        shared = (right.sum(axis=0) + 3) / (cast.sum(axis=0) + 4)  # votes tend to be right
        accuracy = np.clip((of_kind.T @ right + BEHIND * shared) / (of_kind.T @ cast + BEHIND), 0.5, 0.99)
        logs = UNVOTED + (votes * np.log(accuracy / (1 - accuracy))[kind]).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
    columns = [kind == k for k in range(len(kinds))]
    columns += [votes[:, j] == v for j in range(votes.shape[1]) for v in (-1, 1)]
    forms = sorted({p[1].split(";")[1] for p in patterns})
    form = np.array([forms.index(p[1].split(";")[1]) for p in patterns])
    columns += [form == f for f in range(len(forms))]
    x = np.array(columns, float).T
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps on weighted soft labels with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (q - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    accepted = frozenset((a, b) for (a, b, _), s in zip(patterns, p, strict=True) if s >= 0.5)
    return LabelModel(accuracy, accepted)


def _accept(batches, sent):
    accepted = sent.value
    order = {k: i for i, k in enumerate(KINDS)}
    for batch in sub_batches(batches):
        spans = []
        for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = [(s["kind"], s["start"], s["stop"]) for s in base]
            own += chosen([(c["kind"], c["start"], c["stop"], c["pattern"]) for c in more], accepted)
            own.sort(key=lambda s: (order[s[0]], s[1]))
            spans.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "base", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every row's whole text: ``(doc_id, base, spans)``, lists of ``(kind, start, stop)`` in code points.

    base has the matches of the four base patterns; spans adds the candidates that the trained classifier accepts,
    outside the base matches. Texts are read once: votes of six labelers (shape, words before, signs around, units,
    randomness, checksum) are written with the candidates, their counts over all rows are what expectation-maximisation
    learns from, and the classifier trained on its soft labels decides.

    Null and empty texts have no spans. Repeated rows and null doc_ids are searched row by row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(rows.mapInArrow(_find, FOUND), "spans")
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.pattern").agg(F.count("*").alias("n")).collect()
    model = fit_label_model(sorted((r["kind"], r["pattern"], r["n"]) for r in counts))
    sent = docs.sparkSession.sparkContext.broadcast(model.accepted)
    one = "array<struct<kind:string,start:int,stop:int>>"
    return found.mapInArrow(lambda it: _accept(it, sent), f"doc_id long, base {one}, spans {one}")


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digest of the base spans of every document, and all its spans; null and empty texts have none."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(documents(spark, sf_dir)).select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def _cut_out(batches, sent, names):
    accepted, text_at = sent.value, names.index("text")
    for batch in sub_batches(batches):
        texts = []
        for text in batch.column(text_at).to_pylist():
            if text:
                own = base_spans(text)
                spans = own + chosen(candidates(text, own), accepted)
                out, at = [], 0
                for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if start >= at:
                        out += [text[at:start], f"[{kind.upper()}]"]
                        at = end
                    elif end > at:
                        at = end
                text = "".join(out) + text[at:]
            texts.append(text)
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of :func:`find` replaced by its kind in brackets; other columns stay.

    Overlapping spans are replaced together, under the kind of the first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = (
        rows.mapInArrow(_find, FOUND).select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", "c.pattern").agg(F.count("*").alias("n")).collect()
    )
    model = fit_label_model(sorted((r["kind"], r["pattern"], r["n"]) for r in counts))
    sent, names = docs.sparkSession.sparkContext.broadcast(model.accepted), docs.columns
    return docs.mapInArrow(lambda it: _cut_out(it, sent, names), docs.schema)
