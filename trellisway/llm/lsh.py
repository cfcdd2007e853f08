"""One-permutation MinHash with optimal densification, band keys, star-shaped candidate edges and verified components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BoundedCache, keep_only, materialize, small_side, sub_batches
from .components import connected_components

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def odd_constants(n: int, seed: int = 11) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


@lru_cache
def probe_order(bins: int) -> np.ndarray:
    """For each bin its own random order of bins; an empty bin copies the first filled one of its order."""
    rng = np.random.default_rng(bins)
    return np.argsort(rng.random((bins, bins)), axis=1).T.copy()


def one_permutation(owner: np.ndarray, hashes: np.ndarray, owners: int, bins: int) -> np.ndarray:
    """Signatures ``(owners, bins)`` from one hash per shingle.

    owner: index of each hash's set, below 2**20. The upper half of a hash chooses its bin, the lower half is
    its value there, and each bin keeps the least. Empty bins are densified by probing; a set without any hash
    keeps the largest value in every bin.
    """
    width = max(1, (bins - 1).bit_length())
    slot = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    packed = (owner.astype(np.uint64) << np.uint64(32 + width)) | (slot << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    packed.sort()
    cell = packed >> np.uint64(32)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    cell, value = cell[first], packed[first] & np.uint64(0xFFFFFFFF)
    sig = np.full((owners, bins), 0xFFFFFFFF, np.uint64)
    filled = np.zeros((owners, bins), bool)
    at = (cell >> np.uint64(width)).astype(np.int64), (cell & np.uint64((1 << width) - 1)).astype(np.int64)
    sig[at], filled[at] = value, True
    at_row, at_bin = np.nonzero(~filled & filled.any(axis=1)[:, None])
    dense = sig.copy()
    for probe in probe_order(bins):
        if not len(at_row):
            break
        source = probe[at_bin]
        hit = filled[at_row, source]
        dense[at_row[hit], at_bin[hit]] = sig[at_row[hit], source[hit]]
        at_row, at_bin = at_row[~hit], at_bin[~hit]
    return dense


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values."""
    bands = sig.shape[1] // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for i, c in enumerate(odd_constants(rows, 23)):
        keys = mix(keys + parts[:, :, i] * c)
    return mix(keys + np.arange(bands, dtype=np.uint64) * _GOLDEN).view(np.int64)


def _local_stars(batches):
    """Within an Arrow batch the least id of a key becomes the hub of the key's other ids.

    Only hubs go on under the band key, so a key that many rows share reaches the shuffle once a batch. A member
    goes on with its hub as ``peer``, once a batch for however many keys they share.
    """
    for batch in batches:
        ids, flat = batch.column("id").to_numpy(), batch.column("keys").flatten().to_numpy(zero_copy_only=False)
        if not len(ids) or not len(flat):
            continue
        row = np.repeat(np.arange(len(ids)), len(flat) // len(ids))
        order = np.lexsort((ids[row], flat))
        key, row = flat[order], row[order]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        hub = row[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
        pairs = np.unique((row * len(ids) + hub)[ids[hub] != ids[row]])
        member, its_hub = pairs // len(ids), pairs % len(ids)
        row = np.concatenate([row[start], member])
        peer = np.concatenate([np.zeros(int(start.sum()), np.int64), its_hub])
        none = np.arange(len(row)) < int(start.sum())
        key = np.concatenate([key[start], mix(ids[member].view(np.uint64) ^ mix(ids[its_hub].view(np.uint64))).view(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), pa.array(ids[peer], mask=none)], names=["key", "id", "peer"])


def star_edges(sketches: DataFrame) -> DataFrame:
    """Candidate edges ``(a, b)`` from rows ``(id long, keys array<long>)``: of each member of a band bucket to the bucket's least id.

    A bucket of n members gives n - 1 edges and never all its pairs. Within an Arrow batch a star has a hub of its own, which
    is then a member of the bucket's star. Every row has the same number of keys.
    """
    own = sketches.select(F.col("id").cast("long").alias("id"), "keys")
    local = own.mapInArrow(_local_stars, "key long, id long, peer long")
    least = F.min("id").over(Window.partitionBy("key"))
    return local.select("id", "peer", least.alias("least")).select(F.col("id").alias("a"), F.coalesce("peer", "least").alias("b")).filter("a <> b")


@dataclass(frozen=True)
class Bound:
    """A cluster of at most so many rows and characters is compared within one task; one beyond it takes joins."""

    rows: int = 10_000
    chars: int = 6_000_000


def _link_few(ids: list[int], sets: list[set], num: int, den: int) -> list[int]:
    """Component of each row (its least row): all pairs that are not joined already, by plain sets."""
    part = [ids.index(i) for i in ids]
    for j in range(1, len(ids)):
        for i in range(j):
            if part[i] != part[j]:
                m, n = len(sets[i]), len(sets[j])
                if den * min(m, n) >= num * max(m, n) and m and n:
                    overlap = len(sets[i] & sets[j])
                    if den * overlap >= num * (m + n - overlap):
                        low, high = sorted((part[i], part[j]))
                        part = [low if p == high else p for p in part]
    return part


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _link_many(ids: np.ndarray, owner: np.ndarray, hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The same for many rows: one row at a time is compared with all others at once, through an index from shingles to rows.

    A shingle that more than half of the rows have is kept as the list of those that lack it. Rows are compared until
    those not yet compared are all in one component, so a cluster of copies takes a few steps.
    """
    n = len(ids)
    part = np.unique(ids, return_index=True)[1][np.unique(ids, return_inverse=True)[1]]
    code, own = np.divmod(np.unique(np.unique(hashes, return_inverse=True)[1].astype(np.int64) * n + owner), n)
    size, found = np.bincount(own, minlength=n), np.bincount(code)
    common = np.flatnonzero(2 * found > n)
    lacks = np.ones((len(common), n), bool)
    often = np.isin(code, common)
    lacks[np.searchsorted(common, code[often]), own[often]] = False
    lack_code, lack_own = np.nonzero(lacks)
    lack_start = np.searchsorted(lack_code, np.arange(len(common) + 1))
    code, own = code[~often], own[~often]
    start = np.searchsorted(code, np.arange(len(found) + 1))
    by_row = np.argsort(own, kind="stable")
    row_code, row_start = code[by_row], np.searchsorted(own[by_row], np.arange(n + 1))
    compared = np.zeros(n, bool)
    while True:
        left = np.flatnonzero(~compared)
        main = np.bincount(part[left]).argmax() if len(left) else 0
        outside = left[part[left] != main]
        if not len(outside):
            return part
        i = outside[0]
        compared[i] = True
        rare = row_code[row_start[i] : row_start[i + 1]]
        overlap = np.bincount(own[_spans(start[rare], start[rare + 1] - start[rare])], minlength=n)
        has = np.flatnonzero(~lacks[:, i])
        overlap += len(has) - np.bincount(lack_own[_spans(lack_start[has], lack_start[has + 1] - lack_start[has])], minlength=n)
        linked = (den * overlap >= num * (size + size[i] - overlap)) & (size > 0)
        if size[i] and linked.any():
            parts = np.unique(part[linked])
            part[np.isin(part, parts)] = parts[0]


def _solve(batches, sets_of: Callable, num: int, den: int):
    """Components within each cluster of rows ``(cluster, id, text)``, which come in order of cluster."""
    keep_only()
    held: list[tuple] = []

    def components(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        hashes, counts = sets_of([r[2] for r in rows])
        ends = np.cumsum(counts)
        first = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]]
        for a, b in zip(first, [*first[1:], len(rows)], strict=True):
            ids = [r[1] for r in rows[a:b]]
            if b - a > 48:
                at = ends[a] - counts[a]
                part = _link_many(np.array(ids), np.repeat(np.arange(b - a), counts[a:b]), hashes[at : ends[b - 1]], num, den).tolist()
            else:
                part = _link_few(ids, [set(hashes[ends[i] - counts[i] : ends[i]].tolist()) for i in range(a, b)], num, den)
            groups: dict[int, set[int]] = {}
            for i, p in zip(ids, part, strict=True):
                groups.setdefault(p, set()).add(i)
            yield from ((i, least) for g in groups.values() if len(g) > 1 for least in [min(g)] for i in g)

    def sections(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Whole clusters of a few million characters, so that long texts are not hashed all at once."""
        start = chars = 0
        for i, row in enumerate(rows):
            if chars > 4_000_000 and row[0] != rows[i - 1][0]:
                yield rows[start:i]
                start, chars = i, 0
            chars += len(row[2] or "")
        yield rows[start:]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found = [pair for part in sections(rows) for pair in components(part)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["id", "component"])

    for batch in sub_batches(batches):
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        whole = len(held)
        while whole and held[whole - 1][0] == held[-1][0]:
            whole -= 1
        if whole:
            yield out(held[:whole])
            held = held[whole:]
    if held:
        yield out(held)


def _verified(batches, sets_of: Callable, num: int, den: int):
    keep_only()
    sets = BoundedCache(lambda t: np.unique(sets_of([t])[0]), 64)
    for batch in sub_batches(batches):
        a, b, left, right = (c.to_pylist() for c in batch.columns)
        keep = []
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            s, t = sets[x], sets[y]
            overlap = len(np.intersect1d(s, t, assume_unique=True))
            if len(s) and len(t) and den * overlap >= num * (len(s) + len(t) - overlap):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def linked_components(sketches: DataFrame, texts_of: Callable, sets_of: Callable, num: int, den: int, bound: Bound = Bound()) -> DataFrame:
    """Components ``(id, component)`` of the ids whose sets are alike and that share a band bucket; ids without a link are left out.

    sketches: ``(id long, keys array<long>)``. ``texts_of(ids)`` gives ``(id, text)`` of a table of ids, and ``sets_of(texts)``
    the hashed shingles of a list of texts, one text after the other, and their numbers. Two texts are linked where ``den *
    overlap >= num * union``.

    The stars of all buckets are joined into candidate clusters before any text is read, so a text travels once,
    however many buckets it is in. A cluster within ``bound`` is compared in one task until each two of its rows are
    compared or joined. Those of a larger cluster take :func:`_by_rounds`. Neither leaves out a pair that shares a bucket.
    """
    clusters = connected_components(star_edges(sketches))
    clusters = materialize(clusters.select("id", F.col("component").alias("cluster")), "clusters")
    texts = texts_of(clusters.select("id"))
    members = materialize(texts.select("id", "text").join(small_side(clusters), "id").select("cluster", "id", "text"), "members")
    large = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
    large = materialize(large.filter((F.col("n") > bound.rows) | (F.col("chars") > bound.chars)).select("cluster"), "large")
    known = small_side(large)
    one_task = members.join(known, "cluster", "left_anti").repartition("cluster").sortWithinPartitions("cluster", "id")
    found = one_task.mapInArrow(lambda it: _solve(it, sets_of, num, den), "id long, component long")
    found = materialize(found, "components")
    if large.isEmpty():
        return found
    rest = materialize(members.join(known, "cluster", "left_semi").select("id", "text"), "members")
    ids = small_side(materialize(rest.select("id").distinct(), "ids"))
    return found.unionByName(_by_rounds(sketches.join(ids, "id", "left_semi"), rest, sets_of, num, den))


def _by_rounds(sketches: DataFrame, texts: DataFrame, sets_of: Callable, num: int, den: int) -> DataFrame:
    """Components of the same links by joins, for clusters of any size.

    A bucket that holds more than one component is open: of its members outside its largest component some become hubs
    of a round and are compared with every member of another component, which settles a hub for that bucket. Rounds
    have four times as many hubs each and end when no bucket is open, so that each pair of a bucket has been compared
    or is joined already. Copies close their buckets in the first round and cost no pairs.
    """
    links = tested = components = None
    members, hubs = sketches.select(F.explode("keys").alias("key"), F.col("id").cast("long").alias("id")).distinct(), 1
    while True:
        if components is None:
            members = members.withColumn("component", F.col("id"))
        else:
            named = small_side(components.select("id", "component"))
            members = members.drop("component").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = materialize(members, "members")
        parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
        largest = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
        largest = small_side(materialize(largest.filter("parts > 1").select("key", "main"), "open"))
        members = materialize(members.join(largest, "key"), "members")
        if members.isEmpty():
            return components if components is not None else members.select("id", "component")
        turn = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
        outside = members.filter("component <> main").select("key", "id", "component").withColumn("r", F.row_number().over(turn))
        drawn = outside.filter(F.col("r") <= hubs).select("key", F.col("id").alias("hub"), F.col("component").alias("hub_part"))
        drawn = small_side(materialize(drawn, "drawn"))
        pairs = members.join(drawn, "key").filter("component <> hub_part")
        pairs = pairs.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        sides = sides.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
        more = materialize(sides.mapInArrow(lambda it: _verified(it, sets_of, num, den), "a long, b long").distinct(), "links")
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            components = connected_components(links)
        tested = pairs if tested is None else tested.unionByName(pairs)
        members = members.drop("main").join(drawn.select("key", F.col("hub").alias("id")), ["key", "id"], "left_anti")
        hubs *= 4
