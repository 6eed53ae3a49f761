"""SimHash near-duplicates: pigeonring candidate filtering, Hamming verification, components.

A 64-bit fingerprint is a ring of 16 segments of 4 bits. If two differ in at most 3 bits, then from some
segment on every chain of l consecutive segments has at most l * 3 / 16 differing bits: none in 5, at most
one in 10, at most two in 15. So candidates agree in 20 bits from some start and in one half of the 20 bits
that follow: 32 keys of 30 bits each, and no other pair is ever looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ranges, rows, texts
from .components import connected

SEGMENTS, WIDTH = 16, 4
#: Differing bits allowed, and in the first 10 and 15 segments of a chain.
BITS, BITS_10, BITS_15 = 3, 1, 2
#: Fingerprints under one key that are compared in its task; a larger group is dealt out anew by finer keys.
GROUP = 4096
#: The 34 bits beside a key, in 6 parts of which 3 must agree: 20 finer keys.
PARTS = (6, 6, 6, 6, 5, 5)


def digests(text: str | None, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``shingle`` words, or of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and \x20 \x09-\x0D alone
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, seed)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64; without words the fingerprint is 0."""
    hashes = digests(text, shingle, seed)
    if len(hashes) <= 1:
        return hashes[0] if hashes else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for _, t in rows([batch])), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp): the 32 keys, ring start and half (``which``) above, 20 + 10 bits below."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1))).alias("which"))
    turned = each.withColumn("r", F.expr(f"shiftleft(fp, {WIDTH} * div(which, 2)) | shiftrightunsigned(fp, 64 - {WIDTH} * div(which, 2))".replace("div(which, 2)", "int(which div 2)")))
    key = "shiftleft(bigint(which), 30) | shiftleft(shiftrightunsigned(r, 44), 10) | (shiftrightunsigned(r, 34 - 10 * (which % 2)) & 1023)"
    return turned.select(F.expr(key).alias("key"), "fp")


def _finer(keyed: DataFrame) -> DataFrame:
    """(key, fp) anew: each choice of 3 of the 6 parts of the 34 bits beside the key, hashed with it."""
    choices = list(itertools.combinations(range(len(PARTS)), 3))
    below = [sum(PARTS[i + 1 :]) for i in range(len(PARTS))]
    each = keyed.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(len(choices) - 1))).alias("choice"))
    each = each.withColumn("bits", F.expr(f"{WIDTH} * int(shiftrightunsigned(key, 31))")).withColumn("half", F.expr("shiftrightunsigned(key, 30) & 1"))
    each = each.withColumn("r", F.expr("shiftleft(fp, bits) | shiftrightunsigned(fp, 64 - bits)"))
    ten = "if(half = 0, shiftrightunsigned(r, 24), shiftrightunsigned(r, 34)) & 1023"
    each = each.withColumn("rest", F.expr(f"shiftleft({ten}, 24) | (r & {(1 << 24) - 1})"))
    parts = []
    for place in range(3):
        shift = ", ".join(str(below[c[place]]) for c in choices)
        mask = ", ".join(str((1 << PARTS[c[place]]) - 1) for c in choices)
        parts.append(F.expr(f"shiftrightunsigned(rest, get(array({shift}), choice)) & get(array({mask}), choice)"))
    return each.select(F.xxhash64("key", "choice", *parts).alias("key"), "fp")


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """Chain budgets from the key's start, then the full Hamming check; without a start the full check only."""
    x = a ^ b
    if start is not None:
        turn = (start * WIDTH).astype("<u8")
        x = (x << turn) | np.where(turn == 0, np.uint64(0), x >> ((np.uint64(64) - turn) & np.uint64(63)))
        ok = (np.bitwise_count(x >> np.uint64(24)) <= BITS_10) & (np.bitwise_count(x >> np.uint64(4)) <= BITS_15)
        return ok & (np.bitwise_count(x) <= BITS)
    return np.bitwise_count(x) <= BITS


def _tree(fps: np.ndarray, start: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span a group's components: breadth first, each member against those not yet reached."""
    left, ends_a, ends_b = fps, [], []
    starts = None if start is None else np.array([start])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _linked(left, at, starts)
            if hit.any():
                got = left[hit]
                ends_a.append(got)
                ends_b.append(np.full(len(got), at))
                queue.extend(got)
                left = left[~hit]
    none = np.empty(0, "<u8")
    return (np.concatenate(ends_a), np.concatenate(ends_b)) if ends_a else (none, none)


def _links(key: np.ndarray, fp: np.ndarray, ringed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints under equal keys, all of whose rows are here, sorted by key."""
    starts_of = (lambda k: k >> 31) if ringed else (lambda k: None)
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    begin = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([begin, [len(key)]]))
    ends_a, ends_b = [np.empty(0, "<u8")], [np.empty(0, "<u8")]
    small = np.repeat((size > 1) & (size <= 16), size)
    k, f = key[small], fp[small]
    for step in range(1, 16):  # all pairs of all small groups at once, by distance in the sorted order
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else []
        if not len(same):
            break
        a, b = f[same], f[same + step]
        hit = _linked(a, b, starts_of(k[same]))
        ends_a.append(a[hit])
        ends_b.append(b[hit])
    for g in np.flatnonzero(size > 16).tolist():
        at = begin[g]
        a, b = _tree(np.unique(fp[at : at + size[g]]), int(key[at]) >> 31 if ringed else None)
        ends_a.append(a)
        ends_b.append(b)
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    if len(a):
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        a, b = pairs
    return a, b


def _compare(ringed: bool) -> Callable[[Iterator], Iterator]:
    """For mapInArrow over rows (key, fp) sorted by key: links (key null), and rows of too large groups (key set)."""

    def table(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([keys, pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["key", "fp", "other"])

    def run(batches: Iterator) -> Iterator:
        keys, fps, hot = np.empty(0, "<i8"), np.empty(0, "<u8"), None
        for batch in batches:
            k, f = batch.column(0).to_numpy().astype("<i8"), batch.column(1).to_numpy().astype("<i8").view("<u8")
            if hot is not None:
                n = int(np.searchsorted(k, hot, side="right"))
                if n:
                    yield table(k[:n], f[:n], f[:n])
                    k, f = k[n:], f[n:]
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if len(keys) < 1 << 18:
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            yield from whole(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
            if ringed and len(keys) > GROUP:  # goes on in later batches: all of it is dealt out anew
                hot = keys[0]
                yield table(keys, fps, fps)
                keys, fps = keys[:0], fps[:0]
        yield from whole(keys, fps)

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator:
        if not len(keys):
            return
        if ringed:
            cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            size = np.diff(cut)
            big = np.repeat(size > GROUP, size)
            if big.any():
                yield table(keys[big], fps[big], fps[big])
                keys, fps = keys[~big], fps[~big]
        if len(keys):
            a, b = _links(keys, fps, ringed)
            if len(a):
                yield table(None, a, b)

    return run


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links that connect whatever fingerprints lie within ``BITS`` bits; ``fps`` has distinct ``fp``."""
    n = ranges(fps.sparkSession)
    out = materialise(_keyed(fps).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(True), "key long, fp long, other long"), "simhash-links")
    near = out.where("key is null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    again = out.where("key is not null").select("key", "fp")
    more = _finer(again).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(False), "key long, fp long, other long")
    return near.union(more.select("fp", "other"))


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable over links) per row of ``docs``.

    Null and wordless texts have fingerprint 0 and link like any others. Equal texts share a fingerprint, so
    only distinct fingerprints are compared, whatever the size of a group of copies. A null id is passed on
    and is never a component's id (a component of null ids only has a null one); repeated rows give repeated
    results; an empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = materialise(connected(links(distinct.select("fp"))), "components")
    named = roots.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    classes = distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id; all columns are kept.

    Rows whose id is null cannot be told apart from others by id and are kept. Repeated rows of the smallest
    id all stay.
    """
    first = near_duplicates(docs, shingle).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").select(docs.columns)
    return known.unionByName(docs.where("doc_id is null"))
