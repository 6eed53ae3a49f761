"""Near-duplicate documents: SimHash with pigeonring filtering, then every further link of word shingles, components.

Documents link where their sets of word shingles have a Jaccard similarity of t or more. Candidates come from two sides:
fingerprints of the shingles within 3 bits, found by op4's pigeonring chains; and, since most pairs at t = 0.8 lie
further apart than any such filter can reach, an exact filter for the rest. If two sets have a similarity of t, they share
ceil(t / (1 + t) * (n + m)) members at least. In any order that holds for all sets, let their prefixes be the first
n - ceil(t * n) + 1 members. Whatever they share beyond the prefix that ends first is less than ceil(t * n) members, so
the prefixes themselves have the others in common: pairs with fewer common members there are dropped, and no pair is
lost. The order is that of the shingles' XXH64, with shingles of many documents moved to the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import if_small, materialise, ranges, release
from .components import connected
from .pretokens import from_planes, pack, planes, unpack

#: In blocks of up to HOT documents all meet; in larger ones all meet the first, then STARS others, and then those of other components.
#: Shingles that are seen to stand in more than HOT documents go to the end of the order, the FREQUENT most frequent at most.
HOT, FREQUENT = 64, 500_000
#: Shingles that are counted at once, members of prefixes that are sent at once, pairs that are counted at once.
COUNTED, SENT, PAIRS = 4_000_000, 1_000_000, 2_000_000
#: Bits of a member of a prefix as it is sent (equal ones by chance only let more pairs through), bytes of text to a range of them.
KEY_BITS, RANGE_BYTES = 40, 128 << 20
#: Rounds in which the members of a block beyond HOT meet one of another component only, before all those of different ones do.
STARS = 2
#: What stands for the number of common members where it is not known.
UNKNOWN = 1 << 40
#: Shingle hashes that a worker remembers.
REMEMBERED = 4_000_000


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes; a text of fewer words is one shingle, one without words has none."""
    return np.unique(np.array(simhash.digests(text, shingle), "<u8"))


def prefix(found: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The members by which a set is looked up; ``hot`` is sorted."""
    if not len(found):
        return found
    n = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    if not len(hot):
        return found[:n]
    late = hot[np.minimum(np.searchsorted(hot, found), len(hot) - 1)] == found
    return np.concatenate([found[~late], found[late]])[:n]


def fingerprint(found: np.ndarray) -> np.uint64:
    """SimHash of a set of shingles: a bit is 1 if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0]


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many documents, by the counts of those that repeat among the documents counted at once; they only decide the order."""

    def run(batches: Iterator) -> Iterator:
        held, total = [], 0

        def close() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view("<i8")), pa.array(n[n > 1])], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, shingle))
                total += len(held[-1])
                if total > COUNTED:
                    yield close()
                    held, total = [], 0
        if total:
            yield close()

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    return np.sort(counts.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow().column(0).to_numpy().astype("<i8").view("<u8"))


def _range_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(KEY_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _sent(docs: DataFrame, shingle: int, similarity: float, hot: np.ndarray, n_parts: int) -> DataFrame:
    """A written table. Part -1: documents with their set (node stands for it, size) and fingerprint; others: the keys of a range
    in ascending order and whose they are. ``first`` is the number of the first of the documents that a row is about."""
    meta = [("doc_id", "i8"), ("row_key", "i8"), ("node", "i8"), ("size", "i4"), ("fp", "i8")]

    def run(batches: Iterator) -> Iterator:
        number = TaskContext.get().partitionId() << 40
        own, keys, total = [], [], 0

        def close() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(own)), [len(k) for k in keys]).astype("<u4")
            with np.errstate(over="ignore"):
                key = (np.concatenate(keys) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - KEY_BITS)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            cuts = np.searchsorted(_range_of(key, n_parts), np.arange(n_parts + 1))
            parts, sizes, payloads = [-1], [len(own)], [b""]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    parts.append(part)
                    sizes.append(int(b - a))
                    payloads.append(pack(planes(np.diff(key[a:b], prepend=np.uint64(0))) + planes(at[a:b])))
            columns = [pa.array(parts, pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary())]
            for k, (_, kind) in enumerate(meta):
                item = pa.int64() if kind == "i8" else pa.int32()
                columns.append(pa.array([[o[k] for o in own], *[None] * (len(parts) - 1)], pa.list_(item)))
            return pa.RecordBatch.from_arrays(columns, names=["part", "first", "n", "payload", *[name for name, _ in meta]])

        for batch in batches:
            for doc_id, row_key, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text, shingle)
                node = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view("i8"))
                own.append((doc_id, row_key, node, len(found), int(fingerprint(found).view("i8"))))
                keys.append(prefix(found, similarity, hot))
                total += len(keys[-1])
                if total > SENT or len(own) >= 1 << 16:
                    yield close()
                    number += len(own)
                    own, keys, total = [], [], 0
        if own:
            yield close()

    schema = "part int, first long, n int, payload binary, doc_id array<long>, row_key array<long>, node array<long>, size array<int>, fp array<long>"
    return materialise(docs.select("doc_id", "row_key", "text").mapInArrow(run, schema), "shingle-keys")


def _met(key: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, a, b, n) of rows sorted by key: how many keys documents a and b have in common (key -1), or members of a block beyond HOT (b -1)."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    some = np.repeat((size > 1) & (size <= HOT), size)
    k, d = key[some], doc[some]
    held_a, held_b, total = [], [], 0

    def counted() -> tuple:
        a, b = np.concatenate(held_a), np.concatenate(held_b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        return np.full(len(new), -1), low[new], high[new], np.diff(np.append(new, len(low)))

    for step in range(1, HOT):
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.empty(0, np.int64)
        if not len(same):
            break
        for at in range(0, len(same), PAIRS):
            s = same[at : at + PAIRS]
            s = s[d[s] != d[s + step]]
            held_a.append(d[s])
            held_b.append(d[s + step])
            total += len(s)
            if total >= PAIRS:
                yield counted()
                held_a, held_b, total = [], [], 0
    if total:
        yield counted()
    for g in np.flatnonzero(size > HOT):
        members = np.unique(doc[begin[g] : begin[g] + size[g]])
        if len(members) > 1:
            n = np.full(len(members) - 1, UNKNOWN)
            yield np.full(len(n), -1), np.full(len(n), members[0]), members[1:], n
            yield np.full(len(members), np.int64(key[begin[g]])), members, np.full(len(members), -1), np.zeros(len(members), np.int64)


def _meetings(sent: DataFrame, spark_ranges: int) -> DataFrame:
    """(key, a, b, n) as ``_met`` gives them, range by range; a written table."""

    def run(batches: Iterator) -> Iterator:
        part, keys, docs = None, [], []

        def close() -> Iterator:
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(key, kind="stable")
            for columns in _met(key[order].astype("<i8"), doc[order]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype("<i8")) for c in columns], names=["key", "a", "b", "n"])

        for batch in batches:
            for p, first, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and keys:
                    yield from close()
                    keys, docs = [], []
                part, raw = p, unpack(payload)
                keys.append(np.cumsum(from_planes(raw[: 8 * n], "<u8"), dtype="<u8"))
                docs.append(first + from_planes(raw[8 * n :], "<u4").astype(np.int64))
        if keys:
            yield from close()

    rows = sent.where("part >= 0").select("part", "first", "n", "payload").repartition(spark_ranges, "part").sortWithinPartitions("part")
    return materialise(rows.mapInArrow(run, "key long, a long, b long, n long"), "shingle-meetings")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: float, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that have at least that similarity; texts are fetched for those that stand in a pair."""
    pairs = materialise(pairs.distinct(), name)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = sets.select("node", "row_key").join(if_small(ends, 16), "node").groupBy("node").agg(F.min("row_key").alias("row_key"))
    wanted = materialise(wanted, f"{name}-rows")
    found = docs.select("row_key", "text").join(if_small(wanted, 32), "row_key").dropDuplicates(["node"])
    found = materialise(found.select("node", "text"), f"{name}-texts")
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator) -> Iterator:
        known: dict[int, np.ndarray] = {}  # a document of many pairs is cut into shingles once
        held = 0

        def members(node: int, text: str) -> np.ndarray:
            nonlocal held
            if node not in known:
                found = shingles(text, shingle)
                held += len(found)
                if held > REMEMBERED:
                    known.clear()
                    held = len(found)
                known[node] = found
            return known[node]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = members(a, x), members(b, y)
                common = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(common >= similarity * (len(u) + len(v) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialise(both.mapInArrow(run, "a long, b long"), f"{name}-links")


def _ringed(sets: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints are equal or within op4's 3 bits: chains, then the Hamming check."""
    nodes = sets.where("size > 0").select("node", "fp").distinct()
    heads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
    near = simhash.links(heads.select("fp"))
    head = lambda fp, c: heads.select(F.col("fp").alias(fp), F.col("head").alias(c))
    near = near.toDF("u", "v").join(head("u", "a"), "u").join(head("v", "b"), "v").select("a", "b")
    return near.union(nodes.join(heads, "fp").where("node <> head").select("head", "node"))


def _fits(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9


def _enough(c: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether prefixes with ``c`` common members leave the sets a chance (see above)."""
    shared = F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9)
    beyond = lambda size: F.ceil(F.lit(similarity) * size - 1e-9) - 1
    return _fits(n, m, similarity) & (c >= shared - F.greatest(beyond(n), beyond(m)))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, node, component_id (smallest doc_id reachable over links) per row of ``docs``.

    Documents link where the sets of their ``shingle``-word shingles have that Jaccard similarity; no link is missed.
    As in op5's grouping, a document of a block beyond HOT meets a few of its members first, and then those of other components only.
    Texts without words are equal to each other. Null ids link like others and are never a component's id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text", F.lit(1)).alias("row_key"), F.col("text").cast("string").alias("text"))
    n = ranges(docs.sparkSession)
    parts = max(n, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    sent = _sent(docs, shingle, similarity, _frequent(docs, shingle), parts)
    columns = ["doc_id", "row_key", "node", "size", "fp"]
    each = sent.where("part < 0").select("first", F.posexplode(F.arrays_zip(*columns)).alias("at", "one"))
    sets = materialise(each.select((F.col("first") + F.col("at")).alias("doc"), *[F.col(f"one.{c}").alias(c) for c in columns]), "shingle-sets")
    meetings = _meetings(sent, n)
    release(sent)
    of = lambda doc, node, size: if_small(sets.select(F.col("doc").alias(doc), F.col("node").alias(node), F.col("size").alias(size)), 40)
    pairs = meetings.where("key < 0").groupBy("a", "b").agg(F.sum("n").alias("common")).toDF("u", "v", "common")
    pairs = pairs.join(of("u", "a", "n"), "u").join(of("v", "b", "m"), "v").where("a <> b")
    pairs = pairs.where(_enough(F.col("common"), F.col("n"), F.col("m"), similarity)).select("a", "b").union(_ringed(sets))
    links = _verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets, docs, shingle, similarity, "document-pairs")
    roots = materialise(connected(links), "document-roots")
    hot = meetings.where("key >= 0").select("key", F.col("a").alias("u")).join(of("u", "node", "n"), "u").select("key", "node", "n").distinct()
    hot = materialise(hot, "document-hot")
    for step in range(STARS + 1):
        named = hot.join(if_small(roots, 32), "node", "left").select("key", F.col("node").alias("a"), "n", F.coalesce("root", "node").alias("root"))
        split = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
        rest = materialise(named.join(split, "key"), f"document-rest-{step}")
        if rest.isEmpty():
            break
        other = rest.select("key", F.struct(F.col("a").alias("b"), F.col("n").alias("m"), F.col("root").alias("other_root")).alias("one"))
        if step < STARS:  # another member of each block is met by those of other components
            other = other.groupBy("key").agg(F.min_by("one", F.xxhash64("key", "one.b", F.lit(step))).alias("one"))
        apart = F.col("root") < F.col("other_root") if step == STARS else F.col("root") != F.col("other_root")
        cross = rest.join(other.select("key", "one.*"), "key").where(apart & _fits(F.col("n"), F.col("m"), similarity))
        cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = links.union(_verified(cross, sets, docs, shingle, similarity, f"document-crosses-{step}"))
        roots = materialise(connected(links), f"document-components-{step}")
    least = sets.groupBy("node").agg(F.min("doc_id").alias("first"))
    classes = materialise(least.join(if_small(roots, 32), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "document-classes")
    classes = classes.join(classes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return sets.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id; null ids and all columns are kept."""
    first = near_duplicates(docs, shingle, similarity).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").select(docs.columns)
    return known.unionByName(docs.where("doc_id is null"))
