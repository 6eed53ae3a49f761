"""Token-id store: ascending documents in shards, each a Re-Pair grammar of its ids.

File format, one container per shard (little-endian): magic ``RPR1``; six u32: terminals T, rules R, documents
D, symbols S, symbol width in bytes, and whether ids may be null; R rules as two u32 symbols; R expansion
lengths u32; D doc ids i64; D null flags u8; D symbol counts u32; D token counts u64; S symbols. Symbol
T + r stands for rule r. Rules refer to earlier symbols only, so lengths and expansions are found in one pass,
and a document is decoded from its own symbols alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, materialise, ranges, texts
from .pretokens import spread
from .word_ids import encoded, encoder

MAGIC = b"RPR1"
#: Characters of chunks that a worker remembers here: no other large memory stands beside it.
REMEMBER = 10_000_000
#: Ids in one shard; rounds of replacement; rules a round may add; a rule must stand for this many places.
SHARD_IDS, ROUNDS, ROUND_RULES, LEAST = 2 << 20, 4, 1024, 64


SLOTS = 18


def _keys_and_slots(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of neighbours a key that tells pairs apart, and the slot that counts it."""
    wide, half = (np.uint32, 16) if seq.dtype == np.uint16 else (np.uint64, 32)
    key = seq[:-1].astype(wide) << wide(half) | seq[1:]
    return key, _slots_of(key)


def compress(seq: np.ndarray, sizes: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, symbols of each document): frequent pairs inside documents become nonterminals, round by round.

    Pairs are counted in slots first; only those of heavy slots are counted one by one. No pair crosses the
    end of a document.
    """
    seq = seq.astype(np.uint16 if terminals + ROUNDS * ROUND_RULES <= 1 << 16 else np.uint32)
    half = 8 * seq.itemsize
    rules, sizes, made = [np.empty((0, 2), np.int64)], sizes.astype(np.int64), terminals
    for _ in range(ROUNDS):
        if len(seq) < 2 * LEAST:
            break
        ends = np.cumsum(sizes)
        edge = ends[:-1] - 1
        edge = edge[(edge >= 0) & (edge < len(seq) - 1)]
        key, slot = _keys_and_slots(seq)
        slot[edge] = 1 << SLOTS
        counts = np.bincount(slot, minlength=(1 << SLOTS) + 1)
        counts[1 << SLOTS] = 0
        least = max(LEAST, int(np.partition(counts, -ROUND_RULES)[-ROUND_RULES]))
        many = key[(counts >= least)[slot]]
        if not len(many):
            break
        many.sort()
        first = np.flatnonzero(np.concatenate([[True], many[1:] != many[:-1]]))
        n = np.diff(np.append(first, len(many)))
        order = np.argsort(-n, kind="stable")[:ROUND_RULES]
        order = order[n[order] >= LEAST]
        if not len(order):
            break
        keys = many[first[order]]
        rules.append(np.stack([keys >> keys.dtype.type(half), keys & keys.dtype.type((1 << half) - 1)], axis=1).astype(np.int64))
        own = _slots_of(keys)
        of_slot = np.full((1 << SLOTS) + 1, -1, np.int32)  # a slot leads to one rule; a pair that shares it waits for a later round
        of_slot[own[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        at = np.flatnonzero((of_slot >= 0)[slot])
        rule = of_slot[slot[at]]
        hit = key[at] == keys[rule]
        at, rule = at[hit], rule[hit]
        if len(at):  # of places that overlap, every other one from the left
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - start) % 2 == 0
            at, rule = at[take], rule[take]
            seq[at] = made + rule
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            seq = seq[stay]
            gone = np.searchsorted(at, ends)
            sizes = sizes - np.diff(gone, prepend=0)
        made += len(keys)
    return np.concatenate(rules), seq, sizes


def _slots_of(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return keys * np.uint32(2654435761) >> np.uint32(32 - SLOTS)
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)


def dump(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, terminals: int) -> bytes:
    rules, symbols, of_doc = compress(ids, sizes, terminals)
    lengths = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[terminals + k] = lengths[a] + lengths[b]
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    head = struct.pack("<6I", terminals, len(rules), len(doc_ids), len(symbols), width, 1)
    nulls = np.array([d is None for d in doc_ids], "u1")
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    parts = (rules.astype("<u4"), lengths[terminals:].astype("<u4"), numbers, nulls, of_doc.astype("<u4"), sizes.astype("<u8"), symbols.astype(f"<u{width}"))
    return MAGIC + head + b"".join(x.tobytes() for x in parts)


class Container:
    """A shard read back; ``document(k)`` decodes one document without the others."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair container")
        t, r, d, s, width, _ = struct.unpack_from("<6I", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules, lengths = take("<u4", 2 * r).reshape(-1, 2), take("<u4", r)
        numbers, nulls = take("<i8", d), take("u1", d)
        self.doc_ids = [None if n else v for v, n in zip(numbers.tolist(), nulls.tolist())]
        self.symbol_counts, self.sizes = take("<u4", d).astype(np.int64), take("<u8", d).astype(np.int64)
        self.symbols = take(f"<u{width}", s)
        self.lengths = np.concatenate([np.ones(t, np.int64), lengths.astype(np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.uint32)
        flat[:t] = np.arange(t)
        for k, (a, b) in enumerate(self.rules.tolist(), t):
            x, n = self.starts[k], self.lengths[a]
            flat[x : x + n] = flat[self.starts[a] : self.starts[a] + n]
            flat[x + n : x + self.lengths[k]] = flat[self.starts[b] : self.starts[b] + self.lengths[b]]
        self.flat = flat
        self.ends = np.cumsum(self.symbol_counts)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[symbols], self.lengths[symbols])]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.ends[k] - self.symbol_counts[k] : self.ends[k]])

    def documents(self, some: int = 1 << 18) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, expanded a quarter million symbols at a time."""
        k = 0
        while k < len(self.doc_ids):
            base = self.ends[k] - self.symbol_counts[k]
            to = max(k + 1, int(np.searchsorted(self.ends, base + some, side="right")))
            ids = self.expand(self.symbols[base : self.ends[to - 1]])
            at = 0
            for j in range(k, to):
                yield self.doc_ids[j], ids[at : at + self.sizes[j]]
                at += self.sizes[j]
            k = to


STORE = "shard long, part int, first_doc long, n_docs int, n_tokens long, container binary"


def write_store(docs: DataFrame, path: str, end: int, name: str = "token-store") -> DataFrame:
    """Write all documents' ids, each with the id ``end`` after it, in ascending doc_id; gives the written table.

    One row is one container. Shards ascend with their number. Null texts are empty (the end id alone), null
    ids come first, rows of equal id are ordered by text; an empty table gives no shard; other columns are
    ignored. Documents are dealt by ranges of doc_id, so no task holds more than its range.
    """
    ordered = texts(docs).repartitionByRange(ranges(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        part, k = TaskContext.get().partitionId(), 0
        doc_ids, chunks, total = [], [], 0
        tool = None

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(chunks), tool.width)
            sizes = np.fromiter((len(c) // ids.itemsize for c in chunks), np.int64, len(chunks))
            data = dump(doc_ids, ids, sizes, max(tool.library.get_vocab_size(True), end + 1))
            columns = [[part << 32 | k], [part], [doc_ids[0]], [len(doc_ids)], [len(ids)], [data]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "part", "first_doc", "n_docs", "n_tokens", "container"])

        for doc_id, data in encoded(batches, path, end, REMEMBER):
            tool = tool or encoder(path, end, REMEMBER)
            doc_ids.append(doc_id)
            chunks.append(data)
            total += len(data) // (2 if tool.width == "<u2" else 4)
            if total >= SHARD_IDS:
                yield close()
                doc_ids, chunks, total, k = [], [], 0, k + 1
        if doc_ids:
            yield close()

    return materialise(ordered.mapInArrow(run, STORE), name)


def read_store(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, decoded from the containers.

    start counts the ids of all documents before it: shard totals are summed part by part, so that only one
    row per part meets in one task.
    """
    sizes = store.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    at = sizes.select("part", "shard", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("inside"))
    at = at.join(before, "part").select("shard", (F.col("inside") + F.col("before")).alias("begin"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for data, begin in zip(batch.column("container"), batch.column("begin").to_pylist()):
                doc_ids, starts, n, crcs = [], [], [], []
                for doc_id, ids in Container(data.as_py()).documents():
                    doc_ids.append(doc_id)
                    starts.append(begin)
                    n.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4", copy=False).tobytes()))
                    begin += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts, n, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.select("shard", "container").join(if_small(at, 32), "shard").select("container", "begin").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
