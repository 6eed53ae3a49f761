"""Packing into training sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised
groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .word_ids import encoded, encoder

#: Documents of a group, on average: enough for first-fit decreasing to fill bins, small enough for one task.
GROUP_DOCS = 4096


class Tournament:
    """The winner at each node is the largest capacity below it; the leftmost bin that fits is found top down."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put ``size`` into the first bin that has room and say which."""
        tree, at, leaves = self.tree, 1, self.leaves
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        found = at - leaves
        while at > 1:
            at //= 2
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a > b else b
        return found


def pack(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every id of every document lies in exactly one.

    A document longer than ``length`` first gives its full sequences. What remains of each document is placed
    whole, longest first, into the first sequence with room. Then the emptiest sequences are cut up to fill the
    gaps of the others, so that at most one is not full; that one is cut into powers of two, which need no padding.
    """
    full, rest = [], []
    for doc, size in enumerate(sizes):
        whole = size // length
        full += [[(doc, k * length, length)] for k in range(whole)]
        if size % length:
            rest.append((size % length, doc, whole * length))
    if not rest:
        return full
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins: list[list[tuple[int, int, int]]] = []
    tree = Tournament(len(rest), length)
    for size, doc, start in rest:
        b = tree.take(size)
        if b == len(bins):
            bins.append([])
        bins[b].append((doc, start, size))
    fill = [sum(n for *_, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    total = sum(fill)
    n_full = total // length
    keep, cut = order[:n_full], order[n_full:]
    loose = [piece for b in cut for piece in bins[b]]
    for b in keep:
        gap = length - fill[b]
        while gap:
            doc, start, n = loose.pop()
            if n > gap:
                loose.append((doc, start + gap, n - gap))
                n = gap
            bins[b].append((doc, start, n))
            gap -= n
    tail, left = [], total - n_full * length
    for bit in reversed(range(left.bit_length())):
        want = left & 1 << bit
        if want:
            tail.append([])
            while want:
                doc, start, n = loose.pop()
                if n > want:
                    loose.append((doc, start + want, n - want))
                    n = want
                tail[-1].append((doc, start, n))
                want -= n
    return full + [bins[b] for b in keep] + tail


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, path: str, end: int, length: int = 2048, seed: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids (binary).

    Documents are encoded where they are read and dealt at random (by a hash of id and text) into groups, whose
    number follows the number of documents. ids are little-endian, 2 bytes each where the vocabulary allows,
    else 4; ``keep_ids=False`` leaves them null. Null texts are empty (the end id alone), null ids are passed
    on, each repeated row is packed for itself, an empty table gives an empty one, other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_groups = max(1, -(-docs.count() // GROUP_DOCS))

    def tokens(batches: Iterator) -> Iterator:
        def out(some: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["doc_id", "ids"])

        some, size = [], 0
        for doc_id, ids in encoded(batches, path, end):
            some.append((doc_id, ids))
            size += len(ids)
            if size >= 8 << 20:
                yield out(some)
                some, size = [], 0
        if some:
            yield out(some)

    width = encoder(path, end).width

    def one(table: pa.Table) -> pa.Table:
        group, doc_ids = table.column("g")[0].as_py(), table.column("doc_id").to_pylist()
        data = table.column("ids").to_pylist()
        order = sorted(range(len(data)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0, data[i]))
        each = 2 if width == "<u2" else 4
        sizes = [len(data[i]) // each for i in order]
        columns: list[list] = [[] for _ in range(8)]
        for k, pieces in enumerate(pack(sizes, length)):
            at = 0
            for doc, start, n in pieces:
                ids = data[order[doc]][start * each : (start + n) * each]
                crc = zlib.crc32(np.frombuffer(ids, width).astype("<u4").tobytes())
                row = (doc_ids[order[doc]], start, n, crc, sizes[doc], group << 32 | k, at, ids if keep_ids else None)
                for c, v in zip(columns, row):
                    c.append(v)
                at += n
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table({n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)})

    coded = texts(docs).mapInArrow(tokens, "doc_id long, ids binary")
    dealt = coded.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.length("ids")), F.lit(n_groups)))
    return dealt.groupBy("g").applyInArrow(one, PIECES)
