"""Repeated passages by merging shard Burrows-Wheeler transforms.

Which strings can repeat at all is found first, losing none: a string of ``SPAN`` bytes is marked by the least
hash of its ``GRAM``-byte grams, equal strings have equal marks, and only strings whose mark stands in two
documents go on. They are dealt out by mark; equal ones of a block travel once, with their smallest doc_id.

What meets under a range of marks is put into shards. A shard's transform gives, for rows in the order of the
first h bytes after them, the symbol before each row; it is kept for every depth h that is needed. Shards are
merged by refining their interleave: rows in merged order at depth h, sorted stably by the symbol before them,
are the merged order at the next depth, for which the interleave and the shards' symbols suffice, not the
suffixes. Rows fall into one block as long as block and symbol are equal, so at depth ``SPAN`` the blocks are the
repeated intervals (common prefix of at least ``SPAN``), and each has its smallest doc_id.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, ranges
from .pretokens import from_planes, pack, planes, spread, unpack

#: Bytes of text in a block; bytes that are hashed at a time; length of the hashed grams.
BLOCK_BYTES, SLICE, GRAM = 8 << 20, 1 << 20, 24
#: Shards that are merged under one range of marks.
SHARDS = 4
#: Bits of a mark. Different grams of one mark only let more through; at 5.5 billion marks (30 GB) that are 5 in 1000.
MARK_BITS = 40
#: A range of marks takes so many bytes of text at most on average. Its strings are compared in up to SUB steps, as many as
#: hold STRINGS strings each.
RANGE_BYTES, SUB, STRINGS = 32 << 20, 64, 2_000_000
NO_DOC = np.int64(2**63 - 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte gram, put together from grams of half the length."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out, length, have, power = None, 1, 0, np.uint64(0x9E3779B97F4A7C15)
        while k:
            if k & 1:
                if out is None:
                    out, have = h, length
                else:
                    n = len(data) - have - length + 1
                    out = out[:n] * power + h[have : have + n]
                    have += length
            k >>= 1
            if k:
                n = len(h) - length
                h = h[:n] * power + h[length : length + n]
                length, power = 2 * length, power * power
        out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(27)


def marks(data: np.ndarray, span: int) -> np.ndarray:
    """For each string of ``span`` bytes the least hash of its grams, MARK_BITS bits of it, spread evenly again: minima are small."""
    h = gram_hashes(data, min(GRAM, span))
    width, have = span - min(GRAM, span) + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    with np.errstate(over="ignore"):
        return (h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - MARK_BITS)


def runs(data: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, mark) of runs of strings that start one after another and share a mark; none leaves its document."""
    ends = np.cumsum(sizes)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    for at in range(0, len(data) - span + 1, SLICE):
        piece = data[at : at + SLICE + span - 1]
        m = marks(piece, span)
        ok = np.ones(len(m), bool)
        near = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + len(m) + span, side="right") + 1]
        bad = (near[:, None] - np.arange(1, span)).ravel() - at
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
        v = np.flatnonzero(ok)
        if not len(v):
            continue
        m = m[v]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1] + 1) | (m[1:] != m[:-1])]))
        out.append((v[first] + at, np.diff(np.append(first, len(v))), m[first]))
    start, n, mark = (np.concatenate(x) for x in zip(*out))
    return start, n, mark


def shard_transform(symbols, rows: int, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The symbols before a shard's rows in the order of each depth, and the rows in the order of the last depth.

    ``symbols(t)`` gives for every row the symbol that its order at depth t is extended by.
    """
    order, before = np.arange(rows, dtype=np.int32), []
    for t in range(depth):
        b = symbols(t)[order]
        before.append(b)
        order = order[np.argsort(b, kind="stable")]
    return before, order


def merge_transforms(shards: list[list[np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (which shard each merged row comes from) at the last depth, and where its blocks begin."""
    sizes = [len(s[0]) for s in shards]
    n = sum(sizes)
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    begins = np.zeros(n, bool)
    begins[:1] = True
    symbols = np.empty(n, np.uint16)
    for t in range(depth):
        for s, shard in enumerate(shards):
            symbols[interleave == s] = shard[t]
        block = np.cumsum(begins, dtype=np.int32)
        order = np.argsort(symbols, kind="stable")
        interleave, block, ordered = interleave[order], block[order], symbols[order]
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = (ordered[1:] != ordered[:-1]) | (block[1:] != block[:-1])
    return interleave, begins


def least_docs(text: np.ndarray, at: np.ndarray, docs: np.ndarray, span: int) -> np.ndarray:
    """For strings of ``span`` bytes of ``text`` at ``at``, of documents ``docs``, the smallest of all equal strings."""
    if not len(at):
        return np.empty(0, np.int64)
    threes = text[:-2].astype(np.uint32) << 16 | text[1:-1].astype(np.uint32) << 8 | text[2:]
    seen = np.zeros(1 << 24, bool)
    seen[threes] = True
    if int(seen.sum()) <= 1 << 16:  # symbols of three bytes, numbered; else of two
        number = np.cumsum(seen, dtype=np.int32) - 1
        symbol, width = number[threes].astype(np.uint16), 3
    else:
        symbol, width = text[:-1].astype(np.uint16) << 8 | text[1:], 2
    del threes, seen
    places = [span - width * (t + 1) for t in range(span // width)]
    if span % width:
        places.append(0)  # the last symbol overlaps what is sorted already
    n_shards = max(1, min(SHARDS, len(at) // 1000))
    cuts = np.linspace(0, len(at), n_shards + 1).astype(int)
    transforms, orders = [], []
    for a, b in zip(cuts, cuts[1:]):
        before, order = shard_transform(lambda t, a=a, b=b: symbol[at[a:b] + places[t]], b - a, len(places))
        transforms.append(before)
        orders.append(order + a)
    interleave, begins = merge_transforms(transforms, len(places))
    rows = np.empty(len(at), np.int64)
    for s, order in enumerate(orders):
        rows[interleave == s] = order
    firsts = np.flatnonzero(begins)
    least = np.minimum.reduceat(docs[rows], firsts)
    out = np.empty(len(at), np.int64)
    out[rows] = np.repeat(least, np.diff(np.append(firsts, len(rows))))
    return out


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, doc_ids, sizes, data, rest): whole documents packed together, with their other columns."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator) -> Iterator:
        ids, chunks, rest, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=9).compress(b"".join(chunks))
            table = _ipc(pa.Table.from_batches(rest)) if other else b""
            columns = [[random.getrandbits(62)], [ids], [[len(c) for c in chunks]], [data], [pack(table)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["block", "doc_ids", "sizes", "data", "rest"])

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, add = at, 0
                while to < len(texts) and size + add < BLOCK_BYTES:
                    add += len(texts[to])
                    to += 1
                ids += batch.column("doc_id")[at:to].to_pylist()
                chunks += texts[at:to]
                if other:
                    rest.append(batch.select(other).slice(at, to - at))
                size, at = size + add, to
                if size >= BLOCK_BYTES:
                    yield close()
                    ids, chunks, rest, size = [], [], [], 0
        if ids:
            yield close()

    return materialise(docs.mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, data binary, rest binary"), "text-blocks")


def _text(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and doc_ids of a block; null ids count as larger than all others."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), "u1")
    ids = np.array([NO_DOC if d is None else d for d in row["doc_ids"]], np.int64)
    return data, np.array(row["sizes"], np.int64), ids


def _range_of(mark: np.ndarray, n: int) -> np.ndarray:
    return ((mark >> np.uint64(MARK_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _shared_marks(blocks: DataFrame, span: int, n: int) -> DataFrame:
    """(block, part, bits): which of a block's marks, in ascending order, stand in more than one document."""

    def ask(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                data, sizes, ids = _text(row)
                start, _, mark = runs(data, sizes, span)
                if not len(mark):
                    continue
                order = np.argsort(mark, kind="stable")
                doc = ids[np.searchsorted(np.cumsum(sizes), start, side="right")][order]
                mark = mark[order]
                first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
                many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                mark = mark[first]
                cuts = np.searchsorted(_range_of(mark, n), np.arange(n + 1))
                out = []
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        out.append((part, row["block"], int(b - a), planes(np.diff(mark[a:b], prepend=np.uint64(0))), np.packbits(many[a:b]).tobytes()))
                part, block, count, coded, flags = zip(*out)
                coded = [zstandard.ZstdCompressor(level=1).compress(c) for c in coded]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(count, pa.int32()), pa.array(coded, pa.binary()), pa.array(flags, pa.binary())], names=["part", "block", "n", "marks", "many"])

    def answer(table: pa.Table) -> pa.Table:
        counts = table.column("n").to_numpy()
        mark = np.concatenate([np.cumsum(from_planes(unpack(x), "<u8")) for x in table.column("marks").to_pylist()])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, "u1"), count=n) for x, n in zip(table.column("many").to_pylist(), counts)])
        order = np.argsort(mark, kind="stable")
        sorted_marks = mark[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_marks[1:] != sorted_marks[:-1]]))
        size = np.diff(np.append(first, len(mark)))
        shared = (size > 1) | (np.maximum.reduceat(many[order], first) > 0)
        flags = np.empty(len(mark), bool)
        flags[order] = np.repeat(shared, size)
        cuts = np.cumsum(counts)
        bits = [np.packbits(flags[b - n : b]).tobytes() for b, n in zip(cuts, counts)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "n": table.column("n"), "bits": pa.array(bits, pa.binary())})

    asked = blocks.select("block", "doc_ids", "sizes", "data").mapInArrow(ask, "part int, block long, n int, marks binary, many binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, n int, bits binary")


PIECES = "block long, part int, payload binary"


def _pieces(blocks: DataFrame, shared: DataFrame, span: int, n: int) -> DataFrame:
    """Per block and range of marks the distinct pieces that may repeat; under part -1 where they stand."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        data, sizes, ids = _text(row)
        start, count, mark = runs(data, sizes, span)
        got = sorted(zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("bits").to_pylist()))
        flags = np.concatenate([np.unpackbits(np.frombuffer(b, "u1"), count=k) for _, k, b in got] or [np.empty(0, "u1")]).astype(bool)
        known, inverse = np.unique(mark, return_inverse=True)
        keep = flags[inverse] if len(known) else np.empty(0, bool)
        start, count, mark = start[keep], count[keep], mark[keep]
        doc = ids[np.searchsorted(np.cumsum(sizes), start, side="right")]
        raw, seen = data.tobytes(), {}
        which = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), (start + count + span - 1).tolist())), np.int64, len(start))
        least = np.full(len(seen), NO_DOC, np.int64)
        np.minimum.at(least, which, doc)
        example = np.empty(len(seen), np.int64)
        example[which[::-1]] = np.arange(len(which))[::-1]
        step = _range_of(mark[example], n * SUB)
        order = np.argsort(step, kind="stable")
        step = step[order]
        place = np.empty(len(seen), np.int64)
        place[order] = np.arange(len(seen))
        pieces, lengths, least, part = list(seen), count[example][order], least[order], step // SUB
        u4 = lambda x: planes(np.asarray(x).astype("<u4"))
        head = lambda *k: np.array(k, "<u4").tobytes()
        state = head(len(start), len(seen)) + u4(np.diff(start, prepend=0)) + u4(count) + u4(place[which]) + u4(lengths) + u4(part) + planes(least.astype("<i8"))
        parts, payloads = [-1], [pack(state)]
        cuts = np.searchsorted(part, np.arange(n + 1))
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                body = b"".join(pieces[i] for i in order[a:b].tolist())
                parts.append(p)
                payloads.append(pack(head(b - a) + u4(lengths[a:b]) + planes(least[a:b].astype("<i8")) + (step[a:b] % SUB).astype("u1").tobytes() + body))
        del data, raw, seen, pieces, start, count, mark, known, inverse
        give_back()
        return pa.table({"block": pa.array([row["block"]] * len(parts), pa.int64()), "part": pa.array(parts, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return materialise(blocks.drop("rest").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(one, PIECES), "repeat-pieces")


def _verdicts(pieces: DataFrame, span: int) -> DataFrame:
    """(block, part, payload): for each string of the pieces sent, whether it stands in a smaller document than the block knew."""

    def compared(got: list[tuple]) -> list[np.ndarray]:
        """Of (lengths, documents, bytes) of each payload: whether a string stands in a smaller document."""
        seen: dict[bytes, int] = {}
        sent = []
        for count, _, raw in got:
            ends = np.cumsum(count + span - 1).tolist()
            sent.append(np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends)), np.int64, len(count)))
        text = np.frombuffer(b"".join(seen), "u1")
        count = np.fromiter(map(len, seen), np.int64, len(seen)) - (span - 1)
        least = np.full(len(seen), NO_DOC, np.int64)
        for numbers, (_, docs, _) in zip(sent, got):
            np.minimum.at(least, numbers, docs)
        begin = np.cumsum(count + span - 1) - (count + span - 1)
        strings = np.cumsum(count) - count
        found = least_docs(text, spread(begin, count), np.repeat(least, count), span)
        return [found[spread(strings[s], c)] < np.repeat(d, c) for s, (c, d, _) in zip(sent, got)]

    def opened(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, int]:
        """Lengths, documents and steps of a payload's pieces, the payload and where its bytes begin."""
        raw = unpack(payload)
        k = int(np.frombuffer(raw, "<u4", 1)[0])
        count, least = from_planes(raw[4 : 4 + 4 * k], "<u4").astype(np.int64), from_planes(raw[4 + 4 * k : 4 + 12 * k], "<i8")
        return count, least, np.frombuffer(raw, "u1", k, 4 + 12 * k), raw, 4 + 13 * k

    def one(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        of_step = np.zeros(SUB, np.int64)
        for payload in payloads:
            count, _, step, _, _ = opened(payload)
            np.add.at(of_step, step, count)
        cuts = [0]
        for s in range(1, SUB):
            if of_step[cuts[-1] : s + 1].sum() > STRINGS:
                cuts.append(s)
        bits: list[list[np.ndarray]] = [[] for _ in payloads]
        for low, high in zip(cuts, [*cuts[1:], SUB]):
            got = []
            for payload in payloads:
                count, least, step, raw, at = opened(payload)
                a, b = np.searchsorted(step, [low, high])
                ends = np.concatenate([[0], np.cumsum(count + span - 1)])
                got.append((count[a:b], least[a:b], raw[at + ends[a] : at + ends[b]]))
                del raw
            for mine, more in zip(bits, compared(got)):
                mine.append(more)
            del got
            give_back()
        payload = [np.packbits(np.concatenate(x)).tobytes() for x in bits]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "payload": pa.array(payload, pa.binary())})

    return pieces.where("part >= 0").groupBy("part").applyInArrow(one, PIECES)


def find_repeats(docs: DataFrame, span: int = 50, as_text: bool = False) -> DataFrame:
    """``docs`` with kept (the bytes that stay; with ``as_text`` text, without broken characters), n_bytes, n_removed and n_spans instead of text.

    A byte of a text's UTF-8 goes if a string of ``span`` bytes that covers it also starts in a document with a
    smaller doc_id. All strings are judged on the input; none crosses documents. Null texts are empty; rows of
    equal doc_id are not smaller than one another; null ids count as larger than any other; an empty table
    gives an empty one. Other columns are passed on, but for the four names added here.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans")])
    blocks = _blocks(docs)
    size = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (total, x) -> total + x)"))).first()[0] or 0
    n = max(ranges(docs.sparkSession), -(-size // RANGE_BYTES))
    pieces = _pieces(blocks, _shared_marks(blocks, span, n), span, n)
    told = pieces.where("part < 0").unionByName(_verdicts(pieces, span))
    other = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        data, sizes, ids = _text(row)
        got = dict(zip(right.column("part").to_pylist(), right.column("payload").to_pylist()))
        raw = unpack(got.pop(-1))
        r, k = (int(x) for x in np.frombuffer(raw, "<u4", 2))
        at = 8

        def take(m: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = from_planes(raw[at : at + m * np.dtype(kind).itemsize], kind)
            at += m * np.dtype(kind).itemsize
            return out.astype(np.int64)

        start, count, which, lengths, part, least = np.cumsum(take(r)), take(r), take(r), take(k), take(k), take(k, "<i8")
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, start, side="right")
        strings = np.cumsum(lengths) - lengths
        of_part = np.bincount(part, lengths).astype(np.int64) if k else []
        bits = np.concatenate([np.empty(0, "u1"), *(np.unpackbits(np.frombuffer(got[p], "u1"), count=c) for p, c in enumerate(of_part) if c)])
        hit = bits[spread(strings[which], count)].astype(bool) | np.repeat(ids[doc] > least[which], count)
        starts = spread(start, count)[hit]
        of = np.searchsorted(ends, starts, side="right")
        first, last = np.searchsorted(of, np.arange(len(sizes))), np.searchsorted(of, np.arange(len(sizes)), side="right")
        kept, n_removed, n_spans = [], [], []
        whole = data.tobytes()
        for d, (a, b, end, size) in enumerate(zip(first.tolist(), last.tolist(), ends.tolist(), sizes.tolist())):
            begin = end - size
            if a == b:
                kept.append(whole[begin:end])
                n_removed.append(0)
                n_spans.append(0)
                continue
            s = starts[a:b]
            cut = np.flatnonzero(np.diff(s) > span) + 1  # spans that touch are one run
            lo, hi = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])] + span
            edges = [begin, *np.stack([lo, hi], axis=1).ravel().tolist(), end]
            kept.append(b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2])))
            n_removed.append(int((hi - lo).sum()))
            n_spans.append(len(lo))
        columns = {"doc_id": pa.array(row["doc_ids"], pa.int64())}
        if other:
            rest = pa.ipc.open_stream(unpack(row["rest"])).read_all()
            columns |= {f.name: rest.column(f.name) for f in other}
        left = {"text": pa.array([x.decode("utf-8", "ignore") for x in kept])} if as_text else {"kept": pa.array(kept, pa.binary())}
        return pa.table(columns | left | {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64())})

    schema = ", ".join(["doc_id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in other], "text string" if as_text else "kept binary", "n_bytes long, n_removed long, n_spans long"])
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def drop_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text (a character that loses a byte goes whole); all columns stay.

    The rules for nulls, ties and empty texts are those of ``find_repeats``; a null text becomes an empty one.
    """
    return find_repeats(docs, span, as_text=True).select(docs.columns)
