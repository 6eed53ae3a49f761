"""Pre-token blocks: documents packed with a local dictionary, so that corpus-wide work is done
once per distinct pre-token and messages between stages are per block instead of per occurrence."""

from __future__ import annotations

import functools
import itertools
import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from .common import materialise, ranges, rows, texts

#: Text bytes in one block; a longer document makes a block of its own.
BLOCK_BYTES = 32 << 20

#: Below this code point the regex library and the tokenizer libraries class characters alike (tested).
PLAIN_BELOW = 0x530
_RARE = regex.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")


@functools.cache
def _library_class(name: str) -> str:
    """The characters of a Unicode class as the tokenizer libraries know it, as a regex set."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    cut = pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "removed", invert=True)
    runs = []
    for _, (a, b) in cut.pre_tokenize_str(every):
        lo, hi = ord(every[a]), ord(every[b - 1])
        runs.append(f"\\U{lo:08X}-\\U{hi:08X}")
    return "".join(runs)


@functools.cache
def splitter(pattern: str, exact: bool) -> Callable[[str], list[str]]:
    """findall of the pattern; ``exact`` spells the classes out as the tokenizer libraries have them."""
    if exact:
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_library_class('L')}{_library_class('N')}]")
        pattern = inside.replace(r"\p{L}", f"[{_library_class('L')}]").replace(r"\p{N}", f"[{_library_class('N')}]")
    return regex.compile(pattern).findall


def split(pattern: str, text: str) -> list[str]:
    return splitter(pattern, _RARE.search(text) is not None)(text)


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on."""
    return np.ascontiguousarray(values.view("u1").reshape(-1, values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(data, "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def pack_words(words: list[str]) -> bytes:
    """Words as lengths and characters; any text may stand in a word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return pack(planes(np.fromiter(map(len, raw), "<u4", len(raw))) + b"".join(raw))


def unpack_words(data: bytes, n: int) -> list[bytes]:
    raw = unpack(data)
    ends = (4 * n + np.cumsum(from_planes(raw[: 4 * n], "<u4"))).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends)]


#: A block's most frequent words have the smallest numbers, which compress best.
OFTEN = 4096
BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, extra array<long>, sizes array<int>, ids binary, freqs binary, often array<int>, parts array<binary>, part_sizes array<int>"


def block_maker(pattern: str, special: list[str], n_parts: int, keep_order: bool) -> Callable[[Iterator], Iterator]:
    """For mapInArrow: documents to blocks.

    A block's dictionary numbers its pre-tokens part by part (crc32 of the word modulo ``n_parts``), so a
    part's answer slots in as a slice. ``keep_order`` keeps each document's sequence of word numbers, else
    (word number, frequency) pairs. ``special`` strings are cut out first and only counted (``extra``).
    """
    cut = regex.compile("|".join(map(regex.escape, special))).split if special else None

    def emit(docs: list, seen: dict[str, int]) -> pa.RecordBatch:
        per_doc = [(x, y) for _, x, y, _, _ in docs]
        parts: dict[int, list[str]] = defaultdict(list)
        for word in seen:
            parts[zlib.crc32(word.encode("utf-8", "surrogatepass")) % n_parts].append(word)
        ids = np.concatenate([x for x, _ in per_doc]) if seen else np.empty(0, "<u4")
        freqs = b"" if keep_order or not seen else np.concatenate([y for _, y in per_doc]).tobytes()
        often = np.argsort(-np.bincount(ids, minlength=len(seen)), kind="stable")[:OFTEN]
        place = dict.fromkeys(seen)
        at = 0
        for part in range(n_parts):
            parts[part].sort()
            for word in parts[part]:
                place[word] = at
                at += 1
        slot = np.fromiter(place.values(), "<u4", len(seen))
        new = slot + np.uint32(OFTEN)
        new[often] = np.arange(len(often))
        ids = new[ids]
        columns = [
            [random.getrandbits(62)], [[d for d, *_ in docs]], [[b for *_, b, _ in docs]], [[e for *_, e in docs]],
            [[len(x) for x, _ in per_doc]], [pack(planes(ids))], [pack(freqs)], [slot[often].tolist()],
            [[pack_words(parts[p]) if parts[p] else b"" for p in range(n_parts)]], [[len(parts[p]) for p in range(n_parts)]],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)

    def run(batches: Iterator) -> Iterator:
        docs, size, seen = [], 0, {}
        for doc_id, text in rows(batches):
            text = text or ""
            pieces = cut(text) if cut else [text]
            words = split(pattern, pieces[0]) if len(pieces) == 1 else [w for p in pieces for w in split(pattern, p)]
            freqs = None
            if not keep_order:
                words = Counter(words)
                freqs = np.fromiter(words.values(), "<u4", len(words))
            numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "<u4", len(words))
            n = len(text.encode("utf-8", "surrogatepass"))
            docs.append((doc_id, numbers, freqs, n, len(pieces) - 1))
            size += n
            if size >= BLOCK_BYTES:
                yield emit(docs, seen)
                docs, size, seen = [], 0, {}
        if docs:
            yield emit(docs, seen)

    return run


SCHEMA = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("freqs", pa.binary()), ("often", pa.list_(pa.int32())), ("parts", pa.list_(pa.binary())), ("part_sizes", pa.list_(pa.int32()))]
)


def make_blocks(docs: DataFrame, pattern: str, special: list[str], keep_order: bool, name: str, n_parts: int | None = None) -> DataFrame:
    n_parts = n_parts or ranges(docs.sparkSession)
    return materialise(texts(docs).mapInArrow(block_maker(pattern, special, n_parts, keep_order), BLOCKS), name)


def answer_parts(blocks: DataFrame, solve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], width: str) -> DataFrame:
    """(block, part, sizes, values): ``solve`` is called once for the distinct words of each part of the corpus.

    ``solve(words)`` gives for each word how many values it has, and the values end to end. A word stands at
    most once per block in a part, so no word is hot; a part holds its share of the distinct words only.
    """
    asked = blocks.selectExpr("block", "posexplode(arrays_zip(parts, part_sizes)) as (part, x)")
    asked = asked.selectExpr("block", "part", "x.parts as words", "x.part_sizes as n").where("n > 0")

    def one(table: pa.Table) -> pa.Table:
        where: dict[bytes, int] = {}
        wanted = []
        for data, n in zip(table.column("words").to_pylist(), table.column("n").to_pylist()):
            wanted.append(np.fromiter((where.setdefault(w, len(where)) for w in unpack_words(data, n)), np.int64, n))
        sizes, values = solve(list(where))
        starts = np.cumsum(sizes) - sizes
        out_sizes, out_values = [], []
        for w in wanted:
            out_sizes.append(pack(planes(sizes[w].astype("<u4"))))
            out_values.append(pack(planes(values[spread(starts[w], sizes[w])].astype(width))))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "sizes": pa.array(out_sizes, pa.binary()), "tokens": pa.array(out_values, pa.binary())})

    return asked.groupBy("part").applyInArrow(one, "block long, part int, sizes binary, tokens binary")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, end to end."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def finish_blocks(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str, width: str) -> DataFrame:
    """Bring each block's answers back to it; ``finish(row, sizes, values)`` gives the result's columns."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(right.column("part").to_pylist(), right.column("sizes").to_pylist(), right.column("tokens").to_pylist()))
        cat = lambda parts, kind: np.concatenate([from_planes(unpack(x), kind) for x in parts] or [np.empty(0, kind)])
        sizes, values = cat([s for _, s, _ in got], "<u4").astype(np.int64), cat([v for *_, v in got], width)
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        return finish(row, sizes, values)

    kept = blocks.drop("parts", "part_sizes")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)


def word_numbers(row: dict) -> np.ndarray:
    """The dictionary slots of a block's words, document by document."""
    ids = from_planes(unpack(row["ids"]), "<u4")
    slots = np.concatenate([np.array(row["often"], np.int64), np.zeros(OFTEN - len(row["often"]), np.int64)])
    return np.where(ids < OFTEN, slots[np.minimum(ids, OFTEN - 1)], ids.astype(np.int64) - OFTEN)
