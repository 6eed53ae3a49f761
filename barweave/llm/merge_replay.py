"""Byte-level BPE by replaying merges over the distinct words of the corpus.

Words lie end to end as linked tokens. An inverted index leads from a merge (by the rank of what it makes)
to the positions where its pair stands; ranks are taken smallest first and each merge is applied to all of
its positions at once, after which only the pairs with touched neighbours are ranked anew.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import answer_parts, finish_blocks, make_blocks, ranges, spread, word_numbers

NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file: token bytes by id, and for each pair of ids that some token is made of, that token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = pairs

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that joining a and b makes, NONE where they don't join."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)


@functools.cache
def load(path: str) -> Ranks:
    return Ranks(path)


def one_word(word: bytes, ranks: Ranks) -> list[int]:
    """Smallest rank first, leftmost first, for words where merges interleave: a heap over linked tokens, so a long word costs n log n."""
    ids, n = [ranks.ids[word[i : i + 1]] for i in range(len(word))], len(word)
    before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

    def meet(i: int, j: int) -> None:
        if i >= 0 and j < n and (made := ranks.pairs.get(ids[i] << 20 | ids[j])) is not None:
            heapq.heappush(heap, (made, i, ids[i], ids[j]))

    for i in range(n - 1):
        meet(i, i + 1)
    while heap:
        made, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of them has been merged since
        ids[i], ids[j], after[i] = made, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        meet(before[i], i)
        meet(i, after[i])
    return [x for x in ids if x >= 0]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids of all words end to end."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    if not lens.sum():
        return np.zeros(len(words), np.int64), np.empty(0, np.int32)
    token = ranks.byte[np.frombuffer(b"".join(words), "u1")]
    n = len(token)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(lens)
    some = lens > 0
    after[ends[some] - 1] = -1
    before[(ends - lens)[some]] = -1
    of_pair = np.full(n, NONE, np.int32)
    has = np.flatnonzero(after >= 0)
    of_pair[has] = ranks.rank(token[has], token[has + 1])
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []
    early: list[np.ndarray] = []

    def add(at: np.ndarray) -> None:
        r = of_pair[at]
        at, r = at[r != NONE], r[r != NONE]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
        for a, b in zip(cuts, cuts[1:]):
            k = int(r[a])
            if k not in index:
                heapq.heappush(heap, k)
            index[k].append(at[a:b])

    add(has)
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = np.unique(at[of_pair[at] == rank])
        if not len(at):
            continue
        if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():  # of pairs that share a token, every other one from the left
            first = np.concatenate([[True], ~chained])
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = after[at]
        right = after[gone]
        token[at] = rank
        of_pair[gone] = NONE
        token[gone] = -1
        after[at] = right
        inner = right >= 0
        before[right[inner]] = at[inner]
        of_pair[at] = NONE
        has_right = at[inner]
        of_pair[has_right] = ranks.rank(token[has_right], token[after[has_right]])
        left = before[at]
        left = left[left >= 0]
        of_pair[left] = ranks.rank(token[left], token[after[left]])
        touched = np.concatenate([has_right, left])
        if len(sooner := touched[of_pair[touched] < rank]):  # a smaller rank has come up inside these words
            early.append(sooner)
        add(touched)
    kept = token >= 0
    counts = np.add.reduceat(np.append(kept, False), np.minimum(ends - lens, n)).astype(np.int64) * some
    flat = token[kept]
    if early:
        again = np.unique(np.searchsorted(ends, np.concatenate(early), side="right"))
        starts = np.cumsum(counts) - counts
        chunks, last = [], 0
        for w in again.tolist():
            ids = one_word(words[w], ranks)
            chunks += [flat[last : starts[w]], np.array(ids, np.int32)]
            last = starts[w] + counts[w]
            counts[w] = len(ids)
        flat = np.concatenate([*chunks, flat[last:]])
    return counts, flat


def encode(docs: DataFrame, path: str, pattern: str, per_block, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts by the ranks at ``path``, handed block by block to ``per_block(doc_ids, ids, sizes)``.

    ``doc_ids`` is a list, ``ids`` the documents' token ids end to end (int64 array), ``sizes`` how many each
    document has; it returns an Arrow table of ``schema``. Null texts count as empty, null ids are passed on,
    repeated rows give repeated results, an empty table gives an empty one, other columns are ignored.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    blocks = make_blocks(docs, pattern, [], True, "merge-replay", max(6, ranges(docs.sparkSession) // 3))

    def solve(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return replay(words, load(path))

    def finish(row: dict, sizes: np.ndarray, values: np.ndarray) -> pa.Table:
        ids = word_numbers(row)
        starts = np.cumsum(sizes) - sizes
        each = sizes[ids]
        tokens = values[spread(starts[ids], each)]
        sums = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(row["sizes"])
        return per_block(row["doc_ids"], tokens, sums[ends] - sums[ends - row["sizes"]])

    return finish_blocks(blocks, answer_parts(blocks, solve, "<u4"), finish, schema, "<u4")


def decode(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(load(path).tokens.__getitem__, ids.tolist()))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row: the ids and what decoding them gives back."""

    def digest(doc_ids: list, tokens: np.ndarray, sizes: np.ndarray) -> pa.Table:
        of_ids, of_text, at = [], [], 0
        for n in sizes.tolist():
            ids = tokens[at : at + n]
            at += n
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_text.append(hashlib.sha256(decode(ids, path)).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_text})

    return encode(docs, path, pattern, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
