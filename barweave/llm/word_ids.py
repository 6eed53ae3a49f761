"""Token ids by the tokenizers library, once per distinct chunk between white space.

Where the file's pre-tokenizer drops white space and never joins across it, a text's ids are its chunks' ids
end to end; chunks are handed to the library once and remembered per worker. Other files go through whole.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import json
import os
from collections.abc import Iterator

import numpy as np
import regex

#: Chunks a worker remembers, counted in characters; later ones are encoded whenever they come up.
REMEMBER = 6_000_000
#: Pre-tokens a worker remembers beside its chunks.
PIECES = 250_000
#: Below U+0300 lower-casing goes by single characters, NFC changes nothing, and the pattern's classes agree.
_PLAIN = regex.compile(r"[\x00-\u02ff]*").fullmatch
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD = "\x1c\x1d\x1e\x1f"  # white space to str.split alone
_SPACE = regex.compile(r"\s+")


def _drops_space(spec: dict) -> bool:
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    pattern = (first.get("pattern") or {}).get("Regex", "") if first.get("type") == "Split" else ""
    names = {x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])}
    added = [t["content"] for t in spec.get("added_tokens", []) if _SPACE.search(t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    rest_plain = all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
    return pattern == _PIECES and spec.get("model", {}).get("end_of_word_suffix") and first.get("behavior") == "Removed" and bool(first.get("invert")) and rest_plain and names <= {"NFC", "Replace", "Lowercase"} and not added


class Encoder:
    def __init__(self, path: str, end: int, remember: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.by_chunk = _drops_space(spec)
        self.width = "<u2" if max(self.library.get_vocab_size(True), end + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end], self.width).tobytes()
        names = self.library.get_vocab(True)
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile(_PIECES).findall
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.room = REMEMBER if remember is None else remember

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pre-tokens: many go through the library as one text and come apart where a word ends."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                out += self._encode(some)
                continue
            raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _cut(self, chunk: str) -> list[str] | None:
        """The pre-tokens of a chunk, None where cutting it here is not safe. Words and words with a full stop
        or comma after them need no pattern."""
        if not chunk.isascii() and _PLAIN(chunk) is None or "<" in chunk and any(a in chunk for a in self.added):
            return None
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.cut(chunk)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space, by their pre-tokens, of which as many are remembered."""
        cuts = list(map(self._cut, chunks))
        known = self.pieces
        if len(known) > PIECES:
            known.clear()
        new = [y for y in {y for c in cuts if c for y in c} if y not in known]
        known.update(zip(new, self._pieces(new)))
        rest = [x for x, c in zip(chunks, cuts) if c is None]
        of_rest = iter(self._encode(rest) if rest else ())
        get = known.__getitem__
        return [next(of_rest) if c is None else get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cuts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id, as little-endian bytes of ``width``. A null text counts as empty."""
        with _no_collection():
            return self._texts(texts)

    def _texts(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_chunk:
            return [x + self.end for x in self._encode([t or "" for t in texts])]
        known, chunks, new = self.known, [], set()
        for t in texts:
            t = t or ""
            got = [x for x in _SPACE.split(t) if x] if any(c in t for c in _ODD) else t.split()
            chunks.append(got)
            new.update(got)
        fresh = list(new.difference(known))
        extra = dict(zip(fresh, self._chunks(fresh))) if fresh else {}
        known.update(extra)
        out = [b"".join(map(known.__getitem__, c)) + self.end for c in chunks]
        if self.room > 0:
            self.room -= sum(map(len, fresh))
        else:  # there is room for no more
            for x in fresh:
                del known[x]
        return out


@functools.cache
def encoder(path: str, end: int, remember: int | None = None) -> Encoder:
    return Encoder(path, end, remember)


@contextlib.contextmanager
def _no_collection() -> Iterator[None]:
    """Millions of short-lived lists, none in a cycle: the cycle collector would only walk the memories again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encoded(batches: Iterator, path: str, end: int, remember: int | None = None, some: int = 4 << 20) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of the rows of Arrow batches, a few megabytes of text at a time."""
    from .common import rows

    ids, texts, size = [], [], 0
    for doc_id, text in rows(batches):
        ids.append(doc_id)
        texts.append(text)
        size += len(text or "")
        if size >= some:
            yield from zip(ids, encoder(path, end, remember).encode(texts))
            ids, texts, size = [], [], 0
    if ids:
        yield from zip(ids, encoder(path, end, remember).encode(texts))
