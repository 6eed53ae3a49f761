"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the features of a
text. It is fitted on a bounded sample of labelled rows and scores every row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed words; factors; labelled rows that a fit takes at most (the smallest by a hash of the id).
WORDS, FACTORS, FIT_ROWS = 1 << 16, 8, 12_000
#: Thresholds cut a statistic into so many indicator features.
CUTS = 12
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 6, np.uint8)  # 0 space, 1 symbol, 2 other punctuation, 3 digit, 4 upper, 5 lower, 6 beyond ASCII, 7 line end
_CLASS[:128] = 2
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 7
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 3, 4, 5
_CLASS[list(SYMBOLS)] = 1
_END = re.compile(r"[A-Za-zÀ-￿]$")
STATISTICS = 19


def statistics(text: str, words: list[str], n_chars: int | None) -> list[float]:
    """Structure of a text, each figure free of its length as far as may be, and how far off n_chars is."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    n = np.bincount(_CLASS[raw], minlength=8)
    chars, count = max(1, len(raw)), max(1, len(words))
    letters = max(1, n[4] + n[5] + n[6])
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    lengths = list(map(len, words))
    off = 0.0 if n_chars is None else min(5.0, abs(n_chars - len(text)) / max(1, len(text)))
    return [
        np.log1p(len(words)), sum(lengths) / count, max(lengths, default=0) ** 0.5,
        n[1] / chars, n[2] / chars, n[3] / chars, n[4] / letters, n[6] / letters,
        n[1] / count, n[2] / count, distinct / count, pairs / max(1, count - 1),
        len(lines) / count, len(set(lines)) / max(1, len(lines)), text.count("!") / count, text.count(" | ") / count,
        sum(map(str.isupper, words)) / count, sum(map(str.__eq__, words, words[1:])) / count, off,
    ]


_BUCKET: dict[str, int] = {}


def word_features(words: list[str]) -> np.ndarray:
    """Buckets of the distinct words, lower-cased."""
    known = _BUCKET
    if len(known) > 150_000:
        known.clear()
    out = set()
    for w in set(words):
        b = known.get(w)
        if b is None:
            b = known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
        out.add(b)
    return np.fromiter(out, np.int64, len(out))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, list[float]]:
    text = text or ""
    words = text.split()
    return word_features(words), statistics(text, words, n_chars)


class Machine:
    """Weights and factors of the words, then CUTS indicator features per statistic."""

    def __init__(self, cuts: np.ndarray, base: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = WORDS + STATISTICS * (CUTS + 1)
        self.cuts, self.bias, self.w, self.v = cuts, base, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))

    def rows(self, words: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of rows end to end, and where rows begin. The words of a row together weigh as
        much as one statistic, so a text's length does not count and rare words alone settle little."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0), np.zeros(0, np.int64)
        place = np.stack([np.searchsorted(self.cuts[s], stats[:, s], side="right") for s in range(STATISTICS)], axis=1)
        place += WORDS + np.arange(STATISTICS) * (CUTS + 1)
        n = np.fromiter(map(len, words), np.int64, len(words))
        idx = np.concatenate([x for pair in zip(words, place) for x in pair])
        starts = np.concatenate([[0], np.cumsum(n + STATISTICS)[:-1]])
        val = np.full(len(idx), 0.5)
        is_word = idx < WORDS
        val[is_word] = np.repeat(0.5 / np.sqrt(np.maximum(n, 1)), n)
        return idx, val, starts

    def logits(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0)
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def scores(self, words: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        z = self.logits(*self.rows(words, stats))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def fit(self, words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> None:
        """AdaGrad on the logistic loss with both classes weighing alike, rows in a seeded random order."""
        weigh = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        rng = np.random.default_rng(seed)
        g_w, g_v, g_b = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                idx, val, starts = self.rows([words[i] for i in some], stats[some])
                sizes = np.diff(np.append(starts, len(idx)))
                vx = self.v[idx] * val[:, None]
                sums = np.add.reduceat(vx, starts, axis=0)
                z = self.logits(idx, val, starts)
                err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[some]) * weigh[some] / len(some)
                each = np.repeat(err, sizes) * val
                of_v = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                used, inverse = np.unique(idx, return_inverse=True)
                d_w = np.bincount(inverse, each, len(used)) + decay * self.w[used]
                d_v = np.stack([np.bincount(inverse, of_v[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * self.v[used]
                g_w[used] += d_w * d_w
                g_v[used] += d_v * d_v
                self.w[used] -= rate * d_w / np.sqrt(g_w[used])
                self.v[used] -= 0.3 * rate * d_v / np.sqrt(g_v[used])
                g_b += err.sum() ** 2
                self.bias -= rate * err.sum() / np.sqrt(g_b)


def _ready(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Machine:
    """A machine for ``labels.quality``, from at most ``max_rows`` rows of ``labels`` whose crc32(doc_id) mod 5 is not 0.

    Null labels and ids teach nothing; an id labelled twice counts twice. With no rows, or one class only, the
    machine scores the share of label 1 (0.5 without rows), smoothed by one row of each class.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where("labelled is not null and quality in (0, 1) and crc32(cast(labelled as string)) % 5 <> 0")
    bounded = labels.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(max_rows)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            got = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([w.tolist() for w, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))], names=["doc_id", "quality", "words", "stats"])

    matched = _ready(docs).join(F.broadcast(bounded), F.col("doc_id") == F.col("labelled")).select("doc_id", "quality", "text", "n_chars")
    rows = matched.mapInArrow(run, "doc_id long, quality int, words array<int>, stats array<double>").toArrow()
    order = np.lexsort((rows.column("quality").to_numpy(), rows.column("doc_id").to_numpy())) if rows.num_rows else []
    labels_of = rows.column("quality").to_numpy()[order].astype(float) if rows.num_rows else np.empty(0)
    ones = (labels_of.sum() + 1) / (len(labels_of) + 2)
    if not 0 < labels_of.sum() < len(labels_of):
        flat = Machine(np.zeros((STATISTICS, CUTS)), float(np.log(ones / (1 - ones))))
        flat.v[:] = 0.0
        return flat
    flat = rows.column("words").combine_chunks()
    offsets = flat.offsets.to_numpy()
    flat = flat.values.to_numpy().astype(np.int64)
    words = [flat[offsets[i] : offsets[i + 1]] for i in order]
    stats = rows.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, STATISTICS)[order]
    cuts = np.quantile(stats, np.linspace(0, 1, CUTS + 2)[1:-1], axis=0).T.copy()
    machine = Machine(cuts, 0.0)
    machine.fit(words, stats, labels_of)
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 if score >= ``threshold``) of every row.

    Null and empty texts are scored by their (empty) structure; null ids are passed on; repeated rows get equal
    scores; an empty table gives an empty one; columns other than doc_id, text and n_chars are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.cuts, machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(batches: Iterator) -> Iterator:
        own = Machine.__new__(Machine)
        own.cuts, own.bias, own.w, own.v = shared.value
        for b in batches:
            ids, texts, n_chars = (b.column(c).to_pylist() for c in ("doc_id", "text", "n_chars"))
            words, stats, size = [], [], 0
            out = [np.empty(0)]
            for t, n in zip(texts, n_chars):
                w, s = features(t, n)
                words.append(w)
                stats.append(s)
                size += len(w)
                if size > 200_000:
                    out.append(own.scores(words, np.array(stats)))
                    words, stats, size = [], [], 0
            out.append(own.scores(words, np.array(stats).reshape(-1, STATISTICS)))
            got = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return _ready(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is under ``threshold``; every column stays.

    Rows are dropped where they are scored: they carry their other columns along as an Arrow batch, so no join
    is needed and rows without an id, or with a repeated one, are judged one by one.
    """
    machine = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((machine.cuts, machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    has_n = "n_chars" in docs.columns

    def run(batches: Iterator) -> Iterator:
        own = Machine.__new__(Machine)
        own.cuts, own.bias, own.w, own.v = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            n_chars = b.column("n_chars").to_pylist() if has_n else [None] * len(texts)
            keep = np.empty(len(texts), bool)
            for at in range(0, len(texts), 512):
                got = [features(t, n) for t, n in zip(texts[at : at + 512], n_chars[at : at + 512])]
                keep[at : at + len(got)] = own.scores([w for w, _ in got], np.array([s for _, s in got])) >= threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
