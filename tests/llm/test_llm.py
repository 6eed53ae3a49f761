"""The training-data operators against brute force, on small tables with every kind of odd row."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barweave.llm import common, components, host_rules, line_dedup, merge_replay, neighbours, packing, pretokens, quality_fm, repair_store, repeats, simhash, token_counts, word_ids

BYTE, WORD, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
#: Extra columns, some with names the operators use inside.
COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, fp long, key long, block long, root long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    long = words(rng, 400)
    texts = [words(rng, rng.randint(5, 80)) for _ in range(30)]
    passage = words(rng, 25)
    texts += [None, "", " \n\t ", "a", "é ö 漢字 한국 ﷽ 🙂 \x1c\x1d x", "<|endoftext|>hi<|startoftext|> there's", "x" * 300, long, long, long[:-30] + " z", "don't WE'LL 12345 ...!!! ", "՘֋ ́a"]
    texts += [words(rng, 12) + "\n" + passage + "\n" + words(rng, 9) for _ in range(5)]
    texts += ["same line of many words here\n" * 3 + words(rng, 20), "Same line, of many words here!\nother words follow in this line"]
    rows = [(i * 7 % 101, t, f"s{i % 3}" if i % 5 else None, "en", i, i, i, i, i) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "null id and its own few words", "s1", None, None, 1, 1, 1, 1), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def pairs(rows=None):
    return [(r[0], r[1]) for r in rows or corpus()]


def bag(rows):
    return sorted(map(repr, rows))


# pre-tokens, counts, merges


def test_splitting_agrees_with_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(1)
    for lo in (0, 0x500, 0x2000, 0xA000, 0x1F000):
        text = "".join(rng.choice(every[lo : lo + 0x800]) + rng.choice(["", " ", "a", "1", "  "]) for _ in range(400))
        got = pretokens.split(token_counts.BYTE_LEVEL, text)
        assert "".join(got) == text
        assert len(got) == len(tok.pre_tokenizer.pre_tokenize_str(text))


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(docs, BYTE, limit=50).collect()
    want = []
    for d, t in pairs():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 50))
    assert bag(tuple(r) for r in got) == bag(want)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=12))
def test_replay_is_byte_pair_encoding(some):
    ranks = merge_replay.load(RANKS)
    sizes, flat = merge_replay.replay(some, ranks)
    at = 0
    for word, n in zip(some, sizes.tolist()):
        assert flat[at : at + n].tolist() == merge_replay.one_word(word, ranks)
        at += n


def test_replay_merges_that_interleave():
    class Toy(merge_replay.Ranks):
        def __init__(self, tokens):
            self.ids = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
            made = {a << 20 | b: i for t, i in self.ids.items() for k in range(1, len(t)) if (a := self.ids.get(t[:k])) is not None and (b := self.ids.get(t[k:])) is not None}
            keys = np.array(list(made), np.int64)
            order = np.argsort(keys)
            self.keys, self.made, self.pairs = keys[order], np.array(list(made.values()), np.int32)[order], made
            self.byte = np.arange(256, dtype=np.int32)

    ranks = Toy([b"abc", b"ca", b"ab", b"aa", b"abab", b"aaa"])
    some = [bytes(random.Random(i).choices(b"abc", k=9)) for i in range(300)] + [b"aaaaaaa", b"abcabc"]
    sizes, flat = merge_replay.replay(some, ranks)
    ends = np.cumsum(sizes)
    for word, a, b in zip(some, ends - sizes, ends):
        assert flat[a:b].tolist() == merge_replay.one_word(word, ranks)


def test_merge_replay(docs, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in pairs():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(tuple(r) for r in merge_replay.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()) == bag(want)
    assert merge_replay.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ids, store, packing


def whole_ids(text, end):
    from tokenizers import Tokenizer

    if not hasattr(whole_ids, "tok"):
        whole_ids.tok = Tokenizer.from_file(WORD)
    return [*whole_ids.tok.encode(text or "", add_special_tokens=False).ids, end]


def test_chunked_encoding_is_the_library(monkeypatch):
    rng = random.Random(2)
    chars = [chr(c) for c in (*range(9, 14), *range(28, 0x300), 0x301, 0x3A3, 0x3C3, 0x4E00, 0x130, 0x212A, 0xA0, 0x2003, 0x200B, 0x1F600)]
    texts = [t for _, t in pairs()] + ["".join(rng.choices(chars, k=60)) for _ in range(300)] + ["ΟΔΟΣ ΟΔΟΣ. ſt İx <|endoftext|>a<|endoftext|>"]
    for remember, pieces in ((10**6, 10**6), (50, 20)):
        monkeypatch.setattr(word_ids, "REMEMBER", remember)
        monkeypatch.setattr(word_ids, "PIECES", pieces)
        enc = word_ids.Encoder(WORD, 2)
        assert enc.by_chunk
        for some in (texts[:60], texts[40:], texts):
            for t, got in zip(some, enc.encode(some)):
                assert np.frombuffer(got, "<u2").tolist() == whole_ids(t, 2), t


def test_store(docs, empty):
    store = repair_store.write_store(docs, WORD, end=2)
    got = {}
    rows = repair_store.read_store(store).collect()
    order = sorted(((d, t) for d, t in pairs()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at, want = 0, []
    for d, t in order:
        ids = np.array(whole_ids(t, 2), "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert bag(tuple(r) for r in rows) == bag(want)
    for row in store.collect():
        box = repair_store.Container(bytes(row.container))
        for k, (_, ids) in enumerate(box.documents(50)):
            assert box.document(k).tolist() == ids.tolist()
            got[k] = ids
    assert repair_store.read_store(repair_store.write_store(empty, WORD, end=2)).count() == 0
    with pytest.raises(ValueError):
        repair_store.Container(b"nope")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=300), min_size=1, max_size=6), st.sampled_from([4, 70000]))
def test_grammar_round_trip(lists, terminals):
    ids = np.array([x for part in lists for x in part], np.uint32)
    box = repair_store.Container(repair_store.dump(list(range(len(lists))), ids, np.array([len(x) for x in lists]), terminals))
    assert [x.tolist() for _, x in box.documents()] == lists
    assert len(box.symbols) <= len(ids)


def test_grammar_compresses():
    ids = np.tile(np.arange(20, dtype=np.uint32), 500)
    rules, symbols, _ = repair_store.compress(ids, np.array([len(ids)]), 20)
    assert len(rules) and len(symbols) < len(ids) / 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packing_is_whole_and_tight(sizes):
    got = packing.pack(sizes, 16)
    seen = defaultdict(list)
    for seq in got:
        n = sum(x[2] for x in seq)
        assert n == 16 or n & (n - 1) == 0 and n < 16
        for doc, start, k in seq:
            seen[doc].append((start, k))
    for doc, size in enumerate(sizes):
        at = 0
        for start, k in sorted(seen[doc]):
            assert start == at and k > 0
            at += k
        assert at == size


def test_tournament_is_first_fit():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
    tree, bins = packing.Tournament(200, 100), []
    for s in sizes:
        first = next((i for i, room in enumerate(bins) if room >= s), len(bins))
        assert tree.take(s) == first
        if first == len(bins):
            bins.append(100)
        bins[first] -= s


def test_packed_documents(docs, empty):
    rows = packing.pack_documents(docs, WORD, end=1, length=64).collect()
    total = sum(len(whole_ids(t, 1)) for _, t in pairs())
    assert sum(r.length for r in rows) == total
    by_seq = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    ids = {d: t for d, t in pairs() if d is not None}
    for d in (0, 7, 14):
        mine = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start))
        assert np.frombuffer(mine, "<u2").tolist() == whole_ids(ids[d], 1)
    assert packing.pack_documents(empty, WORD, end=1).count() == 0


# rules


def test_host_rules(spark, docs, empty):
    rows = host_rules.judge(docs).collect()
    import re

    def base(t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = defaultdict(list)
        for i in range(len(ws) - 4):
            seen[tuple(ws[i : i + 5])].append(i)
        rep = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(ws) < 10 or 100 * len(rep) > 20 * len(ws)
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed

    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == bag((d, *base(t)) for d, t in pairs())
    assert all(r.kept != r.base_failed or r.host_rate > 0.5 for r in rows)
    assert host_rules.judge(empty).count() == 0
    bad = spark.createDataFrame([(i, "few words", "bad") for i in range(60)] + [(100, words(random.Random(1), 30), "bad")] + [(200 + i, words(random.Random(i), 30), "good") for i in range(60)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judge(bad).collect()}
    assert not kept[100] and kept[205]
    plan = host_rules.measure(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# near duplicates


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(fps, bits=3):
    ids = sorted(fps)
    parent = {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in ids}


def test_pigeonring_loses_no_link(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a, 12)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = brute_classes(fps)
    unsigned = lambda x: x % (1 << 64)
    for group in (4096, 20):
        monkeypatch.setattr(simhash, "GROUP", group)
        links = [(unsigned(a), unsigned(b)) for a, b in simhash.links(df).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {x: find(x) for x in fps} == want


def test_too_large_groups_are_dealt_out_again():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 20, 3000).astype("<u8"))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fps), "<i8")), pa.array(fps.view("<i8"))], names=["key", "fp"])
    out = list(simhash._compare(True)(iter([batch, batch])))
    assert sum(b.num_rows for b in out) == 2 * len(fps) and out[0].column(0).null_count == 0


def test_near_duplicates(docs, empty):
    import re

    def fp(t, n=3):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not ws:
            return 0
        sh = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = simhash.near_duplicates(docs, shingle=3).collect()
    marked = [(d, fp(t)) for d, t in pairs()]
    classes = brute_classes({f for _, f in marked})
    least = defaultdict(lambda: math.inf)
    for d, f in marked:
        if d is not None:
            least[classes[f]] = min(least[classes[f]], d)
    want = [(d, f, None if least[classes[f]] == math.inf else least[classes[f]]) for d, f in marked]
    assert bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == bag(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs, shingle=3)
    assert kept.columns == docs.columns
    first = {c for _, _, c in want if c is not None}
    assert bag(r.doc_id for r in kept.collect()) == bag(d for d, _, c in want if d is None or d in first)


@pytest.mark.parametrize("hot", [256, 2])
def test_documents_alike_by_shingles(spark, empty, monkeypatch, hot):
    import corpus_pipeline
    from barweave.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(12)
    notice = words(rng, 40).split()
    rows = [(None, "null id"), (900, None), (901, ""), (902, "few words"), (903, "Few  words")]
    for k in range(12):
        text = words(rng, rng.randint(60, 300)).split() + notice
        for i in range(5):
            changed = list(text)
            for _ in range(i * rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = "other"
            rows.append((k * 10 + i, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = []
    for d, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    root = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if alike(x, y):
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = bag(d for i, (d, _) in enumerate(rows) if d is None or d == least[root[i]])
    got = bag(r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, "").collect())
    assert got == want and len(want) < len(rows) - 20
    assert jaccard.keep_first(empty).count() == 0


def test_shingles_are_sent_once(spark, docs, monkeypatch):
    """However many shingles are frequent, their keys are written once, and only pairs that share enough of them are fetched."""
    from barweave.llm import jaccard

    written = []
    plain = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    monkeypatch.setattr(jaccard, "HOT", 2)
    rng = random.Random(6)
    shared = words(rng, 30)
    rows = [(i, words(rng, 200) + " " + shared) for i in range(40)] + [(100, words(random.Random(6), 30))]
    rows += [(50 + i, rows[i][1].replace(" ", " new ", 1)) for i in range(3)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id != r.component_id} == {50: 0, 51: 1, 52: 2}
    names = [name for name, _ in written]
    assert len(names) == len(set(names)) and "shingle-keys" in names
    pairs = next(df for name, df in written if name == "document-pairs")
    assert pairs.count() < 200


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(0, 12), st.integers(0, 12))
def test_prefixes_of_alike_sets_have_enough_in_common(seed, both, left, right):
    from barweave.llm import jaccard

    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, both + left + right).astype("<u8"))
    rng.shuffle(h)
    x, y, hot = np.sort(h[: both + left]), np.sort(np.concatenate([h[:both], h[both + left :]])), np.sort(h[::3])
    if both >= 0.8 * len(h):
        c = len(np.intersect1d(jaccard.prefix(x, 0.8, hot), jaccard.prefix(y, 0.8, hot)))
        n, m = len(x), len(y)
        beyond = max(math.ceil(0.8 * n - 1e-9), math.ceil(0.8 * m - 1e-9)) - 1
        assert c >= 1 and c >= math.ceil(0.8 / 1.8 * (n + m) - 1e-9) - beyond


def test_fingerprints_bring_document_pairs(spark, monkeypatch):
    """Documents within 3 bits are candidates by op4's chains, whatever the shingles' filter finds."""
    from barweave.llm import jaccard

    rows = [(10, 5, 0), (20, 5, 7), (30, 5, 15), (40, 5, 0), (50, 0, 0)]
    got = jaccard._ringed(spark.createDataFrame(rows, "node long, size int, fp long")).collect()
    assert {frozenset(r) for r in got} == {frozenset(p) for p in ((10, 20), (20, 30), (10, 40))}
    monkeypatch.setattr(jaccard, "_enough", lambda *_: F.lit(False))
    text = words(random.Random(3), 3000)
    near = spark.createDataFrame([(1, text), (2, text.replace(" ", " new ", 1)), (3, words(random.Random(4), 3000))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(near).collect()} == {1: 1, 2: 1, 3: 3}


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs, min_words=5)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    texts = defaultdict(list)
    for d, t in pairs():
        texts[d].append(t)
    for r in rows:
        if r.text is not None and r.n_dropped == 0:
            assert r.text in texts[r.doc_id]
        assert (r.text is None) == (r.n_lines == 0)
    lines = [line for r in rows if r.text for line in r.text.split("\n")]
    alike = [x for x in lines if x.lower().startswith("same line")]
    assert len(alike) == 1
    passages = [x for x in lines if x in set(corpus()[42][1].split("\n")[1:2])]
    assert len(passages) == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_merges(word, ranks):
    parts = [ranks.ids[word[i : i + 1]] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.pairs.get(a << 20 | b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == math.inf:
            break
        parts[at : at + 2] = [best]
    return parts


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text("aeinst ", max_size=80).map(str.encode))
def test_one_word_against_its_definition(word):
    ranks = merge_replay.load(RANKS)
    assert list(map(int, merge_replay.one_word(word, ranks))) == list(map(int, plain_merges(word, ranks)))


def test_a_word_of_a_million_letters():
    assert sum(len(merge_replay.load(RANKS).ids) > 0 for _ in merge_replay.one_word(b"ab" * 500_000, merge_replay.load(RANKS))) > 1


def brute_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40), st.integers(0, 40))
def test_edit_distances(x, y, most):
    got, want = line_dedup.distance(x, y, most), brute_distance(x, y)
    assert got == want or got > most < want
    x, y = " ".join(x.split()), " ".join(y.split())
    assert line_dedup.alike(x, y, 0.8) == (brute_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9)


def test_very_long_lines_by_edit_distance():
    """Beyond LONG_LINE as below: one letter in every word, a word parted, the same words in another order."""
    rng = random.Random(31)
    line = [words(rng, 1) + words(rng, 1) for _ in range(9700)]
    x = " ".join(line)
    assert len(x) > line_dedup.LONG_LINE
    assert line_dedup.alike(x, " ".join(w[:2] + "q" + w[3:] for w in line), 0.8)
    assert line_dedup.alike(x, x.replace(line[50], line[50][:1] + " " + line[50][1:]), 0.8)
    assert not line_dedup.alike(x, " ".join(sorted(line)), 0.8)
    assert not line_dedup.alike(x, "z" * len(x), 0.8)


def test_groups_of_lines_against_all_pairs(spark):
    """Every pair of real lines of up to 200 characters that is alike ends in one group, but for 3 in 100."""
    import os

    path = os.environ.get("LINES_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet"
    df = spark.read.parquet(path).select("doc_id", "text")
    lines = {(r.doc_id, i): " ".join(line_dedup.normal(x).split()) for r in df.collect() for i, x in enumerate((r.text or "").split("\n"))}
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    texts = sorted({t for t in lines.values() if len(t.split()) >= 5 and len(t) <= 200}, key=len)
    links = [(x, y) for i, x in enumerate(texts) for y in itertools.takewhile(lambda y: len(x) >= 0.8 * len(y), texts[i + 1 :]) if len(set(x) ^ set(y)) < 12 and line_dedup.alike(x, y, 0.8)]
    left = defaultdict(int)
    for t in kept.values():
        for x in (t or "").split("\n"):
            left[" ".join(line_dedup.normal(x).split())] += 1
    both = sum(left[x] + left[y] > 1 for x, y in links)
    assert max((left[t] for t in lines.values() if t), default=0) <= 1 and len(links) > 5 and both <= 0.03 * len(links) + 1


def test_alike_lines_meet(spark):
    """Lines with a letter changed, a word put in or letters changed in a fifth of the words, against edit similarity."""
    rng = random.Random(21)
    common = [words(rng, 1) for _ in range(30)]
    letter = lambda w: (lambda i: w[:i] + "z" + w[i + 1 :])(rng.randrange(len(w)))
    rows, alike = [], 0
    for n in (5, 6, 8, 9, 12, 20, 40):
        for kind in (0, 1, 2):
            for _ in range(10):
                line = [rng.choice(common) if rng.random() < 0.4 else words(rng, 1) + words(rng, 1) for _ in range(n)]
                other = list(line)
                if kind == 1:
                    other.insert(rng.randrange(n + 1), "of")
                else:
                    for i in rng.sample(range(n), max(1, n // 5) if kind else 1):
                        other[i] = letter(other[i])
                rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pair = df.select(F.expr("doc_id div 2").alias("k"), "doc_id", "text").groupBy("k").agg(F.min_by("text", "doc_id").alias("x"), F.max_by("text", "doc_id").alias("y"))
    alike = pair.where("x <> y and 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.8").count()
    gone = line_dedup.dedup_lines(df).agg(F.sum("n_dropped")).first()[0]
    assert alike > 150 and 0.95 * alike <= gone <= len(rows) // 2


def test_short_lines_are_compared_by_their_words(spark):
    rows = [(1, "Read more\nRead  more!\n---\nTop"), (2, "read more\nread most\n---\none two three four five"), (3, "\n---\nTop\nOne, two three four five")]
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("Read more\n---\nTop", 1), 2: ("read most\n---\none two three four five", 1), 3: ("\n---", 2)}


def test_long_lines_are_counted_in_chunks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, words(rng, 300)), (2, words(rng, 40)), (3, words(rng, 7)), (4, "word " * 300_000 + words(rng, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select(*line_dedup._row(df), "text")
    whole = bag(line_dedup.line_table(df, 5).collect())
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    assert bag(line_dedup.line_table(df, 5).collect()) == whole


def test_hot_blocks_of_lines(spark, monkeypatch):
    """A very common pair of long words, thousands of variants of a line and unlike lines that share words: blocks beyond HOT."""
    monkeypatch.setattr(line_dedup, "HOT", 16)
    rng = random.Random(4)
    base = words(rng, 30).split()
    rows = [(i, "commonword otherword " + words(rng, 12)) for i in range(300)]
    for i in range(300, 600):
        line = list(base)
        line[rng.randrange(30)] = "x" + words(rng, 1)
        rows.append((i, " ".join(line)))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in out if r.doc_id >= 300) == 299
    assert sum(r.n_dropped for r in out if r.doc_id < 300) == 0


def test_lines_that_cannot_be_alike_are_not_paired(spark, monkeypatch):
    """A block of unlike lines that share a key: its lines don't become pairs by the square; a near copy among them is found."""
    rng, sizes = random.Random(6), {}
    real, table = line_dedup.materialise, line_dedup.line_table

    def counted(df, name, rows=None):
        out = real(df, name, rows)
        if {c for c, _ in out.dtypes} == {"a", "b"}:
            sizes[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    monkeypatch.setattr(line_dedup, "line_table", lambda *a: table(*a).withColumn("keys", F.array_append("keys", F.lit(7).cast("long"))))
    lines = [words(rng, 14) for _ in range(120)]
    lines.append(lines[50] + "z")
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_dropped} == {120}
    assert sizes and max(sizes.values()) < 2 * len(lines)


# repeats


def brute_repeats(rows, span):
    key = lambda d: math.inf if d is None else d
    first = {}
    for d, t in rows:
        x = (t or "").encode()
        for p in range(len(x) - span + 1):
            s = x[p : p + span]
            first[s] = min(first.get(s, math.inf), key(d))
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - span + 1):
            if first[x[p : p + span]] < key(d):
                gone[p : p + span] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(x), int(gone.sum()), int((edges == 1).sum()), np.frombuffer(x, "u1")[~gone].tobytes()))
    return out


@pytest.mark.parametrize("span", [50, 20])
def test_repeats(docs, empty, span):
    got = repeats.find_repeats(docs.select("doc_id", "text"), span).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == bag(brute_repeats(pairs(), span))
    assert repeats.find_repeats(empty, span).count() == 0


def test_repeats_keep_other_columns(docs):
    left = repeats.drop_repeats(docs)
    assert left.schema.names == docs.schema.names
    assert bag((r.doc_id, r.source, r.block) for r in left.collect()) == bag((r[0], r[2], r[7]) for r in corpus())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text("ab", max_size=70)), min_size=1, max_size=8))
def test_merged_transforms_find_equal_strings(rows):
    span = 8
    raw = [(d, t.encode()) for d, t in rows if len(t) >= span]
    if not raw:
        return
    text = np.frombuffer(b"".join(t for _, t in raw), "u1")
    sizes = np.array([len(t) for _, t in raw])
    begin = np.cumsum(sizes) - sizes
    at = np.concatenate([np.arange(b, b + n - span + 1) for b, n in zip(begin, sizes)])
    owner = np.concatenate([np.full(n - span + 1, d) for (d, _), n in zip(raw, sizes)])
    got = repeats.least_docs(text, at, owner, span)
    best = {}
    for a, d in zip(at.tolist(), owner.tolist()):
        s = text[a : a + span].tobytes()
        best[s] = min(best.get(s, 99), d)
    assert got.tolist() == [best[text[a : a + span].tobytes()] for a in at.tolist()]


def test_merge_over_several_shards(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"abc", "u1"), 6000)
    text[4000:5000] = text[:1000]
    at = np.arange(len(text) - 49)
    owner = at // 500
    got = repeats.least_docs(text, at, owner, 50)
    assert got[4000] == 0 and got[4400] == 0 and got[3000] == 6 and repeats.SHARDS == 4


def test_a_range_of_marks_is_compared_in_steps(docs, monkeypatch):
    """No step holds more strings than asked for, though all marks lie in one range; the results stay."""
    monkeypatch.setattr(repeats, "STRINGS", 200)
    monkeypatch.setattr(repeats, "ranges", lambda spark: 1)
    df = docs.select("doc_id", "text")
    n, sizes = 1, []
    blocks = repeats._blocks(df)
    pieces = repeats._pieces(blocks, repeats._shared_marks(blocks, 50, n), 50, n)
    plain = repeats.least_docs
    monkeypatch.setattr(repeats, "least_docs", lambda text, at, docs, span: sizes.append(len(at)) or plain(text, at, docs, span))
    task = {}
    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInArrow", lambda self, f, schema: task.update(f=f))
    repeats._verdicts(pieces, 50)
    table = pieces.where("part >= 0").toArrow()
    assert task["f"](table).num_rows == table.num_rows > 0
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 3
    monkeypatch.undo()
    monkeypatch.setattr(repeats, "STRINGS", 200)
    got = repeats.find_repeats(df, 50).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == bag(brute_repeats(pairs(), 50))


# classifier, neighbours


def test_classifier(spark, docs, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        t = words(rng, 40) if good else " ".join(w + "%%%" for w in words(rng, 40).split())
        rows.append((i, t, len(t)))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    machine = quality_fm.fit(df, marks)
    got = {r.doc_id: r for r in quality_fm.score(df, machine).collect()}
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in quality_fm.score(docs, machine).collect())
    assert quality_fm.score(docs, machine).count() == len(corpus())
    kept = quality_fm.reject(df, marks)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality_fm.score(empty, machine).count() == 0 and quality_fm.reject(empty, marks).count() == 0
    none = quality_fm.fit(df, marks.where("doc_id < 0"))
    assert {round(r.score, 6) for r in quality_fm.score(df, none).collect()} == {0.5}


def test_machine_scores_by_the_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(np.zeros((quality_fm.STATISTICS, quality_fm.CUTS)), 0.3)
    m.w = rng.normal(size=m.w.shape)
    m.v = rng.normal(size=m.v.shape)
    idx, val, starts = m.rows([np.array([3, 9, 77])], rng.normal(size=(1, quality_fm.STATISTICS)))
    pairwise = sum(float(m.v[i] @ m.v[j]) * a * b for k, (i, a) in enumerate(zip(idx, val)) for j, b in list(zip(idx, val))[k + 1 :])
    assert math.isclose(m.logits(idx, val, starts)[0], 0.3 + float((m.w[idx] * val).sum()) + pairwise, rel_tol=1e-9)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [float("inf")] + [0.0] * 15), (404, [1.0, None] + [0.0] * 14), (405, [1.0, 2.0]), (None, x[0].tolist()), rows[7], (420, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("id", F.lit(2))
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = [*range(300), 420]
    full = np.vstack([x, x[50]])
    for q in [*range(0, 300, 20), 420]:
        s = (full * full[ids.index(q)]).sum(axis=1)
        want = [(ids[i], s[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:7]
        assert [v for v, _ in got[q]] == [v for v, _ in want]
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-12)
    assert set(got) == {*range(0, 300, 20), 420}
    assert neighbours.nearest(df.where("vec_id < 0"), df, 3).count() == 0


def test_scratch_is_shared_and_released(spark):
    df = common.materialise(spark.range(5), "probe")
    assert df.count() == 5
    common.release(df)
    assert common.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == now.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
    assert now.count() > 0
    assert len(corpus_pipeline.STAGES) == 5

