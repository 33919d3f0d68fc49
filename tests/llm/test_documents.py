"""Operators on documents against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from granulite.llm import blocks, mixing
from granulite.llm import compression_rules as cr
from granulite.llm.blocks import pack, unpack
from granulite.llm.components import components
from granulite.llm.compression_rules import compression_rules
from granulite.llm.kd_shards import kd_shards, kd_tree
from granulite.llm.language_id import Model, Tree, language_id
from granulite.llm.lm_score import ADD, SHORTER, lm_score
from granulite.llm.ngram_join import ngram_jaccard_join
from granulite.llm.substring_dedup import substring_dedup
from granulite.llm.words import windows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = 150_000


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return WORD.findall(t or "")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_words_and_windows(size):
    some = ["a b  c", None, "", "x", "y z\n", "é à b a b", "\x0b\x0cq"] * 2
    got, name = [[] for _ in some], {}
    for w in words(pa.array(some), size=size):
        for d, s, e, h in zip(w.doc, w.start, w.end, w.hash):
            x = bytes(w.data[s:e]).decode()
            got[d].append(x)
            assert name.setdefault(x, h) == h
    assert got == [split(t) for t in some] and len(set(name.values())) == len(name)
    h = np.arange(60, dtype=np.uint64) % np.uint64(7)
    for n in (1, 3, 10, 20):
        seen = defaultdict(set)
        for i, x in enumerate(windows(h, n)):
            seen[tuple(h[i : i + n])].add(x)
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_packing():
    a = np.array([0, 5, 1 << 40], np.uint64)
    b = np.array([1, 1, 0], np.uint64)
    c = np.where(np.arange(3000) % 100 == 7, 1 << 20, 1).astype(np.uint64)
    assert [x.tolist() for x in unpack(pack(a, b))] == [a.tolist(), b.tolist()]
    assert len(pack(c)) < 600 and unpack(pack(c, c[::-1]))[1].tolist() == c[::-1].tolist()
    r = np.random.default_rng(1)
    d = np.where(r.random(4000) < 0.3, r.integers(0, 60, 4000), 1).astype(np.uint64)
    d[::50] = r.integers(0, 1 << 40, 80)
    assert unpack(b"xyz" + pack(d, np.zeros(4000, np.uint64)), 3)[0].tolist() == d.tolist() and len(pack(d)) < 3000
    assert [len(x) for x in unpack(pack(d[:0], d[:0]))] == [0, 0]
    for k in ([7], [5, 5, 6], r.integers(0, 1 << 58, 20_000), r.integers(0, 300, 5000), [0, (1 << 58) - 1], [3] * 9):
        keys = np.sort(np.array(k, np.uint64))
        data = blocks.pack_keys(keys)
        got, end = blocks.unpack_keys(data + b"more")
        assert got.tolist() == keys.tolist() and end == len(data)
        for parts, bits in ((1, 58), (7, 58), (2_000_003, 58)):
            assert blocks.part_of(keys, parts, bits).tolist() == [int(x) * parts >> bits for x in keys.tolist()]
    assert len(blocks.pack_keys(np.sort(r.integers(0, 1 << 58, 20_000).astype(np.uint64)))) < 5.8 * 20_000


@pytest.mark.parametrize("tera, rows", [(0.001, 90), (1, 20_000), (100, 3000)])
def test_rows_of_a_block_are_bounded(tera, rows):
    """At 1 GB, 1 TB and 100 TB: rows that a block sends, bytes of a block, and partitions of an exchange."""
    s = blocks.plan(10, int(tera * 1e12))
    assert s.groups <= rows and s.groups <= max(blocks.HOP, 2 * math.isqrt(s.parts) + 1)
    assert s.bytes / s.blocks <= blocks.MOST_BYTES and s.tasks <= blocks.TASKS
    # and those that a relay meets, and a part
    assert not s.group or (s.batch <= 2 * math.isqrt(s.parts) and -(-s.blocks // s.batch) <= 10_000)


@pytest.mark.parametrize("hop", [1, 4096])
def test_exchange(spark, monkeypatch, hop):
    """Each block learns of each of its keys the number of blocks that hold it, in one hop and in two."""
    monkeypatch.setattr(blocks, "HOP", hop)
    r = np.random.default_rng(3)
    texts_ = [" ".join(f"w{x}" for x in r.integers(0, 400, 60)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    sizes = blocks.measure(df, "text", 1000)
    assert (sizes.group > 0) == (hop == 1) and sizes.parts > 3
    dealt = blocks.deal(df, "doc_id", "text", sizes)

    def keys(table):
        h = np.concatenate([blocks.short(w.hash) for w in words(table.column("text"))])
        return [(np.unique(h), [np.ones(len(np.unique(h)), np.uint64)])]

    def reply(k, _, values):
        order, at, size = blocks.groups(k)
        return [blocks.spread(order, size, np.add.reduceat(values[0][order], at))]

    def again(table, got):
        (k, v), = keys(table)
        return [(k[got[0] > 1], [v[0][got[0] > 1]])], b"own"

    def end(table, got, own):
        assert own == b"own"
        return pa.table({"block": pa.array([table.column("__block")[0].as_py()]), "words": pa.array([sorted({x for t in table.column("text").to_pylist() for x in t.split()})]), "n": pa.array([int(got[0].sum())])})

    answered = blocks.answer(blocks.send(dealt, keys, sizes), reply, sizes)
    answered = blocks.answer(blocks.send_again(dealt, answered, again, sizes, sizes), reply, sizes)
    rows = blocks.finish(dealt, answered, end, "block long, words array<string>, n long", sizes, noted=True).collect()
    held = Counter(x for r_ in rows for x in r_.words)
    assert len(rows) > 10 and all(r_.n == sum(held[x] for x in r_.words if held[x] > 1) for r_ in rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (2, 1), *((100 + i, 101 + i) for i in range(20))]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(21)}


def joined(rows):
    """Brute force: set size and component of each row, by its number."""
    sets = []
    for _, t in rows:
        w = split(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    where, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for v in where.values():
        shared.update((a, b) for k, b in enumerate(v) for a in v[:k])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return Counter((k, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_ngram_join(request, table):
    df = request.getfixturevalue(table)
    out = ngram_jaccard_join(df, block_bytes=SMALL)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == joined(texts(df))


def test_ngram_join_of_near_copies(spark):
    """A chain of edits: neighbours link, ends don't; and copies that differ in case."""
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(f"e{k}" if k < i else x for k, x in enumerate(base))) for i in range(0, 40, 2)] + [(100, " ".join(base).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(df).collect()) == joined(rows)


def deduped(rows):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    place = {}
    for i in order:
        k, w = rows[i][0], split(rows[i][1])
        for j in range(len(w) - 19):
            t = tuple(w[j : j + 20])
            here = (k is not None, k or 0, j)
            place[t] = min(place.get(t, here), here)
    for k, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if place[tuple(w[j : j + 20])] != (k is not None, k or 0, j):
                gone[j : j + 20] = [True] * 20
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    out = substring_dedup(df, carry=("source", "n_words"), block_bytes=SMALL)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_text", "removed_spans", "source"]
    rows = out.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == deduped(texts(df))
    assert all(sum(s.end - s.first for s in r.removed_spans) == r.n_removed for r in rows)


@pytest.mark.parametrize("table, order", [("docs", 2), ("docs", 3), ("odd", 2)])
def test_lm_score(request, table, order):
    df = request.getfixturevalue(table)
    rows = texts(df)
    tokens = [[0, *split(lower(t)), None] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows]
    c = [Counter() for _ in range(order + 1)]
    for x, h in zip(tokens, held):
        for n in range(1, order + 1) if not h else ():
            c[n].update(tuple(x[i - n + 1 : i + 1]) for i in range(1, len(x)) if i - n + 1 >= 0)
    n_texts, total, kinds = held.count(False), sum(c[1].values()), len(c[1])
    want = []
    for (k, _), x, h in zip(rows, tokens, held):
        base = score = 0.0
        for i in range(1, len(x)):
            p = (c[1][(x[i],)] + ADD) / (total + ADD * (kinds + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    history = tuple(x[i - n + 1 : i])
                    seen = n_texts if history == (0,) else c[n - 1][history]
                    p = (c[n][(*history, x[i])] + SHORTER * p) / (seen + SHORTER) if seen else p
            score += math.log10(p)
        want.append((k if k is not None else -1, h, len(x) - 1, sum(c[1][(y,)] > 0 for y in x[1:]), total, base, score))
    got = [(r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in lm_score(df, order=order, block_bytes=SMALL).collect()]
    assert [x[:5] for x in sorted(got)] == [x[:5] for x in sorted(want)]
    assert np.allclose([x[5:] for x in sorted(got)], [x[5:] for x in sorted(want)])


def test_automaton_carries_the_longest_known_history():
    """Arcs and states of a few texts, by hand and against a search for the longest known history after each token."""
    from granulite.llm import lm_score as lm

    train = ["a b c a b d", "b c", "a b c a b c a b"]
    some = ["a b c a x b d", "x", "", "c a b c a b d b c a"]
    count = Counter()
    for t in train:
        x = ["^", *t.split(), "$"]
        count.update(tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if j - i <= 3 and j > 1)
    (_, _, _, n, grams, exist), = lm._tokens(pa.chunked_array([pa.array(some)]), 3)
    flat = [(x, i) for t in some for x in [["^", *t.split(), "$"]] for i in range(1, len(x))]
    counts = [np.array([count[tuple(x[i - m : i + 1])] if e[at] else -1 for at, (x, i) in enumerate(flat)]) for m, e in enumerate(exist)]
    total, kinds = sum(v for k, v in count.items() if len(k) == 1), len({k for k in count if len(k) == 1})
    a = lm.Automaton(grams, counts, np.cumsum(n) - n, total, kinds, len(train))
    at = 0
    for t in some:
        state, x = np.array([a.begin]), ["^", *t.split(), "$"]
        for i in range(1, len(x)):
            weight, state = a.walk(np.array([at]), state)
            known = [m for m in (1, 2) if count[tuple(x[max(0, i - m + 1) : i + 1])] and i - m + 1 >= 0]
            assert a.level[state[0]] == max(known, default=0)
            p = (count[x[i],] + lm.ADD) / (total + lm.ADD * (kinds + 1))
            for m in (1, 2):
                h = tuple(x[i - m : i]) if i - m >= 0 else ("none",)
                seen = len(train) if h == ("^",) else count[h]
                p = (count[(*h, x[i])] + lm.SHORTER * p) / (seen + lm.SHORTER) if seen else p
            assert weight[0] == pytest.approx(math.log10(p))
            at += 1
    assert (a.level[a.fail][2:] == a.level[2:] - 1).all() and a.level[a.fail[1]] == 0
    for stretch in (1, 2, 3, 256):
        assert np.allclose(lm.traverse(a, n, 3, stretch), lm.traverse(a, n, 3))


def test_lm_beats_unigrams(docs):
    rows = [r for r in lm_score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def counted(t):
    t = t or ""
    w = split(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in t.split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit)


def kept(t):
    n, *_, repeats = counted(t)
    data = (t or "").encode()
    if n < 10 or 100 * repeats > 20 * n or not data:
        return False
    c = zstandard.ZstdCompressor(level=cr.LEVEL, write_content_size=False, write_checksum=False)
    part = lambda x: len(c.compress(x)) / len(x)
    lo, hi = next((a, b) for below, a, b in cr.DOCUMENT_BANDS if len(data) < below)
    if not lo <= part(data) <= hi:
        return False
    n = (len(data) + cr.CHUNK // 2) // cr.CHUNK
    pieces = [data[i * cr.CHUNK : (i + 1) * cr.CHUNK if i < n - 1 else None] for i in range(n)] if len(data) >= 2 * cr.CHUNK else []
    bad = sum(not cr.CHUNK_BAND[0] <= part(x) <= cr.CHUNK_BAND[1] for x in pieces)
    return bad * 100 <= cr.CHUNKS_OUTSIDE * len(pieces)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_compression_rules(request, table):
    df = request.getfixturevalue(table)
    out = compression_rules(df).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in out)
    assert got == Counter((k, *counted(t), kept(t)) for k, t in texts(df))
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)


def test_compression_bands_reject_extremes(spark):
    import random

    r = random.Random(1)
    words_ = [f"w{r.randint(0, 5000)}" for _ in range(1500)]
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) for _ in range(300))
    rows = [(1, " ".join(words_)), (2, "ab cd ef gh ij kl mn op qr st " * 400), (3, noise)]
    got = {x.doc_id: (x.base_failed, x.kept) for x in compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == (True, False) and got[3] == (False, False) and got[1] == (False, True)


def test_compression_bands_reject_noise(docs):
    """Noise of any length that compression can tell from prose, and prose that is half noise."""
    import random
    import string

    r = random.Random(8)
    letters, alnum = string.ascii_lowercase, string.ascii_letters + string.digits

    def noise(symbols, size, least=3, most=10):
        return " ".join("".join(r.choice(symbols) for _ in range(r.randint(least, most))) for _ in range(size // least))[:size]

    rows = {f"letters {n}": noise(letters, n) for n in (1100, 1500, 2000, 3000, 8000, 40000)}
    rows |= {f"alnum {n}": noise(alnum, n) for n in (300, 500, 700, 1500)} | {f"base64 {n}": noise(alnum + "+/", n, 40, 40) for n in (300, 700, 900, 3000)}
    prose = sorted(x.text for x in docs.collect() if x.text and kept(x.text) and len(x.text) > 4000)
    assert prose
    for x in prose[:5]:
        n = len(x) // 2
        rows |= {f"half letters {len(rows)}": x[:n] + noise(letters, n), f"half base64 {len(rows)}": noise(alnum + "+/", n, 40, 40) + x[:n]}
    names = list(rows)
    df = docs.sparkSession.createDataFrame([(i, rows[k]) for i, k in enumerate(names)] + [(1000 + i, x) for i, x in enumerate(prose)], "doc_id long, text string")
    got = {x.doc_id: x.kept for x in compression_rules(df).collect()}
    assert [names[i] for i in range(len(names)) if got[i]] == [] and all(got[1000 + i] for i in range(len(prose)))


def test_ppm_probabilities_sum_to_one():
    for tree in Model.of({"a": [b"abracadabra", b"a"], "b": [b"xyzzy", "é".encode()], "c": [bytes(range(255)) * 2]}).trees:
        width = np.ones(tree.k)
        width[0] = 256 - (tree.k - 1)
        assert np.allclose((np.exp2(-tree.bits[:-1].astype(float).reshape(-1, tree.k)) * width).sum(1), 1, atol=1e-4)


def test_ppm_against_walk():
    """Code lengths of the tables against a walk through dictionaries of contexts."""
    train, order = {"a": [b"abracadabra", b"banana"], "b": [b"xyzzy abc"]}, 3
    m = Model({k: Tree.loaded(t.saved()) for k, t in zip(train, Model.of(train, order).trees)})
    counts = {k: defaultdict(Counter) for k in train}
    for k, t in train.items():
        for x in t:
            for i in range(len(x)):
                for n in range(min(i, order) + 1):
                    counts[k][x[i - n : i]][x[i]] += 1

    @lru_cache(None)
    def p(k, ctx):
        shorter = p(k, ctx[1:]) if ctx else [1 / 256] * 256
        here = counts[k].get(ctx)
        if not here:
            return shorter
        left = sum(v for y, v in enumerate(shorter) if y not in here)
        n, q = sum(here.values()), len(here)
        return [here[y] / (n + q) if y in here else q / (n + q) * shorter[y] / left for y in range(256)]

    texts_ = [b"abrac", b"zzy", b"\xc3q", b""]
    off = np.cumsum([0, *map(len, texts_)])
    got = m.lengths(off, np.frombuffer(b"".join(texts_), np.uint8))
    for i, t in enumerate(texts_):
        for j, k in enumerate(m.langs):
            want = sum(-math.log2(p(k, t[max(0, x - order) : x])[t[x]]) for x in range(len(t)))
            assert got[i, j] == pytest.approx(want, abs=1e-3)


def test_language_id(docs, odd, none):
    rows = language_id(docs, carry=("lang",)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)
    got = language_id(odd, carry=("lang_pred", "a.b"))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte", "a.b"]
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].bits_per_byte is None for k in (2, 3, 8, 9))
    assert by[6].lang_pred == "en" and 0 <= by[6].score <= 1
    unlabelled = language_id(odd.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language_id(none).count() == 0


def test_language_of_long_rows_only(spark):
    """A language that is labelled on rows above the limit alone is learned from their beginnings."""
    a, b = "the cat sat on the mat and looked at the dog ", "żółw i jeż idą przez łąkę pod dębem "
    rows = [(i, a * (2 + i % 5), "en") for i in range(60)] + [(100 + i, b * (600 + i), "pl") for i in range(6)] + [(200 + i, b * 3 + str(i), None) for i in range(8)]
    got = {r.doc_id: r.lang_pred for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[k] for k in got if k >= 100} == {"pl"} and {got[k] for k in range(60)} == {"en"}


def test_kd_shards(docs, odd, none):
    for df, shards in ((docs, 24), (odd, 5)):
        src = texts(df)
        out = kd_shards(df, shards=shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in src)
        by = defaultdict(list)
        for r in out:
            assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
            by[r.shard].append(r)
        for rows in by.values():
            assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert kd_shards(none).count() == 0


def test_kd_tree_against_recursion(spark):
    """The tree's cells against a recursive split of sorted lists, where one value holds a third of all rows."""
    r, shards = np.random.default_rng(6), 7
    n = 3000
    d0, d1 = np.where(r.random(n) < 1 / 3, 50, r.integers(0, 200, n)), r.integers(-1000, 5000, n)
    tie, size = r.choice(1 << 40, n, replace=False), r.integers(1, 10, n)
    whole = [int(d.max() - d.min()) for d in (d0, d1)]
    want = {}

    def split(at, first, k):
        if k == 1:
            return want.update(dict.fromkeys(at.tolist(), first))
        width = [(int(d[at].max()) - int(d[at].min())) / w for d, w in zip((d0, d1), whole)]
        d = (d0, d1)[width.index(max(width))]
        order = at[np.lexsort((tie[at], d[at]))]
        ends, left = np.cumsum(size[order]), size[at].sum() * (k // 2) / k
        i = int(np.argmax(ends > left))
        i += bool(ends[i] - left < left - (ends[i] - size[order][i]))
        split(order[:i], first, k // 2)
        split(order[i:], first + k // 2, k - k // 2)

    split(np.arange(n), 0, shards)
    rows = [(i, *map(int, x), int(x[3])) for i, x in enumerate(zip(d0, d1, tie, size))]
    df = spark.createDataFrame(rows, "i int, d0 long, d1 long, tie long, size long, heft long").cache()
    tree = kd_tree(df, 2, shards)
    assert {x.i: x.s for x in df.select("i", tree.number().alias("s")).collect()} == want


def test_kd_shards_are_near_equal(spark):
    """A third of all rows has one source and one text."""
    rows = [(i, "same text" * 20 if i % 3 == 0 else "x" * (i % 300), f"s{i % 3 and i % 7}", "en") for i in range(4000)]
    out = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    total = Counter()
    for r in out:
        total[r.shard] += r.size
    mean = sum(total.values()) / 24
    assert len(total) == 24 and max(total.values()) < 1.05 * mean and min(total.values()) > 0.95 * mean


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i // 2} " * 30, f"s{i % 5}", "en") for i in range(2000)]
    where = defaultdict(set)
    for r in kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=6).collect():
        where[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


@pytest.mark.parametrize("copies, most", [(4, 1.05), (20, 1.3)])
def test_large_groups_share_a_shard(spark, copies, most):
    """Groups of more than a 32nd of a shard, and of 0.2 to 0.7 shards, beside single rows; sizes stay as near as whole groups let them."""
    rows = [(i, f"text {i // copies} " * (15 + i // copies % 30), f"s{i % 5}", "en") for i in range(600)]
    rows += [(1000 + i, f"row {i} " * (1 + i % 9), f"s{i % 7}", "de") for i in range(2000)]
    where, total = defaultdict(set), Counter()
    for r in kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect():
        where[r.text_crc32].add(r.shard)
        total[r.shard] += r.size
    assert all(len(v) == 1 for v in where.values())
    assert max(total.values()) < most * sum(total.values()) / 24


def test_mixing(docs, odd, none):
    out = mixing.mix_sources(docs).collect()
    n = sum(len(split(t)) for _, t in texts(docs))
    assert 0.5 * n * mixing.PERCENT / 100 < sum(r.n_tokens for r in out) <= n * mixing.PERCENT / 100
    assert max(Counter((r.doc_id, r.epoch) for r in out).values()) == 1 and {r.epoch for r in out} <= {0, 1}
    every = mixing.mix_sources(odd, percent=1000, epochs=2, carry=("a.b", "epoch"))
    assert every.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch", "a.b"]
    want = Counter((k, len(split(t)), e) for k, t in texts(odd) if split(t) for e in (0, 1))
    assert Counter((r.doc_id, r.n_tokens, r.epoch) for r in every.collect()) == want
    assert mixing.mix_sources(none).count() == 0


def test_mixing_makes_up_shortages(spark):
    """Two domains of equal weight; a source that runs short is made up by its sibling, a domain by the other."""
    rows = [(i, "w " * 10, "en", "a1" if i < 10 else "a5" if i < 300 else "b2") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter()
    for r in mixing.mix_sources(df, percent=50, epochs=1).collect():
        got[r.source] += r.n_tokens
    assert got == {"a1": 100, "a5": 900, "b2": 1000}
    got = Counter(r.source for r in mixing.mix_sources(df, percent=75, epochs=1).collect())
    assert got == {"a1": 10, "a5": 190, "b2": 100}


@pytest.mark.parametrize("at_once", [0, 100])
def test_mixing_to_weights_of_all_levels(spark, at_once):
    """Nobody runs short: tokens lie as weights say, also where leaves are too many to broadcast."""
    rows = [(i, "w " * 10, ("en", "de")[i % 2], f"{'ab'[i // 2 % 2]}{i // 4 % 2}") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"d0": 3}, "lang": {"en": 4}, "source": {"a1": 2, "a0": 1}}
    got = Counter()
    for r in mixing.mix_sources(df, percent=25, epochs=1, weights=weights, leaves_at_once=at_once).collect():
        got[r.domain, r.lang, r.source] += r.n_tokens
    want = {(d, l, s): 4000 * (3 if d == "d0" else 1) / 4 * (4 if l == "en" else 1) / 5 * (2 if s == "a1" else 1) / (3 if d == "d1" else 2) for d in ("d0", "d1") for l in ("en", "de") for s in (f"a{d[1]}", f"b{d[1]}")}
    assert set(got) == set(want) and all(0 <= want[k] - got[k] <= 11 for k in want)


def test_empty_tables(none):
    for f in (ngram_jaccard_join, substring_dedup, lm_score, compression_rules):
        assert f(none).count() == 0


def test_hash_of_kept_text(docs):
    from granulite.llm.queries import op2_substring_dedup

    want = {(k, hashlib.sha256(t.encode()).hexdigest()) for k, _, _, t in deduped(texts(docs))}
    got = {(r.doc_id, r.kept_sha256) for r in op2_substring_dedup(docs.sparkSession, "/root/testdata/sf0.001").collect()}
    assert got == want
