"""WARC, top-k search, SentencePiece and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from granulite.llm import warc
from granulite.llm.pieces import OPEN, decode_pieces, default_model, encode_pieces, load, product, scan
from granulite.llm.topk_search import Lists, nra, topk_search


def test_archive_round_trip():
    some = [warc.record(i, "http://x/ y\n", b"<p>hello %d</p>" % i * 50, hashlib.sha1(b"").digest(), None) for i in range(300)]
    for records in (some, some[:1], [b"a" * 100_000] * 3):
        data = warc.archive(records)
        assert int.from_bytes(data[:4], "little") == warc.MAGIC
        assert list(warc.records_of(data)) == records
    with pytest.raises(Exception):
        list(warc.records_of(data[:-3]))
    headers, http, payload = warc.parse(some[3])
    assert headers["WARC-Type"] == "response" and headers["WARC-Target-URI"] == "http://x/%20y%0A" and payload == b"<p>hello 3</p>" * 50


PAGES = "page_id long, url string, html string, archive string, payload string, digest string"


def test_warc(spark, tmp_path):
    big, small = "<p>é</p>" * 300, "<p>x</p>"
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://c/", small), (4, "u", small), (5, "u", None), (None, "n", big), (6, "", ""), (7, "v", big + "!"), (8, "w", "null" * 500), (8, "w", "null" * 500)]
    df = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], PAGES)
    out = warc.warc_round_trip(df, str(tmp_path / "w"), archive_bytes=3000).collect()
    want = Counter()
    for k, _, h in pages:
        data = (h or "").encode()
        top = max((p for p, _, x in pages if x == h and p is not None), default=None)
        again = len(data) >= 1000 and top is not None and top != k
        want[k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in out)
    assert len(list((tmp_path / "w").glob("*.warc.zst"))) > 1
    assert warc.warc_round_trip(df.where("false"), str(tmp_path / "none")).count() == 0


def full_scan(q, x, k, i, j, score):
    """Whether (i, j, score) holds the k best of each query with ties, with true scores."""
    full = q @ x.T
    assert (full[i, j] == score).all()
    bar = np.sort(full, axis=1)[:, -min(k, len(x))]
    assert set(zip(*np.nonzero(full >= bar[:, None]))) <= set(zip(i, j))


@pytest.mark.parametrize("part", [0.1, 0.5, 1.0])
def test_nra_is_exact(part):
    r = np.random.default_rng(2)
    for n, d in ((400, 16), (50, 3), (3, 5), (1, 1)):
        x, q = r.integers(-60, 60, (n, d)).astype(float), r.integers(-60, 60, (7, d)).astype(float)
        q[0] = 0
        i, j, s, read = nra(q, Lists(x), 5, part=part)
        full_scan(q, x, 5, i, j, s)
        assert read[0] == 0 and (read <= n * (q != 0).sum(1)).all()
    i, j, s, _ = nra(np.zeros((2, 0)), Lists(np.zeros((3, 0))), 2)
    assert sorted(zip(i, j, s)) == [(a, b, 0) for a in range(2) for b in range(3)]


def test_nra_leaves_out_own_vectors():
    x = np.arange(12.0).reshape(6, 2)
    i, j, _, _ = nra(x[-1:], Lists(x), 2, np.arange(6)[None, :] == 5)
    assert set(j) == {4, 3}


def test_nra_stops_when_no_outsider_can_qualify():
    """Where contributions fall steeply few entries are read; where all differ in all lists, reading goes on to the end but candidates get few."""
    r = np.random.default_rng(5)
    x = np.zeros((2000, 20))
    for j in range(20):  # each list has 30 values above 0
        x[r.choice(2000, 30, replace=False), j] = r.integers(1, 200, 30)
    q = r.integers(1, 9, (10, 20)).astype(float)
    i, j, s, read = nra(q, Lists(x), 5, part=0.02)
    full_scan(q, x, 5, i, j, s)
    assert (read <= 0.05 * x.size).all()
    x = r.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    i, j, s, read = nra(x[::50], Lists(x), 5)
    full_scan(x[::50], x, 5, i, j, s)
    assert len(i) < 0.02 * 40 * 2000 and (read <= x.size).all()


def test_topk_of_large_ids(spark):
    """Ids above 2^53 stay apart, also where one repeats in its block."""
    big = 50 * ((1 << 53) // 50 + 3)
    rows = [(big, [1.0, 0.5]), (big, [1.0, 0.5]), *((big + n, [0.5, 0.25]) for n in range(1, 7))]
    got = sorted(map(tuple, topk_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).collect()))
    assert got == best(rows, k=6) and len(got) == 6


def best(rows, k=5, every=50):
    clean = {(i, tuple(math.floor(256 * float(v)) for v in x)) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)}
    out = []
    for q in {i for i, _ in clean if i % every == 0}:
        score = {}
        for i, a in clean:
            for j, b in clean:
                if i == q and j != q and len(a) == len(b):
                    score[j] = max(score.get(j, -(10**9)), sum(u * v for u, v in zip(a, b)))
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k])]
    return sorted(out)


def test_topk(spark):
    r = random.Random(4)
    f32 = lambda v: float(np.float32(v))
    rows = [(i, [f32(r.uniform(-1, 1)) for _ in range(8)]) for i in range(120)]
    rows += [(None, [1.0] * 8), (200, None), (201, [1.0, None] * 4), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (50, rows[50][1]), (7, [0.5] * 8), (204, [1.0] * 3), (250, [1.0] * 3), (205, rows[3][1])]
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows], "vec_id long, embedding array<float>, score string, rank string")
    got = sorted(map(tuple, topk_search(df, candidates=40, queries=2).collect()))
    assert got == best(rows)
    assert topk_search(df.where("false")).count() == 0 and topk_search(df.where("vec_id = 1")).count() == 0


def test_scan_finds_the_best_way():
    r = np.random.default_rng(3)
    sizes = [1, 3, 2, 4, 1]
    ms = [r.integers(-9, 0, (a, b)).astype(float) for a, b in zip(sizes, sizes[1:])]
    way = [0, *scan(ms), 0]
    total = ms[0]
    for m in ms[1:]:
        total = product(total, m)
    assert sum(m[a, b] for m, a, b in zip(ms, way, way[1:])) == total[0, 0]


def chunked(m, text, chunk):
    s = m.marked(text)
    n = -(-len(s) // chunk)
    at = [(i * chunk, min(len(s), (i + 1) * chunk)) for i in range(n)]
    t = [m.transfer(s, a, b) for a, b in at]
    enter = [OPEN, *(t[i + 1][0][q] for i, q in enumerate(scan([x[2] for x in t])))]
    out = []
    for (a, b), e, o in zip(at, enter, [*enter[1:], OPEN]):
        before, inner, after = m.trace(s, a, b, e, o)
        out += [*before, *m.units([inner])[0].tolist(), *after]
    return out


def test_chunks_of_any_size_give_the_library_ids():
    m, r = load(default_model()), random.Random(6)
    some = ["a" * 90, "  ", " ", "a ", "   x   y    ", "日本語🤗🤗 foo🤗bar", "▁▁a▁b", "internationalization" * 6]
    some += ["".join(r.choice("abcdetionin 日é\t") for _ in range(r.randint(1, 80))) for _ in range(60)]
    some += ["".join(r.choice(["tion", "in", "er", "the", "ab", "  ", "x"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    for t in some:
        want = m.sp.encode(t)
        assert m.units([m.marked(t)])[0].tolist() == want
        for chunk in (1, 2, 3, 7, 20):
            assert chunked(m, t, chunk) == want, (t, chunk)


@pytest.mark.parametrize("table, chunk", [("docs", 300), ("odd", 5000), ("odd", 1 << 20)])
def test_encode_and_decode(request, table, chunk):
    df = request.getfixturevalue(table)
    m = load(default_model())
    encoded = encode_pieces(df, chunk=chunk, carry=("a.b", "ids") if table == "odd" else ())
    out = decode_pieces(encoded).collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = Counter((k, t, None if t is None else tuple(m.sp.encode(t))) for k, t in rows)
    assert Counter((r.doc_id, r.text, None if r.ids is None else tuple(r.ids)) for r in out) == want
    assert all(r.n_tokens == len(r.ids or []) for r in out)
    assert max(r.n_chunks for r in out) > 1 or chunk == 1 << 20


def test_any_ids_are_decoded_as_by_the_library(spark):
    """Ids at random, of bytes that aren't UTF-8, of control pieces and none at all."""
    m, r = load(default_model()), random.Random(7)
    some = [None, [], [0], [1, 2], [m.sp.piece_to_id("<0xE6>")], [m.id["▁"], m.id["▁"]], [m.sp.piece_to_id("<0x41>")]]
    some += [[r.randrange(m.sp.get_piece_size()) for _ in range(r.randint(1, 20))] for _ in range(150)]
    some += [[r.randrange(3000, 20000) for _ in range(r.randint(1, 20))] for _ in range(150)]
    out = decode_pieces(spark.createDataFrame(list(enumerate(some)), "i int, ids array<int>")).collect()
    got = {x.i: x.text for x in out}
    assert all(got[i] == (None if x is None else m.sp.decode(x)) for i, x in enumerate(some))


def test_words_of_one_hash(monkeypatch):
    """Words are told apart also where their hashes are equal."""
    from granulite.llm import pieces

    m, t = load(default_model()), "the cat saw  the other cat"
    monkeypatch.setattr(pieces, "hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert m.units([m.marked(t)])[0].tolist() == m.sp.encode(t)


def test_words_are_forgotten(monkeypatch):
    """Beyond the words that a worker remembers, ids stay the library's."""
    from granulite.llm import pieces

    m, r = pieces.Pieces(default_model()), random.Random(2)
    monkeypatch.setattr(pieces, "REMEMBER", 40)
    for _ in range(30):
        t = " ".join(f"w{r.randint(0, 60)}" for _ in range(30))
        assert m.units([m.marked(t)])[0].tolist() == m.sp.encode(t) and len(m.known.size) <= 60


def test_pipeline(spark, docs, none):
    import corpus_pipeline as p

    sf_dir, kept = "/root/testdata/sf0.001", docs
    assert [k for k, _ in p.STAGES] == ["language ID", "near duplicates", "substring dedup", "mixing", "SentencePiece encoding"]
    before = {}
    for name, stage in p.STAGES:
        kept = stage(spark, kept, sf_dir)
        rows = kept.collect()
        before[name] = rows
        if name != p.STAGES[-1][0]:
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(rows, docs.schema)
    texts = [r.text for r in before["near duplicates"]]
    assert len(texts) == len(set(texts)) < len(before["language ID"])
    ids = {r.doc_id: r.text for r in before["mixing"]}
    m = load(default_model())
    assert all(r.ids == m.sp.encode(ids[r.doc_id]) for r in before[p.STAGES[-1][0]])
    assert sorted(map(tuple, (r[:4] for r in p.run(spark, sf_dir).collect()))) == sorted(map(tuple, (r[:4] for r in before[p.STAGES[-1][0]])))


def test_near_duplicates_under_shared_ids(spark):
    """One row of each component, also if rows share an id."""
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (7, c), (7, c + " end"), (7, c), (8, None), (8, ""), (None, b + " end"), (None, "lone words"), (9, "  ")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.near_duplicate_stage(spark, df, "").collect()]
    linked = [(i, (t or "")[:2]) for i, t in got if t and len(t) > 60]
    assert Counter(linked) == {(1, "a0"): 1, (5, "b0"): 1, (7, "c0"): 1}
    assert Counter(x for x in got if not x[1] or len(x[1]) < 60) == {(8, None): 1, (8, ""): 1, (None, "lone words"): 1, (9, "  "): 1}


def test_pipeline_on_odd_rows(spark, odd, none):
    """Each stage by itself on odd rows, whose columns clash with those that operators make, and on what its predecessor kept."""
    import corpus_pipeline as p

    odd = odd.withColumns({c: odd["score"] for c in ("first_id", "row_key", "class_id", "lang_pred", "domain")})
    alone = {name: stage(spark, odd, "").collect() for name, stage in p.STAGES}
    assert {r.doc_id for r in alone["language ID"]} == {1, 4, 5, 6, 7, None, 10, 11} and all(r.lang in ("en", "de") for r in alone["language ID"])
    # 1 and the null id, 5 and 5 and 4, 6 and 7 are groups; texts without words stay
    assert Counter(r.doc_id for r in alone["near duplicates"]) == Counter([1, 2, 3, 4, 6, 8, 9, 10, 11, 11])
    assert all(r.text is None or r.text for r in alone["substring dedup"] if r.doc_id not in (3, 8)) and {r.doc_id for r in alone["substring dedup"]} >= {2, 3, 4, 8, 9}
    assert {r.doc_id for r in alone["mixing"]} <= {r.doc_id for r in odd.collect() if (r.text or "").split()}
    assert Counter((r.doc_id, r.n_tokens == 0) for r in alone["SentencePiece encoding"]) == Counter((r.doc_id, not r.text) for r in odd.collect())
    for df in (odd, none):
        kept = df
        for name, stage in p.STAGES:
            kept = stage(spark, kept, "")
            rows = kept.collect()
            kept = spark.createDataFrame(rows, kept.schema)
            assert rows if df is odd else not rows


def test_entry_names_and_sql(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_warc", "op6_topk_search", "op7_mix_sources", "op8_ngram_jaccard_join"])
def test_sql(spark, name):
    from compare import connection, same

    from granulite.llm import queries

    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), connection("/root/testdata/sf0.001"), queries.ORACLE_SQL[name])
