"""Spelling variants, ranked search and nearest vectors against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest

from feedworks.llm import curves, nra, variants
from feedworks.llm.fmindex import Index, near_words
from feedworks.llm.oracle import ORACLE
from feedworks.llm.queries import QUERIES

NEW = ["op11_spelling_variants", "op12_ranked_search", "op13_nearest_vectors"]


def _documents():
    rnd = random.Random(12)
    stems = ["straight", "elephant", "überall", "Österreich", "mountain", "aaaaaaa", "quelqueé"]
    letters = "abeéÀ×÷ÿ"

    def varied(word):
        at = rnd.randrange(len(word))
        return rnd.choice([word, word, word, word[:at] + rnd.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters) + word[at + 1 :]])

    rows = [(i, " ".join(varied(rnd.choice(stems)) for _ in range(rnd.randint(5, 120)))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, " \t"), (103, "12 34 !!"), (None, "elephant mountain no id"), (None, None)]
    rows += [(104, "straight " * 3000), (105, "é" * 700 + " " + "é" * 701), (106, "é" * 700), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(107, "Straight, STRAIGHT; straight\x00x straight-x 🙂elephant ａｂｃ ÉLÉPHANT"), (108, "xyz only here"), (109, "xyz only here")]
    return [(k, t, 1, "w", "z") for k, t in rows]


def _items():
    texts = ["straight elephant", "xyz", "xyz xyz only here", "", None, "no such thing zzz", "Mountain MOUNTAIN überall 12", "elephant " * 40, "aaaaaaa"]
    return [(i, t, 0, 0) for i, t in enumerate(texts)] + [(None, "mountain", 0, 0), (0, "überall", 0, 0), (0, "überall", 0, 0)]


def _vectors():
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=12)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(15)] + [(1100, rows[0][1]), (1100, rows[0][1]), (300, rows[2][1])]
    rows += [(1200, None), (1300, [0.0] * 12), (1400, [float("nan")] + [1.0] * 11), (1500, [None] + [1.0] * 11), (1600, [])]
    rows += [(1700, [1.0, 2.0]), (1701, [2.0, 4.0]), (1800, [float("inf"), 1.0]), (None, rows[0][1]), (1900, [-0.0] * 11 + [1e-30])]
    return [(k, v, i % 3, 0, 0.0) for i, (k, v) in enumerate(rows)]


SCHEMAS = {
    "documents": (_documents, "doc_id BIGINT, text STRING, n INT, word STRING, term STRING"),
    "benchmark": (_items, "item_id BIGINT, text STRING, doc_id INT, rank INT"),
    "embeddings": (_vectors, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, node INT, score DOUBLE"),
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search"))
    for name, (rows, columns) in SCHEMAS.items():
        spark.createDataFrame(rows(), columns).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for name in SCHEMAS:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", NEW)
def test_as_sql(spark, sf_dir, name, monkeypatch):
    # Small tiles, segments and blocks, so that there are many of each.
    monkeypatch.setattr(variants, "TILE_SYMBOLS", 64)
    monkeypatch.setattr(variants, "TILE_SEARCHES", 8)
    monkeypatch.setattr(nra, "SEGMENT_DOCUMENTS", 9)
    monkeypatch.setattr(nra, "ITEMS_TOGETHER", 3)
    monkeypatch.setattr(nra, "FIRST_READ", 1)
    monkeypatch.setattr(curves, "MOST_BLOCK", 100)
    monkeypatch.setattr(curves, "SEARCHES_TOGETHER", 2)
    db = duckdb.connect()
    for table in SCHEMAS:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    result = db.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert want and _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_one_empty_table(spark, sf_dir, empty_dir):
    items, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents"))
    assert nra.ranked_search(items, docs.limit(0)).count() == 0
    assert nra.ranked_search(items.limit(0), docs).count() == 0
    assert nra.ranked_search(items, docs.filter("text IS NULL OR text = ''")).count() == 0


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_variants_by_brute_force(spark):
    docs = _documents()
    counts = Counter()
    for k, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if k is None else k}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if _near(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    want = [(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n]
    got = variants.spelling_variants(spark.createDataFrame(docs, SCHEMAS["documents"][1])).collect()
    assert any(form.values()) and _sorted(got) == _sorted(want)


def test_roots_follow_long_ways(spark):
    way = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("x", "w3")]
    got = dict(map(tuple, variants.roots(spark.createDataFrame(way, "word STRING, form STRING")).collect()))
    assert got == {w: "w17" for w, _ in way}


def test_near_words_of_an_index():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choices("abé", k=rnd.randint(5, 8))) for _ in range(400)})
    queries = words[:150] + ["zzzzzzz", "ab" * 4]
    for change in (-1, 0, 1):
        for exact in (2, 4):
            kinds = np.full(len(queries), change)
            found = near_words(Index(words), queries, np.full(len(queries), exact), kinds)
            got = {(queries[a], words[b]) for a, b in zip(*found, strict=True)}
            assert len(got) == len(found[0])
            want = {
                (q, w)
                for q in queries
                for w in words
                if len(w) == len(q) + change and w.endswith(q[-exact:]) and _near(q[:-exact], w[: len(w) - exact])
            }
            assert got == want


def test_search_by_brute_force(spark):
    docs, items = _documents(), _items()
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = [(k, Counter(term.findall((t or "").encode().lower().decode()))) for k, t, *_ in docs]
    split = [(k, c) for k, c in split if c]
    docs_n, terms_n = len(split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    want = []
    for item_id, text, *_ in items:
        asked = Counter(term.findall((text or "").encode().lower().decode()))
        scored = []
        for k, c in split:
            m = 25 + (75 * c.total() * docs_n) // terms_n
            score = sum(
                times * math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, k is None, k))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:10]
        want += [(item_id, rank, k, -score) for rank, (score, _, k) in enumerate(best, 1)]
    got = nra.ranked_search(
        spark.createDataFrame(items, SCHEMAS["benchmark"][1]), spark.createDataFrame(docs, SCHEMAS["documents"][1])
    ).collect()
    assert _sorted(got) == _sorted(want)


def test_nra_reads_until_all_is_known(monkeypatch):
    rnd = np.random.default_rng(9)
    monkeypatch.setattr(nra, "FIRST_READ", 2)
    for _ in range(60):
        size = int(rnd.integers(1, 200))
        lists, total = [], np.zeros(size, np.int64)
        for _ in range(rnd.integers(1, 8)):
            rows = rnd.permutation(size)[: rnd.integers(0, size + 1)]
            scores = np.sort(rnd.integers(1, 6, len(rows)))[::-1]
            lists.append((rows, scores))
            total[rows] += scores
        found, scores = nra.nra(lists, size, best=5)
        bar = np.sort(total)[::-1][:5][-1]
        assert sorted(found.tolist()) == np.flatnonzero((total >= bar) & (total > 0)).tolist()
        assert (scores == total[found]).all()


def test_hilbert_curve_has_no_jumps():
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.array(list(product(range(1 << bits), repeat=axes)))
        place = curves.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        steps = np.diff(cells[np.argsort(place)], axis=0)
        assert (np.abs(steps).sum(1) == 1).all()


def test_measured_window_finds_neighbours(spark, monkeypatch):
    monkeypatch.setattr(curves, "LEAST_WINDOW", 16)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, 24))
    data = centres[rnd.integers(0, 40, 4000)] + 0.3 * rnd.normal(size=(4000, 24))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data.astype(np.float32))]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    nodes = curves.vector_nodes(vectors).cache()
    assert curves.measured_window(nodes, curves.curve_ranks(nodes).cache()) < 1000
    got = {}
    for r in curves.nearest_vectors(vectors).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = np.array([v for _, v in rows])
    hits = 0
    for k in range(0, 4000, 100):
        d = np.sqrt(((exact - exact[k]) ** 2).sum(1))
        d[k] = np.inf
        hits += len(got[k] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 400
