"""Every operator against brute force, on a table with all the awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedworks.llm import brown, langid, mixing, neardup, pivots, quality, repeats, simhash, tokenfiles
from feedworks.llm.bpe import op6_byte_bpe
from feedworks.llm.components import connected_components
from feedworks.llm.queries import QUERIES

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, h STRING, fp INT, size STRING, kept INT"


def _rows():
    rnd = random.Random(5)
    syllables = {"en": ["the", "ing", "and", "sh"], "de": ["ein", "ung", "ß", "sch"], "fr": ["é", "aux", "les", "oi"]}

    def prose(lang, n):
        return " ".join("".join(rnd.choices(syllables[lang], k=rnd.randint(1, 3))) for _ in range(n))

    passage = prose("en", 120)
    rows = [(i, prose(lang, rnd.randint(60, 250)), lang) for i in range(60) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(60 + i, prose("en", 40) + " " + passage + " " + prose("en", 40), "en") for i in range(4)]
    rows += [(70, rows[0][1], "en"), (71, rows[0][1] + " x", "en"), (72, None, "en"), (73, "", None), (74, " \t\n", "en")]
    rows += [(75, "12 34 !!", "de"), (76, "a", "fr"), (77, "ab " * 9000, "en"), (78, "é" * 600, "fr"), (79, "🙂 x\x00y", None)]
    rows += [(None, "no id at all", "en"), (None, None, None), (70, rows[0][1], "en"), (80, "  lead and trail  ", "en")]
    return [
        (k, t, lang, None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "x", 1, "y", 2)
        for i, (k, t, lang) in enumerate(rows)
    ]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 5 != 0), 0, "z") for k in range(60)] + [(None, 1, 0, "z"), (3, 0, 0, "z")]
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT, text STRING").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(_vectors(), "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, node INT").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return path


def _vectors():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(30, 16))
    near = [centres[i % 30] + rnd.normal(size=16) * (0.05 if i % 2 else 0.3) for i in range(240)]
    out = [(i, [float(x) for x in v], i % 2, 0) for i, v in enumerate(near)]
    out += [(300, out[0][1], 0, 0), (301, None, 0, 0), (302, [0.0] * 16, 0, 0), (303, out[0][1], None, 0)]
    out += [(304, [float("nan")] + [1.0] * 15, 0, 0), (305, [None] + [1.0] * 15, 0, 0), (None, out[0][1], 0, 0)]
    return out + [(306, [1.0, 2.0], 0, 0), (307, [2.0, 4.0], 0, 0), (308, [], 0, 0)]


def _sorted(values):
    return sorted(values, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_language(spark, sf_dir, rows):
    found = langid.op1_language_id(spark, sf_dir).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for k in (72, 73, 74, 75):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    own = [(by_id[k], lang) for k, _, lang, *_ in rows if k is not None and k < 60]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r, _ in own)
    held = [r.lang_pred == lang for r, lang in own if r.held_out]
    assert held and sum(held) / len(held) > 0.9


def test_language_model_base(spark, sf_dir, rows):
    found = brown.op2_class_lm(spark, sf_dir).collect()
    counts = Counter()
    for k, t, *_ in rows:
        if zlib.crc32(str(k).encode() if k is not None else b"") % 10:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for k, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((k, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert _sorted(got) == _sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    texts = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, f"{t} {i}", lang) for lang, t in texts.items() for i in range(9 if lang == "fr" else 12)]
    found = langid.learn_dictionaries(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    assert list(found) == ["de", "en"]


def test_dictionaries_take_pieces_from_anywhere(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHARS_PER_DOC", 40)
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "SAMPLE_PARTS", 3)
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 6)) for i in range(200)]
    rows = [(i, " ".join(words[(i + k) % 200] for k in range(150)), "xx") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(5)
    ranked = sorted(docs.select("text", F.xxhash64("text").alias("h")).distinct().collect(), key=lambda r: r.h)[:5]
    want = [r.text[(r.h >> 8) % (len(r.text) - 39) :][:40].encode() for r in ranked]
    assert langid.learn_dictionaries(docs) == {"xx": b" ".join(want)}
    monkeypatch.setattr(langid, "DICTIONARY_BYTES", 54)
    assert 45 < len(langid.learn_dictionaries(docs)["xx"]) <= 54
    assert [len(x) for x in langid._shared([b"a" * 30, b"b" * 2, b"c" * 40])] == [24, 2, 25]


def test_class_model_shares_its_probability(spark):
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING")
    counts = brown.count_words(docs)
    vocabulary = brown.Vocabulary(counts.collect())
    none = spark.createDataFrame([], "word BINARY, c BIGINT")
    model = brown.ClassModel(vocabulary, brown.count_pairs(docs, vocabulary), brown.rare_totals(none), len(texts))
    classes = model.member[vocabulary.items]
    for k in set(classes.tolist()):
        seen = (10 ** model.words[classes == k]).sum() + (10**model.end if model.member[brown.END] == k else 0)
        assert seen + 10 ** model.unseen[k] == pytest.approx(1)
    assert (10**model.moves).sum(1) == pytest.approx(1)
    letters = brown.spelling(counts)
    assert (10**letters).sum(1) == pytest.approx(1)
    got = brown.spell([b"ab", b"", b"cab"], letters)
    steps = [[(10, 97), (97, 98), (98, 10)], [(10, 10)], [(10, 99), (99, 97), (97, 98), (98, 10)]]
    assert got == pytest.approx([sum(letters[a, b] for a, b in way) for way in steps])


def test_words_not_seen_are_less_likely(spark):
    rnd = random.Random(10)
    known = ["".join(rnd.choices("abcdef", k=5)) for _ in range(80)]
    rows = [(i, " ".join(rnd.choices(known, k=40)), False) for i in range(60)]
    rows += [(100, known[0], True), (101, "fedcb", True), (102, " ".join(known[:20]), True), (103, "zq" * 9, True)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, held_out BOOLEAN")
    score = {r.doc_id: r.score for r in brown.score_documents(docs).collect()}
    assert score[100] > score[101] > score[103]


def test_exchange_ends_where_no_move_helps():
    rnd = np.random.default_rng(6)
    pairs = rnd.integers(0, 9, (14, 14)) * (1.0 + 30 * (np.arange(14)[:, None] % 3 == np.arange(14) % 3))

    def likelihood(member):
        moves = np.zeros((3, 3))
        np.add.at(moves, (member[:, None], member[None, :]), pairs)
        return sum(brown._xlogx(x).sum() * sign for x, sign in ((moves, 1), (moves.sum(0), -1), (moves.sum(1), -1)))

    member = brown.exchange(pairs, classes=3, rounds=50)
    best = likelihood(member)
    for item in range(14):
        for other in range(3):
            moved = member.copy()
            moved[item] = other
            assert likelihood(moved) <= best + 1e-6


def test_a_word_takes_the_class_that_raises_the_likelihood_most():
    rnd = np.random.default_rng(7)
    pairs = (rnd.integers(0, 9, (30, 30)) * (rnd.random((30, 30)) < 0.4)).astype(float)
    member = rnd.integers(0, 4, 30)

    def moves(member):
        found = np.zeros((4, 4))
        np.add.at(found, (member[:, None], member[None, :]), pairs)
        return found

    one_hot = np.eye(4)[member]
    twice = pairs.diagonal()
    alone = pairs - np.diag(twice)
    after, before = alone @ one_hot, alone.T @ one_hot
    best = brown.best_classes(moves(member), after, before, twice, member)
    assert (best != member).any()
    for word in range(30):
        tried = [brown.likelihood(moves(np.where(np.arange(30) == word, k, member))) for k in range(4)]
        assert tried[best[word]] == pytest.approx(max(tried))
        table_ = moves(member)
        one = [x[word : word + 1] for x in (after, before, twice, member, best)]
        brown._move(table_, *one)
        assert (table_ == moves(np.where(np.arange(30) == word, best, member))).all()


def _two_kinds(spark):
    """Words of two kinds in turn, all of one ending; 300 of 1,400 are rarer."""
    rnd = random.Random(12)
    kinds = [[f"{k}{i}ing" for i in range(700)] for k in "ab"]
    weights = [20] * 550 + [5] * 150
    drawn = [rnd.choices(words, weights, k=16000) for words in kinds]
    line = [w for pair in zip(*drawn, strict=True) for w in pair]
    rows = [(i, " ".join(line[i * 40 : i * 40 + 40]), False) for i in range(800)]
    a, b = (words[560:680] for words in kinds)
    rows += [(1000, " ".join(w for pair in zip(a, b, strict=True) for w in pair), True), (1001, " ".join(a + b), True)]
    rows += [(1002, f"{a[0]} {a[0]} neverseen {b[0]}  {b[1]} the", True), (1003, "", True), (1004, None, True)]
    return rows, spark.createDataFrame(rows, "doc_id LONG, text STRING, held_out BOOLEAN")


def test_every_word_has_a_class_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(brown, "LOOKED_UP", 1200)
    rows, docs = _two_kinds(spark)
    found = {r.doc_id: r for r in brown.score_documents(docs).collect()}
    assert found[1000].n_tokens == found[1001].n_tokens == 241
    assert found[1000].score > found[1001].score + 40

    # The same from the model's parts, word by word.
    training = docs.filter("NOT held_out")
    counts = brown.count_words(training)
    vocabulary = brown.Vocabulary(brown.most_frequent(counts, counts.count()))
    assert brown.OWN_ITEMS < vocabulary.size < 1200
    classes, moves, own = brown.word_classes(training, vocabulary)
    own = {r["key"]: r["class"] for r in own.collect()}
    c = {bytes(r.word): r.c for r in counts.collect()}
    hashed = lambda w: (xxhash.xxh64_intdigest(w, 42) + 2**63) % 2**64 - 2**63
    member = {w: classes[vocabulary.place[w]] if w in vocabulary.place else own[hashed(w)] for w in c}
    assert len(own) == len(c) - vocabulary.size > 200
    kinds = [{member[w] for w in c if w[:1] == k and w not in vocabulary.place} for k in (b"a", b"b")]
    assert not kinds[0] & kinds[1]
    end = classes[vocabulary.end]
    table_ = np.zeros_like(moves)
    for _, text, held_out in rows:
        if not held_out:
            line = [end, *[member[w] for w in text.encode().split()], end]
            np.add.at(table_, (line[:-1], line[1:]), 1)
    assert (table_ == moves).all()

    rare = [w for w in c if w not in vocabulary.place]
    others = spark.createDataFrame([(w, c[w], int(member[w])) for w in rare], "word BINARY, c BIGINT, class INT")
    totals = brown.class_totals(counts, others, vocabulary, classes)
    model = brown.ClassModel(vocabulary, moves, totals, 800, classes)
    letters = brown.spelling(counts)
    words = np.concatenate([model.words, np.log10([(c[w] - model.discount) / model.mass[member[w]] for w in rare])])
    of_words = [classes[: vocabulary.size], [member[w] for w in rare]]
    for k in range(brown.CLASSES):
        seen = (10 ** words[np.concatenate(of_words) == k]).sum() + (10**model.end if end == k else 0)
        assert seen + 10 ** model.unseen[k] == pytest.approx(1)
    probability = dict(zip([*vocabulary.place, *rare], words, strict=True))
    for key, text, _ in rows[::50] + rows[800:]:
        score, at = model.end, end
        for w in (text or "").encode().split():
            k = member.get(w, classes[vocabulary.size + brown.ending(w) - brown.OWN_ITEMS])
            score += model.moves[at, k] + (probability[w] if w in c else model.unseen[k] + brown.spell([w], letters)[0])
            at = k
        assert found[key].score == pytest.approx(score + model.moves[at, end])


def test_neighbours_lie_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(brown, "LOOKED_UP", 1200)
    monkeypatch.setattr(brown, "PART_WORDS", 1 << 11)
    monkeypatch.setattr(brown, "SCANNED_AT_ONCE", 1 << 13)
    rows, docs = _two_kinds(spark)
    training = docs.filter("NOT held_out").repartition(3)
    counts = brown.count_words(training)
    vocabulary = brown.Vocabulary(brown.most_frequent(counts, counts.count()))
    size, end, parts = vocabulary.size, vocabulary.end, vocabulary.parts
    assert parts > 10
    pairs, occurrences = Counter(), Counter()
    tokens = 0
    for _, text, held_out in rows:
        if not held_out:
            words = text.encode().split()
            ids = [end, *vocabulary.ids_of(words)[0].tolist(), end]
            keys = [None, *((xxhash.xxh64_intdigest(w, 42) + 2**63) % 2**64 - 2**63 for w in words), None]
            other = [size <= i < end for i in ids]
            tokens += len(words) + 1
            pairs.update(zip(ids, ids[1:], strict=False))
            occurrences.update(
                (keys[i], ids[i], ids[i - 1], ids[i + 1], keys[i + 1] if other[i + 1] else None)
                for i in range(len(ids)) if other[i]
            )

    found = brown.stored(brown.neighbours(training, vocabulary), "test-neighbours")
    listed = found.collect()
    assert len(listed) <= 2 * parts * (3 + tokens // brown.SCANNED_AT_ONCE)
    got, places = Counter(), {}
    for r in listed:
        assert 0 <= r.part < parts
        if r.n is None:
            got.update(zip(r.key, r.own, r.left, r.right, r.next, strict=True))
            for key in r.key:
                assert places.setdefault(key, r.part) == r.part
        else:
            for pair in zip(r.left, r.right, strict=True):
                assert places.setdefault(pair, r.part) == r.part
    assert got == occurrences

    near = {r.key: sorted(zip(r.near, r.n, strict=True)) for r in brown.contexts(found, vocabulary).collect()}
    plain: dict = {}
    for (u, v), n in pairs.items():
        plain.setdefault(u, []).append((v, n))
        plain.setdefault(v, []).append((u, -n))
    assert near == {key: sorted(lists) for key, lists in plain.items()}

    # Counts of all classes come from every task; they are not made rows one by one.
    def none(*_):
        raise AssertionError("a row for each pair of classes")

    with monkeypatch.context() as patched:
        patched.setattr(brown.F, "posexplode", none)
        classes, moves, own = brown.word_classes(training, vocabulary)
    own = {r["key"]: r["class"] for r in own.collect()}
    assert len(own) == len({o[0] for o in occurrences})
    table_ = np.zeros_like(moves)
    for _, text, held_out in rows:
        if not held_out:
            words = text.encode().split()
            hashed = [(xxhash.xxh64_intdigest(w, 42) + 2**63) % 2**64 - 2**63 for w in words]
            line = [classes[vocabulary.place[w]] if w in vocabulary.place else own[h] for w, h in zip(words, hashed, strict=True)]
            line = [classes[end], *line, classes[end]]
            np.add.at(table_, (line[:-1], line[1:]), 1)
    assert (table_ == moves).all()


def test_token_files(spark, sf_dir, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.start: r for r in tokenfiles.op3_token_id_files(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    ids = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in rows}
    total = sum(len(ids[t]) for _, t, *_ in rows)
    assert sum(r.n_tokens for r in got.values()) == total
    want = _sorted((k, len(ids[t]), zlib.crc32(ids[t].tobytes())) for k, t, *_ in order)
    assert _sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got.values()) == want
    in_order = [got[s] for s in sorted(got)]
    assert [r.doc_id for r in in_order] == [k for k, *_ in order]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(in_order, in_order[1:], strict=False))


def test_token_files_as_the_plain_call(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> 'll y", "<|endoftext", "a b"]
    texts += [f"ab{chr(c)}12 {chr(c)}! {chr(c)}z" for c in (0x58B, 0xC5C, 0xCDC, 0x208F, 0xA7CE, 0x1F642)]
    # One document of every character of the plane, so that none is left out.
    texts += ["".join(f"a{chr(c)}1 !{chr(c)}! " for c in range(low, low + 256)) for low in range(0, 0xD800, 256)]
    texts += ["".join(f"a{chr(c)}1 !{chr(c)}! " for c in range(low, low + 256)) for low in range(0xE000, 0x10000, 256)]
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    starts = np.cumsum([0] + [len(x) for x in ids])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = [tuple(r) for r in tokenfiles.id_digests(tokenfiles.write_ids(docs)).collect()]
    want = [(k, int(starts[k]), len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)]
    assert sorted(got) == want
    assert ids[0].tolist() == [64, 50256, 65, 2]


def test_damaged_block_is_noticed():
    from feedworks.llm.rangecoder import decode_blocks, encode_blocks

    block = np.arange(2000) % 300 * 7
    data = bytearray(encode_blocks([block])[0])
    assert (decode_blocks([bytes(data)])[0] == block).all()
    data[40] ^= 1
    with pytest.raises(ValueError):
        decode_blocks([bytes(data)])


def test_quality(spark, sf_dir, rows):
    found = quality.op4_quality_resampling(spark, sf_dir).collect()
    assert len(found) == len(rows)
    assert all(r.log_weight == 0 for r in found if r.n_grams == 0)


def test_labelled_sample(spark, monkeypatch):
    from feedworks.llm import quality

    monkeypatch.setattr(quality, "LABELLED_ROWS", 40)
    rows = [(i, i % 3 == 0) for i in range(300)] + [(7, True), (None, True), (900, None)]
    labels = spark.createDataFrame(rows, "doc_id LONG, good BOOLEAN").selectExpr(
        "doc_id", "CAST(good AS INT) AS quality", "'x' AS label_id"
    )
    expected = set()
    for wanted in (0, 1):
        order = "SELECT DISTINCT doc_id FROM labels WHERE quality = {q} AND doc_id <> 7"
        labels.createOrReplaceTempView("labels")
        ranked = spark.sql(order.format(q=wanted)).selectExpr("doc_id", "xxhash64(doc_id) AS h")
        expected |= {(r.doc_id, wanted) for r in ranked.orderBy("h").limit(40).collect()}
    spark.catalog.dropTempView("labels")
    sample = [tuple(r) for r in quality.labelled_sample(labels).collect()]
    assert sorted(sample) == sorted(expected)
    none = quality.labelled_sample(labels.filter("false"))
    assert none.collect() == []


def test_rank_and_cut(spark):
    from feedworks.llm.shared import value_at_rank

    values = [float(i % 50) for i in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    ordered = sorted(values, reverse=True)
    assert [value_at_rank(df, k) for k in (1, 200, 9000)] == [ordered[0], ordered[199], ordered[8999]]
    assert quality.best_cut(np.array([3.0, 4.0]), np.array([-1.0, 1.0])) == 2.0


def test_vectors(spark, sf_dir):
    data = _vectors()
    usable = [(k, np.array(v, float), lab) for k, v, lab, _ in data if k is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    near = {k: [o for o, w, m in usable if o != k and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for k, v, lab in usable}
    low = {k: k for k, *_ in data}
    for _ in data:
        low.update({k: min([low[k], *[low[o] for o in near[k]]]) for k in near})
    want = _sorted((k, len(near.get(k, [])), low[k]) for k, *_ in data)
    got = _sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.op5_embedding_near_dedup(spark, sf_dir).collect())
    linked = sum(n for _, n, _ in want)
    assert linked and sum(n for _, n, _ in got) >= 0.9 * linked
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_pivots_without_a_window(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = [(i, 3 + i % 2, [float(x) for x in rnd.normal(size=3 + i % 2)]) for i in range(9001)]
    classes = spark.createDataFrame(rows, "node LONG, dim INT, embedding ARRAY<FLOAT>")
    ranked = classes.selectExpr("dim", "xxhash64(embedding) AS h", "node", "embedding").collect()
    # A window over the table would put all vectors of a length in one task.
    monkeypatch.setattr(F, "row_number", None)
    got = pivots.choose_pivots(classes)
    for dim in (3, 4):
        own = sorted((r.h, r.node, r.embedding) for r in ranked if r.dim == dim)
        want = np.array([v for *_, v in own[: max(math.isqrt(len(own)), pivots.LEAST_PIVOTS)]])
        assert np.allclose(got[dim], pivots.unit(want))


def test_vectors_of_many_lengths(spark):
    rnd = np.random.default_rng(13)
    rows = []
    for dim in range(1, 21):
        for k in range(6):
            base = rnd.normal(size=dim) if k % 2 == 0 else base + 0.05 * rnd.normal(size=dim)
            rows.append((len(rows), [float(x) for x in base], 0))
    data = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _ in rows]
    want = {k: sum(o != k and len(unit[o]) == len(v) and v @ unit[o] >= 0.93 for o in range(len(unit))) for k, v in enumerate(unit)}
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(data).collect()}
    assert got == want and sum(want.values()) > 40


def test_byte_bpe(spark, sf_dir, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        listed = ",".join(map(str, ids)).encode()
        want.append((k, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert _sorted(map(tuple, op6_byte_bpe(spark, sf_dir).collect())) == _sorted(want)


def test_simhash(spark, sf_dir, rows):
    found = simhash.op7_simhash_fingerprints(spark, sf_dir).collect()
    assert len(found) == len(rows)
    unique = {k: t or "" for k, t, *_ in rows if k is not None and k != 70}
    ids = sorted(unique)
    prints = {r.doc_id: r for r in found}
    for k, after in zip(ids, ids[1:], strict=False):
        if k in (69, 70) or after == 71 or k == 60 + 3:
            continue
        t, n = unique[k], len(unique[k])
        edited = t[: n - n // 2] + unique[after][: n // 2]
        assert prints[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        differ = bin(int(prints[k].fingerprint, 16) ^ int(prints[after].fingerprint, 16)).count("1")
        assert prints[k].near_next == 1 - differ / 64
    assert prints[72].fingerprint == prints[74].fingerprint == "0" * 16
    assert prints[0].fingerprint == prints[70].fingerprint


def test_block_tables_find_all(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in base + near]
    df = spark.createDataFrame(signed, "fp BIGINT")
    got = {tuple(r) for r in simhash.within(df, df).collect()}
    want = {(a[0], b[0]) for a in signed for b in signed if bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


@pytest.mark.parametrize("window", [400, 24])
def test_repeats(spark, sf_dir, rows, window, monkeypatch):
    if window == 24:
        monkeypatch.setattr(repeats, "MOST_CLASSES", 2)
        monkeypatch.setattr(repeats, "BUCKET_RUNS", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeats.remove_repeats(docs, window).collect()
    texts = [(k, (t or "").encode()) for k, t, *_ in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    want = []
    for k, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        starts, ends = repeats.spans_of(gone)
        want.append((k, np.frombuffer(t, np.uint8)[~gone].tobytes(), str(list(zip(starts.tolist(), ends.tolist(), strict=True)))))
    got = [(r.doc_id, bytes(r.kept), str([(s.a, s.b) for s in r.removed])) for r in found]
    assert _sorted(got) == _sorted(want)


def test_passage_stage_leaves_no_fifty_words_twice(spark):
    import corpus_pipeline

    rnd = random.Random(21)

    def prose(n):
        return " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))

    passages = [prose(55) for _ in range(6)]
    texts = [f"{prose(40)} {passages[i % 6]} {prose(rnd.randint(0, 60))}" for i in range(40)] + [prose(200) for _ in range(10)]
    texts += [None, "", "short", "é" * 150 + passages[0]]
    rows = [(i, t, len(t or ""), 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_chars LONG, k1 INT").repartition(3)
    kept = {r.doc_id: r for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    window, data = corpus_pipeline.PASSAGE_BYTES, [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in data for i in range(len(t) - window + 1))
    for k, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert (kept[k].text or "") == left and kept[k].n_chars == (None if texts[k] is None else len(left))
    assert kept[50].text is None and all(kept[k].text == texts[k] for k in range(40, 50))
    words = [tuple(r.text.split()) for r in kept.values() if r.text]
    runs = Counter(x for w in words for x in {w[i : i + 50] for i in range(len(w) - 49)})
    assert max(runs.values(), default=1) == 1


def test_deep_shallow_order():
    from feedworks.llm.suffixsort import common_prefix, deep_shallow_sort

    rnd = random.Random(4)
    strings = [b"ab" * 30 + bytes(rnd.choices(b"\0ab", k=rnd.randint(0, 6))) for _ in range(200)] + [b"", b"\0", b"ab"]
    key = np.array([i % 3 for i in range(len(strings))])
    order, shared = deep_shallow_sort(strings, key)
    ranked = [(int(key[i]), strings[i]) for i in order]
    assert ranked == sorted(ranked)
    for a, b, n in zip(ranked, ranked[1:], shared[1:].tolist(), strict=False):
        assert n == (common_prefix(a[1], b[1]) if a[0] == b[0] else -1)


def test_mixing(spark, sf_dir, rows):
    found = mixing.op9_source_mixing(spark, sf_dir).collect()
    assert _sorted((r.doc_id, r.size) for r in found) == _sorted((k, len((t or "").encode().split())) for k, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len((t or "").encode().split())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free = {}, dict(sizes)
    while free:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = 3 * sizes[s]
            del free[s]
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in sizes)
    again = mixing.op9_source_mixing(spark, sf_dir).collect()
    assert _sorted(map(tuple, again)) == _sorted(map(tuple, found))


def test_mixed_texts_rejoin(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    own = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text in own[r.doc_id] and r.n_chars == len(r.text) and r.h == "x" for r in mixed.collect() if r.doc_id is not None)


def test_near_dedup(spark, sf_dir, rows):
    def fingerprint(t):
        words = (t or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(k, fingerprint(t)) for k, t, *_ in rows]
    root = list(range(len(prints)))
    for _ in prints:
        root = [min(root[j] for j, (_, b) in enumerate(prints) if bin(a ^ b).count("1") <= 4) for _, a in prints]
    low = {}
    for (k, _), r in zip(prints, root, strict=True):
        low[r] = min([x for x in (low.get(r), k) if x is not None], default=None)
    want = [(k, f"{f:016x}", low[r]) for (k, f), r in zip(prints, root, strict=True)]
    assert _sorted(map(tuple, neardup.op10_simhash_near_dedup(spark, sf_dir).collect())) == _sorted(want)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_similar_texts_leave_one(spark, monkeypatch):
    import corpus_pipeline
    from feedworks.llm import shingles

    # Small blocks, so that groups are cut.
    monkeypatch.setattr(shingles, "BLOCK", 4)
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = []
    for number in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(6, 400))
        texts.append(" ".join(words))
        for _ in range(12 if number < 3 else 3):
            edited = list(words)
            for at in rnd.sample(range(len(words)), rnd.randint(0, max(1, len(words) // 25))):
                edited[at] = rnd.choice(vocabulary)
            texts.append(" ".join(edited))
    texts += ["", None, "a b", "A  b"]

    def runs(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}

    sets = [runs(t) for t in texts]
    root = list(range(len(texts)))
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)]
    for _ in texts:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id LONG, text STRING, lang STRING")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert len(set(root)) < len(texts) - 60


def test_texts_that_share_nothing_do_not_meet(spark, monkeypatch):
    from feedworks.llm import shingles

    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    words = [rnd.choices(vocabulary, k=rnd.randint(20, 90)) for _ in range(300)]
    line = " ".join(rnd.choices(vocabulary, k=12))
    texts = [" ".join(w) + (f" {line}" if i % 2 else "") for i, w in enumerate(words)]
    # Thirty that differ in their last word meet in a common shingle.
    texts += [" ".join(words[0] + [line, str(i)]) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    whole, compared = shingles.candidate_links, []
    monkeypatch.setattr(shingles, "candidate_links", lambda sets: compared.append(sets.count()) or whole(sets))
    monkeypatch.setattr(shingles, "MOST_SHARING", 20, raising=False)
    groups = shingles.similar_groups(docs).groupBy("root").count().collect()
    # The texts that the thirty were made of may hang together with them.
    assert sum(compared) < 60
    assert sorted(r["count"] for r in groups) in ([1] * 299 + [31], [1] * 300 + [30])


def test_similar_sets_share_a_first_shingle():
    from feedworks.llm import shingles

    rnd = np.random.default_rng(9)
    for size in [*range(1, 40), 200, 901]:
        counts = rnd.integers(0, 3, shingles.COUNTS)
        both = math.ceil(0.8 * size)
        for own in (0, (size - both) // 2, size - both):
            drawn = rnd.integers(0, 1 << 64, both + 2 * (size - both), dtype=np.uint64)
            a, b = np.unique(drawn[:both + own]), np.unique(np.concatenate([drawn[:both], drawn[both + own :][: size - both - own]]))
            if shingles.similar(a, b):
                assert np.intersect1d(shingles.first_shingles(a, counts), shingles.first_shingles(b, counts)).size
    assert len(shingles.first_shingles(drawn[:100], counts)) <= 22
    assert not len(shingles.first_shingles(drawn[:0], counts))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7), (5, -4)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    assert got == {(i, -4) for i in range(61)} | {(200, 100)}
    assert connected_components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def test_pipeline(spark, sf_dir, empty_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf_dir)
    assert "ids" in out.columns and out.count()
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
