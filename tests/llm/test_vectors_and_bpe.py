"""Whitening, vector codes and the tokenization automaton against plain versions, and on awkward input."""

import hashlib
import itertools
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import bpe_automaton, embedding_whitening, integer_vectors, vector_codes
from turnloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, code string, at int, n long"


def vectors_of(spark, rows):
    """rows: (vec_id, embedding, label); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, v, y, "x", "c", 1, 2) for i, v, y in rows], VECTORS)


def awkward(spark, d=4):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(d)], i % 3 if i % 4 else None) for i in range(90)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * (d - 1), 1), (203, [float("nan")] + [0.0] * (d - 1), 1), (204, [None] + [0.0] * (d - 1), 1), (205, [float("inf")] * d, None), (206, [float("-inf")] * d, 1)]
    rows += [(None, [0.5] * d, 7), rows[0], rows[0], (0, [9.0] * d, 2), (300, [-0.0] * d, 2)] + [(400 + i, [0.25] * d, 2) for i in range(60)]
    return vectors_of(spark, rows).repartition(5)


def kept(df, d):
    """(vec_id, whole numbers, label) of the rows that take part."""
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect() if r.embedding is not None and len(r.embedding) == d]
    rows = [(i, v, y) for i, v, y in rows if all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(256 * Fraction(c)) for c in v], y) for i, v, y in rows]


# ---- 11


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64, 100])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d)) * 10.0 ** rng.integers(-4, 4, d)
    for m in (a @ a.T, a + a.T, np.eye(d), np.zeros((d, d)), np.diag(np.arange(d) % 3 - 1.0), np.ones((d, d))):
        values, rows = embedding_whitening.symmetric_qr(m)
        size = np.abs(m).max() or 1.0
        assert (np.diff(values) <= 0).all() and np.abs(rows @ rows.T - np.eye(d)).max() < 1e-12
        assert np.abs(m @ rows.T - rows.T * values).max() < 1e-12 * size * d


def test_moments_of_any_split():
    """Welford's updates and the parallel formula give the covariance of plain sums."""
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 6)) + 10**9
    for cuts in ([], [1], [0, 0, 250], sorted(rng.integers(0, 500, 20).tolist())):
        total = embedding_whitening.Moments.empty(6)
        for part in np.split(x, cuts):
            one = embedding_whitening.Moments.empty(6)
            one.take_each(part)
            one.sums = embedding_whitening._sums(part)
            total.merge(one)
        exact = x.astype(object) * 500 - x.astype(object).sum(0)
        want = np.array([[float(Fraction(int(sum(exact[:, i] * exact[:, j])), 500 * 500)) for j in range(6)] for i in range(6)])
        assert total.n == 500 and (total.sums == x.sum(0)).all()
        assert np.abs(total.products - want).max() < 1e-8 * want.max()
    wide = np.array([[2**62, -(2**62)], [2**62, 5]])
    assert embedding_whitening._sums(wide).tolist() == [2**63, 5 - 2**62]


def check_whitening(got, rows, components=4):
    """Every figure from exact sums and numpy's own solver."""
    fit = sorted({tuple(x) for _, x, _ in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, d)
    assert len(got) == k * len(rows) and {r.n for r in got} == {n}
    for c in range(1, k + 1):
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c), key=lambda t: t[:3])
        want = []
        for i, x, _ in rows:
            gaps = [n * a - s for a, s in zip(x, sums)]
            want.append((i is None, i or 0, sum(g * g for g in gaps), float(np.array([float(Fraction(g, n)) for g in gaps]) @ vectors[:, c - 1] / math.sqrt(values[c - 1]))))
        want.sort(key=lambda t: t[:3])
        sign = 1 if sum(a[3] * b[3] for a, b in zip(mine, want)) > 0 else -1
        for a, b in zip(mine, want):
            assert a[:3] == b[:3] and math.isclose(a[3], sign * b[3], abs_tol=1e-8)
        assert all(math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9) for r in got if r.component == c)
    (error,) = {r.identity_error for r in got}
    assert error < 1e-9


@pytest.mark.parametrize("d", [3, 4, 6])
def test_whitening_awkward(spark, d):
    df = awkward(spark, d)
    got = embedding_whitening.whitening_report(df)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check_whitening(got.collect(), kept(df, d))


def test_whitening_query(spark):
    check_whitening(QUERIES["op11_whitening"](spark, SF).collect(), kept(spark.read.parquet(f"{SF}/embeddings.parquet"), 64))


def test_whitening_without_variance(spark):
    assert embedding_whitening.whitening_report(vectors_of(spark, [])).count() == 0
    assert embedding_whitening.whitening_report(vectors_of(spark, [(1, None, 1), (2, [], 1), (3, [float("nan")], 1)])).count() == 0
    for rows in ([(1, [1.0, 2.0, 3.0], 1)], [(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 2)]):
        got = embedding_whitening.whitening_report(vectors_of(spark, rows)).collect()
        assert len(got) == 3 * len(rows) and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    flat = [(i, [float(i), 1.0, 2.0 * i], 1) for i in range(20)]  # one direction only
    got = embedding_whitening.whitening_report(vectors_of(spark, flat)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in got)
    assert {r.component: round(r.explained, 6) for r in got} == {1: 1.0, 2: 0.0, 3: 0.0}
    huge = embedding_whitening.whitening_report(vectors_of(spark, [(1, [3e38, 0.0], 1), (2, [-3e38, 1.0], 1), (3, [0.0, 2.0], 1)])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and len(huge) == 6


def test_whitened_vectors_of_other_rows(spark):
    """A fitted whitening applied to a table with more columns."""
    df = awkward(spark)
    model = embedding_whitening.fit(df, "embedding")
    out = embedding_whitening.whiten(df, model, "embedding", "w")
    assert out.columns == [*df.columns, "w"] and out.count() == len(kept(df, 4))
    assert out.select(F.size("w.whitened")).distinct().collect()[0][0] == 4


# ---- 12


def brute_codes(rows, parts, entries, rounds):
    d = len(rows[0][1])
    cuts = [p * d // parts for p in range(parts + 1)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in itertools.pairwise(cuts)]

    def best(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(itertools.pairwise(cuts)):
            groups = {}
            for _, x, _ in rows:
                groups.setdefault(best(x[a:b], books[p])[1], []).append(x[a:b])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else old for i, old in enumerate(books[p])]
    out = []
    for i, x, y in rows:
        found = [best(x[a:b], books[p]) for p, (a, b) in enumerate(itertools.pairwise(cuts))]
        out.append((i, "".join(f"{at:02x}" for _, at in found), sum(e for e, _ in found), y))
    total = {}
    for _, _, e, y in out:
        total[y] = total.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    fit = lambda v: v if v < 1 << 63 else None
    return sorted(((i, c, fit(e), fit(total[y]), sha) for i, c, e, y in out), key=repr)


@pytest.mark.parametrize(("d", "parts", "entries", "rounds"), [(4, 2, 16, 2), (6, 4, 64, 3), (5, 5, 3, 1), (16, 16, 64, 2)])
def test_vector_codes_awkward(spark, d, parts, entries, rounds):
    df = awkward(spark, d)
    got = vector_codes.codes_report(df, parts, entries, rounds)
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(kept(df, d), parts, entries, rounds)


def test_vector_codes_few_and_huge(spark):
    assert vector_codes.codes_report(vectors_of(spark, [])).count() == 0
    assert vector_codes.codes_report(vectors_of(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    for rows in ([(5, [1.0, 2.0], None)], [(i, [3e9 * i, -3e9 * i], None) for i in range(7)], [(i, [float(i % 3), 2e7 + i], i % 2) for i in range(50)]):
        df = vectors_of(spark, rows)
        assert sorted(map(tuple, vector_codes.codes_report(df, 2, 4, 2).collect()), key=repr) == brute_codes(kept(df, 2), 2, 4, 2)


@pytest.mark.parametrize("scale", [1, 1000, 1 << 24, 1 << 30, 1 << 45, 1 << 61])
def test_screening_never_loses_the_nearest(scale):
    """Entries that float32 cannot tell apart, ties, and sizes where it overflows or whole numbers would."""
    rng = np.random.default_rng(scale % 1000)
    book = rng.integers(-scale, scale + 1, (40, 4))
    book[20:] = book[:20] + rng.integers(-1, 2, (20, 4))
    x = np.concatenate([book[rng.integers(0, 40, 100)] + rng.integers(-1, 2, (100, 4)), rng.integers(-scale, scale + 1, (50, 4)), book])
    at, found = vector_codes.nearest(x, book)
    for row, i, e in zip(x.tolist(), at.tolist(), found.tolist()):
        assert (e, i) == min((sum((p - q) ** 2 for p, q in zip(row, c)), j) for j, c in enumerate(book.tolist()))


def test_whole_numbers(spark):
    df = vectors_of(spark, [(1, [-0.001, 0.0039, 1.0, -1.0], 1), (2, [3e38, -3e38, 0.0, -0.0], 1)])
    assert [r[0] for r in df.orderBy("vec_id").select(integer_vectors.whole(F.col("embedding"))).collect()] == [[-1, 0, 256, -256], [2**63 - 1, -(2**63), 0, 0]]


# ---- 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe_automaton.Encoder(*bpe_automaton.compiled(bpe_automaton.public_vocabulary()))


STRANGE = [
    "", " ", " \n\t ", "a", "A" * 700, "ab" * 300 + "!?" * 300, "it's WE'LL I'D x'S 've", "ΣΑΣ İstanbul ẞ ß ﬁ é é x́", "日本語 テスト 한국어", "🙂🙂👍🏽 <3", "<|endoftext|>hi<|startoftext|><|endoftext|> <|ENDOFTEXT|> <|x|>",
    "\x00\x1c\x85\xa0 x　y﻿z", "1234567 ½ Ⅷ ²", "naïve—“quotes” … € ‰", "x" * 49 + " " + "y" * 48, "퟿\U0010ffff",
]


def check_text(encoder, library, texts):
    for text, (ids, decoded) in zip(texts, encoder.encode_all(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text[:80]
        assert decoded == library.decode(want, skip_special_tokens=False), text[:80]


def test_strange_texts(encoder, library):
    check_text(encoder, library, STRANGE)


def test_every_character(encoder, library):
    """Alone and between letters, every code point once."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [sep.join(map(chr, points[at : at + 2048])) for at in range(0, 0x3400, 2048) for sep in ("", " ", "a")]
    texts += [" ".join(map(chr, points[at : at + 16384])) for at in range(0x3400, len(points), 16384 * 4)]
    check_text(encoder, library, texts)


def test_random_words(encoder, library):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, size))) for _ in range(60)) for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "!?.,;", "éüñ’a") for size in (3, 9, 30, 90)]
    check_text(encoder, library, texts)


def apply_merges(word, merges):
    """The merges one after the other, each from left to right."""
    symbols = [*word[:-1], word[-1] + "</w>"]
    for a, b in merges:
        i = 0
        while i + 1 < len(symbols):
            if symbols[i] == a and symbols[i + 1] == b:
                symbols[i : i + 2] = [a + b]
            i += 1
    return symbols


@pytest.mark.parametrize("seed", range(6))
def test_automaton_of_random_merges(seed):
    """Small random vocabularies with runs of one letter, against the merges applied one by one to all words of up to 7 letters."""
    rng = random.Random(seed)
    vocab = {c + end: None for end in ("", "</w>") for c in bpe_automaton.byte_labels()}
    parts, merges = ["a", "b", "a</w>", "b</w>"], []
    while len(merges) < 14:
        a, b = rng.choice([p for p in parts if not p.endswith("</w>")]), rng.choice(parts)
        if a + b not in vocab:
            vocab[a + b] = None
            parts.append(a + b)
            merges.append((a, b))
    vocab = {t: i for i, t in enumerate(vocab)}
    automaton = bpe_automaton.Automaton(vocab, merges)
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)] + ["a" * 60, "ab" * 40]
    ids, at = automaton.encode([w.encode() for w in words])
    for w, i, j in zip(words, at.tolist(), at[1:].tolist()):
        assert [automaton.label[x] for x in ids[i:j].tolist()] == apply_merges(w, merges), w


def test_arcs_are_the_right_sequences(encoder):
    """The automaton has an arc after a token exactly if the library's merges leave the two as they are."""
    a, rng = encoder.automaton, random.Random(7)
    tokens = [t for t in range(512, 49406) if a.label[t].isascii() and a.label[t].removesuffix("</w>").isalpha()]
    first = [t for t in tokens if not a.label[t].endswith("</w>")]
    pairs = [(rng.choice(first), rng.choice(tokens)) for _ in range(3000)]
    pairs += [(t, u) for t in rng.sample(first, 100) for u in rng.sample(tokens, 20) if a.label[t][-1] == a.label[u][0]]
    pairs = [(t, u) for t, u in pairs if a.label[u].endswith("</w>")]
    texts = [(a.label[t] + a.label[u]).removesuffix("</w>") for t, u in pairs]
    has = a._has(a.state[[t for t, _ in pairs]], np.array([u for _, u in pairs]))
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [lib.encode(t, add_special_tokens=False).ids == list(p) for t, p in zip(texts, pairs)] == has.tolist() and 0 < has.sum() < len(has)


def test_words_turn_over(library):
    small = bpe_automaton.Encoder(*bpe_automaton.compiled(bpe_automaton.public_vocabulary()), cache=50)
    rng = random.Random(1)
    for _ in range(20):
        check_text(small, library, [" ".join(f"w{rng.randint(0, 60)}x" + "y" * rng.choice([0, 60]) for _ in range(30)) for _ in range(3)] + STRANGE[:8])
        assert len(small.known) + len(small.older) < 400


def test_vocabularies_not_covered():
    spec = json.loads(bpe_automaton.public_vocabulary())
    for path, value in ((("model", "byte_fallback"), True), (("model", "unk_token"), "x"), (("model", "end_of_word_suffix"), None), (("decoder",), {"type": "ByteLevel"}), (("model", "merges"), spec["model"]["merges"][1:])):
        other = json.loads(bpe_automaton.public_vocabulary())
        at = other
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
        with pytest.raises(ValueError):
            bpe_automaton.compiled(json.dumps(other).encode())
    with pytest.raises(ValueError):
        bpe_automaton.Splitter({**spec, "normalizer": None})


def test_bpe_query_awkward_and_round_trip(spark, library):
    long = " ".join(f"word{i % 977} of{i}." for i in range(30_000))
    rows = [(i, t) for i, t in enumerate([*(t for t in STRANGE), None, long, long])] + [(None, "same"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, 5, "x", [1]) for i, t in rows], "doc_id long, text string, n_tokens int, decoded_sha256 string, ids array<int>")
    got = bpe_automaton.encode_digests(df, bpe_automaton.public_vocabulary()).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    ids = bpe_automaton.encode_ids(df, bpe_automaton.public_vocabulary())
    back = {(r.doc_id, r.text) for r in bpe_automaton.decode_ids(ids, bpe_automaton.public_vocabulary()).collect()}
    assert back == {(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows}
    assert bpe_automaton.encode_digests(df.limit(0), bpe_automaton.public_vocabulary()).count() == 0


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
