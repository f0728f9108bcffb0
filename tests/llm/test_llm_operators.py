"""Each operator against a plain-Python version, and on awkward input: nulls, empty and long texts, repeated rows,
empty tables, columns with clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import ann_lists, components, license_scan, line_dedup, line_quality, mixing, ngram_join, sentencepiece_codec, shingle_sets, toxicity, url_reputation, warc_merkle

GAP = "[\x20\x09-\x0d]"
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, label long, token int, words string, line string, quality int"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def docs_of(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 7, 8, 9, "w", "l", 1) for i, t, s in rows], DOCS)


def awkward(spark):
    long = " ".join(f"word{i % 977} of{i}." for i in range(30_000))
    plain = "The mill stands by the river. It grinds the corn of the whole valley all year long. " * 4
    return docs_of(spark, [
        (1, plain, "a"), (1, plain, "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, long, "b"), (6, plain + "End.", None), (None, plain, "a"), (7, "one", "c"), (8, "a  b\n\nc", "c"),
    ])


def empty(spark):
    return docs_of(spark, [])


# ---- 1


def brute_line_dedup(rows, ratio, least):
    seen, total = Counter(), Counter()
    for _, t, s in rows:
        total[s] += 1
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[s, line] += 1
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not (x.strip(" ") and seen[s, x.strip(" ")] >= least and seen[s, x.strip(" ")] > ratio * total[s]))) for i, t, s in rows]


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["menu", "footer ", "", f"own {i}", f"own {rng.randint(0, 40)}"]) for _ in range(6)), rng.choice(["a", "a", "a", "b", None])) for i in range(200)] + [(900, None, "a"), (901, "", "b")]
    df = docs_of(spark, rows)
    got = line_dedup.drop_site_boilerplate(df, F.col("source"), "text", 0.2, 3)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["text"] is not None) == sorted(x for x in brute_line_dedup(rows, 0.2, 3) if x[1] is not None)
    assert got.where("text is null").count() == 1
    assert line_dedup.drop_site_boilerplate(awkward(spark), F.col("source"), "text").count() == 10
    assert line_dedup.drop_site_boilerplate(empty(spark), F.col("source"), "text").count() == 0


def test_page_lines(spark):
    df = spark.createDataFrame([("<p>a</p><script>x</p>y</script><b>b</b><!-- c --><div>d",), (None,)], "html string")
    assert [r[0] for r in df.select(line_dedup.page_lines(F.col("html"))).collect()] == ["\na\nb\nd", None]


# ---- 2


def test_url_rules_and_reputation(spark):
    urls = ["http://X.Net/", "https://a.example.net/en/1", "https://example.net/en", "http://example.com/de/x", "http://notexample.com/de/x", "http://q.org/fr/?a", "http://q.org?x=/fr/", "http://x.net", "nothing", None, "a://B://c/d#e"]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, bad int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_reputation.judge_pages(pages, none).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("x.net", "/", "net/", "block"), ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/en", "net/", "block"), ("example.com", "/de/x", "example.com/de/", "block"),
        ("notexample.com", "/de/x", None, "allow"), ("q.org", "/fr/", "org/fr/", "allow"), ("q.org", "", None, "allow"), ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    rows = [(i, f"http://bad.com/{i}") for i in range(60)] + [(100 + i, f"http://good.com/{i}") for i in range(60)] + [(200, "http://once.com/"), (201, "http://once.com/b")]
    outcomes = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(200, 1), (200, 1), (None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_reputation.judge_pages(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert len(got) == len(rows) and {got[i]["verdict"] for i in range(60)} == {"block"} and {got[100 + i]["verdict"] for i in range(60)} == {"allow"}
    assert got[0]["posterior"] > got[200]["posterior"] > got[100]["posterior"]  # two outcomes count less than forty
    assert url_reputation.judge_pages(pages.limit(0), none).count() == 0


def brute_posteriors(told):
    """host to (n, posterior, bound) by plain Python; told: (host, bad or None)."""
    hosts = {h: [sum(x is not None for g, x in told if g == h), sum(x or 0 for g, x in told if g == h)] for h, _ in told}
    domain_of = lambda h: ".".join(h.split(".")[-2:])
    suffix_of = lambda d: d.partition(".")[2] if "." in d else d
    known = {h: v for h, v in hosts.items() if v[0]}

    def folded(units, up):
        out = {}
        for u, (n, bad) in units.items():
            out.setdefault(up(u), [0, 0])
            out[up(u)] = [out[up(u)][0] + n, out[up(u)][1] + bad]
        return out

    def strength(units, prior):
        s = sum(n * (bad / n - prior[u]) ** 2 for u, (n, bad) in units.items())
        v = sum(prior[u] * (1 - prior[u]) for u in units)
        w = sum(prior[u] * (1 - prior[u]) * (n - 1) for u, (n, _) in units.items())
        rho = min(max(round((s - v) / w, 9) if w else 0.5, 0.001), 0.5)
        return (1 - rho) / rho

    domains = folded(known, domain_of)
    suffixes = folded(domains, suffix_of)
    overall = sum(v[1] for v in known.values()) / sum(v[0] for v in known.values())
    shrink = lambda units, k, prior: {u: (bad + k * prior[u]) / (n + k) for u, (n, bad) in units.items()}
    flat = {s: overall for s in suffixes}
    p_suffix = shrink(suffixes, strength(suffixes, flat), flat)
    by_suffix = {d: p_suffix[suffix_of(d)] for d in domains}
    p_domain = shrink(domains, strength(domains, by_suffix), by_suffix)
    k = strength(known, {h: p_domain[domain_of(h)] for h in known})
    out = {}
    for h, (n, bad) in hosts.items():
        prior = p_domain.get(domain_of(h), p_suffix.get(suffix_of(domain_of(h)), overall))
        a, b = bad + k * prior, n - bad + k * (1 - prior)
        m = a / (a + b)
        out[h] = (n, m, m - 1.645 * math.sqrt(m * (1 - m) / (a + b + 1)))
    return out


def test_every_host_is_judged(spark):
    """Hosts without labels by their domain, else suffix, else the overall rate; all figures against plain Python."""
    rows = [(100 * h + i, f"http://h{h}.{'bad.xyz' if h < 10 else 'good.com'}/{i}") for h in range(20) for i in range(40)]
    outcomes = [(p, int(p < 1000 or p % 9 == 0)) for p, _ in rows if p % 100 < 30] + [(None, 1), (77_777, 1), (5, None)]
    more = [(9000, "http://new.bad.xyz/"), (9001, "http://new.good.com/"), (9002, "http://other.xyz/"), (9003, "http://a.nowhere/"), (9004, None), (9000, "http://new.bad.xyz/")]
    pages = spark.createDataFrame([(p, u, 1) for p, u in rows + more], "page_id long, url string, bad int")
    got = url_reputation.judge_pages(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    by = {p: x for p, x in outcomes if p is not None and x is not None}
    want = brute_posteriors([((u or "").split("://")[-1].split("/")[0], by.get(p)) for p, u in rows + more])
    assert len(got) == len(rows + more)
    for r in got:
        n, posterior, bound = want[r["host"]]
        assert (r["n_labelled"], r["verdict"]) == (n, "block" if bound > 0.5 else "allow") and abs(r["posterior"] - posterior) < 2e-6 and abs(r["bound"] - bound) < 2e-6
    at = {r["page_id"]: r for r in got}
    assert at[9000]["verdict"] == "block" and at[9001]["verdict"] == "allow" and at[9000]["n_labelled"] == 0
    none = url_reputation.judge_pages(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert {(r["verdict"], r["posterior"]) for r in none} == {("allow", None)}
    assert url_reputation.judge_pages(pages.limit(0), spark.createDataFrame(outcomes, "page_id long, bad int")).count() == 0
    tied = spark.createDataFrame([(1, "http://a.b.c/")], "page_id long, url string")
    assert url_reputation.judge_pages(tied, spark.createDataFrame([], "page_id long, bad int"), rules=(("block", "b.c/"), ("allow", "a.b.c/"), ("block", "a.b.c/"))).first()["rule"] == "a.b.c/"


def test_registered_domain(spark):
    df = spark.createDataFrame([("a.b.example.com",), ("a.b.co.uk",), ("localhost",), ("",)], "h string")
    d = url_reputation.registered_domain(F.col("h"))
    assert [tuple(r) for r in df.select(d, url_reputation.suffix(d)).collect()] == [("example.com", "com"), ("b.co.uk", "co.uk"), ("localhost", "localhost"), ("", "")]


# ---- 3


def test_merkle_audit(spark):
    rng = random.Random(2)
    a = {i * rng.randint(1, 3): f"record {i}" for i in range(400)}
    b = dict(a)
    some = sorted(a)
    b[some[3]] = "changed"
    del b[some[77]]
    b[10**6] = "extra"
    make = lambda x: spark.createDataFrame([(k, v, "n") for k, v in x.items()], "at long, body string, node string")
    got = {r["node"]: r["status"] for r in warc_merkle.audit(make(a), make(b), "at", F.col("body")).collect()}
    assert got == {some[3]: "changed", some[77]: "missing", 10**6: "extra"}
    assert warc_merkle.audit(make(a), make(a), "at", F.col("body")).count() == 0
    nothing = make({0: "x"}).limit(0)
    assert warc_merkle.audit(nothing, nothing, "at", F.col("body")).count() == 0
    assert {r["status"] for r in warc_merkle.audit(make({1: "x"}), nothing, "at", F.col("body")).collect()} == {"missing"}
    twice = make({5: "x"}).union(make({5: "y"})).union(make({5: "y"}))
    null = spark.createDataFrame([(None, "z", "n"), (5, None, "n")], twice.schema)
    record = warc_merkle.warc_record(F.lit("u"), F.col("body"))
    assert warc_merkle.audit(twice.union(null), null.union(twice), "at", record).count() == 0
    assert [(r["node"], r["status"]) for r in warc_merkle.audit(twice.union(null), twice.union(null).where("body <> 'x' or body is null"), "at", record).collect()] == [(5, "changed")]
    assert [(r["node"], r["status"]) for r in warc_merkle.audit(twice.union(null), twice, "at", record).where("node = -1").collect()] == [(-1, "missing")]


# ---- 4


def brute_quality(t):
    ws = words(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(grams)
    repeated = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["the ", "mill ", "of ", "corn. ", "\n", "| ", "a&b ", "é🎉 ", "\t"]) for _ in range(rng.randint(0, 90))), "s") for i in range(150)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " ".join(f"w{i}" for i in range(50_000)), "s"), (903, "x y z x y z x y", "s")]
    got = {r["doc_id"]: r for r in line_quality.quality_columns(docs_of(spark, rows), into="q").select("doc_id", "q.*").collect()}
    for i, t, _ in rows:
        n, chars, symbols, dups, repeated = brute_quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert line_quality.quality_columns(empty(spark)).count() == 0


def test_quality_verdicts(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "slow", "light", "every", "mill"]) + str(rng.randint(0, 99)) for _ in range(30)) + "."
    good, menu = "\n".join(prose() for _ in range(4)), "\n".join(" | ".join(words(prose())) for _ in range(4))
    df = docs_of(spark, [(1, good, "s"), (2, menu, "s"), (3, good + "\n" + "Home | About | Contact | More\nAll rights reserved.", "s")])
    out = line_quality.clean_documents(df)
    assert out.columns == df.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept == {1: good, 3: good}


# ---- 5


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a"] * 12 + ["b", "c", "d", None])) for i in range(3000)]
    df = docs_of(spark, rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    got = mixing.mix_report(df).collect()
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        assert math.isclose(r["target"], want[s], rel_tol=1e-12)
    assert len(got) == 3000 and all(abs(taken[s] - want[s]) <= 45 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(df.repartition(5)).collect()))
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())


def test_mixing_awkward(spark):
    assert mixing.mix_report(awkward(spark)).count() == 10
    assert mixing.mix_report(empty(spark)).count() == 0
    blank = docs_of(spark, [(1, None, "a"), (2, " ", None)])
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_report(blank).collect()] == [(0, 0.0, 0)] * 2


# ---- 6


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, *toxicity.train(docs.select("doc_id", "text"), labels)


def test_toxicity_held_out(spark, toxic_model):
    docs, labels, lm, scorer = toxic_model
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    rows = toxicity.score_documents(docs.select("doc_id", "text"), lm, scorer).where(held).join(labels, "doc_id").collect()
    right = np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows])
    assert len(rows) > 50 and right > 0.93


def test_restoration(spark):
    """With a language model of a small world in which these words are common."""
    said = "the river runs by the mill and an idiot or a clown threw trash into the corn of the town "
    lm = toxicity.language_model(docs_of(spark, [(i, said * 20, "s") for i in range(5)]))
    r = toxicity.Restorer(lm, {"idiot": 0})
    told = {w: r.word(w) for w in ("id1ot", "i.d.i.o.t", "idiiiiot", "cl0wn", "tr@sh!!", "river", "corn,")}
    assert told == {"id1ot": "idiot", "i.d.i.o.t": "idiot", "idiiiiot": "idiot", "cl0wn": "clown", "tr@sh!!": "trash", "river": "river", "corn,": "corn"}
    spaced = r.counts("he is an i d i o t they say")
    assert spaced["idiot"] == 1


def insult_model(spark):
    said = "the river runs by the mill and a stupid idiot or a clown sat in the scum on an ass with shit and trash in the corn of the town "
    return toxicity.language_model(docs_of(spark, [(i, said * 20, "s") for i in range(5)]))


def test_restoration_of_edges_and_doubles(spark):
    """Marks at a word's edge may be letters, and a plain word may have a letter doubled."""
    wanted = {w: 0 for w in ("stupid", "scum", "clown", "ass", "idiot", "shit", "trash", "mill", "corn")}
    r = toxicity.Restorer(insult_model(spark), wanted)
    told = {"$tupid": "stupid", "$cum": "scum", "(lown": "clown", "@ss": "ass", "a$$": "ass", "@$$": "ass", "a$$!!": "ass", "!diot": "idiot", "5hi+": "shit", "$h!+!": "shit", "idiiot": "idiot", "stuupid,": "stupid"}
    told |= {"(clown)": "clown", "trash!!": "trash", "(tr@sh!)": "trash", "mill": "mill", "corn+": "corn"}
    for raw, word in told.items():
        assert r.counts(f"he is {raw} then")[word] == 1, raw
    assert {w: r.word(w) for w in ("$tupid", "(lown", "!diot", "idiiot", "mill", "(clown)", "1995")} == {"$tupid": "stupid", "(lown": "clown", "!diot": "idiot", "idiiot": "idiot", "mill": "mill", "(clown)": "clown", "1995": "1995"}


def test_wanted_marks_are_all_marks_that_are_wanted(spark):
    """What a list of wanted marks leaves out is only what isn't on it."""
    lm = insult_model(spark)
    text = "The stupid, $tupid clowns (tr@sh!) met it in a  s t u p i d  millstone; scummy 1995 ab a$$ mill über é"
    every = toxicity.Restorer(lm).counts(text)
    assert {"stupid", "stu~", "clown~", "ab", "mill~", "it"} <= set(every)
    for wanted in ({"stupid", "clown~", "mil~", "scum~"}, {"ab", "a", "über", "é", "it"}, set(every), set()):
        told = toxicity.Restorer(lm, dict.fromkeys(wanted, 0)).counts(text)
        assert told == {m: n for m, n in every.items() if m in wanted}


def test_spaced_run_is_read_to_its_end(spark):
    r = toxicity.Restorer(insult_model(spark), {"idiot": 0, "stupid": 0})
    run = " ".join("theriverrunsbythemill" * 20)
    found = r.counts(f"{run} {' '.join('idiot')} {run} {' '.join('stup1d')}")
    assert found["idiot"] == 1 and found["stupid"] == 1


def test_spaced_and_long_words_without_gates(spark):
    r = toxicity.Restorer(insult_model(spark), {"stupid": 0, "scum": 0})
    for text in ("s. t. u. p. i. d.", "he is s t u p ! d", "$ t u p i d", "st" + "u" * 60 + "pid", ".....".join("stupid") + "." * 50, "st" + "u" * 100_000 + "pid"):
        assert r.counts(text)["stupid"] == 1, text[:80]
    assert r.counts("you $ c u m")["scum"] == 1
    r.counts("_ " * 5000 + "__" * 5000 + "x")  # a search that went back over its gaps would not end


def test_viterbi_is_the_best_path(toxic_model):
    lm = toxic_model[2]
    r = toxicity.Restorer(lm)

    def best(word):
        """All paths of the lattice, one by one."""
        paths = [(0.0, (0, 0), "")]
        for i, ch in enumerate(word):
            run = next(n for n in range(1, i + 2) if n == i + 1 or word[i - n] != ch)
            drawn = run > 1 and (word[i + 1 : i + 2] == ch or run > 2)
            if ch.isalpha():
                options = [(ch, toxicity.SAME)] + ([("", toxicity.DRAWN_OUT if drawn else toxicity.DOUBLED)] if run > 1 else [])
            else:
                options = [(x, toxicity.IMITATED) for x in toxicity.IMITATES.get(ch, "")] + [("", toxicity.LOST if ch in toxicity.IMITATES else toxicity.NOISE)]
            paths = [(s + c + (lm[a][b][ord(e) - 96] if e else 0), (b, ord(e) - 96) if e else (a, b), o + e) for s, (a, b), o in paths for e, c in options]
        return max(s + lm[a][b][0] for s, (a, b), _ in paths)

    for word in ("1d!0t", "sttupp1d", "m0r.0n", "l00ser"):
        assert math.isclose(r.best_path(word)[0], best(word), rel_tol=1e-12)
    assert r.viterbi("m0r0n") == "moron"


def test_words_of_very_many_marks(toxic_model):
    """Time and room by a word's length; what a short word shows is what all its endings show."""
    r = toxicity.Restorer(toxic_model[2])
    for word in ("a" + "$@" * 50_000, "+-" * 50_000, "$@" * 50_000):
        began = time.process_time()
        r.counts(word)
        assert time.process_time() - began < 10  # 2 s on a quiet machine; every ending spelled out took hours
    word = "a" + "$@" * 6
    cuts = range(1, len(word) + 1)
    paths = sorted(((s + toxicity.NOISE * (len(word) - i), x) for (s, x), i in zip(r.endings(word, list(cuts)), cuts)), key=lambda x: -x[0])
    assert r.forms(word) == list(dict.fromkeys((toxicity.spelled(x), True) for _, x in paths))
    told = {m for _, x in r.endings("a" + "$@" * 40, list(range(1, 82))) for m in toxicity.marks(toxicity.spelled(x)) if len(m) <= 32}
    assert told <= set(r.counts("a" + "$@" * 40))


def plain_score(text, lm, words, weights):
    """The score once more, without numpy, caches, gates or heads: every word of the text by itself."""
    restorer = toxicity.Restorer(lm)
    seen, total = set(), 0
    low = (text or "").lower()
    for raw in low.split():
        shown = {m for form, whole in restorer.forms(raw) for m in ([form] if whole else []) + [form[:k] + "~" for k in range(3, min(len(form), 8))] if form}
        seen |= shown
        total += sum(m in words and not m.endswith("~") for m in shown)
    for m in toxicity.SPACED.finditer(low):
        letters = restorer.viterbi(re.sub(r"[\s._*\-]+", "", m[0]))
        left = len(low[: m.start()].rstrip(toxicity.EDGE)) if m.start() else 0
        right = len(low) - len(low[m.end() :].lstrip(toxicity.EDGE))
        alone = len(m[0].split()) == 1 and (left == 0 or low[left - 1].isspace()) and (right == len(low) or low[right].isspace())
        counted = {x for form, whole in restorer.forms(low[left:right]) for x in ([form] if whole else []) + [form[:k] + "~" for k in range(3, min(len(form), 8))]} if alone else set()
        found = [letters[i : i + n] for n in range(3, min(len(letters), 14) + 1) for i in range(len(letters) - n + 1)]
        for x in found:
            if x in words:
                if x not in counted:
                    seen.add(x)
                    total += 1
            else:  # only the first mark that is wanted counts, a beginning where the whole is none
                beginnings = [x[:k] + "~" for k in range(3, min(len(x), 8)) if x[:k] + "~" in words]
                if beginnings and beginnings[0] not in counted:
                    seen.add(beginnings[0])
    z = weights[0] + weights[1] * math.log1p(total) + weights[2] * min(1.0, 20.0 * total / max(len(low.split()), 1))
    z += sum(w for m, w in zip(words, weights[3:]) if m in seen)
    return 1 / (1 + math.exp(-z))


def test_toxicity_query_equals_its_plain_version(spark):
    """The query's rows: splits, the model's counts, and every score from the fitted weights, in plain Python."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").collect()
    counts = np.zeros((28, 28, 28))
    kind = lambda b: b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0
    for r in rows:
        c = [kind(b) for b in f" {r.text} ".encode()] if r.text else []
        for abc in zip(c, c[1:], c[2:]):
            counts[abc] += 1
    lm, scorer = toxicity.train(docs.select("doc_id", "text"), labels)
    pairs = counts.sum(0) + 0.5
    back = pairs / pairs.sum(1, keepdims=True)
    assert np.allclose(lm, np.log((counts + 5 * back) / (counts.sum(2, keepdims=True) + 5)), atol=1e-9)
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == len(rows)
    words = list(scorer.at)
    assert len(words) > 5
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        score = plain_score(r.text, lm, words, scorer.weights.tolist())
        assert math.isclose(got[r.doc_id].score, score, abs_tol=1e-6), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
    # The fit: no small step lowers the penalized loss of the learnt rows.
    toxic = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    learnt = {}
    for r in sorted((r for r in rows if r.doc_id in toxic and r.text is not None), key=lambda r: r.doc_id, reverse=True):
        learnt[r.text] = toxic[r.doc_id]
    restorer = toxicity.Restorer(lm, scorer.at)
    x = np.array([scorer.features(restorer.counts(t), len(t.split())) for t in learnt])
    y = np.array([float(v > 0) for v in learnt.values()])
    ridge = np.full(x.shape[1], 1.0)
    ridge[:3] = [1e-4, 1e-2, 1e-2]
    p = 1 / (1 + np.exp(-np.clip(x @ scorer.weights, -30, 30)))
    assert np.abs(x.T @ (y - p) - ridge * scorer.weights).max() < 1e-4


def test_toxicity_awkward(spark, toxic_model):
    labels = toxic_model[1]
    docs = awkward(spark)
    few = spark.createDataFrame([(1, 1, 9.0), (5, 0, 9.0), (None, 1, 9.0), (6, None, 9.0)], "doc_id long, toxic int, score double")
    assert toxicity.toxicity_report(docs, few).count() == 10
    assert toxicity.toxicity_report(docs, few.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity_report(empty(spark), labels).count() == 0
    kept = toxicity.drop_toxic(docs, few.limit(0))
    assert kept.columns == docs.columns and kept.count() == 10 and kept.where("score = 0.5").count() == 10
    scores = toxicity.score_documents(docs.select("doc_id", "text"), toxic_model[2], toxic_model[3]).collect()
    assert all(0 <= r["score"] <= 1 for r in scores)


# ---- 7


def shingles(t, k):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def copies(seed=6):
    """Groups of near copies of growing distance, exact copies, and unrelated texts with one common line."""
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randint(0, 3000)}" for _ in range(n)]
    rows = []
    for size, n, edits in ((90, 120, 2), (40, 200, 5), (30, 60, 1), (25, 12, 1)):
        base = fresh(n)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(n)] = f"e{rng.randint(0, 10**6)}"
            rows.append(" ".join(w))
    rows += [rows[0]] * 60 + [rows[3].upper().replace(" ", "\n")] * 5
    rows += ["One line that stands in very many texts of the corpus today.\n" + " ".join(fresh(rng.randint(5, 60))) for _ in range(120)]
    rows += [None, None, "", " ", "a", "A", "a b", "a  B", "b a"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,percent,pivots,heavy", [(3, 90, 4, 1000), (5, 80, 1, 10)])
def test_near_components(spark, k, percent, pivots, heavy):
    """Against all pairs; also with few pivots, so that round 3 has work, and with buckets cut into many parts."""
    rows = copies()
    got = ngram_join.near_components(docs_of(spark, [(i, t, "s") for i, t in rows]), k, percent, pivots=pivots, heavy=heavy).collect()
    want = brute_components(rows, k, percent)
    text = dict(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(text[r["doc_id"]], k)) for r in got)


def test_near_components_awkward(spark):
    got = ngram_join.near_components(awkward(spark), 3, 90).collect()
    assert len(got) == 10 and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7, 8: 8, None: None}
    assert ngram_join.near_components(empty(spark), 3, 90).count() == 0
    same_id = docs_of(spark, [(1, "a b c d e", "s"), (1, "x y z u v", "s"), (2, "x y z u v", "s"), (3, "a b c d e", "s")])
    assert {r["component_id"] for r in ngram_join.near_components(same_id, 3, 90).collect()} == {1}
    docs = awkward(spark)
    kept = ngram_join.drop_near_copies(docs, 3, 90)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None]))


def test_copies_under_a_repeated_id(spark):
    """No text is lost by a repeated doc_id; equal ones fall, the same whatever the partitions."""
    one, two, three = "alpha beta gamma delta epsilon zeta", "one two three four five six", "rot grün blau weiß schwarz gelb"
    rows = [(1, one, "a"), (1, two, "a"), (1, one, "b"), (2, two, "c"), (3, three, "d"), (3, three + " lila", "d"), (None, one, "e"), (4, None, "f"), (4, None, "f")]
    kept = ngram_join.drop_near_copies(docs_of(spark, rows), 3, 90)
    texts = [r["text"] for r in kept.collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [one, two, three, three + " lila", one, None]))
    again = ngram_join.drop_near_copies(docs_of(spark, rows).repartition(5), 3, 90)
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


def test_wide_maps_never_lose_a_pair():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)]))
        if len(b):
            assert ngram_join._differ(ngram_join._wide(a), ngram_join._wide(b)) <= len(np.setxor1d(a, b))


def test_shingle_sets_sizes():
    texts = ["", None, "a", "A b", "a b c a b c", "é É\tü\x0b x " * 50, "x" * 400_000, "q w e r t y " * 9000]
    for t, s in zip(texts, shingle_sets.Shingler(3).sets(texts)):
        assert len(s) == len(shingles(t, 3))
    a, b = shingle_sets.Shingler(3).sets(["The Mill by the RIVER", "zz zz\nthe mill  by the river"])
    assert set(a) < set(b)


@pytest.mark.parametrize("k", range(1, 9))
def test_shingle_sets_of_few_words(k):
    """Chunks of 0 to k words in all, and a short text that a large one follows, which closes its chunk."""
    for n in range(k + 1):
        for texts in ([" ".join("abcdefgh"[:n])], ["", " ".join("abcdefgh"[:n]), None], [w for w in "abcdefgh"[:n]]):
            assert [len(s) for s in shingle_sets.Shingler(k).sets(texts)] == [len(shingles(t, k)) for t in texts]
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = ["a b c", long, "A B c", "a b", long.upper()]
    got = list(shingle_sets.Shingler(k).sets(texts))
    assert [len(s) for s in got] == [len(shingles(t, k)) for t in texts] and len(long) > 300_000
    assert (got[0] == got[2]).all() and (got[1] == got[4]).all()


def test_near_copies_of_short_documents(spark):
    docs = docs_of(spark, [(1, "one two three", "a")])
    assert corpus_pipeline.dedup_documents(spark, docs, "").count() == 1
    docs = docs_of(spark, [(1, "one two three", "a"), (2, " ".join(f"w{i}" for i in range(60_000)), "a"), (3, "One two THREE", "b"), (4, "one two", "b")]).coalesce(1)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == [1, 2, 4]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.connected(links.limit(0)).count() == 0


# ---- 8


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece_codec.public_model()
    lib, agenda = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Agenda(model)
    rng = random.Random(8)
    for _ in range(1500):
        t = "".join(rng.choice("ab e\n\tthé▁ ①🎉<0x0A>s日本 ️i..  ") for _ in range(rng.randint(0, 30)))
        assert agenda.encode(t)[0] == lib.encode(t)
    docs = awkward(spark)
    got = sentencepiece_codec.encode_digests(docs, model).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "")
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += 1
    assert Counter(map(tuple, got)) == want
    assert sentencepiece_codec.encode_digests(empty(spark), model).count() == 0


def test_each_new_segment_is_checked():
    """One wrong merge raises, whichever segment it is in, and so does one in a long text."""
    model = sentencepiece_codec.public_model()
    segments = [sentencepiece_codec.SPACE + w for w in "the river runs by a mill and its wheel turns slowly under old stones where moss grows".split()]
    agenda = sentencepiece_codec.Agenda(model)
    right = agenda.merge_all
    for wrong in segments:
        agenda.cache.clear()
        agenda.merge_all = lambda part: [x + x[-1:] if s == wrong else x for s, x in zip(part, right(part))]
        with pytest.raises(AssertionError):
            agenda.learn(set(segments))
    agenda.merge_all = right
    agenda.cache.clear()
    agenda.learn(set(segments))
    agenda.cache[segments[1]] += agenda.cache[segments[1]]
    with pytest.raises(AssertionError):
        sentencepiece_codec._digest(["the river " * 1000], agenda)


def test_sentencepiece_round_trip(spark):
    model = sentencepiece_codec.public_model()
    docs = docs_of(spark, [(1, "Grain of the mill,\n  twice ground.", "s"), (2, "", "s")])
    back = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_ids(docs, model), model)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "Grain of the mill,\n  twice ground.", 2: ""}


def test_segments_are_merged_together():
    """Spaces split as the pattern does, ids are kept as bytes, and many short segments take few calls of the library, which still see a wrong one anywhere."""
    agenda, rng = sentencepiece_codec.Agenda(sentencepiece_codec.public_model()), random.Random(14)
    texts = ["".join(rng.choice("ab \n\0▁thé①🎉") for _ in range(rng.randint(0, 40))) for _ in range(400)] + [" a", "a ", "a  b", "a b\nc", "  ", "\0", " ".join(f"{x}{x * 7}" for x in range(3000))]
    assert all(agenda.segments(t) == (agenda.cut.findall(sentencepiece_codec.SPACE + t.replace(" ", sentencepiece_codec.SPACE)) if t else []) for t in texts)
    assert [ids.tolist() for ids in agenda.arrays(texts)] == agenda.lib.encode(texts)
    short = sorted({s for t in texts for s in agenda.segments(t) if len(s) <= sentencepiece_codec.SHORT}, key=len)
    assert all(isinstance(x, bytes) for x in agenda.cache.values()) and agenda.merge_all(short) == [agenda.merge(s) for s in short]
    calls, lib = [], agenda.lib

    class Counted:
        def encode(self, text, **how):
            calls.append(text)
            return lib.encode(text, **how)

    agenda.lib = Counted()
    agenda.cache.clear()
    agenda.learn({f"{sentencepiece_codec.SPACE}word{i}" for i in range(1600)})
    assert len(calls) == 1600 // sentencepiece_codec.TOGETHER


def test_cache_turns_over():
    model = sentencepiece_codec.public_model()
    agenda = sentencepiece_codec.Agenda(model)
    agenda.limit = 50
    texts = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(30)]
    assert [ids for ids, _ in agenda.encode_all(texts)] == agenda.lib.encode(texts)
    assert agenda.encode(texts[0])[0] == agenda.lib.encode(texts[0])


# ---- 9


def brute_licenses(rows):
    cut = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(re.findall(r"[^\W_]+", (t or "").lower()))
    known = {n: cut(b) for n, b in license_scan.TEMPLATES}
    return {(i, n, len(cut(t) & s), len(s)) for i, t in rows for n, s in known.items() if len(cut(t) & s) >= 0.8 * len(s)}


def test_license_scan(spark):
    rng = random.Random(9)
    noise = lambda: " ".join(rng.choice(["under", "the", "license", "mill", "software", "river", "general", "permission", "is"]) for _ in range(rng.randint(0, 60)))
    rows = []
    for i in range(120):
        _, body = rng.choice(license_scan.TEMPLATES)
        w = body.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, noise() + " " + " ".join(w).upper() + "\n" + noise()))
    rows += [(500, None), (501, ""), (502, "license"), (503, noise() * 300)]
    got = license_scan.scan_licenses(docs_of(spark, [(i, t, "s") for i, t in rows]))
    assert {(r["doc_id"], r["template"], r["n_shared"], r["n_template"]) for r in got.collect()} == brute_licenses(rows)
    assert license_scan.scan_licenses(empty(spark)).count() == 0
    assert license_scan.scan_licenses(awkward(spark), templates=()).count() == 0
    assert license_scan.scan_licenses(awkward(spark)).count() == 0


# ---- 10


def test_nearest(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1200, 16))
    x[300:700] = x[300]  # a third are one vector
    rows = [(i, v.tolist(), 1, 2, 3.0) for i, v in enumerate(x)]
    rows += [(5000, None, 1, 2, 3.0), (5100, [0.0] * 16, 1, 2, 3.0), (5200, [float("nan")] * 16, 1, 2, 3.0), (5300, [None] + [1.0] * 15, 1, 2, 3.0), (5400, [], 1, 2, 3.0), (5500, [1.0, 2.0], 1, 2, 3.0), (None, [1.0] * 16, 1, 2, 3.0), rows[5], rows[5], (5600, [float("inf")] * 16, 1, 2, 3.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, list int, score double")
    got = {}
    for r in ann_lists.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(range(0, 1200, 100))
    recall = []
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        assert all(r["score"] == d[r["vec_id"]] for r in found)
        recall.append(len({r["vec_id"] for r in found} & set(best)) / 10)
    assert np.mean(recall) >= 0.9
    assert [r["vec_id"] for r in sorted(got[300], key=lambda r: r["rank"])] == list(range(301, 311))
    assert ann_lists.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = ann_lists.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def clusters(n=8000, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(200, 24)) * 6
    return centres[rng.integers(0, 200, n)] + rng.normal(size=(n, 24))


def recall_of(found, x, ids, asked):
    """Mean share of the 10 true neighbours that were found."""
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    shares = []
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        shares.append(len(got[int(ids[q])] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    return float(np.mean(shares))


@pytest.mark.parametrize("lists", [None, 1500])
def test_lists_grow_and_few_are_read(spark, lists):
    """On clustered vectors a query reads a small share of the rows, also with lists made on the executors."""
    x = clusters()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, sizes = ann_lists.search(df, F.col("vec_id") % 100 == 0, "vec_id", "embedding", 10, sample=4096, lists=lists)
    asked = list(range(0, len(x), 100))
    assert recall_of(found.collect(), x, np.arange(len(x)), asked) >= 0.9
    read = sizes.selectExpr("sum(n_posted * n_asked)").first()[0]
    assert read <= 0.1 * len(x) * len(asked)


def test_recall_on_the_table_itself(spark):
    from turnloom.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = QUERIES["op10_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect()
    assert recall_of(found, x, ids, np.flatnonzero(ids % 100 == 0)) >= 0.9


# ---- pipeline


def test_pipeline(spark):
    """run() against plain Python from the toxicity stage on, whose decisions are taken from the operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()
    assert 0 < len(kept) <= docs.count()
    rows = brute_line_dedup([(r["doc_id"], r["text"], r["source"]) for r in kept], line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
    source = {r["doc_id"]: r["source"] for r in kept}
    part = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if part[i] == i]
    sizes = Counter()
    for i, t in rows:
        sizes[source[i]] += len(words(t))
    target, wanted = brute_targets(sizes), Counter()
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.public_model())
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        want, before = target[s] - whole * sizes[s], 0
        mine = Counter()
        for i, t in rows:
            if source[i] == s:
                mine[int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:4], 16)] += len(words(t))
        last = -1
        for bucket in sorted(mine):
            if 2 * before + mine[bucket] <= 2 * want:
                last = bucket
            before += mine[bucket]
        for i, t in rows:
            if source[i] == s and words(t):
                n = whole + (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:4], 16) <= last)
                if n:
                    ids = lib.encode(t)
                    wanted[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == wanted


def test_stages_on_awkward_documents(spark, tmp_path):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, str(tmp_path))
            assert out.count() <= 40
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
