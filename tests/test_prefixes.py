"""Longest beginnings in a corpus by sorted suffixes, against trying every length."""

import random

import pytest

from turnloom.operators.prefixes import WIDTH, longest_prefixes


def plain(text, corpus):
    """The largest n with text[:n] in a line; found by halving, as beginnings of what is found are found."""
    low, high = 0, len(text or "")
    while low < high:
        mid = (low + high + 1) // 2
        if text[:mid] in corpus:
            low = mid
        else:
            high = mid - 1
    return low


def check(spark, texts, lines, **more):
    got = longest_prefixes(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "i long, reply string, n int"), spark.createDataFrame([(x, "x") for x in lines], "line string, s string"), "i", **more)
    assert got.dtypes == [("i", "bigint"), ("length", "int"), ("prefix", "int")]
    corpus = "\n".join(x for x in lines if x)
    clean = [t if "\n" not in (t or "") else t.partition("\n")[0] for t in texts]
    assert {r["i"]: (r["length"], r["prefix"]) for r in got.collect()} == {i: (len(t or ""), plain(clean[i], corpus)) for i, t in enumerate(texts)}


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows each, some of them empty, so that neighbours and ties lie in other ranges."""
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("width", "most"), [(1, 9), (3, 9), (WIDTH, 0), (WIDTH, 10**6), (4, 10**6)])
def test_every_length(spark, many_ranges, width, most):
    """Whether heads are shipped or too many."""
    rng = random.Random(width)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["é𝄞ü" * 9, "", None, "same line of some length " * 3] + ["same line of some length " * 3] * 30
    texts = [(x or "")[rng.randint(0, 30) :][: rng.randint(0, 50)] + rng.choice(["", "z", "ab"]) for x in lines] + ["", None, "zzz", "é𝄞x", "𝄞", "same line of some length " * 4, "a", "a"]
    check(spark, texts, lines, width=width, most_heads=most)


def test_no_texts_or_no_lines(spark, many_ranges):
    check(spark, ["a", "", None], [])
    check(spark, [], ["a"])
    check(spark, ["", None], ["a"])
    check(spark, ["a" * 100], ["a" * 99, "b"])


def test_one_passage_on_every_line(spark, many_ranges):
    """A passage that all lines repeat, whose places fill many ranges, and texts that go on from it in different ways."""
    rng = random.Random(5)
    passage = "this passage stands on all of the lines, word by word, and "
    lines = [f"{i} {passage}ends in {rng.randint(0, 9999)} ways {i * 7}" for i in range(400)]
    texts = [x.partition(" ")[2][:n] + tail for x in rng.sample(lines, 60) for n, tail in ((200, ""), (70, "?"), (len(passage), "begins"))] + [passage, passage[5:] + "ends in 1", passage * 2]
    check(spark, texts, lines)


def test_a_hundred_thousand_texts(spark):
    rng = random.Random(9)
    lines = [" ".join(rng.choice("river mill corn valley stone the a of by runs stands".split()) + rng.choice(["", "", "s", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts = []
    for _ in range(100_000):
        x = rng.choice(lines)
        at = rng.randint(0, len(x))
        texts.append(x[at : at + rng.randint(0, 80)] + rng.choice(["", "z", " mill", "s"]))
    check(spark, texts, lines)


def test_texts_that_wait_over_batches(spark):
    """Sorted suffixes alone: several texts behind the last suffix of a batch are told by the first of the next."""
    rng = random.Random(11)
    words = "the river a mill corn stone by valley stands runs of".split()
    lines = [" ".join(rng.choice(words) + rng.choice(["", "s", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts = [x[at : at + rng.randint(0, 80)] + rng.choice(["", "z", " mill", "s"]) for x in rng.choices(lines, k=30_000) for at in [rng.randint(0, len(x))]]
    check(spark, texts, lines, most_bytes=0)


def test_a_trie_reads_lines_once(spark, many_ranges):
    """Few texts: the lines are neither stored nor shuffled but to deal them out; characters of several bytes count whole."""
    lines = ["é𝄞ü" * 9, "êé", "same line of some length " * 3, None, "", "a"] * 50
    texts = ["é𝄞x", "è", "ê", "êê", "𝄟", "same line", "line of some length samx", "", None, "a" * 300, "same\nline"]
    check(spark, texts, lines)
    longest_prefixes(spark.createDataFrame([(1, "same")], "i long, reply string"), spark.range(5).selectExpr("cast(id as string) as line"), "i")
    from turnloom import session

    assert not any("turnloom-lines" in x or "turnloom-merged" in x for x in session._staged[-2:])


@pytest.mark.parametrize("name", ["novelty", "quality_summary", "exact_copy"])
def test_no_suffixes_for_few_replies(spark, name):
    """The queries that share the step neither store nor sort the corpus."""
    from turnloom import session
    from turnloom.plans.quality_queries import QUERIES

    session.release(spark)
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert session._staged and not any("-merged-" in x or "-lines-" in x for x in session._staged)
    session.release(spark)


def test_few_words_are_looked_up_before_the_shuffle(spark):
    """Words of a-z of lower-cased texts, whatever stands between them; where replies have few words, the vocabulary's others aren't shuffled."""
    import re

    from turnloom.operators import quality

    texts = ["The mill's GRIST\nand\tcorn", "naïve ﬁsh café İstanbul K-elvin É", None, "", "12 a1b_c", "zz" * 500, "𝄞x𝄞y", "same same"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lowered = [r[0] or "" for r in docs.selectExpr("lower(text)").collect()]
    want = {w for t in lowered for w in re.findall("[a-z]+", t)}
    assert sorted(r["w"] for r in quality.word_vocabulary(docs).collect()) == sorted(want)
    told = quality.spelled(spark.createDataFrame([(1, "the Mill the miller"), (2, "x y q"), (3, "")], "i long, reply string"), quality.word_vocabulary(docs), "i")
    assert sorted(map(tuple, told.collect())) == [(1, 4, 3), (2, 3, 2)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.rindex("Aggregate [w") and "explode(array_distinct" not in plan
