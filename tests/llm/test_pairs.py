"""Near-duplicates, components and shared spans against brute force on small fixtures."""

import random

import pytest
import regex

from lectern.llm.components import components
from lectern.llm.neardup import NearDuplicates, choose, pairs_within
from lectern.llm.shingles import shingle_sets
from lectern.llm.spans import FingerprintIndex, merge_intervals, shared_spans

_TOKEN = regex.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[\p{L}\p{N}--\u3040-\u30ff\u3400-\u9fff]+", regex.V1)


def shingles(text):
    t = _TOKEN.findall(text.lower())
    return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}


def groups_of(texts, t):
    own = {i: shingles(x) for i, x in texts.items()}
    up = {i: i for i in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and own[b] and len(own[a] & own[b]) / len(own[a] | own[b]) >= t:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {(a, b) for a in own for b in own if a < b and root(a) == root(b)}


def make(n, seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "書", "類", "検", "索"]
    texts, base = {}, []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = r.choice(words) + str(r.randrange(50))
        else:
            w = [r.choice(words) + str(r.randrange(60)) for _ in range(r.randint(3, 60))]
            base.append(w)
        texts[i] = " ".join(w)
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def test_shingles_follow_the_definition():
    texts = ["", "one two three four", "A b c d e f A b c d e", "日本語の書類 x9・y", "İstanbul ΑΒΓ ½ ② a_b c d", "e\u0301 a b c d e f"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize(("patience", "hot"), [(16.0, 10_000), (0.0, 10_000), (0.0, 3)])
def test_groups_equal_brute_force(spark, patience, hot):
    texts = make(120, 3)
    got = NearDuplicates(frame(spark, texts), 0.6, patience=patience, hot_least=hot).groups()
    assert got.count() == 120
    assert {tuple(r) for r in pairs_within(got).collect()} == groups_of(texts, 0.6)


def test_a_hot_group_with_chains_loses_no_link(spark):
    """Most records are edits of one; others hang on through a member only."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(50)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(50)] = f"x{r.randrange(999)}"
        texts[i] = " ".join(w)
    for i in range(90, 100):
        texts[i] = " ".join(base[: 38 - (i - 90)] + [f"y{j}" for j in range(12)])
    got = NearDuplicates(frame(spark, texts), 0.6, patience=1.0, hot_least=30).groups()
    assert {tuple(r) for r in pairs_within(got).collect()} == groups_of(texts, 0.6)


class Counting(NearDuplicates):
    pairs = 0

    def _verify(self, pairs):
        got = super()._verify(pairs)
        self.pairs += got.count()
        return got


def test_a_shared_template_gives_no_candidates(spark):
    """Records that share 65 % of their text and have no similar pair."""
    n = 1600
    template = [f"t{i}" for i in range(130)]
    texts = {i: " ".join([*template, *(f"u{i}x{j}" for j in range(62 + i % 9))]) for i in range(n)}
    near = Counting(frame(spark, texts), 0.6)
    assert pairs_within(near.groups()).count() == 0 and near.pairs < 10 * n


def test_a_large_group_costs_its_length(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(600):
        w = list(base)
        for _ in range(2):
            w[r.randrange(80)] = f"x{i}"
        texts[i] = " ".join(w)
    near = Counting(frame(spark, texts), 0.6, patience=1.0)
    assert {x.group_id for x in near.groups().collect()} == {0} and near.pairs < 10 * len(texts)


def test_records_without_text_copies_and_extra_columns(spark):
    long = " ".join(f"t{i}" for i in range(20))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\u3000", "x"), (4, long, "y"), (5, long, None), (None, long, "z"), (6, "a b c d", "x"), (7, "a b c d", "x")]
    df = spark.createDataFrame(rows, "id long, text string, part string")
    got = NearDuplicates(df, 0.8).groups()
    assert {tuple(r) for r in pairs_within(got).collect()} == {(4, 5)}
    assert NearDuplicates(df.limit(0), 0.8).groups().count() == 0


def test_prefix_choice_keeps_the_bound():
    import numpy as np

    assert choose(10, np.array([2], np.uint32), 0.6, 8, 4.0) == (0, 0)  # nine shingles of its own are more than it may lose
    l, q = choose(10, np.array([2] * 10, np.uint32), 0.6, 8, 4.0)
    assert q == 10 - 6 + l


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (60, 50), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    assert {got[i] for i in range(41)} == {0} and got[100] == got[60] == got[50] == 50 and len(got) == 44
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(docs, win):
    where = {}
    for i, t in docs:
        for j in range(len(t) - win + 1):
            where.setdefault(t[j : j + win], set()).add(i)
    out = set()
    for i, t in docs:
        mark = [False] * len(t)
        for j in range(len(t) - win + 1):
            if len(where[t[j : j + win]]) > 1:
                mark[j : j + win] = [True] * win
        j = 0
        while j < len(t):
            if mark[j]:
                k = j
                while k < len(t) and mark[k]:
                    k += 1
                out.add((i, j, k))
                j = k
            else:
                j += 1
    return out


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (3, 4)])
def test_spans_equal_brute_force(spark, seed, batches):
    r = random.Random(seed)
    letter = lambda n: "".join(r.choice("ab c日é\U0001f600") for _ in range(n))
    parts = [letter(r.randint(10, 90)) for _ in range(8)] + ["-" * 70]
    docs = [(i, "".join(r.choice(parts) if r.random() < 0.5 else letter(r.randint(1, 40)) for _ in range(r.randint(0, 8)))) for i in range(40)]
    docs.append((99, docs[0][1]))
    df = spark.createDataFrame(docs, "id long, text string")
    index = FingerprintIndex(spark, window=30, gram=12, fanout=3)
    from pyspark.sql import functions as F

    for b in range(batches):
        index = FingerprintIndex(spark, index.root, window=30, gram=12, fanout=3)  # a later session
        index.add(df.filter(F.col("id") % batches == b))
        known = [d for d in docs if d[0] % batches <= b]
        want = {x for x in brute_spans(known, 30) if x[0] % batches == b}
        assert {tuple(x) for x in index.new_spans(df).collect()} == want
    assert {tuple(x) for x in index.spans(df).collect()} == brute_spans(docs, 30)
    with pytest.raises(ValueError):
        FingerprintIndex(spark, index.root, window=31, gram=12)


def test_spans_of_repetitive_text(spark):
    docs = [(i, "x" * i + "=" * (500 + 7 * i) + "y") for i in range(6)] + [(10 + i, ("ab" * 300)[i:]) for i in range(5)] + [(20, "q" * 400)]
    df = spark.createDataFrame(docs, "id long, text string")
    assert {tuple(x) for x in shared_spans(df, 30, 12).collect()} == brute_spans(docs, 30)


def test_spans_of_nothing_and_repeats(spark):
    text = "".join(random.Random(4).choice("abcdef") for _ in range(300))
    rows = [(1, None), (2, ""), (3, "short"), (4, text), (4, text), (5, text[:199]), (None, text)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert shared_spans(df).count() == 0
    assert shared_spans(df.limit(0)).count() == 0
    two = spark.createDataFrame([*rows, (6, "x" + text[:200]), (7, text[99:])], "id long, text string")
    assert {tuple(x) for x in shared_spans(two).collect()} == {(4, 0, 300), (6, 1, 201), (7, 0, 201)}


def test_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 2, 3), (1, 20, 22), (2, 1, 2)], "doc long, s int, e int")
    assert {tuple(x) for x in merge_intervals(df).collect()} == {(1, 0, 9), (1, 20, 22), (2, 1, 2)}
