import random

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import jaccard


def brute(docs, words, num, den):
    """doc_id -> (n_shingles, component_id) by comparing all pairs of word n-gram sets."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = {i: grams(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=50)
    docs = []
    for base in range(n // 10):
        words = rng.choices(vocabulary, k=rng.choice([2, 4, 9, 15, 30, 60, 120, 300]))
        if base % 3 == 0:
            words = words + passage
        for _ in range(10):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(copy))
                kind = rng.random()
                if kind < 0.5:
                    copy[at] = rng.choice(vocabulary)
                elif kind < 0.75 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, rng.choice(vocabulary))
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("words", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (1, 80, 100, 3), (3, 60, 100, 4)])
def test_components_equal_brute_force(spark, words, num, den, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, words, num, den).collect()}
    assert got == brute(docs, words, num, den)


@pytest.mark.parametrize(("words", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (1, 80, 100, 3)])
def test_hot_groups_equal_brute_force(spark, monkeypatch, words, num, den, seed):
    monkeypatch.setattr(jaccard, "UNIT", 3)
    monkeypatch.setattr(jaccard, "APART_UNIT", 4)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, words, num, den).collect()}
    assert got == brute(docs, words, num, den)


def test_links_come_from_trees(spark, monkeypatch):
    found = []
    join = jaccard.tree_join
    monkeypatch.setattr(jaccard, "tree_join", lambda *args: found.append(join(*args)) or found[-1])
    df = spark.createDataFrame(corpus(2), "doc_id long, text string")
    got = jaccard.components(df, 5, 80, 100).where("component_id < doc_id").count()
    exact = df.count() - df.select("text").distinct().count()
    assert sum(x.count() for x in found) >= got - exact > 0


def test_nulls_empties_repeats_and_extra_columns(spark):
    rows = [(5, "A b c d", 1), (3, "a B c d", 2), (None, "a b c d", 3), (7, None, 4), (8, " \t", 5), (9, "x", 6), (9, "x", 6), (10, "X", 7), (11, "é", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumnRenamed("node", "component_id")
    got = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df, 3, 90, 100).collect() if r.doc_id is not None)
    assert [x[1:] for x in got] == [(3, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 1, 9), (9, 1, 9), (10, 1, 9), (11, 1, 11)]
    kept = jaccard.one_of_each(df, 3, 90, 100)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 7, 8, 9, 11]
    assert jaccard.components(df.limit(0), 3, 90, 100).count() == 0


def test_sets_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z"), (4, "other text here now")]
    got = {(r.doc_id, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_similar_sets_share_a_key(num, den):
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.15]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(0, n // 10 + 2))).astype(np.uint64))))
        if jaccard.linked(a, b, num, den) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard.keys_of(a, num, den), jaccard.keys_of(b, num, den)))


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 2**63, int(rng.integers(5, 200))).astype(np.uint64)) for _ in range(12)]
    rows = []
    for i in range(150):
        s = base[i % 12]
        s = np.unique(np.concatenate((s[rng.random(len(s)) > 0.05], rng.integers(0, 2**63, 3).astype(np.uint64))))
        rows.append((i, i, s))
    up = jaccard.Union()
    for a, b in jaccard.unit_links(rows, rows, 80, 100):
        up.join(a, b)
    want = jaccard.Union()
    for i, _, x in rows:
        for j, _, y in rows[:i]:
            if jaccard.linked(x, y, 80, 100):
                want.join(i, j)
    assert [up.find(i) for i in range(150)] == [want.find(i) for i in range(150)]


@pytest.mark.parametrize("other", ["words of quite another row here", "", None])
def test_a_node_keeps_its_set_where_a_doc_id_has_other_texts(other):
    text = "one two three four five six"
    node = jaccard.name_of(jaccard.shingles(text, 3))
    for texts in ([text, other], [other, text]):
        got = jaccard.named_sets([node, node], pa.array(texts, pa.string()), 3)
        assert list(got) == [node] and np.array_equal(got[node], jaccard.shingles(text, 3))
