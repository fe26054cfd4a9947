import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from foliospark.llm import jaccard
from foliospark.llm.components import connected
from foliospark.llm.shingles import shingle_sets
from foliospark.llm.common import raw_bytes
import pyarrow as pa


def sets_of(texts, size):
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()
        out.append(frozenset(b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([b" ".join(w)] if w else []))
    return out


def brute(rows, size, num, den):
    sets = sets_of([t for _, t in rows], size)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return sorted(((i, len(s), ids.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=40)
    bases = [rnd.choices(vocabulary, k=rnd.choice([3, 6, 9, 30, 80, 200])) for _ in range(60)]
    out = []
    for i in range(500):
        words = list(rnd.choice(bases if i % 3 else bases[:2]))
        if i % 7 == 0:
            words = passage + words[:6]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        text = " ".join(words)
        out.append((i, text.upper() if i % 11 == 0 else text))
    return out


@pytest.mark.parametrize("size, num, den, least", [(4, 85, 100, 2), (4, 85, 100, 10_000), (5, 80, 100, 3), (2, 60, 100, 2), (1, 50, 100, 4)])
def test_components_against_brute_force(spark, rows, size, num, den, least):
    """With ``least`` at 2 nearly all tokens are of the frequent class, so combinations carry the links; at 10,000 none is."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.components(df, size=size, num=num, den=den, least=least, share=10**9)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, size, num, den)


def test_hot_buckets_meet_in_blocks(spark, rows, monkeypatch):
    """Buckets cut into blocks of three rows find the same links; leaders are kept apart so that the last step has work."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert sorted((tuple(r) for r in jaccard.components(df, size=2, num=60, den=100, least=2, share=10**9).collect()), key=repr) == brute(rows, 2, 60, 100)


def test_pairs_of_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    parts = spark.createDataFrame([(b, n) for b, size in ((1, 30), (2, 3), (3, 9)) for n in range(size)], "bucket long, node long")
    mine, other = jaccard.paired_blocks(parts)
    met = [(r[0], *sorted(r[1:3])) for r in mine.alias("x").join(other.alias("y"), ["bucket", "meet"]).where("x.own < y.own or x.node < y.node").where("x.node <> y.node").select("bucket", "x.node", "y.node").collect()]
    assert len(met) == len(set(met)) == 30 * 29 // 2 + 3 + 36


def test_one_of_each_against_brute_force(spark):
    """Ids that repeat, in one component and in several, null ids, repeated rows, wordless rows, and a column that can't be compared."""
    a, b, c = ("w%d " * 12 % tuple(range(k, k + 12)) for k in (0, 100, 200))
    rows = [(3, a), (7, a), (7, b), (9, b), (None, c), (None, c), (None, c + "more"), (None, a), (4, None), (4, None), (4, ""), (None, " "), (11, "one two"), (11, "one two"), (12, b.upper())]
    df = spark.createDataFrame([(i, t, "x", {"k": 1}) for i, t in rows], "doc_id long, text string, mark string, extra map<string, int>").repartition(4)
    kept = jaccard.one_of_each(df, size=5, num=80, den=100)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()[:1]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, ["w0"]), (7, ["w100"]), (None, ["w200"]), (4, []), (4, []), (4, []), (None, []), (11, ["one"])], key=repr)


def test_edge_cases(spark, docs, empty):
    assert jaccard.components(empty).count() == 0
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in jaccard.components(docs).collect()), key=repr) == brute(rows, 4, 85, 100)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r[0] if r[0] is not None else -1 for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_sets_are_the_shingles():
    texts = ["a b c d e a b c d", "A  B\nc", "", None, "x", "a b c d"]
    found = shingle_sets(*raw_bytes(pa.array(texts)), 4)
    assert [len(s) for s in found] == [len(s) for s in sets_of(texts, 4)]
    assert found[5][0] in found[0]
    assert all((np.diff(s.astype(object)) > 0).all() for s in found)


def test_linked_sets_share_a_key():
    """The lemma itself, on random sets near the threshold, for many splits into classes."""
    rnd = np.random.default_rng(5)
    limits = jaccard.Limits(85, 100, 2)
    met = 0
    for _ in range(3000):
        n = int(rnd.integers(3, 90))
        a = rnd.choice(5000, n, replace=False).astype(np.uint64) << np.uint64(40)
        drop, add = rnd.integers(0, n // 8 + 2, 2)
        b = np.concatenate([a[int(drop) :], (rnd.integers(5000, 9000, int(add)).astype(np.uint64) << np.uint64(40))])
        a, b = np.unique(a), np.unique(b)
        if len(a) and len(b) and not np.array_equal(a, b) and jaccard.linked(a, b, limits):
            met += 1
            every = np.union1d(a, b)
            frequent = np.sort(rnd.choice(every, int(rnd.integers(0, len(every) + 1)), replace=False))
            assert np.intersect1d(jaccard.index_keys(a, frequent, limits), jaccard.index_keys(b, frequent, limits)).size
            wide, narrow = jaccard.sketch(a, jaccard.WIDE), jaccard.sketch(a)
            assert jaccard.least_difference(wide.tobytes(), narrow.tobytes()) == 0
            for size in (jaccard.SKETCH, jaccard.WIDE):
                assert jaccard.least_difference(jaccard.sketch(a, size).tobytes(), jaccard.sketch(b).tobytes()) <= len(np.setxor1d(a, b))
    assert met > 300


def test_connected(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_columns_of_any_name_stay(spark):
    """Names that the operator uses itself, and a null id."""
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "a"), (3, text + " eleven", "b"), (9, "other words altogether in this one here", "c"), (None, text, "d"), (7, None, "e"), (9, "other words altogether in this one here", "f")]
    names = ["__id", "__mark", "__rows", "__its_mark", "id", "mark", "rows", "row", "its_id", "its_mark", "node", "part"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = jaccard.one_of_each(df, size=5, num=80, den=100)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["source"] in "cf", r["its_mark"], r["part"]) for r in out.collect()) == [(3, False, 9, 11), (7, False, 9, 11), (9, True, 9, 11)]


@pytest.fixture
def no_broadcast(spark):
    """Only what the code itself hints at is broadcast, as on tables that are large."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_those_that_go(spark, monkeypatch, no_broadcast):
    """More documents stay than may be broadcast; the few that go are looked for, so that no text is shuffled. Where those are many too, the result is the same."""
    texts = [(i, " ".join(f"v{i}-{j}" for j in range(12))) for i in range(60)]
    df = spark.createDataFrame(texts + [(100 + i, texts[i][1]) for i in range(5)], "doc_id long, text string").repartition(3)
    for most, shuffles in ((20, False), (2, True)):
        monkeypatch.setattr(jaccard, "SMALL", most)
        kept = jaccard.one_of_each(df, size=5, num=80, den=100)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(60))
        assert ("Exchange hashpartitioning" in plan_of(kept)) == shuffles


def test_keys_are_dealt_out_once(spark, no_broadcast):
    """Counts and join read one exchange; buckets of one node go, and of two nodes whose sizes don't fit."""
    rows = [(1, 10, 1), (1, 10, 1), (2, 10, 2), (3, 10, 2), (4, 10, 3), (5, 90, 3), (4, 10, 4), (5, 90, 4), (6, 12, 4), (3, 10, 2), (7, 5, 5)]
    keyed = spark.createDataFrame(rows, "node long, n long, bucket long").repartition(3)
    met = jaccard.met_buckets(keyed, lambda x, y: 100 * F.least(x, y) >= 80 * F.greatest(x, y))
    got = sorted((r["bucket"], r["node"], r["n"], r["c"]) for r in met.collect())
    assert got == [(2, 2, 10, 3), (2, 3, 10, 3), (4, 4, 10, 3), (4, 5, 90, 3), (4, 6, 12, 3)]
    final = plan_of(met).split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1
    assert sum("Exchange hashpartitioning(bucket" in line and "ReusedExchange" not in line for line in final.splitlines()) == 1


def test_buckets_of_two_nodes_are_tried_once(spark, monkeypatch):
    """Two texts that share keys and don't link have met as leader and member; nothing of them goes into the second search."""
    seen = {}

    def noted(df, label):
        seen.setdefault(label, []).append(out := write(df, label))
        return out

    write = jaccard.written
    monkeypatch.setattr(jaccard, "written", noted)
    rnd, rows = random.Random(4), []
    for i in range(0, 40, 2):
        words = [f"{i}-{j}" for j in range(60)]
        other = list(words)
        for j in rnd.sample(range(60), 3):  # three words in fifteen shingles: too far apart
            other[j] += "x"
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.components(df, size=5, num=80, den=100).collect()), key=repr) == brute(rows, 5, 80, 100)
    assert seen["jaccard-buckets"][0].count() > 0 and not any(x.count() for x in seen["jaccard-apart"])
