import random

from foliospark.llm.mixing import mix, mixed_documents, sainte_lague, targets
from pyspark.sql import functions as F


def water_fill(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Share by weight, stop at the cap, share the excess anew, until none is above."""
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] >= cap * sizes[n]}
        if not over:
            return out | share
        for n in over:
            out[n] = cap * sizes[n]
            left -= out[n]
        open_ -= over
    return out


def test_targets_are_the_fixed_point(spark):
    rnd = random.Random(3)
    for _ in range(5):
        sizes = {f"0s{i:02d}": rnd.choice([0, 5, 50, 500, 5000]) + rnd.randrange(50) for i in range(rnd.randrange(1, 12))}
        df = spark.createDataFrame(list(sizes.items()), "key string, source_size long")
        got = {r["key"]: r["target"] for r in targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = water_fill(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in sizes)


def test_seats_are_those_of_the_highest_quotients(spark):
    rnd = random.Random(5)
    for _ in range(6):
        votes = {f"p{i}": rnd.randrange(0, 1000) for i in range(rnd.randrange(1, 9))}
        seats = rnd.randrange(0, 60)
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "key string, vote long, seats long")
        got = {r["key"]: r["won"] for r in sainte_lague(df, [], "key", "vote", "seats", "won").collect()}
        quotients = sorted(((-v / (2 * k - 1), name) for name, v in votes.items() if v for k in range(1, seats + 1)))[:seats]
        want = {name: sum(q[1] == name for q in quotients) for name in votes}
        assert got == want


def test_mix_comes_near_its_targets(docs):
    rows = mix(docs).collect()
    assert len(rows) == 13
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        x = by.setdefault((r["source_size"], r["target"]), 0)
        by[r["source_size"], r["target"]] = x + r["taken"]
    for (size, target), taken in by.items():
        assert target <= 2 * size and abs(taken - target) <= 0.05 * target + 2
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix(docs).collect()), key=repr)


def test_empty_table_and_documents(docs, empty):
    assert mix(empty).count() == 0
    assert mixed_documents(empty).columns == docs.columns
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    copies = out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert copies <= 4  # the repeated row is there twice


def test_rows_that_repeat_share_their_copies(spark):
    """As many copies of each text come out as the mix of the single rows takes, with columns of any name."""
    rows = [(1, "a b c d e f g h", "x")] * 7 + [(2, "i j k l", "x")] * 2 + [(i, f"w{i} " * 12, "y") for i in range(10, 40)] + [(None, "n n n n n", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("row", "id", "place", "rows", "copies", "n", "its_id", "spread", "key")}).repartition(4)
    want = {}
    for r in mix(df).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + int(r["taken"] / r["size"] + 0.5)
    out = mixed_documents(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        assert r["copies"] == "copies" and r["spread"] == "spread"
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}
