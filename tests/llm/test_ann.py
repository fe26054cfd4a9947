import numpy as np

from foliospark.llm import ann


def brute(rows, is_query, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in good}, key=lambda n: (sum(len(v) == n for _, v in good), -n))
    good = [(i, v) for i, v in good if len(v) == size]
    return {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:k] for i, v in good if is_query(i)}


def test_recall_and_exact_scores(spark):
    rnd = np.random.default_rng(7)
    x = rnd.standard_normal((1500, 32))
    x[700:730] = x[3]  # ties
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] + [1.0] * 31), (5200, [1.0] * 8), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(df, lambda i: i % 50 == 0, query_block=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    hit = sum(len({j for _, j in got[q].values()} & {j for _, j in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        order = [found[r] for r in range(1, len(found) + 1)]
        assert order == sorted(order)
        exact = {j: s for s, j in sorted((float(np.sqrt(((x[q] - w) ** 2).sum())), j) for j, w in enumerate(x))}
        assert all(abs(exact[j] - s) < 1e-12 for s, j in order)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, lambda i: i % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(spark.createDataFrame([], schema), lambda i: i == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0])], schema), lambda i: i == 0).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    """Against brute force over rows: two queries of one id, equal and different, and clashing extra columns."""
    rnd = np.random.default_rng(11)
    x = rnd.standard_normal((60, 16))
    ids = [100, 100, 200, 200, *range(1, 57)]
    x[3] = x[2]
    rows = [(i, [float(a) for a in v], 0.5, 1) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, row int").repartition(3)
    got: dict = {}
    for r in ann.search(df, lambda i: i % 100 == 0, bound=50).collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], round(r["score"], 9)))
    want: dict = {}
    for q in range(4):
        near = sorted((float(np.sqrt(((x[q] - x[j]) ** 2).sum())), ids[j]) for j in range(60) if j != q)[:10]
        for rank, (score, j) in enumerate(near, 1):
            want.setdefault((ids[q], rank), []).append((j, round(score, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_the_index_is_not_shuffled(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(50)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shuffled: list = []
    original = ann.written

    def written(df, label):
        shuffled.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return original(df, label)

    ann.written, keep = written, ann.written
    try:
        ann.search(index, lambda i: i % 10 == 0)
    finally:
        ann.written = keep
    plan = dict(shuffled)["ann-hits"]
    assert "Exchange hashpartitioning(place" in plan and "Exchange hashpartitioning(row" not in plan and "bits" not in plan.split("Exchange hashpartitioning(place")[0]


def test_bits_and_corrections():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((50, 64))
    turn = ann.rotation(64, 3)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, far, fit = ann.coded(x, np.zeros(64), turn)
    signs = np.unpackbits(bits, axis=1).astype(float) * 2 - 1
    unit = x / far[:, None] @ turn.T
    assert np.allclose((signs / 8 * unit).sum(1), fit)
