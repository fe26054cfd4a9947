"""Periodic runs against the definition."""

import hashlib
import random
import time
import zlib

import numpy as np

from foliospark.llm import periods


def plain_runs(words, shortest=12):
    """Every stretch of every period, as the definition reads."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            a, b = i, j + q
            if j > i and b - a >= max(shortest, 2 * q) and not any(all(words[k] == words[k + p] for k in range(a, b - p)) for p in range(1, q)):
                found.append((a, b - a, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def made(r, n):
    kind = r.randrange(5)
    if kind == 0:
        return [r.randrange(2) for _ in range(n)]
    if kind == 1:
        out = []
        while len(out) < n:
            out += [r.randrange(3) for _ in range(r.randrange(1, 12))] * r.randrange(1, 5)
        return out[:n]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        p = r.randrange(1, 40)
        return [10 + i % p for i in range(n)]
    return ([0] * r.randrange(1, 30) + [1]) * 4


def test_against_the_definition():
    r = random.Random(5)
    for _ in range(1200):
        words = made(r, r.randrange(1, 110))
        shortest = r.choice([12, 12, 12, 2, 4, 5, 15, 30])
        got = periods.runs_of(np.array(words, np.int64), shortest=shortest, most=r.choice([3, 500_000]))
        assert got == plain_runs(words, shortest), (words, shortest)


def test_long_runs_of_long_periods():
    r = random.Random(7)
    text = [r.randrange(10**6) for _ in range(3000)]
    for p in (1, 6, 7, 15, 31, 64, 999):
        unit = [10**7 + i for i in range(p)]
        words = text[:500] + unit * max(2, 40 // p) + unit[: p // 3] + text[500:]
        # numbers as a document's own words have them
        assert periods.runs_of(periods.numbered(words)) == [(500, p * max(2, 40 // p) + p // 3, p)], p


def test_more_digits_than_one(monkeypatch):
    monkeypatch.setattr(periods, "DIGITS", 3)
    r = random.Random(9)
    for _ in range(200):
        words = made(r, r.randrange(12, 80))
        assert periods.runs_of(periods.numbered(words)) == plain_runs(words)


def test_hard_texts_take_little_time():
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    for words in ([0] * 200_000, b, list(range(100_000)) * 2):
        began = time.perf_counter()
        assert periods.runs_of(np.array(words, np.int64))
        assert time.perf_counter() - began < 20


def plain_row(key, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str("" if key is None else key).encode()), len(words)
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return key, len(runs), *four, digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_rows(spark, empty):
    r = random.Random(1)
    rows = [(i, " ".join(map(str, made(r, r.randrange(0, 60))))) for i in range(150)]
    rows += [(None, "a b " * 20), (None, None), (200, ""), (201, " \t\n"), (202, "漢字 é " * 9), (202, "漢字 é " * 9), (203, "x" * 50_000), (204, "no-break space " * 13), (205, "one"), (-3, "z " * 40)]
    df = spark.createDataFrame([(i, t, 1, "runs") for i, t in rows], "doc_id long, text string, start int, runs string").repartition(4)
    got = sorted((tuple(x) for x in periods.digest_rows(df).collect()), key=repr)
    assert got == sorted((plain_row(*x) for x in rows), key=repr)
    assert periods.digest_rows(empty).count() == 0


def test_texts_and_runs_of_the_operator(spark, docs):
    rows = {r["doc_id"]: r for r in periods.find_runs(docs).collect()}
    assert rows[9]["runs"][0].asDict() == {"start": 0, "length": 30_000, "period": 1} and rows[9]["collapsed"] == "long" and rows[9]["n_words"] == 30_000
    assert rows[3]["runs"] == [] and rows[3]["collapsed"] == "" and rows[5]["n_words"] == 0
