"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

from foliospark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, orders, buckets):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, orders=2, buckets=10_000, share=25, least=20, seed=7):
    s, t, rows = Counter(), Counter(), []
    for _, text in docs:
        s.update(features(text, orders, buckets)[1])
    for text in target:
        t.update(features(text, orders, buckets)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((float(t[b]) + 1) * (whole_s + buckets) / ((float(s[b]) + 1) * (whole_t + buckets)))) for b in s}
    for key, text in docs:
        n, found = features(text, orders, buckets)
        weight = math.floor(Fraction(sum(gain[b] for b in found), len(found))) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    long = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    drawn = share * len(long) // 100
    out = [(*r[:4], None) for r in rows if not r[4]] + [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(long)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, row string, bucket int, score int").repartition(5)


def test_against_a_plain_version(spark):
    r = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "über", "漢字", "x1", "42", "é", "ÄB", "ſ", "naïve", "🙂"]
    docs = [(i, " ,.".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(120)]
    docs += [(3, "same text " * 15)] * 9 + [(None, "alpha beta " * 20)] * 7 + [(500, None), (501, ""), (502, "...\n"), (None, None), (-7, "minus " * 30)]
    target = ["alpha beta gamma " * 4, None, "", "über 漢字"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for options in ({}, {"orders": 1}, {"orders": 3, "buckets": 97, "share": 60, "least": 5, "seed": 1}):
        got = sorted((tuple(x) for x in importance.resample(table(spark, docs), aim, **options).collect()), key=repr)
        assert got == plain(docs, target, **options)


def test_copies_of_a_row_share_no_rank(spark, monkeypatch):
    monkeypatch.setattr(importance, "SPAN", 4)
    docs = [(1, "one two three " * 10)] * 41
    got = importance.resample(table(spark, docs), table(spark, docs).limit(0), share=50).collect()
    assert len(got) == 41 and sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 21))


def test_empty_tables_and_odd_texts(spark, docs, empty):
    none = importance.resample(empty, docs)
    assert none.count() == 0 and [(c, k) for c, k in none.dtypes] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    rows = importance.resample(docs, empty).collect()
    assert len(rows) == docs.count()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in rows), key=repr) == plain(texts, [])
