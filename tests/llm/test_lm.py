import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from foliospark.llm import lm
from foliospark.llm.common import raw_bytes


def arrays(*texts):
    return raw_bytes(pa.array(texts, pa.string()))


def model_of(texts, order):
    keys, n = np.unique(lm.grams(*arrays(*texts), order), return_counts=True)
    levels = []
    for k in range(order + 1):
        own, at = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        levels.append((own, np.bincount(at, n).astype(np.int64)))
    return lm.trie(levels, len(texts))


def brute(context, symbol, counts):
    """Method C with exclusion, by recursion over the counts of every context."""
    seen = counts.get(context)
    shorter = (lambda s: 1 / 256) if not context else (lambda s: brute(context[1:], s, counts))
    if not seen:
        return shorter(symbol)
    base = sum(seen.values()) + len(seen)
    if symbol in seen:
        return seen[symbol] / base
    return len(seen) / base * shorter(symbol) / (1 - sum(shorter(s) for s in seen))


def test_costs_are_those_of_the_recursion():
    train, order = ["banana bandana", "ananas and bananas", "Band"], 3
    counts = {}
    for text in train:
        stream = bytes([lm.START] * order) + text.lower().encode() + bytes([lm.END])
        for i in range(order, len(stream)):
            for k in range(order + 1):
                counts.setdefault(stream[i - k : i], Counter())[stream[i]] += 1
    model = lm.Model(model_of(train, order))
    for text in ["banana", "xylophone", "", "and BAND and", "né"]:
        stream = bytes([lm.START] * order) + text.encode().lower() + bytes([lm.END])
        want = sum(math.log10(brute(stream[i - order : i], stream[i], counts)) for i in range(order, len(stream)))
        assert abs(model.scores(*arrays(text))[0] - want) < 1e-4


def test_probabilities_sum_to_one():
    model = lm.Model(model_of(["abracadabra", "abacus"], 2))
    for context in (b"\xff\xff", b"ab", b"zz", b"ra"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.int64)
        assert abs((10 ** model.costs(keys)).sum() - 1) < 1e-3


def test_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5000))
    table = lm.Table(keys[::2], np.arange(len(keys[::2])))
    known, value = table.find(keys)
    assert known[::2].all() and not known[1::2].any()
    assert (value[::2] == np.arange(len(keys[::2]))).all()


def test_scores_and_base(docs, empty):
    assert lm.lm_scores(empty).count() == 0
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for i, text in rows:
        if not held(i):
            counts.update((text or "").encode().lower().split())
            ends += 1
    total, v = sum(counts.values()) + ends, len(counts) + 1
    got = lm.lm_scores(docs, words=2).collect()  # with two heavy words at most, the join does the rest
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in words) + math.log10((ends + 1) / (total + v + 1))
        want.append((-1 if i is None else i, held(i), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total, round(base, 5)))
    assert sorted(want) == sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 5)) for r in got)
    assert all(r["score"] < 0 for r in got)


def test_every_gram_is_known_whatever_is_looked_up_in_place(docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = lm.Model(model_of([t or "" for i, t in rows if not held(i)], 6))
    want = sorted((-1 if i is None else i, round(float(model.scores(*arrays(t or ""))[0]), 1)) for i, t in rows)
    for nodes in (1, 2_000, 8_000_000):  # nearly nothing, some and all of it in place
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 1)) for r in lm.lm_scores(docs, nodes=nodes, shard=50).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) <= 1e-4 * abs(b) + 0.11 for (_, a), (_, b) in zip(got, want))
