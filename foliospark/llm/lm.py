"""LM scoring by partial matching (PPM) over bytes.

Training. Every task counts the byte strings of length ``order + 1`` in its training documents (lower-cased A-Z, led by
``order`` start marks, closed by an end mark) and its words; the counts meet in one shuffle that grows with the corpus.
Shorter strings are suffix sums.
Every counted string is a node of the trie, which grows with the corpus: nodes of up to three bytes (2 ** 24 at most) are
sent to every task, longer ones are dealt to shards by the three bytes before the last one. All that a cost needs of a
longer string - its context's symbols, its shorter contexts - lies in the same shard. Strings with at least a ``nodes``-th
part of all training bytes have their costs looked up in place (at most ``nodes`` of them); all others, new strings too, go
to their shard, and what they cost comes back summed by document. So ``nodes`` moves work and changes no probability.

Probabilities. A context with T occurrences and D symbols gives a known symbol n / (T + D) and escapes with what is
left (method C). The escape goes to the next shorter context with the symbols already seen there excluded and the rest
made to sum to one, down to a uniform byte. So a symbol's cost is that of the longest context that knows it plus the
escapes on the way, and all of it can be looked up: documents are scored many bytes at a time.

The word base. Words with at least a ``words``-th part of all tokens are counted in place (again at most ``words`` of
them); the others, none of which can be a hot key, are joined with their counts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import id_bucket, raw_bytes, slices, written

START, END = 0xFF, 0xFE  # neither occurs in UTF-8
SHARED = 2  # longest context whose level every task has
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The order + 1 bytes up to each byte and end mark, as one number, document by document."""
    sizes = np.diff(offsets)
    n, step = len(sizes), order + 1
    stream = np.full(len(data) + n * step + 8, START, np.uint8)  # eight more, so that every window below lies inside
    stream[np.arange(len(data)) + np.repeat(np.arange(n) * step + order, sizes)] = LOWER[data]
    stream[offsets[1:] + np.arange(n) * step + order] = END
    windows = np.ndarray((len(data) + n * step - order if n else 0,), ">u8", stream, strides=(1,))
    ends = stream[order : order + len(windows)] != START
    return (windows[ends] >> np.uint64(8 * (8 - step))).astype(np.int64)


def count(batches, order: int):
    """Partial counts (gram, word, n); a row with neither counts the documents."""
    kinds = [pa.int64(), pa.binary(), pa.int64()]

    def batch(gram, word, n):
        return pa.RecordBatch.from_arrays([pa.array(gram, kinds[0]), pa.array(word, kinds[1]), pa.array(n, kinds[2])], names=["gram", "word", "n"])

    def of_words():
        out = batch(pa.nulls(len(words), kinds[0]), list(words), list(words.values()))
        words.clear()
        return out

    def of_grams(keys, n):
        for at in range(0, len(keys), 400_000):
            part = keys[at : at + 400_000]
            yield batch(part, pa.nulls(len(part), kinds[1]), n[at : at + 400_000])

    def merged():
        both, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    words: Counter = Counter()
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    documents = 0
    for whole in batches:
        for piece in slices(whole, "text", 1_000_000):
            data, offsets = raw_bytes(piece.column(0))
            documents += piece.num_rows
            parts.append(np.unique(grams(data, offsets, order), return_counts=True))
            lowered, ends = LOWER[data].tobytes(), offsets.tolist()
            for a, b in zip(ends, ends[1:]):
                words.update(lowered[a:b].split())
            if sum(len(k) for k, _ in parts) > 1_200_000:
                parts = [merged()]
                if len(parts[0][0]) > 800_000:
                    yield from of_grams(*parts.pop())
                    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            if len(words) > 300_000:
                yield of_words()
    yield from of_grams(*merged())
    yield of_words()
    yield batch([None], [None], [documents])


def suffixes(batches, order: int):
    """Partial sums (k, g, n) over the last k + 1 bytes of counted grams, for every k up to ``order``."""
    for batch in batches:
        keys, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for k in range(order, -1, -1):
            found, at = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            keys, n = found, np.bincount(at, n, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(n)], names=["k", "g", "n"])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the three bytes before the last one."""
    return ((((keys >> 8) & 0xFFFFFF) * 10368889 & 0xFFFFFF) * shards) >> 24


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers as planes of bytes, which compress well."""
    return x.astype(">i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(">i8").ravel().astype(np.int64)


def parts(keys: np.ndarray, values: np.ndarray, base: int, shards: int) -> list[dict]:
    """Keys and their values by shard; ``base`` is -1 for counts and the first uid for strings looked up."""
    shard = shard_of(keys, shards)
    at = np.lexsort((keys, shard))
    keys, values, shard = keys[at], values[at], shard[at]
    found, first = np.unique(shard, return_index=True)
    ends = [*first[1:].tolist(), len(keys)]
    return [{"shard": s, "base": base, "grams": packed(keys[a:b]), "numbers": packed(values[a:b])} for s, a, b in zip(found.tolist(), first.tolist(), ends)]


PART = "struct<shard:int,base:long,grams:binary,numbers:binary>"
PART_KIND = pa.struct([("shard", pa.int32()), ("base", pa.int64()), ("grams", pa.binary()), ("numbers", pa.binary())])


class Table:
    """Numbers looked up by 64-bit keys, many at a time: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2 + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.at = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.values = values.astype(np.float32)
        left = np.arange(len(keys))
        slot = self.slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot, the last stays
            placed = self.keys[slot] == keys[left]
            self.at[slot[placed]] = left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, value); the value of an unknown key is 0."""
        slot = self.slots(keys)
        there = self.keys[slot]
        known = there == keys
        out = np.where(known, self.values[self.at[slot]], np.float32(0)) if len(self.values) else np.zeros(len(keys), np.float32)
        rest = np.flatnonzero(~known & (there != -1))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[rest]
            known[rest[hit]] = True
            out[rest[hit]] = self.values[self.at[slot[hit]]]
            go = ~hit & (there != -1)
            rest, slot = rest[go], slot[go]
        return known, out


def trie(levels: list[tuple[np.ndarray, np.ndarray]], documents: int, shorter=()) -> list[dict]:
    """For each context length: sorted keys and log10 probabilities of kept grams, keys and log10 back-off weights of contexts.

    ``levels[k]``: sorted grams of k + 1 bytes and their counts; ``shorter``: what is known of the first levels."""
    out: list[dict] = list(shorter)
    for k, (keys, n) in list(enumerate(levels))[len(out) :]:
        n = n.astype(float)
        if not len(keys):
            out.append({"grams": keys, "log_p": n, "contexts": keys, "log_back": n})
            continue
        contexts, first = np.unique(keys >> 8, return_index=True)
        sizes = np.diff(np.append(first, len(keys)))
        kept = np.add.reduceat(n, first)
        if k == 0:
            total = kept.copy()
            below = np.full(len(keys), 1 / 256)
        else:
            short, short_n = levels[k - 1]
            at = np.minimum(np.searchsorted(short, contexts), max(0, len(short) - 1))
            total = np.where(short[at] == contexts, short_n[at], 0).astype(float)
            total = np.maximum(np.where(contexts & 0xFF == START, documents, total), kept)
            mask = (np.int64(1) << np.int64(8 * k)) - 1
            below = 10 ** out[k - 1]["log_p"][np.searchsorted(short, keys & mask)]
        base = total + sizes
        log_p = np.log10(n / np.repeat(base, sizes))
        left = np.maximum(1 - np.add.reduceat(below, first), 1e-9)
        out.append({"grams": keys, "log_p": log_p, "contexts": contexts, "log_back": np.log10((total - kept + sizes) / base / left)})
    return out


class Model:
    def __init__(self, levels: list[dict], shorter: Model | None = None):
        self.order = len(levels) - 1
        self.log_p, self.log_back = (list(shorter.log_p), list(shorter.log_back)) if shorter else ([], [])
        own = levels[len(self.log_p) :]
        self.log_p += [Table(x["grams"], x["log_p"]) for x in own]
        self.log_back += [Table(x["contexts"], x["log_back"]) for x in own]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others."""
        known, value = self.log_p[self.order].find(keys)
        out = value.astype(float)
        rest = np.flatnonzero(~known)
        own = keys[rest]
        for k in range(self.order, 0, -1):
            if not len(rest):
                return out
            out[rest] += self.log_back[k].find(own >> 8)[1]
            own = own & ((np.int64(1) << np.int64(8 * k)) - 1)
            known, value = self.log_p[k - 1].find(own)
            out[rest] += value
            rest, own = rest[~known], own[~known]
        out[rest] += self.log_back[0].find(own >> 8)[1]
        out[rest] -= math.log10(256)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each document, its end included."""
        keys = grams(data, offsets, self.order)
        if not len(offsets) - 1:
            return np.zeros(0)
        return np.add.reduceat(self.costs(keys), offsets[:-1] + np.arange(len(offsets) - 1))


def levels_of(keys: np.ndarray, n: np.ndarray, order: int, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels ``first`` to ``order`` of counted grams."""
    out = []
    for k in range(order, first - 1, -1):
        found, at = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        keys, n = found, np.bincount(at, n, len(found)).astype(np.int64)
        out.append((keys, n))
    return out[::-1]


def fit(docs: DataFrame, train, *, text="text", order=6, nodes=8_000_000, words=2_000_000, shard=400_000) -> dict:
    """The shared levels, the costs of frequent grams, the words' counts and totals, from the rows where ``train`` holds.

    ``counts`` (of words) and ``grams`` stay tables; a shard has about ``shard`` grams."""
    rows = docs.where(train).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.mapInArrow(lambda batches: count(batches, order), "gram long, word binary, n long")
    counts = written(counts.groupBy("gram", "word").agg(F.sum("n").alias("n")), "lm-counts")
    ends, tokens, different, size, distinct = counts.select(
        F.coalesce(F.sum(F.when(F.col("gram").isNull() & F.col("word").isNull(), F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)),
        F.count("word"),
        F.coalesce(F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))), F.lit(0)),
        F.count("gram"),
    ).first()
    every = counts.where("gram is not null").select("gram", "n")
    low = min(order, SHARED)
    kept = every.mapInArrow(lambda batches: suffixes(batches, low), "k int, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()
    level, gram, n = (kept[c].to_numpy() for c in ("k", "g", "n"))
    levels = []
    for k in range(low + 1):
        own = level == k
        by_key = np.argsort(gram[own])
        levels.append((gram[own][by_key].astype(np.int64), n[own][by_key].astype(np.int64)))
    every = every.withColumn("context", F.shiftright("gram", 8))
    contexts = every.groupBy("context").agg((F.sum("n") + F.count("*")).alias("base"), F.sum("n").alias("total")).where(F.col("total") * nodes >= size)
    often = every.where(F.col("n") * nodes >= size).join(contexts, "context").select("gram", F.log10(F.col("n") / F.col("base")).cast("float").alias("log_p")).toArrow()
    total = tokens + ends
    heavy = counts.where(F.col("word").isNotNull() & (F.col("n") * words >= total)).select("word", "n").toArrow()
    return {
        "order": order, "levels": levels, "trie": trie(levels, ends), "often": (often["gram"].to_numpy().astype(np.int64), often["log_p"].to_numpy()), "shards": max(12, -(-distinct // shard)), "grams": every.select("gram", "n"),
        "heavy": (heavy["word"], heavy["n"]), "counts": counts.where("word is not null").select("word", F.col("n").alias("c")), "ends": ends, "tokens": total, "vocabulary": different + (ends > 0),
    }


def count_parts(batches, shards: int):
    """Counted grams by shard, many at a time."""
    keys, n = [], []

    def batch():
        found = parts(np.concatenate(keys), np.concatenate(n), -1, shards)
        keys.clear()
        n.clear()
        return pa.RecordBatch.from_struct_array(pa.array(found, PART_KIND))

    for b in batches:
        keys.append(b.column(0).to_numpy())
        n.append(b.column(1).to_numpy())
        if sum(map(len, keys)) > 500_000:
            yield batch()
    if sum(map(len, keys)):
        yield batch()


def shard_costs(batches, levels, lower: list[dict], documents: int, order: int):
    """(uid, part): costs by document of the looked-up strings of each shard, whose counts come first."""
    shorter = Model(lower)
    shard, model, keys, n = None, None, [], []
    for b in batches:
        for i in range(b.num_rows):
            own, base, grams_, numbers = (c[i].as_py() for c in b.columns)
            if own != shard:
                shard, model, keys, n = own, None, [], []
            if base < 0:
                keys.append(unpacked(grams_))
                n.append(unpacked(numbers))
                continue
            if model is None:
                none = np.zeros(0, np.int64)
                longer = levels_of(np.concatenate([none, *keys]), np.concatenate([none, *n]), order, len(lower))
                model, keys, n = Model(trie([*levels, *longer], documents, lower), shorter), [], []
            found, at = np.unique(unpacked(numbers), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found + base), pa.array(np.bincount(at, model.costs(unpacked(grams_))))], names=["uid", "part"])


def score(docs: DataFrame, held_out, model: dict, *, doc_id="doc_id", text="text") -> DataFrame:
    """See ``lm_scores``."""
    spark, order, shards, documents = docs.sparkSession, model["order"], model["shards"], model["ends"]
    shared = spark.sparkContext.broadcast((model["often"], model["heavy"]))
    low = spark.sparkContext.broadcast((model["levels"], model["trie"]))
    ends = float(documents)
    names = ["uid", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "parts"]

    def run(batches):
        often, (word, n) = shared.value
        often = Table(*often)
        log = dict(zip(word.to_pylist(), np.log10(n.to_numpy() + 1.0).tolist()))
        uid = TaskContext.get().partitionId() << 33
        end = math.log10(ends + 1)
        rare_kind = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))
        ids, outs, scores, tokens, known, logs, rare, left, of = ([] for _ in range(9))

        def batch():
            nonlocal uid
            m = len(tokens)
            looked_up = [parts(np.concatenate(left), np.concatenate(of), uid, shards)] + [[]] * (m - 1)
            columns = [np.arange(uid, uid + m), pa.concat_arrays(ids), pa.concat_arrays(outs), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), np.concatenate(scores), pa.array(rare, rare_kind), pa.array(looked_up, pa.list_(PART_KIND))]
            uid += m
            for x in (ids, outs, scores, tokens, known, logs, rare, left, of):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

        for whole in batches:
            for piece in slices(whole, "text", 400_000):
                data, offsets = raw_bytes(piece.column(2))
                keys = grams(data, offsets, order)
                found_gram, cost = often.find(keys)
                starts = offsets[:-1] + np.arange(piece.num_rows)
                scores.append(np.add.reduceat(cost.astype(float), starts))
                rest = np.flatnonzero(~found_gram)
                left.append(keys[rest])
                of.append(np.searchsorted(starts, rest, side="right") - 1 + len(tokens))
                ids.append(piece.column(0))
                outs.append(piece.column(1))
                lowered, at = LOWER[data].tobytes(), offsets.tolist()
                for a, b in zip(at, at[1:]):
                    words = lowered[a:b].split()
                    found = [x for x in map(log.get, words) if x is not None]
                    tokens.append(len(words) + 1)
                    known.append(len(found) + (ends > 0))
                    logs.append(math.fsum(found) + end)
                    rest = Counter(w for w in words if w not in log) if len(found) < len(words) else {}
                    rare.append([{"word": w, "times": t} for w, t in rest.items()])
                if len(tokens) >= 1_000 or sum(map(len, left)) > 1_000_000:
                    yield batch()
        if tokens:
            yield batch()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = written(rows.mapInArrow(run, f"uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<word:binary,times:int>>, parts array<{PART}>"), "lm-scores")
    counted = model["grams"].mapInArrow(lambda batches: count_parts(batches, shards), "shard int, base long, grams binary, numbers binary")
    dealt = counted.unionByName(rows.select(F.explode("parts").alias("x")).select("x.*")).repartition(shards, "shard").sortWithinPartitions("shard", "base")
    costs = dealt.mapInArrow(lambda batches: shard_costs(batches, *low.value, documents, order), "uid long, part double").groupBy("uid").agg(F.sum("part").alias("part"))
    rare = rows.select("uid", F.explode("rare").alias("x")).select("uid", "x.word", "x.times").join(model["counts"], "word")
    rare = rare.groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    base = math.log10(model["tokens"] + model["vocabulary"] + 1)
    out = rows.drop("rare", "parts").join(rare, "uid", "left").join(costs, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * base).alias("base_score"), (F.col("score") + F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def lm_scores(docs: DataFrame, *, doc_id="doc_id", text="text", modulus=7, held_out=2, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    A null text is the empty text: one token, its end. Without training rows the counts are 0, so a token's base is that of
    an empty vocabulary and every byte costs 1/256. Repeated rows and null ids are rows of their own (a null id trains).
    An empty table gives no rows; texts are read whole, a few MB at a time; columns that clash with names used here are ignored."""
    out = id_bucket(F.col(doc_id), modulus) == held_out
    return score(docs, out, fit(docs, ~out, text=text, **options), doc_id=doc_id, text=text)
