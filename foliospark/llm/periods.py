"""Periodic runs of words: maximal repetitions, found by block matching and exact extension.

A run is a stretch of words with smallest period q, at least ``shortest`` and 2 q long, that no neighbouring word extends.
Words are numbers within their document.

A run repeats at least ``shortest`` / 2 words in a row, so a document without two equal stretches of that length has none
and is done after a look at hashes. For the others:

1. Blocks. A run of period q and length L repeats L - q words at distance q, and any 2 B - 1 consecutive words hold one
   block of B words that begins at a multiple of B. So each period belongs to one power of two: the largest B with
   2 B - 1 <= max(q, shortest - q), and to find all its runs it is enough to find the aligned blocks of that size again at
   distance q.
2. Matching. An Aho-Corasick automaton over integer sequences holds the different aligned blocks of a size, a block being
   the numbers of its two halves from the size before, and reads the document's numbers once, so that each size costs one
   pass. Automata hold ``most`` blocks at a time. A block whose half doesn't occur elsewhere can't either, which leaves few
   blocks of ordinary text after the first sizes.
3. Seeds. An occurrence and an aligned block of the same content at a distance of that size are a seed; there are at most
   some 2 n a size, however often the document repeats itself. Distances are taken in ascending order. A seed inside a run
   whose period divides its distance belongs to that run, so that it's left out, as are seeds inside the last stretch of
   their own distance.
4. Extension. Every other seed is extended word by word to both sides, exactly. A stretch that is long enough is a run, and
   its distance is its smallest period: a smaller one would divide it (Fine and Wilf), and the run with that one would have
   taken the seed.

Documents are independent of each other, so nothing is shuffled. A null text has no words. Work is about n log n in a
document's words.
"""

from __future__ import annotations

import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.common import slices, texts

#: Children of an automaton's node, at most.
DIGITS = 256


def sizes_of(n: int, shortest: int) -> dict[int, list[tuple[int, int]]]:
    """Block size to the ranges of distances that belong to it, for periods up to n / 2."""
    found: dict[int, list[tuple[int, int]]] = {}
    q = 1
    while 2 * q <= n:
        size = 1 << ((max(q, shortest - q) + 1) // 2).bit_length() - 1
        # the rest of the distances of this size, where it's the period that decides
        last = 4 * size - 2 if 2 * q >= shortest else q
        found.setdefault(size, []).append((q, min(last, n // 2)))
        q = last + 1
    return found


def digits(numbers: np.ndarray, largest: int) -> np.ndarray:
    """A row of digits for each number, as many as ``largest`` needs; 0 is a row of zeros."""
    known, columns = numbers > 0, []
    while largest or not columns:
        columns.append(np.where(known, numbers % DIGITS + 1 + DIGITS * len(columns), 0))
        numbers, largest = numbers // DIGITS, largest // DIGITS
    return np.stack(columns, 1)


def named(names: np.ndarray, half: int, starts: np.ndarray, most: int):
    """For the aligned blocks of two halves that begin at ``starts``: (their contents' numbers, places, contents' numbers there), by content and place.

    ``names``: the number of the ``half`` words from each place on, 0 where they are no half of a repeated block. The places
    are read in steps of ``half``, one remainder after the other with a 0 between, so that the halves of a block are neighbours.
    A number is spelled in digits, those of each place with values of their own: a node's children are searched one by one."""
    steps = -(-len(names) // half) + 1
    table = np.zeros(steps * half, np.int64)
    table[: len(names)] = names
    sequence = tuple(digits(table.reshape(steps, half).T.ravel(), size := int(names.max())).ravel().tolist())
    pairs, own = np.unique(names[starts] * (size + 1) + names[starts + half], return_inverse=True)
    keys = list(map(tuple, np.hstack([digits(pairs // (size + 1), size), digits(pairs % (size + 1), size)]).tolist()))
    wide = len(keys[0]) // 2
    ends, found = [], []
    for first in range(0, len(keys), most):
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i in range(first, min(first + most, len(keys))):
            machine.add_word(keys[i], i)
        machine.make_automaton()
        for end, i in machine.iter(sequence):
            ends.append(end)
            found.append(i)
    remainder, step = np.divmod(np.array(ends, np.int64) // wide, steps)
    places, contents = (step - 1) * half + remainder, np.array(found, np.int64)
    order = np.lexsort((places, contents))
    return own, places[order], contents[order]


def seeds_of(ranges, aligned, own, places, contents, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, start) of every aligned block and every later occurrence of its content at a distance in ``ranges``."""
    base = contents * (n + 1) + places
    at = own * (n + 1) + aligned
    distances, starts = [], []
    for low, high in ranges:
        left, right = np.searchsorted(base, at + low), np.searchsorted(base, np.minimum(at + high, own * (n + 1) + n), side="right")
        count = np.maximum(right - left, 0)
        which = np.repeat(np.arange(len(at)), count)
        hit = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + left[which]
        starts.append(aligned[which])
        distances.append(places[hit] - aligned[which])
    return np.concatenate([np.zeros(0, np.int64), *distances]), np.concatenate([np.zeros(0, np.int64), *starts])


def equal_from(words: np.ndarray, i: int, d: int) -> int:
    """How many words from i on equal those d later."""
    n, length, step = len(words) - d, 0, 16
    while i + length < n:
        same = words[i + length : min(n, i + length + step)] == words[i + length + d : min(n, i + length + step) + d]
        if not same.all():
            return length + int(same.argmin())
        length, step = length + len(same), 2 * step
    return length


def equal_before(words: np.ndarray, i: int, d: int) -> int:
    """How many words before i equal those d later."""
    length, step = 0, 16
    while length < i:
        low = max(0, i - length - step)
        same = words[low : i - length] == words[low + d : i - length + d]
        if not same.all():
            return length + int(same[::-1].argmin())
        length, step = length + len(same), 2 * step
    return length


class Runs:
    """Runs by period; of one period they neither nest nor overlap by a period, so the last that begins before a place is the only one that can hold it."""

    def __init__(self):
        self.by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def put(self, period: int, found: list[tuple[int, int]]) -> None:
        if found:
            self.by_period[period] = tuple(np.array(sorted(found), np.int64).T)

    def hold(self, d: int, starts: np.ndarray, size: int) -> np.ndarray:
        """Which of the stretches of d + size words lie in a run whose period divides d."""
        held = np.zeros(len(starts), bool)
        for p, (first, end) in self.by_period.items() if len(self.by_period) < 64 else [(p, self.by_period[p]) for p in divisors(d) if p in self.by_period]:
            if d % p == 0:
                last = np.searchsorted(first, starts, side="right") - 1
                held |= (last >= 0) & (end[last] >= starts + d + size)
        return held

    def hold_some(self, distances: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """The same for many distances at once, by the runs of the 64 smallest periods."""
        held = np.zeros(len(starts), bool)
        for p in sorted(self.by_period)[:64]:
            first, end = self.by_period[p]
            last = np.searchsorted(first, starts, side="right") - 1
            held |= (distances % p == 0) & (distances > p) & (last >= 0) & (end[last] >= starts + distances + widths)
        return held

    def rows(self) -> list[tuple[int, int, int]]:
        """(start, length, period), ascending by start, then period."""
        return sorted((a, b - a, p) for p, (first, end) in self.by_period.items() for a, b in zip(first.tolist(), end.tolist()))


def divisors(d: int) -> list[int]:
    low = [p for p in range(1, int(d**0.5) + 1) if d % p == 0]
    return sorted({*low, *(d // p for p in low)})


def repeats(words: np.ndarray, width: int) -> bool:
    """May some ``width`` words in a row occur twice? False only if none do: equal stretches have equal sums."""
    sums = np.zeros(len(words) - width + 1, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for j in range(width):
        sums = sums * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + len(sums)]
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def runs_of(words: np.ndarray, *, shortest=12, most=500_000) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document's numbered words, by start, then period."""
    n = len(words)
    found = Runs()
    if n < max(2, shortest) or not repeats(words, (shortest + 1) // 2):
        return []
    # a name is the number of a content that occurs twice at least; 0 stands for any other
    names, width = np.where(np.bincount(words)[words] > 1, words + 1, 0), 1
    waiting: list[tuple[np.ndarray, np.ndarray, int]] = []
    sizes = sizes_of(n, shortest)
    if 1 in sizes:  # with ``shortest`` under 5 only
        places = np.argsort(words, kind="stable")
        waiting.append((*seeds_of(sizes[1], np.arange(n), words, places, words[places], n), 1))
    while 2 * width <= max(sizes):
        half, width = width, 2 * width
        starts = np.arange(n // width) * width
        starts = starts[(names[starts] > 0) & (names[starts + half] > 0)]
        if not len(starts):
            break
        own, places, contents = named(names, half, starts, most)
        if width in sizes or waiting:
            waiting.append((*seeds_of(sizes.get(width, []), starts, own, places, contents, n), width))
            if width * 4 - 2 >= shortest:  # the distances of smaller sizes lie between those of the next ones
                grow(words, waiting, found, shortest)
                waiting = []
        often = np.bincount(contents)[contents] > 1
        names = np.zeros(n, np.int64)
        names[places[often]] = contents[often] + 1
    grow(words, waiting, found, shortest)
    return found.rows()


def grow(words: np.ndarray, seeds, found: Runs, shortest: int) -> None:
    """Adds the runs that the seeds (distances, starts, block size) belong to, by ascending distance."""
    if not seeds:
        return
    distances, starts = np.concatenate([d for d, _, _ in seeds]), np.concatenate([s for _, s, _ in seeds])
    width = np.concatenate([np.full(len(d), size, np.int64) for d, _, size in seeds])
    free = np.flatnonzero(~found.hold_some(distances, starts, width))  # most of them where the document is one long run
    order = free[np.lexsort((starts[free], distances[free]))]
    distances, starts, width = distances[order], starts[order], width[order]
    edges = np.flatnonzero(np.concatenate([[True], distances[1:] != distances[:-1]])) if len(distances) else []
    for a, b in zip(edges, [*edges[1:], len(distances)]):
        d, size = int(distances[a]), int(width[a])
        own = starts[a:b]
        own = own[~found.hold(d, own, size)]
        stretches, reached = [], -1
        at = 0
        while at < len(own):
            i = int(own[at])
            first, end = i - equal_before(words, i, d), i + size + equal_from(words, i + size, d) + d
            if end - first >= max(shortest, 2 * d):
                stretches.append((first, end))
            reached = end - d
            at = int(np.searchsorted(own, reached - size, side="right"))
        found.put(d, stretches)


def numbered(words: list) -> np.ndarray:
    number: dict = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


def kept(n: int, runs) -> np.ndarray:
    """Which words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def repeated_tail(words: list, doc_id) -> list:
    """The words of the document as they count here: of one document in ten, by a checksum of its id, the words from some place on repeat with some period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find_runs(docs: DataFrame, *, doc_id="doc_id", text="text", shortest=12, most=500_000, prepare=None) -> DataFrame:
    """doc_id, n_words, ``runs`` (structs start, length, period by start, then period) and ``collapsed``, the text without the words that a run repeats, of every row.

    ``prepare(words, doc_id)`` may change a document's words first. A null or empty text has no words, no runs and an
    empty ``collapsed``; null ids pass; repeated rows are rows of their own with equal results; an empty table gives no
    rows. Texts are read whole, and columns that clash with names used here are ignored."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(raw: bytes, key) -> tuple[int, list, str]:
        words = raw.split()  # at ASCII white space
        if prepare:
            words = prepare(words, key)
        runs = runs_of(numbered(words), shortest=shortest, most=most)
        stays = words if not runs else [w for w, k in zip(words, kept(len(words), runs).tolist()) if k]
        return len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(stays).decode()

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [one(raw, key) for raw, key in zip(texts(batch.column(1)), batch.column(0).to_pylist())]
                n, runs, left = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return source.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest_rows(docs: DataFrame, **options) -> DataFrame:
    """The longest run and digests of all of them and of the collapsed text, over documents with ``repeated_tail``; see ``find_runs``."""
    from pyspark.sql import functions as F

    found = find_runs(docs, prepare=repeated_tail, **options)
    # the longest; of equal ones the first by start, then period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
