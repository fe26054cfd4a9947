"""N-gram Jaccard join with token-combination prefixes.

Two sets link when ``den`` * |both| >= ``num`` * |either| (tokens are word shingles). Tokens have one global order: rare
class first, frequent class last, by hash within a class. With x any set, o = ceil(t |x|) the least overlap it can link
with, and d the greatest symmetric difference it can have with a set it links with:

* linked sets share a token among the first |x| - o + 1 of each. Rare tokens there are indexed singly.
* sets whose first |x| - o + 1 tokens hold frequent ones extend the prefix to |x| - o + l, where linked sets share at
  least l tokens; l = (k - 1)(d + 1) + 1. If a shared token is rare, the single index has it. Else the at most d
  differences cut the shared frequent tokens, in their order, into at most d + 1 runs, one of which holds k: so the
  combinations of k neighbouring frequent tokens are indexed - a linear number, and no link is lost.
* a set too small to share l tokens has all its prefix indexed singly; sets that need equality are found as copies.

The class only orders tokens, so it needn't be exact: a token is frequent when it repeats within spans of a few thousand
documents and those repeats make up a fixed share of all documents, which bounds how many there are.

Equal sets are one node. Buckets of one node drop out in an aggregation. In each bucket the node that shares most is its
leader; (leader, member) pairs are verified on the texts' whole sets, and components contracted. Then every pair of a
bucket that still lies in different components is a candidate too, so no link is lost, while a group of mutual copies
costs a pair for each member and not all pairs. Of those candidates only pairs whose sketches allow a link leave the
join: a sketch has a bit for each residue of the hash, the parity of the tokens there, so the bits in which two sketches
differ are at most the tokens in which the sets do. A sixteenth of the buckets goes first, so that most groups are one
component before the others are looked at. A node is known by 64 bits of its set's digest (two different sets of n meet
by chance with probability n^2 / 2^65).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import raw_bytes, slices, written
from foliospark.llm.components import connected
from foliospark.llm.shingles import digest, mixed, shingle_sets


class Limits:
    """What the threshold says of a set of n tokens."""

    def __init__(self, num: int, den: int, k: int):
        self.num, self.den, self.k = num, den, k

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + 1

    def overlap(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def difference(self, n: int) -> int:
        """Of |x| + |y| - 2 |both|, with |y| at most n / t and |both| at least t / (1 + t) of both sizes."""
        most = n + n * self.den / self.num
        return int((self.den - self.num) / (self.den + self.num) * most + 1e-9)

    def shared(self, n: int) -> int:
        return (self.k - 1) * (self.difference(n) + 1) + 1

    def lonely(self, n: int) -> bool:
        """No different set can link: one difference is already too much, |both| / (|both| + 1) < t with |both| <= n."""
        return self.den * n < self.num * (n + 1)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, limits: Limits) -> np.ndarray:
    """Bucket keys of a set (ascending): its rare prefix tokens, and runs of k frequent ones."""
    n = len(tokens)
    if not n or limits.lonely(n):
        return tokens[:0]
    short = limits.prefix(n)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    else:
        common = np.zeros(n, bool)
    if not common.any():
        return tokens[:short]
    rare, often = tokens[~common], tokens[common]
    if len(rare) >= short:
        return rare[:short]
    shared = limits.shared(n)
    if limits.overlap(n) < shared:
        return np.concatenate([rare, often])[: min(n, n - limits.overlap(n) + shared)]
    run = often[: max(0, n - limits.overlap(n) + shared - len(rare))]
    keys = np.zeros(max(0, len(run) - limits.k + 1), np.uint64)
    for j in range(limits.k):
        keys = mixed(keys + run[j : j + len(keys)] + np.uint64(j + 1))
    return np.concatenate([rare, keys])


def linked(a: np.ndarray, b: np.ndarray, limits: Limits) -> bool:
    if limits.den * min(len(a), len(b)) < limits.num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return limits.den * both >= limits.num * (len(a) + len(b) - both)


SKETCH = 512


#: Bits of a wide sketch, for sets of over WIDE_FROM tokens: eight bits to each of the narrow one's.
WIDE, WIDE_FROM = 8 * SKETCH, 300


def sketch(tokens: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parities of the tokens by the top bits of their hash, packed."""
    bits = np.bincount((tokens >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8))


def least_difference(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ: no more than the tokens in which the sets do. A wide one is folded for a narrow one."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        fold = lambda z: np.packbits(np.bitwise_xor.reduce(np.unpackbits(z).reshape(SKETCH, -1), axis=1))
        x, y = (fold(z) if len(z) * 8 > SKETCH else z for z in (x, y))
    return int(np.unpackbits(x ^ y).sum())


def plausible(pairs: DataFrame, entries: DataFrame, limits: Limits) -> DataFrame:
    """The pairs (a, b) whose wide sketches allow a link, written out: what must be compared as texts."""

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            num, den = limits.num, limits.den
            keep = [i for i in range(len(a)) if (den + num) * least_difference(x[i], y[i]) <= (den - num) * (n[i] + m[i])]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    nodes = small(written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-nodes"))
    marks = entries.where("wide is not null").join(nodes, "node", "left_semi").select("node", "n", "wide").dropDuplicates(["node"])
    marks = written(marks, "jaccard-sketches")
    right = marks.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y")).join(small(pairs), "b")
    both = right.join(marks.select(F.col("node").alias("a"), "n", F.col("wide").alias("x")), "a")
    return written(both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-pairs")


def repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that come more than once in ``parts``, ascending, and how often. ``parts`` is emptied; there is one sorted copy besides it."""
    tokens = np.concatenate([np.zeros(0, np.uint64), *parts])
    parts.clear()
    tokens.sort()
    again = np.zeros(len(tokens) + 1, bool)  # is a token the one before it?
    np.equal(tokens[1:], tokens[:-1], out=again[1:-1])
    edges = np.flatnonzero(again[1:] != again[:-1])
    return tokens[edges[::2]], edges[1::2] - edges[::2] + 1


def frequent_tokens(rows: DataFrame, size: int, limits: Limits, least: int, share: int, span: int = 4_000_000) -> np.ndarray:
    """Tokens of the frequent class, ascending: those that repeat within spans of ``span`` tokens, where the repeats come to ``least`` documents and to 1 / ``share`` of all."""

    def run(batches):
        documents, held, parts = 0, 0, []

        def repeats():
            keys, n = repeated(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["token", "n"])

        for whole in batches:
            for piece in slices(whole, "text", 1_500_000):
                documents += piece.num_rows
                sets = [s for s in shingle_sets(*raw_bytes(piece.column(0)), size) if not limits.lonely(len(s))]
                parts += sets
                held += sum(map(len, sets))
                if held > span:
                    yield repeats()
                    held = 0
        yield repeats()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([documents], pa.int64())], names=["token", "n"])

    counts = written(rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "jaccard-counts")
    documents = (counts.where("token is null").first() or [None, 0])[1]
    enough = max(least, documents // share)
    found = counts.where(f"token is not null and n >= {enough}").select("token").toArrow()["token"].to_numpy()
    return np.sort(np.asarray(found, np.int64).view(np.uint64))


def verified(pairs: DataFrame, texts: DataFrame, size: int, limits: Limits) -> DataFrame:
    """The pairs (a, b) whose whole sets link, written out; ``texts``: node, text."""

    def run(batches):
        last, mine = None, np.zeros(0, np.uint64)
        for whole in batches:
            for piece in slices(whole, "text_b", 1_500_000):
                a, b = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                others = shingle_sets(*raw_bytes(piece.column(3)), size)
                good = []
                for i, node in enumerate(a):
                    if node != last:
                        mine = shingle_sets(*raw_bytes(piece.column(2).slice(i, 1)), size)[0]
                        last = node
                    good.append(linked(mine, others[i], limits))
                keep = [i for i, g in enumerate(good) if g]
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(small(pairs), "b")
    leaders = small(written(pairs.select("a").distinct(), "jaccard-leaders"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(leaders, "a")
    both = right.join(left, "a")
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "jaccard-links")


#: Rows of a few numbers that may be broadcast: some 16 MB of hash table at most. Beyond that the join shuffles.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def needed_texts(pairs: DataFrame, members: DataFrame, rows: DataFrame, repeats: bool) -> DataFrame:
    """node and text of one document for each node in ``pairs``. ``repeats``: some rows have the same id and text."""
    nodes = small(written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-nodes"))
    chosen = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("one"))
    chosen = small(written(chosen.select("node", F.col("one.doc_id").alias("id"), F.col("one.mark").alias("its_mark")), "jaccard-chosen"))
    found = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its_mark"))).select("node", "text")
    return written(found.dropDuplicates(["node"]) if repeats else found, "jaccard-texts")


#: Rows of a bucket that meet in one task; larger buckets are cut into blocks of about so many, and pairs of blocks meet.
BLOCK = 256


def paired_blocks(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the self join within a bucket, as rows with ``bucket`` and ``meet``: two rows of a bucket have exactly one meeting in common, whatever blocks they are in, so a hot bucket's pairs spread over tasks."""
    sizes = parts.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = parts.join(small(sizes.where("blocks > 1")), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # the one side meets all blocks from its own on, the other all up to its own; each meeting is (lower block, higher block)
    lower = cut.withColumn("with", F.explode(F.filter(others, lambda b: b >= F.col("own")))).withColumn("meet", F.col("own") * F.col("blocks") + F.col("with"))
    higher = cut.withColumn("with", F.explode(F.filter(others, lambda b: b <= F.col("own")))).withColumn("meet", F.col("with") * F.col("blocks") + F.col("own"))
    return lower.drop("blocks", "with"), higher.drop("blocks", "with")


def met_buckets(keyed: DataFrame, fits) -> DataFrame:
    """bucket, node, n and c (the bucket's rows) of the buckets where two nodes meet; two alone must fit by their sizes.

    The keys are most of what the join moves. They are dealt out by bucket once, and both the counts and the join read that
    one exchange, for which they must name the same columns."""
    dealt = keyed.repartition("bucket")
    counts = dealt.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("c"))
    shared = counts.where((F.col("low") != F.col("high")) & ((F.col("c") > 2) | fits(F.col("least"), F.col("most")))).select("bucket", "c")
    return dealt.join(shared, "bucket").distinct()


def components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; options as in ``placed``.

    A null or wordless text has the empty set, links with nothing and is a component of its own (its doc_id). A component's
    id is its smallest doc_id that isn't null. Repeated rows are equal sets and so one component; rows that repeat an id
    with other texts are documents of their own. An empty table gives no rows, texts are read whole, and columns that clash
    with names used here are ignored."""
    found = placed(docs, **options)
    full, empty = found.where("part is not null"), found.where("part is null")
    # written, so that the join has a plain shuffle on either side and a component of very many rows can be split
    least_id = written(full.groupBy("part").agg(F.min("doc_id").alias("component_id")), "jaccard-ids")
    out = full.join(least_id, "part").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(empty.select("doc_id", "n", "doc_id"))


def placed(docs: DataFrame, *, doc_id="doc_id", text="text", size=4, num=85, den=100, k=2, least=8, share=30_000) -> DataFrame:
    """doc_id, mark (a hash of the text), n and part of every row: rows of one component share ``part``, which is null for the empty set."""
    limits = Limits(num, den, k)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frequent = frequent_tokens(rows, size, limits, least, share)
    rows = rows.withColumn("mark", F.xxhash64("text"))

    def index(batches):
        seen: set[int] = set()
        for whole in batches:
            for piece in slices(whole, "text", 1_500_000):
                sets = shingle_sets(*raw_bytes(piece.column(1)), size)
                nodes = [digest(s) if len(s) else None for s in sets]
                keys, marks, wide = [], [], []
                for s, node in zip(sets, nodes):
                    again = node is None or node in seen
                    keys.append(None if again else index_keys(s, frequent, limits).view(np.int64))
                    marks.append(None if again else sketch(s).view(np.int64))
                    wide.append(None if again else sketch(s, WIDE if len(s) > WIDE_FROM else SKETCH).tobytes())
                    if len(seen) < 200_000:
                        seen.add(node)
                n = pa.array(list(map(len, sets)), pa.int64())
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(nodes, pa.int64()), n, pa.array(keys, long), pa.array(marks, long), pa.array(wide, pa.binary())], names=["doc_id", "mark", "node", "n", "keys", "sketch", "wide"])

    entries = written(rows.select("doc_id", "text", "mark").mapInArrow(index, "doc_id long, mark long, node long, n long, keys array<long>, sketch array<long>, wide binary"), "jaccard-index")
    members = entries.select("doc_id", "mark", "node", "n")
    repeats = members.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count() > 0
    fits = lambda x, y: (den * F.least(x, y) >= num * F.greatest(x, y))
    meeting = written(met_buckets(entries.where("keys is not null").select("node", "n", F.explode("keys").alias("bucket")), fits), "jaccard-buckets")

    most = meeting.groupBy("node").agg(F.sum("c").alias("weight"))
    leaders = meeting.join(most, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("one")).select("bucket", F.col("one.node").alias("leader"), F.col("one.n").alias("leader_n"))
    led = meeting.join(leaders, "bucket").where((F.col("node") != F.col("leader")) & fits(F.col("n"), F.col("leader_n")))
    stars = written(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "jaccard-pairs")
    near = plausible(stars, entries, limits)
    links: DataFrame = verified(near, needed_texts(near, members, rows, repeats), size, limits)
    labels = connected(links)

    # what still lies apart in a bucket, and may link by its sketches
    words = [f"s{i}" for i in range(SKETCH // 64)]
    sketches = entries.where("keys is not null").select("node", *[F.col("sketch")[i].alias(w) for i, w in enumerate(words)])
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for part in (F.pmod(F.xxhash64("bucket"), F.lit(16)) == 0, F.lit(True)):
        parts = meeting.where(part).join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("part"))
        # the one pair of a bucket of two nodes has been tried with its leader
        apart = parts.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("nodes")).where("p <> q and nodes > 2").select("bucket")
        parts = written(parts.join(apart, "bucket", "left_semi"), "jaccard-apart")
        parts = written(parts.join(sketches.join(parts.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node"), "jaccard-apart")
        mine, other = paired_blocks(parts)
        other = other.select("bucket", "meet", *[F.col(c).alias(f"{c}_b") for c in other.columns if c not in ("bucket", "meet")])
        differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
        may = (den + num) * differ <= (den - num) * (F.col("n") + F.col("n_b"))
        # within a block each pair meets twice and is taken once; between blocks it meets once
        once = (F.col("own") < F.col("own_b")) | (F.col("node") < F.col("node_b"))
        rest = mine.join(other, ["bucket", "meet"]).where(once & (F.col("node") != F.col("node_b")) & (F.col("part") != F.col("part_b")) & fits(F.col("n"), F.col("n_b")) & may)
        rest = rest.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
        rest = written(rest.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        if rest.limit(1).count():
            near = plausible(rest, entries, limits)
            more = verified(near, needed_texts(near, members, rows, repeats), size, limits)
            tried = tried.union(rest)
            if more.limit(1).count():
                links = links.union(more)
                labels = connected(links)

    return written(members.join(labels, "node", "left").select("doc_id", "mark", "n", F.coalesce("component", "node").alias("part")), "jaccard-placed")


def one_of_each(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One document of each component, that of the smallest id (null last), then of the smallest hash of its text; columns stay, of any type.

    Documents without words are in no component, and all their rows stay. Rows that repeat an id with other texts are
    documents of their own; of rows equal in id and text one stays."""
    found = placed(docs, doc_id=doc_id, text=text, **options)
    full = found.where("part is not null")
    best = full.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("one"), F.count("*").alias("c")).where("c > 1")
    best = small(written(best.select("part", F.col("one.doc_id").alias("first_id"), F.col("one.mark").alias("first_mark")), "jaccard-first"))
    chosen = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    several = full.join(best, "part").groupBy(F.col("doc_id").alias("id"), "mark").agg(F.max(chosen).alias("chosen"), F.count("*").alias("rows"))
    several = written(several, "jaccard-several")
    # the row is one column, so that whatever its columns are called doesn't meet the names used here
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs[doc_id].cast("long").alias("its_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("its_mark"))
    same = F.col("its_id").eqNullSafe(F.col("id")) & (F.col("its_mark") == F.col("mark"))
    # the rows that go are looked for, not those that stay: they are few, so that texts needn't be shuffled
    kept = whole.join(small(several.where("not chosen").select("id", "mark")), same, "left_anti")
    again = several.where("chosen and rows > 1").select("id", "mark")
    if again.limit(1).count():
        again = small(again)
        once = kept.join(again, same, "left_semi").dropDuplicates(["its_id", "its_mark"])
        kept = kept.join(again, same, "left_anti").union(once)
    return kept.select("row.*")
