"""Importance resampling towards a target distribution, by hashed n-grams.

1. Position table. Documents are dealt out whole, by bytes; then words are exploded with their positions, a row each, and a
   window over a document's positions leads the following words in, without another exchange. A row holds the word and
   the n-grams that begin with it, and goes into a table as their bucket numbers.
2. Counts. A feature's bucket is a checksum of its bytes. Both corpora are counted by bucket, pre-aggregated before the
   exchange, so that a very common word is a few rows a task.
3. Gains. A bucket's gain is the scaled logarithm of its smoothed frequency in the target against that in the corpus. A
   row for each bucket, ``buckets`` in number, is what is broadcast; joined gains are summed by document.
4. Draw. Seeded Gumbel noise on a document's mean gain makes the highest scores a sample without replacement. Scores are
   whole thousandths of logarithms, so there are at most some ten thousand different ones at any size: documents before a
   score come from a running sum over the counts of scores, and places inside a score from a window over it alone.

Ranks don't depend on how rows are dealt. A null text is empty; a null id counts as the empty text in the noise and comes
first among ties; repeated rows are features, documents and ranks of their own; empty tables are fine on either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text whose words are sorted in one task.
TASK_BYTES = 24 << 20
#: Copies of a row that are numbered at a time.
SPAN = 4096


def words_of(text: Column) -> Column:
    """The words of a text, A to Z lowered; none for a null text."""
    return F.regexp_extract_all(F.coalesce(F.translate(text, CAPITALS, CAPITALS.lower()), F.lit("")), F.lit(WORD), F.lit(0))


def positions(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    """row, doc_id and a column for each order: the bucket of the n-gram that begins at a word, null where the text ends before it does. A text without words has one row without buckets.

    ``docs``: doc_id, text. Rows are numbered where they are read, so that repeated ones stay apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(size // TASK_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism)
    # whole documents are dealt out, which moves a text once; their words then lie where the window wants them
    rows = rows.repartition(tasks, "row").select("row", "doc_id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    place = Window.partitionBy("row").orderBy("pos")
    for k in range(2, orders + 1):
        rows = rows.withColumn(f"word{k}", F.lead("word", k - 1).over(place))
    grams = [reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col("word"), *[F.col(f"word{j}") for j in range(2, k + 1)]]) for k in range(1, orders + 1)]
    return rows.select("row", "doc_id", *[(F.crc32(g.cast("binary")) % buckets).cast("int").alias(f"gram{k + 1}") for k, g in enumerate(grams)])


def counted(table: DataFrame, orders: int, name: str) -> DataFrame:
    """bucket and ``name``, its features in ``table``; each order is counted by itself, over its own column."""
    each = [table.select(F.col(f"gram{k}").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n")) for k in range(1, orders + 1)]
    return reduce(DataFrame.union, each).groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain, a row for each bucket."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    whole = Window.partitionBy()  # over one row a bucket
    all_s, all_t = F.sum("s").over(whole), F.sum("t").over(whole)
    return both.select("bucket", F.floor(1000 * F.log((F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets)))).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, *, orders=2, buckets=10_000, seed=7, doc_id="doc_id", text="text", target_text="text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row; ``weight`` is the floored mean gain of its features, 0 where there are none."""
    corpus = written(positions(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), orders, buckets), "positions")
    aim = positions(target.select(F.lit(None).cast("long").alias("doc_id"), target[target_text].alias("text")), orders, buckets)
    gain = gains(counted(corpus, orders, "s"), counted(aim, orders, "t"), buckets)
    gain = F.broadcast(written(gain, "gains"))  # a row a bucket
    for k in range(1, orders + 1):
        corpus = corpus.join(gain.select(F.col("bucket").alias(f"gram{k}"), F.col("gain").alias(f"gain{k}")), f"gram{k}", "left")
    features = [F.count(f"gram{k}") for k in range(1, orders + 1)]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(f"gain{k}"), F.lit(0)) for k in range(1, orders + 1)])
    sums = corpus.groupBy("row", "doc_id").agg(features[0].alias("n_words"), reduce(lambda a, b: a + b, features).alias("n_features"), total.alias("total"))
    n = F.greatest("n_features", F.lit(1))
    weight = ((F.col("total") - F.pmod("total", n)) / n).cast("long")
    return sums.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """Adds rank: 1 to ``draw`` by falling score, ties to the smaller id, among the rows whose ``long`` is true; null for the others.

    Rows that are equal in every column are counted first and numbered again afterwards, so that no key's rows meet in one task."""
    columns = scored.columns
    alike = scored.groupBy(*columns).agg(F.count("*").alias("rows"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # over one row a score
    before = alike.where("long").groupBy("long", "score").agg(F.sum("rows").alias("rows")).select("long", "score", F.coalesce(F.sum("rows").over(higher), F.lit(0)).alias("before")).where(F.col("before") < draw)
    inside = Window.partitionBy("long", "score").orderBy(*[c for c in columns if c not in ("long", "score")]).rowsBetween(Window.unboundedPreceding, 0)
    placed = alike.join(F.broadcast(before), ["long", "score"], "left").withColumn("at", F.col("before") + F.sum("rows").over(inside) - F.col("rows"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / SPAN) - 1)))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.col("part") * SPAN + 1, F.least("rows", (F.col("part") + 1) * SPAN))))
    return placed.select(*columns, F.when(F.col("at") + F.col("nth") <= draw, F.col("at") + F.col("nth")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, share=25, least=20, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``: of the documents with at least ``least`` words, ``share`` of a hundred are drawn and ranked, the others' rank is null. Other options are those of ``scores``."""
    scored = written(scores(docs, target, **options), "importance").select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least).alias("long"))
    draw = scored.where("long").count() * share // 100
    return ranked(scored, draw).select("doc_id", "n_features", "weight", "score", "rank")
