"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks. [native: DataFrame functions only]

1. Targets. Sources in code-point order (null last) weigh ``weights``, repeating, and share ``budget`` times all words.
   A target stops at ``cap`` times its source's words; the excess is shared anew by weight. That fixed point is a water
   level: with sources ordered by cap / weight, those below the level are capped and the others get weight * level.
2. Blocks. The shared words are cut into equal blocks, and the blocks go to sources by the highest quotients
   target / (2k - 1). Divisors slightly above and below the level bound each source's seats from both sides, so only
   about two quotients a source are ranked, however many blocks there are.
3. Shards. A source's documents are dealt by a hash into shards of about ``shard_words`` words - a source with a third
   of all rows gets a third of the shards - and the source's blocks go to its shards by the same rule.
4. Selection. A shard's documents lie end to end in seeded order. Whole passes over the shard come first; the rest of
   the quota is a run of blocks from a seeded start, round the end if need be. A document's ``taken`` words are its
   overlap with that, so whole documents are taken but for the two at the run's ends.

A block has ``block_words`` words, but a fiftieth of the smallest target where that is less, so that rounding to blocks
stays small against every target; the rule is the same at every size.

What stays on one task is a row for each source, and a row for each shard of one source - never the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; ordered like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """``sizes``: key, source_size; adds target."""
    whole = Window.partitionBy()
    by_name = Window.orderBy("key")
    by_ratio = Window.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    df = df.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    df = df.withColumn("wanted", F.lit(budget) * F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    df = df.withColumn("place", F.row_number().over(by_ratio))
    df = df.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    df = df.withColumn("capped", F.col("ratio") <= F.col("level"))
    df = df.withColumn("level", F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(whole)["level"])
    return df.select("key", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], by: str, vote: str, seats: str, name: str) -> DataFrame:
    """Adds ``name``, the seats of each row: in each group the ``seats`` highest of vote / (2k - 1), ties to the smaller ``by``."""
    own = Window.partitionBy(*group)
    df = votes.withColumn("all_votes", F.sum(F.col(vote).cast("double")).over(own)).withColumn("half", F.sum(F.when(F.col(vote) > 0, 0.5).otherwise(0.0)).over(own))

    def at(shift: Column) -> Column:
        divided = F.col(vote) * (F.col(seats) + shift) / F.col("all_votes")
        return F.when((F.col("all_votes") > 0) & (F.col(seats) + shift > 0), F.floor(divided + 0.5)).otherwise(0).cast("long")

    df = df.withColumn("sure", F.greatest(at(-F.col("half") - 1), F.lit(0).cast("long"))).withColumn("most", F.greatest(at(F.col("half") + 1), F.col("sure")))
    df = df.withColumn("open", F.col(seats) - F.sum("sure").over(own))
    seat = F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("most"))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("seat", seat)
    quotient = F.col(vote) / (2 * F.col("seat") - 1)
    ranked = Window.partitionBy(*group).orderBy(F.col("quotient").desc_nulls_last(), *([] if isinstance(by, str) and by in group else [by]))
    df = df.withColumn("quotient", quotient).withColumn("rank", F.row_number().over(ranked))
    won = F.sum(F.when(F.col("seat").isNotNull() & (F.col("rank") <= F.col("open")), 1).otherwise(0))
    keys = [*dict.fromkeys([*group, by])]
    rest = [c for c in votes.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], (F.first("sure") + won).cast("long").alias(name))


def plan(sized: DataFrame, *, weights=(5, 2, 1), budget=1.5, cap=2.0, block_words=64, shard_words=1_000_000, seed=17) -> tuple[DataFrame, DataFrame]:
    """(sources, quotas) for rows of key, size, spread: a row for each source, and one for each shard with its quota of words."""
    sources = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    whole = Window.partitionBy()
    # small tables: at least fifty blocks to the smallest target, so that rounding stays small against it
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole) / 50))).cast("long"))
    sources = sources.withColumn("all_blocks", F.coalesce(F.round(F.sum("target").over(whole) / F.col("block")), F.lit(0)).cast("long"))
    sources = sainte_lague(sources, [], "key", "target", "all_blocks", "blocks").withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = written(sources, "mix-sources")
    shards = dealt(sized, sources).groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))
    shards = sainte_lague(shards, ["key"], "shard", "shard_size", "blocks", "shard_blocks")
    # a shard takes no more than cap times its words; what rounding to blocks puts above that goes to the source's next shards with room
    shards = shards.withColumn("most", (F.lit(cap) * F.col("shard_size")).cast("long")).withColumn("due", F.col("shard_blocks") * F.col("block"))
    own = Window.partitionBy("key")
    before = own.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0).cast("long"), F.col("most") - F.col("due"))
    lost = F.sum(F.greatest(F.lit(0).cast("long"), F.col("due") - F.col("most"))).over(own) - F.coalesce(F.sum(room).over(before), F.lit(0))
    quota = F.least("due", "most") + F.greatest(F.lit(0).cast("long"), F.least(room, lost))
    start = F.when(F.col("shard_size") > 0, F.col("block") * F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.ceil(F.col("shard_size") / F.col("block")))).otherwise(0)
    return sources, shards.select("key", "shard", "shard_size", quota.alias("quota"), start.cast("long").alias("run_start"))


def dealt(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's figures and its shard."""
    return sized.join(sources, "key").withColumn("shard", F.pmod("spread", "n_shards"))


def select_blocks(sized: DataFrame, sources: DataFrame, quotas: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows of key, size, spread; the key goes."""
    rows = dealt(sized, sources).drop("block", "all_blocks", "blocks", "n_shards").join(quotas, ["key", "shard"])
    order = Window.partitionBy("key", "shard").orderBy("spread", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("to", F.sum("size").over(order)).withColumn("from", F.col("to") - F.col("size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    rows = rows.withColumn("run_end", F.col("run_start") + F.col("quota") - F.col("passes") * F.col("shard_size"))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("to"), b) - F.greatest(F.col("from"), a))

    run = overlap(F.col("run_start"), F.col("run_end")) + overlap(F.lit(0).cast("long"), F.col("run_end") - F.col("shard_size"))
    return rows.withColumn("taken", F.col("passes") * F.col("size") + run).drop("shard", "shard_size", "quota", "run_start", "run_end", "passes", "to", "from", "key")


def spread_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's seeded place: rows that share it are equal in id and text, so that any order among them gives the same mix."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def sized_rows(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", seed=17) -> DataFrame:
    size = word_count(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("key"), size.alias("size"), spread_of(F.col(doc_id), F.col(text), seed).alias("spread"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    Null or empty texts have size 0 and are never taken; a null source is a source of its own, the last one; repeated rows
    are separate documents; a null doc_id is an id like others; an empty table gives no rows; other columns are ignored,
    whatever they are called. The same table gives the same mix again (``seed``), ties included: rows in the same place are
    equal."""
    names = {k: options.pop(k) for k in ("doc_id", "text", "source") if k in options}
    sized = written(sized_rows(docs, seed=options.get("seed", 17), **names), "mix-sizes")
    sources, quotas = plan(sized, **options)
    return select_blocks(sized, sources, quotas).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, mixed: a row appears taken / size times, rounded, so not at all, once or twice. Columns stay, whatever they are called.

    The mix is made of sizes alone; a row's text meets its number of copies once, in a join on the id and its seeded place.
    Rows equal in id and text share their copies evenly, and what is left over goes to one of them."""
    seed = options.get("seed", 17)
    sized = written(sized_rows(docs, seed=seed), "mix-sizes")
    sources, quotas = plan(sized, **options)
    rows = select_blocks(sized, sources, quotas)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("long")
    alike = rows.groupBy(F.col("doc_id").alias("its_id"), F.col("spread").alias("its_place")).agg(F.count("*").alias("rows"), F.sum(times).alias("copies")).where("copies > 0")
    alike = written(alike, "mix-copies")
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("id"), spread_of(docs["doc_id"], docs["text"], seed).alias("place"))
    here = lambda some: whole.join(some, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("place") == F.col("its_place")))
    each = here(alike.where("copies >= rows")).select("row", F.floor(F.col("copies") / F.col("rows")).cast("int").alias("n"))
    rest = here(alike.where("copies % rows > 0")).dropDuplicates(["id", "place"]).select("row", (F.col("copies") % F.col("rows")).cast("int").alias("n"))
    return each.union(rest).select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
