"""Terminology: terms in texts, missing translations, glossaries, the store across works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.udfs import nfkc
from foliospark.operators.finder import finder

def normal(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.trim(nfkc(F.coalesce(x, F.lit(""))))


def forms(target: Column) -> Column:
    """A target and, where it ends in a particle, itself without it."""
    cut = F.substr(target, F.lit(1), F.char_length(target) - 1)
    return F.when((F.char_length(target) > 1) & F.right(target, F.lit(1)).isin("的", "地", "得"), F.array(target, cut)).otherwise(F.array(target))


ENTRY = ("ord", "source", "target", "goals", "main")


def named(glossary: DataFrame, *, first: bool = False) -> DataFrame:
    """name, entries: every source and alias with the entries it stands for: ord, source, target, goals (the target's accepted forms), main (is it the source itself?).

    ``first``: of a name's entries of one source those of the smallest ord alone, so that a name holds as many as it has sources, however often the glossary repeats them. The others never count where only a source's first entry that occurs does: wherever one occurs, so does that."""
    by = lambda a, main: F.struct(a.alias("name"), F.lit(main).alias("main"))
    names = F.explode(F.concat(F.array(by(F.col("source"), True)), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: by(a, False))))
    every = glossary.select("ord", "source", "target", forms(normal("target")).alias("goals"), names.alias("n"))
    every = every.select(normal("n.name").alias("name"), "ord", "source", "target", "goals", F.col("n.main").alias("main")).where("name <> ''")
    if first:
        every = every.withColumn("place", F.rank().over(Window.partitionBy("name", "source").orderBy("ord"))).where("place = 1").drop("place")
    return every.groupBy("name").agg(F.collect_set(F.struct(*ENTRY)).alias("entries"))


def found_entries(found: Column) -> Column:
    """What a finder of ``named`` found, as an array of the entries, each with n, how often its name occurs."""
    return F.flatten(F.transform(found, lambda x: F.transform(x["entries"], lambda e: F.struct(*[e[c].alias(c) for c in ENTRY], x["n"].alias("n")))))


def terms_in_texts(texts: DataFrame, glossary: DataFrame, **options) -> DataFrame:
    """id, ord, source for texts (id, text) and entries (ord, source, aliases) that occur in them by source or alias, once each."""
    find = finder(named(glossary.withColumn("target", F.lit(""))), **options)
    met = F.array_distinct(F.transform(found_entries(find(F.col("text"))), lambda e: F.struct(e["ord"].alias("ord"), e["source"].alias("source"))))
    return texts.select("id", F.explode(met).alias("e")).select("id", "e.ord", "e.source").distinct()


def with_missing_targets(rows: DataFrame, glossary: DataFrame, **options) -> DataFrame:
    """Adds ``missing`` to rows (src, tgt and anything else): structs source, expected, n of the terms of the source side whose target, in no accepted form, is on the target side; n is how often the source itself occurs.

    Of entries of one source the first that has a target and occurs counts, whatever its status. Rows with an empty side miss nothing."""
    entries = glossary.where("coalesce(trim(target), '') <> ''")
    sources = finder(named(entries, first=True), **options)
    there = finder(entries.select(F.explode(forms(normal("target"))).alias("name")).distinct().select("name", F.lit(0).alias("entries")), **options)
    df = rows.select("*", found_entries(sources(F.col("src"))).alias("__met"), F.transform(there(F.col("tgt")), lambda x: x["name"]).alias("__kept"), (normal("tgt") != "").alias("__said"))
    met = F.col("__met")
    first = F.filter(met, lambda x: ~F.exists(met, lambda y: (y["source"] == x["source"]) & (y["ord"] < x["ord"])))
    lost = F.filter(first, lambda x: F.col("__said") & ~F.arrays_overlap(x["goals"], F.col("__kept")))
    often = lambda x: F.coalesce(F.array_max(F.transform(F.filter(met, lambda y: (y["source"] == x["source"]) & (y["ord"] == x["ord"]) & y["main"]), lambda y: y["n"])), F.lit(0).cast("long"))
    told = F.array_distinct(F.transform(lost, lambda x: F.struct(x["source"].alias("source"), x["target"].alias("expected"), often(x).alias("n"))))
    return df.withColumn("missing", told).drop("__met", "__kept", "__said")


def missing_targets(rows: DataFrame, glossary: DataFrame, **options) -> DataFrame:
    """id, source, expected of the missing targets of rows (id, src, tgt); see ``with_missing_targets``."""
    return with_missing_targets(rows.select("id", "src", "tgt"), glossary, **options).select("id", F.explode("missing").alias("m")).select("id", "m.source", "m.expected")


def exempted(hits: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Verdicts on missing terms (unit, seq, source, occ_src, occ_tgt, digest) against exemptions (unit, source, seq, digest).

    An exemption without a place frees the unit; one whose digest no longer fits is stale; those that fit free as many
    occurrences as there are of them. What is left is hard."""
    whole = exemptions.where("seq is null").select("unit", "source").distinct().withColumn("whole", F.lit(True))
    placed = exemptions.where("seq is not null").groupBy("unit", "source", "seq", "digest").agg(F.count("*").alias("times"))
    fit = hits.join(placed, ["unit", "source", "seq", "digest"], "left").join(whole, ["unit", "source"], "left")
    stale = hits.join(placed.withColumnRenamed("digest", "its_digest"), ["unit", "source", "seq"]).where("digest <> its_digest").select("unit", "source", "seq").distinct().withColumn("stale", F.lit(True))
    fit = fit.join(stale, ["unit", "source", "seq"], "left")
    left = F.greatest(F.lit(0), F.col("occ_src") - F.col("occ_tgt") - F.least(F.coalesce("times", F.lit(0)), F.col("occ_src")))
    verdict = F.when(F.col("whole"), "exempt").when(left == 0, "exempt_located").when(F.col("stale"), "stale_and_missing").otherwise("missing")
    return fit.select("unit", "seq", "source", left.cast("long").alias("missing"), verdict.alias("verdict"))


def conflicts(glossary: DataFrame) -> DataFrame:
    """key, existing, proposed, n_targets: entries that aren't confirmed and differ from a key's standing target, which is the first confirmed one, else the first entry's."""
    g = glossary.withColumn("key", normal("source"))
    w = Window.partitionBy("key")
    ordered = w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = F.coalesce(F.col("target"), F.lit("")) != ""
    g = g.withColumn("n_targets", F.size(F.collect_set(F.when(has, F.col("target"))).over(w)).cast("long"))
    g = g.withColumn("first_confirmed", F.first(F.when((F.col("status") == "confirmed") & has, F.col("target")), ignorenulls=True).over(ordered))
    g = g.withColumn("existing", F.coalesce("first_confirmed", F.first(F.coalesce("target", F.lit(""))).over(ordered)))
    return g.where((F.col("n_targets") > 1) & (F.col("status") != "confirmed") & has & (F.col("target") != F.col("existing"))).select("key", "existing", F.col("target").alias("proposed"), "n_targets")


def standing_targets(glossary: DataFrame) -> DataFrame:
    """key, target: the first confirmed target, else the first there is."""
    g = glossary.where("coalesce(target, '') <> ''").withColumn("key", normal("source"))
    return g.groupBy("key").agg(F.min_by("target", F.struct(F.col("status") != "confirmed", F.col("ord"))).alias("target"))


MERGED = "src_lang string, tgt_lang string, key string, source string, target string, status string, aliases array<string>, note string, books array<string>, outcome string"


def merged_store(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after a batch. Rows of either: src_lang, tgt_lang, source, target, status, aliases, note, book, ord.

    An incoming row that has its key's target enriches that entry (aliases, an empty note, confirmation where no other
    target is confirmed); another target of a key with a confirmed one becomes a conflict; else it is a new entry. Rows of
    a batch see those before them, so the rows of one key - few - are folded in order, key by key."""
    import pyarrow as pa

    def fold(key, table):
        entries: list[dict] = []
        for row in sorted(table.to_pylist(), key=lambda r: (r["fresh"], r["ord"])):
            if not row["fresh"]:
                entries.append(dict(row, outcome="kept", aliases=list(row["aliases"] or []), books=[row["book"]]))
                continue
            same = next((e for e in entries if e["goal"] == row["goal"]), None)
            confirmed = [e for e in entries if e["status"] == "confirmed" and e["target"]]
            if same is None:
                status = "conflict" if confirmed else row["status"] or "seed"
                entries.append(dict(row, status=status, outcome="conflict" if confirmed else "added", aliases=list(row["aliases"] or []), books=[row["book"]]))
                continue
            new = [a for a in row["aliases"] or [] if a and a not in same["aliases"]]
            rises = row["status"] == "confirmed" and same["status"] not in ("confirmed", "conflict") and not [e for e in confirmed if e is not same]
            if new or rises or row["note"] and not same["note"]:
                same["aliases"] += new
                same["status"] = "confirmed" if rises else same["status"]
                same["note"] = same["note"] or row["note"]
                same["outcome"] = "updated" if same["outcome"] == "kept" else same["outcome"]
        names = [f.split()[0] for f in MERGED.split(", ")]
        kinds = [pa.list_(pa.string()) if "array" in f else pa.string() for f in MERGED.split(", ")]
        return pa.table({n: pa.array([e[n] for e in entries], k) for n, k in zip(names, kinds)})

    both = store.withColumn("fresh", F.lit(False)).unionByName(incoming.where("coalesce(source, '') <> '' and coalesce(target, '') <> ''").withColumn("fresh", F.lit(True)))
    both = both.withColumn("key", normal("source")).withColumn("goal", normal("target"))
    return both.groupBy("src_lang", "tgt_lang", "key").applyInArrow(fold, MERGED)


def exported(store: DataFrame, src_lang: str, tgt_lang: str, *, pending: bool) -> DataFrame:
    """One row a key of a language pair, a confirmed one first; seeds and candidates only on request, conflicts never."""
    status = ["confirmed", "seed", "candidate"] if pending else ["confirmed"]
    rows = store.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang) & F.col("status").isin(*status)).withColumn("key", normal("source"))
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.col("status") != "confirmed", "ord"))
    return rows.withColumn("n", n).where("n = 1").select("key", "source", "target", "status")


def store_stats(store: DataFrame) -> DataFrame:
    """Rows by language pair, by status and in all, with distinct keys and books."""
    s = store.withColumn("pair", F.concat_ws(">", "src_lang", "tgt_lang")).withColumn("key", normal("source"))
    sets = s.groupingSets([[F.col("pair")], [F.col("status")], []], "pair", "status")
    return sets.agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), F.countDistinct("book").alias("n_books"))


def unresolved_keys(store: DataFrame) -> DataFrame:
    s = store.where("coalesce(target, '') <> ''").select("src_lang", "tgt_lang", normal("source").alias("key"), normal("target").alias("goal"))
    return s.groupBy("src_lang", "tgt_lang", "key").agg(F.countDistinct("goal").alias("n_targets")).where("n_targets > 1")


def new_conflicts(standing: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key isn't there yet, once each; appending again adds nothing."""
    return proposed.dropDuplicates(keys).join(standing.select(*keys), keys, "left_anti")
