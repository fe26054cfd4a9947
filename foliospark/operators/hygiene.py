"""Text hygiene and repair signals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import markup, udfs
from foliospark.functions import text as t

# Fixed values of these rules, which aren't those of other rules: marks of broken encodings, words by which a block goes on,
# marks that end a sentence and that may close it, abbreviations that end in a full stop but no sentence, tails that want
# more, pairs of quotation marks and brackets, and Latin words that stand in any prose.
GARBLED = "�|Ã[\u0080-¿]|â€|ï¿½"
CONTINUES = r"^\s*(?:[a-zà-ÿ]|[“‘«(（，、；;：]|(?:并且|而且|但是|然而|因此|所以|以及|或者|而是|同时|此外|即|则|也|还|又|而))"


def repair_signals(docs: DataFrame) -> DataFrame:
    """unit and six counts: hard_wrap_lines, hyphen_eol, duplicate_paras, garbled_marks, ascii_punct_cjk, long_latin_run. Headings, lists, quotations, tables and lone images don't count as prose."""
    blocks = F.filter(F.transform(F.split(F.regexp_replace(F.col("text"), r"^\n+|\n+$", ""), r"\n\s*\n"), lambda b: F.filter(F.split(b, r"\R"), lambda x: t.stripped(x) != "")), lambda b: F.size(b) > 0)

    def every(b, pattern):
        return F.forall(b, lambda x: t.stripped(x).rlike(pattern))

    prose = F.filter(blocks, lambda b: ~(t.stripped(b[0]).startswith("#") | every(b, r"^(?:[-*+]|\d+[.)])\s+") | every(b, "^>") | every(b, r"^\|") | ((F.size(b) == 1) & t.stripped(b[0]).rlike(r"^!\[[^\]]*\]\([^)]*\)$"))))
    df = docs.select("unit", "text", prose.alias("prose"))
    inner = F.transform("prose", lambda b: F.slice(b, F.lit(1), F.size(b) - 1))
    wrapped = F.aggregate(inner, F.lit(0).cast("long"), lambda a, b: a + F.size(F.filter(b, lambda x: ~t.right_stripped(x).rlike("[。！？；…!?;]$"))))
    hyphens = F.aggregate("prose", F.lit(0).cast("long"), lambda a, b: a + F.size(F.filter(b, lambda x: t.right_stripped(x).rlike("[A-Za-z]-$"))))
    paragraphs = F.transform("prose", lambda b: F.array_join(F.transform(b, t.stripped), ""))
    return df.select(
        "unit", wrapped.alias("hard_wrap_lines"), hyphens.alias("hyphen_eol"), (F.size(paragraphs) - F.size(F.array_distinct(paragraphs))).cast("long").alias("duplicate_paras"),
        t.count_of(F.col("text"), GARBLED).alias("garbled_marks"), t.count_of(F.col("text"), r"[一-鿿][\"',.;:!?]|[\"',.;:!?][一-鿿]").alias("ascii_punct_cjk"), t.count_of(F.col("text"), "[A-Za-z]{20,}").alias("long_latin_run"),
    )
TERMINAL = "。！？!?；;…."
CLOSERS = "”』」》）)]\""
ABBREVIATED = r"(?i)\b(?:e\.g|i\.e|etc|vs|cf|fig|no|vol|pp|ed|trans|approx|ca)\.$"
TAIL = r"(?i)(?:[，,、—–-]|(?:和|与|及|或|而|但是|以及|the|and|of|to|in|for))\s*$"
PAIRS = (("“", "”"), ("『", "』"), ("「", "」"), ("（", "）"), ("(", ")"), ("《", "》"))
LATIN_IN_PROSE = ("ibid", "idem", "passim", "op", "cit", "vol", "pp", "ed", "trans", "approx", "epub", "html", "http", "https", "isbn", "doi", "pdf", "url", "www")
SKIPPED_KINDS = ("bibliography", "index", "glossary", "toc")


def occurs(mark: Column) -> Column:
    return (F.char_length("text") - F.char_length(F.replace(F.col("text"), mark, F.lit("")))).cast("long")


def duplicate_words(blocks: DataFrame) -> DataFrame:
    """unit, block, word, n: a Latin word that follows itself, whatever its case, and two to four ideographs that do so at once."""
    latin = F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{2,})(?U:\s+)\1\b"), F.lit(1))
    han = F.regexp_extract_all(F.col("text"), F.lit(r"([\u4e00-\u9fff]{2,4})\1"), F.lit(1))
    return blocks.select("unit", "block", F.explode(F.concat(latin, han)).alias("word")).groupBy("unit", "block", "word").agg(F.count("*").alias("n"))


def unbalanced_quotes(blocks: DataFrame) -> DataFrame:
    """unit, block, pair, open, close: marks that don't balance over the unit, placed at the blocks that don't, else at the unit (block null). Straight quotes are a pair of one mark: an odd number of them is open, at every block with an odd number."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS])
    each = blocks.select("unit", "block", "text", F.explode(pairs).alias("p"))
    each = each.select("unit", "block", F.concat("p.a", "p.b").alias("pair"), occurs(F.col("p.a")).alias("open"), occurs(F.col("p.b")).alias("close"))
    straight = blocks.select("unit", "block", F.lit('""').alias("pair"), (occurs(F.lit('"')) % 2).alias("open"), F.lit(0).cast("long").alias("close"))
    unit = Window.partitionBy("unit", "pair")
    each = each.union(straight).where("open > 0 or close > 0").withColumn("balance", F.sum(F.col("open") - F.col("close")).over(unit))
    off = F.when(F.col("pair") == '""', F.col("balance") % 2 != 0).otherwise(F.col("balance") != 0)
    return each.where(off & (F.col("open") != F.col("close"))).select("unit", "block", "pair", "open", "close")


def tail_findings(blocks: DataFrame, *, long_limit=1200) -> DataFrame:
    """unit, block, code: long_paragraph; and for a block without a terminal end, by what follows: cross_page_fragment where the next block goes on, half_sentence else (but after an abbreviation), tail_loss where it ends in a word or mark that wants more and the next doesn't go on, quote_tail_dropped where a quotation is left open at a comma, dash or colon.

    A colon that leads into a next block and list items are no halves."""
    order = Window.partitionBy("unit").orderBy("block")
    df = blocks.select("unit", "block", t.right_stripped(F.col("text")).alias("text"), F.lead("text").over(order).alias("next")).where("text <> ''")
    tail = F.right("text", F.lit(1))
    ends = tail.isin(*(TERMINAL + CLOSERS))
    half = ~ends & ~(tail.isin(":", "：") & F.col("next").isNotNull()) & ~F.col("text").rlike(r"^\s*(?:[-*+]|\d+[.)])\s")
    goes_on = F.coalesce(F.col("next").rlike(CONTINUES), F.lit(False))
    depth = sum((F.greatest(F.lit(0), t.count_char(F.col("text"), a) - t.count_char(F.col("text"), b)) for a, b in PAIRS), F.lit(0)) + t.count_char(F.col("text"), '"') % 2
    codes = F.array(
        F.when(F.char_length("text") >= long_limit, "long_paragraph"), F.when(half & goes_on, "cross_page_fragment"), F.when(half & ~goes_on & ~F.col("text").rlike(ABBREVIATED), "half_sentence"),
        F.when(half & ~goes_on & F.col("text").rlike(TAIL), "tail_loss"), F.when(half & (depth > 0) & tail.isin(*"，,、—–-:："), "quote_tail_dropped"),
    )
    return df.select("unit", "block", F.explode(F.array_compact(codes)).alias("code"))


def untranslated_words(blocks: DataFrame, exempt=()) -> DataFrame:
    """unit, block, word: Latin words of four letters and more left in Chinese prose, but for glosses in brackets and quotations, short capitals and words that are listed or exempt."""
    prose = F.regexp_replace(F.regexp_replace(F.col("text"), "[（(][^）)]*[）)]", ""), "《[^》]*》|“[^”]*”|『[^』]*』", "")
    words = F.filter(F.regexp_extract_all(prose, F.lit("([A-Za-z][A-Za-z'-]{3,})"), F.lit(1)), lambda w: ~F.lower(w).isin(*LATIN_IN_PROSE, *exempt) & ~((F.upper(w) == w) & (F.char_length(w) <= 6)))
    return blocks.where(F.col("text").rlike("[一-鿿]")).select("unit", "block", F.explode(words).alias("word"))


def md_blocks(units: DataFrame) -> DataFrame:
    """unit, block (from 1), kind, whole, text of units (unit, md): content blocks in order, ``text`` without code spans. Tables and short quoted verse have kinds of their own."""
    each = units.select("unit", F.posexplode(udfs.blocks(F.col("md"))).alias("at", "b"))
    lines = F.filter(F.transform(F.split(F.col("b.block"), r"\R"), t.stripped), lambda x: x != "")
    table = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith("|"))
    said = F.transform(lines, lambda x: t.stripped(F.ltrim(x, F.lit("> "))))
    ends = rf"[{re.escape(TERMINAL + CLOSERS)}]$"
    verse = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith(">")) & F.forall(said, lambda x: (x != "") & (F.char_length(x) <= 40) & ~x.rlike(ends))
    kind = F.when(F.col("b.kind") != "text", F.col("b.kind")).when(table, "table").when(verse, "verse").otherwise("text")
    return each.select("unit", (F.col("at") + 1).cast("long").alias("block"), kind.alias("kind"), F.col("b.block").alias("whole"), markup.without_inline_code(F.col("b.block")).alias("text"))


def scan(units: DataFrame, *, long_limit=1200, exempt=()) -> DataFrame:
    """unit, block, code, detail, context, block_sha256: all findings of units (unit, kind, md). Contents, indexes, glossaries and bibliographies aren't scanned; code, tables and verse have no findings but for quotation marks."""
    blocks = md_blocks(units.where(~F.coalesce(F.col("kind").isin(*SKIPPED_KINDS), F.lit(False))))
    prose = blocks.where("kind = 'text'")
    # what follows a block is the next one of any kind
    tails = tail_findings(blocks, long_limit=long_limit).join(prose.select("unit", "block"), ["unit", "block"])
    found = [
        duplicate_words(prose).select("unit", "block", F.lit("duplicate_word").alias("code"), F.concat_ws("*", "word", F.col("n").cast("string")).alias("detail")),
        tails.select("unit", "block", "code", F.lit("").alias("detail")),
        untranslated_words(prose, exempt).select("unit", "block", F.lit("primitive_word"), F.col("word")),
        unbalanced_quotes(blocks.where("kind not in ('code', 'raw')")).select("unit", "block", F.lit("unbalanced_quote"), F.concat_ws(" ", "pair", F.col("open").cast("string"), F.col("close").cast("string"))),
    ]
    flat = F.array_join(F.filter(F.split(F.col("whole"), t.BLANK + "+"), lambda x: x != ""), " ")
    where = blocks.select("unit", "block", F.substr(flat, F.lit(1), F.lit(60)).alias("context"), F.sha2(flat.cast("binary"), 256).alias("block_sha256"))
    return reduce(DataFrame.union, found).join(where, ["unit", "block"])
