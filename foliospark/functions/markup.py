"""Markup as column expressions: labels without Markdown, residue, links, correction notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as t


def plain_label(x: Column) -> Column:
    """Inline Markdown taken off, in order: images and links to their text, emphasis, code, note marks, attributes, tags."""
    for pattern, to in ((r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]^][^\]]*)\]\([^)]*\)", "$1"), (r"\[\^[^\]]+\]", ""), (r"\{[#.][^}]*\}", ""), (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<![\w*])[*_](\S(?:[^*_]*\S)?)[*_](?![\w*])", "$1"), (r"`+([^`]+)`+", "$1"), ("<[^>]+>", ""), (r"\\([\\`*_{}\[\]()#+.!|-])", "$1")):
        x = F.regexp_replace(x, pattern, to)
    return t.stripped(x)


def without_residue(x: Column) -> Column:
    """Attribute lists, bracketed spans and fenced divs of a converter removed; runs of blank lines become one."""
    for pattern, to in ((r"(?m)^:{3,}.*$\n?", ""), (r"\[([^\[\]]*)\]\{[^}]*\}", "$1"), (r"\{[.#][^}]*\}", ""), (r"(?m)^[ \t]*\\$", ""), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return t.stripped(x)


def with_correction_note(note: Column, found: Column) -> Column:
    """The trace of corrections before a note there may be."""
    return F.when(found == "", note).otherwise(F.concat_ws(";", F.concat(F.lit("corrected:"), found), F.when(F.coalesce(note, F.lit("")) != "", note)))


def own_comments_removed(x: Column, name: str = "fingerprint") -> Column:
    """Comments that hold this engine's JSON stamp; others, and stamps that aren't JSON, stay."""
    return F.regexp_replace(x, rf"<!--\s*{name}:\s*\{{[^{{}}]*\}}\s*-->\n?", "")


def is_formula(text: Column, width: Column, left: Column, right: Column, page: Column) -> Column:
    """Much mathematics for its length, or a short centred line with some; no chapter words."""
    signs, n = t.math_chars(text), F.greatest(F.lit(1), F.char_length(t.without_blanks(text)))
    centred = F.abs((left + right) / 2 - page / 2) <= page * 0.05
    prose = text.rlike(r"(?i)^\s*(?:chapter|part|section)\b|[a-z]{4,}\s+[a-z]{4,}\s+[a-z]{4,}")
    return ~prose & ((signs / n >= 0.3) | ((signs >= 1) & (n <= 40) & centred & (width <= page * 0.8)))


def heading_only(md: Column) -> Column:
    """Some line that isn't blank, and all such lines headings."""
    lines = F.filter(F.split(F.coalesce(md, F.lit("")), r"\R"), lambda x: t.stripped(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^#{1,6}[ \t]+\S"))


def drift_key(md: Column) -> Column:
    """What two versions of a text are compared by: without headings, note prefixes, marks and white space."""
    x = F.regexp_replace(md, r"(?m)^#{1,6}[ \t]+.*$", "")
    x = F.regexp_replace(x, r"(?m)^\[\^[^\]]+\]:\s*", "")
    x = F.regexp_replace(x, r"\[\^[^\]]+\]|\{\w+:\d+\}", "")
    return t.without_blanks(x)


def without_inline_code(x: Column) -> Column:
    """Code spans taken out: a run of backticks up to the next run of the same length. A span marked ``{=html}`` is markup and stays."""
    span = lambda n: rf"(?<!`)(`+)(?!`)(?:(?!(?<!`)\{n}(?!`)).)*(?<!`)\{n}(?!`)"
    return F.regexp_replace(x, rf"(?s)({span(2)}(?=\s*\{{\s*=\s*html\s*\}}))|{span(3)}", "$1")


def file_stem(x: Column) -> Column:
    """A unit's id as a file name: letters, digits, points, dashes and underscores; others become dashes."""
    return F.regexp_replace(F.regexp_replace(x, r"[^\w.-]+", "-"), "^-+|-+$", "")
