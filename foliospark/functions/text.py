"""Text functions as column expressions. Everything here stays in the JVM.

Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII unless ``(?U)`` is given; U+001C to U+001F count as white space as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)[\s\x1c-\x1f]"
SENTENCE_END = r"[。！？!?；;.؟؛۔]"
#: The same blanks as characters, for trimming without a pattern.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# What the rules below look for, in the order in which the rules look.
ACADEMIC_MARKERS = ("参考文献", "references", "bibliography", "bibliography", "appendix", "abstract", "footnote", "citation", "et al.", "doi")
COPYRIGHT_MARKERS = ("All rights reserved", "First published", "Printed in", "Library of Congress Cataloging", "British Library Cataloguing")
CORRECTIONS = (("IDG", "IDF"), ("19487", "1948"), ("67 December", "6-7 December"))
TERMINAL = "。！？!?…."
CLOSERS = "”’」』）)》】〕\"'"
QUOTE_PAIRS = (("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("（", "）"), ("《", "》"))
BIDI_CONTROLS = "‎‏‪‫‬‭‮⁦⁧⁨⁩"


def text_of(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def stripped(x: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(x, F.lit(BLANKS))


def right_stripped(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def without_blanks(x: Column) -> Column:
    """All white space deleted: the identity of blocks and lines."""
    return F.regexp_replace(x, rf"{BLANK}+", "")


def sentences(x: Column) -> Column:
    """Trimmed, non-empty sentences: cut after terminal marks and at line ends."""
    parts = F.split(x, rf"(?<={SENTENCE_END})|\n")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def long_length(x: Column) -> Column:
    return F.char_length(x).cast("long")


def length_ratio(src: Column, tgt: Column) -> Column:
    n = F.char_length(stripped(src))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.char_length(stripped(tgt)) / n)


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)).cast("long")


def count_char(x: Column, literal: str) -> Column:
    """How often a literal string occurs."""
    return ((F.char_length(x) - F.char_length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def word_count(x: Column) -> Column:
    """Ideographs, kana and Hangul one by one, runs of ASCII letters and of the Arabic blocks as words; numbers are none."""
    return count_of(x, r"[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]") + count_of(x, "[A-Za-z]+") + count_of(x, r"[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]+")


def language(x: Column) -> Column:
    """By script: zh, ja, ko, ru, ar, else en."""
    han, kana = count_of(x, r"[㐀-䶿一-鿿]"), count_of(x, r"[぀-ゟ゠-ヿ]")
    return (
        F.when((han > 0) | (kana > 0), F.when(kana > han * 0.1, "ja").otherwise("zh"))
        .when(x.rlike(r"[가-힯]"), "ko")
        .when(x.rlike(r"[Ѐ-ӿ]"), "ru")
        .when(x.rlike(r"[؀-ۿ]"), "ar")
        .otherwise("en")
    )


def source_language(x: Column) -> Column:
    """As ``language``; und where there is no text, or neither another script nor a Latin letter."""
    found = language(x)
    return F.when(stripped(x) == "", "und").when((found == "en") & ~x.rlike("[A-Za-z]"), "und").otherwise(found)


def genre(x: Column) -> Column:
    """academic with two marker hits (one marker counts twice), newspaper with three short title lines in a row, else novel."""
    hits = sum((F.contains(F.lower(x), F.lit(m)).cast("int") for m in ACADEMIC_MARKERS), F.lit(0))
    return F.when(hits >= 2, "academic").when(x.rlike(r"(?m)^(?:[A-Z][A-Za-z ,'-]{3,40}\n){3,}"), "newspaper").otherwise("novel")


def has_copyright(x: Column) -> Column:
    out = F.lit(False)
    for marker in COPYRIGHT_MARKERS:
        out = out | F.contains(x, F.lit(marker))
    return out


def cut_boilerplate(x: Column) -> Column:
    """The text before the first marker, in the order of the list, that it holds."""
    out = x
    for marker in reversed(COPYRIGHT_MARKERS):
        at = F.instr(x, marker)
        out = F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(out)
    return out


def with_hyphens(x: Column) -> Column:
    """A hyphen between a lower-case letter and a capital that starts a word, and between two years run together."""
    x = F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z][a-z])", "-")
    return F.regexp_replace(x, r"(?<=\b\d{4})(?=\d{4}\b)", "-")


def corrected(x: Column, pairs=CORRECTIONS) -> Column:
    for wrong, right in pairs:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    return x


def corrections_in(x: Column, pairs=CORRECTIONS) -> Column:
    return F.concat_ws("|", *[F.when(F.contains(x, F.lit(w)), F.lit(f"{w}>{r}")) for w, r in pairs])


def markers(x: Column) -> Column:
    """Marks of inserted elements, such as {fig:1}."""
    return count_of(x, r"(?U)\{\w+:\d+\}")


def note_marks(x: Column) -> Column:
    return count_of(x, r"\[\^[^\]\s]+\]")


def note_definitions(x: Column) -> Column:
    return count_of(x, r"(?m)^\s*\[\^[^\]\s]+\]:")


def heading_level(line: Column) -> Column:
    """Of an ATX heading line, else 0."""
    return F.char_length(F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1)).cast("long")


def slug(x: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "book").otherwise(out)


def version_key(x: Column) -> Column:
    """An array of numbers, which compares as versions do; null where a part isn't a number."""
    bare = F.regexp_replace(x, "^[vV]", "")
    return F.when(bare.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(bare, r"\."), lambda p: p.cast("int")))


def reversed_words(x: Column) -> Column:
    return F.array_join(F.reverse(F.split(stripped(x), rf"{BLANK}+")), " ")


def without_bidi(x: Column) -> Column:
    return F.translate(x, BIDI_CONTROLS, "")


def math_chars(x: Column) -> Column:
    return count_of(x, r"[∀-⋿Α-ω℀-⅏=+<>±×÷√]")


def rtl_share(x: Column) -> Column:
    """Right-to-left letters among letters of either direction."""
    rtl = count_of(x, r"[֐-ࣿיִ-﷿ﹰ-﻿]")
    ltr = count_of(x, r"[A-Za-zÀ-ɏͰ-ϿЀ-ԯ]")
    return F.when(rtl + ltr == 0, F.lit(0.0)).otherwise(rtl / (rtl + ltr))


def toc_label(x: Column) -> Column:
    """The key by which printed and navigation labels are compared (of NFKC text)."""
    x = F.translate(x, "「」『』“”‘’\"'", "")
    x = F.regexp_replace(x, r"^\s*(?:\d{1,3}[.．、)]|[①-⑳])\s*", "")
    x = F.regexp_replace(stripped(x), r"[ .…·•—–-]+$", "")
    return F.lower(without_blanks(x))


def title_key(x: Column) -> Column:
    """Letters and numbers only, lower case."""
    return F.lower(F.regexp_replace(x, r"(?U)[\s\W_]+", ""))


def titles_match(a: Column, b: Column) -> Column:
    """Equal, or the one in the other where the shorter has four characters at least."""
    short = F.least(F.char_length(a), F.char_length(b)) >= 4
    return (a != "") & (b != "") & ((a == b) | (short & (F.contains(a, b) | F.contains(b, a))))


# Captions that are file names, numbers, or stand for a caption still to be written.
CAPTION_FILE = r"(?i)\.(?:png|jpe?g|gif|svg|tiff?|bmp|webp)$"
CAPTION_SLUG = r"^[A-Za-z0-9._\-]*\d[A-Za-z0-9._\-]*$"
CAPTION_NUMBER = r"^\d+(?:[.\-]\d+)*\.?$"
CAPTION_BLANK = r"(?i)^(?:image|img|figure|fig|picture|photo|graphic|icon|illustration|插图|图片|圖片|图像|圖像|图|未命名|待补|待定|todo|tbd|n/?a|xxx+)\.?$"


def caption_is_filename(x: Column) -> Column:
    """One word that ends in an image's extension, or an ASCII name with a digit that isn't a plain number."""
    x = stripped(x)
    return (x != "") & ~F.contains(x, F.lit(" ")) & ~x.rlike(CAPTION_NUMBER) & (x.rlike(CAPTION_FILE) | x.rlike(CAPTION_SLUG))


def caption_is_placeholder(x: Column) -> Column:
    return stripped(x).rlike(CAPTION_BLANK)


def range_end(ref: Column) -> Column:
    """Last page of a reference such as 98-9 (99): a shorter end takes the start's leading digits."""
    start, end = F.regexp_extract(ref, r"^(\d+)", 1), F.regexp_extract(ref, r"[-–—]\s*(\d+)$", 1)
    whole = F.when(F.char_length(end) < F.char_length(start), F.concat(F.substr(start, F.lit(1), F.char_length(start) - F.char_length(end)), end)).otherwise(end)
    return F.when(end == "", start).otherwise(whole).try_cast("long")


def markdown_row(cells: Column) -> Column:
    """Cells as a pipe-table line, pipes escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
