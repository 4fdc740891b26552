"""Text normalisation and comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII U+FF01..U+FF5E maps onto U+0021..U+007E by a fixed distance; the ideographic space is a space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Half-width katakana U+FF66..U+FF9D in code order, and the kana each stands for.
_HALF_KANA = "".join(chr(c) for c in range(0xFF66, 0xFF9E))
_FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def strip(text: Column) -> Column:
    """Cut white space, including the ideographic space, at both ends."""
    return F.regexp_replace(text, r"^[\s　﻿]+|[\s　﻿]+$", "")


def fold_width(text: Column) -> Column:
    return F.translate(F.translate(text, _WIDE, _NARROW), _HALF_KANA, _FULL_KANA)


def normalize_text(text: Column) -> Column:
    """Width fold, lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold_width(F.coalesce(text, F.lit("")))), r"\s+", " "))


def compact(text: Column) -> Column:
    """Letters a-z, digits, kana and Han only."""
    return F.regexp_replace(normalize_text(text), r"[^0-9a-z぀-ヿ㐀-鿿]+", "")


def hiragana(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _HIRAGANA)


def kana_key(text: Column) -> Column:
    """Hiragana with the two merged sounds folded, for reading comparison."""
    return F.translate(hiragana(text), "づぢ", "ずじ")


def reading_key(text: Column) -> Column:
    """Kana, latin letters and digits of a reading, as lower-case hiragana."""
    return F.regexp_replace(hiragana(normalize_text(text)), r"[^぀-ヿa-z0-9]", "")


def line_key(text: Column) -> Column:
    """Text without white space, punctuation, underscore and long marks: equal keys mean the same sung line."""
    return F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]|[ー]", "")


def word_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def safe_file_name(name: Column, fallback: str = "untitled") -> Column:
    """A name that is legal on common file systems."""
    cleaned = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    return (
        F.when(cleaned == "", F.lit(fallback)).when(cleaned.rlike(reserved), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)
    )


def natural_key(text: Column) -> Column:
    """Sort key under which digit runs of any length compare as numbers: a run stands behind the length that it has without leading zeros."""
    bare = lambda run: F.regexp_replace(run, r"^0+(?=\d)", "")
    piece = lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1), piece), "")
