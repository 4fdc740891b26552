"""Character classes, language and display width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class name -> character set, tested in this order.
CLASSES = (
    ("long_vowel", r"[ーｰ－～〜]"),
    ("sokuon", r"[っッ]"),
    ("hiragana", r"[぀-ゟ]"),
    ("symbol", r"[・゠]"),
    ("katakana", r"[゠-ヿ]"),
    ("kanji", r"[一-鿿㐀-䶿豈-﫿々]"),
    ("hangul", r"[가-힣]"),
    ("katakana", r"[ｦ-ﾟ]"),
    ("alphabet", r"\p{L}"),
    ("number", r"\p{Nd}"),
    ("full_space", r"　"),
    ("space", r"[\s ]"),
    ("symbol", r"[\p{P}\p{S}]"),
)


def char_class(ch: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in CLASSES:
        out = out.when(ch.rlike("^" + pattern), name)
    return out.otherwise("other")


def count_of(text: Column, pattern: str) -> Column:
    """Number of characters that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


_JA = r"[぀-ゟァ-ヺー-ヿｦ-ﾟ一-鿿㐀-䶿豈-﫿々ー－～〜]"


def detect_language(text: Column) -> Column:
    """``ja`` / ``en`` above half of the visible characters, ``mixed`` above a fifth, else ``other``."""
    ja = count_of(text, _JA)
    rest = F.regexp_replace(text, _JA, "")
    en = count_of(rest, r"\p{L}")
    total = F.length(F.regexp_replace(text, r"[\s　 ]", ""))
    return (
        F.when(total == 0, "other")
        .when(ja * 2 > total, "ja")
        .when(en * 2 > total, "en")
        .when((ja * 5 > total) | (en * 5 > total), "mixed")
        .otherwise("other")
    )


def is_chinese_only(text: Column) -> Column:
    """No kana anywhere."""
    return ~text.rlike(r"[぀-ヿｦ-ﾟ]")


def is_korean(text: Column) -> Column:
    return text.rlike(r"[가-힣]") & is_chinese_only(text)


def display_units(text: Column, narrow: float = 0.5) -> Column:
    """Display width: characters below U+2E80 count ``narrow``, others 1."""
    slim = count_of(text, r"[\x{0}-\x{2E7F}]")
    return slim * F.lit(narrow) + (F.length(text) - slim)


def default_checks(klass: Column, *, sokuon: bool = False, long_vowel: bool = False) -> Column:
    """Beats a character gets before any reading is known."""
    return (
        F.when(klass.isin("space", "full_space"), 0)
        .when(klass == "sokuon", 1 if sokuon else 0)
        .when(klass == "long_vowel", 1 if long_vowel else 0)
        .otherwise(1)
    )
