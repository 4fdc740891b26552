"""Text similarity scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verseline.functions.textnorm import compact, normalize_text

_TOKEN_SPLIT = r"[\s\-_/\\|,.;:!?()\[\]{}'\"`~]+"


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when either side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, _TOKEN_SPLIT), lambda t: t != "")


def token_score(k: Column, t: Column, kt: Column, tt: Column) -> Column:
    """``text_score`` on normalised texts ``k``, ``t`` and their tokens."""
    n = F.size(kt)
    shared = F.size(F.filter(kt, lambda w: F.array_contains(tt, w)))
    prefixed = F.size(F.filter(kt, lambda w: F.exists(tt, lambda x: F.startswith(x, w))))
    usable = (n > 0) & (F.size(tt) > 0)
    score = F.greatest(
        edit_ratio(k, t) * 100,
        F.when(F.contains(t, k), 92.0),
        F.when(usable & (shared > 0), shared / n * 95.0),
        F.when(usable & (prefixed > 0), prefixed / n * 90.0),
    )
    return F.when((k == "") | (t == ""), F.lit(0.0)).when(k == t, F.lit(100.0)).otherwise(F.round(F.least(score, F.lit(100.0)), 2))


def text_score(keyword: Column, text: Column) -> Column:
    """0-100: equality, containment, shared words, word prefixes, else the edit ratio."""
    k, t = normalize_text(keyword), normalize_text(text)
    return token_score(k, t, tokens(k), tokens(t))


def title_tier(keyword: Column, title: Column, score: Column) -> Column:
    """4 equal, 3 prefix, 2 contained, 1 similar (score >= 80), 0 otherwise."""
    k, t = normalize_text(keyword), normalize_text(title)
    ck, ct = compact(keyword), compact(title)
    return (
        F.when((k == "") | (t == ""), 0)
        .when((k == t) | ((ck != "") & (ck == ct)), 4)
        .when(F.startswith(t, k) | F.startswith(ct, ck), 3)
        .when(F.contains(t, k) | ((ck != "") & F.contains(ct, ck)), 2)
        .when(score >= 80, 1)
        .otherwise(0)
    )


def best_window_ratio(needle: Column, hay: Column) -> Column:
    """Best edit ratio of ``needle`` against any piece of ``hay`` of the same length."""
    n, m = F.length(needle), F.length(hay)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda p: edit_ratio(needle, F.substring(hay, p, n)))
    return F.when((n == 0) | (m == 0), F.lit(0.0)).when(m <= n, edit_ratio(needle, hay)).otherwise(F.array_max(windows))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only gram."""
    # one whole letter is passed each time: no gram begins inside a letter beyond 16 bits
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)
    return F.when(F.length(text) < n, F.filter(F.array(text), lambda g: g != "")).otherwise(F.array_distinct(windows))
