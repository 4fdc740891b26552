"""Readings: beats, even distribution, hangul arithmetic, numerals, romanisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verseline.functions.textnorm import hiragana

# Small kana and the long mark lean on the beat before them.
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー"
PAUSE = "^"
# Decimal digits, the units inside four digits and the units of four-digit groups.
KANJI_DIGITS = "零一二三四五六七八九"
KANJI_SMALL_UNITS = ("", "十", "百", "千")
KANJI_BIG_UNITS = ("", "万", "億", "兆", "京")
ENGLISH_ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen"
).split()
ENGLISH_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
ENGLISH_SCALES = ("", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion")
# Revised romanisation of the hangul initials, vowels and finals in code order.
HANGUL_INITIAL = "g kk n d tt r m b pp s ss _ j jj ch k t p h".split()
HANGUL_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
HANGUL_FINAL = "_ k k ks n nj nh t l lk lm lb ls lt lp lh m p ps t t ng t t k t p _".split()

# The kana by rows of consonants, and the letters that leave their row's rule.
KANA_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの",
    "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ",
}
KANA_ODD = {
    "し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n",
    "ゔ": "vu", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ゎ": "wa", "ゕ": "ka", "ゖ": "ke",
}
# Pairs with a small vowel that make one beat, and the particles that are read otherwise.
KANA_PAIRS = (
    "うぃ wi うぇ we うぉ wo ゔぁ va ゔぃ vi ゔぇ ve ゔぉ vo ふぁ fa ふぃ fi ふぇ fe ふぉ fo てぃ ti でぃ di とぅ tu どぅ du "
    "しぇ she じぇ je ちぇ che つぁ tsa つぃ tsi つぇ tse つぉ tso くぁ kwa ぐぁ gwa"
).split()
PARTICLES = {"は": "wa", "へ": "e", "を": "o"}


def romaji_table() -> dict[str, str]:
    """Hepburn spelling of every kana and of every pair that is one beat."""
    table = {k: c + v for c, row in KANA_ROWS.items() for k, v in zip(row, "aiueo")} | KANA_ODD
    for k in "きぎしじちぢにひびぴみり":
        stem = table[k][:-1]
        for small, vowel in zip("ゃゅょ", "auo"):
            table[k + small] = stem + ("" if stem in ("sh", "ch", "j") else "y") + vowel
    return table | dict(zip(KANA_PAIRS[::2], KANA_PAIRS[1::2]))


def romaji_parts(parts: Column, particles: Column | None = None) -> Column:
    """Hepburn spelling of the parts of a reading, as many parts as before.

    A pair that makes one beat belongs to the part of its first kana. A small tsu doubles the consonant of the next beat (``c`` before ch) or
    is written ``xtsu`` where there is none; a long mark repeats the last vowel; n takes an apostrophe before vowels and y. ``particles``:
    indices of parts of one kana that are read as particles. Letters that are no kana stay.
    """
    table = romaji_table()
    spelt = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    pairs = "|".join(k for k in table if len(k) == 2)
    # beats of the joined text, each with the part that its first letter lies in
    letters = F.flatten(F.transform(parts, lambda p, i: F.transform(F.filter(F.split(hiragana(p), ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), i.alias("i")))))
    beats = F.regexp_extract_all(F.array_join(F.transform(letters, lambda x: x["c"]), ""), F.lit(f"({pairs}|(?s:.))"), 1)
    own = F.transform(beats, lambda b, k: F.struct(b.alias("b"), k.alias("k")))
    plain = lambda b: F.coalesce(F.try_element_at(spelt, b), b)
    after = lambda k: F.coalesce(F.get(beats, k + 1), F.lit(""))
    next_sound = lambda k: F.when(after(k).isin("っ", "ー"), "").otherwise(plain(after(k)))
    doubled = lambda s: F.when(s.startswith("ch"), "c").when(F.lower(s).rlike(r"^[aiueon]"), "").otherwise(F.regexp_extract(F.lower(s), r"^(\p{L})", 1))

    def step(state: Column, x: Column) -> Column:
        b, k, at = x["b"], x["k"], state["at"]
        part = F.get(letters, at)["i"]
        single = F.length(F.get(parts, part)) == 1
        before = F.when(k > 0, F.get(beats, k - 1)).otherwise("")
        read = F.lit(None).cast("string")
        if particles is not None:
            spoken = F.try_element_at(F.create_map(*[F.lit(y) for kv in PARTICLES.items() for y in kv]), b)
            read = F.when(F.coalesce(F.array_contains(particles, part), F.lit(False)) & single & (before != "っ"), spoken)
        s = (
            F.when(read.isNotNull(), read)
            .when(b == "っ", F.when(doubled(next_sound(k)) == "", "xtsu").otherwise(doubled(next_sound(k))))
            .when(b == "ー", F.when(state["vowel"] == "", "-").otherwise(state["vowel"]))
            .when(b == "ん", F.when(F.lower(next_sound(k)).rlike("^[aiueoy]"), "n'").otherwise("n"))
            .otherwise(plain(b))
        )
        heard = F.regexp_extract(F.lower(s), "([aiueo])[^aiueo]*$", 1)
        vowel = F.when(b.isin("っ", "ー"), state["vowel"]).when(b == "ん", "").when(heard == "", state["vowel"]).otherwise(heard)
        return F.struct(F.concat(state["out"], F.array(F.struct(part.alias("i"), s.alias("s")))).alias("out"), vowel.alias("vowel"), (at + F.length(b)).alias("at"))

    start = F.struct(F.array().cast("array<struct<i:int,s:string>>").alias("out"), F.lit("").alias("vowel"), F.lit(0).alias("at"))
    done = F.aggregate(own, start, step)["out"]
    return F.transform(parts, lambda _, i: F.array_join(F.transform(F.filter(done, lambda y: y["i"] == i), lambda y: y["s"]), ""))


def moras(text: Column) -> Column:
    """Split into beats; commas are separators and vanish."""
    clean = F.replace(text, F.lit(","), F.lit(""))
    return F.regexp_extract_all(clean, F.lit(f"(.[{SMALL_KANA}]*)"), 1)


def spread_evenly(parts: Column, n: Column) -> Column:
    """Join ``parts`` into ``n`` pieces, the earlier ones at most one longer; short input is filled with pauses."""
    size = F.size(parts)
    base, extra = F.floor(size / n).cast("int"), F.pmod(size, n).cast("int")

    def piece(i: Column) -> Column:
        start = i * base + F.least(i, extra)
        return F.array_join(F.slice(parts, start + 1, base + F.when(i < extra, 1).otherwise(0)), "")

    filled = F.concat(parts, F.array_repeat(F.lit(PAUSE), F.greatest(n - size, F.lit(0))))
    return F.when(size <= n, filled).otherwise(F.transform(F.sequence(F.lit(0), n - 1), piece))


def split_for_checks(reading: Column, n: Column) -> Column:
    """Reading cut into ``n`` checkpoint parts: beat by beat when there are enough, else character by character."""
    clean = F.replace(reading, F.lit(","), F.lit(""))
    beats = moras(reading)
    letters = F.regexp_extract_all(clean, F.lit("(.)"), 1)
    return (
        F.when(n <= 1, F.array(clean))
        .when(F.size(beats) >= n, spread_evenly(beats, n))
        .otherwise(spread_evenly(letters, n))
    )


def head_heavy_split(reading: Column, n: Column) -> Column:
    """Even split over ``n`` characters with every left-over letter on the first."""
    base = F.floor(F.length(reading) / n).cast("int")
    extra = F.pmod(F.length(reading), n).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(i == 0, F.substring(reading, F.lit(1), base + extra)).otherwise(
            F.substring(reading, 1 + extra + i * base, base)
        ),
    )


def _pick(names, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit("" if x == "_" else x) for x in names]), index.cast("int") + 1)


def hangul_romaji(ch: Column) -> Column:
    """Romanise one hangul syllable; any other character is returned as it is."""
    code = F.ascii(ch) - 0xAC00
    inside = (code >= 0) & (code < 11172)
    safe = F.when(inside, code).otherwise(0)
    return F.when(
        inside,
        F.concat(
            _pick(HANGUL_INITIAL, F.floor(safe / 588)),
            _pick(HANGUL_VOWEL, F.floor(F.pmod(safe, F.lit(588)) / 28)),
            _pick(HANGUL_FINAL, F.pmod(safe, F.lit(28))),
        ),
    ).otherwise(ch)


def _kanji_group(v: Column) -> Column:
    """Four decimal digits in kanji; one before ten, hundred and thousand is silent."""
    out = []
    for k in (3, 2, 1, 0):
        d = F.pmod(F.floor(v / 10**k), F.lit(10)).cast("int")
        digit = F.substring(F.lit(KANJI_DIGITS), d + 1, F.lit(1))
        shown = digit if k == 0 else F.when(d == 1, "").otherwise(digit)
        out.append(F.when(d == 0, "").otherwise(F.concat(shown, F.lit(KANJI_SMALL_UNITS[k]))))
    return F.concat(*out)


def kanji_number(n: Column) -> Column:
    """Any whole number from zero up in kanji numerals; null for a negative one."""
    n = n.cast("bigint")
    groups = []
    for k in (4, 3, 2, 1, 0):
        g = F.pmod(F.floor(n / F.lit(10 ** (4 * k)).cast("decimal(20,0)")), F.lit(10000)).cast("bigint")
        groups.append(F.when(g == 0, "").otherwise(F.concat(_kanji_group(g), F.lit(KANJI_BIG_UNITS[k]))))
    return F.when(n == 0, "零").when(n > 0, F.concat(*groups))


def _english_below_thousand(v: Column) -> Column:
    h, r = F.floor(v / 100), F.pmod(v, F.lit(100))
    small = F.when(r < 20, _pick(ENGLISH_ONES, F.least(r, F.lit(19)))).otherwise(
        F.concat_ws(" ", _pick(ENGLISH_TENS, F.floor(r / 10)), F.when(F.pmod(r, F.lit(10)) > 0, _pick(ENGLISH_ONES, F.pmod(r, F.lit(10)))))
    )
    return F.when(h == 0, small).otherwise(
        F.concat(_pick(ENGLISH_ONES, h), F.lit(" hundred"), F.when(r > 0, F.concat(F.lit(" and "), small)).otherwise(""))
    )


def english_number(n: Column) -> Column:
    """Any whole number in English words; negatives start with ``minus``."""
    a = F.abs(n.cast("decimal(20,0)"))
    scales = F.array(*[F.struct(F.lit(1000**k).cast("decimal(20,0)").alias("unit"), F.lit(f" {ENGLISH_SCALES[k]}" if k else "").alias("name")) for k in range(6, -1, -1)])
    groups = F.transform(scales, lambda s: F.struct(F.pmod(F.floor(a / s["unit"]), F.lit(1000)).cast("bigint").alias("g"), s["name"].alias("name")))
    parts = F.transform(F.filter(groups, lambda s: s["g"] > 0), lambda s: F.concat(_english_below_thousand(s["g"]), s["name"]))
    words = F.when(a == 0, "zero").otherwise(F.array_join(parts, " "))
    return F.when(n < 0, F.concat(F.lit("minus "), words)).otherwise(words)
