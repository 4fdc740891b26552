"""Row projections and filters: text clean-up, character rows, singers, checkpoints, footage scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.functions import timetext as tt
from verseline.functions.scripts import char_class, display_units
from verseline.functions.textnorm import compact, normalize_text, strip
from verseline.operators.ordered import dealt, running_sum, salted_lookup, scan
from verseline.sources.dialects import METADATA_LINE, split_lines

LINE = ("track_id", "line_no")
# Words that open a credit line, and words that open one in a user's own file.
INTRO_CREDIT = (
    r"(?i)^(?:作词|作曲|编曲|制作人|作詞|編曲|詞|曲|編|词|编|lyric(?:s|ist)?|composer|arranger|producer|prod|歌手|演唱|vocal|artist)\s*[:：]"
)
USER_CREDIT = (
    r"(?i)^\s*(作词|作詞|作曲|编曲|編曲|词|曲|制作人|製作|混音|母带|和声|吉他|贝斯|鼓|弦乐|录音|出品|演唱|Lyrics?|Lyricist|Composer|"
    r"Compose[rd]?|Arrange[rd]?|Arrangement|Vocals?|Producer)\s*[:：]"
)
# Separators of a search key, tried in this order.
QUERY_SEPARATORS = (" - ", " / ", "、", "|")
# Frame rates a probed rate snaps to.
# Broadcast rates and the whole rates that they stand for.
BROADCAST_RATES = ((23.976, 24), (29.97, 30), (59.94, 60), (119.88, 120))


def explode_chars(lines: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in lines.columns if c != text]
    return lines.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(text, "")).alias("char_no", "ch"))


def sanitize_lrc(files: DataFrame) -> DataFrame:
    """Clean LRC lines: no metadata, no unstamped lines in a stamped file, stamps at centiseconds, no empty bodies."""
    stamped_file = F.regexp_count("content", F.lit(tt.ANY_STAMP)) > 0
    lines = split_lines(files.select("file_id", "content", stamped_file.alias("__timed")))
    raw = strip(F.replace("raw", F.lit("　"), F.lit(" ")))
    lines = lines.withColumn("raw", raw).where((F.col("raw") != "") & ~F.col("raw").rlike(METADATA_LINE))
    lines = lines.where(~F.col("__timed") | F.col("raw").rlike(tt.ANY_STAMP))
    token = r"([\[<]\d{1,3}:\d{2}(?:[.:]\d{2,3})?[\]>])[ \t]*"
    pieces = F.split("raw", r"(?=[\[<]\d{1,3}:\d{2}(?:[.:]\d{2,3})?[\]>])")

    def rewritten(p: Column) -> Column:
        stamp = F.regexp_extract(p, "^" + token, 1)
        mark = F.concat(F.substring(stamp, 1, 1), tt.lrc_clock(tt.stamp_ms(stamp)), F.expr("right('x', 0)"), F.substring(stamp, -1, 1))
        return F.when(stamp == "", p).otherwise(F.concat(mark, F.regexp_replace(p, "^" + token, "")))

    clean = F.array_join(F.transform(pieces, rewritten), "")
    body = F.trim(F.regexp_replace("raw", tt.ANY_STAMP, ""))
    return lines.where(body != "").select("file_id", "line_no", clean.alias("text"))


def looks_like_credit(text: Column, title: Column, artist: Column) -> Column:
    """Credit keyword, short ``x: y``, title with artist and little else, or title followed by a separator."""
    sep = F.least(
        F.when(F.instr(text, ":") > 0, F.instr(text, ":") - 1), F.when(F.instr(text, "：") > 0, F.instr(text, "：") - 1)
    )
    c, ct, ca = compact(text), compact(title), compact(artist)
    both = (ct != "") & (ca != "") & F.contains(c, ct) & F.contains(c, ca)
    left = F.length(c) - F.length(ct) - F.length(ca)
    n, nt = normalize_text(text), normalize_text(title)
    tail = F.ltrim(F.substring(n, F.length(nt) + 1, F.length(n)))
    opened = (nt != "") & F.startswith(n, nt) & (F.length(text) <= 96) & (tail.rlike(r"^[-–—/／]") | text.rlike("/|／| - "))
    return text.rlike(INTRO_CREDIT) | (sep.between(1, 8) & (F.length(text) <= 48)) | (both & (left <= 8)) | opened


def strip_intro_credits(lines: DataFrame, *, probe: int = 5) -> DataFrame:
    """Drop the leading run of credit lines among the first ``probe`` lines of a file (needs file_id, line_no, text, title, artist)."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    body = F.trim(F.regexp_replace("text", tt.ANY_STAMP, ""))
    s = lines.withColumn("__n", F.row_number().over(w))
    credit = F.when(F.col("__n") <= probe, F.coalesce(looks_like_credit(body, F.col("title"), F.col("artist")), F.lit(False))).otherwise(False)
    s = s.withColumn("__credit", credit)
    first = F.min(F.when(~F.col("__credit"), F.col("__n"))).over(Window.partitionBy("file_id"))
    return s.withColumn("__first", first).where(F.col("__n") >= F.col("__first")).select(*lines.columns)


def split_user_credits(lines: DataFrame) -> DataFrame:
    """Role of each line of a user's file: ``credit`` (JSON or keyword lines before the first sung line), ``translation``
    (same tenth of a second as the line before, without kana or latin letters) or ``lyric``. Works inside one file."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    is_json = F.col("text").rlike(r"^\{.*\}$") & F.get_json_object("text", "$.c").isNotNull()
    keyword = F.col("text").rlike(USER_CREDIT)
    s = lines.withColumns({"__json": F.coalesce(is_json, F.lit(False)), "__kw": keyword})
    sung_before = F.coalesce(F.max(F.when(~F.col("__json") & ~F.col("__kw"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("__credit", F.col("__json") | (F.col("__kw") & (sung_before == 0)))
    tenth = F.floor((F.col("start_ms") + 50) / 100)
    before = F.last(F.when(~F.col("__credit"), F.struct(tenth.alias("k"), "text")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__prev", before)
    tr = (F.col("__prev.k") == tenth) & (F.col("__prev.text") != F.col("text")) & ~F.col("text").rlike(r"[A-Za-z぀-ヿ]")
    role = F.when(F.col("__credit"), "credit").when(F.coalesce(tr, F.lit(False)), "translation").otherwise("lyric")
    return s.select(*lines.columns, role.alias("role"))


def query_variants(keyword: Column) -> Column:
    """Whole key, then (at the first separator found) its parts joined and each part; distinct, in order."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    parts = F.array().cast("array<string>")
    for sep in reversed(QUERY_SEPARATORS):
        pieces = F.filter(F.transform(F.split(keyword, "\\Q" + sep + "\\E"), lambda x: F.trim(x)), lambda x: x != "")
        parts = F.when(F.contains(keyword, F.lit(sep)), pieces).otherwise(parts)
    whole = F.array(tidy(keyword))
    more = F.when(F.size(parts) >= 2, F.concat(F.array(F.array_join(parts, " ")), parts)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.transform(F.concat(whole, more), tidy)), lambda x: x != "")


# ------------------------------------------------------------------ footage
def classify_asset(src: Column, origin: Column) -> Column:
    """An origin that is given wins; else the source says: a scene of the source video, any address, or a file of the user."""
    given = F.when(F.length(origin) > 0, origin)
    address = F.coalesce(src, F.lit(""))
    return F.coalesce(given, F.when(F.startswith(address, F.lit("source-video@")), "video").when(F.contains(address, F.lit("://")), "web").otherwise("user"))


# Upper limit and weight of each measured quality, and what movement is worth.
SHOT_WEIGHTS = (("color", 0.22, 0.32), ("luma", 0.32, 0.24), ("detail", 0.17, 0.2))
MOTION_RANGE, MOTION_WEIGHT, MOTION_WORTH = (0.006, 0.09), 0.24, {"calm": 0.55, "good": 1.0, "wild": 0.6}
FADE_FACTOR, LEAST_LUMA, LEAST_DETAIL = 0.6, 0.07, 0.03


def score_shot(luma: Column, detail: Column, color: Column, motion: Column, fade: Column) -> Column:
    """Weighted sum of the measured qualities, each up to its limit; too dark or too flat a picture is worth nothing."""
    low, high = MOTION_RANGE
    measured = {"color": color, "luma": luma, "detail": detail}
    total = F.lit(0.0)
    for name, limit, weight in SHOT_WEIGHTS:
        total = total + weight * F.least(F.lit(1.0), measured[name] / limit)
    worth = F.when(motion < low, MOTION_WORTH["calm"]).when(motion <= high, MOTION_WORTH["good"]).otherwise(MOTION_WORTH["wild"])
    total = (total + MOTION_WEIGHT * worth) * F.when(fade, FADE_FACTOR).otherwise(1.0)
    return F.when((luma < LEAST_LUMA) | (detail < LEAST_DETAIL), 0.0).otherwise(F.round(total, 3))


def clip_quality(score: Column, tags: Column, prefer: Column) -> Column:
    return F.coalesce(score, F.lit(0.5)) + F.when(F.array_contains(tags, "best"), 0.25).otherwise(0.0) + F.when(F.arrays_overlap(tags, prefer), 0.2).otherwise(0.0)


def auto_tags(motion: Column, luma: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(motion >= 0.05, "dynamic").when(motion <= 0.015, "calm"), F.when(luma >= 0.55, "bright").when(luma <= 0.22, "dark")
        )
    )


def usable_assets(assets: DataFrame, excluded: DataFrame, *, min_score: float = 0.35, min_side: int = 480) -> DataFrame:
    return assets.where((F.col("score") >= min_score) & (F.least("w", "h") >= min_side)).join(excluded.select("asset_id").distinct(), "asset_id", "left_anti")


def low_quality_sources(assets: DataFrame, used: DataFrame) -> DataFrame:
    """Sources of used clips below 1080 lines or 30 frames a second."""
    low = assets.where((F.least("w", "h") < 1080) | (F.col("fps") < 30)).join(used.select("asset_id"), "asset_id", "left_semi")
    return low.groupBy("library_id").agg(F.min(F.least("w", "h")).alias("short_side"), F.min("fps").alias("fps"))


def normalize_fps(rate: Column) -> Column:
    """Whole frame rate: a broadcast rate within 0.02 becomes the rate it stands for, any other the nearest (a half to the even one); 0 if unusable."""
    number = rate.try_cast("double") if hasattr(rate, "try_cast") else rate.cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))
    out = F.when(~usable, 0)
    for listed, whole in BROADCAST_RATES:
        out = out.when(F.abs(number - listed) < 0.02, whole)
    return out.otherwise(F.greatest(F.lit(1), F.rint(number).cast("int")))


# ------------------------------------------------------------------ characters and singers
def filter_singers(chars: DataFrame, groups: DataFrame) -> DataFrame:
    """Keep lines with at least one character of the group, without the others' characters; blanks stay; an empty group keeps all.

    ``groups``: track_id, singer_ids.
    """
    j = salted_lookup(chars, groups, ["track_id"])
    everyone = F.size("singer_ids") == 0
    mine = everyone | F.array_contains("singer_ids", F.col("singer_id"))
    j = j.withColumn("__mine", mine)
    any_mine = F.max(F.col("__mine")).over(Window.partitionBy(*LINE))
    blank = F.trim("ch") == ""
    return j.withColumn("__line", any_mine).where(F.col("__line") & (F.col("__mine") | blank)).select(*chars.columns)


def shift_times(chars: DataFrame, *, offset_ms: int) -> DataFrame:
    move = lambda t: F.when(t.isNotNull(), F.greatest(F.lit(0).cast("long"), t + offset_ms))
    return chars.withColumns({"cps_ms": F.transform("cps_ms", move), "release_ms": move(F.col("release_ms"))})


def chorus_spans(text: Column, begin: str = "（(", end: str = "）)") -> Column:
    """Bracket spans of a line as array of (first, last) positions; an unclosed bracket ends the search."""
    b, e = "".join("\\" + c for c in begin), "".join("\\" + c for c in end)
    pieces = F.regexp_extract_all(text, F.lit(f"([^{b}]*[{b}][^{e}]*[{e}])"), 1)
    lengths = F.transform(pieces, lambda p: F.length(p))
    upto = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x)
    return F.transform(
        pieces, lambda p, i: F.struct((upto(i) + F.length(F.regexp_extract(p, f"^[^{b}]*", 0))).alias("first"), (upto(i + 1) - 1).alias("last"))
    )


def timetag_type(check_count: Column, stamps: Column, released: Column, is_line_end: Column, position: Column) -> Column:
    """Kind of a checkpoint: first / later stamp of a character, pause, line end or rest."""
    return (
        F.when(released & is_line_end, "LINE_END")
        .when(released, "SENTENCE_END")
        .when((check_count == 0) & (stamps == 0), "REST")
        .when(position == 0, "CHAR_START")
        .otherwise("CHAR_MIDDLE")
    )


def auto_split_long(lines: DataFrame, *, max_units: float = 17.0) -> DataFrame:
    """One round: lines wider than ``max_units`` are cut at the space nearest the middle, a phrase break within 22 % first.

    Returns line_no, part (0 / 1) and text; run it again on the result for longer lines.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    left, right = F.reverse(F.substring("text", F.lit(1), half + 1)), F.substring("text", half + 1, n)

    def found(in_left: str, in_right: str) -> Column:
        """Nearest hit on each side of the middle: (distance, position) of the space, the left one winning a tie."""
        p, q = F.regexp_instr(left, F.lit(in_left)), F.regexp_instr(F.substring(right, F.lit(2), n), F.lit(in_right))
        at = lambda k, ok: F.when(ok, F.struct(F.abs(k - n / 2).alias("d"), k.alias("k")))
        lk, rk = half - p + 1, half + q
        return F.least(at(lk, (p > 0) & (lk > 0)), at(rk, (q > 0) & (rk < n - 1)))

    space = found("[ 　]", "[ 　]")
    before = found("[ 　](?=[,;:!?、。，])", "(?<=[,;:!?、。，])[ 　]")
    # a phrase break right after the middle character needs that character in view
    edge = F.when(
        F.substring("text", half + 1, F.lit(1)).isin(*",;:!?、。，") & F.substring("text", half + 2, F.lit(1)).isin(" ", "　") & (half + 1 < n - 1),
        F.struct(F.abs(half + 1 - n / 2).alias("d"), (half + 1).alias("k")),
    )
    phrase = F.least(before, edge)
    wide = (display_units(F.col("text")) > max_units) & (n > 2)
    s = lines.withColumn("__at", F.when(wide, F.when(phrase["d"] <= n * 0.22, phrase["k"]).otherwise(space["k"])))
    cut = F.col("__at").isNotNull()
    parts = F.when(
        cut, F.array(F.rtrim(F.substring("text", F.lit(1), F.col("__at"))), F.ltrim(F.substring("text", F.col("__at") + 1, n)))
    ).otherwise(F.array("text"))
    return s.select(*[c for c in lines.columns if c != "text"], F.posexplode(parts).alias("part", "text"))


def split_spans(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """Reading spans re-indexed around a cut position: (line_no, at) -> part 0 keeps, part 1 shifts; crossing spans go."""
    j = spans.join(cuts, list(LINE), "left")
    left = F.col("at").isNull() | (F.col("last") < F.col("at"))
    right = F.col("first") >= F.col("at")
    shift = F.when(left, 0).otherwise(F.col("at"))
    return j.where(left | right).select(
        *LINE, F.when(left, 0).otherwise(1).alias("part"), (F.col("first") - shift).alias("first"), (F.col("last") - shift).alias("last"), "reading"
    )


def merge_line_pairs(lines: DataFrame, *, sep: str = " ") -> DataFrame:
    """Join every odd line with the even line after it; the second text starts at ``shift``."""
    pair = F.floor((F.col("line_no") - 1) / 2)
    return lines.groupBy("track_id", pair.alias("pair_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), sep).alias("text"),
        (F.min_by(F.length("text"), "line_no") + len(sep)).alias("shift"),
    )


def break_lines(chars: DataFrame) -> DataFrame:
    """Renumber characters after line breaks: ``break_here`` starts a new line at that character (inside each line)."""
    w = Window.partitionBy(*LINE).orderBy("char_no")
    s = chars.withColumn("sub_line", F.sum(F.col("break_here").cast("int")).over(w))
    return s.withColumn("new_char_no", F.row_number().over(Window.partitionBy(*LINE, "sub_line").orderBy("char_no")) - 1).drop("break_here")


def join_lines(chars: DataFrame, lines: DataFrame, *, block_lines: int = 4096) -> DataFrame:
    """(track_id, line_no, char_no, ch, source_line, source_char): lines marked ``join_up`` move to the end of the line before, behind a space.

    ``chars``: track_id, line_no, char_no, ch; ``lines``: track_id, line_no, join_up, also for lines without characters (they leave no
    space). Lines are numbered anew from 1; the spaces have no source.
    """
    sizes = chars.groupBy(*LINE).agg(F.count("*").alias("__n"))
    s = lines.select(*LINE, "join_up").join(sizes, list(LINE), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    at = F.floor(F.col("line_no") / block_lines)
    s = scan(s, by=["track_id"], order=["line_no"], block=at, __heads=running_sum(F.when(F.col("join_up"), 0).otherwise(1).cast("long")))
    # a track that begins with a joined line keeps it as its first
    first = lines.groupBy("track_id").agg(F.min_by("join_up", "line_no").cast("long").alias("__lead"))
    s = salted_lookup(s, first, ["track_id"]).withColumn("__new", F.col("__heads") + F.col("__lead")).drop("__heads", "__lead")
    width = F.when(F.col("__n") > 0, F.col("__n") + 1).otherwise(0)
    s = scan(s, by=["track_id", "__new"], order=["line_no"], block=at, __from=running_sum(width, inclusive=False), __rest=running_sum(F.col("__n"), inclusive=False, forward=False))
    s = s.withColumn("__from", F.coalesce("__from", F.lit(0)))
    moved = chars.select(*LINE, "char_no", "ch").join(s.select(*LINE, "__new", "__from"), list(LINE))
    kept = moved.select("track_id", F.col("__new").alias("line_no"), (F.col("__from") + F.col("char_no")).alias("char_no"), "ch", F.col("line_no").alias("source_line"), F.col("char_no").alias("source_char"))
    spaces = s.where((F.col("__n") > 0) & (F.col("__rest") > 0)).select("track_id", F.col("__new").alias("line_no"), (F.col("__from") + F.col("__n")).alias("char_no"), F.lit(" ").alias("ch"))
    return kept.unionByName(spaces, allowMissingColumns=True)


def flatten_timestamps(chars: DataFrame) -> DataFrame:
    """Every checkpoint and release as one row: ms, line, character, checkpoint number, reading part."""
    marks = chars.select(
        *LINE, "char_no", "parts", F.posexplode("cps_ms").alias("cp_no", "ms")
    ).select(*LINE, "char_no", "ms", F.col("cp_no"), F.lit(False).alias("is_release"), F.get("parts", F.col("cp_no")).alias("part"))
    rel = chars.where(F.col("release_ms").isNotNull()).select(
        *LINE, "char_no", F.col("release_ms").alias("ms"), F.size("cps_ms").alias("cp_no"), F.lit(True).alias("is_release"), F.lit(None).cast("string").alias("part")
    )
    return marks.unionByName(rel)


def recount_checks(chars: DataFrame) -> DataFrame:
    """Beats from readings: kanji and digits take one beat per reading part, none without a reading unless timed."""
    klass = char_class(F.col("ch"))
    n = F.size("parts")
    by_reading = F.when(n > 0, n).when(F.size("cps_ms") > 0, F.size("cps_ms")).otherwise(0)
    return chars.withColumn("check_count", F.when(klass.isin("kanji", "number"), by_reading).otherwise(F.col("check_count")))


def drop_by_class(chars: DataFrame, *, classes: tuple[str, ...], what: str = "ruby") -> DataFrame:
    """Clear readings or beats of the chosen classes; a compound linked to a kanji counts as kanji throughout."""
    w = Window.partitionBy(*LINE).orderBy("char_no")
    prev = F.coalesce(F.lag("linked").over(w), F.lit(False))
    s = dealt(chars, *LINE).withColumn("__g", F.sum(F.when(prev, 0).otherwise(1)).over(w))
    klass = char_class(F.col("ch"))
    compound = Window.partitionBy(*LINE, "__g")
    s = s.withColumn("__kanji", F.max(klass == "kanji").over(compound) & (F.count("*").over(compound) > 1))
    hit = F.when(F.col("__kanji"), F.lit("kanji")).otherwise(klass).isin(*classes)
    if what == "ruby":
        return s.withColumn("parts", F.when(hit, F.array().cast("array<string>")).otherwise(F.col("parts"))).select(*chars.columns)
    return s.withColumn("check_count", F.when(hit, 0).otherwise(F.col("check_count"))).select(*chars.columns)


def replace_singer(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Delete singers: lines move to the heir named in ``mapping`` (old_id, new_id); a null heir deletes the lines."""
    j = lines.join(mapping.select(F.col("old_id").alias("singer_id"), "new_id", F.lit(True).alias("__hit")), "singer_id", "left")
    return j.where(F.col("__hit").isNull() | F.col("new_id").isNotNull()).select(
        *[F.coalesce("new_id", "singer_id").alias(c) if c == "singer_id" else F.col(c) for c in lines.columns]
    )


def remap_roles(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename role labels by table (role, new_role); unknown labels stay."""
    j = rows.join(renames, "role", "left")
    return j.select(*[F.coalesce("new_role", "role").alias(c) if c == "role" else F.col(c) for c in rows.columns])
