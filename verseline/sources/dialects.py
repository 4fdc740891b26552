"""Timed-text dialects as DataFrame parsers.

Input is ``text_files`` (file_id, content): one row per file. A file is cut into line rows inside the JVM and everything
after that works on lines, so one very long file spreads over tasks. Work that needs neighbours stays inside one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verseline.functions import timetext as tt
from verseline.functions.textnorm import strip
from verseline.session import bounded_batches
from verseline.sources import inline

# Line shapes that carry no words.
ID_TAG = r"^\[[a-zA-Z]+:.*\]$"
METADATA_LINE = r"(?i)^\[(ar|al|au|by|offset|ti|tool):.*\]$"
PUNCTUATION_ONLY = "^[\\[\\]【】（）(){}<>\"‘’`~!@#$%^&*+=|\\\\:;,.?/\\s\\-]+$"
STAMP_ONLY = r"^(\[\d{1,2}:\d{2}[.:]\d{2,3}\])+$"
# Word stamps of the two line-duration dialects.
DURATION_LINE = r"^\[(\d+),(\d+)\](.*)$"
ANGLE_WORD = r"<(\d+),(\d+),\d+>([^<]*)"
PAREN_WORD = r"\((\d+),(\d+),\d+\)([^()]*)"


def split_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per text line: file_id, line_no (1-based), raw."""
    return files.select(
        *[c for c in files.columns if c != content],
        F.posexplode(F.split(F.regexp_replace(F.col(content), "\r\n?", "\n"), "\n")).alias("__pos", "raw"),
    ).select(
        *[c for c in files.columns if c != content], (F.col("__pos") + 1).cast("long").alias("line_no"), "raw"
    )


def _blankish(text: Column) -> Column:
    return (text == "") | text.rlike(r"^\d+$") | text.rlike(PUNCTUATION_ONLY)


def parse_txt(files: DataFrame) -> DataFrame:
    """Plain text lines; blank, digits-only, punctuation-only, tag-only and stamp-only lines are dropped."""
    text = strip(F.col("raw"))
    return (
        split_lines(files)
        .withColumn("text", text)
        .where(~_blankish(F.col("text")))
        .where(~F.col("text").rlike(r"^<.*>$") & ~F.col("text").rlike(r"^\[\d{1,2}:\d{2}[.:]\d{2,3}\]$"))
        .drop("raw")
    )


def parse_lrc(files: DataFrame) -> DataFrame:
    """``[mm:ss.xx]text`` lines; a line with several stamps gives one row per stamp."""
    lines = split_lines(files).withColumn("__stamps", F.regexp_extract_all("raw", F.lit(f"({tt.LRC_STAMP_BARE})"), 1))
    return lines.select(
        *[c for c in lines.columns if c not in ("raw", "__stamps")],
        F.posexplode("__stamps").alias("stamp_no", "__stamp"),
        strip(F.regexp_replace("raw", tt.LRC_STAMP_BARE, "")).alias("text"),
    ).withColumn("start_ms", tt.stamp_ms(F.col("__stamp"))).drop("__stamp")


def lrc_offset(content: Column) -> Column:
    """The last ``[offset:n]`` of a file in milliseconds, 0 when there is none."""
    found = F.regexp_extract_all(content, F.lit(r"(?i)\[offset:([+-]?\d+)\]"), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("bigint"), F.lit(0).cast("bigint"))


def apply_lrc_offset(files: DataFrame) -> DataFrame:
    """Lines with the file's own offset applied (positive = earlier, never below 0); wordless lines go, text without a stamp stays with a null time."""
    tagged = files.withColumn("offset_ms", lrc_offset(F.col("content")))
    lines = split_lines(tagged).withColumn("raw", strip(F.col("raw")))
    kept = lines.where(
        ~_blankish(F.col("raw")) & ~F.col("raw").rlike(ID_TAG) & ~F.col("raw").rlike(STAMP_ONLY)
    )
    stamps = kept.withColumn("__stamps", F.regexp_extract_all("raw", F.lit(f"({tt.LRC_STAMP_BARE})"), 1))
    return stamps.select(
        *[c for c in stamps.columns if c not in ("raw", "__stamps")],
        F.explode_outer("__stamps").alias("__stamp"),
        strip(F.regexp_replace("raw", tt.LRC_STAMP_BARE, "")).alias("text"),
    ).select("*", F.when(F.col("__stamp").isNotNull(), F.greatest(tt.stamp_ms(F.col("__stamp")) - F.col("offset_ms"), F.lit(0))).alias("start_ms")).drop("__stamp")


def _pieces(files: DataFrame, stamp: str, stop: str) -> DataFrame:
    """Explode ``stamp + text`` pieces of each line, with the position of every piece in the line's plain text."""
    shape = f"{stamp}([^{stop}]*)"
    lines = split_lines(files.select("file_id", "content"))
    timed = lines.select(
        "file_id", "line_no", F.posexplode(F.regexp_extract_all("raw", F.lit(shape), 0)).alias("piece_no", "p")
    )
    # one match found the piece; its parts stand at places that plain string functions reach
    close = "]" if stop == r"\[" else ">"
    stamped = timed.withColumn("__stamp", F.substring_index("p", close, 1)).withColumn("__m", F.expr("substring(substring_index(__stamp, ':', 1), 2)"))
    at = F.length("__m")
    clock = tt.clock_ms(F.col("__m"), F.col("__stamp").substr(at + 3, F.lit(2)), F.col("__stamp").substr(at + 6, F.lit(3)))
    piece = stamped.select("file_id", "line_no", "piece_no", clock.alias("ms"), F.col("p").substr(F.length("__stamp") + 2, F.length("p")).alias("piece"))
    piece = piece.withColumn("word", strip(F.col("piece")))
    # patterns look only at pieces that hold white space in front, or nothing else
    plain = (F.col("word") != "") & F.startswith("piece", "word")
    indent = F.when(plain, 0).otherwise(F.length("piece") - F.length(F.regexp_replace("piece", r"^[\s　]+", "")))
    piece = piece.select(
        "file_id", "line_no", "piece_no", "ms", "word", F.length("piece").alias("__size"), indent.alias("__indent"), F.length("word").alias("__len"),
        ((F.col("word") == "") & F.col("piece").rlike(r"^[\s　]*$")).alias("__blank"),
    )
    keys = ["file_id", "line_no"]
    w = Window.partitionBy(*keys).orderBy("piece_no")
    line = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = piece.withColumns({"__first": before + F.col("__indent"), "__last_no": F.max("piece_no").over(line)})
    closing = (F.col("piece_no") == F.col("__last_no")) & F.col("__blank") & (F.col("piece_no") > 0)
    return out.withColumns(
        {
            "__lead": F.min(F.when(~F.col("__blank"), F.col("__first"))).over(line),
            "release_ms": F.max(F.when(closing, F.col("ms"))).over(line),
        }
    )


def parse_word_lrc(files: DataFrame) -> DataFrame:
    """``[t]word[t]word`` lines: first / last character position, start and the closing release of the line."""
    return _words(_pieces(files, tt.WORD_STAMP, r"\["))


def parse_enhanced_lrc(files: DataFrame) -> DataFrame:
    """``<t>`` stamps inside a line; the line's own ``[t]`` is ignored."""
    return _words(_pieces(files, tt.ENHANCED_STAMP, "<"))


def _words(pieces: DataFrame) -> DataFrame:
    keys = ["file_id", "line_no"]
    w = Window.partitionBy(*keys).orderBy("piece_no")
    return (
        pieces.where(~F.col("__blank"))
        .select(
            *keys,
            F.row_number().over(w).cast("long").alias("word_no"),
            "word",
            (F.col("__first") - F.col("__lead")).cast("long").alias("first"),
            (F.col("__first") - F.col("__lead") + F.col("__len") - 1).cast("long").alias("last"),
            F.col("ms").alias("start_ms"),
            "release_ms",
        )
    )


def parse_duration_words(files: DataFrame) -> DataFrame:
    """``[start,length]`` lines with ``<offset,length,_>word`` (relative to the line) or ``(start,length,_)word`` (absolute)."""
    head = lambda i: F.regexp_extract("raw", DURATION_LINE, i).cast("bigint")
    lines = split_lines(files.select("file_id", "content")).where(F.col("raw").rlike(DURATION_LINE))
    relative = F.col("raw").rlike(r"^\[\d+,\d+\]\s*<")
    words = F.when(relative, F.regexp_extract_all("raw", F.lit(ANGLE_WORD), 0)).otherwise(
        F.regexp_extract_all("raw", F.lit(PAREN_WORD), 0)
    )
    # what belongs to the line is read before its words become rows, or every word would read the whole line again
    headed = lines.select("file_id", "line_no", head(1).alias("line_start_ms"), head(2).alias("line_dur_ms"), relative.alias("__rel"), words.alias("__words"))
    timed = headed.select("file_id", "line_no", "line_start_ms", "line_dur_ms", "__rel", F.posexplode("__words").alias("__pos", "p"))
    stamp = F.when(F.col("__rel"), F.substring_index("p", ">", 1)).otherwise(F.substring_index("p", ")", 1))
    number = lambda i: F.get(F.col("__n"), F.lit(i)).cast("bigint")
    cut = timed.select("*", stamp.alias("__stamp")).select("*", F.split(F.expr("substring(__stamp, 2)"), ",").alias("__n"))
    return cut.select(
        "file_id",
        "line_no",
        "line_start_ms",
        "line_dur_ms",
        (F.col("__pos") + 1).cast("long").alias("word_no"),
        F.col("p").substr(F.length("__stamp") + 2, F.length("p")).alias("word"),
        (number(0) + F.when(F.col("__rel"), F.col("line_start_ms")).otherwise(0)).alias("start_ms"),
        number(1).alias("dur_ms"),
    )


def parse_duration_translation(files: DataFrame) -> DataFrame:
    """Translation rows of the base64 JSON in a ``[language:...]`` line, the k-th row going to the k-th timed line."""
    payload = F.regexp_extract("content", r"(?m)^\[language:([A-Za-z0-9+/=]+)\]", 1)
    schema = "struct<content: array<struct<type: int, lyricContent: array<array<string>>>>>"
    rows = (
        files.select("file_id", F.from_json(F.unbase64(payload).cast("string"), schema).alias("j"))
        .select("file_id", F.explode("j.content").alias("c"))
        .where(F.col("c.type") == 1)
        .select("file_id", F.posexplode("c.lyricContent").alias("k", "row"))
        .select("file_id", "k", strip(F.array_join("row", "")).alias("translation"))
    )
    starts = files.select(
        "file_id",
        F.posexplode(F.regexp_extract_all("content", F.lit(r"(?m)^\[(\d+),\d+\]"), 1)).alias("k", "s"),
    ).select("file_id", "k", F.col("s").cast("bigint").alias("start_ms"))
    return (
        starts.join(rows, ["file_id", "k"])
        .where(F.col("translation") != "")
        .select("file_id", (F.col("k") + 1).cast("long").alias("row_no"), "start_ms", "translation")
    )


def parse_srt(files: DataFrame) -> DataFrame:
    """Subtitle blocks: start, end (only when after the start), tags removed, text lines joined by a space."""
    body = strip(F.regexp_replace("content", "\r\n?", "\n"))
    blocks = files.select("file_id", F.posexplode(F.split(body, r"\n\s*\n")).alias("__pos", "block"))
    rows = F.transform(F.split("block", "\n"), lambda x: F.trim(x))
    words = F.filter(rows, lambda x: ~x.rlike(r"^\d+$") & ~x.rlike(tt.SRT_RANGE))
    clean = F.filter(F.transform(words, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    out = blocks.select(
        "file_id",
        F.col("__pos"),
        tt.srt_clock_ms(F.col("block"), True).alias("start_ms"),
        tt.srt_clock_ms(F.col("block"), False).alias("__end"),
        F.array_join(clean, " ").alias("text"),
    ).where(F.col("text") != "")
    return out.select(
        "file_id",
        (F.col("__pos") + 1).cast("long").alias("block_no"),
        "text",
        "start_ms",
        F.when(F.col("__end") > F.col("start_ms"), F.col("__end")).alias("end_ms"),
    )


def parse_ass_karaoke(files: DataFrame) -> DataFrame:
    """Dialogue rows whose ``\\k`` segments accumulate to start times.

    Column positions come from the file's own Format line. An empty segment is a pause; ``\\sing_x`` (or the Name
    field) gives the singer of the segments after it.
    """
    fmt = F.transform(
        F.split(F.regexp_extract("content", r"(?s)\[Events\].*?\nFormat:\s*([^\n]*)", 1), ","), lambda x: F.lower(F.trim(x))
    )
    lines = split_lines(files.withColumn("__fmt", fmt)).where(F.col("raw").rlike(r"^Dialogue:"))
    fields = F.split(F.regexp_replace("raw", r"^Dialogue:\s*", ""), ",")
    field = lambda name: F.try_element_at(fields, F.array_position("__fmt", name).cast("int"))
    text = F.array_join(F.slice(fields, F.size("__fmt"), F.greatest(F.size(fields), F.lit(1))), ",")
    rows = lines.select(
        "file_id",
        "line_no",
        tt.ass_clock_ms(field("start")).alias("line_start_ms"),
        tt.ass_clock_ms(field("end")).alias("line_end_ms"),
        F.trim(field("name")).alias("__name"),
        text.alias("__text"),
    )
    seg = r"\{([^}]*?\\[kK][fo]?(\d+)[^}]*)\}([^{]*)"
    part = lambda i: F.regexp_extract("p", seg, i)
    parts = rows.select(
        "file_id",
        "line_no",
        "line_start_ms",
        "line_end_ms",
        "__name",
        F.posexplode(F.regexp_extract_all("__text", F.lit(seg), 0)).alias("seg_no", "p"),
    )
    # only what the result needs is shuffled: no tags, and the name of a line with its first segment alone
    marker = F.nullif(F.regexp_extract(part(1), r"\\sing_(\w+)", 1), F.lit(""))
    named = F.when(F.col("seg_no") == 0, F.coalesce(marker, F.nullif("__name", F.lit("")))).otherwise(marker)
    parts = parts.select("file_id", "line_no", "line_start_ms", "line_end_ms", "seg_no", (part(2).cast("bigint") * 10).alias("dur_ms"), part(3).alias("text"), named.alias("__mark"))
    w = Window.partitionBy("file_id", "line_no").orderBy("seg_no")
    dur = F.col("dur_ms")
    return parts.select(
        "file_id",
        "line_no",
        F.col("seg_no").cast("long").alias("seg_no"),
        "text",
        (F.col("line_start_ms") + F.coalesce(F.sum(dur).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start_ms"),
        "dur_ms",
        (F.col("text") == "").alias("is_pause"),
        F.last("__mark", True).over(w).alias("singer_id"),
        "line_end_ms",
    )


# Han letters of the two large blocks with the repeat and counter marks, and kana.
HAN, KANA = "\u3400-\u4dbf\u4e00-\u9fff々〆ヶ", "\u3040-\u30ff"
# The two notations of a reading, and the braces that both are brought to.
READING_IN_BRACKETS = rf"([{HAN}]+)[(（]([{KANA}]+)[)）]"
READING_IN_BRACES = r"\{([^{}|]+)\|{1,2}([^{}|]*)\}"


def parse_annotated_ruby(files: DataFrame) -> DataFrame:
    """``{base||reading}`` or ``kanji(kana)`` marks -> one row per reading span, with the plain text and singer tag; a line without a
    reading gives one row with a null span. Positions are counted inside the line, so nothing is shuffled."""
    lines = split_lines(files)
    keys = [c for c in lines.columns if c != "raw"]
    raw = strip(F.col("raw"))
    singer = F.when(~raw.rlike(r"^\[\d"), F.nullif(F.regexp_extract(raw, r"^[\[【]([^\]】]{1,24})[\]】]\s*", 1), F.lit("")))
    body = F.when(singer.isNotNull(), F.regexp_replace(raw, r"^[\[【][^\]】]{1,24}[\]】]\s*", "")).otherwise(raw)
    one = F.regexp_replace(F.regexp_replace(body, READING_IN_BRACKETS, "{$1||$2}"), READING_IN_BRACES, "{$1||$2}")
    mark = r"\{([^{}|]+)\|\|([^{}|]*)\}"
    marked = lines.select(*keys, singer.alias("singer"), one.alias("__m"), F.regexp_replace(one, mark, "$1").alias("text")).where(F.trim("text") != "")
    pieces = F.regexp_extract_all("__m", F.lit(r"([^{]*)(?:" + mark + ")?|\\{"), F.lit(0))
    parts = F.transform(pieces, lambda x: F.struct(F.regexp_replace(x, mark, "").alias("pre"), F.regexp_extract(x, mark, 1).alias("base"), F.regexp_extract(x, mark, 2).alias("reading")))

    def span(x: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("__p", 1, i), F.lit(0).cast("long"), lambda n, p: n + F.length(p["pre"]) + F.length(p["base"]))
        first = before + F.length(x["pre"])
        return F.struct(first.alias("first"), (first + F.length(x["base"]) - 1).alias("last"), x["reading"].alias("reading"), x["base"].alias("base"))

    spans = F.filter(F.transform("__p", span), lambda x: x["base"] != "")
    found = marked.withColumn("__p", parts).select(*keys, "singer", "text", F.explode_outer(spans).alias("s"))
    return found.select(*keys, "singer", "text", F.col("s.first").alias("first"), F.col("s.last").alias("last"), F.col("s.reading").alias("reading"))


def parse_inline_timed(files: DataFrame) -> DataFrame:
    """``[N|mm:ss:cc]text`` checkpoints; N is the beat count and a trailing 0 of a longer N marks the line end.

    Every character of the line is a row: the first after a stamp carries it, the others have no beat and a null time; a stamp that
    no character follows is a row with an empty one.
    """
    bounded_batches(files.sparkSession)
    keys = [c for c in files.columns if c != "content"]
    schema = StructType([files.schema[c] for c in keys])
    for name, kind in (("line_no", "long"), ("char_no", "long"), ("ch", "string"), ("check_count", "integer"), ("is_line_end", "boolean"), ("ms", "long")):
        schema = schema.add(name, kind)
    return files.mapInArrow(inline.read_letters("content", keys), schema)


def lyrics_query_from_file(files: DataFrame) -> DataFrame:
    """Search key of a file: title and artist tags, else the file stem."""
    tag = lambda name: F.nullif(
        strip(F.coalesce(F.try_element_at(F.regexp_extract_all("content", F.lit(rf"(?im)^\[{name}:([^\]\n]*)\]"), 1), F.lit(-1)), F.lit(""))),
        F.lit(""),
    )
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    tagged = F.concat_ws(" ", tag("ti"), tag("ar"))
    return files.select("file_id", F.when(tag("ti").isNotNull(), tagged).otherwise(stem).alias("query"))


def parse_sections_spec(spec: Column) -> Column:
    """``60-180, 7:30-9:00`` -> array of (start_s, end_s); a range that is not two ordered times fails the query."""
    pieces = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    seconds = lambda t: F.aggregate(
        F.split(F.trim(t), ":"), F.lit(0.0), lambda a, x: a * 60 + F.try_to_number(F.trim(x), F.lit("99999999.999")).cast("double")
    )
    ranges = F.transform(
        pieces,
        lambda p: F.struct(
            seconds(F.element_at(F.split(p, "-"), 1)).alias("start_s"),
            seconds(F.try_element_at(F.split(p, "-"), F.lit(2))).alias("end_s"),
        ),
    )
    good = F.forall(ranges, lambda r: F.coalesce(r["end_s"] > r["start_s"], F.lit(False)))
    return F.when(good, ranges).otherwise(F.raise_error(F.concat(F.lit("bad section list: "), spec)))


def parse_dictionary(files: DataFrame) -> DataFrame:
    """Word / reading pairs from tab pairs, ``key=value`` sections or alternating lines (picked per file)."""
    # each step in a select of its own: a filter that is pushed down would repeat its patterns on every line
    plain = files.select("file_id", "content", F.regexp_replace("content", "\r\n?", "\n").alias("__body"))
    body = F.col("__body")
    kind = F.when(body.rlike(r"(?m)^[^\t\n]+\t"), "tab").when(body.rlike(r"(?m)^[^=\n]+="), "ini").otherwise("alternate")
    typed = plain.select("file_id", "content", kind.alias("kind"))
    pairs = F.when(F.col("kind") == "alternate", F.regexp_replace("content", r"([^\n]*)\n([^\n]*)(?:\n|$)", "$1\t$2\n")).otherwise(F.col("content"))
    body = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    typed = typed.withColumn("content", pairs)
    lines = typed.select("file_id", "kind", F.posexplode(F.transform(body, lambda x: strip(x))).alias("__pos", "raw")).withColumn("line_no", (F.col("__pos") + 1).cast("long"))
    mark = F.when(F.col("kind") == "ini", F.lit("=")).otherwise(F.lit("\t"))
    at = F.instr("raw", mark)
    word = F.when(at > 0, F.substr("raw", F.lit(1), at - 1)).otherwise(F.col("raw"))
    reading = F.when(at > 0, F.substr("raw", at + 1)).otherwise(F.lit(""))
    some = r"[^\s\u3000\ufeff]"
    full = word.rlike(some) & reading.rlike(some)
    return lines.where(((F.col("kind") != "ini") | ~F.col("raw").rlike(r"^[\[;#]")) & full).select(
        "file_id",
        F.when(F.col("kind") == "alternate", F.col("line_no") * 2 - 1).otherwise(F.col("line_no")).alias("line_no"),
        strip(word).alias("word"),
        strip(reading).alias("reading"),
    )


def read_asr_json(files: DataFrame) -> DataFrame:
    """Recogniser output -> one row per word; a segment without words counts as one word."""
    schema = (
        "struct<segments: array<struct<start: double, end: double, text: string, "
        "words: array<struct<s: double, e: double, w: string, p: double>>>>>"
    )
    segs = files.select("file_id", F.posexplode(F.from_json("content", schema)["segments"]).alias("seg_no", "seg"))
    whole = F.array(
        F.struct(
            F.col("seg.start").alias("s"), F.col("seg.end").alias("e"), F.col("seg.text").alias("w"), F.lit(None).cast("double").alias("p")
        )
    )
    words = F.when(F.coalesce(F.size("seg.words"), F.lit(0)) > 0, F.col("seg.words")).otherwise(whole)
    return segs.select("file_id", F.col("seg_no").cast("long").alias("seg_no"), F.posexplode(words).alias("word_no", "w")).select(
        "file_id",
        "seg_no",
        F.col("word_no").cast("long").alias("word_no"),
        F.col("w.s").alias("start_s"),
        F.col("w.e").alias("end_s"),
        F.col("w.w").alias("word"),
        F.coalesce("w.p", F.lit(1.0)).alias("prob"),
    )


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape_html(text: Column) -> Column:
    for entity, ch in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text


def html_text(markup: Column) -> Column:
    """Tags removed, entities resolved, white space collapsed."""
    return F.trim(F.regexp_replace(unescape_html(F.regexp_replace(markup, r"(?s)<[^>]*>", "")), r"\s+", " "))


def parse_html_links(pages: DataFrame) -> DataFrame:
    """Link rows of a page: position, address, label, and the page title."""
    shape = r'(?is)<a\s+href="([^"]+)"[^>]*>(.*?)</a>'
    g = lambda i: F.regexp_extract_all("html", F.lit(shape), i)
    return pages.select(
        "page_id",
        html_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.posexplode(F.arrays_zip(g(1).alias("href"), g(2).alias("label"))).alias("__pos", "p"),
    ).select(
        "page_id",
        "title",
        (F.col("__pos") + 1).cast("long").alias("link_no"),
        unescape_html(F.col("p.href")).alias("href"),
        html_text(F.col("p.label")).alias("label"),
    )


def parse_html_search(pages: DataFrame) -> DataFrame:
    """Result rows of a search page: title, artist, snippet and address from each row of the result table."""
    body = F.regexp_extract("html", r'(?is)<table[^>]*class="[^"]*\bsearchResult\b[^"]*"[^>]*>(.*?)</table>', 1)
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("__pos", "row"))
    link = lambda mark, i: F.regexp_extract(
        "row", rf'(?is)class="[^"]*\b{mark}\b[^"]*"[^>]*>.*?<a\s+href="([^"]+)"[^>]*>(.*?)</a>', i
    )
    return rows.select(
        "page_id",
        (F.col("__pos") + 1).cast("long").alias("row_no"),
        html_text(link("searchResult__title", 2)).alias("title"),
        html_text(link("searchResult__artist", 2)).alias("artist"),
        html_text(link("lyricList__beginning", 2)).alias("snippet"),
        unescape_html(link("searchResult__title", 1)).alias("href"),
    ).where(F.col("title") != "")


def parse_html_ruby(pages: DataFrame) -> DataFrame:
    """Ruby spans of an HTML body as ``{base||reading}`` marked text lines."""
    rb = r'(?is)<span class="ruby">\s*<span class="rb">(.*?)</span>\s*<span class="rt">(.*?)</span>\s*</span>'
    marked = F.regexp_replace(F.regexp_replace("html", rb, "{$1||$2}"), r"(?i)<br\s*/?>", "\n")
    return pages.select(
        "page_id", F.posexplode(F.split(marked, "\n")).alias("__pos", "__l")
    ).select("page_id", (F.col("__pos") + 1).cast("long").alias("line_no"), html_text(F.col("__l")).alias("text")).where(F.col("text") != "")


def parse_singer_runs(files: DataFrame) -> DataFrame:
    """``key：text`` prefixes at line starts: the singer key carries on to lines without one (inside a file)."""
    raw = strip(F.col("raw"))
    tag = r"^[\[【（(]?([^\[\]【】（）():：\s]{1,12})[\]】）):：]+\s*(.*)$"
    lines = split_lines(files).where(raw != "")
    lines = lines.withColumns(
        {
            "__key": F.when(raw.rlike(tag) & ~raw.rlike(r"^\[\d"), F.regexp_extract(raw, tag, 1)),
            "__text": F.when(raw.rlike(tag) & ~raw.rlike(r"^\[\d"), F.regexp_extract(raw, tag, 2)).otherwise(raw),
        }
    )
    w = Window.partitionBy("file_id").orderBy("line_no")
    return lines.select("file_id", "line_no", F.last("__key", True).over(w).alias("singer_key"), F.col("__text").alias("text"))


# Tag lines of the singer-labelled dialect.
TAG_LINE = r"^\s*@(\w+)\s*=(.*)$"


def parse_labelled_tags(files: DataFrame) -> DataFrame:
    """``@Tag=value`` tail lines of a labelled song file, in file order."""
    lines = split_lines(files.select("file_id", "content")).where(F.col("raw").rlike(TAG_LINE))
    return lines.select("file_id", "line_no", F.lower(F.regexp_extract("raw", TAG_LINE, 1)).alias("tag"), strip(F.regexp_extract("raw", TAG_LINE, 2)).alias("value"))


def parse_labelled_rubies(files: DataFrame) -> DataFrame:
    """``@RubyN=base,reading,pos1,pos2``: base, reading and the time range it holds for (missing ends are open)."""
    parts = F.split("value", ",")
    at = lambda i: tt.stamp_ms(F.regexp_replace(F.get(parts, F.lit(i)), r"(\d{2}):(\d{2,3})\]", "$1.$2]"))
    return parse_labelled_tags(files).where(F.col("tag").rlike(r"^ruby\d+$")).select(
        "file_id", "line_no", F.get(parts, F.lit(0)).alias("base"), F.regexp_replace(F.get(parts, F.lit(1)), tt.LRC_STAMP_BARE, "").alias("reading"),
        at(2).alias("from_ms"), at(3).alias("to_ms"),
    )


def parse_labelled_body(files: DataFrame) -> DataFrame:
    """Body lines with the singer that is current at the line end of ``【singer】`` labels carried on inside the file; lines with neither
    text nor stamp are dropped. Files of one file_id that differ carry on each for itself."""
    lines = split_lines(files.select("file_id", "content", F.xxhash64("content").alias("__file"))).where(~F.col("raw").rlike(TAG_LINE))
    labels = F.regexp_extract_all("raw", F.lit("【([^】]+)】"), 1)
    # a range, as rows of equal files stand beside each other
    w = Window.partitionBy("file_id", "__file").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    s = lines.withColumns(
        {
            "__first": F.regexp_extract("raw", r"^(?:\[[^\]]*\])*【([^】]+)】", 1),
            "__last": F.try_element_at(labels, F.lit(-1)),
        }
    )
    s = s.withColumn("singer", F.coalesce(F.nullif("__first", F.lit("")), F.last("__last", True).over(w)))
    stamps = F.regexp_extract_all("raw", F.lit(r"(\[\d+:\d+[:.]\d{2,3}\])"), 1)
    clock = lambda i: tt.stamp_ms(F.try_element_at(stamps, F.lit(i)))
    plain = strip(F.regexp_replace(F.regexp_replace("raw", r"\[\d+:\d+[:.]\d{2,3}\]", ""), "【[^】]+】", ""))
    out = s.select("file_id", "line_no", "singer", plain.alias("text"), clock(1).alias("start_ms"), clock(-1).alias("end_ms"), (F.size(stamps) > 0).alias("__timed"))
    return out.where((F.col("text") != "") | F.col("__timed")).drop("__timed")
