"""Queries over text clean-up, character edits, singers and footage scores, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseline.functions import bits, kana, scripts, similarity, textnorm
from verseline.functions import timetext as tt
from verseline.operators import cleaning as cl
from verseline.operators import windows as wn
from verseline.plans import bindings as b
from verseline.plans.formats import _CLK, CHARS_SQL, timed_chars
from verseline.plans.registry import query

_D = "WITH " + b.DOC_LINES_SQL
_L = "WITH " + b.LINES_SQL
_A = "WITH " + b.ASSETS_SQL
RND3 = "CAST(CAST(CAST({0} AS VARCHAR) AS DECIMAL(30, 3)) AS DOUBLE)"
RND2 = "CAST(CAST(CAST({0} AS VARCHAR) AS DECIMAL(30, 2)) AS DOUBLE)"


@query(f"{_D} SELECT doc_id, line_no, ch, count(*) AS n FROM (SELECT doc_id, line_no, unnest(string_split(text, '')) AS ch FROM doc_lines WHERE text <> '') GROUP BY ALL")
def explode_chars(spark, sf):
    return cl.explode_chars(b.doc_lines(spark, sf)).groupBy("doc_id", "line_no", "ch").agg(F.count("*").alias("n"))


@query(
    f"""{_D}, s AS (SELECT *, (line_no * 3170 + doc_id % 1000) AS t FROM doc_lines)
SELECT doc_id AS file_id, line_no + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 5 END AS line_no,
 '[' || {_CLK.format('t')} || ']' || CASE WHEN line_no % 5 = 0 THEN '[' || {_CLK.format('(t + 600000)')} || ']' ELSE '' END || trim(text) AS text FROM s WHERE trim(text) <> ''"""
)
def sanitize_lrc(spark, sf):
    return cl.sanitize_lrc(b.lrc_files(spark, sf))


@query(f"{_D} SELECT doc_id AS file_id, line_no, text FROM doc_lines")
def strip_intro_credits(spark, sf):
    """Documents with up to three credit lines put in front; exactly the document's own lines come back."""
    docs = b.spread(b.table(spark, sf, "documents"))
    title = F.concat(F.lit("song "), F.col("doc_id").cast("string"))
    heads = F.array(F.lit("Composer: nobody"), F.concat(F.upper(title), F.lit(" by "), F.col("source")), F.concat(title, F.lit(" - live")))
    body = F.concat(F.slice(heads, F.lit(1), F.pmod("doc_id", F.lit(4)).cast("int")), F.split("text", "\n"))
    lines = docs.select(F.col("doc_id").alias("file_id"), title.alias("title"), F.col("source").alias("artist"), F.pmod("doc_id", F.lit(4)).alias("heads"), F.posexplode(body).alias("p", "text"))
    lines = lines.withColumn("line_no", F.col("p") + 1 - F.col("heads"))
    return cl.strip_intro_credits(lines).select("file_id", "line_no", "text")


@query(
    """WITH t AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id AS file_id, turn * 3 + k AS line_no, CASE WHEN k = 0 AND turn = 0 THEN 'credit' WHEN k = 2 THEN 'translation' ELSE 'lyric' END AS role FROM t, (SELECT unnest([0, 1, 2]) AS k)"""
)
def split_user_credits(spark, sf):
    conv = b.table(spark, sf, "conversations", "conv_id", "turn", "text")
    rows = F.array(F.lit("Composer: someone"), F.concat(F.lit("sung "), F.col("text")), F.lit("翻译。"))
    lines = conv.select(F.col("conv_id").alias("file_id"), "turn", F.posexplode(rows).alias("k", "text"))
    lines = lines.select("file_id", (F.col("turn") * 3 + F.col("k")).alias("line_no"), "text", (F.col("turn") * 10000 + F.when(F.col("k") == 0, 0).otherwise(4000)).alias("start_ms"))
    return cl.split_user_credits(lines).select("file_id", "line_no", "role")


@query(
    """SELECT p_partkey, k AS n, CASE p_partkey % 3 WHEN 0 THEN [p_name || ' - ' || p_brand, p_name || ' ' || p_brand, p_name, p_brand] WHEN 1 THEN [p_name || ' / ' || p_type || ' / ' || p_brand, p_name || ' ' || p_type || ' ' || p_brand, p_name, p_type, p_brand] ELSE [p_name] END[k] AS variant
FROM part, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <= CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 1 END"""
)
def query_variants(spark, sf):
    p = b.table(spark, sf, "part")
    k = F.pmod("p_partkey", F.lit(3))
    key = F.when(k == 0, F.concat("p_name", F.lit(" -  "), F.col("p_brand"))).when(k == 1, F.concat("p_name", F.lit(" / "), "p_type", F.lit(" / "), "p_brand")).otherwise(F.col("p_name"))
    key = F.when(k == 0, F.concat("p_name", F.lit(" - "), F.col("p_brand"))).otherwise(key)
    return p.select("p_partkey", F.posexplode(cl.query_variants(key)).alias("i", "variant")).select("p_partkey", (F.col("i") + 1).alias("n"), "variant")


# ---------------------------------------------------------------- footage
@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'clip' WHEN 1 THEN 'video' WHEN 2 THEN 'web' WHEN 3 THEN 'user' ELSE CASE WHEN url LIKE '%://%' THEN 'web' ELSE 'user' END END AS origin FROM pages")
def classify_asset(spark, sf):
    p = b.table(spark, sf, "pages", "page_id", "url")
    k, n = F.pmod("page_id", F.lit(5)), F.col("page_id").cast("string")
    src = F.when(k == 1, F.concat(F.lit("source-video@"), n)).when(k == 2, F.concat(F.lit("ftp://host/"), n, F.lit(".mp4"))).when(k == 3, F.concat(F.lit("C:\\pictures\\"), n)).otherwise(F.col("url"))
    return p.select("page_id", cl.classify_asset(src, F.when(k == 0, "clip").otherwise("")).alias("origin"))


_SCORE = f"""CASE WHEN luma < 0.07 OR detail < 0.03 THEN 0.0::DOUBLE ELSE {RND3.format("((0.32::DOUBLE * least(1.0::DOUBLE, color / 0.22::DOUBLE) + 0.24::DOUBLE * least(1.0::DOUBLE, luma / 0.32::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, detail / 0.17::DOUBLE) + 0.24::DOUBLE * CASE WHEN motion BETWEEN 0.006 AND 0.09 THEN 1.0::DOUBLE WHEN motion < 0.006 THEN 0.55::DOUBLE ELSE 0.6::DOUBLE END) * CASE WHEN fade THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END)")} END"""


def scored(spark, sf):
    a = b.assets(spark, sf)
    return a.withColumn("score", cl.score_shot(F.col("luma"), F.col("detail"), F.col("color"), F.col("motion"), F.col("fade")))


SCORED_SQL = b.ASSETS_SQL + f", scored AS (SELECT *, {_SCORE} AS score FROM assets)"


@query(f"WITH {SCORED_SQL} SELECT asset_id, score FROM scored")
def score_shot(spark, sf):
    return scored(spark, sf).select("asset_id", "score")


@query(
    f"""WITH {SCORED_SQL} SELECT asset_id, score + CASE WHEN asset_id % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN origin_code = 'r' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM scored"""
)
def clip_quality(spark, sf):
    a = scored(spark, sf)
    tags = F.array(F.when(F.pmod("asset_id", F.lit(5)) == 0, "best").otherwise("plain"), F.col("origin_code"))
    return a.select("asset_id", cl.clip_quality(F.col("score"), tags, F.array(F.lit("r"), F.lit("zz"))).alias("quality"))


@query(
    f"""{_A} SELECT asset_id, concat_ws(',', CASE WHEN motion >= 0.05 THEN 'dynamic' WHEN motion <= 0.015 THEN 'calm' END, CASE WHEN luma >= 0.55 THEN 'bright' WHEN luma <= 0.22 THEN 'dark' END) AS tags FROM assets"""
)
def auto_tags(spark, sf):
    return b.assets(spark, sf).select("asset_id", F.array_join(cl.auto_tags(F.col("motion"), F.col("luma")), ",").alias("tags"))


@query(
    f"""{_A} SELECT asset_id, 'c' || substr(sha1(library_id || '|' || CAST(CAST(t_in AS BIGINT) AS VARCHAR) || '.00'), 1, 10) AS clip_id, 'p' || substr(md5('supplier ' || library_id), 1, 6) AS person_id FROM assets"""
)
def stable_id(spark, sf):
    a = b.assets(spark, sf)
    return a.select(
        "asset_id", bits.clip_id(F.col("library_id").cast("string"), F.col("t_in")).alias("clip_id"), bits.person_id(F.concat(F.lit("supplier "), F.col("library_id").cast("string"))).alias("person_id")
    )


@query(
    f"""WITH {SCORED_SQL}, u AS (SELECT *, 400 + asset_id % 900 AS w, 360 + asset_id % 700 AS h FROM scored)
SELECT asset_id, score FROM u WHERE score >= 0.35 AND least(w, h) >= 480 AND asset_id NOT IN (SELECT asset_id FROM assets WHERE quality > 80000)"""
)
def usable_assets(spark, sf):
    a = scored(spark, sf).withColumns({"w": F.pmod("asset_id", F.lit(900)) + 400, "h": F.pmod("asset_id", F.lit(700)) + 360})
    return cl.usable_assets(a, b.assets(spark, sf).where(F.col("quality") > 80000)).select("asset_id", "score")


@query(
    f"""{_A}, u AS (SELECT *, 400 + asset_id % 900 AS w, 360 + asset_id % 1700 AS h, 24 + asset_id % 37 AS fps FROM assets)
SELECT library_id, min(least(w, h)) AS short_side, min(fps) AS fps FROM u WHERE (least(w, h) < 1080 OR fps < 30) AND asset_id IN (SELECT asset_id FROM assets WHERE quality > 40000) GROUP BY 1"""
)
def low_quality_sources(spark, sf):
    a = b.assets(spark, sf).withColumns({"w": F.pmod("asset_id", F.lit(900)) + 400, "h": F.pmod("asset_id", F.lit(1700)) + 360, "fps": F.pmod("asset_id", F.lit(37)) + 24})
    return cl.low_quality_sources(a, b.assets(spark, sf).where(F.col("quality") > 40000))


@query(
    f"""{_A}, f AS (SELECT asset_id, CASE asset_id % 7 WHEN 0 THEN 23.976 WHEN 1 THEN 29.97 WHEN 2 THEN 59.94 WHEN 3 THEN 119.88 WHEN 4 THEN -1.0 WHEN 5 THEN NULL ELSE (asset_id % 4200) / 40 END::DOUBLE AS rate FROM assets)
SELECT asset_id, CAST(CASE WHEN rate IS NULL OR rate <= 0 THEN 0 WHEN abs(rate - 23.976::DOUBLE) < 0.02 THEN 24 WHEN abs(rate - 29.97::DOUBLE) < 0.02 THEN 30 WHEN abs(rate - 59.94::DOUBLE) < 0.02 THEN 60 WHEN abs(rate - 119.88::DOUBLE) < 0.02 THEN 120 ELSE greatest(1, round_even(rate, 0)) END AS INTEGER) AS fps FROM f"""
)
def normalize_fps(spark, sf):
    k = F.pmod("asset_id", F.lit(7))
    rate = F.when(k == 0, 23.976).when(k == 1, 29.97).when(k == 2, 59.94).when(k == 3, 119.88).when(k == 4, -1.0).when(k == 6, F.pmod("asset_id", F.lit(4200)) / 40)
    return b.assets(spark, sf).select("asset_id", cl.normalize_fps(rate).alias("fps"))


# ---------------------------------------------------------------- characters and singers
@query(
    f"""WITH {CHARS_SQL}, g AS (SELECT *, CAST(track_id AS BIGINT) % 3 AS k FROM chars), m AS (SELECT *, k = 0 OR (k = 1 AND singer_id = 'lead') OR (k = 2 AND singer_id = 'choir') AS mine FROM g)
SELECT track_id, line_no, char_no, ch FROM m WHERE mine"""
)
def filter_singers(spark, sf):
    chars = timed_chars(spark, sf)
    k = F.pmod(F.col("track_id").cast("long"), F.lit(3))
    groups = chars.select("track_id").distinct().withColumn(
        "singer_ids", F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("lead"))).otherwise(F.array(F.lit("choir")))
    )
    return cl.filter_singers(chars, groups).select("track_id", "line_no", "char_no", "ch")


@query(f"WITH {CHARS_SQL} SELECT track_id, line_no, char_no, CASE WHEN t IS NOT NULL THEN greatest(0, t - 5000) END AS first_cp, CASE WHEN release_ms IS NOT NULL THEN greatest(0, release_ms - 5000) END AS release_ms FROM chars")
def shift_times(spark, sf):
    out = cl.shift_times(timed_chars(spark, sf), offset_ms=-5000)
    return out.select("track_id", "line_no", "char_no", F.get("cps_ms", F.lit(0)).alias("first_cp"), "release_ms")


@query(
    f"""{_D}, p AS (SELECT doc_id, line_no, length(text) AS n FROM doc_lines)
SELECT doc_id, line_no, k AS span_no, CASE k WHEN 1 THEN 2 ELSE 7 + n END AS first, CASE k WHEN 1 THEN 5 ELSE 10 + n END AS last FROM p, (SELECT unnest([1, 2]) AS k)"""
)
def detect_chorus_spans(spark, sf):
    text = F.concat(F.lit("ab(cd）"), F.translate("text", "()", "__"), F.lit("x（ef)rest(open"))
    return b.doc_lines(spark, sf).select("doc_id", "line_no", F.posexplode(cl.chorus_spans(text)).alias("i", "s")).select(
        "doc_id", "line_no", (F.col("i") + 1).alias("span_no"), F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last")
    )


@query(
    f"""WITH {CHARS_SQL} SELECT track_id, line_no, char_no, CASE WHEN release_ms IS NOT NULL THEN 'LINE_END' WHEN t IS NULL THEN 'REST' ELSE 'CHAR_START' END AS kind FROM chars"""
)
def timetag_type(spark, sf):
    c = timed_chars(spark, sf)
    last = F.col("release_ms").isNotNull()
    return c.select("track_id", "line_no", "char_no", cl.timetag_type(F.col("check_count"), F.size("cps_ms"), last, last, F.lit(0)).alias("kind"))


@query(
    f"""{_D}, s AS (SELECT doc_id, line_no, text, length(text) AS n FROM doc_lines),
c AS (SELECT *, list_min(list_transform(list_filter(range(1, n - 1), lambda k: cs[k + 1] = ' '), lambda k: {{'p': CASE WHEN cs[k] IN (',', ';', ':', '!', '?') AND abs(k - n / 2) <= n * 0.22::DOUBLE THEN 0 ELSE 1 END, 'd': abs(k - n / 2), 'k': k}})).k AS cut FROM (SELECT *, string_split(text, '') AS cs FROM s)),
w AS (SELECT *, n * 0.5 > 17 AND n > 2 AND cut IS NOT NULL AS wide FROM c)
SELECT doc_id, line_no, 0 AS part, CASE WHEN wide THEN rtrim(substr(text, 1, cut)) ELSE text END AS text FROM w UNION ALL SELECT doc_id, line_no, 1, ltrim(substr(text, cut + 1)) FROM w WHERE wide"""
)
def auto_split_long(spark, sf):
    return cl.auto_split_long(b.doc_lines(spark, sf))


@query(
    f"""{_D}, s AS (SELECT doc_id AS track_id, line_no, k * 6 AS first, k * 6 + 3 AS last, 'r' || k AS reading, length(text) // 2 AS at_ FROM doc_lines, (SELECT unnest(range(0, 10)) AS k) WHERE k * 6 + 3 < length(text))
SELECT track_id, line_no, CASE WHEN last < at_ THEN 0 ELSE 1 END AS part, CASE WHEN last < at_ THEN first ELSE first - at_ END AS first, CASE WHEN last < at_ THEN last ELSE last - at_ END AS last, reading FROM s WHERE last < at_ OR first >= at_"""
)
def split_line(spark, sf):
    ln = b.doc_lines(spark, sf).withColumnRenamed("doc_id", "track_id")
    spans = ln.select("track_id", "line_no", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k"))
    spans = spans.where(F.col("k") * 6 + 3 < F.col("n")).select("track_id", "line_no", (F.col("k") * 6).alias("first"), (F.col("k") * 6 + 3).alias("last"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("reading"))
    cuts = ln.select("track_id", "line_no", F.floor(F.length("text") / 2).alias("at"))
    return cl.split_spans(spans, cuts)


@query(
    f"""{_D} SELECT doc_id AS track_id, (line_no - 1) // 2 AS pair_no, string_agg(text, ' ' ORDER BY line_no) AS text, CAST(length(arg_min(text, line_no)) + 1 AS INTEGER) AS shift FROM doc_lines GROUP BY 1, 2"""
)
def merge_lines(spark, sf):
    return cl.merge_line_pairs(b.doc_lines(spark, sf).withColumnRenamed("doc_id", "track_id"))


@query(
    f"""WITH {CHARS_SQL}, s AS (SELECT *, char_no // 3 AS sub FROM chars) SELECT track_id, line_no, char_no, ch, CAST(sub AS BIGINT) AS sub_line, CAST(char_no % 3 AS INTEGER) AS new_char_no FROM s"""
)
def break_line(spark, sf):
    c = timed_chars(spark, sf).select("track_id", "line_no", "char_no", "ch", ((F.col("char_no") > 0) & (F.pmod("char_no", F.lit(3)) == 0)).alias("break_here"))
    return cl.break_lines(c)


# every third line joins the one before; lines of clicks have no characters
@query(
    f"""WITH {CHARS_SQL}, l AS (SELECT track_id, line_no, line_no % 3 = 0 AS up, CASE WHEN text = 'click' THEN 0 ELSE length(text) END AS n FROM lines),
h AS (SELECT *, sum(CASE WHEN up AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY line_no) AS new_line FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY line_no) AS rn FROM l)),
o AS (SELECT *, coalesce(sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END) OVER (PARTITION BY track_id, new_line ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift,
  coalesce(sum(n) OVER (PARTITION BY track_id, new_line ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM h)
SELECT c.track_id, CAST(new_line AS BIGINT) AS line_no, CAST(shift + char_no AS BIGINT) AS char_no, ch, c.line_no AS source_line, char_no AS source_char FROM chars c JOIN (SELECT track_id, line_no AS own, new_line, shift, n FROM o) o ON o.track_id = c.track_id AND own = c.line_no WHERE o.n > 0
UNION ALL SELECT track_id, CAST(new_line AS BIGINT), CAST(shift + n AS BIGINT), ' ', NULL, NULL FROM o WHERE n > 0 AND rest > 0"""
)
def join_lines(spark, sf):
    chars = timed_chars(spark, sf)
    ln = b.lines(spark, sf)
    spoken = chars.join(ln.where("text <> 'click'").select("track_id", "line_no"), ["track_id", "line_no"], "left_semi")
    return cl.join_lines(spoken, ln.select("track_id", "line_no", (F.pmod("line_no", F.lit(3)) == 0).alias("join_up")))


@query(
    f"""WITH {CHARS_SQL}, l AS (SELECT track_id, line_no, CASE WHEN text <> 'click' THEN start_ms END AS start_ms, CASE WHEN text <> 'click' THEN start_ms + length(text) * 100 END AS last_ms, CASE WHEN line_no % 4 = 0 AND text <> 'click' THEN end_ms END AS end_ms FROM lines),
n AS (SELECT *, first_value(start_ms IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l)
SELECT track_id, line_no, start_ms, last_ms, coalesce(end_ms, CASE WHEN start_ms IS NOT NULL THEN CASE WHEN nxt >= last_ms THEN nxt ELSE last_ms END END) AS end_ms FROM n"""
)
def borrow_line_ends(spark, sf):
    """Clicks as blank lines, every fourth line with an end of its own."""
    ln = b.lines(spark, sf)
    sung = F.col("text") != "click"
    rows = ln.select(
        "track_id", "line_no", F.when(sung, F.col("start_ms")).alias("start_ms"), F.when(sung, F.col("start_ms") + F.length("text") * 100).alias("last_ms"),
        F.when(sung & (F.pmod("line_no", F.lit(4)) == 0), F.col("end_ms")).alias("end_ms"),
    )
    return wn.borrow_line_ends(rows)


@query(
    f"""WITH {CHARS_SQL} SELECT track_id, line_no, char_no, t AS ms, 0 AS cp_no, false AS is_release, upper(ch) AS part FROM chars WHERE t IS NOT NULL
UNION ALL SELECT track_id, line_no, char_no, release_ms, CASE WHEN t IS NULL THEN 0 ELSE 1 END, true, NULL FROM chars WHERE release_ms IS NOT NULL"""
)
def flatten_timestamps(spark, sf):
    return cl.flatten_timestamps(timed_chars(spark, sf))


_CLASS = r"CASE WHEN regexp_matches(ch, '^\p{L}') THEN 'alphabet' WHEN regexp_matches(ch, '^[0-9]') THEN 'number' WHEN ch = ' ' THEN 'space' ELSE 'symbol' END"


@query(f"{_D}, c AS (SELECT unnest(string_split(text, '')) AS ch, lang FROM doc_lines WHERE text <> '') SELECT lang, {_CLASS} AS klass, count(*) AS n FROM c GROUP BY 1, 2")
def char_class(spark, sf):
    c = cl.explode_chars(b.doc_lines(spark, sf, "lang"))
    return c.groupBy("lang", "ch").agg(F.count("*").alias("n")).groupBy("lang", scripts.char_class(F.col("ch")).alias("klass")).agg(F.sum("n").alias("n"))


@query(f"{_D}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM doc_lines WHERE text <> '') SELECT doc_id, count(*) FILTER (ch <> ' ') AS beats FROM c GROUP BY 1")
def default_check_counts(spark, sf):
    c = cl.explode_chars(b.doc_lines(spark, sf)).groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.sum(F.col("n") * scripts.default_checks(scripts.char_class(F.col("ch")))).alias("beats"))


@query(f"WITH {CHARS_SQL} SELECT track_id, line_no, char_no, CASE WHEN char_no % 4 = 1 THEN 1 WHEN char_no % 4 = 3 THEN 0 ELSE 1 END AS check_count FROM chars")
def recount_checks(spark, sf):
    """Odd characters become digits; every other one of those loses its reading and has no stamp."""
    c = timed_chars(spark, sf).withColumns(
        {
            "ch": F.when(F.pmod("char_no", F.lit(2)) == 1, "7").otherwise(F.col("ch")),
            "parts": F.when(F.pmod("char_no", F.lit(4)) == 3, F.array().cast("array<string>")).otherwise(F.col("parts")),
        }
    )
    return cl.recount_checks(c).select("track_id", "line_no", "char_no", "check_count")


@query(
    f"""WITH {CHARS_SQL} SELECT track_id, line_no, char_no, CASE WHEN char_no % 3 = 0 AND char_no = n - 1 THEN 0 WHEN char_no % 3 < 2 THEN 1 ELSE 0 END AS n_parts FROM chars"""
)
def drop_by_class(spark, sf):
    """Characters 0-1 of every three form a compound whose second character is a kanji; latin readings are dropped outside it."""
    c = timed_chars(spark, sf).withColumn("ch", F.when(F.pmod("char_no", F.lit(3)) == 1, "夢").otherwise(F.col("ch")))
    return cl.drop_by_class(c, classes=("alphabet",)).select("track_id", "line_no", "char_no", F.size("parts").alias("n_parts"))


@query(f"{_L} SELECT track_id, line_no, CASE WHEN text = 'view' THEN 'click' ELSE text END AS singer_id FROM lines WHERE text <> 'error'")
def replace_singer(spark, sf):
    ln = b.lines(spark, sf).select("track_id", "line_no", F.col("text").alias("singer_id"))
    kinds = ln.select("singer_id").distinct().where(F.col("singer_id").isin("view", "error"))
    mapping = kinds.select(F.col("singer_id").alias("old_id"), F.when(F.col("singer_id") == "view", "click").alias("new_id"))
    return cl.replace_singer(ln, mapping)


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'lead' ELSE role END AS role FROM conversations")
def remap_roles(spark, sf):
    conv = b.table(spark, sf, "conversations", "conv_id", "turn", "role")
    renames = conv.select("role").distinct().where(F.col("role") == "user").withColumn("new_role", F.lit("lead"))
    return cl.remap_roles(conv, renames)


# ---------------------------------------------------------------- scalar functions
@query(
    r"""SELECT o_orderkey, lower(trim(regexp_replace('  ' || o_orderpriority || '   X ' || o_orderstatus, '\s+', ' ', 'g'))) AS norm,
 regexp_replace(lower(o_orderpriority || o_orderstatus), '[^0-9a-z]+', '', 'g') AS compact, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS word FROM orders"""
)
def normalize_text(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(
        "o_orderkey", textnorm.normalize_text(F.concat(F.lit("　 "), F.col("o_orderpriority"), F.lit(" 　 Ｘ "), F.col("o_orderstatus"))).alias("norm"),
        textnorm.compact(F.concat("o_orderpriority", "o_orderstatus")).alias("compact"), textnorm.word_key(F.col("o_orderpriority")).alias("word"),
    )


_LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
_VISIBLE = r"length(regexp_replace(text, '\s', '', 'g'))"


@query(f"{_D} SELECT doc_id, line_no, CASE WHEN {_VISIBLE} = 0 THEN 'other' WHEN {_LETTERS} * 2 > {_VISIBLE} THEN 'en' WHEN {_LETTERS} * 5 > {_VISIBLE} THEN 'mixed' ELSE 'other' END AS language, length(text) * 0.5::DOUBLE AS units FROM doc_lines")
def detect_language(spark, sf):
    t = F.col("text")
    return b.doc_lines(spark, sf).select("doc_id", "line_no", scripts.detect_language(t).alias("language"), scripts.display_units(t).alias("units"))


@query(
    f"""{_L} SELECT line_no, {_CLK.format('start_ms')} AS lrc, CAST(start_ms // 60000 AS VARCHAR) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') AS timecode, start_ms AS back FROM lines"""
)
def time_text(spark, sf):
    ms = F.col("start_ms")
    return b.lines(spark, sf).select("line_no", tt.lrc_clock(ms).alias("lrc"), tt.timecode(ms).alias("timecode"), tt.timecode_ms(tt.timecode(ms)).alias("back"))


# letters a-z written as kana, so part names become readings with small kana and long marks
_AZ, _KANA = "abcdefghijklmnopqrstuvwxyz ", "あゃくどえふげはいじっらむんおぷきるすとうょわきゅーざ"
_SMALL = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー"


@query(
    f"""WITH r AS (SELECT p_partkey, translate(lower(p_name), '{_AZ}', '{_KANA}') AS r FROM part), m AS (SELECT *, regexp_extract_all(r, '.[{_SMALL}]*', 0) AS ms FROM r)
SELECT p_partkey, r AS reading, array_to_string(ms, '|') AS moras, array_to_string(ms[1:(len(ms) + 1) // 2], '') || '|' || array_to_string(ms[(len(ms) + 1) // 2 + 1:], '') AS halves FROM m WHERE len(ms) > 2"""
)
def kana_units(spark, sf):
    r = F.translate(F.lower("p_name"), _AZ, _KANA)
    p = b.table(spark, sf, "part").select("p_partkey", r.alias("reading")).where(F.size(kana.moras(F.col("reading"))) > 2)
    return p.select(
        "p_partkey", "reading", F.array_join(kana.moras(F.col("reading")), "|").alias("moras"), F.array_join(kana.split_for_checks(F.col("reading"), F.lit(2)), "|").alias("halves")
    )


# the readings' kana and pairs in Hepburn spelling
_SPELT = (
    "MAP {'あ': 'a', 'ゃ': 'ya', 'く': 'ku', 'ど': 'do', 'え': 'e', 'ふ': 'fu', 'げ': 'ge', 'は': 'ha', 'い': 'i', 'じ': 'ji', 'ら': 'ra', 'む': 'mu', 'お': 'o', 'ぷ': 'pu', 'き': 'ki', 'る': 'ru', 'す': 'su', 'と': 'to', "
    "'う': 'u', 'ょ': 'yo', 'わ': 'wa', 'ゅ': 'yu', 'ざ': 'za', 'ん': 'n', 'きゃ': 'kya', 'きゅ': 'kyu', 'きょ': 'kyo', 'じゃ': 'ja', 'じゅ': 'ju', 'じょ': 'jo'}"
)


@query(
    f"""WITH r AS (SELECT p_partkey, translate(lower(p_name), '{_AZ}', '{_KANA}') AS reading FROM part), u AS (SELECT *, regexp_extract_all(reading, '[きじ][ゃゅょ]|.') AS u FROM r),
s AS (SELECT p_partkey, reading, u, list_transform(u, lambda x: {_SPELT}[x]) AS s FROM u)
SELECT p_partkey, reading, array_to_string(list_transform(range(1, len(u) + 1), lambda k: CASE
  WHEN u[k] = 'っ' THEN CASE WHEN k = len(u) OR u[k + 1] IN ('っ', 'ー') OR s[k + 1][1] IN ('a', 'i', 'u', 'e', 'o', 'n') THEN 'xtsu' ELSE s[k + 1][1] END
  WHEN u[k] = 'ー' THEN coalesce(nullif(CASE WHEN (list_filter(u[1:k - 1], lambda y: y NOT IN ('っ', 'ー')))[-1] = 'ん' THEN '-' ELSE right({_SPELT}[(list_filter(u[1:k - 1], lambda y: y NOT IN ('っ', 'ー')))[-1]], 1) END, ''), '-')
  WHEN u[k] = 'ん' THEN CASE WHEN k < len(u) AND u[k + 1] NOT IN ('っ', 'ー') AND s[k + 1][1] IN ('a', 'i', 'u', 'e', 'o', 'y') THEN 'n' || chr(39) ELSE 'n' END
  ELSE s[k] END), '') AS romaji FROM s"""
)
def romaji(spark, sf):
    """Readings in Hepburn spelling."""
    r = F.translate(F.lower("p_name"), _AZ, _KANA)
    p = b.table(spark, sf, "part").select("p_partkey", r.alias("reading"))
    return p.select("p_partkey", "reading", kana.romaji_parts(F.array("reading"))[0].alias("romaji"))


_DIG = "'零一二三四五六七八九'"
_KD = "CASE WHEN ({v} // {p}) % 10 = 0 THEN '' ELSE CASE WHEN ({v} // {p}) % 10 = 1 AND {p} > 1 THEN '' ELSE substr(" + _DIG + ", CAST(({v} // {p}) % 10 AS INTEGER) + 1, 1) END || '{u}' END"


def _kgroup(v):
    return "(" + " || ".join(_KD.format(v=v, p=p, u=u) for p, u in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))) + ")"


@query(
    f"""SELECT o_orderkey, n, CASE WHEN n // 10000 > 0 THEN {_kgroup('(n // 10000)')} || '万' ELSE '' END || {_kgroup('(n % 10000)')} AS kanji FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + 1 AS n FROM orders)"""
)
def kanji_numbers(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", (F.floor("o_totalprice") + 1).alias("n"))
    return o.select("o_orderkey", "n", kana.kanji_number(F.col("n")).alias("kanji"))


_ONES = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
_TENS = "['', 'ten', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"


def _small(v):
    return f"(CASE WHEN {v} < 20 THEN {_ONES}[{v} + 1] ELSE {_TENS}[{v} // 10 + 1] || CASE WHEN {v} % 10 > 0 THEN ' ' || {_ONES}[{v} % 10 + 1] ELSE '' END END)"


def _thousand(v):
    return f"(CASE WHEN {v} < 100 THEN {_small(v)} ELSE {_ONES}[{v} // 100 + 1] || ' hundred' || CASE WHEN {v} % 100 > 0 THEN ' and ' || {_small(f'({v} % 100)')} ELSE '' END END)"


@query(
    f"""SELECT o_orderkey, n, CASE WHEN n // 1000 > 0 THEN {_thousand('(n // 1000)')} || ' thousand' || CASE WHEN n % 1000 > 0 THEN ' ' || {_thousand('(n % 1000)')} ELSE '' END ELSE {_thousand('n')} END AS words FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)"""
)
def english_numbers(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("n"))
    return o.select("o_orderkey", "n", kana.english_number(F.col("n")).alias("words"))


_HI = "['g', 'kk', 'n', 'd', 'tt', 'r', 'm', 'b', 'pp', 's', 'ss', '', 'j', 'jj', 'ch', 'k', 't', 'p', 'h']"
_HV = "['a', 'ae', 'ya', 'yae', 'eo', 'e', 'yeo', 'ye', 'o', 'wa', 'wae', 'oe', 'yo', 'u', 'wo', 'we', 'wi', 'yu', 'eu', 'ui', 'i']"
_HF = "['', 'k', 'k', 'ks', 'n', 'nj', 'nh', 't', 'l', 'lk', 'lm', 'lb', 'ls', 'lt', 'lp', 'lh', 'm', 'p', 'ps', 't', 't', 'ng', 't', 't', 'k', 't', 'p', '']"


@query(f"SELECT o_orderkey, chr(CAST(44032 + k AS INTEGER)) AS ch, {_HI}[k // 588 + 1] || {_HV}[k % 588 // 28 + 1] || {_HF}[k % 28 + 1] AS romaji FROM (SELECT o_orderkey, (o_orderkey * 7) % 11172 AS k FROM orders)")
def hangul_romaji(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 7, F.lit(11172)).alias("k"))
    hi, mid, lo = F.floor((F.col("k") + 44032) / 4096), F.floor((F.col("k") + 44032) / 64) % 64, (F.col("k") + 44032) % 64
    raw = F.unhex(F.concat(F.lpad(F.hex(hi + 224), 2, "0"), F.lpad(F.hex(mid + 128), 2, "0"), F.lpad(F.hex(lo + 128), 2, "0")))
    ch = F.decode(raw, "UTF-8")
    return o.select("o_orderkey", ch.alias("ch"), kana.hangul_romaji(ch).alias("romaji"))


@query("SELECT o_orderkey, substr(r, 1, n // 2 + n % 2) || '|' || substr(r, n // 2 + n % 2 + 1) AS parts FROM (SELECT o_orderkey, o_orderpriority AS r, length(o_orderpriority) AS n FROM orders)")
def reading_split(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select("o_orderkey", F.array_join(kana.head_heavy_split(F.col("o_orderpriority"), F.lit(2)), "|").alias("parts"))


@query("SELECT vec_id, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN CAST(embedding[i + 1] AS DOUBLE) >= m THEN (1::BIGINT << i)::HUGEINT ELSE 0::HUGEINT END)) + CASE WHEN CAST(embedding[64] AS DOUBLE) >= m THEN (-9223372036854775808)::HUGEINT ELSE 0::HUGEINT END AS BIGINT) AS ahash FROM (SELECT vec_id, embedding, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings)")
def average_hash(spark, sf):
    e = b.table(spark, sf, "embeddings")
    return e.select("vec_id", bits.hash_bits(F.col("embedding")).alias("ahash"))
