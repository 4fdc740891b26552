"""Queries over joins, de-duplication, matching, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseline.functions import similarity as sim
from verseline.functions import textnorm
from verseline.operators import catalogue as cg
from verseline.operators import matching as mt
from verseline.operators import ranking as rk
from verseline.operators import walks as wk
from verseline.operators.ordered import salted_lookup
from verseline.plans import bindings as b
from verseline.plans.editing import RND2, SCORED_SQL, scored
from verseline.plans.formats import CHARS_SQL, timed_chars
from verseline.plans.registry import query
from verseline.session import cut_lineage

_D = "WITH " + b.DOC_LINES_SQL
_L = "WITH " + b.LINES_SQL
_A = "WITH " + b.ASSETS_SQL

# ---------------------------------------------------------------- joins
_TR = """tr AS (SELECT track_id, start_ms + line_no % 5 * 20 AS tr_ms, line_no AS tr_no, CASE line_no % 4 WHEN 0 THEN text WHEN 1 THEN '//skip' ELSE 'tr ' || line_no END AS tr_text FROM lines WHERE line_no % 3 > 0)"""


@query(
    f"""{_L}, {_TR}, t AS (SELECT track_id, (tr_ms + 50) // 100 AS k, arg_max(tr_text, tr_ms * 10000000 + tr_no) AS tr FROM tr GROUP BY 1, 2)
SELECT l.track_id, l.line_no, CASE WHEN t.tr <> l.text AND NOT starts_with(t.tr, '//') THEN t.tr END AS translation FROM lines l LEFT JOIN t ON t.track_id = l.track_id AND t.k = (l.start_ms + 50) // 100"""
)
def attach_translation(spark, sf):
    ln = b.lines(spark, sf)
    k = F.pmod("line_no", F.lit(4))
    tr = ln.where(F.pmod("line_no", F.lit(3)) > 0).select(
        "track_id", (F.col("start_ms") + F.pmod("line_no", F.lit(5)) * 20).alias("tr_ms"), F.col("line_no").alias("tr_no"),
        F.when(k == 0, F.col("text")).when(k == 1, "//skip").otherwise(F.concat(F.lit("tr "), F.col("line_no").cast("string"))).alias("tr_text"),
    )
    return cg.attach_translation(ln, tr).select("track_id", "line_no", "translation")


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS sha1 FROM documents GROUP BY text")
def dedupe_exact(spark, sf):
    docs = b.table(spark, sf, "documents", "doc_id", F.sha1("text").alias("sha1"))
    return cg.first_of(docs, ["sha1"], ["doc_id"])


@query(f"{_A} SELECT a.asset_id, u.asset_id IS NOT NULL AS used_elsewhere FROM assets a LEFT JOIN (SELECT DISTINCT asset_id FROM assets WHERE quality > 50000) u USING (asset_id)")
def avoid_used(spark, sf):
    a = b.assets(spark, sf)
    return cg.avoid_used(a.select("asset_id"), a.where(F.col("quality") > 50000))


@query(
    f"""{_L}, c AS (SELECT user_id % 97 AS query_id, event_id AS candidate_id, event_type <> 'error' AS timed, value AS duration_s, length(props) AS n, event_id % 5003 = 0 AS chosen FROM events),
t AS (SELECT query_id, avg_.v AS target_s FROM (SELECT user_id % 97 AS query_id, floor(min(value)) + 30 AS v FROM events GROUP BY 1) avg_)
SELECT query_id, arg_max(candidate_id, (CASE WHEN chosen THEN 1 ELSE 0 END) * 1000000000000 + n * 10000000000 - candidate_id) AS candidate_id FROM c JOIN t USING (query_id) WHERE timed AND (abs(duration_s - target_s) <= 20 OR chosen) GROUP BY 1"""
)
def pick_reference(spark, sf):
    ev = b.table(spark, sf, "events")
    c = ev.select(
        F.pmod("user_id", F.lit(97)).alias("query_id"), F.col("event_id").alias("candidate_id"), (F.col("event_type") != "error").alias("timed"),
        F.col("value").alias("duration_s"), F.length("props").alias("lines"), (F.pmod("event_id", F.lit(5003)) == 0).alias("chosen"),
    )
    t = c.groupBy("query_id").agg((F.floor(F.min("duration_s")) + 30).alias("target_s"))
    return cg.pick_reference(c, t)


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'a/' || p_partkey || '_vocals.wav' ELSE 'a/' || p_partkey || '_vocals.mp3' END AS sibling FROM part"""
)
def match_siblings(spark, sf):
    p = b.table(spark, sf, "part", "p_partkey")
    stem = F.concat(F.lit("a/"), F.col("p_partkey").cast("string"))
    audio = p.select("p_partkey", F.concat(stem, F.lit(".flac")).alias("path"))
    have = p.where(F.pmod("p_partkey", F.lit(3)) != 0)
    files = have.select(F.concat(stem, F.lit("_vocals.mp3")).alias("path")).union(
        have.where(F.pmod("p_partkey", F.lit(2)) == 0).select(F.concat(stem, F.lit("_vocals.wav")))
    )
    return cg.match_siblings(audio, files, suffix="_vocals").select("p_partkey", "sibling")


@query(
    f"""{_A} SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'new' ELSE origin_code END AS tag, CASE WHEN asset_id % 4 = 0 THEN least(t_in, 30) ELSE t_in END AS t_in, CASE WHEN asset_id % 4 = 0 THEN greatest(t_in + 5, 60) ELSE t_in + 5 END AS t_out FROM assets"""
)
def apply_tag_updates(spark, sf):
    a = b.assets(spark, sf).select("asset_id", F.array("origin_code").alias("tags"), "t_in", (F.col("t_in") + 5).alias("t_out"))
    u = a.where(F.pmod("asset_id", F.lit(4)) == 0).select("asset_id", F.array(F.lit("new")).alias("new_tags"), F.lit(30.0).alias("new_in"), F.lit(60.0).alias("new_out"))
    return cg.apply_tag_updates(a, u).select("asset_id", F.get("tags", F.lit(0)).alias("tag"), "t_in", "t_out")


@query(
    """WITH ax AS (SELECT conv_id, min(turn) AS axis_id, role FROM conversations GROUP BY 1, 3)
SELECT c.conv_id AS track_id, c.turn AS slot, ax.axis_id, CASE WHEN c.turn % 2 = 0 THEN 'name' ELSE 'singers' END AS matched_by FROM conversations c JOIN ax ON ax.conv_id = c.conv_id AND ax.role = c.role"""
)
def match_axis(spark, sf):
    conv = b.table(spark, sf, "conversations", F.col("conv_id").alias("track_id"), "turn", "role")
    axes = conv.groupBy("track_id", "role").agg(F.min("turn").alias("axis_id")).select("track_id", "axis_id", F.col("role").alias("name"), F.array(F.lit("x"), "role").alias("singer_ids"))
    slots = conv.select("track_id", F.col("turn").alias("slot"), F.when(F.pmod("turn", F.lit(2)) == 0, F.col("role")).otherwise("renamed").alias("name"), F.array("role", F.lit("x")).alias("singer_ids"))
    return cg.match_axis(slots, axes).select("track_id", "slot", "axis_id", "matched_by")


@query(
    """WITH e AS (SELECT p_name AS word, p_brand AS source, p_partkey AS rank, 'r' || p_partkey AS reading, p_size > 10 AS enabled FROM part), o AS (SELECT DISTINCT p_brand AS source, length(p_brand) * 100 + ascii(right(p_brand, 1)) AS position FROM part WHERE p_brand <> 'Brand#7')
SELECT word, reading, source FROM e JOIN o USING (source) WHERE enabled QUALIFY row_number() OVER (PARTITION BY word ORDER BY position, rank, reading, source) = 1"""
)
def effective_dictionary(spark, sf):
    p = b.table(spark, sf, "part")
    e = p.select(F.col("p_name").alias("word"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("rank"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("reading"), (F.col("p_size") > 10).alias("enabled"))
    o = p.where(F.col("p_brand") != "Brand#7").select(F.col("p_brand").alias("source"), (F.length("p_brand") * 100 + F.ascii(F.expr("right(p_brand, 1)"))).alias("position")).distinct()
    return cg.effective_dictionary(e, o)


_NEW = "nv AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN text || '!' ELSE text END AS text FROM doc_lines WHERE line_no % 7 <> 0)"


@query(
    f"""{_D}, {_NEW}, o AS (SELECT doc_id, text, line_no AS old_no, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS occ, count(*) OVER (PARTITION BY doc_id, text) AS n FROM doc_lines),
n AS (SELECT doc_id, text, line_no AS new_no, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS occ, count(*) OVER (PARTITION BY doc_id, text) AS m FROM nv)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, old_no, new_no, CASE WHEN new_no IS NULL THEN 'deleted' WHEN old_no IS NULL THEN 'added' WHEN n = m THEN 'equal' ELSE 'unsure' END AS kind FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.text = n.text AND o.occ = n.occ"""
)
def diff_versions(spark, sf):
    old = b.doc_lines(spark, sf)
    new = old.where(F.pmod("line_no", F.lit(7)) != 0).withColumn("text", F.when(F.pmod("line_no", F.lit(5)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return cg.diff_versions(old, new)


@query(
    f"""{_D} SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN 'c' WHEN line_no % 3 = 0 THEN 'n' ELSE lang END AS label, CASE WHEN line_no % 6 = 0 THEN 'conflict' WHEN line_no % 2 = 0 THEN 'current' WHEN line_no % 3 = 0 THEN 'new' ELSE 'same' END AS taken FROM doc_lines"""
)
def merge_three_way(spark, sf):
    base = b.doc_lines(spark, sf, "lang").select("doc_id", "line_no", F.col("lang").alias("label"))
    cur = base.withColumn("label", F.when(F.pmod("line_no", F.lit(2)) == 0, "c").otherwise(F.col("label")))
    new = base.withColumn("label", F.when(F.pmod("line_no", F.lit(3)) == 0, "n").otherwise(F.col("label")))
    return cg.merge_three_way(base, cur, new)


@query(
    """WITH k AS (SELECT doc_id AS track_id, line_no AS i, regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]', '', 'g') AS key FROM doc_lines), s AS (SELECT *, min(i) OVER (PARTITION BY track_id, key) AS src FROM k),
r AS (SELECT *, i - src AS d FROM s WHERE src < i), p AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(src) OVER w = src - 1 THEN 0 ELSE 1 END AS f FROM r WINDOW w AS (PARTITION BY track_id ORDER BY i)),
g AS (SELECT *, sum(f) OVER (PARTITION BY track_id ORDER BY i) AS run FROM p)
SELECT track_id, min(i) AS first_line, max(i) AS last_line, min(src) AS src_first, max(src) AS src_last FROM g GROUP BY track_id, run""".replace("WITH k", f"{_D}, k", 1)
)
def repeat_runs(spark, sf):
    """Consecutive lines that repeat consecutive earlier lines, with the span they repeat."""
    from verseline.operators.ordered import islands_after, multiplied

    k = b.doc_lines(spark, sf).select(F.col("doc_id").alias("track_id"), F.col("line_no").alias("i"), textnorm.line_key(F.col("text")).alias("key"))
    # nearly as many keys as lines: a copy for every salt would be many times the text
    src = k.groupBy("track_id", "key").agg(F.min("i").alias("src"), F.max("i").alias("last")).where("src < last").drop("last")
    r = k.join(multiplied(src), ["track_id", "key"]).where(F.col("src") < F.col("i"))
    runs = islands_after(
        r, by=["track_id"], order=["i"], block=F.floor(F.col("i") / 4096), cols=["i", "src"],
        starts=lambda p, c: (c["i"] - p["i"] != 1) | (c["src"] - p["src"] != 1), name="run",
    )
    return runs.groupBy("track_id", "run").agg(
        F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.min("src").alias("src_first"), F.max("src").alias("src_last")
    ).drop("run")


# ---------------------------------------------------------------- near duplicates
_HASH = """h0 AS (SELECT vec_id AS asset_id, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN CAST(embedding[i + 1] AS DOUBLE) >= m THEN (1::BIGINT << i)::HUGEINT ELSE 0::HUGEINT END)) + CASE WHEN CAST(embedding[64] AS DOUBLE) >= m THEN (-9223372036854775808)::HUGEINT ELSE 0::HUGEINT END AS BIGINT) AS h FROM (SELECT vec_id, embedding, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings)),
hs AS (SELECT asset_id * 2 AS asset_id, h AS ahash FROM h0 UNION ALL SELECT asset_id * 2 + 1, CASE WHEN asset_id % 3 = 0 THEN h ELSE xor(xor(h, 1::BIGINT << (asset_id % 60)), CASE WHEN asset_id % 2 = 0 THEN 1::BIGINT << ((asset_id * 7 + 1) % 60) ELSE 0 END) END FROM h0)"""


def hashed(spark, sf):
    """Picture hashes of the embeddings, each with a twin that is equal or differs in one or two bits."""
    from verseline.functions.bits import hash_bits

    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), hash_bits(F.col("embedding")).alias("ahash"))
    flip = lambda c, p: c.bitwiseXOR(F.expr(f"shiftleft(1L, cast({p} as int))"))
    one = flip(F.col("ahash"), "pmod(asset_id, 60)")
    two = flip(one, "pmod(asset_id * 7 + 1, 60)")
    twin = F.when(F.pmod("asset_id", F.lit(3)) == 0, F.col("ahash")).when(F.pmod("asset_id", F.lit(2)) == 0, two).otherwise(one)
    return e.select((F.col("asset_id") * 2).alias("asset_id"), "ahash").unionByName(e.select((F.col("asset_id") * 2 + 1).alias("asset_id"), twin.alias("ahash")))


@query(f"WITH {_HASH} SELECT a.asset_id FROM hs a WHERE NOT EXISTS (SELECT 1 FROM hs b WHERE b.asset_id < a.asset_id AND bit_count(xor(a.ahash, b.ahash)) <= 6)")
def dedupe_near(spark, sf):
    a = hashed(spark, sf)
    return a.join(mt.near_duplicates(a), "asset_id", "left_anti").select("asset_id")


@query(f"WITH {_HASH} SELECT a.asset_id FROM hs a WHERE EXISTS (SELECT 1 FROM hs b WHERE b.asset_id < a.asset_id AND bit_count(xor(a.ahash, b.ahash)) <= 3)")
def near_duplicate_clips(spark, sf):
    return mt.near_duplicates(hashed(spark, sf), max_bits=3, bands=5)


# ---------------------------------------------------------------- n-gram matching
_GR = "list_distinct(list_transform(range(1, greatest(length({t}) - 2, 1) + 1), lambda p: substr({t}, p, 3)))"
_SENT = "sent AS (SELECT item_id, k AS line_no, t AS text FROM (SELECT item_id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS t FROM (SELECT item_id, string_split(text, '. ') AS s FROM benchmark)) WHERE t <> '')"


def _sentences(spark, sf):
    return b.table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("p", "text")).where("text <> ''").select(
        "item_id", (F.col("p") + 1).cast("long").alias("line_no"), "text"
    )


@query(
    f"""WITH {_SENT}, lg AS (SELECT item_id, line_no, len(g) AS n, unnest(g) AS gram FROM (SELECT item_id, line_no, {_GR.format(t='text')} AS g FROM sent)),
cs AS (SELECT doc_id, text, string_split(text, '') AS c FROM documents WHERE text <> ''), dg AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(c) < 3 THEN [text] ELSE list_transform(range(1, len(c) - 1), lambda p: c[p] || c[p + 1] || c[p + 2]) END) AS gram FROM cs)),
o AS (SELECT item_id, line_no, doc_id, n, count(*) AS shared FROM lg JOIN dg USING (gram) GROUP BY ALL), p AS (SELECT *, shared / CAST(n AS DOUBLE) AS score FROM o WHERE round(shared / CAST(n AS DOUBLE), 9) >= 0.35)
SELECT item_id, line_no, doc_id, CAST(shared AS INTEGER) AS shared, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id, line_no ORDER BY score DESC, doc_id) AS INTEGER) AS hit FROM p QUALIFY hit <= 4"""
)
def match_lines_fuzzy(spark, sf):
    """Where do the sentences of the benchmark passages stand in the documents? Best four documents of each."""
    docs = b.table(spark, sf, "documents", "doc_id", "text")
    hits = mt.gram_search(_sentences(spark, sf), docs, left_id=["item_id", "line_no"], right_id="doc_id", min_score=0.35, top=4)
    return hits.withColumn("score", F.round("score", 6))


@query(
    f"""WITH RECURSIVE {b.DOC_LINES_SQL}, o AS (SELECT doc_id, line_no, {_GR.format(t='text')} AS g FROM doc_lines WHERE text <> ''),
nt AS (SELECT doc_id, line_no, array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 6 <> 5), ' ') AS text FROM doc_lines), n AS (SELECT doc_id, line_no, {_GR.format(t='text')} AS g FROM nt WHERE text <> ''),
og AS (SELECT doc_id, line_no, len(g) AS n, unnest(g) AS gram FROM o), ng AS (SELECT doc_id, line_no, len(g) AS n, unnest(g) AS gram FROM n),
p AS MATERIALIZED (SELECT * FROM (SELECT ng.doc_id, ng.line_no, og.line_no AS ref_no, 2 * count(*) / CAST(ng.n + og.n AS DOUBLE) AS score FROM ng JOIN og ON ng.doc_id = og.doc_id AND ng.gram = og.gram GROUP BY ng.doc_id, ng.line_no, og.line_no, ng.n, og.n) WHERE round(score, 9) >= 0.55),
h AS (SELECT doc_id, list([{{'l': line_no, 'e': ref_no, 'f': w, 'pl': CAST(NULL AS BIGINT), 'pe': CAST(NULL AS BIGINT)}}] ORDER BY line_no, ref_no) AS hs FROM (SELECT *, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS w FROM p) GROUP BY 1),
d AS MATERIALIZED (SELECT doc_id, unnest(list_reduce(hs, lambda acc, x: list_append(acc, list_transform([list_max(list_transform(list_filter(acc, lambda y: y.l < x[1].l AND y.e < x[1].e), lambda y: {{'f': y.f, 'ne': -y.e, 'nl': -y.l}}))],
    lambda m: {{'l': x[1].l, 'e': x[1].e, 'f': x[1].f + coalesce(m.f, 0), 'pl': -m.nl, 'pe': -m.ne}})[1]))) AS x FROM h),
c AS (SELECT doc_id, x.l AS l, x.e AS e, x.pl AS pl, x.pe AS pe FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x.f DESC, x.e, x.l) = 1
  UNION ALL SELECT c.doc_id, d.x.l, d.x.e, d.x.pl, d.x.pe FROM c JOIN d ON d.doc_id = c.doc_id AND d.x.l = c.pl AND d.x.e = c.pe)
SELECT c.doc_id, c.l AS line_no, c.e AS ref_no, round(p.score, 6) AS score FROM c JOIN p ON p.doc_id = c.doc_id AND p.line_no = c.l AND p.ref_no = c.e"""
)
def map_to_reference(spark, sf):
    """Lines of a shortened version of each document mapped to the lines of the full one, never backwards."""
    full = b.doc_lines(spark, sf)
    short = full.withColumn("text", F.array_join(F.filter(F.split("text", " "), lambda w, i: F.pmod(i + 1, F.lit(6)) != 5), " "))
    return mt.map_lines(short, full, by=["doc_id"], min_score=0.55).withColumn("score", F.round("score", 6))


_WORDS = "dict AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+', 0)) AS w FROM benchmark) WHERE length(w) BETWEEN 3 AND 6)"


def _dictionary(spark, sf):
    w = b.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("w")).where(F.length("w").between(3, 6))
    return w.select(F.lower("w").alias("word")).distinct().select("word", F.upper("word").alias("reading"), F.ascii(F.substring("word", 1, 1)).cast("long").alias("rank"))


def _hits(spark, sf):
    conv = b.spread(b.table(spark, sf, "conversations", "conv_id", "turn", "text"))
    return mt.dictionary_hits(conv, _dictionary(spark, sf), lengths=(3, 4, 5, 6))


@query(
    f"""WITH {_WORDS}, c AS (SELECT conv_id, turn, string_split(text, '') AS c FROM conversations), s AS (SELECT conv_id, turn, n, unnest(range(1, len(c) - n + 2)) AS p, unnest(list_transform(range(1, len(c) - n + 2), lambda p: array_to_string(c[p:p + n - 1], ''))) AS word FROM c, (SELECT unnest([3, 4, 5, 6]) AS n))
SELECT conv_id, turn, p - 1 AS first, p + n - 2 AS last, word, upper(word) AS reading, CAST(ascii(word) AS BIGINT) AS rank FROM s JOIN dict USING (word)"""
)
def dictionary_cover(spark, sf):
    """Every dictionary word at every place of the conversation texts."""
    return _hits(spark, sf)


@query(
    f"""WITH {_WORDS}, c AS (SELECT conv_id, turn, string_split(text, '') AS c FROM conversations), s AS (SELECT conv_id, turn, n, unnest(range(1, len(c) - n + 2)) AS p, unnest(list_transform(range(1, len(c) - n + 2), lambda p: array_to_string(c[p:p + n - 1], ''))) AS word FROM c, (SELECT unnest([3, 4, 5, 6]) AS n)),
h AS (SELECT conv_id, turn, list([{{'a': p - 1, 'z': p + n - 2, 'w': word}}] ORDER BY n DESC, ascii(word), p) AS hs FROM s JOIN dict USING (word) GROUP BY 1, 2),
t AS (SELECT conv_id, turn, unnest(list_reduce(hs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a <= x[1].z AND y.z >= x[1].a)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM h)
SELECT conv_id, turn, x.a AS first, x.z AS last, x.w AS word, upper(x.w) AS reading, CAST(ascii(x.w) AS BIGINT) AS rank FROM t"""
)
def greedy_cover(spark, sf):
    """The accepted, non-overlapping words."""
    return mt.greedy_cover(_hits(spark, sf), line=["conv_id", "turn"])


# ---------------------------------------------------------------- offsets
def _lyric_words(spark, sf):
    return b.asr_words(spark, sf).select("track_id", "seg_no", "word_no", "start_ms", F.lower("word").alias("word"))


_LW = "lw AS (SELECT track_id, seg_no, word_no, start_ms, lower(word) AS word FROM asr_words), hw AS (SELECT track_id, seg_no, word_no, word, start_ms + 3700 + (seg_no + word_no) % 3 * 100 AS start_ms FROM lw WHERE word_no % 5 <> 4)"


def _heard_words(spark, sf):
    w = _lyric_words(spark, sf).where(F.pmod("word_no", F.lit(5)) != 4)
    return w.withColumn("start_ms", F.col("start_ms") + 3700 + F.pmod(F.col("seg_no") + F.col("word_no"), F.lit(3)) * 100)


@query(
    f"""WITH {b.ASR_SQL}, {_LW}, d AS (SELECT a.track_id, a.seg_no, a.word_no, h.start_ms - a.start_ms AS d FROM lw a JOIN hw h ON h.track_id = a.track_id AND h.word = a.word AND abs(h.start_ms - a.start_ms) < 60000),
bn AS (SELECT track_id, CAST(floor(d / 100.0 + 0.5) AS BIGINT) AS b, count(*) AS n FROM d GROUP BY 1, 2), sp AS (SELECT track_id, b + k AS b, n * CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS s FROM bn, (SELECT unnest([-1, 0, 1]) AS k)),
sc AS (SELECT track_id, b, sum(s) AS s FROM sp GROUP BY 1, 2), md AS (SELECT track_id, b * 100 AS mode FROM sc QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, abs(b), b DESC) = 1),
cl AS (SELECT d.* FROM d JOIN md USING (track_id) WHERE abs(d - mode) <= 300), me AS (SELECT track_id, quantile_cont(CAST(d AS DOUBLE), 0.5) AS offset_ms, count(DISTINCT seg_no * 100000 + word_no) AS hits FROM cl GROUP BY 1)
SELECT me.track_id, offset_ms, round(hits / CAST(n AS DOUBLE), 4) AS agree FROM me JOIN (SELECT track_id, count(*) AS n FROM lw GROUP BY 1) USING (track_id)"""
)
def word_offset(spark, sf):
    return mt.word_offset(_lyric_words(spark, sf), _heard_words(spark, sf))


@query(
    f"""WITH {b.ASR_SQL}, {_LW}, a AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg_no, word ORDER BY word_no) AS k FROM lw), h AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg_no, word ORDER BY word_no) AS k FROM hw),
j AS (SELECT a.track_id, a.seg_no, a.word_no, a.word, a.start_ms, h.start_ms AS t FROM a LEFT JOIN h ON h.track_id = a.track_id AND h.seg_no = a.seg_no AND h.word = a.word AND h.k = a.k),
n AS (SELECT *, last_value(t IGNORE NULLS) OVER f AS pt, last_value(CASE WHEN t IS NOT NULL THEN word_no END IGNORE NULLS) OVER f AS pi, first_value(t IGNORE NULLS) OVER g AS nt, first_value(CASE WHEN t IS NOT NULL THEN word_no END IGNORE NULLS) OVER g AS ni FROM j
 WINDOW f AS (PARTITION BY track_id, seg_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY track_id, seg_no ORDER BY word_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, coalesce(t, CASE WHEN pt IS NULL THEN nt - (ni - word_no) * 50 WHEN nt IS NULL THEN pt + (word_no - pi) * 50 ELSE pt + CAST(floor((nt - pt) * (word_no - pi) / CAST(ni - pi AS DOUBLE)) AS BIGINT) END) AS s FROM n)
SELECT track_id, seg_no, word_no, word, start_ms, t IS NOT NULL AS matched, max(s - word_no * 50) OVER (PARTITION BY track_id, seg_no ORDER BY word_no) + word_no * 50 AS placed_ms FROM s"""
)
def place_words(spark, sf):
    return mt.place_words(_lyric_words(spark, sf), _heard_words(spark, sf))


_KN = "kn AS (SELECT track_id, start_ms AS src, start_ms + 250 + CASE WHEN (seg_no + word_no) % 12 = 0 THEN 390 ELSE word_no % 3 * 10 END AS dst FROM asr_words WHERE word_no % 3 = 0)"


@query(
    f"""WITH {b.ASR_SQL}, {_KN}, o AS (SELECT track_id, quantile_cont(CAST(dst - src AS DOUBLE), 0.5) AS off, count(*) AS n FROM kn GROUP BY 1), u AS (SELECT kn.track_id, off FROM kn JOIN o USING (track_id) GROUP BY kn.track_id, off, n HAVING n >= 8 AND avg(CASE WHEN abs(dst - src - off) <= 200 THEN 1.0 ELSE 0.0 END) >= 0.4),
t AS (SELECT kn.track_id, src, CASE WHEN abs(dst - src - off) > 200 THEN CAST(floor(dst - off) AS BIGINT) ELSE src END AS v FROM kn JOIN u USING (track_id)),
h AS (SELECT *, max(v) OVER (PARTITION BY track_id ORDER BY src, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM t), k AS (SELECT track_id, src AS k0, v AS v0, lead(src) OVER w AS k1, lead(v) OVER w AS v1, row_number() OVER w AS i FROM h WHERE hi IS NULL OR v > hi + 30 WINDOW w AS (PARTITION BY track_id ORDER BY src))
SELECT a.track_id, a.seg_no, a.word_no, a.start_ms + 100 AS t_ms, greatest(0, CASE WHEN k.k0 IS NULL THEN a.start_ms + 100 + coalesce(f.v0 - f.k0, 0) WHEN k.k1 IS NULL THEN a.start_ms + 100 + k.v0 - k.k0 ELSE k.v0 + CAST(floor((a.start_ms + 100 - k.k0) * (k.v1 - k.v0) / CAST(k.k1 - k.k0 AS DOUBLE)) AS BIGINT) END) AS warped_ms
FROM asr_words a LEFT JOIN k ON k.track_id = a.track_id AND k.k0 <= a.start_ms + 100 AND (k.k1 IS NULL OR k.k1 > a.start_ms + 100) LEFT JOIN k f ON f.track_id = a.track_id AND f.i = 1"""
)
def warp_times(spark, sf):
    w = b.asr_words(spark, sf)
    jump = F.when(F.pmod(F.col("seg_no") + F.col("word_no"), F.lit(12)) == 0, 390).otherwise(F.pmod("word_no", F.lit(3)) * 10)
    knots = w.where(F.pmod("word_no", F.lit(3)) == 0).select("track_id", F.col("start_ms").alias("src_ms"), (F.col("start_ms") + 250 + jump).alias("dst_ms"))
    return mt.warp_times(w.select("track_id", "seg_no", "word_no", (F.col("start_ms") + 100).alias("t_ms")), knots)


_FM = """fm AS (SELECT track_id, line_no, CASE WHEN line_no % 5 > 0 THEN start_ms END AS s, CASE WHEN line_no % 7 = 0 THEN 0.3 ELSE 0.9 END AS score, CASE WHEN line_no % 4 > 0 THEN start_ms - 2000 - start_ms // 150000 * 4000 + CASE WHEN line_no % 23 = 0 THEN 9000 ELSE 0 END END AS r, CASE WHEN line_no % 6 = 0 THEN 0.6 ELSE 0.95 END AS sim FROM lines)"""


@query(
    f"""{_L}, {_FM}, du AS (SELECT track_id, max(end_ms) AS d FROM lines GROUP BY 1), a AS (SELECT track_id, line_no, r, CAST(s - r AS DOUBLE) AS off FROM fm WHERE s IS NOT NULL AND score >= 0.5 AND r IS NOT NULL AND sim >= 0.8),
p AS (SELECT *, sum(f) OVER (PARTITION BY track_id ORDER BY line_no) AS piece FROM (SELECT *, CASE WHEN lag(off) OVER w IS NULL OR abs(off - lag(off) OVER w) > 3000 THEN 1 ELSE 0 END AS f FROM a WINDOW w AS (PARTITION BY track_id ORDER BY line_no))),
i0 AS (SELECT track_id, piece, min(r) AS lo, max(r) AS hi, count(*) AS n, quantile_cont(off, 0.5) AS med FROM p GROUP BY 1, 2), i1 AS (SELECT *, lag(med) OVER w AS pm, lead(med) OVER w AS nm FROM i0 WINDOW w AS (PARTITION BY track_id ORDER BY piece)),
i AS (SELECT * FROM i1 WHERE NOT (n = 1 AND pm IS NOT NULL AND nm IS NOT NULL AND abs(pm - nm) <= 3000)),
ins AS (SELECT f.track_id, f.line_no, arg_min(i.med, i.piece) AS m FROM fm f JOIN i ON i.track_id = f.track_id AND f.r BETWEEN i.lo - 500 AND i.hi + 500 GROUP BY 1, 2),
ed AS (SELECT track_id, piece, med, lo AS e FROM i UNION SELECT track_id, piece, med, hi FROM i),
ne AS (SELECT f.track_id, f.line_no, arg_min(ed.med, {{'d': abs(ed.e - f.r), 'late': ed.e > f.r, 'k': CASE WHEN ed.e > f.r THEN ed.piece ELSE -ed.piece END}}) AS m FROM fm f JOIN ed ON ed.track_id = f.track_id WHERE f.r IS NOT NULL GROUP BY 1, 2),
q AS (SELECT f.*, d, CAST(floor(f.r + coalesce(ins.m, ne.m) + 0.5) AS BIGINT) AS pred, CASE WHEN f.s IS NOT NULL AND f.score >= 0.5 THEN f.s END AS asr FROM fm f JOIN du USING (track_id) LEFT JOIN ins USING (track_id, line_no) LEFT JOIN ne USING (track_id, line_no)),
w AS (SELECT *, pred IS NOT NULL AND (asr IS NULL OR abs(asr - pred) > 4000) AND pred BETWEEN 0 AND d AS u FROM q)
SELECT track_id, line_no, CASE WHEN u THEN pred ELSE asr END AS est_ms, CASE WHEN u THEN 'lrc' WHEN asr IS NOT NULL THEN 'asr' END AS source FROM w"""
)
def fuse_estimates(spark, sf):
    ln = b.lines(spark, sf)
    mod = lambda n: F.pmod("line_no", F.lit(n))
    m = ln.select(
        "track_id", "line_no", F.when(mod(5) > 0, F.col("start_ms")).alias("start_ms"), F.when(mod(7) == 0, 0.3).otherwise(0.9).alias("score"),
        F.when(mod(4) > 0, F.col("start_ms") - 2000 - F.floor(F.col("start_ms") / 150000) * 4000 + F.when(mod(23) == 0, 9000).otherwise(0)).alias("ref_ms"),
        F.when(mod(6) == 0, 0.6).otherwise(0.95).alias("sim"),
    )
    return mt.fuse_estimates(m, ln.groupBy("track_id").agg(F.max("end_ms").alias("duration_ms")))


# ---------------------------------------------------------------- ranking
_NORM = "lower(trim({0}))"
_LEV = "CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


def _score(k, t):
    toks = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\s\\-_/\\\\|,.;:!?()\\[\\]{{}}''\"`~]+'), lambda w: w <> '')"
    kt, tt = toks(k), toks(t)
    sh = f"len(list_filter({kt}, lambda w: list_contains({tt}, w)))"
    pf = f"len(list_filter({kt}, lambda w: len(list_filter({tt}, lambda x: starts_with(x, w))) > 0))"
    raw = f"greatest({_LEV.format(a=k, b=t)} * 100, CASE WHEN contains({t}, {k}) THEN 92.0::DOUBLE END, CASE WHEN {sh} > 0 THEN {sh} / CAST(len({kt}) AS DOUBLE) * 95.0::DOUBLE END, CASE WHEN {pf} > 0 THEN {pf} / CAST(len({kt}) AS DOUBLE) * 90.0::DOUBLE END)"
    return f"CASE WHEN {k} = '' OR {t} = '' THEN 0.0::DOUBLE WHEN {k} = {t} THEN 100.0::DOUBLE ELSE {RND2.format(f'least({raw}, 100.0::DOUBLE)')} END"


_COMP = "regexp_replace({0}, '[^0-9a-z]+', '', 'g')"
_CAND = f"""kw AS (SELECT p_size AS query_id, min(p_name) AS keyword FROM part GROUP BY 1),
cand AS (SELECT p_size AS query_id, keyword, p_partkey AS candidate_id, p_partkey % 3 AS variant, p_partkey % 11 AS position, length(p_brand) * 10 AS priority, p_name AS title, p_type AS artist, p_brand AS album, p_name || ' ' || p_type AS body FROM part JOIN kw ON kw.query_id = p_size),
lo AS (SELECT *, lower(keyword) AS k, lower(title) AS t, lower(artist) AS a, lower(album) AS al, lower(body) AS bo FROM cand),
sc AS (SELECT *, {_score('k', 't')} AS title_score, {_score('k', 'a')} AS artist_score, {_score('k', 'al')} AS album_score, {_score('k', 'bo')} AS body_score FROM lo),
ti AS (SELECT *, CASE WHEN k = t OR {_COMP.format('k')} = {_COMP.format('t')} THEN 4 WHEN starts_with(t, k) OR starts_with({_COMP.format('t')}, {_COMP.format('k')}) THEN 3 WHEN contains(t, k) OR contains({_COMP.format('t')}, {_COMP.format('k')}) THEN 2 WHEN title_score >= 80 THEN 1 ELSE 0 END AS tier FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, variant, position, priority DESC, title_score DESC, artist_score DESC, album_score DESC, body_score DESC, candidate_id) AS rank FROM ti)"""


def _candidates(spark, sf):
    p = b.spread(b.table(spark, sf, "part"))  # scoring costs far more than reading, and a file of few splits would be scored in as few tasks
    kw = p.groupBy(F.col("p_size").alias("query_id")).agg(F.min("p_name").alias("keyword"))
    # the parts stay where the rows are: as the smaller file they could be broadcast to their own keywords
    return salted_lookup(p.withColumn("query_id", F.col("p_size")), kw, ["query_id"]).select(
        "query_id", "keyword", F.col("p_partkey").alias("candidate_id"), F.pmod("p_partkey", F.lit(3)).alias("variant"), F.pmod("p_partkey", F.lit(11)).alias("position"),
        (F.length("p_brand") * 10).alias("priority"), F.col("p_name").alias("title"), F.col("p_type").alias("artist"), F.col("p_brand").alias("album"), F.concat_ws(" ", "p_name", "p_type").alias("body"),
    )


def _ranked(spark, sf):
    return rk.rank_candidates(_candidates(spark, sf))


@query(f"WITH {_CAND} SELECT query_id, candidate_id, tier, title_score, artist_score, album_score, body_score, rank FROM rk")
def rank_candidates(spark, sf):
    return _ranked(spark, sf).select("query_id", "candidate_id", "tier", "title_score", "artist_score", "album_score", "body_score", "rank")


@query(f"WITH {_CAND} SELECT query_id, candidate_id, rank, (SELECT count(*) FROM rk r WHERE r.query_id = rk.query_id) > 20 AS has_more FROM rk WHERE rank > 10 AND rank <= 20")
def page_results(spark, sf):
    return rk.page_results(_ranked(spark, sf).select("query_id", "candidate_id", "rank"), limit=10, page=1)


@query(
    f"""WITH {_CAND} SELECT candidate_id, CASE greatest(title_score, artist_score, album_score, body_score) WHEN title_score THEN 'title' WHEN artist_score THEN 'artist' WHEN album_score THEN 'album' ELSE 'body' END AS best_field FROM rk"""
)
def best_match_field(spark, sf):
    return rk.score_candidates(_candidates(spark, sf)).select("candidate_id", "best_field")


@query(f"{_A}, f AS (SELECT *, asset_id % 7 AS res FROM assets) SELECT library_id, res, quality AS size, asset_id AS seq FROM f QUALIFY row_number() OVER (PARTITION BY library_id, res ORDER BY quality DESC, asset_id DESC) = 1")
def best_variant(spark, sf):
    f = b.assets(spark, sf).select("library_id", F.pmod("asset_id", F.lit(7)).alias("res"), F.col("quality").alias("size"), F.col("asset_id").alias("seq"))
    return rk.best_variant(f, key=["library_id", "res"])


@query(f"{_A} SELECT library_id, asset_id AS seq, motion AS abr FROM assets WHERE fade QUALIFY row_number() OVER (PARTITION BY library_id ORDER BY CASE WHEN origin_code = 'a' THEN 1 ELSE 0 END DESC, motion DESC, luma DESC, quality DESC, asset_id DESC) = 1")
def best_audio(spark, sf):
    f = b.assets(spark, sf).select("library_id", F.col("fade").alias("audio_only"), F.col("origin_code").alias("ext"), F.col("motion").alias("abr"), F.col("luma").alias("tbr"), F.col("quality").alias("size"), F.col("asset_id").alias("seq"))
    return rk.best_audio(f, by=["library_id"], prefer="a")


@query(f"{_L}, g AS (SELECT track_id, count(*) AS lines, max(start_ms) AS t FROM lines GROUP BY 1) SELECT track_id, lines FROM g WHERE lines >= 4 ORDER BY lines DESC")
def sort_loaded(spark, sf):
    g = b.lines(spark, sf).groupBy("track_id").agg(F.count("*").alias("lines"))
    return g.where(F.col("lines") >= 4).orderBy(F.col("lines").desc(), "track_id")


@query(f"WITH {SCORED_SQL} SELECT library_id, asset_id, CAST(row_number() OVER (PARTITION BY library_id ORDER BY score DESC, asset_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 80")
def top_clips_spread(spark, sf):
    a = scored(spark, sf).select("library_id", "asset_id", "score")
    return rk.top_per_key(a, by=["library_id"], order=[F.col("score").desc(), F.col("asset_id")], n=80).drop("score")


@query(
    f"""WITH {SCORED_SQL}, l AS (SELECT *, asset_id % 9 = 0 AS late FROM scored) SELECT asset_id, late, row_number() OVER (PARTITION BY late, library_id ORDER BY score DESC, asset_id) AS turn, count(*) OVER (PARTITION BY late, library_id) AS source_size FROM l"""
)
def round_robin(spark, sf):
    a = scored(spark, sf).select("asset_id", "library_id", "score", (F.pmod("asset_id", F.lit(9)) == 0).alias("used"))
    return rk.round_robin(a, source="library_id", score="score", avoid="used").select("asset_id", "late", "turn", "source_size")


_POOL = "pool AS (SELECT library_id AS track_id, asset_id AS pool_no, CASE origin_code WHEN 'r' THEN 'user' WHEN 'a' THEN 'web' ELSE 'video' END AS origin FROM assets)"


def _pool(spark, sf):
    o = F.when(F.col("origin_code") == "r", "user").when(F.col("origin_code") == "a", "web").otherwise("video")
    return b.assets(spark, sf).select(F.col("library_id").alias("track_id"), F.col("asset_id").alias("pool_no"), o.alias("origin"))


@query(
    f"""{_A}, {_POOL}, c AS (SELECT track_id, origin, count(*) AS m, CASE origin WHEN 'user' THEN 1 WHEN 'web' THEN 2 ELSE 3 END AS r FROM pool GROUP BY 1, 2), q AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS kinds, greatest(least(m, least(100, sum(m) OVER (PARTITION BY track_id)) - coalesce(sum(m) OVER (PARTITION BY track_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS quota FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, origin ORDER BY pool_no) AS j FROM pool) SELECT n.track_id, n.pool_no, n.origin, CASE WHEN kinds = 1 THEN round((j - 0.5::DOUBLE) / m, 6) WHEN j <= quota THEN round((j - 0.5::DOUBLE) / quota, 6) ELSE 2.0::DOUBLE END AS place FROM n JOIN q USING (track_id, origin)"""
)
def quota_interleave(spark, sf):
    return rk.quota_interleave(_pool(spark, sf), n=100).select("track_id", "pool_no", "origin", "place")


@query(
    f"""{_A}, {_POOL}, c AS (SELECT track_id, origin, count(*) AS m, min(pool_no) AS head FROM pool GROUP BY 1, 2), t AS (SELECT *, count(*) OVER p AS kinds, least(100, sum(m) OVER p) AS n, sum(m) OVER p AS s FROM c WINDOW p AS (PARTITION BY track_id)),
e AS (SELECT *, least(CAST(round_even(CAST(n AS DOUBLE) * m / s, 0) AS BIGINT), m) AS base FROM t), f AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY m - base DESC, head) AS gap, n - sum(base) OVER (PARTITION BY track_id) AS rest FROM e), q AS (SELECT *, base + CASE WHEN gap <= rest THEN 1 ELSE 0 END AS quota FROM f),
n AS (SELECT track_id, origin, pool_no, row_number() OVER (PARTITION BY track_id, origin ORDER BY pool_no) AS j FROM pool) SELECT track_id, pool_no, origin, CASE WHEN kinds = 1 THEN round((j - 0.5::DOUBLE) / m, 6) WHEN j <= quota THEN round((j - 0.5::DOUBLE) / quota, 6) ELSE 2.0::DOUBLE END AS place FROM n JOIN q USING (track_id, origin)"""
)
def quota_interleave_even(spark, sf):
    return rk.quota_interleave(_pool(spark, sf), n=100, prefer="even").select("track_id", "pool_no", "origin", "place")


@query(
    f"""{_A}, {_POOL}, n AS (SELECT track_id, pool_no, row_number() OVER (PARTITION BY track_id ORDER BY pool_no) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS m FROM pool)
SELECT DISTINCT track_id, pool_no FROM n, (SELECT unnest(range(0, 50)) AS k) WHERE m <= 50 OR k * m // 50 = i"""
)
def even_sample(spark, sf):
    return rk.even_sample(_pool(spark, sf), n=50, by=["track_id"], order="pool_no", block=F.floor(F.col("pool_no") / 65536)).select("track_id", "pool_no")


@query("WITH r AS (SELECT event_id, user_id, event_type, event_id % 50 = 0 AS locked FROM events), f AS (SELECT event_id FROM r WHERE NOT locked QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 3) SELECT event_id FROM f UNION ALL SELECT event_id FROM r WHERE locked")
def keep_recent(spark, sf):
    ev = b.table(spark, sf, "events", "event_id", "user_id", "event_type").withColumn("locked", F.pmod("event_id", F.lit(50)) == 0)
    return rk.keep_recent(ev, by=["user_id", "event_type"], order=[F.col("event_id").desc()], n=3, locked=F.col("locked")).select("event_id")


@query("SELECT p_partkey, p_brand, CAST(regexp_extract(p_brand, '[0-9]+', 0) AS BIGINT) AS number, lower(regexp_replace(p_brand, '[0-9]+', '')) || lpad(CAST(length(regexp_extract(p_brand, '[0-9]+', 0)) AS VARCHAR), 10, '0') || regexp_extract(p_brand, '[0-9]+', 0) AS sort_key FROM part")
def natural_sort(spark, sf):
    p = b.table(spark, sf, "part", "p_partkey", "p_brand")
    return p.select("p_partkey", "p_brand", F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("number"), textnorm.natural_key(F.col("p_brand")).alias("sort_key"))


@query(
    f"""{_A} SELECT origin_code AS origin, count(*) FILTER (k IN (0, 1)) AS used, count(*) FILTER (k = 2) AS missing, count(*) FILTER (k = 3) AS fallback, count(*) FILTER (k = 4) AS repeats FROM (SELECT *, asset_id % 5 AS k FROM assets) GROUP BY 1"""
)
def pool_by_origin(spark, sf):
    k = F.pmod("asset_id", F.lit(5)).cast("int")
    why = F.element_at(F.array(*[F.lit(x) for x in ("new", "pin", "missing", "fallback", "repeat")]), k + 1)
    return rk.pool_by_origin(b.assets(spark, sf).select(F.col("origin_code").alias("origin"), why.alias("why")))


@query(f"{_A} SELECT 'https://v/' || library_id || '?id=' || (library_id % 7) AS link, min(asset_id) AS first_asset, count(*) AS uses FROM assets GROUP BY library_id")
def credits(spark, sf):
    a = b.assets(spark, sf)
    s = F.col("library_id")
    t = F.concat(F.lit("t="), F.floor("t_in").cast("string"), F.lit("s"))
    url = F.concat(
        F.lit("https://v/"), s.cast("string"), F.lit("?"), F.when(F.pmod("asset_id", F.lit(2)) == 0, F.concat(t, F.lit("&"))).otherwise(""), F.lit("id="),
        F.pmod(s, F.lit(7)).cast("string"), F.when(F.pmod("asset_id", F.lit(2)) == 1, F.concat(F.lit("&"), t)).otherwise(""),
    )
    return rk.credits(a.select("asset_id", url.alias("url")))


@query(f"{_L}, a AS (SELECT track_id, max(end_ms) AS d FROM lines GROUP BY 1), z AS (SELECT track_id, max(start_ms) AS d FROM lines WHERE line_no % 2 = 0 GROUP BY 1) SELECT a.track_id, a.d - z.d AS difference_ms FROM a JOIN z USING (track_id) WHERE a.d - z.d > 5000")
def duration_mismatch(spark, sf):
    ln = b.lines(spark, sf)
    a = ln.groupBy("track_id").agg(F.max("end_ms").alias("duration_a"))
    z = ln.where(F.pmod("line_no", F.lit(2)) == 0).groupBy("track_id").agg(F.max("start_ms").alias("duration_b"))
    return rk.duration_mismatch(a, z, limit_ms=5000)


@query(f"{_L} SELECT track_id, max(coalesce(CASE WHEN line_no % 3 > 0 THEN end_ms END, start_ms + 1000)) AS duration_ms FROM lines GROUP BY 1")
def track_duration(spark, sf):
    end = F.when(F.pmod("line_no", F.lit(3)) > 0, F.col("end_ms"))
    return b.lines(spark, sf).groupBy("track_id").agg(F.max(F.coalesce(end, F.col("start_ms") + 1000)).alias("duration_ms"))


@query("SELECT conv_id, role, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2")
def singer_coverage(spark, sf):
    conv = b.table(spark, sf, "conversations")
    return conv.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("decimal(38,0)").cast("long").alias("chars"))


# ---------------------------------------------------------------- sets
@query("WITH u AS (SELECT text, doc_id AS id, 1 AS rank FROM documents UNION ALL SELECT text, item_id, 2 FROM benchmark UNION ALL SELECT text, conv_id * 1000 + turn, 3 FROM conversations) SELECT sha1(text) AS sha1, id, CAST(rank AS INTEGER) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank, id) = 1")
def union_sources(spark, sf):
    d = b.table(spark, sf, "documents", F.sha1("text").alias("sha1"), F.col("doc_id").alias("id"), F.lit(1).alias("rank"))
    m = b.table(spark, sf, "benchmark", F.sha1("text").alias("sha1"), F.col("item_id").alias("id"), F.lit(2).alias("rank"))
    c = b.table(spark, sf, "conversations", F.sha1("text").alias("sha1"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(3).alias("rank"))
    return rk.union_sources(d, m, c, key=["sha1"], order=["rank", "id"])


@query(f"{_A} SELECT asset_id FROM assets WHERE quality <= 60000 AND NOT fade")
def exclude_ids(spark, sf):
    a = b.assets(spark, sf)
    return rk.exclude_ids(a.select("asset_id"), a.where(F.col("quality") > 60000), a.where("fade"))


@query(f"{_A} SELECT asset_id, motion >= 0.05 OR origin_code = 'r' AS wanted, CASE WHEN motion >= 0.05 THEN 3 ELSE 2 END + CASE WHEN origin_code = 'r' THEN 0 ELSE 1 END AS n_all FROM assets")
def tags_overlap(spark, sf):
    tags = F.array_compact(F.array(F.col("origin_code"), F.when(F.col("motion") >= 0.05, "dynamic").otherwise(F.col("origin_code"))))
    want = F.array(F.lit("r"), F.lit("dynamic"))
    a = b.assets(spark, sf)
    return a.select("asset_id", F.arrays_overlap(tags, want).alias("wanted"), F.size(F.array_union(F.array_union(tags, want), F.when(F.col("motion") >= 0.05, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))).alias("n_all"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'timing' WHEN 3 THEN 'text' ELSE 'same' END AS change FROM documents")
def new_vs_old_signature(spark, sf):
    f = b.lrc_files(spark, sf).select(F.col("file_id").alias("doc_id"), "content")
    k = F.pmod("doc_id", F.lit(5))
    new = f.where(k != 1).withColumn("content", F.when(k == 2, F.regexp_replace("content", r"\[(\d+):0", "[$1:1")).when(k == 3, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    new = new.withColumn("content", F.when(k == 2, F.concat(F.lit("[00:59.99]"), F.col("content"))).otherwise(F.col("content")))
    return rk.compare_versions(f.where(k != 0), new)


@query(
    f"""WITH {CHARS_SQL}, i AS (SELECT track_id, line_no, char_no, ch || '/' || CASE WHEN char_no % 2 = 0 THEN '1' ELSE '0' END || '/' || CASE WHEN release_ms IS NOT NULL THEN 'true' ELSE 'false' END || '/' || upper(ch) AS v FROM chars),
l AS (SELECT track_id, line_no, sha256(string_agg(v, '|' ORDER BY char_no)) AS v FROM i GROUP BY 1, 2), k AS (SELECT track_id, line_no // 1024 AS b, sha256(string_agg(v, '|' ORDER BY line_no)) AS v FROM l GROUP BY 1, 2) SELECT track_id, sha256(string_agg(v, '|' ORDER BY b)) AS digest FROM k GROUP BY 1"""
)
def annotation_digest(spark, sf):
    return rk.annotation_digest(timed_chars(spark, sf))


@query(f"WITH {CHARS_SQL} SELECT track_id, count(*) FILTER (char_no % 3 = 0) AS no_reading, count(*) FILTER (char_no % 4 = 0) AS no_token, count(*) FILTER (char_no % 3 = 0 OR char_no % 4 = 0) = 0 AS complete FROM chars GROUP BY 1")
def pending_units(spark, sf):
    c = timed_chars(spark, sf)
    c2 = c.withColumn("parts", F.when(F.pmod("char_no", F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(F.col("parts")))
    return rk.pending_units(c2, c.where(F.pmod("char_no", F.lit(4)) != 0))


# ---------------------------------------------------------------- shot planning
@query(
    f"""WITH {b.FRAMES_SQL}, bl AS (SELECT track_id, frame_no // 13 AS block_no, CASE WHEN (frame_no // 13) % 4 = 0 THEN 'chorus' ELSE 'verse' END AS kind, CAST(sum(value) AS BIGINT) AS energy FROM frames GROUP BY 1, 2, 3),
v AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY energy) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM bl WHERE kind = 'verse' AND energy > 0), t AS (SELECT track_id, max(energy) AS lim FROM v WHERE i = greatest(0, CAST(floor(n * 0.7) AS BIGINT) - CASE WHEN n > 1 THEN 0 ELSE 1 END) GROUP BY 1)
SELECT bl.track_id, block_no, CASE WHEN kind = 'verse' AND energy > 0 AND energy >= lim THEN 'chorus' ELSE kind END AS kind, energy FROM bl LEFT JOIN t USING (track_id)"""
)
def energetic_sections(spark, sf):
    k = F.floor(F.col("frame_no") / 13)
    bl = b.frames(spark, sf).groupBy("track_id", k.alias("block_no")).agg(F.sum("value").cast("long").alias("energy"))
    bl = bl.select("track_id", "block_no", F.when(F.pmod("block_no", F.lit(4)) == 0, "chorus").otherwise("verse").alias("kind"), "energy")
    return rk.energy_sections(bl)


_BARS = "bars AS (SELECT track_id, frame_no AS bar_no, frame_no * 500 AS t_ms, frame_no % 29 = 3 AS forced, least(value / 150, 1.0) AS energy, CASE WHEN frame_no % 58 < 29 THEN 0.75 ELSE 1.5 END AS pace FROM frames)"
_CUTS = "cuts AS (SELECT track_id, bar_no, t_ms, forced FROM (SELECT *, bar_no - max(CASE WHEN forced OR bar_no = 0 THEN bar_no END) OVER (PARTITION BY track_id ORDER BY bar_no) AS since, greatest(1, CAST(floor(2 * CASE WHEN energy > 0.72 THEN 0.5 WHEN energy < 0.28 THEN 2.0 ELSE 1.0 END * pace + 0.5) AS BIGINT)) AS k FROM bars) WHERE since = 0 OR since % k = 0)"


def _cut_plan(spark, sf):
    f = b.frames(spark, sf)
    bars = f.select(
        "track_id", F.col("frame_no").alias("bar_no"), (F.col("frame_no") * 500).alias("t_ms"), (F.pmod("frame_no", F.lit(29)) == 3).alias("forced"),
        F.least(F.col("value") / 150, F.lit(1.0)).alias("energy"), F.when(F.pmod("frame_no", F.lit(58)) < 29, 0.75).otherwise(1.5).alias("pace"),
    )
    return rk.plan_cuts(bars)


@query(f"WITH {b.FRAMES_SQL}, {_BARS}, {_CUTS} SELECT * FROM cuts")
def plan_cuts(spark, sf):
    return _cut_plan(spark, sf)


# the same bars as a walk: half a second each, forced cuts between them, a take every 24 seconds of odd tracks
_WALK = """nodes AS (SELECT track_id, (frame_no - min(frame_no) OVER (PARTITION BY track_id)) * 500 AS t, least(value / 150, 1.0) AS energy, CASE WHEN frame_no % 58 < 29 THEN 0.75 ELSE 1.5 END AS pace FROM frames),
fin AS (SELECT track_id, max(t) + 700 AS fin FROM nodes GROUP BY 1), forced AS (SELECT track_id, t + 130 AS t FROM nodes WHERE t % 14500 = 1500),
takes AS (SELECT track_id, t AS t0, t + 4250 AS t1 FROM nodes WHERE track_id % 2 = 1 AND t % 24000 = 6000),
stops AS (SELECT track_id, t FROM nodes UNION SELECT track_id, t FROM forced UNION SELECT track_id, t1 FROM takes UNION SELECT track_id, 0 FROM fin),
a AS (SELECT s.track_id, s.t, f.fin, coalesce(n.energy, m.energy) AS energy, coalesce(n.pace, m.pace) AS pace,
        (SELECT max(t1) FROM takes k WHERE k.track_id = s.track_id AND k.t0 <= s.t AND s.t < k.t1) AS inside, (SELECT min(t0) FROM takes k WHERE k.track_id = s.track_id AND k.t0 > s.t) AS take
      FROM stops s JOIN fin f ON f.track_id = s.track_id ASOF LEFT JOIN nodes n ON n.track_id = s.track_id AND n.t <= s.t
      LEFT JOIN (SELECT track_id, arg_min(energy, t) AS energy, arg_min(pace, t) AS pace FROM nodes GROUP BY 1) m ON m.track_id = s.track_id),
w AS (SELECT *, least(t + CAST(round(greatest(1.0, 2.0 * CASE WHEN energy > 0.72 THEN 0.5 WHEN energy < 0.28 THEN 2.0 ELSE 1.0 END * pace) * 500) AS BIGINT), t + most) AS target
      FROM (SELECT *, least(6000, coalesce(take - t, 6000)) AS most FROM a)),
nx AS (SELECT track_id, t, CASE WHEN t >= fin - 800 THEN NULL WHEN inside IS NOT NULL THEN inside WHEN fin - nxt < 800 THEN NULL ELSE nxt END AS nxt FROM (
  SELECT w.*, coalesce((SELECT min(f.t) FROM forced f WHERE f.track_id = w.track_id AND f.t BETWEEN w.t + 800 AND w.target + 10),
    (SELECT arg_min(n.t, abs(n.t - w.target) * 100000000 + n.t) FROM nodes n WHERE n.track_id = w.track_id AND n.t BETWEEN w.t + 800 AND w.t + w.most), least(fin, w.t + most)) AS nxt FROM w))"""


@query(
    f"""WITH RECURSIVE {b.FRAMES_SQL}, {_WALK}, walk AS (SELECT track_id, CAST(0 AS BIGINT) AS t FROM fin UNION ALL SELECT w.track_id, n.nxt FROM walk w JOIN nx n ON n.track_id = w.track_id AND n.t = w.t WHERE n.nxt IS NOT NULL)
SELECT track_id, t AS t0, coalesce(nxt, fin) AS t1 FROM walk JOIN nx USING (track_id, t) JOIN fin USING (track_id) WHERE coalesce(nxt, fin) - t > 50"""
)
def walk_cuts(spark, sf):
    """The shots of a greedy walk over bars, forced cuts and takes; all of them come from the bars, which are written once."""
    odd, frames = F.pmod("track_id", F.lit(2)) == 1, b.frames(spark, sf)
    first = frames.groupBy("track_id").agg(F.min("frame_no").alias("first"))
    nodes = cut_lineage(frames.join(first, "track_id").select(
        "track_id", ((F.col("frame_no") - F.col("first")) * 500).alias("t"), F.least(F.col("value") / 150, F.lit(1.0)).alias("energy"), F.when(F.pmod("frame_no", F.lit(58)) < 29, 0.75).otherwise(1.5).alias("pace"), F.lit(500).cast("long").alias("bar_ms")
    ))
    forced = nodes.where(F.pmod("t", F.lit(14500)) == 1500).select("track_id", (F.col("t") + 130).alias("t"))
    takes = nodes.where(odd & (F.pmod("t", F.lit(24000)) == 6000)).select("track_id", F.col("t").alias("t0"), (F.col("t") + 4250).alias("t1"))
    ends = nodes.groupBy("track_id").agg((F.max("t") + 700).alias("end"))
    return wk.walk_cuts(nodes, forced, takes, ends, min_shot=800, max_shot=6000)


@query(
    f"""WITH RECURSIVE {b.LINES_SQL}, pts AS (SELECT DISTINCT track_id, start_ms AS t FROM lines), nx AS (SELECT p.track_id, p.t, (SELECT min(q.t) FROM pts q WHERE q.track_id = p.track_id AND q.t >= p.t + 4) AS nxt FROM pts p),
walk AS (SELECT track_id, min(t) AS t FROM pts GROUP BY 1 UNION ALL SELECT w.track_id, n.nxt FROM walk w JOIN nx n ON n.track_id = w.track_id AND n.t = w.t WHERE n.nxt IS NOT NULL) SELECT * FROM walk"""
)
def min_gap_pick(spark, sf):
    """Starts of lines at least four milliseconds (hours of event time) from the one picked before."""
    return wk.min_gap_pick(b.lines(spark, sf).select("track_id", F.col("start_ms").alias("t")), by=["track_id"], t="t", min_gap=4)


@query(
    f"""WITH {b.FRAMES_SQL}, {_BARS}, {_CUTS}, {b.ASSETS_SQL}, sh AS (SELECT track_id, bar_no AS shot_no FROM cuts), pn AS (SELECT track_id, min(shot_no) AS shot_no, min(pinned) AS pinned FROM sh JOIN (SELECT library_id AS track_id, min(asset_id) AS pinned FROM assets GROUP BY 1) USING (track_id) GROUP BY 1),
po AS (SELECT library_id AS track_id, asset_id, row_number() OVER (PARTITION BY library_id ORDER BY quality DESC, asset_id) AS slot, count(*) OVER (PARTITION BY library_id) AS size FROM assets a WHERE asset_id % 40 < 20 AND NOT EXISTS (SELECT 1 FROM pn WHERE pn.track_id = a.library_id AND pn.pinned = a.asset_id)),
nn AS (SELECT s.*, p.pinned, sum(CASE WHEN p.pinned IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.track_id ORDER BY s.shot_no) AS nth FROM sh s LEFT JOIN pn p USING (track_id, shot_no)), zz AS (SELECT track_id, max(size) AS size FROM po GROUP BY 1)
SELECT nn.track_id, nn.shot_no, coalesce(pinned, po.asset_id) AS asset_id, CASE WHEN pinned IS NOT NULL THEN 'pin' WHEN po.asset_id IS NULL THEN 'missing' WHEN nth > zz.size THEN 'fallback' ELSE 'new' END AS why FROM nn LEFT JOIN zz USING (track_id) LEFT JOIN po ON po.track_id = nn.track_id AND pinned IS NULL AND po.slot = (nth - 1) % zz.size + 1"""
)
def assign_assets(spark, sf):
    shots = _cut_plan(spark, sf).select("track_id", F.col("bar_no").alias("shot_no"))
    a = b.assets(spark, sf)
    pool = a.where(F.pmod("asset_id", F.lit(40)) < 20).select(F.col("library_id").alias("track_id"), "asset_id", (-F.col("quality")).alias("place"))
    lowest = a.groupBy(F.col("library_id").alias("track_id")).agg(F.min("asset_id").alias("pinned"))
    pins = shots.groupBy("track_id").agg(F.min("shot_no").alias("shot_no")).join(lowest, "track_id")
    return rk.assign_assets(shots, pool, pins)


# ---------------------------------------------------------------- similarity
@query(
    f"""WITH l AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS t, substr(lower(p_name), 3, 4) AS w FROM part) SELECT p_partkey, round({_LEV.format(a='n', b='t')}, 6) AS ratio, 1.0::DOUBLE AS best FROM l"""
)
def similarity(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("n"), F.lower("p_type").alias("t"))
    return p.select("p_partkey", F.round(sim.edit_ratio(F.col("n"), F.col("t")), 6).alias("ratio"), sim.best_window_ratio(F.substring("n", 3, 4), F.col("n")).alias("best"))


_SPN = """sp AS (SELECT track_id, line_no AS span_no, text AS base, upper(text) AS reading, CASE WHEN line_no % 7 = 0 THEN 0 ELSE start_ms - 3000 END AS f, CASE WHEN line_no % 7 = 0 THEN 0 ELSE start_ms + 3000 END AS t, CASE WHEN line_no % 5 = 0 AND line_no % 7 <> 0 THEN line_no END AS owner FROM lines WHERE line_no % 4 = 0)"""


@query(
    f"""{_L}, {_SPN} SELECT l.track_id, l.line_no, s.span_no, s.reading FROM lines l JOIN sp s ON s.track_id = l.track_id AND contains(l.text, s.base) AND CASE WHEN s.owner IS NOT NULL THEN s.owner = l.line_no ELSE (s.f = 0 AND s.t = 0) OR (l.start_ms < s.t AND l.end_ms > s.f) END"""
)
def active_spans_for_line(spark, sf):
    ln = b.lines(spark, sf)
    m = lambda n: F.pmod("line_no", F.lit(n))
    spans = ln.where(m(4) == 0).select(
        "track_id", F.col("line_no").alias("span_no"), F.col("text").alias("base"), F.upper("text").alias("reading"),
        F.when(m(7) == 0, 0).otherwise(F.col("start_ms") - 3000).alias("from_ms"), F.when(m(7) == 0, 0).otherwise(F.col("start_ms") + 3000).alias("to_ms"),
        F.when((m(5) == 0) & (m(7) != 0), F.col("line_no")).alias("owner"),
    )
    return mt.active_spans_for_line(ln, spans)
