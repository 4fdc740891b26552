"""Queries that carry readings and singers from one version of a text to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.functions import textnorm
from verseline.operators import alignment as al
from verseline.plans import bindings as b
from verseline.plans.registry import query

DOC = ["doc_id"]

# the other version of a document: its first third of lines moved behind the rest, every fifth line gone, every seventh word gone from
# every fourth line
_VERSION = """version AS (
  SELECT doc_id, CASE WHEN line_no * 3 <= n THEN line_no + n ELSE line_no END AS line_no,
         CASE WHEN line_no % 4 = 2 THEN array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 7 <> 4), ' ') ELSE text END AS text
  FROM (SELECT doc_id, line_no, text, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_lines) WHERE line_no % 5 <> 0)"""


def other_version(spark, sf) -> DataFrame:
    docs = b.table(spark, sf, "documents", "doc_id", "text")
    rows = docs.withColumn("l", F.split("text", "\n")).select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("p", "text")).withColumn("line_no", (F.col("p") + 1).cast("long"))
    kept = rows.where(F.pmod("line_no", F.lit(5)) != 0)
    fewer = F.array_join(F.filter(F.split("text", " "), lambda w, i: F.pmod(i + 1, F.lit(7)) != 4), " ")
    return kept.select(
        "doc_id", F.when(F.col("line_no") * 3 <= F.col("n"), F.col("line_no") + F.col("n")).otherwise(F.col("line_no")).alias("line_no"),
        F.when(F.pmod("line_no", F.lit(4)) == 2, fewer).otherwise(F.col("text")).alias("text"),
    )


def sung(c: Column) -> Column:
    """Letters and digits as lower-case hiragana of full width."""
    return textnorm.hiragana(F.lower(textnorm.fold_width(c)))


def _units_sql(name: str, lines: str, key: str, keep: str) -> str:  # key: of the line's text x, letter for letter
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id, line_no, col, unit, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, col) - 1 AS pos
  FROM (SELECT doc_id, line_no, unnest(range(0, len(c))) AS col, unnest(c) AS unit FROM (SELECT doc_id, line_no, string_split({key}, '') AS c FROM (SELECT doc_id, line_no, text AS x FROM {lines})))
  WHERE regexp_matches(unit, '{keep}')),
{name}_runs AS (
  SELECT doc_id, pos, CASE WHEN len(u) = 8 THEN array_to_string(u, chr(31)) END AS anchor, CASE WHEN len(u) >= 3 THEN array_to_string(u[1:3], chr(31)) END AS chk
  FROM (SELECT doc_id, pos, list(unit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS u FROM {name}))"""


def _aligned_sql(key: str, keep: str) -> str:
    return f"""WITH {b.DOC_LINES_SQL}, {_VERSION},
{_units_sql('src', 'doc_lines', key, keep)},
{_units_sql('dst', 'version', key, keep)},
met AS (
  SELECT a.doc_id, a.pos AS a, z.pos AS z
  FROM (SELECT doc_id, anchor, min(pos) AS pos FROM src_runs WHERE anchor IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) a
  JOIN (SELECT doc_id, anchor, min(pos) AS pos FROM dst_runs WHERE anchor IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) z ON a.doc_id = z.doc_id AND a.anchor = z.anchor),
votes AS (
  SELECT doc_id, region, shift, row_number() OVER (PARTITION BY doc_id, region ORDER BY n DESC, abs(shift), shift DESC) AS place FROM (SELECT doc_id, z // 64 AS region, z - a AS shift, count(*) AS n FROM met GROUP BY 1, 2, 3)
  QUALIFY place <= 3),
tried AS (
  SELECT d.doc_id, d.pos, d.chk, v.shift, v.rank FROM dst_runs d
  JOIN (SELECT doc_id, region + k AS region, shift, CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 6 END + place AS rank FROM votes, (SELECT unnest([0, 1, -1]) AS k)) v ON v.doc_id = d.doc_id AND v.region = d.pos // 64
  WHERE d.chk IS NOT NULL),
mapping AS MATERIALIZED (
  SELECT doc_id, pos, source_pos FROM (
    SELECT t.doc_id, t.pos + k AS pos, t.pos - t.shift + k AS source_pos, rank
    FROM tried t JOIN src_runs s ON s.doc_id = t.doc_id AND s.pos = t.pos - t.shift AND s.chk = t.chk, (SELECT unnest([0, 1, 2]) AS k))
  QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY rank, source_pos) = 1)"""


_PLAIN = _aligned_sql("lower(x)", al.VISIBLE)
_SUNG_KEY = f"translate(lower(translate(translate(x, '{textnorm._WIDE.replace(chr(39), chr(39) * 2)}', '{textnorm._NARROW.replace(chr(39), chr(39) * 2)}'), '{textnorm._HALF_KANA}', '{textnorm._FULL_KANA}')), '{textnorm._KATAKANA}', '{textnorm._HIRAGANA}')"
LETTER = r"[\p{L}\p{N}]"
_SUNG = _aligned_sql(_SUNG_KEY, LETTER)


@query(
    f"""{_PLAIN}, spans AS MATERIALIZED (
  SELECT doc_id, line_no, s AS first, s + 2 AS last, '<' || substr(text, CAST(s + 1 AS INTEGER), 3) || '>' AS reading
  FROM (SELECT doc_id, line_no, text, unnest(range(1, length(text) - 2, 9)) AS s FROM doc_lines)),
units AS MATERIALIZED (
  SELECT p.doc_id, p.line_no AS own, p.first AS f0, p.last AS l0, p.reading, s.pos AS source_pos
  FROM (SELECT *, unnest(range(first, last + 1)) AS col FROM spans) p JOIN src s ON s.doc_id = p.doc_id AND s.line_no = p.line_no AND s.col = p.col),
placed AS MATERIALIZED (SELECT m.doc_id, m.source_pos, m.pos, d.line_no, d.col FROM mapping m JOIN dst d ON d.doc_id = m.doc_id AND d.pos = m.pos),
moved AS MATERIALIZED (SELECT u.*, p.pos - p.source_pos AS shift, p.line_no, p.col FROM units u JOIN placed p ON p.doc_id = u.doc_id AND p.source_pos = u.source_pos)
SELECT doc_id, min(line_no) AS line_no, min(col) AS first, max(col) AS last, reading FROM moved GROUP BY doc_id, own, f0, l0, reading, shift
HAVING count(*) = 3 AND min(line_no) = max(line_no) AND max(col) - min(col) = 2"""
)
def transfer_spans(spark, sf):
    """Readings over three letters in nine, carried to the other version of every document."""

    def spans(text: Column) -> Column:
        return F.when(F.length(text) >= 4, F.transform(F.sequence(F.lit(1), F.length(text) - 3, F.lit(9)), lambda i: F.struct(
            i.cast("long").alias("first"), (i + 2).cast("long").alias("last"), F.concat(F.lit("<"), F.substring(text, i + 1, F.lit(3)), F.lit(">")).alias("reading")
        )))

    return al.carry_spans(b.doc_lines(spark, sf), other_version(spark, sf), by=DOC, spans=spans)


_SINGERS = "singers AS (SELECT doc_id, pos, chr(CAST(65 + line_no // 2 % 3 AS INTEGER)) AS singer FROM src WHERE line_no % 11 > 0)"


def _sung(spark, sf):
    # two lines for each of three singers; every eleventh line belongs to nobody
    whole = F.struct(F.lit(0).cast("long").alias("first"), (F.length("text") - 1).cast("long").alias("last"), F.expr("char(65 + line_no div 2 % 3)").alias("singer"))
    singers = F.when((F.pmod("line_no", F.lit(11)) > 0) & (F.col("text") != ""), F.array(whole))
    return b.doc_lines(spark, sf).withColumn("singers", singers), other_version(spark, sf)


@query(
    f"""{_SUNG}, {_SINGERS}, got AS (SELECT m.doc_id, m.pos, s.singer FROM mapping m JOIN singers s ON s.doc_id = m.doc_id AND s.pos = m.source_pos)
SELECT * FROM (SELECT d.doc_id, d.line_no, d.col, coalesce(
    last_value(singer IGNORE NULLS) OVER (PARTITION BY d.doc_id, line_no ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(singer IGNORE NULLS) OVER (PARTITION BY d.doc_id, line_no ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS singer
  FROM dst d LEFT JOIN got USING (doc_id, pos)) WHERE singer IS NOT NULL"""
)
def transfer_singers(spark, sf):
    """A singer for every letter of the other version."""
    return al.carry_singers(*_sung(spark, sf), by=DOC, key=sung, keep=LETTER)


@query(
    f"""{_SUNG}, {_SINGERS}, got AS (SELECT m.doc_id, m.pos FROM mapping m JOIN singers s ON s.doc_id = m.doc_id AND s.pos = m.source_pos),
ln AS (SELECT d.doc_id, d.line_no, count(*) AS letters, count(g.pos) AS matched FROM dst d LEFT JOIN got g USING (doc_id, pos) GROUP BY 1, 2)
SELECT *, CASE WHEN matched = 0 THEN 'uncovered' WHEN matched / letters < 0.5 THEN 'weak' ELSE 'ok' END AS state,
       round(sum(matched) OVER (PARTITION BY doc_id) / sum(letters) OVER (PARTITION BY doc_id), 3) AS coverage FROM ln"""
)
def singer_report(spark, sf):
    """How well the singers of every line of the other version are covered."""
    return al.carry_report(*_sung(spark, sf), by=DOC, key=sung, keep=LETTER)
