"""Who sings what, from files that say it: runs of text with a singer key, out of coloured HTML, ASS, JSON and labelled text.

All functions take files (file_id, content) and return (file_id, line_no, run_no, singer_key, text): ``run_no`` orders the runs of a file,
``line_no`` counts its line breaks. What carries over from line to line (open tags, the last label) is an ordered scan over blocks of a
file, so a file of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.operators.ordered import last_known, running_min, running_sum, scan
from verseline.session import cut_lineage
from verseline.sources.dialects import split_lines, unescape_html

#: Key of text without a colour or singer.
NO_KEY = "none"
# Tags that colour text, tags that end a line, and parts of a page that hold no text.
COLOUR_TAGS, BREAK_TAGS = ("span", "font"), ("br", "p", "div", "li", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6")
HIDDEN = r"(?is)<(script|style|noscript)\b.*?</\1\s*>"
BLOCK = 4096


def colour_key(colour: Column) -> Column:
    """``#rrggbb`` of a CSS colour in hex (three or six digits) or rgb() notation; others in lower case."""
    c = F.lower(F.trim(colour))
    part = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(c, r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", i).try_cast("int"))), 2, "0")
    return (
        F.when(c.rlike(r"^rgba?\(\s*\d+\s*,\s*\d+\s*,\s*\d+"), F.concat(F.lit("#"), part(1), part(2), part(3)))
        .when(c.rlike(r"^#[0-9a-f]{3}$"), F.regexp_replace(c, "([0-9a-f])", "$1$1"))
        .otherwise(c)
    )


def html_runs(files: DataFrame) -> DataFrame:
    """Text of a page by the colour that it stands in.

    Tags nest: depth is a running sum of opens and closes (a close without an open does nothing), and every close finds its open as the last
    one of its depth. Tags without a colour pass on the colour around them, so with their closes they drop out, and what is left is the last
    coloured open at the current depth of coloured tags. The scans of the nesting see tags alone, which are written down once; a text is
    shuffled once, to meet the last coloured tag and the line breaks before it.
    """
    pieces = files.select("file_id", F.regexp_extract_all(F.regexp_replace("content", HIDDEN, ""), F.lit(r"(<[^>]*>|[^<]+|<)"), 1).alias("__all"))
    rows = pieces.select("file_id", F.posexplode("__all").alias("__pos", "__t")).withColumn("run_no", F.col("__pos").cast("long") + 1)
    is_tag = F.col("__t").startswith("<") & F.col("__t").endswith(">")
    name = F.when(is_tag, F.lower(F.regexp_extract("__t", r"^</?([a-zA-Z0-9]+)", 1)))
    closing = F.col("__t").startswith("</")
    colour = F.regexp_extract("__t", r"(?i)color\s*[:=]\s*[\"']?\s*(#[0-9a-fA-F]{3,6}\b|rgba?\([^)]*\))", 1)
    at = F.floor(F.col("run_no") / BLOCK)
    step = F.when(closing, -1).when(~F.col("__t").rlike(r"/\s*>$"), 1).otherwise(0).cast("long")
    tags = rows.where(name.isin(*COLOUR_TAGS)).select("file_id", "run_no", step.alias("__step"), F.when(~closing & (colour != ""), colour_key(colour)).alias("__colour"))
    tags = cut_lineage(tags.where("__step <> 0"))
    s = scan(tags, by=["file_id"], order=["run_no"], block=at, wide=True, __sum=running_sum(F.col("__step")))
    s = scan(s, by=["file_id"], order=["run_no"], block=at, wide=True, __low=running_min(F.col("__sum")), __low0=running_min(F.col("__sum"), inclusive=False))
    floor_ = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    # the stack never falls below empty: what the sum lost below zero is added again
    depth = F.col("__sum") - floor_("__low")
    idle = (F.col("__step") == -1) & (floor_("__low") < floor_("__low0"))
    s = s.where(~idle).withColumn("__level", depth + F.when(F.col("__step") == -1, 1).otherwise(0))
    met = scan(s, by=["file_id", "__level"], order=["run_no"], block=at, wide=True, __open=last_known(F.when(F.col("__step") == 1, F.col("__colour").isNotNull())))
    coloured = cut_lineage(met.where("__open").select("file_id", "run_no", "__step", "__colour"))
    deep = scan(coloured, by=["file_id"], order=["run_no"], block=at, wide=True, __depth=running_sum(F.col("__step")))
    seen = scan(deep, by=["file_id", "__depth"], order=["run_no"], block=at, wide=True, __key=last_known(F.when(F.col("__step") == 1, F.col("__colour"))))
    key = F.when(F.col("__depth") > 0, F.col("__key")).otherwise(NO_KEY)
    keys = seen.select("file_id", "run_no", key.alias("__mark"), F.lit(0).cast("long").alias("__break"), F.lit(None).cast("string").alias("__text"))
    breaks = F.when(name.isin(*BREAK_TAGS), 1).otherwise(0).cast("long")
    rest = rows.select("file_id", "run_no", F.lit(None).cast("string").alias("__mark"), breaks.alias("__break"), F.when(~is_tag, unescape_html(F.col("__t"))).alias("__text"))
    both = keys.unionByName(rest.where("__break > 0 or __text is not null"))
    out = scan(both, by=["file_id"], order=["run_no"], block=at, wide=True, __line=running_sum(F.col("__break")), __key=last_known(F.col("__mark")))
    return out.where(F.col("__text").isNotNull()).select(
        "file_id", (F.col("__line") + 1).alias("line_no"), "run_no", F.coalesce("__key", F.lit(NO_KEY)).alias("singer_key"), F.col("__text").alias("text")
    )


def ass_runs(files: DataFrame) -> DataFrame:
    """Text of Dialogue lines by the Name field, else the Style; a colour override starts a run of that colour, ``\\r`` goes back."""
    fmt = F.transform(F.split(F.regexp_extract("content", r"(?is)\[Events\].*?\n\s*Format:\s*([^\r\n]*)", 1), ","), lambda x: F.lower(F.trim(x)))
    lines = split_lines(files.withColumn("__fmt", fmt))
    events = F.coalesce(F.try_element_at(F.split("raw", ":", 2), F.lit(2)), F.lit(""))
    rows = lines.where(F.col("raw").rlike(r"(?i)^\s*Dialogue:")).withColumn("__f", F.split(events, ","))
    rows = rows.where(F.size("__f") >= F.size("__fmt"))
    field = lambda n: F.trim(F.coalesce(F.try_element_at("__f", F.nullif(F.array_position("__fmt", n), F.lit(0)).cast("int")), F.lit("")))
    text = F.array_join(F.slice("__f", F.size("__fmt"), F.size("__f")), ",")
    base = F.when(field("name") != "", field("name")).otherwise(field("style"))
    parts = rows.select("file_id", "line_no", base.alias("__base"), F.posexplode(F.regexp_extract_all(text, F.lit(r"(\{[^}]*\}|[^{]+)"), 1)).alias("__k", "__p"))
    colours = F.regexp_extract_all("__p", F.lit(r"\\1?c&H([0-9a-fA-F]{6,8})&?"), 1)
    bgr = F.lower(F.right(F.try_element_at(colours, F.lit(-1)), F.lit(6)))
    rgb = F.concat(F.lit("#"), bgr.substr(5, 2), bgr.substr(3, 2), bgr.substr(1, 2))
    tag = F.col("__p").startswith("{")
    mark = F.when(tag & (F.size(colours) > 0), rgb).when(tag & F.col("__p").rlike(r"\\r(?![a-z])"), F.col("__base"))
    line = Window.partitionBy("file_id", "line_no").orderBy("__k")
    out = parts.withColumn("singer_key", F.coalesce(F.last(mark, ignorenulls=True).over(line), F.col("__base"))).where(~tag)
    return out.select("file_id", "line_no", (F.col("line_no") * 65536 + F.col("__k")).alias("run_no"), "singer_key", F.regexp_replace("__p", r"\\[Nnh]", " ").alias("text"))


def json_runs(files: DataFrame) -> DataFrame:
    """``[{"singer": .., "text": ..}]``, or such a list under ``runs`` or ``parts``."""
    one = "array<struct<singer:string,text:string>>"
    listed = F.from_json("content", one)
    held = F.from_json("content", f"struct<runs:{one},parts:{one}>")
    got = F.when(F.ltrim(F.col("content")).startswith("["), listed).otherwise(F.coalesce(F.when(F.size(held["runs"]) > 0, held["runs"]), held["parts"]))
    rows = files.select("file_id", F.posexplode(got).alias("__k", "__r"))
    key = F.coalesce(F.nullif(F.col("__r.singer"), F.lit("")), F.lit(NO_KEY))
    number = F.col("__k").cast("long") + 1
    return rows.select("file_id", number.alias("line_no"), number.alias("run_no"), key.alias("singer_key"), F.coalesce("__r.text", F.lit("")).alias("text"))


def labelled_runs(files: DataFrame, known: Sequence[str]) -> DataFrame:
    """Lines by the label at their start (``name：``, ``[name]``, ``【name】``, ``(name)``) if it is one of ``known``; the last label holds on."""
    plain = F.trim(F.regexp_replace("raw", r"\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\]|<\d{1,3}:\d{2}(?:[.:]\d{1,3})?>", ""))
    lines = split_lines(files).withColumn("__l", plain).where(~F.col("__l").rlike(r"^\[[a-zA-Z]+:.*\]$"))
    label = r"^(?:[\[【(（]([^\]】)）]{1,24})[\]】)）]|([^\s:：]{1,24})[:：])\s*"
    name = F.trim(F.concat(F.regexp_extract("__l", label, 1), F.regexp_extract("__l", label, 2)))
    hit = F.col("__l").rlike(label) & name.isin(list(known))
    lines = lines.withColumns({"__name": F.when(hit, name), "text": F.when(hit, F.regexp_replace("__l", label, "")).otherwise(F.col("__l"))})
    s = scan(lines.drop("raw", "__l"), by=["file_id"], order=["line_no"], block=F.floor(F.col("line_no") / BLOCK), singer_key=last_known(F.col("__name")))
    return s.select("file_id", "line_no", F.col("line_no").alias("run_no"), "singer_key", "text")


def singer_runs(files: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Runs of files (file_id, ext, content) of any kind: ``ass`` / ``ssa``, ``html`` / ``htm``, ``json``, else labelled text."""
    ext = F.lower("ext")
    of = lambda *names: files.where(ext.isin(*names)).select("file_id", "content")
    rest = files.where(~ext.isin("ass", "ssa", "html", "htm", "json") | ext.isNull()).select("file_id", "content")
    return ass_runs(of("ass", "ssa")).unionByName(html_runs(of("html", "htm"))).unionByName(json_runs(of("json"))).unionByName(labelled_runs(rest, known))
