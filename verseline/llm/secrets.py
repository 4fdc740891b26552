"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds, each matched leftmost and without overlap inside its own kind: ``assign`` (key word, separator, value of six characters or
more), ``access`` (fixed prefix, twenty characters or more) and ``hex`` (twenty-four digits or more). Weak kinds are candidates that mean
little alone: ``weak_id`` (a bare identifier), ``weak_secret`` (a bare 40-character value) and ``endpoint`` (a URL). An interval join
inside a scope of ``scope`` code points keeps a weak identifier only near a secret, a weak secret only near an identifier or an endpoint,
and an endpoint only near both an identifier and a secret. Base spans are always kept and are the partners of the weak ones.

Places are code points, the end exclusive. A split of the text at the matches gives the gaps, and running sums of gaps and matches give the
places, so that neither the text nor its matches leave the JVM. Only documents with a match meet a shuffle, and without their texts.

Defined results: null and empty texts have no span; rows that repeat an id are documents of their own (equal rows get equal results);
a null id is an id like any other; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.llm.common import checkpointed, document_columns, field, null_safe, row_key

# Kinds in listed order with their patterns; the base patterns are given, {n,} stands where a shorter match cannot hide a longer one.
BASE = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
)
WEAK = (
    ("weak_id", r"(?<![A-Za-z0-9])(?=[A-Z0-9]{0,40}[0-9])(?=[0-9]{0,40}[A-Z])[A-Z0-9]{16,40}(?![A-Za-z0-9])"),
    ("weak_secret", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    ("endpoint", r"(?:https?|wss?|ftp|s3|amqps?|rediss?|postgres(?:ql)?|mysql|mongodb)://[^\x20\x09-\x0D\x22\x27<>]{4,}"),
)
KINDS = tuple(k for k, _ in BASE + WEAK)
MIN_VALUE = 6


# What every match of the kind holds; a plain search for it spares the pattern.
HOLDS = {1: "AKIA", 5: "://"}


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, pos, gap before it, length, value length) of one kind's matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == 0 else hits
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"), F.length(x["value"]).alias("value")),
    )
    there = text.contains(HOLDS[kind]) & text.rlike(pattern) if kind in HOLDS else text.rlike(pattern)
    return F.when(there, F.filter(rows, lambda x: x["len"].isNotNull()))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end) of every base and weak candidate span; one set for rows that are equal."""
    patterns = [p for _, p in BASE + WEAK]
    own = document_columns(docs).select("doc_id", row_key().alias("key"), *[_found(F.col("text"), k, p).alias(f"k{k}") for k, p in enumerate(patterns)])
    nothing = F.expr("cast(array() as array<struct<kind:int,pos:int,gap:bigint,len:bigint,value:int>>)")
    parts = F.concat(*[F.coalesce(F.col(f"k{k}"), nothing) for k in range(len(patterns))])
    rows = own.select("doc_id", "key", F.explode(parts).alias("m")).select("doc_id", "key", "m.*").dropDuplicates(["doc_id", "key", "kind", "pos"])
    w = Window.partitionBy("doc_id", "key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w)).withColumn("start", F.col("end") - F.col("len"))
    return placed.where((F.col("kind") != 0) | (F.col("value") >= MIN_VALUE)).select("doc_id", "key", "kind", "start", "end")


def _near(left: DataFrame, right: DataFrame, scope: int, how: str) -> DataFrame:
    """Semi or anti interval join: is there a right span of the same document at most ``scope`` code points away?"""
    side = right.select(
        F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"),
        F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("r_cell"),
    )
    cond = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")) & (F.floor(F.col("start") / scope) == F.col("r_cell"))
    return left.join(side, cond & (F.col("r_start") <= F.col("end") + scope) & (F.col("r_end") + scope >= F.col("start")), how)


def _inside(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """Left spans whose start no right span of the document covers."""
    side = right.select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))).alias("r_cell"))
    cond = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")) & (F.floor(F.col("start") / cell) == F.col("r_cell"))
    return left.join(side, cond & (F.col("start") >= F.col("r_start")) & (F.col("start") < F.col("r_end")), "left_anti")


def link(spans: DataFrame, scope: int = 300) -> DataFrame:
    """Base spans and those weak spans whose complementary parts stand within the scope. Kinds are numbers of ``KINDS``.

    The spans (small beside the texts) are checkpointed, as several joins read them and the texts should be matched once.
    """
    spans = checkpointed(spans)
    base = spans.where(F.col("kind") < len(BASE))
    kind = F.col("kind")
    loose = _inside(spans.where(kind.isin(3, 4)), base, scope)
    ids = base.where(kind == 1).unionByName(loose.where(kind == 3))
    values = base.where(kind.isin(0, 2)).unionByName(loose.where(kind == 4))
    ends = spans.where(kind == 5)
    weak_id = _near(loose.where(kind == 3), values, scope, "left_semi")
    weak_secret = _near(loose.where(kind == 4), ids.unionByName(ends), scope, "left_semi")
    endpoint = _near(_near(ends, ids, scope, "left_semi"), values, scope, "left_semi")
    return base.unionByName(weak_id).unionByName(weak_secret).unionByName(endpoint)


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Per row of ``docs``: doc_id, counts per base kind, ``spans`` (array of kind, start, end by start) and the same as text."""
    linked = link(matches(docs), scope)
    per = linked.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    keys = document_columns(docs).select("doc_id", row_key().alias("key"))
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    rows = null_safe(keys, per, ["doc_id", "key"], "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))

    def written(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    return rows.select("doc_id", *[count(k).alias(f"n_{n}") for k, (n, _) in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.col("spans").alias("span_list"))


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = 300) -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` a mark stands for every run of overlapping spans. Texts without a span, and null texts, stay as they are."""
    text = field(docs, "text")
    tagged = docs.withColumn("__id", field(docs, "doc_id").cast("long")).withColumn("__key", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    per = link(matches(docs), scope).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    per = per.withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    joined = null_safe(tagged, per, ["__id", "__key"], "left")
    body = F.col("text")
    # pieces of text between runs; the state is (end so far, text so far)
    folded = F.aggregate(
        "__spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(body, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).alias("out"))
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(body, (s["at"] + 1).cast("int"), F.length(body))),
    )
    return joined.withColumn("text", F.when(F.size("__spans") > 0, folded).otherwise(body)).select(*[F.col(f"`{c}`") for c in docs.columns])
