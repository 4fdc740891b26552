"""Reading text corpora and tolerant JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File kinds by extension.
MEDIA_KINDS = {
    "lyrics": ("lrc", "krc", "yrc", "srt", "ass", "ssa", "txt"),
    "audio": ("mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "wma", "ape", "tta", "alac", "aiff", "aif"),
    "video": ("mp4", "mkv", "webm", "mov", "avi", "flv", "ts", "m2ts", "m4v", "wmv", "mpg", "mpeg"),
    "image": ("jpg", "jpeg", "png", "webp", "bmp", "gif"),
}
DECODE_CHARSETS = ("UTF-8", "GB18030", "Big5", "Shift_JIS", "EUC-KR")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def media_kind(path: Column) -> Column:
    ext = extension(path)
    out = F.when(F.lit(False), "")
    for kind, exts in MEDIA_KINDS.items():
        out = out.when(ext.isin(*exts), kind)
    return out.otherwise("other")


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path, ext, kind, raw bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", extension(F.col("path")).alias("ext"), media_kind(F.col("path")).alias("kind"), F.col("content").alias("bytes"))


def decode_corpus(binary: DataFrame, charsets=DECODE_CHARSETS) -> DataFrame:
    """Bytes -> text: a byte order mark decides; else the clean candidate with the best score, or where none is clean the best one, marked ``lossy``.

    A candidate with replacement characters is not clean. The score is the share of common characters, kana counting
    extra, private-use and half-width kana counting against. Other charsets than the six standard ones need
    ``spark.sql.legacy.javaCharsets`` and ``spark.sql.legacy.codingErrorAction`` set to true on the session.
    """
    keys = [c for c in binary.columns if c != "bytes"]
    head = F.hex(F.substring("bytes", 1, 3))
    bom = (
        F.when(F.startswith(head, F.lit("EFBBBF")), F.struct(F.lit(4).alias("skip"), F.lit("UTF-8").alias("cs")))
        .when(F.startswith(head, F.lit("FFFE")), F.struct(F.lit(3).alias("skip"), F.lit("UTF-16LE").alias("cs")))
        .when(F.startswith(head, F.lit("FEFF")), F.struct(F.lit(3).alias("skip"), F.lit("UTF-16BE").alias("cs")))
    )
    tries = F.when(bom.isNotNull(), F.array(bom["cs"])).otherwise(F.array(*[F.lit(c) for c in charsets]))
    rows = binary.withColumn("__skip", F.coalesce(bom["skip"], F.lit(1))).select(
        *keys, "__skip", "bytes", F.posexplode(tries).alias("__rank", "charset")
    )
    decoded = F.expr(
        "CASE charset "
        + " ".join(f"WHEN '{c}' THEN decode(substring(bytes, __skip), '{c}')" for c in dict.fromkeys((*charsets, "UTF-16LE", "UTF-16BE")))
        + " END"
    )
    text = rows.withColumn("text", decoded).withColumn("__clean", ~F.contains("text", F.lit("�")))
    n = F.greatest(F.length("text"), F.lit(1))
    score = (
        F.regexp_count("text", F.lit(r"[\x{20}-\x{7E}\s一-鿿、。！？]"))
        + 2 * F.regexp_count("text", F.lit(r"[぀-ヿ]"))
        - 2 * F.regexp_count("text", F.lit(r"[\x{E000}-\x{F8FF}]"))
        - F.regexp_count("text", F.lit(r"[ｦ-ﾟ]"))
    ) / n
    best = F.max_by(F.struct("charset", "text", "__clean"), F.struct("__clean", score, -F.col("__rank")))
    return text.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.charset").alias("charset"), F.col("b.text").alias("content"), (~F.col("b.__clean")).alias("lossy"))


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; unreadable lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The unreadable lines of a JSON-lines folder, one row per line."""
    lines = spark.read.text(path)
    return lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select(F.col("value").alias("bad_line"))
