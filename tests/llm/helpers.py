"""Fixtures shared by the corpus tests: awkward rows and the smallest documents table."""

SF = "/root/testdata/sf0.001"


def awkward(spark, texts=()):
    """Null and empty texts, null and repeated ids, equal rows, extra columns whose names operators use inside."""
    rows = [(None, None), (1, ""), (1, ""), (2, None), (2, "one two three"), (3, "\x0b\x0c \n"), (None, "one two three"), *texts]
    return spark.createDataFrame([(i, t, "x", 1, 2, "p") for i, t in rows], "doc_id long, text string, key string, pos int, start long, fp string")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) if not isinstance(v, (list, dict)) else (True, str(v)) for v in r))
