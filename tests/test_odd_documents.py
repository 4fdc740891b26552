"""Documents that hold marks of the dialects, line breaks of all kinds, blanks, nulls and repeated ids, against the DuckDB statements."""

import __spark_entry__ as entry
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle_check import compare

TEXTS = [
    "abc def\nghi", "", None, "\n", "a\n\nb\n", "a\n \nb", "\ta\t\n\tb", "a\r\nb", "a\rb\rc", "【x】a\n【】b\nc【y】d\ne", "[00:01:02]a\n[1:02.03] b\n[x] c\n[d",
    "@Title=x\n@Ruby1=a,b\n @z = 1\nq", "　a　\n﻿b\n　", "a𝒳b\n𝒳\n𝒳𝒳𝒳", "a\u0085b\u0085\nc\u0085", "a \nb ", "\x0b a \x0c\n\x1c\nb", "a\xa0\n\xa0b\xa0",
    "]\n]]\n[|]\n||\n[[", "1\n2|3\n[1|00:00:00]a\n0]", "é é\n\U0001f468‍\U0001f469", "abcd\nabcde\nabcdef\nab", "】a\n【b\nc】d【e】", "a\n@x=\n[offset:1]\n",
    "\n".join(f"l{i}" for i in range(19_000)), "y" * 3000 + "\nabc",
]
ROWS = [(k, text, "en", "src0") for k, text in enumerate(TEXTS)] + [
    (900, "one\ntwo", "en", "src1"), (900, "other\nthree\nfour\nfive", "de", "src2"), (900, "one\ntwo", "en", "src1"), (-1005, "ids\nbelow\nnought", "en", "src1"),
    (901, "a\nb", None, "src1"), (902, "a\nb\nc\nd", "en", None), (903, "a\nb", "en", "s】[1:02.03]【r"), (904, "a\nb", "en", "s\nt"),
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    ids, texts, langs, sources = zip(*ROWS)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["parse_nicokara", "parse_inline_timed"])
def test_odd_documents_equal_the_statement(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet')")
    assert compare(entry.queries()[name](spark, odd), con, entry.oracle_sql()[name]) is None
