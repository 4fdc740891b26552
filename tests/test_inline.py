"""Letters of the checkpoint notation, read in slices of any size."""

import re

import pyarrow as pa
from verseline.sources import dialects, inline

TEXTS = [
    "x[1|00:01:05]ab][[10|00:02:00]c[2|00:03:00]", "", None, "\n\n[1|1:02:03]é\r\n[20|0:00:01]\r[0|9:59:59][日本\n", "[1|00:0", "5:00]x", "[|00:01:02]a[1|:01:02]b[1|00:1:02]c[1x|00:01:02]",
    "[00|00:00:10]𝒳[000012|12345:00:00]\x00b[2147483647|0:00:00]c[2147483648|0:00:00]d[21474836480|0:00:00]e[99999999999999999999|0:00:00]f", "[1|00:01:00][1|00:02:00][[3|00:03:00]z" * 30,
]


def by_pattern(text):
    """The rows of a text by the pattern that states the notation."""
    stamp = r"\[([0-9]+)\|([0-9]+):([0-9]{2}):([0-9]{2})\]"
    for line_no, line in enumerate(re.split(r"\r\n?|\n", text), 1):
        char_no = 0
        for m in re.finditer(rf"(?:{stamp})?[^\[]+|{stamp}|\[", line):
            n, a, s, c = [x or y for x, y in zip(m.groups()[:4], m.groups()[4:])]
            for k, ch in enumerate(m[0][m[0].index("]") + 1 if n else 0 :] or [""]):
                char_no += 1
                if not n or k:
                    yield line_no, char_no, ch, 0, False, None
                    continue
                ended = len(n) > 1 and n.endswith("0")
                count = int(n[:-1] if ended else n)
                yield line_no, char_no, ch, count if count < 1 << 31 else None, ended, int(a) * 60_000 + int(s) * 1000 + int(c) * 10


def test_letters_of_any_slice(monkeypatch):
    want = [(k, *row) for k, text in enumerate(TEXTS) if text is not None for row in by_pattern(text)]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["id", "content"])
    for size in (1, 7, 60, 1 << 20):
        monkeypatch.setattr(inline, "SLICE", size)
        got = [row for out in inline.read_letters("content", ["id"])(iter([part])) for row in zip(*[c.to_pylist() for c in out.columns])]
        assert got == want, size


def test_no_expression_looks_at_a_letter(spark):
    plan = dialects.parse_inline_timed(spark.createDataFrame([(1, "[1|00:00:01]a")], "file_id long, content string"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Generate" not in plan
