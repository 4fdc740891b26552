"""Coloured runs of pages of random tags against a stack, and what their plan shuffles."""

import random

from verseline.sources import singer_runs as sr

PIECES = ["<span style='color:#F00'>", "<font color=#00ff00>", "<span>", "<font>", "</span>", "</font>", "<font color='#abcdef'/>", "<br>", "</p>", "<b>", "a", "&lt;", "<", " x "]


def by_stack(pieces):
    """(line, key, text) of every text; a close takes the last open tag, whatever its name."""
    line, stack = 1, []
    for p in pieces:
        if p in PIECES[:4]:
            stack.append({0: "#ff0000", 1: "#00ff00"}.get(PIECES.index(p)))
        elif p in PIECES[4:6]:
            del stack[-1:]
        elif p in PIECES[7:9]:
            line += 1
        elif not p.startswith("<"):
            yield line, next((c for c in reversed(stack) if c), "none"), p.replace("&lt;", "<")


def pages(spark):
    rng = random.Random(7)
    made = [(k, [p for p in rng.choices(PIECES[:12] + PIECES[13:], k=rng.randint(0, 40))]) for k in range(60)]
    made.append((99, ["</span>", "x"] + [PIECES[0], "x", PIECES[2], "</font>"] * 1500 + ["x"] + ["</span>", "x", "<br>"] * 1600))  # tags of several blocks
    # texts that touch are one text
    made = [(k, [p for i, p in enumerate(own) if not (i and not p.startswith("<") and not own[i - 1].startswith("<"))]) for k, own in made]
    return made, spark.createDataFrame([(k, "html", "".join(own)) for k, own in made], "file_id int, ext string, content string")


def test_pages_of_random_tags(spark):
    made, df = pages(spark)
    rows = sorted((r.file_id, r.run_no, r.line_no, r.singer_key, r.text) for r in sr.singer_runs(df).collect())
    assert [(k, *rest) for k, _, *rest in rows] == [(k, *row) for k, own in made for row in by_stack(own)]


def test_a_text_is_shuffled_once(spark):
    _, df = pages(spark)
    plan = sr.html_runs(df.select("file_id", "content"))._jdf.queryExecution().executedPlan().toString()
    # the pages are cut for the rows and for the block summaries of the last scan alone
    assert plan.count("posexplode(") <= 2
