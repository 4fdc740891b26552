"""Plans that must hold at any size: what an ``explode`` has multiplied is shuffled, never sent whole through the driver."""

import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def joins_on(spark, name, key):
    """The join operators that meet on a column, as planned before anything runs."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    return [x for x in re.findall(r"(\w+Join) \[([^\]]*)\]", plan) if re.search(rf"\b{key}#", x[1])]


def test_band_keys_of_pictures_are_shuffled(spark):
    for name in ("dedupe_near", "near_duplicate_clips"):
        met = joins_on(spark, name, "key")
        assert met and all(kind == "SortMergeJoin" for kind, _ in met)


def test_interval_buckets_are_shuffled(spark):
    met = joins_on(spark, "resolve_coverage", "__bucket")
    assert met and all(kind == "SortMergeJoin" for kind, _ in met)


def test_heard_words_are_shuffled(spark):
    met = joins_on(spark, "word_offset", "cell"), joins_on(spark, "word_offset", "__salt")
    assert all(met) and {kind for kind, _ in [*met[0], *met[1]]} == {"SortMergeJoin"}


def test_keys_of_lines_are_not_copied_for_salts(spark):
    for name in ("repeat_runs", "majority_source", "chorus_kinds"):
        assert not joins_on(spark, name, "__salt") and joins_on(spark, name, "key")


def test_candidates_of_one_file_are_scored_in_several_tasks(spark):
    for name in ("rank_candidates", "page_results", "best_match_field"):
        assert "REPARTITION_BY_NUM" in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def pieces_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_line_do_not_read_the_line_again(spark):
    from verseline.sources import dialects

    files = spark.createDataFrame([(1, "[100,500]<0,200,0>a<250,200,0>b>c\n[9,1](10,20,0)x")], "file_id long, content string")
    out = dialects.parse_duration_words(files)
    assert [tuple(r)[2:] for r in out.orderBy("line_no", "word_no").collect()] == [(100, 500, 1, "a", 100, 200), (100, 500, 2, "b>c", 350, 200), (9, 1, 1, "x", 10, 20)]
    kept = re.findall(r"Generate posexplode\(__words#\d+\), \[([^\]]*)\]", pieces_plan(out))
    assert kept and all("raw#" not in k for k in kept)


def test_timed_pieces_are_matched_once(spark):
    from verseline.sources import dialects

    files = spark.createDataFrame([(1, "[00:01.50]a[00:02.250] b [00:03.00]")], "file_id long, content string")
    out = dialects.parse_word_lrc(files)
    assert [tuple(r)[2:] for r in out.orderBy("word_no").collect()] == [(1, "a", 0, 0, 1500, 3000), (2, "b", 2, 2, 2250, 3000)]
    files = spark.createDataFrame([(1, "[00:01.00]<00:01.50>a<00:02:25> b <00:03.00>")], "file_id long, content string")
    other = dialects.parse_enhanced_lrc(files)
    assert [tuple(r)[2:] for r in other.orderBy("word_no").collect()] == [(1, "a", 0, 0, 1500, 3000), (2, "b", 2, 2, 2250, 3000)]
    for df in (out, other):
        assert "regexp_extract(" not in pieces_plan(df)


def test_clock_stamps_of_any_size(spark):
    from pyspark.sql import functions as F

    from verseline.functions import timetext as tt

    df = spark.createDataFrame([(0,), (65432,), (7_265_432,), (-70_010,)], "ms long")
    got = df.select(tt.lrc_clock(F.col("ms")), tt.lrc_clock(F.col("ms"), "ms"), tt.inline_clock(F.col("ms"))).collect()
    assert [tuple(r) for r in got[:3]] == [("00:00.00", "00:00.000", "00:00:00"), ("01:05.43", "01:05.432", "01:05:43"), ("121:05.43", "121:05.432", "121:05:43")]
    assert tuple(got[3]) == ("00:00.00", "00:00.000", "-2:49:99")


def test_stamped_letters_are_matched_once(spark):
    from verseline.sources import dialects

    files = spark.createDataFrame([(1, "x[1|00:01:05]ab][[10|00:02:00]c[2|00:03:00]")], "file_id long, content string")
    out = dialects.parse_inline_timed(files)
    assert [tuple(r)[2:] for r in out.orderBy("char_no").collect()] == [
        (1, "x", 0, False, None), (2, "a", 1, False, 1050), (3, "b", 0, False, None), (4, "]", 0, False, None), (5, "[", 0, False, None),
        (6, "c", 1, True, 2000), (7, "", 2, False, 3000),
    ]
    assert "regexp_extract(" not in pieces_plan(out) and "regexp_replace(lambda" not in pieces_plan(out)


def test_pairs_of_a_dictionary_are_not_cut_again_by_the_filter(spark):
    from verseline.sources import dialects

    files = spark.createDataFrame([(1, " a \tA\n\tB\nc\t　"), (2, "[w]\nx = y=z\n;n=m"), (3, "k\nv\nl\n")], "file_id long, content string")
    out = dialects.parse_dictionary(files)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "a", "A"), (2, 2, "x", "y=z"), (3, 1, "k", "v")]
    kept = [x for x in pieces_plan(out).splitlines() if "Filter" in x]
    assert kept and all("regexp_replace" not in x and "split(" not in x for x in kept)


def test_karaoke_windows_shuffle_no_tags(spark):
    from verseline.sources import dialects

    text = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:05.00,D,a,0,0,0,,{\\k20}x{\\sing_b\\k30}{\\k10}y"
    out = dialects.parse_ass_karaoke(spark.createDataFrame([(1, text)], "file_id long, content string"))
    got = [(r.text, r.start_ms, r.dur_ms, r.is_pause, r.singer_id) for r in out.orderBy("seg_no").collect()]
    assert got == [("x", 1000, 200, False, "a"), ("", 1200, 300, True, "b"), ("y", 1500, 100, False, "b")]
    below = pieces_plan(dialects.parse_ass_karaoke(spark.createDataFrame([(1, text)], "file_id long, content string"))).split("Exchange", 1)[1].splitlines()[1]
    assert "__mark" in below and "tags" not in below and " __name#" not in below


def test_letters_of_two_versions_are_not_shuffled_one_by_one(spark):
    for name in ("transfer_spans", "transfer_singers"):
        exchanged = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]
        assert "Generate posexplode(__u" not in exchanged and "unit" not in exchanged
