"""What one task sorts must not grow with the input divided by the cores: letters and words are dealt to all partitions of the session."""

import re

import __spark_entry__ as entry
import pytest
from verseline.operators import ordered
from verseline.operators import walks as wk

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["singer_runs", "warp_times", "attach_word_durations", "drop_by_class", "max_pyramid"])
def test_rows_of_wide_queries_are_dealt(spark, name):
    assert re.search(r"hashpartitioning\(.*\), REPARTITION_BY_NUM", planned(entry.queries()[name](spark, SF)))


def test_a_scan_sorts_its_rows_once(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id as t", "id as x")
    got = ordered.scan(rows, by=["k"], order=["t"], block=rows["t"] % 7, s=ordered.running_sum(rows["x"]))
    # the rows, the summary of blocks, and the summary again for the join
    assert len(re.findall(r"\bSort \[", planned(got))) == 3


def test_levels_of_a_pyramid_are_shuffled_once(spark):
    from verseline.operators import signal as sg

    frames = spark.createDataFrame([(1, k, float(k % 5)) for k in range(-3, 37)], "track_id int, frame_no long, value double")
    got = sg.max_pyramid(frames, levels=4)
    assert planned(got).count("Exchange") == 1
    want = {}
    for k in range(-3, 37):
        for level in range(1, 5):
            key = 1, level, k // 2**level
            want[key] = max(want.get(key, 0.0), float(k % 5))
    assert {tuple(r)[:3]: r[3] for r in got.collect()} == want


def test_next_cuts_read_the_bars_a_few_times(spark):
    bars = spark.createDataFrame([(1, 500 * k, 0.5, 1.0, 500) for k in range(40)], "track_id int, t long, energy double, pace double, bar_ms long")
    forced, takes = bars.where("t = 3000").select("track_id", "t"), bars.where("t = 8000").selectExpr("track_id", "t as t0", "t + 4250 as t1")
    ends = bars.groupBy("track_id").agg({"t": "max"}).toDF("track_id", "end")
    got = wk._successors(bars.select("track_id", "t"), bars, forced, takes, ends, ["track_id"], 2, 800, 6000, 60_000)
    assert planned(got).count("Scan ExistingRDD") <= 8
