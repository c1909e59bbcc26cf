"""Layout and note rules that no query over the driver's tables covers, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import layout, marks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_report_marks(spark):
    said = ["head", "bar 3 (page 1, system 1):", "    too long", "    staff 2 is empty", "note", "    not a mark", "bar 4 (page 1, system 2):", "bar 3 (page 9):", "    later"]
    lines = spark.createDataFrame([("r", k, t) for k, t in enumerate(said)] + [("r", 20, None), ("r", 21, "    lost")], "file string, n int, text string")
    assert rows(layout.report_marks(lines, ["file"], "n", "text")) == [("r", 3, ["later"]), ("r", 4, [])]
    assert rows(layout.report_marks(lines.where("n < 7"), ["file"], "n", "text")) == [("r", 3, ["too long", "staff 2 is empty"]), ("r", 4, [])]
    assert rows(layout.report_marks(lines.where("false"), ["file"], "n", "text")) == []


def test_page_images(spark):
    files = spark.createDataFrame([(p,) for p in ("a_p10.png", "a_p2.png", "a_p2.jpg", "cover.png", None)], "path string")
    assert [tuple(r) for r in layout.page_images(files).orderBy("page").collect()] == [("a_p2.png", 2), ("a_p10.png", 10)]


def test_listing_and_counts(spark):
    bars = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 3), (None, 1, 4)], "page int, system int, bar int")
    assert rows(layout.listing(bars, ["page", "system"], "bar")) == sorted([(1, 1, 1, 2, 2), (1, 2, 3, 3, 1), (None, 1, 4, 4, 1)], key=repr)
    notes = spark.createDataFrame([(1, True), (1, False), (2, True)], "bar int, rest boolean")
    assert rows(marks.pitched_counts(notes, ["bar"], F.col("rest"))) == [(1, 1), (2, 0)]


def test_double_bars_and_endings(spark):
    lines = spark.createDataFrame([(1, None, "light-heavy"), (2, "left", "light-light"), (3, "right", "regular"), (4, "right", None), (5, "right", "light-light"), (5, None, "light-light")], "bar int, location string, style string")
    assert rows(marks.double_bars(lines, ["bar"], "location", "style")) == [(1,), (5,)]
    ends = spark.createDataFrame([("1.",), ("",), ("slur",), (None,), ("1, 2",)], "text string")
    assert rows(marks.real_endings(ends, "text")) == [("1, 2",), ("1.",)]


def test_spaced_takes_the_best_first(spark):
    own = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 5.0, 2.0), (1, 5.5, 2.0), (1, 8.1, 1.5), (2, 0.0, 1.0)], "k int, y double, s double")
    # 2 first; 5 and 0 are within 3 of it; 5.5 is not; 8.1 is within 3 of 5.5
    assert rows(marks.spaced(own, "k", "y", "s", 3.0)) == [(1, 2.0, 3.0), (1, 5.5, 2.0), (2, 0.0, 1.0)]
    assert rows(marks.spaced(own.where("false"), "k", "y", "s", 3.0)) == []


def _parts(spark, bars):
    return spark.createDataFrame([("s", p, o, b, n, st) for p, o, st, own in bars for b, n in own.items()], "score string, part string, ord int, bar int, notes int, staves int")


@pytest.mark.parametrize(
    "third, expected, to",
    [
        ({1: 0, 2: 0, 3: 4}, 2, {"a": "a", "b": "b", "c": "a"}),  # both are free in bar 3, a has more notes
        ({1: 1, 2: 0, 3: 4}, 2, {"a": "a", "b": "b", "c": "b"}),  # a plays in bar 1
        ({1: 1, 2: 1, 3: 1}, 2, {"a": "a", "b": "b", "c": "c"}),  # nobody is free in all its bars
        ({1: 0, 2: 0, 3: 4}, 3, {"a": "a", "b": "b", "c": "c"}),
    ],
)
def test_regrouped(spark, third, expected, to):
    bars = _parts(spark, [("a", 0, 1, {1: 9, 2: 0, 3: 0}), ("b", 1, 1, {1: 0, 2: 8, 3: 0}), ("c", 2, 1, third)])
    assert {r.part: r.target for r in marks.regrouped(bars, "score", "part", "ord", "bar", "notes", "staves", expected).collect()} == to


def test_regrouped_goes_on(spark):
    """A fragment that took another one goes on with it; parts of other staves are never a target."""
    bars = _parts(spark, [("a", 0, 1, {1: 9, 2: 0, 3: 0}), ("b", 1, 1, {1: 0, 2: 2, 3: 0}), ("c", 2, 1, {1: 0, 2: 0, 3: 1}), ("d", 3, 2, {1: 0, 2: 0, 3: 50})])
    assert {r.part: r.target for r in marks.regrouped(bars, "score", "part", "ord", "bar", "notes", "staves", 2).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_fingerprints(spark):
    notes = spark.createDataFrame([(1, 0, "C", None), (1, 1, "D", "1"), (2, 5, "C", None), (2, 6, "D", "1"), (3, 0, "C", ""), (3, 1, "D", "1")], "bar int, k int, step string, alter string")
    found = {r.bar: r.digest for r in marks.fingerprints(notes, ["bar"], "k", ["step", "alter"]).collect()}
    assert found[1] == found[2] != found[3]


def test_runs_with_null_measures_and_repeats(spark):
    own = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 1, 1.0), (4, 2, 1.0), (5, None, 1.0), (6, None, 2.0)], "k int, m int, b double").withColumn("key", F.lit(1))
    got = layout.run_bounds(own, ["key"], ["k"], "m", "b", 4.0).orderBy("k").select("run", "first", "last", "position").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 1.0), (1, 1, 2, 2.0), (2, 3, 3, 5.0), (3, 4, 4, 9.0), (4, 5, 6, 13.0), (4, 5, 6, 14.0)]


def test_signs_of_null_kind_and_piece_stay(spark):
    signs = spark.createDataFrame([(None, 1, "staccatissimo"), (None, 1, "staccato"), (None, 2, None), (2, 1, "staccatissimo")], "piece int, note int, kind string")
    assert rows(marks.dots_for_wedges(signs, ["piece"], "kind")) == sorted([(None, 1, "staccato"), (None, 2, None), (2, 1, "staccatissimo")], key=repr)
    own = spark.createDataFrame([("turn", None), ("turn", 0.2), ("accent", 0.2), (None, 0.1)], "kind string, sure double")
    assert rows(marks.kept_signs(own, "kind", "sure", 0.5)) == sorted([("turn", None), ("accent", 0.2), (None, 0.1)], key=repr)
    assert rows(marks.kept_signs(own, "kind", "sure")) == sorted([("accent", 0.2), (None, 0.1)], key=repr)
