"""Alignment, judgement, peaks, evidence, streaming and geometry."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import align, evidence, geometry, judge, peaks
from cadenza.sources import audio
from cadenza.streaming import onset_state


def test_alignment_of_equal_sequences():
    assert align.align(np.eye(6))[0] == [(k, k) for k in range(6)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=7), st.lists(st.integers(0, 3), max_size=7))
def test_alignment_is_best_and_ordered(a, b):
    """Against all order-preserving pairings."""
    p = np.array([[float(x == y) for y in b] for x in a]).reshape(len(a), len(b))
    pairs, score = align.align(p)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))

    def value(ps):
        total = 0.0
        for n, (i, j) in enumerate(ps):
            total += 2 * p[i, j] - 0.8
            if n:
                total -= 0.5 * (i - ps[n - 1][0] - 1 + j - ps[n - 1][1] - 1)
        if ps:  # only one side's skips are free at either end
            total -= 0.5 * (min(ps[0]) + min(len(a) - 1 - ps[-1][0], len(b) - 1 - ps[-1][1]))
        return total

    best = 0.0

    def extend(ps, i, j):
        nonlocal best
        best = max(best, value(ps))
        for x in range(i, len(a)):
            for y in range(j, len(b)):
                extend([*ps, (x, y)], x + 1, y + 1)

    if len(a) * len(b) <= 20:
        extend([], 0, 0)
        assert score == pytest.approx(best)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.booleans(), st.randoms(use_true_random=False))
def test_alignment_of_all_observed(n, k, anchored, rng):
    """Against all ways through the matrix that end behind the last observed row."""
    p = np.array([[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(k)] for _ in range(n)]).reshape(n, k)
    ways = []

    def walk(i, j, total, pairs):
        if j == k:
            ways.append((total, pairs))
        if i < n and j < k:
            walk(i + 1, j + 1, total + 2 * p[i, j] - 0.8, [*pairs, (i, j)])
        if i < n:
            walk(i + 1, j, total - 0.5, pairs)
        if j < k:
            walk(i, j + 1, total - 0.5, pairs)

    for j in range(k + 1):  # observed rows before the first expected one are free
        walk(0, j, 0.0, [])
    for i in range(n + 1):
        walk(i, 0, -(0.5 if anchored else 0.1) * i, [])
    pairs, score = align.align_suffix(p, anchored)
    assert score == pytest.approx(max(total for total, _ in ways), abs=1e-6)
    assert any(pairs == own and total == pytest.approx(score, abs=1e-6) for total, own in ways)


def test_play_order():
    bars = [{}, {"segno": True}, {"tocoda": True}, {"fine": True}, {"dalsegno": True}, {"coda": True}, {}]
    assert align.play_order(bars) == [0, 1, 2, 3, 4, 1, 2, 5, 6]
    assert align.play_order([{}, {"fine": True}, {"dacapo": True}]) == [0, 1, 2, 0, 1]
    assert align.play_order([{}, {}]) == [0, 1] and align.play_order([]) == []
    # without a segno there is no way back; of two jumps in one bar dal segno counts; to-coda comes before fine
    assert align.play_order([{}, {"dalsegno": True}, {}]) == [0, 1, 2]
    assert align.play_order([{}, {"segno": True}, {"dacapo": True, "dalsegno": True}]) == [0, 1, 2, 1, 2]
    assert align.play_order([{"tocoda": True, "fine": True}, {"dacapo": True}, {"coda": True}]) == [0, 1, 0, 2]
    assert align.play_order([{"tocoda": True, "fine": True}, {"dacapo": True}]) == [0, 1, 0]
    assert len(align.play_order([{"coda": True}, {"tocoda": True}, {"dacapo": True}])) == 10_000


def test_played(spark):
    bars = spark.createDataFrame([("a", 0, ["segno"]), ("a", 1, ["dalsegno"]), ("a", 2, None), ("b", 0, [])], "score_id string, measure_idx int, flags array<string>")
    onsets = spark.createDataFrame([("a", k, 0.0, [60 + k]) for k in (0, 1, 2)] + [("b", 0, 0.0, [70]), ("c", 0, 0.0, [71])], "score_id string, measure_idx int, quarter double, notes array<int>")
    got = sorted((r.score_id, r.play_pos, r.notes[0]) for r in align.played(onsets, bars).collect())
    assert got == [("a", 0, 60), ("a", 1, 61), ("a", 2, 60), ("a", 3, 61), ("a", 4, 62), ("b", 0, 70)]


def _spectra(**harmonics):
    """Evidence whose notes have given (prominence, peak, rise); others are silent."""
    e = evidence.Evidence(np.zeros(40_000, np.float32), 0.5)
    e.late = None
    for m in range(20, 110):
        e.notes[m] = (np.full(5, -5.0), np.zeros(5), np.zeros(5))
    for name, (prom, peak, rise) in harmonics.items():
        e.notes[int(name[1:])] = (np.array(prom, float), np.array(peak, float), np.array(rise, float))
    return e


def test_evidence_rules(spark):
    """By hand, for each rule, and the same rules as columns."""
    cases = {
        # prominence, rise -> presence, present, fresh
        ((20, 20, 20, 20, 0), (6, 0, 0, 0, 0)): (1.0, True, True),
        ((20, 20, 0, 0, 20), (5.9, 9, 9, 9, 9)): (2 / 3, True, False),
        ((0, 20, 20, 0, 0), (0, 6, 7, 0, 0)): (2 / 3, True, True),
        ((0, 20, 0, 20, 0), (9, 6, 5, 9, 0)): (1 / 3, False, False),
        ((12, 12, 20, 12, 0), (0, 9, 9, 0, 0)): (1 / 3, False, True),
        ((0, 0, 0, 0, 20), (9, 9, 9, 9, 9)): (0.0, False, True),
    }
    for (prom, rise), want in cases.items():
        e = _spectra(m60=(prom, (1,) * 5, rise))
        assert (pytest.approx(e.presence(60)), e.present(60), e.fresh(60)) == want
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, [float(x) for x in p], [float(x) for x in r]) for k, (p, r) in enumerate(cases)], "k int, prom array<double>, rise array<double>")
    got = df.select("k", judge.presence(F.col("prom")).alias("p"), judge.present(F.col("prom")).alias("is"), judge.fresh(F.col("prom"), F.col("rise")).alias("new")).orderBy("k").collect()
    assert [(pytest.approx(r.p), r["is"], r.new) for r in got] == list(cases.values())


def test_detection_rules():
    loud, up = (20,) * 5, (9,) * 5

    def heard(**notes):
        return _spectra(**{k: (prom, (peak, peak, peak, peak, peak), rise) for k, (prom, peak, rise) in notes.items()}).detected

    assert heard(m60=(loud, 1, up), m64=(loud, 0.9, up)) == [60, 64]
    assert heard(m60=(loud, 1, up), m64=((13, 13, 13, 13, 13), 0.9, up)) == [60]  # nothing is clear
    assert heard(m60=(loud, 1, up), m64=((20, 20, 0, 0, 20), 0.9, up)) == [60]  # two of four
    assert heard(m60=(loud, 1, up), m64=(loud, 0.9, (0,) * 5)) == [60]  # rings
    assert heard(m60=(loud, 1, up), m72=(loud, 0.9, up)) == [60] and heard(m60=(loud, 0.9, up), m72=(loud, 1, up)) == [60, 72]
    assert heard(m60=(loud, 1, up), m62=(loud, 0.4, up)) == [60] and heard(m60=(loud, 1, up), m62=(loud, 0.6, up)) == [60, 62]
    assert heard(m60=(loud, 0.4, up), m61=(loud, 1, up)) == [61]  # the skirt of a stronger note above
    assert heard(m60=(loud, 1, up), m65=(loud, 0.2, up)) == [60]  # a quarter of the loudest
    # what is explained explains nothing itself: 79 goes by 60, so its neighbour 81 stays
    assert heard(m60=(loud, 1, up), m79=(loud, 0.9, up), m81=(loud, 0.4, up)) == [60, 81]
    ringing = _spectra(m60=((20,) * 5, (1.0,) * 5, up))
    ringing.early, ringing.late = np.full(evidence.SIZE // 2 + 1, 1.0), np.full(evidence.SIZE // 2 + 1, 1.3)
    assert ringing.detected == []  # grows


def test_presence_offline_and_live():
    e = _spectra(m60=((20,) * 5, (1.0,) * 5, (9,) * 5), m64=((20,) * 5, (1.0,) * 5, (0,) * 5), m67=((20,) * 5, (1.0,) * 5, (9,) * 5))
    assert evidence.chord_presence(e, [60, 64]) == pytest.approx(2 / 3)  # 67 is extra
    assert evidence.chord_presence(e, [60, 64], live=True) == pytest.approx(1.4 / 3)


def test_neighbours_bleed(spark):
    rows = [("t", 0, [60], [60]), ("t", 1, [62], [62, 60, 64, 70]), ("t", 2, [64], [64])]
    df = spark.createDataFrame(rows, "take string, i int, expected array<int>, heard array<int>").withColumn("near", judge.neighbours(["take"], ["i"], "expected"))
    got = {r.i: (r.extra, r.status) for r in judge.judged(df, "i", "expected", "heard", "near").collect()}
    assert got == {0: ("", "ok"), 1: ("70", "bad"), 2: ("", "ok")}


def test_substitutions():
    assert judge.substitutions([60, 64], [65, 50]) == ([(65, 64), (50, 60)], [], [])
    assert judge.substitutions([60], [61, 62]) == ([(61, 60)], [], [62])
    assert judge.substitutions([60, 62], [61]) == ([(61, 60)], [62], [])


def test_injected_mistakes_are_found():
    """Synthetic audio with known mistakes: onsets, evidence, alignment and judgement together."""
    scale = [[60, 64], [62, 65], [64, 67], [65, 69], [67, 71], [69, 72], [71, 74], [72, 76]]
    x = audio.synthetic(scale, {5: (72, 73), 2: (67, None)})
    times = [t for t, _ in peaks.onsets(x, audio.RATE)]
    assert times == pytest.approx([1 + 0.6 * k for k in range(8)], abs=0.07)
    pairs, _ = align.align(evidence.presence_matrix(x, times, scale))
    assert [i for i, _ in pairs] == list(range(8))
    heard = {i: evidence.Evidence(x, times[j], times[j + 1] if j + 1 < len(times) else None) for i, j in pairs}
    missing = {i: [m for m in scale[i] if not (e.present(m) and e.fresh(m))] for i, e in heard.items()}
    assert {i: m for i, m in missing.items() if m} == {2: [67], 5: [72]}
    assert 73 in heard[5].extras(scale[5])


def test_resampling():
    x = audio.normalised(np.sin(np.arange(44100) / 50) * 0.2 + 0.1, 44100)
    assert len(x) == 22050 and abs(np.abs(x).max() - 1) < 1e-6 and abs(x.mean()) < 0.05
    assert len(audio.normalised(np.zeros(0), 44100)) == 0


def test_gate():
    gate = onset_state.OnsetGate()
    out = []
    for t, s in [(1.0, 5.0), (1.15, 2.0), (2.0, 1.0), (2.05, 3.0), (7.0, 1.0)]:
        out += gate.push(t, s)
    out += gate.flush()
    # an echo goes, a double strike counts once and later, a silence ends the phrase
    assert out == [(1.0, 5.0, False), (2.05, 3.0, True), (7.0, 1.0, True)]


def test_released_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"take{k}", round(sum(rng.choice([0.05, 0.1, 0.3, 1.0, 4.0]) for _ in range(n)) + n * 0.01, 3), float(rng.randint(1, 5))) for k in range(4) for n in range(30)]
    df = spark.createDataFrame(rows, "take string, t double, strength double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = onset_state.released(df).collect()
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = onset_state.released(source).writeStream.format("memory").queryName("gated").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(60):  # timeouts keep such a query busy: it is stopped once the one batch is through
        if query.lastProgress and any(p["numInputRows"] for p in query.recentProgress):
            break
        time.sleep(1)
    query.stop()
    streamed = {(r.take, r.t, r.strength) for r in spark.table("gated").collect()}
    own = {(r.take, r.t, r.strength) for r in batch}
    last = {max(x for x in own if x[0] == take) for take in {x[0] for x in own}}
    # what is still pending when the input ends waits for the silence
    assert own - last <= streamed <= own


def test_follower():
    chords = [(k // 4, frozenset({60 + k % 12})) for k in range(24)]
    follower = onset_state.Follower(chords)
    for k, (_, notes) in enumerate(chords):
        if k != 9:
            follower.push(float(k), {n + 12 for n in notes})
    follower.push(30.0, set(), final=True)
    status = {i: s for i, s, _ in follower.committed}
    assert follower.shift == 12 and status[9] == "skipped"
    assert all(status[i] == "ok" for i in range(24) if i != 9)


def test_follower_commits_measures():
    """A measure is committed when two matches lie beyond it; the last only at the end."""
    chords = [(k // 4, frozenset({60 + k})) for k in range(12)]
    follower = onset_state.Follower(chords)
    out = [follower.push(float(k), set(notes)) for k, (_, notes) in enumerate(chords)]
    # ten matches are needed for the first commit, which brings all complete measures
    assert [len(o) for o in out] == [0] * 9 + [8, 0, 0]
    assert follower.low == 8 and follower.times == [8.0, 9.0, 10.0, 11.0]
    assert follower.push(20.0, set(), final=True) == [(k, "ok", float(k)) for k in range(8, 12)] and follower.heard == []
    assert follower.push(21.0, {60}) == [] and follower.heard == []  # nothing is left to follow
    # from the middle: the whole measure of the first match is judged
    late = onset_state.Follower([(k // 4, frozenset({40 + k})) for k in range(24)])
    got = [r for k in range(6, 24) for r in late.push(float(k), {40 + k})]
    assert got[:3] == [(4, "skipped", None), (5, "skipped", None), (6, "ok", 6.0)]
    # beats that fall tell two measures of one number apart
    twice = onset_state.Follower([(1, frozenset({60})), (1, frozenset({62})), (1, frozenset({64}))], [0.0, 1.0, 0.0])
    assert twice.begin.tolist() == [0, 0, 2] and twice.end.tolist() == [2, 2, 3]


def test_sampler_carries_its_tail():
    x = np.arange(10_000, dtype=np.float32)
    whole, parts = onset_state.Sampler().feed(x), onset_state.Sampler()
    cut = np.concatenate([parts.feed(p) for p in np.split(x, [100, 3000, 3001, 9000])])
    assert (whole == cut).all() and len(whole) == 16


def test_components_of_a_page():
    ink = np.zeros((40, 60), bool)
    ink[2:5, 3:9] = True
    ink[5, 9] = True  # touches by a corner
    ink[20:30, 30] = ink[20, 30:40] = ink[20:30, 39] = True  # an arch: one part
    assert geometry.components(ink) == [(3, 2, 7, 4, 19), (30, 20, 10, 10, 28)]


def test_staves():
    page = np.zeros((200, 300), bool)
    for top in (20, 120):
        for k in range(5):
            page[top + 10 * k, 10:290] = True
    got = geometry.staves(page)
    assert [(a, b, r[0], r[1], u) for a, b, *r, u in got] == [(20, 60, 10, 289, 10.0), (120, 160, 10, 289, 10.0)]
    assert geometry.line_distance(page) == 10
    gray = np.where(page, 0, 255)
    assert abs(geometry.skew(gray)) < 0.1


def test_bar_of_point(spark):
    points = spark.createDataFrame([(1, 1, 50.0, 12.0), (1, 2, 150.0, 200.0), (1, 3, 100.0, 45.0)], "sheet int, id int, x double, y double")
    stacks = spark.createDataFrame([(1, 0, 0.0, 100.0), (1, 1, 100.0, 180.0)], "sheet int, stack int, left double, right double")
    rows = spark.createDataFrame([(1, s, 0, k, 10.0 + 40 * k, 30.0 + 40 * k, 5.0) for s in (0, 1) for k in (0, 1)], "sheet int, stack int, part int, staff int, top double, bottom double, u double")
    got = {r.id: (r.stack, r.staff) for r in geometry.bar_of_point(points, stacks, rows).collect()}
    assert got == {1: (0, 0), 3: (0, 1)}


def test_slots_twins_and_crowds(spark):
    points = spark.createDataFrame([(0, 1, 15.0), (0, 2, 25.0)], "stack int, id int, x double")
    slots = spark.createDataFrame([(0, 10.0, 0), (0, 20.0, 1), (0, 30.0, 2)], "stack int, x double, slot int")
    assert {r.id: r.slot for r in geometry.slot_of(points, slots).collect()} == {1: 0, 2: 1}
    lines = spark.createDataFrame([(0, 1, 0.0, 10.0, 5.0), (0, 2, 2.0, 9.0, 8.0), (0, 3, 50.0, 60.0, 8.0)], "page int, id int, x0 double, x1 double, cy double")
    assert sorted(r.id for r in geometry.twins(lines, 5.0).collect()) == [1, 2]
    glyphs = spark.createDataFrame([(0, 0, 0, 5, 5), (0, 7, 1, 5, 5), (0, 100, 0, 5, 5)], "page int, x int, y int, w int, h int")
    assert [r.x for r in geometry.uncrowded(glyphs, glyphs, 4).collect()] == [100]


def test_refractory(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.5, 2.0), ("a", 9.0, 1.0), ("b", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, s double")
    got = sorted(tuple(r) for r in peaks.refractory(df, ["k"], "t", "s", 2.0).collect())
    assert got == [("a", 1.0, 3.0), ("a", 9.0, 1.0), ("b", 0.5, 1.0)]


def test_speeds(spark):
    from cadenza.functions import scalars
    from cadenza.operators import tempo

    rows = [("a", 1 + k // 4, 0.5, 1.0) for k in range(8)] + [("a", 3, 3.0, 1.0), ("a", 4, 1.5, 1.0), ("b", 1, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "take string, measure int, dt double, dq double")
    assert [(r.measure, r.dt) for r in tempo.paused(df, "take", "dt", "dq").where("pause").orderBy("measure").collect()] == [(3, 3.0), (4, 1.5)]
    assert [(r.take, r.ratio, r.bpm, r.pauses) for r in tempo.tempo_summary(df, "take", "dt", "dq").collect()] == [("a", 0.5, 120, 2)]
    assert sorted((r.take, r.measure, r.s) for r in tempo.measure_speeds(df, "take", "measure", "dt", "dq", 4.0).collect()) == [("a", 1, 0.5), ("a", 2, 0.5)]
    points = spark.createDataFrame([("a", float(t), 9.0 * t) for t in range(4)], "k string, t double, q double")
    assert [(r.slope, r.intercept) for r in tempo.theil_sen(points, "k", "t", "q", 0.05, (0.5, 5.0)).collect()] == [(5.0, 6.0)]
    clefs = spark.createDataFrame([("G", None), ("F", 0), ("C", 1), ("percussion", 0)], "sign string, up int")
    assert [r[0] for r in clefs.select(scalars.middle_line(clefs.sign, clefs.up)).collect()] == [34, 22, 35, None]


def test_line_distance_of_the_whole_page():
    """Ink that is no long line doesn't count, wherever it lies."""
    page = np.zeros((400, 2400), bool)
    for top in (20, 140):
        for k in range(5):
            page[top + 12 * k : top + 12 * k + 2, 100:2300] = True
    page[220:400:7, ::12] = True  # dots under every twelfth column, seven pixels apart
    assert geometry.line_distance(page) == 12
    assert geometry.line_distance(np.zeros((50, 50), bool)) is None


def test_least_common_multiple_of_large_numbers(spark):
    from pyspark.sql import functions as F

    from cadenza.functions.scalars import least_common_multiple

    got = spark.createDataFrame([([9007199254740993, 2],), ([4, 6, 10],), ([7],)], "x array<long>").select(least_common_multiple(F.col("x")).alias("y"))
    assert [r.y for r in got.collect()] == [18014398509481986, 60, 7]


def test_medoid_of_equal_sets(spark):
    """Against all pairs of readings, with repeated sets, ties and empty sets."""
    from pyspark.sql import functions as F

    from cadenza.operators import consensus

    rng = random.Random(8)
    rows = [(k % 6, k, sorted(rng.sample(range(4), rng.randint(0, 3)))) for k in range(70)] + [(9, 100, [])]
    sets = spark.createDataFrame(rows, "k int, r int, s array<int>")
    got = {x.k: (x.medoid, round(x.score, 6)) for x in consensus.medoid_of_sets(sets, "k", "r", "s").collect()}
    want = {x.k: (x.medoid, round(x.score, 6)) for x in consensus.medoid(consensus.pairs(sets, "k", "r", "s"), sets, "k", "r").collect()}
    assert got == want and got[9] == (100, 0.0)
    assert consensus.medoid_of_sets(sets.where(F.lit(False)), "k", "r", "s").count() == 0


def test_numbered(spark):
    from cadenza.operators import islands

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k) for k in rng.sample(range(5000), 3000)]
    got = [(r.a, r.b) for r in islands.numbered(spark.createDataFrame(rows, "a string, b int"), ["a", "b"], "place", 8).orderBy("place").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    few = spark.createDataFrame([("x", 1)], "a string, b int")
    assert [r.place for r in islands.numbered(few, ["a", "b"], "place").collect()] == [1]
    assert islands.numbered(few.where("b > 1"), ["a", "b"], "place").count() == 0
