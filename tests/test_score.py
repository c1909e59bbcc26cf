"""Scores from hand-written MusicXML: timelines, rhythm variants, state, merging, votes and repairs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from cadenza.operators import rhythm, score
from cadenza.sources import musicxml

N = "<note>{extra}<pitch><step>{step}</step>{alter}<octave>{octave}</octave></pitch><duration>{d}</duration><voice>{v}</voice><type>{t}</type>{tail}<staff>{s}</staff></note>"


def note(step="C", octave=4, d=1, v=1, s=1, extra="", alter="", t="quarter", tail=""):
    return N.format(step=step, octave=octave, d=d, v=v, s=s, extra=extra, alter=f"<alter>{alter}</alter>" if alter != "" else "", t=t, tail=tail)


def document(bars, attributes="<attributes><divisions>1</divisions><key><fifths>0</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time></attributes>", implicit=()):
    body = "".join(f'<measure number="{k + 1}"{" implicit=" + chr(34) + "yes" + chr(34) if k in implicit else ""}>{attributes if k == 0 else ""}{b}</measure>' for k, b in enumerate(bars))
    return f'<score-partwise><part-list><score-part id="P1"/></part-list><part id="P1">{body}</part></score-partwise>'


@pytest.fixture
def read(spark, tmp_path):
    def load(**scores):
        for name, text in scores.items():
            (tmp_path / f"{name}.musicxml").write_text(text)
        return musicxml.read_scores(spark, str(tmp_path))

    return load


def test_timeline(read):
    """A chord member, a grace note, a tie's end, two voices joined by a backup, and a gap."""
    grace = "<note><grace/><pitch><step>D</step><octave>4</octave></pitch><voice>1</voice><staff>1</staff></note>"
    stop = note("G", d=1, tail="").replace("<voice>", '<tie type="stop"/><voice>')
    bar = note("C", d=2) + note("E", d=2, extra="<chord/>") + grace + note("F", d=1) + stop + "<backup><duration>4</duration></backup>" + note("C", 3, d=1, v=2) + "<forward><duration>2</duration></forward>" + note("D", 3, d=1, v=2)
    df = read(a=document([bar]))
    at = {(r.step, r.octave, r.is_grace): (r.onset, r.end) for r in rhythm.timed(df).where("step is not null").collect()}
    assert at == {("C", 4, False): (0, 2), ("E", 4, False): (0, 2), ("D", 4, True): (2, 2), ("F", 4, False): (2, 3), ("G", 4, False): (3, 4), ("C", 3, False): (0, 1), ("D", 3, False): (3, 4)}
    heard = {r.quarter: r.notes for r in score.onsets(df).collect()}
    assert heard == {0.0: [48, 60, 64], 2.0: [65], 3.0: [50]}


def test_play_chords(read):
    """Jumps from the sounds of a direction (any of them, several in one), chords of all parts, and a range that picks bars only."""

    def sound(**flags):
        return "<direction><sound " + " ".join(f'{k}="x"' for k in flags) + "/></direction>"

    bars = [sound(segno=1, dynamics=1) + note("C", d=4), note("D", d=4) + sound(tocoda=1, fine=1), note("E", d=2) + note("G", d=2) + sound(dalsegno=1), sound(coda=1) + note("F", d=4)]
    df = read(a=document(bars))
    assert [(r.measure_idx, r.flags) for r in score.bar_flags(df).orderBy("measure_idx").collect()] == [(0, ["segno"]), (1, ["fine", "tocoda"]), (2, ["dalsegno"]), (3, ["coda"])]
    got = [(r.play_pos, r.measure_no, r.quarter, r.notes) for r in score.play_chords(df).orderBy("play_pos", "quarter").collect()]
    assert got == [(0, "1", 0.0, [60]), (1, "2", 0.0, [62]), (2, "3", 0.0, [64]), (2, "3", 2.0, [67]), (3, "1", 0.0, [60]), (4, "2", 0.0, [62]), (5, "4", 0.0, [65])]
    assert [r.play_pos for r in score.play_chords(df, 2, 2).orderBy("play_pos").collect()] == [1, 4]


def test_zip_and_unreadable_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.mxl", "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
        z.writestr("inside.xml", document([note(d=4)]))
    (tmp_path / "bad.musicxml").write_text("<score-part")
    (tmp_path / "time.xml").write_text("<score-timewise/>")
    df = musicxml.read_scores(spark, str(tmp_path))
    assert [r.score_id for r in df.where("step is not null").collect()] == ["z.mxl"]


def test_round_trip(read):
    text = document([note("C", d=2, alter="1") + note("E", d=2, extra="<chord/>") + "<backup><duration>2</duration></backup>" + note("A", 3, d=4, v=2, s=2)])
    df = read(a=text)
    again = list(musicxml.elements("a.musicxml", bytes(musicxml.written_scores(df).first().content)))
    keep = ("tag", "step", "alter", "octave", "duration", "is_chord", "voice", "staff", "divisions", "beats")
    assert [tuple(r[k] for k in keep) for r in again] == [tuple(r[k] for k in keep) for r in df.orderBy("measure_idx", "elem_idx").collect()]


def test_issues(read):
    second = note("C", 3, d=4, v=5, s=2)
    back = "<backup><duration>4</duration></backup>"
    bars = [note(d=1), note(d=4) + back + second, note(d=5), note(d=3) + "<backup><duration>3</duration></backup>" + second, note(d=4)]
    got = {(r.measure_idx, r.staff): r.status for r in rhythm.issues(read(a=document(bars, implicit=(0,)))).collect()}
    assert got == {(0, "1"): "ok", (0, "2"): "empty", (1, "1"): "ok", (1, "2"): "ok", (2, "1"): "over", (2, "2"): "empty", (3, "1"): "short", (3, "2"): "ok", (4, "1"): "ok", (4, "2"): "empty"}
    assert score.empty_staves(read()).count() == 3


def test_padding(read):
    df = read(a=document([note(d=1), note(d=3), note(d=4), note(d=2) + "<forward><duration>2</duration></forward>"], implicit=(0,)))
    rests = {r.measure_idx: r.duration for r in score.padded(df).where("is_rest").collect()}
    assert rests == {1: 1}
    assert score.usual_length(df).first().usual == 1.0 or score.usual_length(df).first().usual in (1.0, 2.0, 3.0, 4.0)


def test_key_and_accidentals(read):
    two = "<attributes><divisions>1</divisions><key><fifths>2</fifths></key></attributes>"
    sharp = "<accidental>sharp</accidental>"
    df = read(a=document([note("F") + note("G", tail=sharp) + note("G") + note("G", 5), note("G") + note("C")], two))
    got = [r.sounding for r in score.sounding_alter(df).where("step is not null").orderBy("measure_idx", "elem_idx").collect()]
    assert got == [1, 1, 1, 0, 0, 1]


def test_courtesy(read):
    df = read(a=document([note("G", alter="1") + note("A"), note("A") + note("G"), note("G")]))
    assert [(r.measure_idx, r.step) for r in score.courtesy_naturals(df).collect()] == [(1, "G")]


def test_merge(read, spark):
    other = "<attributes><divisions>3</divisions><key><fifths>0</fifths></key><time><beats>4</beats><beat-type>4</beat-type></time></attributes>"
    df = read(m1=document([note(d=4)] * 2), m2=document([note(d=12)], other))
    own = df.withColumn("piece", F.lit("p")).withColumn("movement", F.col("score_id"))
    merged = score.merged_movements(own, "piece", "movement").orderBy("measure_idx", "elem_idx").collect()
    assert [(r.measure_no, r.duration) for r in merged if r.tag == "note"] == [("1", 12), ("2", 12), ("3", 12)]
    assert [(r.measure_idx, r.divisions, r.beats, r.fifths) for r in merged if r.tag == "attributes"] == [(0, 3, 4, 0)]


def reading(spark, read_rows, name):
    return read_rows.where(F.col("score_id") == f"{name}.musicxml").withColumn("reading", F.lit(name))


def test_vote(read, spark):
    good, other, bad = note("C", d=2) + note("E", d=2), note("C", d=2) + note("F", d=2), note("C", d=5)
    df = read(r0=document([bad, good, bad, good]), r1=document([good, other, bad, other]), r2=document([good, other, bad, good]))
    own = df.withColumn("reading", F.substring("score_id", 1, 2))
    got = {r.measure_idx: r.chosen for r in score.voted(score.staff_readings(own, "reading"), "reading", F.lit("r0")).collect()}
    # the primary is not valid; it is outvoted; nothing is valid; it agrees with another one
    assert got == {0: "r1", 1: "r1", 2: "r0", 3: "r0"}


def test_slurs(read):
    slur = '<notations><slur type="{}" number="1"/></notations>'
    df = read(a=document([note("C", d=2, tail=slur.format("start")) + note("D", d=2), note("E", d=4, tail=slur.format("stop")), note("E", d=4, tail=slur.format("stop"))]))
    got = [(r.from_measure, r.to_measure) for r in score.slur_pairs(df).collect()]
    assert got == [(0, 1)]
    pairs = score.slur_pairs(df).withColumn("reading", F.explode(F.array(F.lit(1), F.lit(2))))
    assert score.voted_slurs(pairs, "reading", 0).count() == 1
    assert score.voted_slurs(pairs, "reading", 1).count() == 0


def test_tuplet_faults(read):
    mark = '<notations><tuplet type="{}"/></notations>'
    bars = [note(tail=mark.format("start")) + note(tail=mark.format("stop")), note(tail=mark.format("stop")), note(tail=mark.format("start")), note(tail=mark.format("start")) + note(tail=mark.format("start")) + note(tail=mark.format("stop"))]
    got = sorted((r.measure_idx, r.fault) for r in score.tuplet_faults(read(a=document(bars))).collect())
    assert got == [(1, "orphan"), (2, "open"), (3, "doubled")]


def test_triplets(read):
    """Three eighths written as such make the bar too long by just their third."""
    three = "<attributes><divisions>6</divisions><time><beats>2</beats><beat-type>4</beat-type></time></attributes>"
    beams = "".join(note(c, d=3, t="eighth", tail=f"<beam>{b}</beam>") for c, b in zip("CDE", ("begin", "continue", "end")))
    df = read(a=document([beams + note("F", d=6), beams + note("F", d=3), note("F", d=15)], three))
    got = score.triplet_candidates(df).collect()
    assert [(r.measure_idx, r.length, r.full) for r in got] == [(0, 15, 12)]


def test_small_repairs(read):
    dot = note("C", d=3, t="quarter", tail="<dot/>").replace("<type>quarter</type><dot/>", "<type>quarter</type><dot/>")
    df = read(a=document([dot + note("D", d=1) + note("D", d=1, extra="<chord/>")]))
    wrong = df.where("dots > 0").select("score_id", "part_id", "measure_idx", "elem_idx")
    assert [r.duration for r in score.undotted(df, wrong).where("step = 'C'").collect()] == [2]
    assert score.kept_unisons(df).where("step = 'D'").count() == 1
    doubt = df.withColumn("conf", F.when(F.col("step") == "C", 0.2).otherwise(0.9))
    assert [(r.step, r.beat) for r in score.doubtful(doubt, "conf").collect()] == [("C", 1.0)]
    assert score.without_ghosts(df.withColumn("conf", F.lit(0.1)), "conf").where("tag = 'note'").count() == 0
    assert score.in_range(df, 1, 1).count() == df.count() and score.in_range(df, 2, 9).count() == 0
    assert score.summary(df).first().notes == 3


def test_ghost_voices(read):
    """A doubtful voice goes only beside one that fills the bar; a doubtful whole note only near the notes it begins with."""
    back = "<backup><duration>{}</duration></backup>"
    whole = note("C", 5, d=4) + note("E", 5, d=4, extra="<chord/>") + back.format(4)
    bars = [
        note("C", d=1) + note("D", d=2),  # the only voice of its staff
        whole + note("A", 4, d=1, v=2) + note("G", 4, d=1, v=2, extra="<chord/>") + back.format(1) + note("C", 3, d=4, v=3, s=2),  # a ghost, and another staff
        note("C", 5, d=2) + back.format(2) + note("A", 4, d=1, v=2),  # no voice fills the bar
        whole + note("E", 4, d=4, v=2),  # 8 below the lowest: a fragment
        whole + note("D", 4, d=4, v=2),  # 10 below: none
        whole + note("A", 4, d=2, v=2) + note("B", 4, d=2, v=2),  # fills the bar with two notes
    ]
    df = read(a=document(bars))
    sure = F.when((F.col("voice") == "1") & (F.col("measure_idx") > 0), 0.9).when((F.col("measure_idx") == 3), 0.6).otherwise(0.3)
    got = score.without_ghost_voices(df.withColumn("conf", sure), "conf")
    left = {}
    for r in got.where("tag = 'note'").collect():
        left.setdefault(r.measure_idx, []).append(f"{r.step}{r.octave}")
    assert {k: sorted(v) for k, v in left.items()} == {0: ["C4", "D4"], 1: ["C3", "C5", "E5"], 2: ["A4", "C5"], 3: ["C5", "E5"], 4: ["C5", "D4", "E5"], 5: ["A4", "B4", "C5", "E5"]}
    at = {(r.measure_idx, r.step, r.octave): r.onset for r in rhythm.timed(got).where("tag = 'note'").collect()}
    assert at[1, "C", 3] == 0  # what the ghost took is skipped, so that the next staff stays in its place
    assert score.without_ghost_voices(df.withColumn("conf", F.lit(None).cast("double")), "conf").where("tag = 'note'").count() == df.where("tag = 'note'").count()


def test_readings_of_another_shape(read):
    """A reading with one bar more would vote with shifted bars."""
    bars = [note("C", d=4), note("D", d=4)]
    df = read(a=document(bars), b=document(bars), c=document([note("E", d=4), *bars]))
    got = score.staff_readings(df, "score_id", "a.musicxml")
    assert sorted({r.score_id for r in got.collect()}) == ["a.musicxml", "b.musicxml"]
    assert {r.score_id for r in score.staff_readings(df, "score_id").collect()} == {"a.musicxml", "b.musicxml", "c.musicxml"}
