"""Queries of the score operators: bars, notes and signs are made from the rows of lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import islands, layout, marks, tempo, timeline

from .catalog import EV, load, query

#: An event as a chord: its measure is the day, its beat a place in a bar of four quarters.
CHORDS = """c AS (SELECT user_id, ts, event_id, event_type, CAST(day(ts) // 3 AS INTEGER) AS measure, hour(ts) % 8 / 2.0 + 1 AS beat FROM events),
n AS (SELECT *, row_number() OVER w AS place, CASE WHEN measure = lag(measure) OVER w AND NOT beat < lag(beat) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM n)"""


def _chords(spark, d):
    ev = load(spark, d, "events", "user_id", "ts", "event_id", "event_type")
    return ev.withColumn("measure", F.floor(F.dayofmonth("ts") / 3).cast("int")).withColumn("beat", F.hour("ts") % 8 / 2.0 + 1)


@query(f"""
WITH {CHORDS} SELECT user_id, event_id, run, CAST(min(place) OVER (PARTITION BY user_id, run) AS INTEGER) AS "first", CAST(max(place) OVER (PARTITION BY user_id, run) AS INTEGER) AS "last",
  (run - 1) * 4.0 + beat AS position FROM r
""")
def q40_run_bounds(spark, d):
    return layout.run_bounds(_chords(spark, d), ["user_id"], EV, "measure", "beat", 4.0).select("user_id", "event_id", "run", "first", "last", "position")


@query(f"""
WITH {CHORDS}, t AS (SELECT user_id, run, measure, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS mistakes, min(CASE WHEN event_type = 'error' THEN place END) AS first_wrong FROM r GROUP BY ALL)
SELECT user_id, run, measure, CAST(mistakes AS BIGINT) AS mistakes, first_wrong, CASE mistakes WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'err' END AS tile FROM t
""")
def q41_run_tiles(spark, d):
    runs = layout.run_bounds(_chords(spark, d), ["user_id"], EV, "measure", "beat", 4.0)
    return layout.run_tiles(runs, ["user_id"], "measure", "place", F.col("event_type") == "error")


@query("""
SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R')), ',') AS missing,
  array_to_string(list_sort(list(DISTINCT l_linenumber + 7) FILTER (l_returnflag <> 'R')), ',') AS extra FROM lineitem GROUP BY 1
""")
def q42_merged_sets(spark, d):
    items = load(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_returnflag")
    none = F.array().cast("array<int>")
    own = items.select("l_partkey", F.when(F.col("l_returnflag") == "R", F.array(F.col("l_linenumber").cast("int"))).otherwise(none).alias("missing"), F.when(F.col("l_returnflag") == "R", none).otherwise(F.array((F.col("l_linenumber") + 7).cast("int"))).alias("extra"))
    said = [F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("missing", "extra")]
    return layout.merged_sets(own, ["l_partkey"], ["missing", "extra"]).select("l_partkey", *said)


#: An order as a bar of its customer's piece: a new month begins a row, a new year a page.
BARS = """b AS (SELECT o_custkey AS piece, o_orderkey AS bar, o_orderdate AS day, row_number() OVER w AS place, coalesce(date_trunc('month', o_orderdate) <> date_trunc('month', lag(o_orderdate) OVER w), false) AS new_row,
  coalesce(year(o_orderdate) <> year(lag(o_orderdate) OVER w), false) AS new_page FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT *, sum(CASE WHEN new_page THEN 1 ELSE 0 END) OVER w + 1 AS page, sum(CASE WHEN new_page OR new_row OR place = 1 THEN 1 ELSE 0 END) OVER w AS "row" FROM b WINDOW w AS (PARTITION BY piece ORDER BY place ROWS UNBOUNDED PRECEDING)),
s AS (SELECT piece, CAST(page AS BIGINT) AS page, CAST("row" AS BIGINT) AS "row", CAST(min(place) AS INTEGER) AS "first", CAST(max(place) AS INTEGER) AS "last" FROM g GROUP BY ALL)"""


def _bars(spark, d):
    own = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").select(F.col("o_custkey").alias("piece"), F.col("o_orderkey").alias("bar"), F.col("o_orderdate").alias("day"))
    own = timeline.renumbered(own, ["piece"], ["day", "bar"], "place")
    was = islands.before("day", ["piece"], ["place"])
    return own.withColumn("new_row", F.date_trunc("month", "day") != F.date_trunc("month", was)).withColumn("new_page", F.year("day") != F.year(was))


def _rows(spark, d):
    return layout.rows_of_bars(_bars(spark, d), ["piece"], ["place"], "place", F.col("new_row"), F.col("new_page"))


@query(f'WITH {BARS} SELECT piece, page, "row", "first", "last" FROM s')
def q43_rows_of_bars(spark, d):
    return _rows(spark, d)


@query(f"""
WITH {BARS}, a AS (SELECT piece, bar, CAST(place AS INTEGER) AS "begin", CAST(place + bar % 3 AS INTEGER) AS "end" FROM b)
SELECT a.piece, a.bar, "begin", "end", NOT coalesce(x."row" = y."row" OR (y."row" = x."row" + 1 AND a."begin" = x."last" AND a."end" = y."first"), false) AS stray
FROM a LEFT JOIN s x ON x.piece = a.piece AND a."begin" BETWEEN x."first" AND x."last" LEFT JOIN s y ON y.piece = a.piece AND a."end" BETWEEN y."first" AND y."last"
""")
def q44_broken_arcs(spark, d):
    arcs = _bars(spark, d).select("piece", "bar", F.col("place").alias("begin"), (F.col("place") + F.col("bar") % 3).cast("int").alias("end"))
    return layout.broken_arcs(arcs, _rows(spark, d), ["piece"])


@query(f"""
WITH {BARS}, m AS (SELECT piece, bar, place, year(day) AS sheet, lead(bar) OVER w AS next_bar, lead(year(day)) OVER w AS next_sheet FROM b WINDOW w AS (PARTITION BY piece ORDER BY place))
SELECT piece, bar, CAST(sheet AS INTEGER) AS sheet, next_bar, CAST(next_sheet AS INTEGER) AS next_sheet FROM m WHERE next_sheet <> sheet
""")
def q45_across_breaks(spark, d):
    own = _bars(spark, d).select("piece", "bar", "place", F.year("day").alias("sheet"))
    return layout.across_breaks(own, ["piece"], ["place"], "sheet").select("piece", "bar", "sheet", "next_bar", "next_sheet")


@query("""
WITH l AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS number, min(l_orderkey) AS place FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT x.l_orderkey, x.l_linenumber, coalesce(l.place, 0) AS mi FROM lineitem x LEFT JOIN l ON l.l_suppkey = x.l_suppkey AND l.number = CAST(x.l_quantity AS INTEGER)
""")
def q46_first_places(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").withColumn("number", F.col("l_quantity").cast("int"))
    bars = items.where("l_linenumber = 1").select("l_suppkey", "number", F.col("l_orderkey").alias("place"))
    return layout.first_places(items, bars, ["l_suppkey"], "number", "place", "mi").select("l_orderkey", "l_linenumber", "mi")


@query("""
WITH a AS (SELECT user_id, day(ts) AS day, CAST(floor(value / 10) AS BIGINT) AS pitch, event_id, event_type FROM events),
x AS (SELECT user_id, day, pitch, event_id, row_number() OVER (PARTITION BY user_id, day, pitch ORDER BY event_id) AS k FROM a WHERE event_type = 'view'),
y AS (SELECT user_id, day, pitch, event_id, row_number() OVER (PARTITION BY user_id, day, pitch ORDER BY event_id) AS k FROM a WHERE event_type = 'click')
SELECT x.user_id, CAST(x.day AS INTEGER) AS day, x.pitch, x.event_id AS "from", y.event_id AS "to" FROM x JOIN y USING (user_id, day, pitch, k)
""")
def q47_same_pitches(spark, d):
    own = load(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value").select("user_id", F.dayofmonth("ts").alias("day"), F.floor(F.col("value") / 10).cast("long").alias("pitch"), "event_id", "event_type")
    return layout.same_pitches(own.where("event_type = 'view'"), own.where("event_type = 'click'"), ["user_id", "day"], "pitch", "event_id", "event_id")


@query("""
WITH v AS (SELECT user_id, epoch_us(ts) / 1e6 AS q, max({'x': value, 'line': day(ts)}) AS h FROM events WHERE event_type = 'view' GROUP BY 1, 2),
l AS (SELECT user_id, q, h.x AS x, h.line AS line, lead(q) OVER w AS q2, lead(h.x) OVER w AS x2, lead(h.line) OVER w AS line2 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY q))
SELECT p.event_id, round(CASE WHEN l.line = l.line2 THEN l.x + least(1.0, (p.q - l.q) / (l.q2 - l.q)) * (l.x2 - l.x) ELSE l.x END, 6) AS x, CAST(l.line AS INTEGER) AS line
FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS q FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN l ON l.user_id = p.user_id AND p.q >= l.q
""")
def q48_cursor_places(spark, d):
    ev = load(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("q", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = ev.where("event_type = 'view'").select("user_id", "q", F.col("value").alias("x"), F.dayofmonth("ts").alias("line"))
    asked = ev.where("event_type = 'purchase'").select("event_id", "user_id", "q")
    return layout.cursor_places(asked, rows, ["user_id"], "q", "x", "line").select("event_id", F.round("x", 6).alias("x"), "line")


#: A line item as a note: the order is its bar, the staff one of two, onsets are quantities and lengths line numbers.
NOTES = """n AS (SELECT l_orderkey AS bar, l_linenumber AS k, CAST(l_suppkey % 2 + 1 AS INTEGER) AS staff, CAST(l_quantity AS BIGINT) % 8 AS onset, CAST(l_quantity AS BIGINT) % 8 + l_partkey % 4 AS "end",
  CAST(l_partkey % 7 + 1 AS INTEGER) AS step, CAST(l_partkey % 2 + 4 AS INTEGER) AS octave, CAST(l_suppkey % 3 - 1 AS INTEGER) AS alter, l_returnflag AS flag FROM lineitem)"""


def _notes(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    onset = F.col("l_quantity").cast("long") % 8
    return items.select(
        F.col("l_orderkey").alias("bar"), F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("staff"), onset.alias("onset"), (onset + F.col("l_partkey") % 4).alias("end"),
        (F.col("l_partkey") % 7 + 1).cast("int").alias("step"), (F.col("l_partkey") % 2 + 4).cast("int").alias("octave"), (F.col("l_suppkey") % 3 - 1).cast("int").alias("alter"), F.col("l_returnflag").alias("flag"),
    )


@query(f"""
WITH {NOTES}, a AS (SELECT bar, onset, arg_min(k, (staff <> 1, k)) AS note FROM n GROUP BY 1, 2), e AS (SELECT bar, max("end") AS "end" FROM n GROUP BY 1)
SELECT bar, onset, note, "end" FROM a JOIN e USING (bar)
""")
def q49_first_notes(spark, d):
    return marks.first_notes(_notes(spark, d), ["bar"], "onset", "end", "staff", "k")


@query(f"""
WITH {NOTES}, m AS (SELECT *, max("end") OVER (PARTITION BY bar, staff) AS e FROM n), t AS (SELECT *, max(onset) OVER (PARTITION BY bar, staff) AS o FROM m WHERE "end" = e)
SELECT bar, staff, k FROM t WHERE onset = o
""")
def q50_lasting(spark, d):
    return marks.lasting(_notes(spark, d), ["bar", "staff"], "onset", "end").select("bar", "staff", "k")


@query("""
WITH e AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS bar, event_id AS k, event_type = 'view' AS note, CASE WHEN event_type IN ('signup', 'error') THEN event_type END AS clef FROM events),
f AS (SELECT *, min(CASE WHEN note THEN k END) OVER (PARTITION BY user_id, bar) AS f FROM e),
b AS (SELECT user_id, bar, arg_max(clef, k) FILTER (clef IS NOT NULL AND (f IS NULL OR k < f)) AS s, arg_max(clef, k) FILTER (clef IS NOT NULL) AS e FROM f GROUP BY 1, 2)
SELECT user_id, bar, coalesce(s, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS "start",
  last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "end" FROM b
""")
def q51_bar_clefs(spark, d):
    ev = load(spark, d, "events", "user_id", "ts", "event_id", "event_type").withColumn("bar", F.dayofmonth("ts"))
    clef = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return marks.bar_clefs(ev, ["user_id"], "bar", "event_id", F.col("event_type") == "view", clef)


@query(f"""
WITH {NOTES}, h AS (SELECT *, flag = 'R' AND alter <> 0 AND alter = CASE WHEN step <= 4 THEN 1 ELSE -1 END AS hit FROM n),
m AS (SELECT *, min(CASE WHEN hit THEN onset END) OVER (PARTITION BY bar, staff, step, octave, alter) AS since FROM h)
SELECT bar, k, CASE WHEN hit OR coalesce(since < onset, false) AND flag <> 'A' AND alter <> 0 THEN 0 ELSE alter END AS alter, CASE WHEN hit AND flag <> 'A' THEN 'natural' WHEN flag = 'A' THEN 'sharp' END AS accidental FROM m
""")
def q52_with_naturals(spark, d):
    own = _notes(spark, d).withColumn("accidental", F.when(F.col("flag") == "A", "sharp"))
    out = marks.with_naturals(own, ["bar", "staff"], "step", "octave", "onset", "alter", "accidental", F.col("flag") == "R", F.when(F.col("step") <= 4, 1).otherwise(-1))
    return out.select("bar", "k", "alter", "accidental")


@query("""
WITH n AS (SELECT l_orderkey AS bar, l_linenumber AS k, CAST(l_partkey % 3 AS INTEGER) AS step, CAST(l_partkey % 4 AS INTEGER) AS octave, CAST(l_suppkey % 2 + 1 AS INTEGER) AS owner, CAST(l_suppkey % 3 - 1 AS INTEGER) AS alter FROM lineitem),
w AS (SELECT *, step - 1 AS ka, count(*) OVER p AS c, max(octave) OVER p - min(octave) OVER p AS apart, min(owner) OVER p <> max(owner) OVER p AS hands, min(alter) OVER p AS lo, max(alter) OVER p AS hi FROM n WINDOW p AS (PARTITION BY bar, step)),
a AS (SELECT *, c = 2 AND hands AND apart IN (1, 2) AND ka <> 0 AND lo = least(0, ka) AND hi = greatest(0, ka) AND alter <> ka AS aligned FROM w)
SELECT bar, k, aligned, CASE WHEN aligned THEN ka ELSE alter END AS alter FROM a
""")
def q53_doubled_accidentals(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    own = items.select(F.col("l_orderkey").alias("bar"), F.col("l_linenumber").alias("k"), *((x).cast("int").alias(c) for c, x in (("step", F.col("l_partkey") % 3), ("octave", F.col("l_partkey") % 4), ("owner", F.col("l_suppkey") % 2 + 1), ("alter", F.col("l_suppkey") % 3 - 1))))
    return marks.doubled_accidentals(own, ["bar"], "step", "octave", "owner", "alter", F.col("step") - 1).select("bar", "k", "aligned", "alter")


SIGNS = """s AS (SELECT l_suppkey % 40 AS piece, l_orderkey AS note, CASE l_returnflag WHEN 'R' THEN 'staccatissimo' WHEN 'A' THEN 'staccato' ELSE CASE WHEN l_linenumber = 1 THEN 'turn' ELSE 'accent' END END AS kind, l_quantity / 50 AS certainty FROM lineitem)"""


def _signs(spark, d):
    items = load(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    kind = F.when(F.col("l_returnflag") == "R", "staccatissimo").when(F.col("l_returnflag") == "A", "staccato").when(F.col("l_linenumber") == 1, "turn").otherwise("accent")
    return items.select((F.col("l_suppkey") % 40).alias("piece"), F.col("l_orderkey").alias("note"), kind.alias("kind"), (F.col("l_quantity") / 50).alias("certainty"))


@query(f"""
WITH {SIGNS}, g AS (SELECT piece FROM s GROUP BY 1 HAVING count(*) FILTER (kind = 'staccatissimo') > 0 AND count(*) FILTER (kind = 'staccato') >= count(*) FILTER (kind = 'staccatissimo'))
SELECT piece, note, kind FROM s WHERE piece NOT IN (SELECT piece FROM g) OR kind NOT IN ('staccato', 'staccatissimo')
UNION ALL SELECT DISTINCT piece, note, 'staccato' FROM s WHERE piece IN (SELECT piece FROM g) AND kind IN ('staccato', 'staccatissimo')
""")
def q54_dots_for_wedges(spark, d):
    return marks.dots_for_wedges(_signs(spark, d).drop("certainty"), ["piece"], "kind")


@query(f"WITH {SIGNS} SELECT piece, note, kind, certainty FROM s WHERE NOT (kind = 'turn' AND certainty < 0.6)")
def q55_kept_signs(spark, d):
    return marks.kept_signs(_signs(spark, d), "kind", "certainty", 0.6)


@query("""
WITH e AS (SELECT l_orderkey AS bar, l_extendedprice AS x, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS len FROM lineitem),
g AS (SELECT bar, x, len, lead(x) OVER w - x AS gap, row_number() OVER w AS place FROM e WINDOW w AS (PARTITION BY bar ORDER BY x)),
b AS (SELECT bar, 4.0 - sum(len) AS missing, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, arg_max(place, (gap, place)) FILTER (gap IS NOT NULL) AS place, arg_max(x, (gap, place)) FILTER (gap IS NOT NULL) AS x, max(gap) AS gap FROM g GROUP BY 1)
SELECT bar, place, round(x + gap / 2, 6) AS x, missing AS "length" FROM b WHERE len(gaps) > 0 AND missing IN (4, 2, 1, 0.5, 0.25, 0.125) AND len(list_filter(gaps, lambda v: v > 1.6 * gaps[len(gaps) // 2 + 1])) = 1
""")
def q56_missing_rest(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    own = items.select(F.col("l_orderkey").alias("bar"), F.col("l_extendedprice").alias("x"), F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(0.5).alias("len"), F.lit(4.0).alias("full"))
    return marks.missing_rest(own, ["bar"], "x", "len", "full").select("bar", "place", F.round("x", 6).alias("x"), "length")


@query("""
WITH e AS (SELECT l_suppkey, l_partkey * 100 + l_linenumber AS x, l_quantity + 50 AS w FROM lineitem WHERE l_linenumber = 2),
s AS (SELECT *, lead(x) OVER (PARTITION BY l_suppkey ORDER BY x, w) - x AS step FROM e),
m AS (SELECT l_suppkey, quantile_cont(w, 0.5) AS mw, quantile_cont(step, 0.5) AS ms, count(*) AS n FROM s GROUP BY 1)
SELECT l_suppkey, max(n) < 4 OR (avg(CASE WHEN abs(w - mw) <= 0.35 * mw THEN 1 ELSE 0 END) >= 0.8 AND avg(CASE WHEN step IS NULL THEN NULL WHEN abs(step - ms) <= 0.25 * ms THEN 1 ELSE 0 END) >= 0.8) AS regular FROM s JOIN m USING (l_suppkey) GROUP BY 1
""")
def q57_regular(spark, d):
    own = load(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity").where("l_linenumber = 2")
    return marks.regular(own.select("l_suppkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("x"), (F.col("l_quantity") + 50).alias("w")), ["l_suppkey"], "x", "w")


@query("""
WITH n AS (SELECT l_orderkey AS chord, CAST(60 + l_partkey % 3 * 12 AS INTEGER) AS midi, l_suppkey % 2 AS voice, l_returnflag = 'X' AS rest FROM lineitem)
SELECT chord, max(midi) AS top FROM n GROUP BY 1 HAVING NOT bool_or(rest) AND count(*) >= 2 AND count(DISTINCT voice) = 1 AND list_contains(list(midi), max(midi) - 12)
""")
def q58_octave_chords(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    own = items.select(F.col("l_orderkey").alias("chord"), (60 + F.col("l_partkey") % 3 * 12).cast("int").alias("midi"), (F.col("l_suppkey") % 2).alias("voice"), (F.col("l_returnflag") == "X").alias("rest"))
    return marks.octave_chords(own, ["chord"], "midi", "voice", F.col("rest"))


@query("""
WITH n AS (SELECT l_orderkey AS chunk, CASE l_suppkey % 2 WHEN 0 THEN 'eighth' ELSE '16th' END AS kind, CAST(CASE l_suppkey % 2 WHEN 0 THEN 4 ELSE 2 END AS INTEGER) AS dur, l_returnflag <> 'Z' AS plain FROM lineitem)
SELECT chunk, min(kind) AS kind, min(dur) AS dur FROM n GROUP BY 1 HAVING count(*) = 3 AND bool_and(plain) AND count(DISTINCT kind) = 1
""")
def q59_equal_threes(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag")
    even = F.col("l_suppkey") % 2 == 0
    own = items.select(F.col("l_orderkey").alias("chunk"), F.when(even, "eighth").otherwise("16th").alias("kind"), F.when(even, 4).otherwise(2).alias("dur"), F.lit(8).alias("div"), (F.col("l_returnflag") != "Z").alias("plain"))
    return marks.equal_threes(own, ["chunk"], "kind", "dur", "div", F.col("plain"))


@query(f"""
WITH {NOTES}, c AS (SELECT *, bool_or(staff = 2 AND octave = 4) OVER (PARTITION BY bar) AS crossing FROM n)
SELECT bar, k, CASE WHEN crossing AND staff = 2 AND flag <> 'R' AND step <> 7 THEN CASE WHEN octave = 4 THEN 'up' ELSE 'down' END END AS stem FROM c
""")
def q60_stems(spark, d):
    own = _notes(spark, d).withColumn("owner", F.col("octave") - 3).withColumn("type", F.when(F.col("step") == 7, "whole").otherwise("half"))
    return marks.stems(own, ["bar"], "staff", "owner", "type", F.col("flag") == "R").select("bar", "k", "stem")


@query("""
WITH r AS (SELECT l_orderkey AS bar, CAST(l_suppkey % 2 + 1 AS INTEGER) AS staff, l_linenumber AS k, CASE WHEN l_suppkey % 2 = lag(l_suppkey % 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) THEN 0 ELSE 1 END AS new FROM lineitem)
SELECT bar, staff, min(k) AS low, max(k) AS high, sum(new) > 1 AS interleaved FROM r GROUP BY 1, 2
""")
def q61_staff_blocks(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # an order may hold a line number twice
    own = items.select(F.col("l_orderkey").alias("bar"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("staff"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return marks.staff_blocks(own, ["bar"], "staff", "at").select("bar", "staff", F.col("low.l_linenumber").alias("low"), F.col("high.l_linenumber").alias("high"), "interleaved")


@query("""
WITH t AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS reading FROM orders WHERE o_orderstatus = 'P')
SELECT l.l_orderkey AS o_orderkey, l.l_linenumber, CAST(l.l_linenumber % 3 AS INTEGER) AS reading FROM lineitem l LEFT JOIN t ON t.o_orderkey = l.l_orderkey WHERE l.l_linenumber % 3 = coalesce(t.reading, 0)
""")
def q62_followed_marks(spark, d):
    own = load(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_linenumber") % 3).cast("int").alias("reading"))
    taken = load(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("reading"))
    return marks.followed_marks(own, taken, ["o_orderkey"], "reading")


@query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 1 AND (d * 2) % 3 = 0 THEN d * 2 // 3 ELSE d END AS BIGINT) AS undotted, CAST(CASE WHEN (d * 3) % 2 = 0 THEN d * 3 // 2 ELSE d END AS BIGINT) AS untupled,
  CASE WHEN l_returnflag = 'R' THEN 34 WHEN l_returnflag = 'A' THEN 22 END AS middle FROM (SELECT *, CAST(l_quantity AS BIGINT) AS d FROM lineitem)
""")
def q63_lengths(spark, d):
    own = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").withColumn("d", F.col("l_quantity").cast("long"))
    sign = F.when(F.col("l_returnflag") == "R", "G").when(F.col("l_returnflag") == "A", "F")
    return own.select("l_orderkey", "l_linenumber", marks.undotted(F.col("d"), F.col("l_linenumber"), F.lit(False)).alias("undotted"), marks.untupled(F.col("d"), F.lit(3), F.lit(2)).alias("untupled"), S.middle_line(sign, F.lit(None).cast("int")).alias("middle"))


@query("""
WITH i AS (SELECT l_suppkey, l_orderkey % 20 AS measure, l_quantity / 10 AS dt, l_extendedprice / 10000 AS dq FROM lineitem),
s AS (SELECT *, dt / dq AS s FROM i), m AS (SELECT l_suppkey, quantile_cont(s, 0.5) AS med FROM s GROUP BY 1),
k AS (SELECT s.* FROM s JOIN m USING (l_suppkey) WHERE NOT (dt >= 1.2 AND s > 2.5 * med))
SELECT l_suppkey, measure, round(quantile_cont(s, 0.5), 6) AS s FROM k GROUP BY 1, 2 HAVING sum(dq) >= 0.5 * 4
""")
def q64_measure_speeds(spark, d):
    items = load(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice")
    own = items.select("l_suppkey", (F.col("l_orderkey") % 20).alias("measure"), (F.col("l_quantity") / 10).alias("dt"), (F.col("l_extendedprice") / 10000).alias("dq"))
    return tempo.measure_speeds(own, "l_suppkey", "measure", "dt", "dq", 4.0).select("l_suppkey", "measure", F.round("s", 6).alias("s"))
