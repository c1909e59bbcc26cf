"""Queries over the driver's tables, each an operator bound to tabular data, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import consensus, islands, joins, peaks, rhythm, tempo, timeline

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


EV = ["ts", "event_id"]


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, max(q) AS fullest FROM v GROUP BY 1)
SELECT o_orderkey, fullest, CASE WHEN fullest IS NULL THEN 'empty' WHEN fullest > 50 THEN 'over' WHEN fullest < 50 THEN 'short' ELSE 'ok' END AS status
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey
""")
def q01_rhythm_issues(spark, d):
    voices = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    fullest = voices.groupBy("l_orderkey").agg(F.max("q").alias("fullest"))
    out = load(spark, d, "orders", "o_orderkey").join(fullest, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", "fullest", rhythm.status(F.col("fullest"), F.lit(50.0)).alias("status"))


@query("""
SELECT event_id, user_id, round(coalesce(sum(CASE event_type WHEN 'error' THEN -value WHEN 'signup' THEN 0 ELSE value END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) + 0.0 AS onset FROM events
""")
def q02_running_timeline(spark, d):
    delta = F.when(F.col("event_type") == "error", -F.col("value")).when(F.col("event_type") == "signup", 0.0).otherwise(F.col("value"))
    return timeline.cursor(load(spark, d, "events"), ["user_id"], EV, delta).select("event_id", "user_id", (F.round("onset", 3) + 0.0).alias("onset"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events
""")
def q03_carry_forward(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return timeline.carried(load(spark, d, "events"), ["user_id"], EV, value, "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
WHERE b IS DISTINCT FROM event_type
""")
def q04_state_changes(spark, d):
    return timeline.changes(load(spark, d, "events"), ["user_id"], EV, ["event_type"]).select("event_id", "user_id", "event_type")


SESSIONS = """
s0 AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 10800000000 THEN 0 ELSE 1 END AS new, event_id FROM events),
s1 AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s0),
s AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS "begin", max(ts) AS "end", count(*) AS n FROM s1 GROUP BY 1, 2)
"""


@query(f'WITH {SESSIONS} SELECT user_id, session, "begin", "end", n FROM s')
def q05_gap_islands(spark, d):
    return islands.sessions(load(spark, d, "events", "user_id", "ts", "event_id"), "user_id", "ts", 10800, "event_id").select("user_id", F.col("session").cast("long").alias("session"), "begin", "end", "n")


@query("""
SELECT event_id, user_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING), 4) AS base FROM events
""")
def q06_moving_median(spark, d):
    ev = load(spark, d, "events", "event_id", "user_id", "ts", "value")
    return ev.select("event_id", "user_id", F.round(peaks.moving_median(["user_id"], EV, "value", 40), 4).alias("base"))


PEAKS = """
p0 AS (SELECT event_id, user_id, ts, (coalesce(lag(value) OVER w, 0) + value + coalesce(lead(value) OVER w, 0)) / 3 AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p1 AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS base,
  lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM p0),
p AS (SELECT event_id, user_id, ts, x FROM p1 WHERE x > base + 20 AND x >= a AND x >= b)
"""


def _peaks(spark, d):
    ev = load(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("x", peaks.smoothed(["user_id"], EV, "value"))
    ev = ev.withColumn("base", peaks.moving_median(["user_id"], EV, "x", 40))
    return ev.withColumn("peak", peaks.is_peak(["user_id"], EV, "x", F.col("base") + 20)).where("peak")


@query(f"WITH {PEAKS} SELECT event_id, user_id, round(x, 4) AS strength FROM p")
def q07_peaks(spark, d):
    return _peaks(spark, d).select("event_id", "user_id", F.round("x", 4).alias("strength"))


@query(f"""
WITH RECURSIVE {PEAKS},
n AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, round(x, 4) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM p),
w AS (SELECT user_id, k, t AS kt, x AS kx, NULL::DOUBLE AS dt, NULL::DOUBLE AS dx FROM n WHERE k = 1
  UNION ALL SELECT n.user_id, n.k,
    CASE WHEN n.t - kt < 86400 AND n.x <= kx THEN kt ELSE n.t END, CASE WHEN n.t - kt < 86400 AND n.x <= kx THEN kx ELSE n.x END,
    CASE WHEN n.t - kt >= 86400 THEN kt END, CASE WHEN n.t - kt >= 86400 THEN kx END
  FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)
SELECT user_id, round(t, 3) AS t, x AS strength FROM (
  SELECT user_id, dt AS t, dx AS x FROM w WHERE dt IS NOT NULL
  UNION ALL SELECT user_id, kt, kx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM w) WHERE r = 1)
""")
def q08_refractory(spark, d):
    own = _peaks(spark, d).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.round("x", 4).alias("strength"))
    return peaks.refractory(own, ["user_id"], "t", "strength", 86400.0).select("user_id", F.round("t", 3).alias("t"), "strength")


@query("""
SELECT p.event_id, p.user_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def q09_asof_backward(spark, d):
    ev = load(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", "ts", "value")
    return joins.asof(left, right, ["user_id"], "ts", "value", "last_view").select("event_id", "user_id", "last_view")


@query("""
SELECT event_id, user_id, nearest FROM (SELECT a.event_id, a.user_id, b.event_id AS nearest,
  row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.c - a.c), b.event_id) AS r
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_type = 'purchase') a
  LEFT JOIN (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id) WHERE r = 1
""")
def q10_nearest(spark, d):
    ev = load(spark, d, "events", "event_id", "user_id", "event_type", "value").withColumn("c", F.round(F.col("value") * 100).cast("long"))
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "c")
    right = ev.where("event_type = 'click'").select("event_id", "user_id", "c")
    return joins.nearest(left, right, ["user_id"], "c", "c", "event_id", "nearest").select("event_id", "user_id", "nearest")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY
""")
def q11_interval_contain(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    spans = load(spark, d, "orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.containing(items, spans, ["l_orderkey"], F.col("l_shipdate"), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"))


@query(f"""
WITH {SESSIONS}, m AS (SELECT user_id * 100000 + session AS id, epoch_us("begin") / 1e6 AS b, epoch_us("end") / 1e6 AS e, user_id FROM s WHERE n > 1)
SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.id < y.id AND x.user_id < y.user_id AND x.b <= y.e AND y.b <= x.e
""")
def q12_interval_overlap(spark, d):
    own = islands.sessions(load(spark, d, "events", "user_id", "ts", "event_id"), "user_id", "ts", 10800, "event_id").where("n > 1")
    seconds = [(F.unix_micros(F.col(c).cast("timestamp")) / 1e6).alias(c) for c in ("begin", "end")]
    spans = own.select((F.col("user_id") * 100000 + F.col("session")).cast("long").alias("id"), *seconds)
    return joins.overlapping(spans, "id", "begin", "end", 14400.0).where(F.floor(F.col("a") / 100000) < F.floor(F.col("b") / 100000))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q13_anti(spark, d):
    return load(spark, d, "orders", "o_orderkey").join(load(spark, d, "lineitem", "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def q14_semi(spark, d):
    full = load(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity >= 49")
    return load(spark, d, "orders", "o_orderkey").join(full, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("""
WITH g AS (SELECT user_id, unnest(range(1, 31)) AS day FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, CAST(day AS INTEGER) AS day FROM g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.user_id AND day(e.ts) = g.day)
""")
def q15_cross_fill(spark, d):
    ev = load(spark, d, "events", "user_id", "ts").select("user_id", F.dayofmonth("ts").alias("day"))
    return joins.missing(ev.select("user_id").distinct(), "user_id", F.sequence(F.lit(1), F.lit(30)), ev, "day")


SETS = """
r AS (SELECT o_custkey, o_orderkey, list(DISTINCT l_suppkey % 10) FILTER (l_suppkey IS NOT NULL) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
e AS (SELECT o_custkey, o_orderkey, coalesce(s, []) AS s FROM r),
j AS (SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n
  FROM e x JOIN e y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey),
p AS (SELECT o_custkey, a, b, CASE WHEN n = 0 THEN 1.0 ELSE i / (n - i) END AS jac FROM j)
"""


def _sets(spark, d):
    items = load(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    both = load(spark, d, "orders", "o_orderkey", "o_custkey").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.groupBy("o_custkey", "o_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("s"))


@query(f"WITH {SETS} SELECT o_custkey, a, b, round(jac, 6) AS jaccard FROM p")
def q16_jaccard(spark, d):
    return consensus.pairs(_sets(spark, d), "o_custkey", "o_orderkey", "s").select("o_custkey", "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
WITH {SETS}, u AS (SELECT o_custkey, a AS o, jac FROM p UNION ALL SELECT o_custkey, b, jac FROM p),
t AS (SELECT e.o_custkey, e.o_orderkey, round(coalesce(sum(jac), 0), 9) AS score FROM e LEFT JOIN u ON u.o_custkey = e.o_custkey AND u.o = e.o_orderkey GROUP BY 1, 2)
SELECT o_custkey, arg_min(o_orderkey, (-score, o_orderkey)) AS medoid, round(max(score), 6) AS score FROM t GROUP BY 1
""")
def q17_medoid_vote(spark, d):
    sets = _sets(spark, d).withColumn("s", F.array_sort("s"))
    return consensus.medoid_of_sets(sets, "o_custkey", "o_orderkey", "s").select("o_custkey", "medoid", F.round("score", 6).alias("score"))


@query("""
SELECT user_id, arg_min(event_type, (-votes, event_type)) AS mode, max(votes) AS votes FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1
""")
def q18_mode_vote(spark, d):
    return consensus.mode(load(spark, d, "events", "user_id", "event_type"), ["user_id"], "event_type", 2)


@query("""
SELECT l_suppkey, arg_min(l_orderkey, (bad, l_orderkey)) AS base FROM (SELECT l_suppkey, l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def q19_argmin_struct(spark, d):
    bad = load(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_returnflag").groupBy("l_suppkey", "l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    return consensus.first_best(bad, ["l_suppkey"], [F.col("bad"), F.col("l_orderkey")], "l_orderkey", "base")


@query("""
WITH l AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS t, value AS q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 14),
s AS (SELECT a.user_id, quantile_cont((b.q - a.q) / (b.t - a.t), 0.5) AS slope FROM l a JOIN l b ON a.user_id = b.user_id AND b.t - a.t > 0.05 AND b.q > a.q GROUP BY 1)
SELECT l.user_id, round(slope, 4) AS slope, round(quantile_cont(q - slope * (t - 473352), 0.5), 2) AS intercept FROM l JOIN s USING (user_id) GROUP BY l.user_id, slope
""")
def q20_theil_sen(spark, d):
    ev = load(spark, d, "events", "user_id", "ts", "event_id", "value")
    last = tempo.last_rows(ev, ["user_id"], [F.desc("ts"), F.desc("event_id")], 14)
    points = last.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("t"), F.col("value").alias("q"))
    return tempo.theil_sen(points, "user_id", "t", "q", 0.05).select("user_id", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("""
WITH r AS (SELECT l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity / l_extendedprice, l_quantity, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, round(sum(l_quantity) / sum(l_extendedprice), 9) AS ratio, count(*) AS n FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY 1
""")
def q21_trimmed_ratio(spark, d):
    items = load(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice")
    return tempo.trimmed_ratio(items, "l_suppkey", "l_quantity", "l_extendedprice", 0.1).select("l_suppkey", F.round("ratio", 9).alias("ratio"), "n")


@query("""
WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1),
k AS (SELECT e.user_id, ts, event_id, value / med AS ratio, CASE WHEN value / med >= 1.5 THEN 'slow' WHEN value / med <= 0.5 THEN 'fast' ELSE 'ok' END AS kind FROM events e JOIN m USING (user_id)),
b AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT user_id, CAST(island AS BIGINT) AS island, kind, count(*) AS n, round(avg(ratio), 5) AS mean_ratio FROM i WHERE kind <> 'ok' GROUP BY 1, 2, 3
""")
def q22_region_merge(spark, d):
    ev = load(spark, d, "events", "user_id", "ts", "event_id", "value")
    own = ev.join(ev.groupBy("user_id").agg(F.percentile("value", 0.5).alias("med")), "user_id").withColumn("ratio", F.col("value") / F.col("med"))
    return tempo.regions(own, ["user_id"], EV, "ratio", 1.5, 0.5).select("user_id", F.col("island").cast("long").alias("island"), "kind", "n", F.round("mean_ratio", 5).alias("mean_ratio"))


@query("""
WITH m AS (SELECT *, lag(event_type) OVER w AS lk, lag(event_id) OVER w AS lp FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS closed, lp AS opened FROM m WHERE event_type = 'error' AND lk = 'signup'
""")
def q23_pairing(spark, d):
    ev = load(spark, d, "events", "user_id", "ts", "event_id", "event_type")
    return timeline.paired(ev, ["user_id"], EV, "event_type", "signup", "error", "event_id").select("user_id", F.col("event_id").alias("closed"), "opened")


@query("""
WITH k AS (SELECT s_suppkey, 'No ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'a' END || s_nationkey AS name FROM supplier),
n AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), '') AS nat FROM k)
SELECT s_suppkey, name, nat AS natural_key, row_number() OVER (ORDER BY nat, s_suppkey) AS place FROM n
""")
def q24_natural_sort(spark, d):
    name = F.concat(F.lit("No "), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "B").otherwise("a"), F.col("s_nationkey"))
    own = load(spark, d, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", name.alias("name")).withColumn("natural_key", islands.natural_key(F.col("name")))
    return islands.numbered(own, ["natural_key", "s_suppkey"], "place").select("s_suppkey", "name", "natural_key", "place")


@query("""
WITH k AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS played FROM lineitem GROUP BY 1), x AS (SELECT *, [1, 2, 3, 4, 5, 6, 7] AS expected FROM k)
SELECT l_orderkey, array_to_string(list_filter(expected, lambda e: NOT list_contains(played, e)), ',') AS missing,
  array_to_string(list_filter(played, lambda e: e % 2 = 1), ',') AS kept FROM x
""")
def q25_set_difference(spark, d):
    played = load(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("played"))
    missing = F.array_except(F.array(*map(F.lit, range(1, 8))), "played")
    return played.select("l_orderkey", F.array_join(missing, ",").alias("missing"), F.array_join(F.filter("played", lambda e: e % 2 == 1), ",").alias("kept"))


@query("""
WITH u AS (SELECT c_custkey AS id, c_name AS label, 1 AS src FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT n_nationkey, n_name, 3 FROM nation),
f AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, label) AS r FROM u) WHERE r = 1)
SELECT id, label FROM f ORDER BY id DESC LIMIT 30
""")
def q27_dedupe_union(spark, d):
    parts = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name")]
    frames = [load(spark, d, t, k, n).select(F.col(k).cast("long").alias("id"), F.col(n).alias("label"), F.lit(i).alias("src")) for i, (t, k, n) in enumerate(parts)]
    both = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return consensus.first_of(both, ["id"], ["src", "label"]).select("id", "label").orderBy(F.desc("id")).limit(30)


@query("""
WITH b AS (SELECT DISTINCT l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
m AS (SELECT n, q, 12 * (n + 1) + [0, 2, 4, 5, 7, 9, 11][n] AS midi FROM b)
SELECT n, q, midi, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][midi % 12 + 1] || CAST(midi // 12 - 1 AS VARCHAR) AS name,
  round(440 * power(2, (midi - 69) / 12), 6) AS hz, round(20 * log10(q / 7), 6) AS db, greatest(0.5, least(5.0, q / 10)) AS clipped,
  CAST(least(q, 30) - greatest(n, 10) AS INTEGER) AS overlap, CAST(floor(q * 4 * 2 / 8) AS BIGINT) AS bar_floor, round(q * 4.0 / 8, 6) AS bar_float FROM m
""")
def q28_scalars(spark, d):
    own = load(spark, d, "lineitem", "l_linenumber", "l_quantity").select(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")).distinct()
    step = F.element_at(F.array(*map(F.lit, "CDEFGAB")), F.col("n"))
    own = own.withColumn("midi", S.midi(step, F.col("n"), F.lit("0")))
    return own.select(
        "n", "q", "midi", S.note_name(F.col("midi")).alias("name"), F.round(S.hertz(F.col("midi")), 6).alias("hz"), F.round(S.decibel(F.col("q"), F.lit(7)), 6).alias("db"),
        S.clip(F.col("q") / 10, 0.5, 5.0).alias("clipped"), S.overlap(F.col("n"), F.lit(30), F.lit(10), F.col("q")).cast("int").alias("overlap"),
        S.bar_length(F.col("q"), F.lit(8), F.lit(2)).alias("bar_floor"), F.round(S.bar_length(F.col("q"), F.lit(8), F.lit(1), "float"), 6).alias("bar_float"),
    )


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_type":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS state FROM events
""")
def q29_json_state(spark, d):
    ev = load(spark, d, "events", "event_id", "event_type", "props").withColumn("k", F.from_json("props", "k long")["k"])
    return ev.select("event_id", "k", F.to_json(F.struct("event_type", "k")).alias("state"))


@query("""
WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, s, CAST(list_reduce(list_transform(s, lambda x: CAST(x AS BIGINT)), lambda a, b: lcm(a, b)) AS BIGINT) AS m FROM g)
SELECT l_orderkey, m AS divisions, array_to_string(list_transform(s, lambda x: m // x), ',') AS factors FROM m
""")
def q30_normalised_lcm(spark, d):
    sets = load(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("s"))
    # few sets differ, so each is folded once
    own = sets.join(sets.select("s").distinct().withColumn("divisions", S.least_common_multiple(F.col("s"))), "s")
    return own.select("l_orderkey", "divisions", F.array_join(F.transform("s", lambda x: F.floor(F.col("divisions") / x)), ",").alias("factors"))


@query("""
WITH r AS (SELECT user_id, ts, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
SELECT user_id, event_id, value FROM r WHERE top IS NULL OR value > top
""")
def q32_increasing(spark, d):
    return timeline.increasing(load(spark, d, "events", "user_id", "ts", "event_id", "value"), ["user_id"], EV, "value").select("user_id", "event_id", "value")


@query("""
WITH p AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS page, count(*) AS bars FROM orders GROUP BY 1, 2)
SELECT o_custkey, page, bars, CAST(coalesce(sum(bars) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p
""")
def q33_page_offsets(spark, d):
    page = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz").alias("page")
    pages = load(spark, d, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey", page).agg(F.count("*").alias("bars"))
    return timeline.offsets(pages, ["o_custkey"], ["page"], "bars").select("o_custkey", "page", "bars", F.col("offset").cast("long").alias("offset"))


@query("""
WITH c AS (SELECT s.event_id AS sign, n.event_id AS note, abs(CAST(round(n.value * 100) AS BIGINT) - CAST(round(s.value * 100) AS BIGINT)) AS gap
  FROM events s JOIN events n ON s.user_id = n.user_id AND day(s.ts) = day(n.ts) WHERE s.event_type = 'error' AND n.event_type = 'view'),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY gap, note) AS r FROM c) WHERE r = 1)
SELECT sign, note, gap FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY gap, sign) AS r2 FROM a) WHERE r2 = 1
""")
def q34_exclusive_nearest(spark, d):
    ev = load(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("day", F.dayofmonth("ts")).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    signs = ev.where("event_type = 'error'").select("user_id", "day", F.col("event_id").alias("sign"), F.col("c").alias("x"))
    notes = ev.where("event_type = 'view'").select("user_id", "day", F.struct(F.col("event_id").alias("note"), F.col("c").alias("y")).alias("near"), F.col("c").alias("y"))
    found = joins.nearest(signs, notes, ["user_id", "day"], "x", "y", "near", "of").where("of is not null")
    return joins.exclusive(found.select("sign", F.col("of.note").alias("note"), F.abs(F.col("of.y") - F.col("x")).alias("gap")), "sign", "note", "gap")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, o_custkey, 0.0 FROM orders WHERE o_orderstatus = 'P'
""")
def q35_upsert(spark, d):
    orders = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    new = orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)).drop("o_orderstatus")
    return joins.upsert(orders.drop("o_orderstatus"), new, ["o_custkey"])


@query("""
WITH v AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_quantity) AS q, max(l_linenumber) AS e FROM lineitem GROUP BY 1, 2)
SELECT o, s, abs(q - 25) < 1e-6 AS vote_valid, q < 25 AS pad, CAST(greatest(0, 25 - q) AS DOUBLE) AS padding, q > 25 + 1e-6 AS over FROM v
""")
def q36_rhythm_variants(spark, d):
    v = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"))
    full = F.lit(25.0)
    return v.select("o", "s", rhythm.vote_valid(F.col("q"), full).alias("vote_valid"), (F.col("q") < full).alias("pad"), rhythm.padding(F.col("q"), full).alias("padding"), rhythm.overfull(F.col("q"), full).alias("over"))


@query("""
SELECT event_id, CASE WHEN value > 300 THEN 'blue' WHEN event_type = 'error' THEN 'red' WHEN value < 20 THEN 'orange' END AS colour FROM events
""")
def q37_confidence_colour(spark, d):
    ev = load(spark, d, "events", "event_id", "event_type", "value")
    return ev.select("event_id", rhythm.colour(F.col("value") > 300, F.col("event_type") == "error", F.col("value") < 20).alias("colour"))


@query("""
WITH m AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
a AS (SELECT conv_id, role, count(*) AS turns, quantile_cont(n, 0.5) AS med, max(n) AS longest FROM m GROUP BY 1, 2)
SELECT conv_id, role, turns, round(med, 3) AS med, CAST(longest AS BIGINT) AS longest FROM a
""")
def q38_piece_summary(spark, d):
    own = load(spark, d, "conversations", "conv_id", "role", "text").withColumn("n", F.length("text"))
    return own.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.round(F.percentile("n", 0.5), 3).alias("med"), F.max("n").cast("long").alias("longest"))


def _streamed(spark, d):
    from cadenza.streaming import replay

    return replay.closed_sessions(spark, d)


@query(f'''WITH {SESSIONS} SELECT user_id, "begin", "end", n FROM s WHERE "end" + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)''')
def q31_stream_equals_batch(spark, d):
    return _streamed(spark, d)


@query(None)
def q26_alignment(spark, d):
    """Each user's purchases are expected, in order, in the user's clicks: values that round to the same ten count as present."""
    from cadenza.operators import align

    ev = load(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value").withColumn("tens", F.floor(F.col("value") / 10).cast("long"))
    return align.aligned(ev.where("event_type = 'purchase'").select("user_id", "ts", "tens"), ev.where("event_type = 'click'").select("user_id", "ts", "tens"), "user_id", "ts", "tens")


@query(None)
def q39_substitutions(spark, d):
    """What an order's line numbers lack of 1..7 against what its supplier digits have beyond: nearest pairs, greedily."""
    from cadenza.operators import judge

    items = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    sets = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("expected"), F.array_sort(F.collect_set((F.col("l_suppkey") % 12).cast("int"))).alias("heard"))
    return judge.judged(sets, "l_orderkey", "expected", "heard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
