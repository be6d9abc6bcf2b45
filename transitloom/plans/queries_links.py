"""Queries of journeys, links and calendars.

Stand-ins: orders are journeys, line items stop events, suppliers stops, nations stations and regions countries; a
user of `events` is a service and the days of its events are its dates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from transitloom.functions import times
from transitloom.operators import aggregates as agg
from transitloom.operators import calendar, rows, sequences
from transitloom.plans.catalogue import query
from transitloom.plans.frames import ORDER, journeys, order_nations, service_days

EV = """WITH ev AS (SELECT l_orderkey AS trip, s_nationkey AS stn, n_regionkey AS region,
  CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS t, CAST(l_quantity AS INT) AS wait,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
PAIRS = EV + """, p AS (SELECT a.trip, a.stn AS src, b.stn AS trg, a.region AS rs, b.region AS rt, a.t AS dep, b.t AS arr
  FROM ev a JOIN ev b ON a.trip = b.trip AND a.pos < b.pos)"""
STATS = "count(*) AS nservices, round(avg(arr - dep), 6) AS avg_time, CAST(median(arr - dep) AS DOUBLE) AS median_time, round(stddev_samp(arr - dep), 6) AS std_time"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def timetable(t, **options):
    return sequences.timetable_pairs(journeys(t), "trip", ORDER, "stn", "t", "t", **options)


@query(PAIRS + f" SELECT src, trg, {STATS} FROM p GROUP BY src, trg")
def pspace_links(t, spark):
    return rounded(agg.link_statistics(timetable(t), ["src", "trg"], F.col("arr") - F.col("dep")), "avg_time", "std_time")


@query(PAIRS + " SELECT trip, src, trg, dep, arr FROM p WHERE src <> trg AND arr > dep")
def pspace_timetable(t, spark):
    return timetable(t, drop_self=True, positive_only=True)


@query(PAIRS + f" SELECT src, trg, {STATS}, round(count(*) / 1461.0, 6) AS avg_freq FROM p WHERE src <> trg GROUP BY src, trg")
def pspace_frequency(t, spark):
    from transitloom.params import DEFAULTS

    return rounded(agg.link_statistics(timetable(t, drop_self=True), ["src", "trg"], F.col("arr") - F.col("dep"), DEFAULTS.total_days), "avg_time", "std_time", "avg_freq")


@query(
    PAIRS
    + """, w AS (SELECT p.*, CAST(floor(o_totalprice) AS BIGINT) % 5 + 1 AS days FROM p JOIN orders ON trip = o_orderkey),
  x AS (SELECT src, trg, arr - dep AS tm FROM w, range(days))
  SELECT src, trg, count(*) AS nservices, round(avg(tm), 6) AS avg_time, CAST(median(tm) AS DOUBLE) AS median_time, round(stddev_samp(tm), 6) AS std_time, round(count(*) / 1461.0, 6) AS avg_freq FROM x GROUP BY src, trg"""
)
def pspace_weighted_freq(t, spark):
    days = t("orders").select(F.col("o_orderkey").alias("trip"), (F.floor("o_totalprice").cast("long") % 5 + 1).alias("days"))
    pairs = timetable(t).join(days, "trip").select("src", "trg", (F.col("arr") - F.col("dep")).alias("tm"), "days")
    return rounded(agg.weighted_link_statistics(pairs, ["src", "trg"], "tm", "days", 1461), "avg_time", "std_time", "avg_freq")


@query(PAIRS + ", d AS (SELECT src, trg, dep, count(*) AS n FROM p GROUP BY ALL) SELECT src, trg, CAST(median(n) AS DOUBLE) AS med_active_freq FROM d GROUP BY src, trg")
def active_day_frequency(t, spark):
    return agg.active_frequency(timetable(t), ["src", "trg"], "dep")


@query(EV + " SELECT trip, array_to_string(list(stn ORDER BY pos), ',') AS stops, array_to_string(list(t - t0 ORDER BY pos), ',') AS rel FROM (SELECT *, first_value(t) OVER (PARTITION BY trip ORDER BY pos) AS t0 FROM ev) GROUP BY trip")
def relative_times(t, spark):
    order = [F.col(c) for c in ORDER]
    g = journeys(t).groupBy("trip").agg(sequences.ordered_list(F.col("stn"), *order).alias("s"), sequences.ordered_list(F.col("t"), *order).alias("a"))
    return g.select("trip", F.array_join("s", ",").alias("stops"), F.array_join(sequences.relative(F.col("a")), ",").alias("rel"))


@query(EV + ", g AS (SELECT trip, array_to_string(list(stn ORDER BY pos), ',') AS seq FROM ev GROUP BY trip) SELECT seq, count(*) AS n FROM g GROUP BY seq")
def line_identify(t, spark):
    return sequences.distinct_sequences(journeys(t), ["trip"], "stn", ORDER).select(F.array_join("seq", ",").alias("seq"), "n")


@query(EV + ", f AS (SELECT trip, stn, min(pos) AS pos FROM ev GROUP BY trip, stn) SELECT trip, array_to_string(list(stn ORDER BY pos), ',') AS stops FROM f GROUP BY trip HAVING count(*) > 1")
def first_visit_dedupe(t, spark):
    first = sequences.first_visits(journeys(t), "trip", ORDER, "stn")
    g = first.groupBy("trip").agg(sequences.ordered_list(F.col("stn"), *[F.col(c) for c in ORDER]).alias("s"))
    return g.where(F.size("s") > 1).select("trip", F.array_join("s", ",").alias("stops"))


@query(EV + " SELECT trip, count(DISTINCT region) AS n_regions FROM ev GROUP BY trip HAVING count(DISTINCT region) >= 2")
def intercity_filter(t, spark):
    return journeys(t).groupBy("trip").agg(F.countDistinct("region").alias("n_regions")).where("n_regions >= 2")


@query(
    EV
    + """, e AS (SELECT a.stn AS src, b.stn AS trg, o_orderstatus = 'F' AS rail FROM ev a JOIN ev b ON a.trip = b.trip AND b.pos = a.pos + 1 JOIN orders ON a.trip = o_orderkey)
  SELECT src, trg, count(*) AS n, CASE WHEN bool_and(rail) THEN 'Rail' WHEN bool_or(rail) THEN 'Both' ELSE 'Bus' END AS mode FROM e GROUP BY src, trg"""
)
def consecutive_segments(t, spark):
    g = journeys(t).groupBy("trip").agg(sequences.ordered_list(F.col("stn"), *[F.col(c) for c in ORDER]).alias("s"))
    o = t("orders").select(F.col("o_orderkey").alias("trip"), (F.col("o_orderstatus") == "F").alias("rail"))
    e = g.join(o, "trip").select("rail", F.inline(sequences.consecutive(F.col("s"))))
    return e.groupBy("src", "trg").agg(F.count("*").alias("n"), agg.mode_label(F.col("rail")).alias("mode"))


@query(
    EV
    + """, g AS (SELECT trip, list(stn ORDER BY pos) AS s FROM ev GROUP BY trip), l AS (SELECT DISTINCT s FROM g), n AS (SELECT s, row_number() OVER (ORDER BY array_to_string(s, ',')) AS line FROM l),
  u AS (SELECT line, s, unnest(range(1, len(s) + 1)) AS i FROM n), p AS (SELECT a.line, a.s[a.i] AS src, b.s[b.i] AS trg, a.i AS i, b.i AS j FROM u a JOIN u b ON a.line = b.line AND a.i < b.i WHERE a.s[a.i] <> b.s[b.i])
  SELECT src, trg, count(*) AS n_pairs, count(DISTINCT line) AS n_lines FROM p GROUP BY src, trg"""
)
def line_pairs(t, spark):
    lines = sequences.distinct_sequences(journeys(t), ["trip"], "stn", ORDER).withColumn("line", F.array_join("seq", ","))
    p = lines.select("line", F.inline(sequences.downstream(F.col("seq")))).where("src <> trg")
    return p.groupBy("src", "trg").agg(F.count("*").alias("n_pairs"), F.countDistinct("line").alias("n_lines"))


@query(
    EV
    + """, x AS (SELECT trip, pos, CASE WHEN wait % 10 = 0 THEN NULL ELSE wait END AS d FROM ev), c AS (SELECT trip, pos, sum(coalesce(d, 0)) OVER w AS cum, sum(CAST(d IS NULL AS INT)) OVER w AS missing FROM x WINDOW w AS (PARTITION BY trip ORDER BY pos))
  SELECT a.trip, a.pos AS i, b.pos AS j, CAST(CASE WHEN a.missing = b.missing THEN b.cum - a.cum END AS BIGINT) AS dist FROM c a JOIN c b ON a.trip = b.trip AND a.pos < b.pos"""
)
def cum_distance_missing(t, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy(*ORDER)
    legs = journeys(t).select("trip", F.row_number().over(w).cast("long").alias("pos"), F.when(F.col("wait") % 10 != 0, F.col("wait")).alias("d"))
    c = sequences.cumulative_pairs(legs, "trip", "pos", "d")
    a = c.select("trip", F.col("pos").alias("i"), F.col("cum").alias("ca"), F.col("missing").alias("ma"))
    b = c.select("trip", F.col("pos").alias("j"), F.col("cum").alias("cb"), F.col("missing").alias("mb"))
    return a.join(b, "trip").where("i < j").select("trip", "i", "j", F.when(F.col("ma") == F.col("mb"), F.col("cb") - F.col("ca")).alias("dist"))


@query(EV + " SELECT trip, pos, t, prev, t - prev AS gap FROM (SELECT trip, pos, t, lag(t + wait) OVER (PARTITION BY trip ORDER BY pos) AS prev FROM ev) WHERE t < prev")
def trip_overlap_check(t, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy(*ORDER)
    x = journeys(t).select("trip", F.row_number().over(w).cast("long").alias("pos"), "t", F.lag(F.col("t") + F.col("wait")).over(w).alias("prev"))
    return x.where("t < prev").withColumn("gap", F.col("t") - F.col("prev"))


@query(EV + ", d AS (SELECT DISTINCT stn, trip FROM ev), c AS (SELECT trip, list(stn ORDER BY stn) AS s FROM d GROUP BY trip HAVING count(*) > 1) SELECT a.stn AS u, b.stn AS v, count(*) AS n FROM d a JOIN d b ON a.trip = b.trip AND a.stn < b.stn GROUP BY 1, 2")
def undirected_pairs(t, spark):
    p = timetable(t, drop_self=True)
    u, v = sequences.undirected(F.col("src"), F.col("trg"))
    return p.select("trip", u.alias("u"), v.alias("v")).distinct().groupBy("u", "v").agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT DISTINCT p_brand AS provider, s_nationkey AS src, c_nationkey AS trg, o_orderstatus AS mode FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  n AS (SELECT mode, provider, count(*) AS n_items FROM o GROUP BY ALL),
  r AS (SELECT o.mode, o.provider, row_number() OVER (PARTITION BY o.mode, src, trg ORDER BY n_items DESC, o.provider) AS k FROM o JOIN n USING (mode, provider))
  SELECT n.mode, n.provider, n_items, count(k) AS n_new FROM n LEFT JOIN r ON n.mode = r.mode AND n.provider = r.provider AND k = 1 GROUP BY ALL"""
)
def coverage_rank(t, spark):
    o = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    items = o.select(F.col("o_orderstatus").alias("mode"), F.col("p_brand").alias("provider"), F.struct("s_nationkey", "c_nationkey").alias("item"))
    return agg.coverage(items, "mode", "provider", "item")


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), s AS (SELECT user_id, array_to_string(list(strftime(day, '%Y-%m-%d') ORDER BY day), ',') AS dates FROM d GROUP BY user_id),
  i AS (SELECT dates, row_number() OVER (ORDER BY dates) - 1 AS dateset FROM (SELECT DISTINCT dates FROM s)) SELECT user_id, dateset, dates FROM s JOIN i USING (dates)"""
)
def service_datesets(t, spark):
    ids, of = calendar.datesets(service_days(t).withColumnRenamed("day", "date"))
    joined = of.join(ids, "dateset")
    return joined.select(F.col("service").alias("user_id"), "dateset", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


SETS = """WITH e AS (SELECT DISTINCT user_id AS service, CAST(ts AS DATE) AS day, event_type AS k FROM events), a AS (SELECT service, day FROM e WHERE k = 'view'), b AS (SELECT service, day FROM e WHERE k = 'click'), c AS (SELECT service, day FROM e WHERE k = 'purchase')"""


def three_kinds(t):
    e = t("events").select(F.col("user_id").alias("service"), F.to_date("ts").alias("date"), "event_type")
    return [e.where(F.col("event_type") == k).select("service", "date") for k in ("view", "click", "purchase")]


@query(SETS + " SELECT service, strftime(day, '%Y-%m-%d') AS day FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT SELECT * FROM c)")
def calendar_setdiff(t, spark):
    return calendar.combined(*three_kinds(t)).select("service", F.col("date").cast("string").alias("day"))


@query(SETS + " SELECT service, strftime(day, '%Y-%m-%d') AS day FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY service, day HAVING count(*) = 1")
def calendar_symdiff(t, spark):
    return calendar.combined(*three_kinds(t), mode="symdiff").select("service", F.col("date").cast("string").alias("day"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_custkey % 21 AS INT) AS n, CAST(o_custkey % 7 AS INT) AS m FROM orders),
  d AS (SELECT id, m, CAST(s + CAST(g AS INT) AS DATE) AS day FROM o, range(0, 21) r(g) WHERE g <= n) SELECT id, strftime(day, '%Y-%m-%d') AS day FROM d WHERE (isodow(day) - 1 + m) % 3 <> 0"""
)
def weekday_calendar_expand(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("s"), (F.col("o_custkey") % 21).cast("int").alias("n"), (F.col("o_custkey") % 7).cast("int").alias("m"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: ((d + F.col("m")) % 3 != 0).cast("int"))
    return o.select("id", F.explode(calendar.active_dates(F.col("s"), F.date_add("s", F.col("n")), mask)).alias("day")).select("id", F.col("day").cast("string").alias("day"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_custkey % 15 AS INT) AS n, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS ops FROM orders)
  SELECT id, count(*) AS n_days, strftime(min(s + CAST(g AS INT)), '%Y-%m-%d') AS first_day FROM o, range(0, 15) r(g) WHERE g <= n AND contains(ops, CAST(isodow(s + CAST(g AS INT)) AS VARCHAR)) GROUP BY id"""
)
def flight_ops_days(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("s"), (F.col("o_custkey") % 15).cast("int").alias("n"), F.floor("o_totalprice").cast("long").cast("string").alias("ops"))
    d = o.select("id", calendar.op_days_dates(F.col("s"), F.date_add("s", F.col("n")), F.col("ops")).alias("days")).where(F.size("days") > 0)
    return d.select("id", F.size("days").cast("long").alias("n_days"), F.array_min("days").cast("string").alias("first_day"))


@query("WITH s AS (SELECT conv_id, array_to_string(list(role ORDER BY turn, text), '>') AS seq FROM conversations GROUP BY conv_id) SELECT seq, count(*) AS n FROM s GROUP BY seq")
def stop_sequences(t, spark):
    return sequences.distinct_sequences(t("conversations"), ["conv_id"], "role", ["turn", "text"]).select(F.array_join("seq", ">").alias("seq"), "n")


@query(
    """WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT user_id, event_id, CAST(s - min(s) OVER (PARTITION BY user_id) AS BIGINT) AS rel FROM e"""
)
def seconds_since_first(t, spark):
    from pyspark.sql import Window

    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t("events").select("user_id", "event_id", (s - F.min(s).over(Window.partitionBy("user_id"))).alias("rel"))


@query(
    PAIRS
    + """, h AS (SELECT trip, CAST(median(t) AS INT) AS med, stn, region FROM ev GROUP BY trip, stn, region),
  q AS (SELECT a.stn AS src, b.stn AS trg, a.med AS dep, b.med AS arr FROM h a JOIN h b ON a.trip = b.trip AND a.region = b.region AND a.stn <> b.stn AND b.med > a.med)
  SELECT src, trg, """.replace("CAST(median(t) AS INT)", "CAST(trunc(median(t)) AS INT)")
    + STATS
    + " FROM q GROUP BY src, trg"
)
def local_pt_links(t, spark):
    hub = journeys(t).groupBy("trip", "stn", "region").agg(F.median("t").cast("int").alias("med"))
    a = hub.select("trip", "region", F.col("stn").alias("src"), F.col("med").alias("dep"))
    b = hub.select("trip", "region", F.col("stn").alias("trg"), F.col("med").alias("arr"))
    pairs = a.join(b, ["trip", "region"]).where("src <> trg and arr > dep")
    return rounded(agg.link_statistics(pairs, ["src", "trg"], F.col("arr") - F.col("dep")), "avg_time", "std_time")


@query(
    """WITH f AS (SELECT o_orderkey AS id, c_nationkey AS src, s_nationkey AS trg, CAST(l_quantity AS INT) * 20 % 1440 AS dm, (CAST(l_quantity AS INT) * 20 + l_linenumber * 35) % 1440 AS am, CAST(l_shipdate AS DATE) AS day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
  g AS (SELECT src, trg, (am - 60 * (trg % 3)) - (dm - 60 * (src % 3)) AS tm FROM f)
  SELECT src, trg, count(*) AS nservices, round(avg(tm), 6) AS avg_time, CAST(median(tm) AS DOUBLE) AS median_time, round(stddev_samp(tm), 6) AS std_time FROM g GROUP BY src, trg"""
)
def air_links(t, spark):
    f = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    hhmm = lambda m: F.floor(m / 60) * 100 + m % 60  # noqa: E731  as a schedule states it
    dm, am = F.col("l_quantity").cast("int") * 20 % 1440, (F.col("l_quantity").cast("int") * 20 + F.col("l_linenumber") * 35) % 1440
    f = f.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("trg"), hhmm(dm).alias("dep"), hhmm(am).alias("arr"))
    gmt = lambda c, e: times.to_gmt(times.hhmm_minutes(F.col(c)), 60 * (F.col(e) % 3))
    return rounded(agg.link_statistics(f, ["src", "trg"], gmt("arr", "trg") - gmt("dep", "src")), "avg_time", "std_time")


@query("SELECT c_nationkey AS nation, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS last_day, max_by(o_orderkey, o_orderdate::VARCHAR || '|' || lpad(o_orderkey::VARCHAR, 20, '0')) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= DATE '1995-06-30' GROUP BY 1")
def asof_snapshot(t, spark):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "o_orderdate", "o_orderkey")
    got = rows.as_of(o, ["nation"], "o_orderdate", F.lit(date(1995, 6, 30)), ["o_orderkey"])
    return got.select("nation", F.to_date("o_orderdate").cast("string").alias("last_day"), "o_orderkey")


@query(
    """WITH m AS (SELECT c_nationkey AS src, s_nationkey AS trg, min(l_extendedprice) AS tm FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  b AS (SELECT * FROM (VALUES (1, 2, 100.0::DOUBLE), (2, 1, 100.0), (3, 8, 250.0)) x(a, b, cost)), v AS (SELECT l.src, r.trg, l.tm + cost + r.tm AS tm FROM m l JOIN b ON l.trg = b.a JOIN m r ON b.b = r.src)
  SELECT src, trg, round(min(tm), 4) AS tm FROM (SELECT * FROM m UNION ALL SELECT * FROM v) GROUP BY src, trg"""
)
def bridge_compose(t, spark):
    from transitloom.operators.links import compose_via

    m = order_nations(t).groupBy("src", "trg").agg(F.min("l_extendedprice").alias("time"))
    bridges = spark.createDataFrame([(1, 2, 100.0), (2, 1, 100.0), (3, 8, 250.0)], "a int, b int, time double")
    return compose_via(m, bridges, ["time"]).select("src", "trg", F.round("time", 4).alias("tm"))
