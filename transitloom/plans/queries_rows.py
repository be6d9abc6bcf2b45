"""Queries of rows, joins, aggregates, windows, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from transitloom.functions import geo, text, times
from transitloom.operators import aggregates as agg
from transitloom.operators import rows
from transitloom.plans.catalogue import query
from transitloom.plans.frames import order_nations

@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(t, spark):
    return rows.keep_last(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def keep_first(t, spark):
    return rows.keep_first(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def exactly_once(t, spark):
    return rows.exactly_once(t("lineitem").select("l_suppkey", "l_partkey"))


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def full_distinct(t, spark):
    return t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS id FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def surrogate_ids(t, spark):
    return rows.surrogate_key(t("part").select("p_brand", "p_type").distinct(), "id", ["p_brand", "p_type"])


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def factorize(t, spark):
    return rows.dense_codes(t("part").select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "code")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority LIKE '1%'")
def range_filter(t, spark):
    return t("orders").where(F.col("o_totalprice").between(1000, 50000) & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS INT) AS arr, CAST(l_quantity AS INT) + l_linenumber AS dep FROM lineitem WHERE CAST(l_quantity AS INT) - 10 >= 0 AND CAST(l_quantity AS INT) + l_linenumber <= 45")
def chained_comparison(t, spark):
    x = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").cast("int").alias("arr"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("dep"))
    return x.where(rows.ordered_times(F.col("arr") - 10, F.col("dep") - 10, 35))


@query("SELECT p_partkey, CASE WHEN p_size IN (2) THEN TRUE WHEN p_size IN (3) THEN FALSE END AS rail, CASE WHEN p_size = 2 THEN 2 ELSE 3 END AS route_type FROM part")
def route_types(t, spark):
    rail = rows.rail_flag(F.col("p_size"))
    return t("part").select("p_partkey", rail.alias("rail"), rows.export_route_type(rail).alias("route_type"))


@query("SELECT d.doc_id, d.lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_agency(t, spark):
    return t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@query("SELECT d.doc_id, source, n FROM (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def right_segments(t, spark):
    n = t("labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.join(t("documents"), "doc_id", "right").select("doc_id", "source", "n")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_known(t, spark):
    return t("documents").select("doc_id", "lang").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_unknown(t, spark):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left_anti")


@query("SELECT a.n_nationkey AS src, b.n_nationkey AS trg FROM nation a, nation b WHERE a.n_regionkey = 1 AND b.n_regionkey = 2")
def filtered_cross(t, spark):
    n = t("nation")
    a = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("src"))
    return a.crossJoin(n.where("n_regionkey = 2").select(F.col("n_nationkey").alias("trg")))  # two small slices of nation


@query("SELECT a.n_name AS hub_x, b.n_name AS hub_y, a.n_regionkey AS region FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def hub_self_join(t, spark):
    n = t("nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("hub_x"), F.col("n_nationkey").alias("x")), n.select("n_regionkey", F.col("n_name").alias("hub_y"), F.col("n_nationkey").alias("y"))
    return a.join(b, "n_regionkey").where("x <> y").select("hub_x", "hub_y", F.col("n_regionkey").alias("region"))


@query("SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def validated_lookup(t, spark):
    n, r = t("nation").withColumnRenamed("n_nationkey", "s_nationkey"), t("region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = rows.many_to_one(rows.many_to_one(t("supplier"), n, ["s_nationkey"]), r, ["n_regionkey"])
    return joined.select("s_suppkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


LOOKUP = "(VALUES ('1-URGENT', 'Urgent'), ('2-HIGH', 'High'), ('3-MEDIUM', 'Medium')) v(k, name)"


def priorities(spark):
    return spark.createDataFrame([("1-URGENT", "Urgent"), ("2-HIGH", "High"), ("3-MEDIUM", "Medium")], "k string, name string")


@query(f"SELECT o_orderkey, name AS label FROM orders LEFT JOIN {LOOKUP} ON o_orderpriority = k")
def map_lookup(t, spark):
    return rows.lookup(t("orders").select("o_orderkey", "o_orderpriority"), priorities(spark), "o_orderpriority", "k", "name", "label").select("o_orderkey", "label")


@query(f"SELECT o_orderkey, coalesce(name, o_orderpriority) AS label FROM orders LEFT JOIN {LOOKUP} ON o_orderpriority = k")
def redirect_lookup(t, spark):
    return rows.lookup(t("orders").select("o_orderkey", "o_orderpriority"), priorities(spark), "o_orderpriority", "k", "name", "label", keep_missing=True).select("o_orderkey", "label")


@query("SELECT doc_id, n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1) USING (doc_id)")
def reindexed_counts(t, spark):
    n = t("labels").where("toxic = 1").groupBy("doc_id").agg(F.count("*").alias("n"))
    return rows.reindexed(t("documents").select("doc_id"), n, ["doc_id"])


@query("SELECT c_nationkey AS nation, round(sum(c_custkey * (c_acctbal + 1000)) / sum(c_acctbal + 1000), 4) AS cx, round(sum((c_custkey % 100) * (c_acctbal + 1000)) / sum(c_acctbal + 1000), 4) AS cy FROM customer GROUP BY 1")
def weighted_centroid(t, spark):
    from transitloom.operators.spatial import weighted_centroid as centroid

    p = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("x"), (F.col("c_custkey") % 100).alias("y"), (F.col("c_acctbal") + 1000).alias("w"))
    return centroid(p, ["nation"], "w").select("nation", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@query("SELECT c_nationkey AS nation, round(sum(CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50) * (c_acctbal + 1000) END) / sum(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal + 1000 END), 4) AS time FROM customer GROUP BY 1")
def weighted_access_mean(t, spark):
    cell = t("customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 50).alias("time"), (F.col("c_acctbal") + 1000).alias("popu"))
    return cell.groupBy("nation").agg(F.round(agg.weighted_mean(F.col("time"), F.col("popu")), 4).alias("time"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_types, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 2")
def distinct_having(t, spark):
    return t("events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_types"), F.count("*").alias("n")).where("n_types >= 2")


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, count(*) AS n FROM orders GROUP BY 1")
def first_and_last(t, spark):
    at = F.struct("o_orderdate", "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"), F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), x AS (SELECT DISTINCT o_custkey, l_suppkey FROM s JOIN orders ON l_orderkey = o_orderkey) SELECT o_custkey, array_to_string(list(l_suppkey ORDER BY l_suppkey), ',') AS suppliers FROM x GROUP BY 1")
def set_union(t, spark):
    s = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return s.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.array_join(agg.set_union(F.col("s")), ",").alias("suppliers"))


@query("WITH c AS (SELECT l_suppkey, l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT s_nationkey, p_brand, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT s_nationkey, array_to_string(list(p_brand ORDER BY n DESC, p_brand), ' | ') AS names FROM b GROUP BY 1")
def names_by_freq(t, spark):
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return agg.names_by_frequency(x.select("s_nationkey", "p_brand"), ["s_nationkey"], "p_brand")


@query("SELECT s_nationkey, array_to_string(list_slice(list_sort(list(DISTINCT p_type)), 1, 5), ',') AS types FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def first_k_sorted(t, spark):
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("s_nationkey").agg(text.first_sorted(F.collect_set("p_type"), 5).alias("types"))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_large FROM events GROUP BY 1")
def value_counts(t, spark):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"))


KINDS = ("view", "click", "purchase", "signup", "error")


@query("SELECT user_id, " + ", ".join(f"count_if(event_type = '{k}') > 0 AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def presence_pivot(t, spark):
    return agg.presence(t("events"), "user_id", "event_type", KINDS)


@query("SELECT DISTINCT user_id, event_type AS kind FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error')")
def incidence_long(t, spark):
    return agg.incidence(agg.presence(t("events"), "user_id", "event_type", KINDS), "user_id", KINDS, "kind")


@query("SELECT n_nationkey, 'name' AS field, n_name AS code FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation")
def melt_codes(t, spark):
    n = t("nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return n.unpivot("n_nationkey", ["name", "region"], "field", "code")


@query("SELECT s_nationkey AS src, p_brand AS mode, CAST(median(l_quantity) AS DOUBLE) AS med, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def median_by_key(t, spark):
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("s_nationkey").alias("src"), F.col("p_brand").alias("mode")).agg(F.median("l_quantity").alias("med"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("WITH a AS (SELECT c_nationkey AS n, o_custkey, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), b AS (SELECT n, k, count(*) AS m FROM a GROUP BY ALL) SELECT n, array_to_string(list(k || ':' || m ORDER BY k), ',') AS shape FROM b GROUP BY n")
def multi_level_regroup(t, spark):
    a = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n"), "o_custkey").agg(F.count("*").alias("k"))
    b = a.groupBy("n", "k").agg(F.count("*").alias("m"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda e: F.concat_ws(":", e["k"].cast("string"), e["m"].cast("string")))
    return b.groupBy("n").agg(F.array_join(s, ",").alias("shape"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def date_span(t, spark):
    return t("events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("SELECT l_orderkey, l_suppkey, n FROM (SELECT l_orderkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n > 5")
def group_size_filter(t, spark):
    return t("lineitem").select("l_orderkey", "l_suppkey", F.count("*").over(Window.partitionBy("l_orderkey")).alias("n")).where("n > 5")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos FROM events")
def position_in_sequence(t, spark):
    return t("events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("pos"))


@query("SELECT lang, doc_id FROM documents WHERE lang = 'de' UNION SELECT lang, doc_id FROM documents WHERE n_chars < 900")
def set_ops_union(t, spark):
    d = t("documents").select("lang", "doc_id", "n_chars")
    return d.where("lang = 'de'").select("lang", "doc_id").union(d.where("n_chars < 900").select("lang", "doc_id")).distinct()


@query("(SELECT doc_id FROM documents WHERE lang = 'de' INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_ops(t, spark):
    ids = t("documents").where("lang = 'de'").select("doc_id")
    return ids.intersect(t("labels").select("doc_id")).subtract(t("labels").where("toxic = 1").select("doc_id"))


@query("SELECT c_custkey AS id, 'Access' AS kind, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, 'Egress', NULL, s_name FROM supplier")
def union_links(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.lit("Access").alias("kind"), F.col("c_acctbal").alias("bal"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("Egress").alias("kind"), F.col("s_name").alias("name"))
    return rows.union_all(a, b)


@query("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, value) AS k FROM (SELECT doc_id AS key, quality AS value, 0 AS src FROM labels UNION ALL SELECT doc_id, n_chars, 1 FROM documents)) WHERE k = 1")
def union_by_key(t, spark):
    a = t("labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("long").alias("value"))
    b = t("documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("value"))
    return rows.union_distinct([a, b], ["key"])


@query("SELECT c_nationkey AS nation, min_by(c_custkey, (abs(c_acctbal - 5000), c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def arg_min(t, spark):
    return t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min_by("c_custkey", F.struct(F.abs(F.col("c_acctbal") - 5000), "c_custkey")).alias("c_custkey"))


@query(
    "SELECT p_partkey, split_part(p_type, ' ', 1) AS head, trim(p_name, ' |p') AS stripped, coalesce(p_brand, '') || ' | ' || coalesce(p_type, '') AS joined, 'FUA_' || lpad(p_partkey::VARCHAR, CAST(greatest(3, length(p_partkey::VARCHAR)) AS INT), '0') AS node, replace(p_brand, 'Brand#', '') AS code, contains(p_name, CAST(p_size % 10 AS VARCHAR)) AS has_digit, regexp_matches(replace(p_brand, 'Brand#', ''), '^[0-9]+$') AS digits FROM part"
)
def string_ops(t, spark):
    return t("part").select(
        "p_partkey", text.split_take(F.col("p_type"), " ").alias("head"), text.strip_chars(F.col("p_name"), " |p").alias("stripped"), text.concat_nulls_empty(" | ", F.col("p_brand"), F.col("p_type")).alias("joined"),
        text.padded_id("FUA_", F.col("p_partkey"), 3).alias("node"), text.without(F.col("p_brand"), "Brand#").alias("code"), text.has_digit(F.col("p_name"), F.col("p_size") % 10).alias("has_digit"), text.is_digits(text.without(F.col("p_brand"), "Brand#")).alias("digits"),
    )


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS BIGINT) AS n_links, split_part(split_part(url, '://', 2), '/', 1) AS host, list_last(string_split(url, '/')) AS leaf FROM pages")
def xml_title_extract(t, spark):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).cast("long").alias("n_links"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), text.path_leaf(F.col("url")).alias("leaf"))


CLOCK = "lpad((l_partkey % 30)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') || ':' || lpad((l_orderkey % 60)::VARCHAR, 2, '0')"


@query(f"SELECT l_orderkey, {CLOCK} AS clock, CAST((l_partkey % 30) * 3600 + (l_suppkey % 60) * 60 + l_orderkey % 60 AS INT) AS seconds, CAST(((l_partkey % 30) * 3600 + (l_suppkey % 60) * 60 + l_orderkey % 60) // 60 AS INT) AS minutes FROM lineitem")
def time_parse(t, spark):
    part = lambda c, m: F.lpad((F.col(c) % m).cast("string"), 2, "0")
    x = t("lineitem").select("l_orderkey", F.concat_ws(":", part("l_partkey", 30), part("l_suppkey", 60), part("l_orderkey", 60)).alias("clock"))
    s = times.clock_seconds(F.col("clock"))
    return x.select("l_orderkey", "clock", s.alias("seconds"), times.truncated_minutes(s).alias("minutes"))


@query("SELECT o_orderkey, lpad(((o_orderkey % 1800) // 60)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':00' AS clock FROM (SELECT o_orderkey FROM orders)")
def gtfs_time_format(t, spark):
    return t("orders").select("o_orderkey", times.minutes_clock(F.col("o_orderkey") % 1800).alias("clock"))


@query("SELECT o_orderkey, CAST((o_orderkey % 24) * 60 + o_custkey % 60 AS INT) AS minutes FROM orders")
def hhmm_minutes(t, spark):
    return t("orders").select("o_orderkey", times.hhmm_minutes((F.col("o_orderkey") % 24) * 100 + F.col("o_custkey") % 60).alias("minutes"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS code, strftime(o_orderdate, '%Y-%m-%d') AS back, CAST(datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS INT) AS day_offset, CAST(isodow(o_orderdate) - 1 AS INT) AS dow, strftime(o_orderdate::DATE - 1, '%Y-%m-%d') AS day_before FROM orders")
def yyyymmdd_roundtrip(t, spark):
    from datetime import date

    x = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), times.date_code(F.col("o_orderdate")).alias("code"))
    back = times.code_date(F.col("code"))
    return x.select("o_orderkey", "code", back.cast("string").alias("back"), times.day_offset(back, date(1992, 1, 1)).alias("day_offset"), times.monday_index(back).alias("dow"), F.date_sub(back, 1).cast("string").alias("day_before"))


ZONES = {0: "Europe/London", 1: "Europe/Paris", 2: "Europe/Athens", 3: "Not/AZone", 4: "Europe/Helsinki"}


@query("SELECT o_orderkey, zone, CAST(trunc((o_orderkey % 3600 - off * 60) / 60.0) AS INT) AS gmt FROM orders JOIN customer ON o_custkey = c_custkey JOIN (VALUES (0, 'Europe/London', 0), (1, 'Europe/Paris', 60), (2, 'Europe/Athens', 120), (3, 'Not/AZone', NULL), (4, 'Europe/Helsinki', 120)) z(k, zone, off) ON c_nationkey % 5 = k")
def gmt_shift(t, spark):
    from transitloom.params import DEFAULTS

    names = spark.createDataFrame(list(ZONES.items()), "k int, zone string")
    zones = names.join(times.zone_offsets(spark, ZONES.values(), DEFAULTS.tz_reference), "zone")
    x = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(zones, F.col("c_nationkey") % 5 == F.col("k"))
    return x.select("o_orderkey", "zone", times.truncated_minutes(times.to_gmt(F.col("o_orderkey") % 3600, F.col("offset") * 60)).alias("gmt"))


@query("SELECT o_orderkey, CAST(CASE WHEN v < 0 THEN v + 1440 ELSE v END AS INT) AS minute, CASE WHEN v < 0 THEN -1 ELSE 0 END AS day_shift FROM (SELECT o_orderkey, CAST(o_custkey % 1500 - 60 AS INT) AS v FROM orders)")
def day_shift(t, spark):
    v = (F.col("o_custkey") % 1500 - 60).cast("int")
    return t("orders").select("o_orderkey", F.when(v < 0, v + 1440).otherwise(v).alias("minute"), F.when(v < 0, -1).otherwise(0).alias("day_shift"))


LONLAT = "SELECT c_custkey, (c_custkey * 37 % 4000) / 100.0 - 10.0 AS lon, 35.0 + (c_custkey * 53 % 3500) / 100.0 AS lat FROM customer"


def lonlat(t):
    return t("customer").select("c_custkey", ((F.col("c_custkey") * 37 % 4000) / 100.0 - 10.0).alias("lon"), (F.lit(35.0) + (F.col("c_custkey") * 53 % 3500) / 100.0).alias("lat"))


@query(
    f"WITH p AS ({LONLAT}) SELECT c_custkey, CAST(trunc(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(52.0)) / 2), 2) + cos(radians(52.0)) * cos(radians(lat)) * pow(sin(radians(lon - 10.0) / 2), 2))))) AS INT) AS km FROM p"
)
def haversine_links(t, spark):
    return lonlat(t).select("c_custkey", geo.haversine_km(F.lit(10.0), F.lit(52.0), F.col("lon"), F.col("lat")).cast("int").alias("km"))


@query(
    f"""WITH c AS (SELECT 0.00669438002290::DOUBLE AS e2, sqrt(0.00669438002290::DOUBLE) AS e, 6378137.0::DOUBLE AS a, radians(52.0) AS p0), k AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp, (1 - e2) * (sin(p0) / (1 - e2 * sin(p0) * sin(p0)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0 FROM c),
  m AS (SELECT *, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq FROM k), n AS (SELECT *, a * cos(p0) / sqrt(1 - e2 * sin(p0) * sin(p0)) / (rq * cos(b0)) AS d FROM m),
  p AS ({LONLAT}), s AS (SELECT *, asin(((1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) * sin(radians(lat))) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e))) / qp) AS b, radians(lon - 10.0) AS l FROM p, n),
  u AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l))) AS bb FROM s)
  SELECT c_custkey, round(4321000 + bb * d * cos(b) * sin(l), 2) AS x, round(3210000 + bb / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l)), 2) AS y FROM u"""
)
def laea_project(t, spark):
    x, y = geo.project(F.col("lon"), F.col("lat"))
    return lonlat(t).select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("SELECT s_suppkey, CASE WHEN hi = lo THEN 0 ELSE round((s_acctbal - lo) / (hi - lo), 6) END AS scaled FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def minmax_normalise(t, spark):
    s = t("supplier")
    bounds = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    return s.crossJoin(F.broadcast(bounds)).select("s_suppkey", F.round(geo.scaled(F.col("s_acctbal"), F.col("lo"), F.col("hi")), 6).alias("scaled"))  # bounds is one row


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(props) AS hash FROM events")
def json_and_hash(t, spark):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.sha2("props", 256).alias("hash"))


@query("SELECT l_orderkey, round(l_extendedprice / 1000.0, 5) AS km, round(l_quantity * 60 / 60.0, 3) AS minutes, coalesce(nullif(trim(l_returnflag), 'N'), 'none') AS flag FROM lineitem")
def unit_conversions(t, spark):
    return t("lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") / 1000, 5).alias("km"), F.round(F.col("l_quantity") * 60 / 60, 3).alias("minutes"), F.coalesce(F.nullif(F.trim("l_returnflag"), F.lit("N")), F.lit("none")).alias("flag"))


@query(
    """SELECT "check", CAST(violations AS BIGINT) AS violations FROM (SELECT 'null_key' AS "check", count_if(l_orderkey IS NULL) AS violations FROM lineitem UNION ALL SELECT 'repeated_key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'range', count_if(NOT (l_discount BETWEEN 0 AND 0.05)) FROM lineitem UNION ALL SELECT 'foreign_key', count_if(l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 10)) FROM lineitem) """
)
def source_checks(t, spark):
    from transitloom.operators import checks

    li = t("lineitem")
    return checks.report(
        {
            "null_key": checks.nulls(li, "l_orderkey"),
            "repeated_key": checks.repeated(li, ["l_orderkey", "l_linenumber"]),
            "range": checks.outside(li, "l_discount", 0, 0.05),
            "foreign_key": checks.unknown(li, "l_suppkey", t("supplier").where("s_suppkey > 10"), "s_suppkey"),
        }
    )


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE value < prev")
def order_violations(t, spark):
    from transitloom.operators import checks

    return checks.unordered(t("events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id")


@query("SELECT src, trg, count(*) AS n FROM (SELECT c_nationkey AS src, s_nationkey AS trg FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL")
def od_matrix(t, spark):
    return order_nations(t).groupBy("src", "trg").agg(F.count("*").alias("n"))
