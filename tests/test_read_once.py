"""Members and documents are read no more often than needed, and documents stay small."""

import io
import zipfile

import pyspark.sql.functions as F

from transitloom.plans import catalogue, queries_feeds
from transitloom.sources import export, gtfs, netex


def test_trips_of_feeds_are_read_once(spark):
    table = lambda columns, *rows: spark.createDataFrame([("F", *r) for r in rows], ["fid", *columns])
    feeds = export.archives({
        "agency": table(["agency_id", "agency_name", "agency_timezone"], ("A", "a", "Europe/Paris")),
        "stops": table(["stop_id", "stop_name", "stop_lon", "stop_lat"], ("S", "s", "1", "2"), ("T", "t", "1", "3")),
        "routes": table(["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"], ("R", "A", "r", "l", "2"), ("Q", "A", "q", "l", "2")),
        "trips": table(["trip_id", "route_id", "service_id"], ("1", "R", "C"), ("2", "R", "C"), ("3", "Q", "C")),
        "stop_times": table(["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"], *[(k, i, s, f"0{6 + i}:00:00", f"0{6 + i}:01:00") for k in "12" for i, s in ((1, "S"), (2, "T"))]),
        "calendar_dates": table(["service_id", "date", "exception_type"], ("C", "20240103", "1")),
    })
    n = gtfs.normalised(feeds)
    for name in ("trips", "stop_seq", "time_seq"):
        assert "MapInArrow" not in n[name]._jdf.queryExecution().toString()
    assert sorted(r["trip_id"] for r in n["trips"].collect()) == ["1", "2"]
    assert [r["route_id"] for r in n["routes"].collect()] == ["R"]
    assert n["stop_seq"].count() == n["time_seq"].count() == 1


def test_absent_journeys_are_not_searched(spark, tmp_path, monkeypatch):
    body = '<PublicationDelivery><Line id="L"><Name>l</Name></Line>{}<ServiceJourney id="1"><Ref x="VehicleJourney"/><LineRef ref="L"/></ServiceJourney></PublicationDelivery>'
    searched, real = [], netex.elements
    monkeypatch.setattr(netex, "elements", lambda s, p, tag, schema: searched.append(tag) or real(s, p, tag, schema))
    for name, extra, ids in (("a", "", ["1"]), ("b", '<n:VehicleJourney id="2"><LineRef ref="L"/></n:VehicleJourney>', ["1", "2"])):
        searched.clear()
        (tmp_path / f"{name}.xml").write_text(body.format(extra))
        path = str(tmp_path / f"{name}.xml")
        trips, _ = netex.journeys(spark, path, netex.routes(spark, path, "AG"))
        assert sorted(r["trip_id"] for r in trips.collect()) == ids
        assert ("VehicleJourney" in searched) == (len(ids) == 2)


def test_documents_stay_small(spark, monkeypatch):
    monkeypatch.setattr(queries_feeds, "ELEMENTS", 3)
    rows = spark.range(0, 20, 1, 2).select(F.format_string('<StopPointInJourneyPattern id="%s"><QuayRef ref="Q"/></StopPointInJourneyPattern>', "id").alias("value"))
    path = queries_feeds._document(spark, rows)
    texts = [r["value"].split() for r in spark.read.text(path, wholetext=True).collect()]
    assert len(texts) == 8 and all(t[0] == "<PublicationDelivery>" and t[-1] == "</PublicationDelivery>" and len([x for x in t if "<Stop" in x]) <= 3 for t in texts)
    assert sorted(int(r["point"]) for r in netex.pattern_stops(spark, path).collect()) == list(range(20))


def test_routes_need_no_sequences(spark, sf_dir, monkeypatch):
    """Routes of feeds with trips are found without sequences of trips, ids of dates or numbers of either."""

    def none(*a, **k):
        raise AssertionError("a sequence is numbered")

    whole = gtfs.normalised(queries_feeds.archives(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))["routes"]
    want = sorted(tuple(map(str, r)) for r in whole.select("fid", "route_id", "name", "agency", "tz", "mode_id").collect())
    monkeypatch.setattr(gtfs, "surrogate_key", none)
    monkeypatch.setattr(gtfs.calendar, "datesets", none)
    routes = catalogue.QUERIES["feed_routes"](spark, sf_dir)
    assert "collect_list" not in routes._jdf.queryExecution().toString()
    assert sorted(tuple(map(str, r)) for r in routes.collect()) == want and want


def test_ragged_lines_and_empty_cells(spark):
    body = 'b, a,c\n1,"x, ""y""",3,4\n\n2\n3,,""\n'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("in/t.csv", body.encode())
        z.writestr("empty.txt", "")
        z.writestr("head.txt", "a\n")
    feeds = spark.createDataFrame([("f", held.getvalue()), ("g", b"no archive"), ("h", None)], "fid string, content binary")
    assert sorted(map(tuple, gtfs.read_table(feeds, "t", ["a", "c", "none", "b"]).collect()), key=lambda r: r[4]) == [("f", 'x, "y"', "3", None, "1"), ("f", None, None, None, "2"), ("f", None, None, None, "3")]
    assert gtfs.read_table(feeds, "empty", ["a"]).count() == gtfs.read_table(feeds, "head", ["a"]).count() == 0
