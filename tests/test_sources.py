"""Archives, documents, export and streaming on small fixtures."""

import zipfile

from pyspark.sql import functions as F

from transitloom.params import Params
from transitloom.sources import export, gtfs, netex, tables
from transitloom.streaming import links as stream

MEMBERS = {
    "agency.txt": "agency_id,agency_name,agency_timezone\nA, Rail Co ,Europe/Paris\n",
    "routes.txt": "route_id, agency_id,route_short_name,route_long_name,route_type\nR1,A,1,North - South,2\nR2,A,,Bus,700\nR3,A,x,y,bad\n",
    "stops.txt": "﻿stop_id,stop_name,stop_lon,stop_lat\nS1,One,2.0,48.0\nS2,Two,2.1,48.1\nS3,Three,,\n",
    "trips.txt": "trip_id,route_id,service_id\nT1,R1,W\nT2,R1,W\nT3,R2,NONE\nT4,R3,W\n",
    "stop_times.txt": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nT1,1,S1,10:00:00,10:01:00\nT1,2,S2,10:30:00,10:30:00\nT2,2,S2,24:30:00,24:30:00\nT2,1,S1,24:00:00,24:01:00\nT1,3,S3,,\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,1,1,1,1,0,0,20240101,20240114\n",
    "calendar_dates.txt": "service_id,date,exception_type\nW,20240106,1\nW,20240102,2\n",
}


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)


def test_normalised_feed(spark, tmp_path):
    archive(tmp_path / "one.zip", MEMBERS)
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    feeds = gtfs.archives(spark, str(tmp_path))
    t = gtfs.normalised(feeds)
    trips = t["trips"].collect()
    assert {(r["trip_id"], r["start"], r["end"]) for r in trips} == {("T1", 36000, 37800), ("T2", 86400, 88200)}
    assert t["stop_seq"].count() == 1 and t["time_seq"].count() == 1  # both trips share their sequences
    assert t["time_seq"].first()["rel"] == [0, 1800]
    assert len(t["datesets"].first()["dates"]) == 10
    assert [(r["route_id"], r["name"], r["agency"]) for r in t["routes"].collect()] == [("R1", "1 | North - South", "Rail Co")]
    seen = {r["fid"]: r["valid"] for r in gtfs.inventory(feeds).collect()}
    assert seen == {"one": True, "broken": False}


NETEX = """<PublicationDelivery xmlns="http://www.netex.org.uk/netex"><CompositeFrame>
<ValidBetween><FromDate>2026-02-01T00:00:00</FromDate><ToDate>2026-03-01</ToDate></ValidBetween>
<StopPlace id="P1"><Name>Roma</Name><Centroid><Location><Longitude>12.5</Longitude><Latitude>41.9</Latitude></Location></Centroid></StopPlace>
<Quay id="Q1"><Name> </Name><StopPlaceRef ref="P1"/></Quay>
<ScheduledStopPoint id="X1"><Name>Milano</Name><Location><pos>45.5 9.2</pos></Location></ScheduledStopPoint>
<Line id="L1"><Name>Roma Milano</Name><PublicCode>RM</PublicCode></Line>
<StopPointInJourneyPattern id="J1"><ScheduledStopPointRef ref="X1"/><QuayRef ref="Q1"/></StopPointInJourneyPattern>
<ServiceJourney id="T1"><dayTypes><DayTypeRef ref="D"/></dayTypes><LineRef ref="L1"/><passingTimes>
<TimetabledPassingTime><StopPointInJourneyPatternRef ref="J1"/><DepartureTime>08:00:00</DepartureTime></TimetabledPassingTime>
<TimetabledPassingTime><StopPointInJourneyPatternRef ref="J2"/><ArrivalTime>2026-01-23T11:00:00Z</ArrivalTime></TimetabledPassingTime>
<TimetabledPassingTime><StopPointInJourneyPatternRef ref="J3"/></TimetabledPassingTime></passingTimes></ServiceJourney>
<ServiceJourney id="T2"><LineRef ref="unknown"/></ServiceJourney>
</CompositeFrame></PublicationDelivery>"""


def test_netex(spark, tmp_path):
    path = str(tmp_path / "n.xml")
    (tmp_path / "n.xml").write_text(NETEX)
    v = netex.validity(spark, path).first()
    assert (str(v["from_date"]), str(v["to_date"])) == ("2026-02-01", "2026-03-01")
    s = {r["stop_id"]: r for r in netex.stops(spark, path).collect()}
    assert (s["Q1"]["stop_name"], s["Q1"]["stop_lat"], s["Q1"]["parent_station"]) == ("Q1", 41.9, "P1")
    assert (s["X1"]["stop_lat"], s["X1"]["stop_lon"], s["P1"]["location_type"]) == (45.5, 9.2, 1)
    r = netex.routes(spark, path, "TI")
    assert [(x["route_id"], x["route_short_name"]) for x in r.collect()] == [("L1", "RM")]
    trips, times = netex.journeys(spark, path, r)
    assert {(x["trip_id"], x["route_id"], x["service_id"]) for x in trips.collect()} == {("T1", "L1", "D"), ("T2", "L1", "ALL_DAYS")}
    assert [(x["stop_id"], x["arrival_time"], x["departure_time"], x["stop_sequence"]) for x in times.orderBy("stop_sequence").collect()] == [("J1", "08:00:00", "08:00:00", 1), ("J2", "11:00:00", "11:00:00", 2)]
    assert [tuple(x) for x in netex.pattern_stops(spark, path).collect()] == [("J1", "Q1")]


def test_export(spark, tmp_path):
    times = spark.createDataFrame([(1, 7, -20, -18), (1, 8, 30, 31), (2, 7, 5, 5), (2, 8, 90, 91)], "jrn int, stn int, arr int, dep int")
    s = export.shifted(times)
    assert {(r["jrn"], r["day_shift"]) for r in s.collect()} == {(1, -1), (2, 0)}
    st = export.stop_times(s)
    assert st.where("trip_id = '1'").orderBy("stop_sequence").first()["arrival_time"] == "23:40:00"
    j = s.select("jrn", F.lit(0).cast("long").alias("dateset"), "day_shift").distinct()
    sv = export.services(j)
    d = spark.sql("select 0L dateset, array(date'2024-01-01') dates")
    assert {r["date"] for r in export.calendar_dates(d, sv).collect()} == {20231231, 20240101}
    export.write_archive({"stop_times": st}, str(tmp_path / "f.zip"))
    with zipfile.ZipFile(tmp_path / "f.zip") as z:
        assert z.testzip() is None and len(z.read("stop_times.txt").splitlines()) == 5


def test_feed(spark, tmp_path):
    stations = spark.createDataFrame([(1, "A | Aa", 0.0, 0.0), (2, "B", 0.1, 0.0), (3, "C", 0.2, 0.0)], "stn int, name string, lon double, lat double")
    lines = spark.createDataFrame([(10, " Z ", True, [1, 2, 3]), (11, None, True, [1, 2, 3]), (12, "", False, [1, 3])], "line int, agency string, rail boolean, stns array<int>")
    journeys = spark.createDataFrame([(100, 10, 0), (101, 12, 0), (102, 11, 0)], "jrn int, line int, dateset long")
    datesets = spark.sql("select 0L dateset, array(date'2024-01-01', date'2024-01-03') dates")
    times = spark.createDataFrame([(100, 1, -20, -18), (100, 2, 5, 6), (100, 3, 30, 31), (101, 1, 5, 5), (101, 3, 90, 91), (102, 1, 0, 0), (102, 2, 7, 8), (102, 3, 9, 9)], "jrn int, stn int, arr int, dep int")
    # the second runs against its direction; there is none for buses
    segments = spark.sql("""select 1 src, 2 trg, 'Rail' mode, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0.05D, 'y', 0D), named_struct('x', 0.1D, 'y', 0D)) line
      union all select 2, 3, 'Rail', array(named_struct('x', 0.19D, 'y', 0D), named_struct('x', 0.11D, 'y', 0D))
      union all select 1, 3, 'Bus', null""")
    f = export.feed(stations, lines, journeys, datesets, times, segments, publisher="P", url="https://example.org/", timezone="Europe/Paris", version="1")
    rows = {name: df.collect() for name, df in f.items()}
    assert {(r["agency_id"], r["agency_name"]) for r in rows["agency"]} == {(1, "Unknown agency"), (2, "Z")}
    assert {(r["route_id"], r["agency_id"], r["route_short_name"], r["route_long_name"], r["route_type"]) for r in rows["routes"]} == {(10, 2, "IC-00010", "A \u2013 C", 2), (11, 1, "IC-00011", "A \u2013 C", 2), (12, 1, "IC-00012", "A \u2013 C", 3)}
    assert {(r["route_id"], r["trip_id"], r["shape_id"]) for r in rows["trips"]} == {(10, "100", 1), (11, "102", 1), (12, "101", None)}
    shape = sorted(rows["shapes"], key=lambda r: r["shape_pt_sequence"])
    assert [(r["shape_pt_sequence"], r["shape_pt_lon"]) for r in shape] == [(1, 0.0), (2, 0.05), (3, 0.1), (4, 0.11), (5, 0.19), (6, 0.2)]
    degree = 6378.137 * 3.141592653589793 / 180
    assert all(abs(r["shape_dist_traveled"] - degree * r["shape_pt_lon"]) < 1e-6 for r in shape)
    at = {(r["trip_id"], r["stop_sequence"]): r["shape_dist_traveled"] for r in rows["stop_times"]}
    assert len(at) == 8 and at["101", 1] is None and at["100", 1] == 0 and abs(at["100", 3] - 0.2 * degree) < 1e-6
    assert len({r["service_id"] for r in rows["calendar_dates"]}) == 2
    info = rows["feed_info"][0]
    assert (info["feed_start_date"], info["feed_end_date"]) == (20231231, 20240103)
    export.write_archive(f, str(tmp_path / "f.zip"))
    back = gtfs.read_table(gtfs.archives(spark, str(tmp_path)), "stop_times", ["trip_id", "arrival_time"])
    assert back.where("trip_id = '100'").agg(F.min("arrival_time"), F.max("arrival_time")).first()[:] == ("23:40:00", "24:30:00")


def test_feed_of_unknown_stations_is_an_error(spark):
    import pytest

    far = spark.createDataFrame([(1, "A", 0.0, 91.0)], "stn int, name string, lon double, lat double")
    with pytest.raises(Exception, match="out of range"):
        export.stops(far).collect()


def test_minimal_feed(spark):
    trips = spark.createDataFrame([("R", "S", "T"), ("R", "S", "U"), ("R", "V", "W")], "route_id string, service_id string, trip_id string")
    valid = spark.sql("select date'2026-02-01' from_date, date'2026-03-01' to_date")
    f = export.minimal_feed(("X", "Rail", "https://example.org/", "Europe/Rome"), valid, trips, trips, trips, trips, "it")
    assert {(r["service_id"], r["sunday"], r["start_date"], r["end_date"]) for r in f["calendar"].collect()} == {(s, 1, "20260201", "20260301") for s in "SV"}
    assert (f["feed_info"].first()["feed_end_date"], f["agency"].first()["agency_id"]) == ("20260301", "X")


def test_catalogue_resources(spark):
    items = spark.createDataFrame([("d", 0, "other", True, 1), ("d", 1, "gtfs", False, 2), ("d", 2, "gtfs", True, 3), ("d", 3, "gtfs", True, 4)], "dataset string, position int, format string, is_active boolean, id int")
    assert [r["id"] for r in tables.active_resource(items, ["dataset"], "gtfs").collect()] == [3]
    res = "array<struct<format: string, name: string, last_modified: string, created: string>>"
    packages = spark.createDataFrame([("a", [(".XML", "t 2026", None, "2025-05"), ("xml", "t 2026 b", "2025-06", None), ("xml", "u 2026", "2025-06", ""), ("csv", "t 2026", "2027", None)]), ("b", [("xml", "t 2025", "2025", None)]), ("c", []), ("e", [(None, None, None, None), ("xml", "2026", "", None)])], f"id string, resources {res}")
    assert {(r["id"], r["resource"]["name"]) for r in tables.newest_resources(packages, "2026").collect()} == {("a", "t 2026 b"), ("e", "2026")}


def test_schedule_and_verified_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",".join(tables.SCHEDULE) + "\nCDG,FRA,AF,1018,0930,1145,0,1234567,150,2024-01-01,2024-02-01\nCDG,FRA,AF,1018,0930,1145,0,1234567,150,2024-01-01,2024-02-01\n")
    rows = tables.read_schedule(spark, str(tmp_path / "s.csv")).collect()
    assert len(rows) == 1 and rows[0]["arr"] - rows[0]["dep"] == 135
    expected = spark.createDataFrame([("s.csv", "0" * 64), ("gone.csv", "1" * 64)], "name string, hash string")
    assert {tuple(r) for r in tables.verified_files(spark, str(tmp_path / "*.csv"), expected).collect()} == {("s.csv", "changed"), ("gone.csv", "missing")}


def test_params(tmp_path):
    (tmp_path / "p.yml").write_text("SERVICE_START: 2024-01-01\nOTHER: 1\n")
    assert Params().total_days == 1461 and Params.from_yaml(str(tmp_path / "p.yml")).total_days == 1096


def test_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    q = stream.windowed_statistics(stream.read_events(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("st").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("st").agg(F.sum("n")).first()[0] == events.count()


def test_archives_round_trip(spark):
    stops = spark.createDataFrame([("a", "1", 'x, "y"'), ("a", "2", None), ("b", "1", " z "), (None, "3", "lost")], "fid string, stop_id string, stop_name string")
    agency = spark.createDataFrame([("b", "A")], "fid string, agency_name string")
    packed = export.archives({"agency": agency, "stops": stops, "routes": stops.where("false")})
    rows = {tuple(r) for r in gtfs.read_table(packed, "stops", ["stop_id", "stop_name"]).collect()}
    assert rows == {("a", "1", 'x, "y"'), ("a", "2", None), ("b", "1", " z ")}
    assert [tuple(r) for r in gtfs.read_table(packed, "agency", ["agency_name"]).collect()] == [("b", "A")]
    found = {r["fid"]: (r["f_agency"], r["f_stops"], r["f_routes"], r["valid"]) for r in gtfs.inventory(packed).collect()}
    assert found == {"a": (False, True, False, False), "b": (True, True, False, False)}
    again = export.archives({"agency": agency, "stops": stops})
    assert {r["fid"]: bytes(r["content"]) for r in again.collect()} == {r["fid"]: bytes(r["content"]) for r in packed.collect()}


def test_the_first_validity_counts(spark, tmp_path):
    frame = "<ValidBetween><FromDate>{}</FromDate>{}</ValidBetween>"
    later = frame.format("2020-01-01", "<ToDate>2020-02-01</ToDate>")
    (tmp_path / "v.xml").write_text(f"<D><CompositeFrame>{frame.format('2025-03-01T00:00:00', '')}<frames><F>{later}</F></frames></CompositeFrame></D>")
    assert [str(x) for x in netex.validity(spark, str(tmp_path / "v.xml"), end="2030-12-31").first()] == ["2025-03-01", "2030-12-31"]
