"""Readers and writers on small files written by the test."""

import gzip

import pytest
from pyspark.sql import functions as F

from trellisway.sources import geopackage as G
from trellisway.sources import sinks as K
from trellisway.sources import tables as R
from trellisway.streaming import volumes as V


def test_geopackage_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(5, "a", 1.5, True, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]), (9, None, None, False, [(1.0, 1.0), (3.0, 1.0), (3.0, 4.0)]), (11, "c", 0.0, None, None)],
        "nodeID long, name string, z double, flag boolean, points array<struct<x:double,y:double>>",
    )
    path = f"{tmp_path}/zones.gpkg"
    assert G.write_features(rows, path, "zones", "polygon") == 3
    back = {r.nodeID: r for r in G.read_features(spark, path, "nodeID").collect()}
    assert (back[5].name, back[5].z, back[5].flag) == ("a", 1.5, True) and (back[9].name, back[9].z, back[9].flag) == (None, None, False)
    assert [(p.x, p.y) for p in back[5].points] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)] and not back[11].points
    assert G.read_boundary(spark, path)[0][0][1] == (2.0, 0.0)
    twice = f"{tmp_path}/twice.gpkg"
    G.write_features(rows.unionByName(rows), twice, "zones", "line")
    with pytest.raises(Exception, match="repeated feature id"):
        G.read_features(spark, twice, "nodeID").collect()
    with pytest.raises(ValueError):
        G.write_features(rows, path, "zones", "polygon", max_rows=2)
    assert G.corners(bytes(G.with_wkb(rows, "line").first().geometry)) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]


def test_diary(spark, tmp_path):
    (tmp_path / "trips.csv").write_text(
        "hh;p;t;start;mode;from;to;ox;oy;dx;dy\n1;1;1;28000;Walk;Home;Usual place of work;1;1;2;2\n1;1;2;30000.7;Tram;Home;NR;1;1;;2\n"
        "2;1;1;x;Rocket;Other;Home;5;5;5;5\n"
    )
    names = {
        "household": "hh", "person": "p", "trip": "t", "start": "start", "mode": "mode", "origin_purpose": "from", "target_purpose": "to",
        "origin_x": "ox", "origin_y": "oy", "target_x": "dx", "target_y": "dy",
    }
    df = R.read_diary(spark, f"{tmp_path}/trips.csv", names, ";")
    rows = df.orderBy("household", "trip").collect()
    assert [r.start for r in rows] == [28000, 30000, 28800] and [r["mode"] for r in rows] == ["walk", "pt", "other"]
    assert rows[1].target_x is None and rows[1].target_y is None and rows[0].target_purpose == "work"
    found = R.routable(df, lambda x, y: (x < 4) & (y < 4)).orderBy("household", "trip").collect()
    assert [r.routable for r in found] == [True, None, False]
    assert R.read_diary(spark, f"{tmp_path}/trips.csv", names, ";", where="mode = 'Tram'").count() == 1
    (tmp_path / "bad.csv").write_text("hh;p;t;from\n1;1;1;Flying\n")
    with pytest.raises(Exception, match="unknown purpose Flying"):
        R.read_diary(spark, f"{tmp_path}/bad.csv", {"household": "hh", "person": "p", "trip": "t", "origin_purpose": "from"}, ";").collect()


def test_locations(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ID;X;Y;WEIGHT\na;1;1;2\na;2;1;2\nb;90;1;4\nb;1;1;5\n")
    near = lambda x, y: x < 50
    assert {(r.id, r.x, r.weight) for r in R.read_locations(spark, f"{tmp_path}/l.csv", near).collect()} == {("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 5.0)}
    with pytest.raises(Exception, match="weights differ"):
        R.read_locations(spark, f"{tmp_path}/l.csv").collect()
    (tmp_path / "p.csv").write_text("ID;X;Y\na;1;1\n")
    nearest = lambda df: df.select("point", F.lit(7).alias("best"))
    assert [tuple(r) for r in R.read_population(spark, f"{tmp_path}/p.csv", nearest).collect()] == [(7, 1.0)]


def test_pairs_and_edges(spark, tmp_path):
    (tmp_path / "od.csv").write_text("originNode,destinationNode,mcAmbience,mcStress\n1,2,0.5,1\n")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert tuple(R.read_pairs(spark, f"{tmp_path}/od.csv", nodes).select("origin", "target", "ambience", "stress").first()) == (1, 2, 0.5, 1.0)
    with pytest.raises(Exception, match="unknown target node"):
        R.read_pairs(spark, f"{tmp_path}/od.csv", nodes.filter("node = 1")).collect()
    (tmp_path / "e.csv").write_text("edgeIDs\n4\n7\n")
    assert [r[0] for r in R.read_edge_ids(spark, f"{tmp_path}/e.csv").collect()] == [4, 7]
    with pytest.raises(ValueError):
        R.read_edge_ids(spark, f"{tmp_path}/od.csv")


def test_census(spark, tmp_path):
    head = "a\n" * 6 + '"mode","Bicycle"\nx\ny\n"","E1","E2"\nz\n'
    (tmp_path / "c.csv").write_text(head + '"E1",0,3\n"E2",5,\n\n"E3",9,9\n')
    assert {tuple(r) for r in R.read_census(spark, f"{tmp_path}/c.csv").collect()} == {("bike", "E1", "E2", 3), ("bike", "E2", "E1", 5)}
    (tmp_path / "d.csv").write_text(head.replace("Bicycle", "Horse"))
    with pytest.raises(ValueError):
        R.read_census(spark, f"{tmp_path}/d.csv")


def test_xml(spark, tmp_path):
    (tmp_path / "n.xml").write_text(
        '<network><nodes><node id="1" x="0.5" y="2"/></nodes><links><link id="a" from="1" to="2" length="10" freespeed="5" capacity="600" permlanes="1" '
        'modes="car,bike"><attributes><attribute name="urban" class="java.lang.Boolean">true</attribute></attributes></link>'
        '<link id="b" from="2" to="1" length="1" freespeed="5" capacity="6" permlanes="1" modes="walk"></link></links></network>'
    )
    nodes, links = R.read_network(spark, f"{tmp_path}/n.xml")
    assert tuple(nodes.first()) == ("1", 0.5, 2.0)
    a, b = links.orderBy("link_id").collect()
    assert (a.modes, a.attributes, a.lanes) == (["car", "bike"], {"urban": "true"}, 1.0) and b.length == 1.0
    with gzip.open(tmp_path / "e.xml.gz", "wt") as f:
        f.write('<events><event time="3.0" type="entered link" link="a" vehicle="v"/><event time="9" type="left link" link="a" vehicle="v"/><event time="9" type="act"/></events>')
    assert [tuple(r) for r in R.read_events(spark, f"{tmp_path}/e.xml.gz").orderBy("time").collect()] == [("v", "a", 3.0, "enter"), ("v", "a", 9.0, "leave")]
    (tmp_path / "v.xml").write_text('<vehicles><vehicle id="v" type="truck"/></vehicles>')
    assert tuple(R.read_vehicles(spark, f"{tmp_path}/v.xml").first()) == ("v", "truck")


def test_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(["1.5"] * 1440))
    assert R.read_minutes(spark, f"{tmp_path}/m.txt").count() == 1440
    (tmp_path / "short.txt").write_text("1\n2\n")
    with pytest.raises(ValueError):
        R.read_minutes(spark, f"{tmp_path}/short.txt")
    (tmp_path / "ch.csv").write_text("id,choice,x\nq1,2,0.5\n")
    assert R.read_choices(spark, f"{tmp_path}/ch.csv", "id", "choice").dtypes == [("id", "string"), ("choice", "int"), ("x", "double")]
    (tmp_path / "co.csv").write_text("Iteration,LL,b,c\n0,-9,0,0\n1,-5,0.25,-1\nstd.err,,0.1,0.1\n")
    assert R.read_coefficients(spark, f"{tmp_path}/co.csv", ["b", "c"]) == {"b": 0.25, "c": -1.0}
    with pytest.raises(ValueError):
        R.read_coefficients(spark, f"{tmp_path}/co.csv", ["c", "b"])
    (tmp_path / "r.csv").write_text("ID,walk_time,grad\n1,5,0.1\n")
    known = spark.createDataFrame([("1",)], "id string")
    assert R.read_routes(spark, f"{tmp_path}/r.csv", ["walk"], known).count() == 1
    with pytest.raises(ValueError):
        R.read_routes(spark, f"{tmp_path}/r.csv", ["walk"], spark.createDataFrame([("2",)], "id string"))
    (tmp_path / "p.csv").write_text("IDNumber,PersonNumber,TripNumber,path,distance,links\nh,1,2,0,10.5,a-b-c\n")
    assert R.read_paths(spark, f"{tmp_path}/p.csv").first().links == ["a", "b", "c"]
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,25:00:10,25:01:00,s,1\n")
    assert tuple(R.read_gtfs_stop_times(spark, str(tmp_path)).first()) == ("t", 1, "s", 90010.0, 90060.0)
    (tmp_path / "z.csv").write_text("id;wkt\n1;POLYGON ((0 0, 2 0, 2 2, 0 0), (1 1, 1.2 1, 1 1))\n2;MULTIPOLYGON (((5 5, 6 5, 6 6)))\n")
    assert [[(p.x, p.y) for p in r.parts[0][0]] for r in R.read_zones(spark, f"{tmp_path}/z.csv").orderBy("zone").collect()] == [[(0, 0), (2, 0), (2, 2), (0, 0)], [(5, 5), (6, 5), (6, 6)]]


def test_sinks(spark, tmp_path):
    points = "array<struct<x:double,y:double>>"
    edges = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(2.0, 2.0), (1.0, 0.0)])], f"edge_id long, points {points}")
    steps = spark.createDataFrame([(7, 0, 1, True), (7, 1, 2, False)], "path long, seq int, edge_id long, forward boolean")
    assert [(p.x, p.y) for p in K.path_lines(steps, edges, "path").first().points] == [(0, 0), (1, 0), (2, 2)]
    with pytest.raises(Exception, match="do not line up"):
        K.path_lines(steps.withColumn("forward", F.lit(True)), edges, "path").collect()
    values = spark.createDataFrame([("d", "10", "2", 1.0), ("d", "2", "10", 4.0), ("t", "2", "2", 0.5)], "matrix string, o string, d string, value double")
    K.write_matrices(values, f"{tmp_path}/m")
    assert R.read_matrix(spark, f"{tmp_path}/m").count() == 3
    wide = K.wide_matrix(values.filter("matrix = 'd'"), ["10", "2"], numeric=True)
    assert wide.columns == ["o", "2", "10"] and [tuple(r) for r in wide.collect()] == [("2", None, 4.0), ("10", 1.0, None)]
    volumes = spark.createDataFrame([(1, "fast", 3)], "link long, route string, trips long")
    table = K.link_volume_table(spark.createDataFrame([(1,), (2,)], "link long"), volumes, ["fast", "calm"])
    assert {tuple(r) for r in table.collect()} == {(1, 3, 0), (2, 0, 0)}
    rows = spark.createDataFrame([(i, 1, float(i)) for i in range(6)], "iteration int, node long, demand double")
    assert K.iteration_table(rows, 6).columns == ["node", "0", "1", "2", "4"]
    trips = spark.createDataFrame([("h", 1, 1), ("h", 1, 2)], "household string, person int, trip int")
    routes = spark.createDataFrame([("h", 1, 1, "walk", "time", 5.0)], "household string, person int, trip int, route string, attribute string, value double")
    out = K.trip_table(trips, routes, ["time", "dist"])
    K.write_csv(out, f"{tmp_path}/csv")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/csv").collect() if "trip" not in r[0]) == ["h,1,1,walk,5.0,null", "h,1,2,null,null,null"]


def test_stream_drops_late_events(spark, tmp_path):
    schema = "ts timestamp, link long, type string"
    for i, rows in enumerate([[("2024-01-01 00:10:00", 1, "car"), ("2024-01-01 05:00:00", 1, "truck")], [("2024-01-01 00:20:00", 1, "car"), ("2024-01-01 04:50:00", 1, "car")]]):
        own = spark.createDataFrame(rows, "ts string, link long, type string").select(F.to_timestamp("ts").alias("ts"), "link", "type")
        own.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    stream = V.entries(spark, f"{tmp_path}/in*", own.schema, files_per_trigger=1)
    query = V.write_closed(V.hourly(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    got = {(r.hour.hour, r.car, r.truck) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (0, 1, 0) in got or (0, 2, 0) in got  # the late entry counts only if its file came first
    batch = V.hourly(spark.read.schema(schema).parquet(f"{tmp_path}/in*"))
    assert {(r.hour.hour, r.car, r.truck) for r in batch.collect()} == {(0, 2, 0), (4, 1, 0), (5, 0, 1)}


def test_polygons_of_several_parts(spark, tmp_path):
    hook = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole, island = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)], [(6.0, 6.0), (7.0, 6.0), (7.0, 7.5), (6.0, 6.0)]
    parts = [[hook, hole], [island]]
    assert G.polygons(G.parts_wkb(parts)) == parts and G.polygons(G.parts_wkb(parts[:1])) == parts[:1]
    assert G.polygons(b"GP\x00\x01\x00\x00\x00\x00" + G.parts_wkb(parts)) == parts and G.polygons(G.wkb([(1.0, 2.0)], "point")) is None
    kind = "zone long, parts array<array<array<struct<x:double,y:double>>>>"
    rows = [(1, [[[{"x": x, "y": y} for x, y in r] for r in part] for part in parts]), (2, None), (3, [[[{"x": x, "y": y} for x, y in island]]])]
    path = str(tmp_path / "a.gpkg")
    assert G.write_features(spark.createDataFrame(rows, kind), path, "areas", "polygon") == 3
    found = {r.zone: r.parts for r in G.read_features(spark, path, "zone", areas=True).collect()}
    assert [[[(p.x, p.y) for p in r] for r in part] for part in found[1]] == parts and not found[2]
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1,2 1, 2 2,1 1)),((6 6, 7 6, 7 7.5, 6 6)))"
    texts = [("a", wkt), ("b", "POLYGON EMPTY"), ("c", "polygon ((0 0,1 0,1 1))".upper()), ("d", None), ("e", "MULTIPOLYGON Z (((0 0 5, 1 0 5, 1 1 5)))")]
    made = {r.id: r.p for r in spark.createDataFrame(texts, "id string, wkt string").select("id", R.parts_of("wkt").alias("p")).collect()}
    assert [[[(p.x, p.y) for p in r] for r in part] for part in made["a"]] == parts
    assert made["b"] == [] and made["d"] is None and len(made["c"][0][0]) == len(made["e"][0][0]) == 3
    with pytest.raises(Exception, match="no polygon"):
        spark.createDataFrame([("LINESTRING (0 0, 1 1)",)], "wkt string").select(R.parts_of("wkt")).collect()


def test_services_of_weeks_and_exceptions(spark, tmp_path):
    head = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
    rows = ["week,1,1,1,1,1,0,0,20240226,20240303", "sunday,0,0,0,0,0,0,1,20240225,20240310", "none,0,0,0,0,0,0,0,20240101,20241231", "back,1,1,1,1,1,1,1,20240310,20240301"]
    (tmp_path / "both").mkdir()
    (tmp_path / "both" / "calendar.txt").write_text(head + "\n".join(rows) + "\n")
    exceptions = "service_id,date,exception_type\nweek,20240228,2\nweek,20240302,1\nother,20240301,1\nother,20240302,1\nother,20240302,2\nsunday,20240225,1\n"
    (tmp_path / "both" / "calendar_dates.txt").write_text(exceptions)
    week = {("week", d) for d in ("20240226", "20240227", "20240229", "20240301", "20240302")}
    sunday = {("sunday", d) for d in ("20240225", "20240303", "20240310")}
    found = R.read_services(spark, str(tmp_path / "both")).collect()
    assert {tuple(r) for r in found} == week | sunday | {("other", "20240301")} and len(found) == 9
    for name, text in (("weeks", "calendar.txt"), ("dates", "calendar_dates.txt")):
        (tmp_path / name).mkdir()
        (tmp_path / name / text).write_text((tmp_path / "both" / text).read_text())
    assert {tuple(r) for r in R.read_services(spark, str(tmp_path / "weeks")).collect()} == (week | {("week", "20240228")} | sunday) - {("week", "20240302")}
    assert {tuple(r) for r in R.read_services(spark, str(tmp_path / "dates")).collect()} == {("week", "20240302"), ("other", "20240301"), ("sunday", "20240225")}
    with pytest.raises(ValueError, match="calendar"):
        R.read_services(spark, str(tmp_path))


def test_stream_keeps_the_last_count_of_an_hour(spark, tmp_path):
    import datetime as dt

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    for i, rows in enumerate([[(at(8, 5), 1, "car"), (at(9, 1), 2, "truck")], [(at(8, 50), 1, "car"), (at(9, 59), 1, "car"), (at(9, 2), 2, "bus")]]):
        spark.createDataFrame(rows, "ts timestamp, link long, type string").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    schema = spark.read.parquet(f"{tmp_path}/in0").schema
    stream = V.hourly(V.entries(spark, f"{tmp_path}/in*", schema, files_per_trigger=1), late="3 hours")
    found = V.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check", ["link", "hour"])
    assert {(r.link, r.hour.hour, r.car, r.truck) for r in found.collect()} == {(1, 8, 2, 0), (2, 9, 0, 1), (1, 9, 1, 0)}
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) >= 3


def test_feature_files_of_any_number_of_rows(spark, tmp_path):
    """A GeoPackage a task, read as one layer; a task without rows leaves an empty layer."""
    rows = spark.range(25, numPartitions=3).selectExpr("id", "id % 2 = 0 AS even", "IF(id % 5 = 0, NULL, array(named_struct('x', id * 1D, 'y', 2D))) AS points")
    rows = rows.unionByName(rows.limit(0))
    assert G.write_feature_files(rows, str(tmp_path), "spots", "point") == 25
    assert len(list(tmp_path.iterdir())) == rows.rdd.getNumPartitions() > 2
    found = sorted(G.read_features(spark, str(tmp_path), "id", "spots").select("id", "even", "points").collect())
    assert [(r.id, r.even, r.points and r.points[0].x) for r in found] == [(i, i % 2 == 0, None if i % 5 == 0 else float(i)) for i in range(25)]
    (tmp_path / "none").mkdir()
    assert G.write_feature_files(rows.limit(0), str(tmp_path / "none"), "spots", "point") == 0
    assert G.read_features(spark, str(tmp_path / "none")).count() == 0
