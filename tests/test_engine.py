"""Ingest rules, state, formats, snapshots, the catalog, and the stream."""

import uuid

import pytest
from pyspark.sql import functions as F

from shoal.functions import features as feat
from shoal.functions import geometry as geo
from shoal.functions.geometry import EngineError, Options
from shoal.operators import replay, state
from shoal.plans import catalog, tiles
from shoal.sources import reports as ingest
from shoal.sources import snapshot, views
from shoal.streaming import live

OPTS = Options(categories=("idle", "enroute"), max_props_bytes=40)


def bodies(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "batch bigint, value string")


def test_shapes_and_rules(spark):
    ok = '{"id":"a","lng":-46.6,"lat":-23.5}'
    b = bodies(
        spark,
        f"[{ok},{ok}]",
        '{"points":[' + ok + "]}",
        ok,
        "[]",
        f'[{ok},{{"id":"b","lng":1,"lat":2,"speed":3}}]',
        '[{"id":"c","lng":1,"lat":2,"cat":"nowhere"}]',
        '[{"id":"d","lng":1,"lat":2,"props":[1]}]',
        '[{"id":"e","lng":1,"lat":2,"props":{"k":"' + "x" * 60 + '"}}]',
        '[{"id":"f","lng":1,"lat":2,"cat":"enroute","props":{"z":1,"a":2}},{"id":"","lng":1,"lat":2,"cat":1,"props":null}]',
    )
    got = ingest.accepted(ingest.parse(b), OPTS)
    assert sorted({r.batch for r in got.collect()}) == [0, 1, 2, 8]
    last = {r.id: (r.cat, r.props) for r in got.where("batch = 8").collect()}
    assert last == {"f": (1, '{"z":1,"a":2}'), "": (1, None)}


def test_projection(spark):
    df = spark.createDataFrame([(0.0, 0.0), (180.0, 90.0), (-200.0, -90.0), (-46.6, -23.5)], "lng double, lat double")
    rows = df.select(geo.project_x(F.col("lng")).alias("x"), geo.project_y(F.col("lat")).alias("y")).collect()
    assert tuple(rows[0]) == (1 << 29, 1 << 29) and rows[2].x == 0
    assert rows[1].x == round(0.9999999 * geo.WORLD)
    assert tuple(rows[3]) == geo.project_point(-46.6, -23.5)
    back = spark.createDataFrame([tuple(map(float, rows[3]))], "x double, y double").select(geo.unproject_x(F.col("x")), geo.unproject_y(F.col("y"))).first()
    assert abs(back[0] + 46.6) < 1e-6 and abs(back[1] + 23.5) < 1e-6


def test_options_and_boxes():
    for bad in ({"max_zoom": 21}, {"radius": 0.0}, {"hysteresis": -0.1}, {"min_zoom": 9, "max_zoom": 3}):
        with pytest.raises(EngineError):
            Options(**bad)
    for bad in ("1,2,3", "a,b,c,d", "1,2,3,nan"):
        with pytest.raises(EngineError):
            geo.parse_box(bad)
    assert geo.parse_box(None)[0] == -180.0
    assert Options().level(-4) == 0 and Options().level(3.9) == 3 and Options().level(99) == 16


def test_abbreviation(spark):
    df = spark.createDataFrame([(7,), (999,), (1000,), (1234,), (9999,), (10000,), (123456,)], "n bigint")
    assert [r[0] for r in df.select(feat.count_abbreviation(F.col("n"))).collect()] == ["7", "999", "1k", "1.2k", "10k", "10k", "123k"]


def test_scalar_tags(spark):
    df = spark.createDataFrame([('{"s":"12","n":12,"b":true,"f":1.5,"m":-3,"x":null,"o":{"a":1},"l":[1],"id":"no"}',), ("{}",), (None,), ("no json",), ('{"a":1,"p":{"a":"x"},"big":18446744073709551615,"huge":18446744073709551616,"t":"true","q\\"":"k: \\"v"}',)], "props string")
    got = {r.key: (r.kind, r.value) for r in feat.scalar_tags(df).collect()}
    assert {k: got.pop(k) for k in ("a", "big", "huge", "t", 'q"')} == {"a": ("uint", "1"), "big": ("uint", "18446744073709551615"), "huge": ("string", "18446744073709551616"), "t": ("string", "true"), 'q"': ("string", 'k: "v')}
    assert got == {"s": ("string", "12"), "n": ("uint", "12"), "b": ("bool", "true"), "f": ("string", "1.5"), "m": ("string", "-3")}


def varint(b, i):
    n = s = 0
    while True:
        n |= (b[i] & 127) << s
        s += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def fields(b):
    i, out = 0, []
    while i < len(b):
        key, i = varint(b, i)
        n, i = varint(b, i)
        if key & 7 == 2:
            out.append((key >> 3, b[i : i + n]))
            i += n
        else:
            out.append((key >> 3, n))
    return out


def test_tile_bytes():
    assert tiles.encode_layer([], 512) == b""
    raw = tiles.encode_layer([(5, -7, 99, [("cluster", True), ("n", 300)]), (600, 1, None, [("cluster", False), ("id", "é")])], 512.9)
    (tag, layer), *rest = fields(raw)
    assert tag == 3 and not rest
    got = fields(layer)
    assert (15, 2) in got and (5, 512) in got and [v for t, v in got if t == 3] == [b"cluster", b"n", b"id"]
    first, second = (dict(fields(v)) for t, v in got if t == 2)
    assert first[1] == 99 and first[2] == bytes([0, 0, 1, 1]) and 1 not in second
    assert first[4] == bytes([9, 10, 13])
    assert [fields(v)[0] for t, v in got if t == 4] == [(7, 1), (5, 300), (7, 0), (1, "é".encode())]
    assert tiles.tile_format("12.pbf") == ("12", "mvt") and tiles.tile_format("3") == ("3", "mvt")
    with pytest.raises(EngineError):
        tiles.tile_format("3.png")


def reports(spark):
    rows = [
        (1, 0, "upsert", "a", 10, 10, 2, '{"k":1}'),
        (2, 50, "upsert", "a", 20, 20, 1, None),
        (3, 60, "remove", "a", 0, 0, 0, None),
        (4, 70, "upsert", "a", 30, 30, 1, None),
        (5, 80, "upsert", "b", 5, 5, 0, "{}"),
        (6, 900, "upsert", "b", 6, 6, 1, None),
    ]
    df = spark.createDataFrame(rows, "seq bigint, s bigint, op string, id string, qx bigint, qy bigint, cat int, props string")
    return df.select(F.lit("c").alias("collection"), "seq", F.timestamp_seconds("s").alias("ts"), "op", "id", "qx", "qy", "cat", "props")


def test_lives(spark):
    got = {(r.id, r.life): (r.qx, r.cat, r.props, r.ended) for r in state.life_states(state.lives(reports(spark), 300)).collect()}
    assert got == {("a", 1): (20, 2, '{"k":1}', "remove"), ("a", 2): (30, 1, None, "upsert"), ("b", 1): (5, 0, "{}", "upsert"), ("b", 2): (6, 1, None, "upsert")}
    now = F.timestamp_seconds(F.lit(1000))
    assert [r.id for r in state.live_devices(reports(spark), 300, now).collect()] == ["b"]
    assert [r.id for r in state.expired(reports(spark), 300, now).collect()] == ["a"]
    assert {r.id: r.num for r in state.intern_ids(reports(spark)).collect()} == {"a": 0, "b": 1}


def test_catalog():
    c = catalog.Catalog(auto_create=False)
    assert c.create("x") and not c.create("x")
    with pytest.raises(EngineError) as e:
        c.create("x", Options(radius=10.0))
    assert e.value.code == "conflict"
    with pytest.raises(EngineError) as e:
        c.for_write("y")
    assert e.value.code == "no_such_collection"
    c.drop("x")
    assert c.names() == []


def fresh(spark, name):
    from shoal.sources.tables import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def devices(spark, rows):
    d = spark.createDataFrame(rows, "collection string, num bigint, id string, qx bigint, qy bigint, cat int, props string")
    return d.withColumn("last_seen", F.timestamp_seconds(F.lit(100)))


def test_snapshot(spark, small):
    path = fresh(spark, "snap")
    assert snapshot.listed(spark, path) == [] and snapshot.read(spark, path).count() == 0
    rows = [("a/b", 0, "", 1, 2, 5, "{}"), ("a/b", 1, "é?", 3, 4, 0, None), ("z", 0, "q", 5, 6, 1, None), ("007", 0, "j", 5, 6, 1, None), ("", 0, "k", 5, 6, 1, None)]
    snapshot.write(devices(spark, rows), path, {"z": OPTS})
    assert snapshot.listed(spark, path) == ["", "007", "a/b", "z"]
    assert snapshot.read_options(spark, path)["z"] == OPTS
    back = snapshot.restore(snapshot.read(spark, path), Options(categories=("p", "q")), F.timestamp_seconds(F.lit(150)))
    assert {(r.collection, r.id, r.cat) for r in back.where("collection IN ('a/b', 'z')").collect()} == {("a/b", "", 0), ("a/b", "é?", 0), ("z", "q", 1)}
    assert {r.collection: r.devices for r in snapshot.info(spark, path).collect()} == {"": 1, "007": 1, "a/b": 2, "z": 1}
    for gone in ("a/b", "never there", "007", ""):
        snapshot.delete(spark, path, gone)
    assert snapshot.listed(spark, path) == ["z"]


def test_names_as_path_parts(spark):
    names = ["", ".x", "a/b", "é", "n" * 300, "a b*c~d+e", "ü" * 90, "..", "100%"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", snapshot.encoded(F.col("n")).alias("e"))
    for n, part in df.collect():
        assert part == snapshot.encode_name(n)
        assert "/" not in part and not part.startswith(".") and len(part) <= 200
    assert len({snapshot.encode_name(n) for n in names}) == len(names)
    assert snapshot.decode_name(snapshot.encode_name("a/é b")) == "a/é b"


def test_collections_are_stored_beside_each_other(spark):
    path = fresh(spark, "snap")
    snapshot.write(devices(spark, [("a", 0, "x", 1, 2, 0, None), ("a", 1, "y", 1, 2, 0, "{}")]), path, {"a": Options(radius=30.0)})
    snapshot.write(devices(spark, [("b", 0, "x", 1, 2, 0, None)]), path, {"b": Options(max_zoom=9)})
    assert snapshot.read_options(spark, path) == {"a": Options(radius=30.0), "b": Options(max_zoom=9)}
    changed = [("a", 2, "z", 9, 9, 1, None, True), ("a", 0, "x", 0, 0, 0, None, False)]
    ch = spark.createDataFrame(changed, "collection string, num bigint, id string, qx bigint, qy bigint, cat int, props string, live boolean")
    snapshot.merge(ch.withColumn("last_seen", F.timestamp_seconds(F.lit(7))), path)
    assert {(r.collection, r.id, r.qx) for r in snapshot.read(spark, path).collect()} == {("a", "y", 1), ("a", "z", 9), ("b", "x", 1)}
    assert snapshot.read_options(spark, path) == {"a": Options(radius=30.0), "b": Options(max_zoom=9)}
    snapshot.merge(spark.createDataFrame([("b", 0, "x", 0, 0, 0, None, False)], ch.schema).withColumn("last_seen", F.timestamp_seconds(F.lit(7))), path)
    assert snapshot.listed(spark, path) == ["a", "b"] and {r.collection for r in snapshot.read(spark, path).collect()} == {"a"}


def test_a_corrupt_collection_is_skipped(spark):
    import glob

    path = fresh(spark, "snap")
    snapshot.write(devices(spark, [("a", 0, "x", 1, 2, 0, None), ("b", 0, "x", 1, 2, 0, None)]), path)
    for f in glob.glob(f"{path.removeprefix('file://')}/devices/part=a/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"not a table")
        crc = f"{f.rpartition('/')[0]}/.{f.rpartition('/')[2]}.crc"
        __import__("os").remove(crc)
    found, skipped = snapshot.read_sound(spark, path)
    assert [r.collection for r in found.collect()] == ["b"] and skipped == ["a"]


def test_stored_catalog(spark):
    path = fresh(spark, "cat")
    c = catalog.Catalog.stored(spark, path)
    assert c.create("x", Options(radius=10.0)) and not c.create("x", Options(radius=10.0))
    assert catalog.Catalog.stored(spark, path).names() == ["x"]
    lines = bodies(spark, '{"id":"a","lng":1,"lat":2,"cat":"0"}', '{"id":"b","lng":1,"lat":2,"props":{"k":1}}')
    c.ingest("x", ingest.accepted(ingest.parse(lines), c.get("x")))
    c.ingest("new", ingest.accepted(ingest.parse(lines), Options()))
    c.ingest("x", ingest.accepted(ingest.parse(bodies(spark, '{"id":"b","lng":3,"lat":2}', '{"id":"c","lng":1,"lat":2}')), c.get("x")))
    assert {(r.num, r.id, r.props) for r in snapshot.read(spark, path).where("collection = 'x'").collect()} == {(0, "a", None), (1, "b", '{"k":1}'), (2, "c", None)}
    c.remove("x", "a")
    with pytest.raises(EngineError):
        c.remove("x", "a")
    c.drop("x")
    assert catalog.Catalog.stored(spark, path).names() == ["new"] and snapshot.listed(spark, path) == ["new"]
    with pytest.raises(EngineError):
        catalog.Catalog.stored(spark, path, auto_create=False).for_write("y")


def test_metrics(spark):
    d = spark.createDataFrame([('a"\\\nb', 3, 0.5)], "collection string, devices bigint, fast_move_ratio double")
    page = catalog.metrics_page(catalog.metrics_text(d))
    assert '# TYPE shoal_devices gauge' in page and 'shoal_devices{collection="a\\"\\\\\\nb"} 3' in page and page.count("HELP") == 2 and "} 0.5000" in page


def test_bodies_in_files(spark, tmp_path):
    one = '{"id":"a",\n "lng":1, "lat":2}'
    for name, text, n in (("array", f"[{one},\n{one}]\n", 2), ("points", f'{{"points":\n[{one}]}}', 1), ("lines", '{"id":"a","lng":1,"lat":2}\n\n{"id":"b","lng":1,"lat":2}\n', 2), ("empty", "", 0)):
        (tmp_path / name).write_text(text)
        assert ingest.parse(ingest.read_bodies(spark, f"file://{tmp_path / name}")).count() == n
    assert [r.problem is None for r in ingest.within_limit(bodies(spark, "x" * 10, "é" * 5, "é" * 6), 10).collect()] == [True, True, False]
    assert geo.parse_zoom(None) == geo.parse_zoom(" ") == 0.0 and geo.parse_zoom("3.5") == 3.5
    for bad in ("x", "nan", "inf"):
        with pytest.raises(EngineError):
            geo.parse_zoom(bad)


def test_one_tile(spark):
    from shoal.operators import net
    from shoal.plans import reads

    rows = [("t", k, 300_000_000 + 40_000_000 * k, 500_000_000, 0) for k in range(10)]
    opts = Options()
    nodes = net.build_nodes(spark.createDataFrame(rows, "collection string, num bigint, qx bigint, qy bigint, cat int"), opts)
    segs = net.segments(nodes, opts)
    every = {(r.tx, r.ty): bytes(r.tile) for r in tiles.tile_mvt(reads.tile_features(segs, opts, 4), opts).collect()}
    assert every
    for (x, y), raw in every.items():
        assert tiles.tile(segs, opts, 4, x, y) == raw
    assert tiles.tile(segs, opts, 4, 0, 0) == b"" and tiles.tile(segs, opts, 4, 0, 0, kind="json") == []
    assert len(tiles.tile(segs, opts, 4, *next(iter(every)), kind="json")) >= 1
    for bad in ((4, 16, 0), (4, 0, -1), (21, 0, 0)):
        with pytest.raises(EngineError):
            tiles.tile(segs, opts, *bad)


def test_silent_devices_leave_in_a_replay():
    c = replay.Collection(Options(ttl_seconds=300))
    s = 1_000_000
    c.apply("upsert", "a", 1, 1, 2, 0, '{"k":1}')
    c.apply("upsert", "b", 500_000, 1, 0, 10 * s)
    c.apply("upsert", "a", 2, 2, 1, 200 * s)
    assert len(c.net.points) == 2 and c.props == {0: '{"k":1}'} and c.net.points[0].cat == 2
    c.apply("upsert", "c", 9, 9, 0, 400 * s)  # b is silent for 390 s
    assert set(c.net.points) == {0, 2} and c.expired == 1
    c.apply("upsert", "b", 5, 5, 1, 401 * s)
    assert c.net.points[1].cat == 1  # a new life, the old number
    assert c.sweep(501 * s) == 1 and c.sweep(5_000 * s) == 2 and not c.net.points and c.expired == 4


def run_live(spark, tmp_path, lots, opts, emit, clock):
    schema = "seq bigint, s bigint, collection string, op string, id string, qx bigint, qy bigint, cat int, props string"
    got = []
    for k, rows in enumerate(lots):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.keep(live.read_reports(spark, str(tmp_path / "in"), df.schema, 100), opts, emit, clock)
        live.run_available(stream, lambda batch, _: got.append([r.asDict() for r in batch.collect()]), str(tmp_path / "ck"))
    return [r for b in got for r in b]


def test_a_silent_collection_drains_in_the_stream(spark, tmp_path):
    opts = Options(ttl_seconds=300)
    up = lambda seq, s, c, i: (seq, 1000 + s, c, "upsert", i, 10 * seq, 10, 0, '{"n":1}')
    lots = [[up(1, 0, "quiet", "a"), up(2, 100, "quiet", "b"), up(3, 100, "busy", "z")], [up(4, 350, "busy", "z")], [up(5, 2000, "busy", "z")], [up(6, 2001, "busy", "z")]]
    got = run_live(spark, tmp_path, lots, opts, "counts", "event")
    last = {r["collection"]: (r["devices"], r["expired"]) for r in got}
    assert last["quiet"] == (0, 2), [(r["devices"], r["expired"], r["inserts"], r["removes"]) for r in got if r["collection"] == "quiet"]
    assert any(r["collection"] == "quiet" and r["devices"] == 1 for r in got) or any(r["collection"] == "quiet" and r["devices"] == 2 for r in got)


def test_the_stream_keeps_props_and_snapshots(spark, tmp_path):
    opts = Options(ttl_seconds=0)
    lots = [[(1, 1, "c", "upsert", "a", 1, 1, 0, '{"n":1}'), (2, 1, "d", "upsert", "q", 1, 1, 0, None)], [(3, 2, "c", "upsert", "b", 9, 9, 1, None), (4, 3, "c", "upsert", "a", 5, 5, 1, None)], [(5, 9, "c", "remove", "b", 0, 0, 0, None)]]
    schema = "seq bigint, s bigint, collection string, op string, id string, qx bigint, qy bigint, cat int, props string"
    path = fresh(spark, "live")
    for rows in lots:
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.run_available(live.keep(live.read_reports(spark, str(tmp_path / "in"), df.schema), opts, "changes"), live.snapshot_sink(path, {"c": opts}), str(tmp_path / "ck"))
    assert {(r.collection, r.id, r.num, r.qx, r.cat, r.props) for r in snapshot.read(spark, path).collect()} == {("c", "a", 0, 5, 0, '{"n":1}'), ("d", "q", 0, 1, 0, None)}


def test_stream_equals_batch(spark, small, tmp_path):
    opts = Options(ttl_seconds=86_400)
    r = views.reports(spark, small).select("collection", "seq", "ts", "op", "id", "qx", "qy", "cat")
    for k in range(3):  # three files, in order
        r.where(f"seq >= {k * 400} AND seq < {(k + 1) * 400}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}

    def sink(batch, _):
        rows = batch.collect()
        for c in {x.collection for x in rows}:
            got[c] = {(x.id, x.tz, x.parent) for x in rows if x.collection == c}

    live.run_available(live.keep(live.read_reports(spark, str(tmp_path / "in"), r.schema), opts, "nodes"), sink, str(tmp_path / "ck"))
    want = {}
    for x in replay.replay_nodes(r.where("seq < 1200"), opts).collect():
        want.setdefault(x.collection, set()).add((x.id, x.tz, x.parent))
    assert got == want
