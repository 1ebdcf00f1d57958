"""The kernel's invariants under random churn, the distributed build, and its reads."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoal.functions.geometry import EngineError, Options
from shoal.operators import bulk, net, replay, search
from shoal.operators.kernel import Net
from shoal.plans import reads, verify


def check(n: Net) -> None:
    """Every invariant of the hierarchy, from scratch."""
    opts, pts = n.opts, n.points
    for num, p in pts.items():
        assert 0 <= p.level <= opts.max_zoom + 1
        if p.level == 0:
            assert p.parent is None
        else:
            q = pts[p.parent]
            assert q.level < p.level and num in q.children
            assert (q.x - p.x) ** 2 + (q.y - p.y) ** 2 <= opts.slack(p.level - 1) ** 2
    nums = sorted(pts)
    for i, a in enumerate(nums):
        for b in nums[:i]:
            z = max(pts[a].level, pts[b].level)
            if z <= opts.max_zoom:
                assert (pts[a].x - pts[b].x) ** 2 + (pts[a].y - pts[b].y) ** 2 > opts.scale(z) ** 2
    for z, grid in enumerate(n.cells):
        listed = {m for cell in grid.values() for m in cell}
        assert listed == {m for m in pts if pts[m].level <= z}


def spot(k: int) -> tuple[int, int]:
    """Spot k of a pattern that repeats on every scale: its digits to the base 5 are steps of ever smaller length."""
    x = y = 0
    for level in range(8):
        step = 1 << (27 - 3 * level)
        digit = k // 5**level % 5
        x += (digit % 3) * step
        y += (digit // 2) * step
    return x, y


_SPOTS = st.integers(0, 5**8 - 1)
_KEYS = st.integers(0, 25)
_SCRIPTS = st.lists(st.one_of(st.tuples(st.just("put"), _KEYS, _SPOTS), st.tuples(st.just("nudge"), _KEYS, st.integers(-20_000, 20_000)), st.tuples(st.just("drop"), _KEYS, st.just(0))), max_size=120)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(_SCRIPTS, st.sampled_from([Options(), Options(max_zoom=3), Options(max_zoom=20, hysteresis=0.0), Options(max_zoom=9, hysteresis=2.0, radius=300.0)]))
def test_scripts_of_operations_keep_every_invariant(script, opts):
    n, want = Net(opts), {}
    for what, key, value in script:
        if what == "put":
            want[key] = spot(value)
        elif what == "nudge" and key in want:
            want[key] = (want[key][0] + value, want[key][1] - value // 3)
        elif what == "drop":
            assert n.remove(key) == (want.pop(key, None) is not None)
        if key in want:
            n.upsert(key, *want[key])
    check(n)
    assert {num: (p.x, p.y) for num, p in n.points.items()} == want
    again = Net(opts)
    again.restore(n.rows())
    check(again)
    assert again.rows() == n.rows()


@settings(max_examples=30, deadline=None, derandomize=True)
@given(st.lists(_SPOTS, max_size=60), st.randoms(use_true_random=False))
def test_insertions_give_the_bulk_build_and_removals_nothing(spots, rnd):
    opts = Options(max_zoom=10)
    n = Net(opts)
    for i, k in enumerate(spots):
        n.upsert(i, *spot(k))
    x, y = (np.array([spot(k)[a] for k in spots], np.int64) for a in (0, 1))
    level, parent = bulk.build(np.arange(len(spots)), x, y, opts)
    assert [(p.level, -1 if p.parent is None else p.parent) for _, p in sorted(n.points.items())] == list(zip(level.tolist(), parent.tolist(), strict=True))
    order = list(n.points)
    rnd.shuffle(order)
    for num in order:
        n.remove(num)
    assert not n.points and not any(n.cells)


def test_children_lists_are_the_parents_turned_round():
    rnd, n = random.Random(8), Net(Options())
    for i in range(300):
        n.upsert(i, *spot(rnd.randrange(5**8)))
    for i in range(0, 300, 3):
        n.remove(i)
    turned = {}
    for num, p in n.points.items():
        turned.setdefault(p.parent, set()).add(num)
    assert all(p.children == turned.get(num, set()) for num, p in n.points.items())


def test_small_moves_are_fast():
    rnd, n = random.Random(3), Net(Options())
    for i in range(300):
        n.upsert(i, 400_000_000 + rnd.randrange(100_000), 600_000_000 + rnd.randrange(100_000))
    for _ in range(2000):
        num = rnd.randrange(300)
        n.upsert(num, n.points[num].x + rnd.randrange(-30, 31), n.points[num].y + rnd.randrange(-30, 31))
    assert n.counts["moves_fast"] > 0.8 * n.counts["moves"]
    check(n)


def points(spark, n, seed=1, collections=("a",)):
    rnd = random.Random(seed)
    rows = [(c, i, *spot(rnd.randrange(5**8)), i % 3) for c in collections for i in range(n)]
    rows += [(c, n + k, 450_000_000, 450_000_000, 0) for c in collections for k in range(12)]
    return spark.createDataFrame(rows, "collection string, num bigint, qx bigint, qy bigint, cat int")


def test_distributed_build_equals_sequential(spark):
    opts = Options(max_zoom=5)
    p = points(spark, 150, collections=("a", "b"))
    local = net.build_nodes(p, opts)
    spread = net.build_nodes(p, opts, local_limit=40)
    key = lambda df: sorted(map(tuple, df.select("collection", "num", "tz", "parent").collect()), key=str)
    assert key(local) == key(spread)


def test_ties_go_by_id_as_text(spark):
    rows = [("t", 9, 0, 0, 0), ("t", 10, 200, 0, 0), ("t", 11, 100, 0, 0)]
    opts = Options(max_zoom=0, radius=150 * 512 / (1 << 30), extent=512.0)
    p = spark.createDataFrame(rows, "collection string, num bigint, qx bigint, qy bigint, cat int")
    got = {r.num: (r.tz, r.parent) for r in net.build_nodes(p, opts).collect()}
    assert got == {9: (0, None), 10: (0, None), 11: (1, 10)}


def test_reads_and_invariants(spark):
    opts = Options()
    nodes = net.build_nodes(points(spark, 120), opts)
    segs = net.segments(nodes, opts)
    assert all(r.violations == 0 for r in verify.verify(nodes, segs, opts).collect())
    for z in (-3, 0, 7, 16, 40):
        assert reads.clusters(segs, opts, z).agg(F.sum("cnt")).first()[0] == 132
    whole = reads.clusters(segs, opts, 6)
    parts = [reads.clusters(segs, opts, 6, cat=k).agg(F.sum("cnt")).first()[0] for k in range(3)]
    assert sum(parts) == 132
    big = whole.where("sx <> cnt * 450000000").orderBy(F.desc("cnt")).first()  # the points on one spot never split
    handle = big.rep * 32 + 6
    kids = reads.children(segs, nodes, opts, handle, "a")
    assert kids.agg(F.sum("cnt")).first()[0] == big.cnt
    pages = [reads.leaves(segs, nodes, handle, "a", 7, k).count() for k in range(0, big.cnt, 7)]
    assert sum(pages) == big.cnt
    with pytest.raises(EngineError):
        reads.leaves(segs, nodes, 999_999 * 32 + 1, "a")
    box = (-180.0, -89.0, 180.0, 89.0)
    assert reads.clusters(segs, opts, 6, box=box).count() == whole.count()
    assert reads.clusters(segs, opts, 6, box=(box[2], box[3], box[0], box[1])).count() == whole.count()


def test_segments_of_both_ways(spark):
    opts = Options()
    nodes = net.build_nodes(points(spark, 100, collections=("a", "b")), opts)
    assert counted(net.segments(nodes, opts)) == counted(net.segments(nodes, opts, local_limit=0))


def counted(df):
    return sorted(map(tuple, df.collect()))


def test_reads_stay_in_their_collection(spark):
    opts = Options()
    p = points(spark, 80, collections=("a",)).unionByName(points(spark, 60, seed=9, collections=("b",)))
    nodes = net.build_nodes(p, opts)
    segs = net.segments(nodes, opts)
    for c, n in (("a", 92), ("b", 72)):
        big = reads.clusters(segs, opts, 2).where((F.col("collection") == c) & (F.col("sx") != F.col("cnt") * 450_000_000)).orderBy(F.desc("cnt")).first()
        assert {r.collection for r in reads.leaves(segs, nodes, big.rep * 32 + 2, c, 500).collect()} == {c}
        kids = reads.children(segs, nodes, opts, big.rep * 32 + 2, c)
        assert kids.agg(F.sum("cnt")).first()[0] == big.cnt and {r.collection for r in kids.collect()} == {c}
        assert {r.collection for r in reads.cluster_of(segs, opts, F.lit(5), 4, c).collect()} == {c}
        assert reads.clusters(segs, opts, 2).where(F.col("collection") == c).agg(F.sum("cnt")).first()[0] == n


def test_boxes_do_not_cut_clusters(spark):
    opts = Options()
    nodes = net.build_nodes(points(spark, 200), opts)
    segs = net.segments(nodes, opts)
    for z in (1, 3, 6):
        whole = reads.features(reads.clusters(segs, opts, z)).collect()
        for box in ((-180.0, 20.0, -100.0, 85.0), (-175.0, 60.0, -150.0, 84.0), (-90.0, 0.0, -40.0, 70.0)):
            want = {(r.rep, r["count"]) for r in whole if box[0] <= r.lng <= box[2] and box[1] <= r.lat <= box[3]}
            assert {(r.rep, r["count"]) for r in reads.features(reads.clusters(segs, opts, z, box=box)).collect()} == want


def test_searches_of_dense_places(spark):
    rows = [("a", k, 1000, 1000) for k in range(40)] + [("a", 100, 1000, 1009), ("a", 101, 5000, 5000), ("a", 102, 5000, 5400), ("b", 7, 1000, 1000)]
    p = spark.createDataFrame(rows, "collection string, num bigint, qx bigint, qy bigint")
    dist = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
    for radius in (5.0, 10.0, 401.0):
        best = {}
        for a in rows:
            near = [(dist(a, b), str(b[1]), b[1]) for b in rows if a[0] == b[0] and a[1] != b[1] and dist(a, b) <= radius**2]
            if near:
                best[a[:2]] = min(near)
        got = {(r.collection, r.probe): (r.d2, str(r.other), r.other) for r in search.nearest(p, p, radius).collect()}
        assert got == best
        assert {(r.collection, r.num) for r in search.covered(p, p, radius).collect()} == set(best)
        assert {(r.collection, r.num) for r in search.uncovered(p, p, radius).collect()} == {r[:2] for r in rows} - set(best)


def test_empty_and_single(spark):
    opts = Options()
    empty = spark.createDataFrame([], "collection string, num bigint, qx bigint, qy bigint, cat int")
    nodes = net.build_nodes(empty, opts)
    assert nodes.count() == 0 and net.segments(nodes, opts).count() == 0
    one = net.build_nodes(spark.createDataFrame([("x", 0, 5, 5, None)], "collection string, num bigint, qx bigint, qy bigint, cat int"), opts)
    assert [(r.tz, r.parent) for r in one.collect()] == [(0, None)]


def test_replay_insert_only_equals_build(spark):
    opts = Options(ttl_seconds=0)
    p = points(spark, 100)
    r = p.select("collection", F.col("num").alias("seq"), F.timestamp_seconds("num").alias("ts"), F.lit("upsert").alias("op"), F.col("num").cast("string").alias("id"), "qx", "qy", "cat")
    a = {(x.num, x.tz, x.parent) for x in replay.replay_nodes(r, opts).collect()}
    assert a == {(x.num, x.tz, x.parent) for x in net.build_nodes(p, opts).collect()}


def plans_of(monkeypatch, module):
    """The plans of all tables that a module stores from now on."""
    plans, store = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, tag))
    return plans


def test_no_table_of_the_build_goes_through_the_driver(spark, monkeypatch):
    plans, opts = plans_of(monkeypatch, net), Options(max_zoom=5)
    p = points(spark, 150)
    nodes = net.build_nodes(p, opts, local_limit=40)
    net.segments(nodes, opts, local_limit=0)
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)


def test_numbers_that_stand_twice_do_not_walk_for_ever(spark):
    rows = [("a", 1, 0, 0, 0, 1, 2), ("a", 2, 0, 0, 0, 1, 1)]
    nodes = spark.createDataFrame(rows, net.NODE_SCHEMA)
    with pytest.raises(ValueError):
        net.segments(nodes, Options(max_zoom=2), local_limit=0)


def test_a_probe_of_the_build_goes_to_four_cells_at_most(spark, monkeypatch):
    seen, spread = [], net.with_near_cells
    monkeypatch.setattr(net, "with_near_cells", lambda df, radius, side: seen.append((df.count(), spread(df, radius, side).count())) or spread(df, radius, side))
    net.build_nodes(points(spark, 300), Options(), local_limit=60)
    assert seen and all(after <= 4 * before for before, after in seen)


def test_pairs_of_the_nearest_search_follow_the_points(spark, monkeypatch):
    n, pairs, within = 50 * 50, [], search.within
    monkeypatch.setattr(search, "within", lambda *a: pairs.append(within(*a).count()) or within(*a))
    p = spark.range(n).selectExpr("'a' AS collection", "id AS num", "id % 50 AS qx", "id div 50 AS qy")
    got = search.nearest(p, p, 300_000.0).collect()
    assert len(got) == n and {r.d2 for r in got} == {1}
    assert sum(pairs) <= 49 * n


def test_replay_sees_reports_a_batch_at_a_time(spark):
    opts = Options(ttl_seconds=40)
    rows = [(c, k, "remove" if k % 11 == 5 else "upsert", f"d{k * 7 % 13}", 450_000_000 + k * k % 97 * 1000, 600_000_000 + k * 37, 1) for k in range(300) for c in ("a", "b", "c")]
    r = spark.createDataFrame(rows, "collection string, seq bigint, op string, id string, qx bigint, qy bigint, cat int").selectExpr("*", "timestamp_seconds(seq * 3) AS ts")
    assert "Grouped" not in (plan := replay.replay_nodes(r, opts)._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan
    want = []
    for name in ("a", "b", "c"):
        c = replay.Collection(opts)
        for k in range(300):
            _, _, op, ident, x, y, cat = rows[3 * k]
            c.apply(op, ident, x, y, cat, k * 3_000_000)
        want += [(name, c.names[num], num, *rest) for num, *rest in c.net.rows()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert counted(replay.replay_nodes(r, opts)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reports_of_a_micro_batch_are_held_in_columns():
    import pandas as pd

    from shoal.streaming import live

    n = 10_000
    pdf = pd.DataFrame({"seq": range(n), "ts": pd.Timestamp("2024-01-01"), "op": "upsert", "id": [f"dev-{k}" for k in range(n)], "qx": 1, "qy": 2, "cat": 3, "props": ['{"k": 12}', None] * (n // 2)})
    held = live._packed(pdf)
    assert held.num_rows == n and held.nbytes < 100 * n < pdf.memory_usage(deep=True).sum()
    assert held.column("props").null_count == n // 2


def test_counts_within_a_radius_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "LOT", 40)
    monkeypatch.setattr(search, "within", None)  # no pair of points is made
    rnd = random.Random(5)
    rows = [(c, k, *(rnd.choice(((500, 500), (1500, 800), (0, 0)))[i] + rnd.randrange(-w, w) for i in (0, 1))) for c in "ab" for k in range(400) for w in (rnd.choice((3, 90, 900)),)]
    rows += [("a", 900 + k, 500, 500) for k in range(100)] + [("c", 1, 9, 9)]
    p = spark.createDataFrame(rows, "collection string, num bigint, qx bigint, qy bigint")
    for radius in (40.0, 1000.0):
        want = {}
        for c, num, x, y in rows:
            n = sum(c == d and (x - u) ** 2 + (y - v) ** 2 <= radius**2 for d, _, u, v in rows) - 1
            if n:
                want[c, num] = n
        assert {(r.collection, r.num): r.n for r in search.counts(p, radius).collect()} == want


def test_pairs_of_a_full_cell_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(search, "DEAL", 10)
    p = spark.range(120).selectExpr("'a' AS collection", "id AS num", "id % 7 AS qx", "IF(id < 100, 0, id * 40) AS qy")
    met = search.within_dealt(p, p, 5.0)
    assert counted(met) == counted(search.within(p, p, 5.0))
    assert "lot" in met._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].split("]")[0]
