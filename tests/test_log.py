import random

import pytest
from pyspark.sql import functions as F

from gridlake import patterns
from gridlake.functions.geometry import Geometry
from gridlake.operators import log as wl
from gridlake.schema import parse_schema
from gridlake.streaming import feed

SCHEMA = parse_schema("a u8 DEFAULT 0, b f64, c text(8) NULL", "owner u8 DEFAULT 0")
GEOMETRY = Geometry((2, 2))
SHAPE = "rev long, commit_time_ms long, user string, x long, y long, op string, names array<string>, a smallint, b double, c string"


def random_log(seed, n=120):
    r, out = random.Random(seed), []
    for rev in range(1, n + 1):
        x, y = r.randint(-2, 1), r.randint(-2, 1)
        if r.random() < 0.25:
            out.append((rev, 10 * rev, "u", x, y, "D", None, None, None, None))
        else:
            names = r.choice([None, ["a"], ["b"], ["c"], ["a", "c"]])
            given = names or ["a", "b", "c"]
            out.append((rev, 10 * rev, "u", x, y, "S", names, r.randint(0, 2) if "a" in given else None, r.choice([0.0, -0.0, 1.5, float("nan")]) if "b" in given else None, r.choice([None, "", "x"]) if "c" in given else None))
    return out


def key(v):
    return repr(v)


def model(rows):
    """State, effective writes, versions by chunk, with plain dicts."""
    state, effective, versions = {}, [], {}
    for rev, _, _, x, y, op, names, a, b, c in rows:
        before = state.get((x, y))
        if op == "D":
            after = None
        else:
            after = dict(before) if before else {"a": 0, "b": 0.0, "c": None}
            for n, v in (("a", a), ("b", b), ("c", c)):
                if names is None or n in names:
                    after[n] = v
        if key(before) != key(after):
            effective.append((rev, x, y, key(before), key(after)))
            versions[(x // 2, y // 2)] = rev
        if after is None:
            state.pop((x, y), None)
        else:
            state[(x, y)] = after
    return state, effective, versions


def as_dict(row):
    return None if row is None else row.asDict()


@pytest.mark.parametrize("seed,span", [(1, 1 << 20), (2, 7), (3, 1)])
def test_history_and_state_against_a_model(spark, seed, span):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SHAPE)
    state, effective, versions = model(rows)
    got = wl.history(log, SCHEMA, GEOMETRY, span=span).where("effective").collect()
    assert sorted((r.rev, r.x, r.y, key(as_dict(r.before)), key(as_dict(r.after))) for r in got) == sorted(effective)
    live = wl.fold(log, SCHEMA, GEOMETRY).collect()
    assert {(r.x, r.y): key({"a": r.a, "b": r.b, "c": r.c}) for r in live} == {k: key(v) for k, v in state.items()}
    chunks = wl.identities(log, SCHEMA, GEOMETRY, span=span).collect()
    assert {(r.cx, r.cy): r.version for r in chunks} == versions
    assert {(r.cx, r.cy) for r in chunks if r.populated} == {(x // 2, y // 2) for x, y in state}


def test_fold_at_every_revision(spark):
    rows = random_log(5, 40)
    log = spark.createDataFrame(rows, SHAPE)
    for upto in (1, 13, 27, 40):
        state, _, _ = model([r for r in rows if r[0] <= upto])
        assert {(r.x, r.y) for r in wl.fold(log, SCHEMA, GEOMETRY, upto=upto).collect()} == set(state)


def test_empty_log(spark):
    log = spark.createDataFrame([], SHAPE)
    assert wl.fold(log, SCHEMA, GEOMETRY).count() == 0
    assert wl.identities(log, SCHEMA, GEOMETRY).count() == 0
    assert feed.changes(log, SCHEMA, GEOMETRY).count() == 0


def test_metadata_populates_and_tombstones_are_forgotten(spark):
    log = spark.createDataFrame([(1, 1, "u", 0, 0, "S", None, 1, 0.0, None), (2, 2, "u", 0, 0, "D", None, None, None, None)], SHAPE)
    meta = spark.createDataFrame([(3, 3, 5, 5, None, 7), (4, 4, 6, 6, None, 0)], "rev long, commit_time_ms long, cx long, cy long, names array<string>, owner smallint")
    found = {(r.cx, r.cy): (r.version, r.populated) for r in wl.identities(log, SCHEMA, GEOMETRY, meta=meta).collect()}
    assert found == {(0, 0): (2, False), (5, 5): (3, True), (6, 6): (4, False)}
    assert {(r.cx, r.cy) for r in wl.identities(log, SCHEMA, GEOMETRY, meta=meta, floor=2).collect()} == {(5, 5), (6, 6)}


def test_scan_pages_and_refusals(spark):
    chunks = spark.createDataFrame([(i, -i, i + 1, i % 3 > 0) for i in range(20)], "cx long, cy long, version long, populated boolean")
    seen, after = [], None
    while True:
        page = wl.scan(chunks, GEOMETRY, after=after, limit=4).collect()
        seen += [(r.cx, r.cy) for r in page[:4]]
        if len(page) < 5:
            break
        after = seen[-1]
    assert seen == [(i, -i) for i in range(20) if i % 3 > 0]
    assert [r.cx for r in wl.scan(chunks, GEOMETRY, since=18).collect()] == [18, 19]
    for limit in (0, 1025):
        with pytest.raises(ValueError):
            wl.scan(chunks, GEOMETRY, limit=limit)
    with pytest.raises(ValueError, match="RESYNC_REQUIRED"):
        wl.scan(chunks, GEOMETRY, since=3, floor=4)


def test_chunk_writes(spark):
    blocks = spark.createDataFrame([(0, 0, 1, 1.0, "k"), (1, 0, 2, 2.0, None), (4, 4, 3, 3.0, None)], "x long, y long, a smallint, b double, c string")
    written = spark.createDataFrame([(0, 0)], "cx long, cy long")
    form = spark.createDataFrame([(0, 0, 9), (0, 1, 8)], "x long, y long, a smallint")
    merged = {(r.x, r.y): (r.a, r.b, r.c) for r in wl.merge_chunks(blocks, form, written, SCHEMA, GEOMETRY, ["a"]).collect()}
    assert merged == {(0, 0): (9, 1.0, "k"), (0, 1): (8, 0.0, None), (4, 4): (3, 3.0, None)}
    full = spark.createDataFrame([(1, 1, 5, 5.0, "z")], blocks.schema)
    replaced = {(r.x, r.y): r.a for r in wl.replace_chunks(blocks, full, written, GEOMETRY).collect()}
    assert replaced == {(1, 1): 5, (4, 4): 3}


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(9, 60)
    log = spark.createDataFrame(rows, SHAPE)
    folder = str(tmp_path / "log")
    out = []
    query = None
    for part, (a, b) in enumerate(((1, 20), (21, 45), (46, 60))):
        log.where(F.col("rev").between(a, b)).coalesce(1).write.mode("append").parquet(folder)

        def state(a=a):
            return wl.fold(log, SCHEMA, GEOMETRY, upto=a - 1)

        def write(found, number):
            out.extend((r.rev, r.x, r.y, key(as_dict(r.before)), key(as_dict(r.after))) for r in found.collect())

        stream = spark.readStream.schema(log.schema).parquet(folder)
        query = feed.stream_changes(stream, state, write, SCHEMA, GEOMETRY, str(tmp_path / "cp"))
        query.awaitTermination()
    assert query is not None
    assert sorted(out) == sorted(model(rows)[1])


def test_replay_rebuild_and_timelapse(spark):
    rows = random_log(11, 60)
    log = spark.createDataFrame(rows, SHAPE)
    live = {(r.x, r.y): key((r.a, r.b, r.c)) for r in wl.fold(log, SCHEMA, GEOMETRY).collect()}
    journal = feed.changes(log, SCHEMA, GEOMETRY, after=10)
    again = patterns.replay(wl.fold(log, SCHEMA, GEOMETRY, upto=30), wl.identities(log, SCHEMA, GEOMETRY, upto=30), journal, SCHEMA, GEOMETRY)
    assert {(r.x, r.y): key((r.a, r.b, r.c)) for r in again.collect()} == live
    frames = patterns.timelapse(log, SCHEMA, GEOMETRY, [15, 60]).groupBy("frame").count().collect()
    assert {r.frame: r["count"] for r in frames} == {15: len(model(rows[:15])[0]), 60: len(live)}
    assert patterns.rebuild_at_time(log, SCHEMA, GEOMETRY, 305).count() == len(model(rows[:30])[0])


def test_running_total(spark):
    rows = spark.createDataFrame([(i, (-1) ** i * i) for i in range(300)], "rev long, step long")
    got = {r.rev: r.total for r in patterns.running_total(rows, "rev", "step", "total", span=16).collect()}
    total = 0
    for i in range(300):
        total += (-1) ** i * i
        assert got[i] == total


def test_slots():
    kept = {}
    slots = feed.Slots(lambda: kept.get("s"), lambda text: kept.update(s=text))
    slots.create("a", "t", "e", 5, columns=("x",))
    with pytest.raises(ValueError, match="SLOT_EXISTS"):
        slots.create("a", "t", "e", 5)
    slots.claim("a", "one")
    with pytest.raises(ValueError, match="SLOT_BUSY"):
        slots.claim("a", "two")
    slots.claim("a", "two", takeover=True)
    with pytest.raises(ValueError, match="beyond"):
        slots.ack("a", 6)
    slots.sent("a", 9)
    slots.ack("a", 8)
    assert slots.ack("a", 7).acked == 8
    again = feed.Slots(lambda: kept.get("s"), lambda text: None)
    assert again.retained() == 8 and again.get("a").columns == ("x",)
    again.check_columns(parse_schema("y u8"))
    assert again.get("a").lost == "schema_filter" and again.retained() is None


def test_positions():
    assert feed.start(None, "e", 9, 0) == ("change", 9)
    assert feed.start(("e", 4), "e", 9, 0) == ("change", 4)
    assert feed.start(("e", 4), "e", 9, 5) == ("resync", 9)
    assert feed.start(("p", 7), "e", 9, 0, ("p", 7)) == ("change", 7)
    assert feed.start(("p", 6), "e", 9, 0, ("p", 7)) == ("resync", 9)


@pytest.mark.parametrize("seed,group", [(7, 64), (8, 3), (9, 1)])
def test_chunk_forms_after_each_commit(spark, monkeypatch, seed, group):
    monkeypatch.setattr(feed, "GROUP", group)
    # revisions far apart, and three at a time in one commit as a transaction writes them
    rows, seen = [], set()
    for row in random_log(seed):
        rev = 1000 * (row[0] // 3)
        if (rev, *row[3:5]) not in seen:
            seen.add((rev, *row[3:5]))
            rows.append((rev, *row[1:]))
    rows += [(10**6, 0, "u", x, y, "D", None, None, None, None) for x in (0, 1) for y in (0, 1)]
    want = {}
    for rev in sorted({r[0] for r in rows}):
        state, effective, _ = model([r for r in rows if r[0] <= rev])
        for cx, cy in {(x // 2, y // 2) for at, x, y, *_ in effective if at == rev}:
            want[rev, cx, cy] = sorted((x % 2 + 2 * (y % 2), key(v)) for (x, y), v in state.items() if (x // 2, y // 2) == (cx, cy))
    forms = feed.chunk_forms_at_commits(spark.createDataFrame(rows, SHAPE), SCHEMA, GEOMETRY)
    got = [(r.rev, r.cx, r.cy, [(c["index"], key(as_dict(c.row))) for c in r.cells]) for r in forms.collect()]
    assert len(got) == len(want) and {t[:3]: t[3] for t in got} == want
    assert want[10**6, 0, 0] == []


def test_chunk_forms_broadcast_nothing(spark, sf):
    from gridlake.plans.views import Events

    e = Events(spark, sf)
    forms = feed.chunk_forms_at_commits(e.log, e.schema, e.geometry)
    forms.collect()
    plan = forms._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
