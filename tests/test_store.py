import pytest

from gridlake.functions.geometry import Geometry
from gridlake.operators import area as areas
from gridlake.plans.statements import Session
from gridlake.schema import GridError, parse_schema
from gridlake.sources import rights
from gridlake.sources.store import Store, Transaction


@pytest.fixture
def session(spark, tmp_path):
    return Session(Store(spark, str(tmp_path / "store")))


def test_blocks_end_to_end(session):
    run = session.run
    assert run("CREATE TABLE world (id u10 REQUIRED, temp i8 NULL, solid bool, h f32, d f64, mask bits(3) NULL, name text(16) NULL, blob bytes(4)) CHUNK 4 x 4 LARGE 2 x 2") == "OK"
    assert run("GET BLOCK 1 3 FROM world") is None
    assert run("SET BLOCK 0 0 IN world id = 1") == 1
    assert run("GET BLOCK 0 0 FROM world") == {"id": 1, "temp": None, "solid": False, "h": 0.0, "d": 0.0, "mask": None, "name": None, "blob": bytearray()}
    assert run("SET BLOCK 0 0 IN world name = 'it''s', mask = b'101', d = 1.5") == 2
    assert run("GET BLOCK 0 0 FROM world COLUMNS name, id") == {"name": "it's", "id": 1}
    assert run("SET BLOCK 0 0 IN world id = 1") == 2  # changes nothing
    with pytest.raises(GridError, match="VERSION_MISMATCH current=2"):
        run("SET BLOCK 0 0 IN world id = 9 IF VERSION 1")
    assert run("GET BLOCK 5 5 FROM world WITH SCHEMA WITH VERSION") == [None, 1, None]
    for bad in ("SET BLOCK 0 0 IN world id = 5000", "SET BLOCK 0 0 IN world id = NULL", "SET BLOCK 9 9 IN world temp = 1", "SET BLOCK 0 0 0 IN world id = 1", "SET BLOCK 0 0 IN world id = 1, id = 2", "SET BLOCK 0 0 IN world nope = 1"):
        with pytest.raises(GridError):
            run(bad)
    run("SET BLOCK 9 -1 IN world id = 3")
    found = [(r.cx, r.cy) for r in run("GET AREA -1 -1 TO 2 0 FROM world").collect()]
    assert found == [(0, 0), (2, -1)]
    assert [(r.cx, r.cy) for r in run("GET AREA AROUND 1 0 RADIUS 1 FROM world").collect()] == [(0, 0)]
    page = run("GET AREA -1 -1 TO 2 0 FROM world LIMIT 4")
    assert page["more"] and page["after"] == (0, 0) and page["chunks"].count() == 1
    assert run("DELETE BLOCK 0 0 FROM world") is not None
    chunk = run("GET CHUNK 0 0 FROM world")
    assert chunk["cells"] == [] and run("GET CHUNK 7 7 FROM world") is None
    assert [(r.cx, r.cy) for r in run("SCAN CHUNKS FROM world")["chunks"].collect()] == [(2, -1)]
    assert [(r.cx, r.populated) for r in run("SCAN CHUNKS FROM world SINCE 2")["chunks"].collect()] == [(0, False), (2, True)]
    assert run("SHOW TABLE STATS world")["tombstones"] == 1
    floor = run(f"COMPACT TOMBSTONES world BEFORE {chunk['version'] + 1}")
    assert floor == chunk["version"] and run("GET CHUNK 0 0 FROM world") is None
    with pytest.raises(GridError, match="RESYNC_REQUIRED"):
        run("SCAN CHUNKS FROM world SINCE 1")
    with pytest.raises(GridError):
        run("GET AREA 0 0 TO 99 99 FROM world")


def test_schema_changes_end_to_end(session):
    run = session.run
    run("CREATE TABLE land (id u10 REQUIRED, light u4 DEFAULT 15, sign text(8) NULL) CHUNK 4x4")
    run("SET BLOCK 0 0 IN land id = 1")
    run("ALTER TABLE land ADD COLUMN depth i8 NULL")
    assert run("GET BLOCK 0 0 FROM land") == {"id": 1, "light": 15, "sign": None, "depth": None}
    run("SET BLOCK 0 0 IN land depth = 100")
    with pytest.raises(GridError, match=r"block \(0, 0\) holds 100"):
        run("ALTER TABLE land ALTER COLUMN depth TYPE i4")
    run("ALTER TABLE land ALTER COLUMN light TYPE u2 USING CLAMP")
    run("ALTER TABLE land RENAME COLUMN light TO lamp")
    assert run("GET BLOCK 0 0 FROM land COLUMNS lamp, depth") == {"lamp": 3, "depth": 100}
    run("ALTER TABLE land DROP COLUMN sign")
    run("ALTER TABLE land DROP COLUMN IF EXISTS sign")
    with pytest.raises(GridError):
        run("ALTER TABLE land ADD COLUMN need u8 REQUIRED")
    run("SET BLOCK 1 0 IN land id = 2")
    assert run("GET BLOCK 1 0 FROM land") == {"id": 2, "lamp": 3, "depth": None}
    assert run("DESCRIBE land")["version"] == 5


def test_metadata_and_forms(session, spark):
    run = session.run
    run("CREATE TABLE volume (a u8 DEFAULT 0, note text(64) NULL) CHUNK 2 x 2 x 2 CHUNK COLUMNS (owner u8 DEFAULT 0)")
    run("SET CHUNK 0 0 0 IN volume META owner = 7")
    assert [(r.cx, r.populated) for r in run("SCAN CHUNKS FROM volume")["chunks"].collect()] == [(0, True)]
    with pytest.raises(GridError, match="VERSION_MISMATCH"):
        run("SET CHUNK 0 0 0 IN volume META owner = 8 IF ABSENT")
    form = spark.createDataFrame([(2, 0, 0, 5, "n"), (3, 1, 1, 6, None)], "x long, y long, z long, a short, note string")
    run("SET CHUNK 1 0 0 IN volume $1", [form])
    assert run("GET BLOCK 3 1 1 FROM volume") == {"a": 6, "note": None}
    run("SET CHUNK 1 0 0 IN volume COLUMNS a $1", [form.limit(1).drop("note")])
    assert run("GET BLOCK 2 0 0 FROM volume") == {"a": 5, "note": "n"} and run("GET BLOCK 3 1 1 FROM volume") is None


def test_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = Session(store), Session(store)
    a.run("CREATE TABLE bank (gold u16) CHUNK 2 x 2")
    a.run("SET BLOCK 0 0 IN bank gold = 10")
    a.run("BEGIN")
    assert a.run("GET BLOCK 0 0 FROM bank") == {"gold": 10}
    a.run("SET BLOCK 0 0 IN bank gold = 4")
    assert a.run("GET BLOCK 0 0 FROM bank") == {"gold": 4} and b.run("GET BLOCK 0 0 FROM bank") == {"gold": 10}
    b.run("SET BLOCK 8 8 IN bank gold = 1")  # another chunk
    assert a.run("COMMIT") == 3 and b.run("GET BLOCK 0 0 FROM bank") == {"gold": 4}
    a.run("BEGIN")
    a.run("GET BLOCK 0 0 FROM bank")
    a.run("SET BLOCK 20 20 IN bank gold = 2")
    b.run("SET BLOCK 1 1 IN bank gold = 3")  # in a chunk that was read
    with pytest.raises(GridError, match="CONFLICT"):
        a.run("COMMIT")
    a.run("BEGIN")
    a.run("DELETE BLOCK 0 0 FROM bank")
    assert a.run("GET BLOCK 0 0 FROM bank") is None
    a.run("ROLLBACK")
    assert a.run("GET BLOCK 0 0 FROM bank") == {"gold": 4}
    a.run("BEGIN")
    assert a.run("COMMIT") is None
    a.run("BEGIN")
    with pytest.raises(GridError):
        a.run("DROP TABLE bank")


def test_feed_slots_and_resync(session):
    run = session.run
    run("CREATE TABLE t (n u8, label text(8) NULL) CHUNK 4 x 4")
    run("CREATE SLOT 's' ON t AREA 0 0 TO 0 0 COLUMNS n")
    run("SET BLOCK 0 0 IN t n = 1")
    run("SET BLOCK 9 9 IN t n = 2")
    run("SET BLOCK 0 0 IN t n = 3")
    got = run("WATCH t SLOT 's'")
    rows = [(r.rev, r.before and r.before.n, r.after and r.after.n) for r in got["changes"].orderBy("rev").collect()]
    assert rows == [(1, None, 1), (3, 1, 3)] and got["progress"][1] == 3
    run("ACK 3 SLOT 's'")
    assert run("WATCH t SLOT 's'")["changes"].count() == 0
    epoch = run("DESCRIBE t")["epoch"]
    assert run(f"WATCH t AFTER '{epoch}' 1")["changes"].count() == 2
    assert run("WATCH t AFTER 'other' 1")["event"] == "resync"
    run("ALTER TABLE t ADD COLUMN extra u8 DEFAULT 0")
    run("ALTER TABLE t DROP COLUMN n") if False else None
    assert run("SHOW SLOTS") == ["s"] and run("DROP SLOT 's'") == "OK"


def test_catalog(session, tmp_path):
    run = session.run
    assert run("MIGRATE 'm1' CREATE TABLE a (k u8) CHUNK 2 x 2") == "applied"
    assert run("MIGRATE 'm1' CREATE TABLE a (k u8) CHUNK 2 x 2") == "skipped"
    with pytest.raises(GridError, match="MIGRATION_MISMATCH"):
        run("MIGRATE 'm1' CREATE TABLE b (k u8)")
    assert [r.name for r in run("SHOW MIGRATIONS").collect()] == ["m1"]
    run("CREATE TABLE b (k u8) CHUNK 2 x 2")
    run("SET BLOCK 0 0 IN a k = 1")
    run("SET BLOCK 0 0 IN b k = 2")
    epoch = run("DESCRIBE a")["epoch"]
    run("SWAP TABLES a, b")
    assert run("GET BLOCK 0 0 FROM a") == {"k": 2} and run("DESCRIBE b")["epoch"] == epoch
    assert run(f"BACKUP TO '{tmp_path}/copy'") == ["a", "b"]
    run(f"RESTORE TABLE b FROM '{tmp_path}/copy' AS c")
    d = run("DESCRIBE c")
    assert d["lineage"] == (epoch, 1) and d["epoch"] != epoch and run("GET BLOCK 0 0 FROM c") == {"k": 1}
    assert session.store.table("c").verify() == []
    run("DROP TABLE c")
    assert run("SHOW TABLES") == ["a", "b"]
    with pytest.raises(GridError, match="NO_TABLE"):
        run("GET BLOCK 0 0 FROM c")


def test_rights(session):
    run = session.run
    run("CREATE TABLE world (k u8) CHUNK 2 x 2")
    run("GRANT READ, WRITE ON world TO bot")
    run("REVOKE WRITE ON world FROM bot")
    assert run("SHOW USERS") == {"bot": {"world": "READ"}}
    bot = Session(session.store, "bot")
    assert bot.run("GET BLOCK 0 0 FROM world") is None
    with pytest.raises(GridError, match="PERMISSION_DENIED"):
        bot.run("SET BLOCK 0 0 IN world k = 1")
    assert rights.grant({"t": 3}, "t", ["READ"]) == {"t": 3} and rights.revoke({"t": 3, "*": 2}, "t", ["READ"]) == {"*": 2}
    assert rights.right({"t": 1, "*": 2}, "t") == 2


@pytest.mark.parametrize("text,message", [
    ("GTE BLOCK 0 0 FROM t", "like it: GET"), ("GET BLOCK 0 FROM t", "column"), ("GET BLOCK 0 0 FROM t COLUMNS", "expected a name"), ("SELECT 1", "unknown statement"), ("CREATE TABLE t (k u99)", "unknown type"),
    ("FLUSH WAL", "UNSUPPORTED"), ("GET BLOCK 0 0\nFROM t", "one statement"), ("GET BLOCK 0 0 FROM t WITH VERSION WITH VERSION", "twice|NO_TABLE"),
])
def test_statement_errors(session, text, message):
    with pytest.raises(GridError, match=message):
        session.run(text)


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    table = store.create("t", parse_schema("k u8"), Geometry((4, 4)))
    rows = spark.createDataFrame([(0, 0, 1)], "x long, y long, k int")
    other = Store(spark, str(tmp_path / "s")).table("t")
    before = table.manifest
    other.write(rows)
    # the number this writer would take is gone
    assert not table.chain.push(table.chain.last()[0], before.dump())
    assert table.write(spark.createDataFrame([(0, 1, 2)], "x long, y long, k int")) == 2
    assert table.blocks().count() == 2
    with pytest.raises(GridError):
        table.write(spark.createDataFrame([(5, 5, 1), (5, 5, 2)], "x long, y long, k int"))
    txn = Transaction(table)
    assert txn.blocks(areas.Box((0, 0), (0, 0))).count() == 2


def test_merged_segments_keep_history(spark, tmp_path):
    from gridlake.schema import parse_column

    table = Store(spark, str(tmp_path / "s")).create("t", parse_schema("k u8"), Geometry((4, 4), (2, 2)))
    for n in range(4):
        table.write(spark.createDataFrame([(n * 5, -n, n), (0, 0, n)], "x long, y long, k int") if n else spark.createDataFrame([(0, 0, 9)], "x long, y long, k int"))
    table.alter(lambda s: s.add(parse_column("note text(4) NULL")))
    table.write(spark.createDataFrame([(0, 0, "n")], "x long, y long, note string"))
    look = lambda: (sorted(map(repr, table.blocks().collect())), sorted(map(repr, table.changes().collect())), sorted(map(repr, table.identities().collect())))
    before = look()
    assert table.merge_segments() == 4 and look() == before
    assert table.vacuum() == 4 and look() == before and table.verify() == []
    assert table.merge_segments() == 0


def test_transaction_covers_chunk_writes_and_required_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = Session(store), Session(store)
    a.run("CREATE TABLE w (id u10 REQUIRED, temp i8 NULL) CHUNK 4 x 4")
    a.run("SET BLOCK 0 0 IN w id = 1")
    form = spark.createDataFrame([(1, 1, 7, 2)], "x long, y long, id int, temp int")
    a.run("BEGIN")
    a.run("SET CHUNK 0 0 IN w $1", [form])
    assert a.run("GET BLOCK 0 0 FROM w") is None and a.run("GET BLOCK 1 1 FROM w") == {"id": 7, "temp": 2}
    assert b.run("GET BLOCK 0 0 FROM w") == {"id": 1, "temp": None}
    a.run("ROLLBACK")
    assert a.run("GET BLOCK 0 0 FROM w") == {"id": 1, "temp": None} and a.run("DESCRIBE w")["revision"] == 1
    a.run("BEGIN")
    with pytest.raises(GridError, match="required"):
        a.run("SET BLOCK 9 9 IN w temp = 3")
    a.run("SET BLOCK 0 0 IN w temp = 4")  # present: id stays
    a.run("SET CHUNK 5 5 IN w COLUMNS id $1", [spark.createDataFrame([(20, 20, 3)], "x long, y long, id int")])
    with pytest.raises(GridError, match="IF VERSION"):
        a.run("DELETE BLOCK 0 0 FROM w IF VERSION 1")
    assert a.run("COMMIT") == 2
    assert a.run("GET BLOCK 0 0 FROM w") == {"id": 1, "temp": 4} and a.run("GET BLOCK 20 20 FROM w") == {"id": 3, "temp": None}
    a.run("BEGIN")
    a.run("SET BLOCK 0 0 IN w temp = 4")
    assert a.run("COMMIT") is None and a.run("DESCRIBE w")["revision"] == 2
    for text in ("SCAN CHUNKS FROM w", "SHOW TABLES", "BEGIN"):
        a.run("BEGIN")
        with pytest.raises(GridError):
            a.run(text)
        a.run("ROLLBACK")


def test_reads_in_a_transaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = Session(store), Session(store)
    a.run("CREATE TABLE w (id u10, temp i8 NULL) CHUNK 4 x 4")
    a.run("SET BLOCK 0 0 IN w id = 1")
    a.run("SET BLOCK 8 0 IN w id = 2")
    a.run("BEGIN")
    assert a.run("GET CHUNK 10 10 FROM w") is None
    assert a.run("DELETE BLOCK 40 40 FROM w") is None and a.run("GET CHUNK 10 10 FROM w") is None
    a.run("SET BLOCK 40 40 IN w id = 8")
    chunk = a.run("GET CHUNK 10 10 FROM w")
    assert chunk["version"] is None and [c.id for c in chunk["cells"]] == [8]
    b.run("SET BLOCK 1 0 IN w id = 5")  # the snapshot doesn't see it
    assert a.run("GET CHUNK 0 0 FROM w COLUMNS id")["version"] == 1 and len(a.run("GET CHUNK 0 0 FROM w")["cells"]) == 1
    assert a.run("GET BLOCK 0 0 FROM w COLUMNS id WITH VERSION") == [1, {"id": 1}]
    assert a.run("GET BLOCK 40 40 FROM w COLUMNS id WITH VERSION") == [None, {"id": 8}]
    found = a.run("GET AREA 0 0 TO 10 10 FROM w COLUMNS id").collect()
    assert [(r.cx, r.cy, r.version, [tuple(c) for c in r.cells]) for r in found] == [(0, 0, 1, [(0, 1)]), (2, 0, 2, [(0, 2)]), (10, 10, None, [(0, 8)])]
    page = a.run("GET AREA 0 0 TO 10 10 FROM w LIMIT 12 AFTER 1 0")
    assert page["more"] and [(r.cx, r.cy) for r in page["chunks"].collect()] == [(2, 0)]
    a.run("ROLLBACK")
    assert a.run("GET CHUNK 10 10 FROM w") is None


def test_conditional_chunk_writes_are_one_step(spark, tmp_path, monkeypatch):
    """A writer that comes between the check and the write makes the check run again."""
    store = Store(spark, str(tmp_path / "s"))
    session = Session(store)
    session.run("CREATE TABLE w (id u10) CHUNK 4 x 4 CHUNK COLUMNS (owner u8 DEFAULT 0)")
    session.run("SET BLOCK 0 0 IN w id = 1")
    form = spark.createDataFrame([(0, 0, 9)], "x long, y long, id int")
    checked = Session._expect

    def late(self, *a, **b):
        found = checked(self, *a, **b)
        monkeypatch.setattr(Session, "_expect", checked)
        Session(store).run("SET BLOCK 1 1 IN w id = 2")
        return found

    for text, p in (("SET CHUNK 0 0 IN w $1 IF VERSION 1", [form]), ("SET CHUNK 0 0 IN w META owner = 3 IF VERSION 2", [])):
        monkeypatch.setattr(Session, "_expect", late)
        if "META" in text:
            monkeypatch.setattr(Session, "_expect", lambda self, *a, **b: (checked(self, *a, **b), store.table("w").write(spark.createDataFrame([(2, 2, 2)], "x long, y long, id int")))[0])
        with pytest.raises(GridError, match="VERSION_MISMATCH"):
            session.run(text, p)
        monkeypatch.setattr(Session, "_expect", checked)
    assert session.run("GET BLOCK 0 0 FROM w") == {"id": 1} and session.run("GET BLOCK 1 1 FROM w") == {"id": 2}
    with pytest.raises(GridError, match="another chunk"):
        session.run("SET CHUNK 0 0 IN w $1", [spark.createDataFrame([(50, 50, 1)], "x long, y long, id int")])


def test_writes_that_change_nothing_take_no_revision(session):
    run = session.run
    run("CREATE TABLE w (id u10, h f64) CHUNK 4 x 4 CHUNK COLUMNS (owner u8 REQUIRED, note text(4) NULL)")
    run("SET BLOCK 0 0 IN w id = 1, h = 1.5")
    for text in ("SET BLOCK 0 0 IN w id = 1", "SET BLOCK 0 0 IN w h = 1.5, id = 1", "DELETE BLOCK 1 1 FROM w", "DELETE BLOCK 90 90 FROM w"):
        run(text)
        assert run("DESCRIBE w")["revision"] == 1, text
    with pytest.raises(GridError, match="required"):
        run("SET CHUNK 0 0 IN w META note = 'a'")
    assert run("SET CHUNK 0 0 IN w META owner = 2") == 2 and run("SET CHUNK 0 0 IN w META owner = 2") == 2
    assert run("SET CHUNK 0 0 IN w META note = 'a'") == 3
    with pytest.raises(GridError, match="SYNTAX"):
        run("DROP TABLE w nonsense 5")
    assert run("SHOW TABLES") == ["w"]


def test_users_without_rights(session, tmp_path):
    session.run("CREATE TABLE w (id u10) CHUNK 4 x 4")
    session.run("GRANT WRITE ON w TO eve")
    eve = Session(session.store, "eve")
    for text in ("GRANT ADMIN ON * TO eve", "REVOKE READ ON w FROM eve", "SHOW USERS", f"BACKUP TO '{tmp_path}/b'", f"RESTORE TABLE w FROM '{tmp_path}/b' AS v", "DROP TABLE w"):
        with pytest.raises(GridError, match="PERMISSION_DENIED"):
            eve.run(text)
    session.run("GRANT ADMIN ON * TO root")
    assert Session(session.store, "root").run("GRANT READ ON w TO bob") == "OK"


def test_slots_of_two_consumers(session):
    run = session.run
    run("CREATE TABLE w (id u10) CHUNK 4 x 4")
    run("CREATE SLOT 'a' ON w")
    run("CREATE SLOT 'b' ON w")
    run("SET BLOCK 0 0 IN w id = 1")
    first, second = session.store.slots(), session.store.slots()  # both read before either writes
    first.sent("a", 1)
    second.sent("b", 1)
    first.ack("a", 1)
    second.ack("b", 1)
    now = session.store.slots()
    assert now.get("a").acked == now.get("b").acked == 1 and now.retained() == 1
    now.claim("a", "x")
    now.release("a", "x")
    assert session.store.slots().claim("a", "y").holder == "y"


def test_limits_of_writes_and_transactions(session, monkeypatch):
    from gridlake.sources import store as stored

    run = session.run
    run("CREATE TABLE w (note text(64) NULL, n u8) CHUNK 4 x 4 WITH var_max_chunk_bytes = 40")
    run("SET BLOCK 0 0 IN w note = '0123456789'")  # 22 bytes
    with pytest.raises(GridError, match="OUT_OF_RANGE"):
        run("SET BLOCK 1 0 IN w note = '0123456789'")
    run("SET BLOCK 9 9 IN w note = '0123456789'")  # another chunk
    run("SET BLOCK 0 0 IN w n = 3")
    run("DELETE BLOCK 0 0 FROM w")
    run("SET BLOCK 1 0 IN w note = '0123456789'")
    assert run("GET BLOCK 1 0 FROM w COLUMNS note") == {"note": "0123456789"}
    table = session.store.table("w")
    monkeypatch.setattr(stored, "MAX_READ_CHUNKS", 20)
    txn = Transaction(table)
    txn.blocks(areas.Box((0, 0), (3, 3)))
    txn.blocks(areas.Box((1, 1), (2, 2)))  # the same chunks again
    with pytest.raises(GridError, match="reads at most"):
        txn.blocks(areas.Box((10, 10), (13, 13)))
    with pytest.raises(GridError, match="too long"):
        Transaction(table, seconds=-1).commit()


def test_slots_hold_history_and_are_given_up(session):
    run = session.run
    run("CREATE TABLE w (n u8) CHUNK 4 x 4")
    run("CREATE SLOT 's' ON w")
    for n in range(1, 4):
        run(f"SET BLOCK 0 0 IN w n = {n}")
    run("DELETE BLOCK 0 0 FROM w")
    run("WATCH w SLOT 's'")
    run("ACK 2 SLOT 's'")
    assert run("COMPACT TOMBSTONES w BEFORE 100") == 2
    other = Session(session.store, "bob")
    run("GRANT READ ON w TO bob")
    with pytest.raises(GridError, match="SLOT_BUSY"):
        other.run("WATCH w SLOT 's'")
    assert run("UNWATCH SLOT 's'") == "OK" and other.run("WATCH w SLOT 's'")["changes"].count() == 2
