import pytest
from pyspark.sql import functions as F

from gridlake.schema import F32_MAX, Column, GridError, Type, parse_column, parse_schema


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("old,new,given,wanted", [
    ("u10", "u8", 700, 255), ("i8", "i4", -100, -8), ("i8", "u4", -3, 0), ("u64", "i64", 2**64 - 1, 2**63 - 1), ("f64", "f32", 1e300, F32_MAX), ("f64", "f32", float("inf"), float("inf")), ("u8", "u2", 15, 3),
])
def test_clamp(spark, old, new, given, wanted):
    assert value(spark, Type.parse(new).clamp(Type.parse(old).literal(given))) == wanted


def test_clamp_keeps_nan(spark):
    assert value(spark, Type.parse("f32").clamp(F.lit(float("nan")))) != 0


@pytest.mark.parametrize("kind,given,wanted", [
    ("text(2)", "héllo", "h"), ("text(3)", "héllo", "hé"), ("text(9)", "héllo", "héllo"), ("text(3)", "a😀b", "a"), ("text(5)", "a😀b", "a😀"), ("text(1)", "é", ""), ("text(4)", "", ""), ("text(3)", None, None),
    ("bits(2)", "101", "10"), ("bits(2)", "100", "10"), ("bits(5)", "101", "10100"),
])
def test_truncate(spark, kind, given, wanted):
    assert value(spark, Type.parse(kind).truncate(F.lit(given).cast("string"))) == wanted


def test_fits(spark):
    for kind, given, ok in (("u8", 255, True), ("u8", 256, False), ("u8", -1, False), ("i4", -8, True), ("i4", 8, False), ("bits(2)", "100", True), ("bits(2)", "101", False), ("text(1)", "é", False)):
        assert value(spark, Type.parse(kind).fits(F.lit(given))) is ok, (kind, given)


@pytest.mark.parametrize("text", ["u0", "u65", "i1", "f16", "bits(0)", "bits(65536)", "text(0)", "decimal", "text"])
def test_unknown_types(text):
    with pytest.raises(GridError):
        Type.parse(text)


def test_schema_at_every_version():
    s = [parse_schema("id u10 REQUIRED, light u4 DEFAULT 15, sign text(8) NULL", "owner u8 DEFAULT 0")]
    s.append(s[-1].add(parse_column("depth i8 NULL")))
    s.append(s[-1].rename("light", "lamp"))
    s.append(s[-1].drop("sign"))
    s.append(s[-1].retype("lamp", Type.parse("u2"), "CLAMP"))
    s.append(s[-1].add(parse_column("tag bytes(4) NULL"), "chunk"))
    for k, old in enumerate(s):
        back = s[-1].at(k + 1)
        assert (back.columns, back.chunk_columns, back.version) == (old.columns, old.chunk_columns, k + 1)
    assert len({c.id for c in s[-1].columns + s[-1].chunk_columns}) == len(s[-1].columns) + len(s[-1].chunk_columns)


def test_translate_over_versions(spark):
    s = parse_schema("id u10, light u4 DEFAULT 2")
    rows = spark.createDataFrame([(7, 1, 15), (8, 2, 3)], "rev long, id int, light short")
    t = s.rename("light", "lamp").retype("lamp", Type.parse("u2"), "DEFAULT").add(parse_column("temp i8 DEFAULT -4")).drop("id")
    got = t.translate(rows, 1)
    assert got.columns == ["rev", "lamp", "temp"] and [r.temp for r in got.collect()] == [-4, -4]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1


def test_misfit_is_the_first_in_order(spark):
    s = parse_schema("d i8")
    rows = spark.createDataFrame([(1, 0, 100), (0, 5, 90), (0, 1, 3)], "x long, y long, d short")
    assert tuple(s.misfits(rows, "d", Type.parse("i4"), ["x", "y"]).first()) == (0, 5, 90)


@pytest.mark.parametrize("columns", ["t text(8)", "a u8, a u8", "A-b u8", "a bits(65000), b bits(65000)", "a u8 DEFAULT NULL, b bits(70000)"])
def test_schema_refusals(columns):
    with pytest.raises(GridError):
        parse_schema(columns)


def test_family_rule():
    s = parse_schema("a u8, t text(4)")
    with pytest.raises(GridError):
        s.retype("a", Type.parse("f32"))
    with pytest.raises(GridError):
        s.retype("t", Type.parse("text(2)"), "CLAMP")
    assert Column(0, "a", Type.parse("u8")).initial == 0 and Column(0, "a", Type.parse("u8"), nullable=True).initial is None
