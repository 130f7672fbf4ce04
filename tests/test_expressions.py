import math
import random

import pytest

from gridlake.functions import expressions as ex
from gridlake.schema import GridError, parse_schema

SCHEMA = parse_schema("u8c u8, i64c i64, u64c u64, f32c f32, f64c f64, n8 i8 NULL, t text(8), flag bool, m bits(3), by bytes(4)", "k u8 DEFAULT 0")
SHAPE = "x long, y long, u8c smallint, i64c long, u64c decimal(20,0), f32c float, f64c double, n8 tinyint, t string, flag boolean, m string, by binary, `chunk.k` smallint"


def one(spark, **values):
    row = {"x": 3, "y": -4, "u8c": 5, "i64c": -7, "u64c": 2**64 - 1, "f32c": 0.5, "f64c": 2.5, "n8": None, "t": "é", "flag": True, "m": "101", "by": b"\xff", "chunk.k": 9} | values
    from decimal import Decimal

    row["u64c"] = Decimal(row["u64c"])
    return spark.createDataFrame([tuple(row.values())], SHAPE)


def scalar(spark, text, row=None, **more):
    got = (row or one(spark)).select(ex.scalar(text, SCHEMA, **more).alias("v")).first()["v"]
    return int(got) if got is not None and not isinstance(got, (float, str, bool, bytes, bytearray)) else got


def truth(spark, text, row=None, **more):
    return (row or one(spark)).select(ex.condition(text, SCHEMA, **more).alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [
    ("-7 / 2", -3), ("-7 % 2", -1), ("7 % -2", 1), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("10 - 3 - 2", 5), ("- -5", 5),
    ("u64c + u64c - u64c * 2", 0), ("-9223372036854775808 * -9223372036854775808", 2**126), ("i64c / 2", -3), ("POS_X * 10 + POS_Y", 26),
    ("170141183460469231731687 * 1000000 / 7", 170141183460469231731687 * 1000000 // 7), ("LEAST(n8, 3)", 3), ("GREATEST(n8, NULL)", None),
    ("NOW() + 1", 1235), ("COALESCE(n8, u8c)", 5), ("chunk.k * 2", 18), ("n8 + 1", None), ("1 / n8", None),
])
def test_integers(spark, text, value):
    assert scalar(spark, text, now_ms=1234) == value


@pytest.mark.parametrize("text,code", [("1 / 0", "INVALID_ARGUMENT"), ("u8c % (u8c - 5)", "INVALID_ARGUMENT"), ("u64c * u64c * u64c", "OUT_OF_RANGE")])
def test_integer_errors(spark, text, code):
    with pytest.raises(Exception, match=code):
        scalar(spark, text)


@pytest.mark.parametrize("text,value", [
    ("1.0 / 0", math.inf), ("-1 / 0.0", -math.inf), ("0.0 / 0", math.nan), ("5.5 % 0", math.nan), ("-7.5 % 2", -1.5), ("1 / -0.0", -math.inf),
    ("f32c + f64c", 3.0), ("LEAST(1, nan)", math.nan), ("GREATEST(nan, 1)", math.nan), ("LEAST(-0.0, 0.0)", -0.0), ("LEAST(0.0, -0.0)", 0.0), ("inf - inf", math.nan), ("GREATEST(1, 2.5)", 2.5),
])
def test_floats(spark, text, value):
    got = scalar(spark, text)
    assert repr(got) == repr(float(value)), got


@pytest.mark.parametrize("text,value", [
    ("nan = nan", False), ("nan <> nan", True), ("nan < 1", False), ("nan > 1", False), ("-0.0 = 0.0", True),
    ("9007199254740993 = 9007199254740992.0", False), ("9007199254740993 > 9007199254740992.0", True), ("1 < inf", True), ("1 > -inf", True),
    ("u64c < 18446744073709551616.0", True), ("u64c = 18446744073709551616.0", False), ("2 < 2.5", True), ("-3 < -2.5", True),
    ("t > 'z'", True), ("by > x'7f'", True), ("m = b'101'", True), ("flag = TRUE", True), ("flag", True), ("NOT flag", False),
    ("n8 = 1", None), ("n8 IS NULL", True), ("n8 IS NOT NULL", False), ("n8 = 1 OR TRUE", True), ("n8 = 1 AND FALSE", False), ("NOT n8 = 1", None),
    ("u8c IN (1, 5)", True), ("u8c NOT IN (1, NULL)", None), ("u8c IN (5, NULL)", True), ("u8c BETWEEN 1 AND 5", True), ("u8c NOT BETWEEN 6 AND 9", True),
    ("u8c = 5 AND (t = 'a' OR i64c < 0)", True), ("(u8c + 1) * 2 = 12", True), ("EXISTS", True), ("u8c <> 5 AND 1 / (u8c - 5) = 1", False), ("u8c = 5 OR 1 / (u8c - 5) = 1", True),
    ("COALESCE(u8c, 1 / 0) = 5", True), ("i64c = -7", True), ('"t" = \'é\'', True), ("t = 'it''s'", False),
])
def test_conditions(spark, text, value):
    assert truth(spark, text) is value


def test_absent_block(spark):
    from pyspark.sql import functions as F

    gone = F.lit(False)
    for text, value in (("EXISTS", False), ("u8c = 5", None), ("COALESCE(u8c, 0) = 0", True), ("chunk.k = 9", True), ("POS_X = 3", True)):
        assert truth(spark, text, exists=gone) is value


@pytest.mark.parametrize("text,code", [
    ("a < b < c", "INVALID|SYNTAX"), ("u8c < 1 < 2", "SYNTAX"), ("(u8c = 1) + 1 = 2", "SYNTAX"), ("u8c =", "SYNTAX"), ("nope = 1", "INVALID"), ("t = 1", "INVALID"), ("flag < TRUE", "INVALID"),
    ("m < b'101'", "INVALID"), ("m = b'10'", "INVALID"), ("t + 1 = 2", "INVALID"), ("u8c", "INVALID"), ("NULL IN (1, 'a')", "INVALID"), ("POS_Z = 1", "INVALID"), ("u8c IN (POS_X)", "SYNTAX"),
    ("$1 < $2", "INVALID"), ("$1 IN (1, 2)", "INVALID"), ("u8c = $2", "INVALID"), ("COALESCE(u8c, 'a') = 1", "INVALID"), ("u8c = 1 # 2", "SYNTAX"), ("version = 1", "INVALID"),
    ("(" * 40 + "u8c" + ")" * 40 + " = 1", "SYNTAX"), ("u8c IN (" + ",".join(["1"] * 300) + ")", "SYNTAX"),
])
def test_refusals(text, code):
    with pytest.raises(GridError, match=code):
        ex.condition(text, SCHEMA, parameters=[1, 2] if "$2" in text else [1] if "$1" in text else [])


def test_parameters(spark):
    assert truth(spark, "u8c = $1 AND t = $2", parameters=[5, "é"]) is True
    assert truth(spark, "$1 BETWEEN u8c AND u64c", parameters=[2**64 - 1]) is True
    assert truth(spark, "f32c < $1 + f64c", parameters=[0.25]) is True


def test_assignments_read_the_old_row(spark):
    made = ex.assignments("u8c = u8c + POS_X, i64c = u8c, f32c = u8c / 2, n8 = NULL, t = 'x'", SCHEMA)
    row = one(spark).withColumns(made).first()
    assert (row.u8c, row.i64c, row.f32c, row.n8, row.t) == (8, 5, 2.0, None, "x")


@pytest.mark.parametrize("text,code", [("u8c = 300", "OUT_OF_RANGE"), ("f32c = 1e300", "OUT_OF_RANGE"), ("t = 'ninechars'", "OUT_OF_RANGE"), ("u8c = n8", "INVALID_ARGUMENT"), ("n8 = u8c * 100", "OUT_OF_RANGE")])
def test_store_errors(spark, text, code):
    with pytest.raises(Exception, match=code):
        one(spark).withColumns(ex.assignments(text, SCHEMA)).collect()


@pytest.mark.parametrize("text", ["u8c = 1.5", "u8c = NULL", "u8c = 1, u8c = 2", "t = 1", "m = b'10'", "u8c = 'a'"])
def test_assignment_refusals(text):
    with pytest.raises(GridError):
        ex.assignments(text, SCHEMA)


def random_sum(r, depth=0):
    """A random integer expression as text and a function of the row."""
    if depth > 3 or r.random() < 0.25:
        pick = r.choice(["u8c", "i64c", "POS_X", "POS_Y", "lit"])
        if pick == "lit":
            v = r.randint(-9, 9)
            return str(v), lambda _: v
        names = {"POS_X": "x", "POS_Y": "y"}
        return pick, lambda row: row[names.get(pick, pick)]
    (ta, a), (tb, b) = random_sum(r, depth + 1), random_sum(r, depth + 1)
    op = r.choice("+-*/%")

    def run(row):
        p, q = a(row), b(row)
        if op in "/%":
            if q == 0:
                raise ZeroDivisionError
            quotient = abs(p) // abs(q) * (1 if (p < 0) == (q < 0) else -1)
            return quotient if op == "/" else p - q * quotient
        return {"+": p + q, "-": p - q, "*": p * q}[op]

    return f"({ta} {op} {tb})", run


def test_random_sums_against_python(spark):
    r = random.Random(7)
    row = {"u8c": 200, "i64c": -(2**40) + 3, "x": 17, "y": -5}
    wanted, columns = [], []
    while len(wanted) < 60:
        text, run = random_sum(r)
        try:
            value = run(row)
        except ZeroDivisionError:
            continue
        if abs(value) < 10**37:
            wanted.append((text, value))
            columns.append(ex.scalar(text, SCHEMA).alias(f"c{len(columns)}"))
    got = one(spark, **row).select(*columns).first()
    for (text, value), v in zip(wanted, got):
        assert int(v) == value, text


def test_filters_reach_the_scan(spark, tmp_path):
    one(spark).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(ex.condition("u8c >= 3 AND i64c = -7", SCHEMA))._jdf.queryExecution().toString()
    assert "EqualTo(i64c,-7)" in plan and "GreaterThanOrEqual(u8c,3)" in plan
