"""Typed expressions over a block's row: conditions and assignments with exact integers and three-valued logic.

``condition`` and ``assignments`` parse a text, check names and types against a schema, give parameters the type of the column
they meet, and build Spark Columns; nothing runs in Python.  Where Spark's own arithmetic differs, the Column guards it:

* integers compute in 38 digits; a result beyond raises OUT_OF_RANGE (the range is a little less than 128 bits);
* floats follow IEEE 754: division by zero gives an infinity or NaN, NaN is unequal to everything and wins LEAST and GREATEST;
* an integer and a float are compared exactly;
* AND, OR and COALESCE don't evaluate what they don't need.

One difference stays: an operand beside a NULL isn't evaluated for its errors, so ``NULL + 1 / 0`` is NULL here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column as Col
from pyspark.sql import functions as F

from gridlake.schema import F32_MAX, GridError, Schema, Type, invalid

MAX_NODES, MAX_DEPTH = 256, 32
#: Fixed: words that an unquoted column name can't be.
KEYWORDS = frozenset("and or not is null in between exists true false inf nan now least greatest coalesce pos_x pos_y pos_z chunk if where".split())
TOKEN = re.compile(
    r"""\s*(?:(?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<bytes>[xX]'[0-9a-fA-F]*')|(?P<bits>[bB]'[01]*')
    |(?P<text>'(?:[^']|'')*')|(?P<param>\$\d+)|(?P<quoted>"[^"]*")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><>|<=|>=|[-+*/%=<>(),.]))""",
    re.VERBOSE,
)
WIDE = "decimal(38,0)"
I64, U64, F32, F64 = Type("i", 64), Type("u", 64), Type("f", 32), Type("f", 64)


def syntax(message: str) -> GridError:
    return GridError("SYNTAX", message)


@dataclass
class Node:
    """``op`` is one of lit, param, col, chunk, pos, now, exists, neg, arith, pick, coalesce, cmp, isnull, in, between, not, and, or."""

    op: str
    args: list[Node] = field(default_factory=list)
    value: Any = None
    kind: str = ""  # category: int, float, bool, text, bytes, bits, null, open (a parameter without a type yet)
    type: Type | None = None  # the column type behind the category, where there is one


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise syntax(f"unexpected character at column {at + 1}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup]))
            at = m.end()
        self.at = self.nodes = self.parens = 0

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        k = self.at + ahead
        return k < len(self.tokens) and self.tokens[k][0] in ("op", "word") and self.tokens[k][1].lower() in texts

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise syntax(f"expected {text.upper()}")

    def node(self, op: str, *args: Node, value: Any = None) -> Node:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise syntax(f"more than {MAX_NODES} nodes")
        made = Node(op, list(args), value)
        if depth(made) > MAX_DEPTH:
            raise syntax(f"more than {MAX_DEPTH} levels")
        return made

    def open(self) -> None:
        self.need("(")
        self.parens += 1
        if self.parens > MAX_DEPTH:
            raise syntax(f"more than {MAX_DEPTH} parentheses")

    def close(self) -> None:
        self.need(")")
        self.parens -= 1

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise syntax(f"unexpected {self.tokens[self.at][1]}")

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = self.node("or", left, self.both())
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = self.node("and", left, self.negated())
        return left

    def negated(self) -> Node:
        turns = 0
        while self.take("not"):
            turns += 1
        found = self.predicate()
        for _ in range(turns):
            found = self.node("not", found)
        return found

    def predicate(self) -> Node:
        if self.take("exists"):
            return self.node("exists")
        if self.peek("("):
            # a parenthesis opens a condition or a sum; what follows the closing one, or what it holds, tells
            start, nodes = self.at, self.nodes
            self.open()
            inner = self.either()
            self.close()
            follows = self.peek("=", "<>", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "is", "in", "between") or self.peek("not") and self.peek("in", "between", ahead=1)
            if not follows:
                return inner
            if inner.op in ("and", "or", "not", "cmp", "isnull", "in", "between", "exists"):
                raise syntax("a condition can't be an operand")
            self.at, self.nodes = start, nodes
        left = self.sum()
        if (op := self.take("=", "<>", "<", "<=", ">", ">=")) is not None:
            found = self.node("cmp", left, self.sum(), value=op)
            if self.peek("=", "<>", "<", "<=", ">", ">="):
                raise syntax("comparisons don't chain")
            return found
        if self.take("is"):
            no = bool(self.take("not"))
            self.need("null")
            return self.node("isnull", left, value=no)
        no = bool(self.peek("not") and self.peek("in", "between", ahead=1) and self.take("not"))
        if self.take("in"):
            self.open()
            items = [self.item()]
            while self.take(","):
                items.append(self.item())
            self.close()
            return self.node("in", left, *items, value=no)
        if self.take("between"):
            low = self.sum()
            self.need("and")
            return self.node("between", left, low, self.sum(), value=no)
        return left

    def item(self) -> Node:
        found = self.factor()
        if found.op not in ("lit", "param"):
            raise syntax("IN takes values and parameters")
        return found

    def sum(self) -> Node:
        left = self.term()
        while op := self.take("+", "-"):
            left = self.node("arith", left, self.term(), value=op)
        return left

    def term(self) -> Node:
        left = self.factor()
        while op := self.take("*", "/", "%"):
            left = self.node("arith", left, self.factor(), value=op)
        return left

    def factor(self) -> Node:
        if self.at >= len(self.tokens):
            raise syntax("unexpected end")
        if self.take("-"):
            signs = 1
            while self.take("-"):
                signs += 1
            kind = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
            found = self.factor()
            if found.op == "lit" and found.kind in ("int", "float") and (kind in ("int", "float") or found.value == float("inf")):
                found.value, signs = -found.value, signs - 1
            for _ in range(signs):
                found = self.node("neg", found)
            return found
        if self.peek("("):
            self.open()
            found = self.sum()
            self.close()
            return found
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "op":
            raise syntax(f"unexpected {text}")
        if kind == "param":
            return self.node("param", value=int(text[1:]))
        if kind == "quoted":
            return self.node("col", value=text[1:-1])
        if kind != "word":
            value = {"int": int, "float": float, "text": lambda t: t[1:-1].replace("''", "'"), "bytes": lambda t: bytes.fromhex(t[2:-1]), "bits": lambda t: t[2:-1]}[kind](text)
            return self.literal(kind, value)
        word = text.lower()
        if word in ("true", "false"):
            return self.literal("bool", word == "true")
        if word in ("inf", "nan"):
            return self.literal("float", float(word))
        if word == "null":
            return self.literal("null", None)
        if word in ("pos_x", "pos_y", "pos_z"):
            return self.node("pos", value=word[-1])
        if word == "now":
            self.open()
            self.close()
            return self.node("now")
        if word in ("least", "greatest", "coalesce"):
            self.open()
            args = [self.sum()]
            while self.take(","):
                args.append(self.sum())
            self.close()
            return self.node("coalesce" if word == "coalesce" else "pick", *args, value=word)
        if word == "chunk":
            self.need(".")
            name = self.tokens[self.at][1].strip('"') if self.at < len(self.tokens) else ""
            self.at += 1
            return self.node("chunk", value=name)
        if word in KEYWORDS:
            raise syntax(f"unexpected {text}")
        return self.node("col", value=word)

    def literal(self, kind: str, value: Any) -> Node:
        found = self.node("lit", value=value)
        found.kind = kind
        found.type = Type("bits", len(value)) if kind == "bits" else None
        return found


def depth(node: Node) -> int:
    deep, level = 0, [node]
    while level:
        level = [a for n in level for a in n.args]
        deep += 1
    return deep


class Planner:
    """Gives every node its type, and parameters the type of the column they meet."""

    def __init__(self, schema: Schema, dims: int, parameters: list[Any]) -> None:
        self.schema, self.dims, self.parameters = schema, dims, parameters

    def plan(self, root: Node, wanted: Type | None = None) -> Node:
        used = sorted(n.value for n in walk(root) if n.op == "param")
        if len(set(used)) < len(used):
            raise invalid("a parameter is used twice")
        self.infer(root)
        self.bind(root, wanted)
        self.infer(root, final=True)
        return root

    def bind(self, node: Node, wanted: Type | None) -> None:
        """Types of parameters, from the top: the other side's column type, or the enclosing one's."""
        if node.op == "param":
            if wanted is None:
                raise invalid(f"${node.value} has no column to take its type from")
            node.type, node.kind = wanted, wanted.family
            return
        if node.op in ("cmp", "in"):
            first, *rest = node.args
            other = next((a.type for a in rest if typed(a)), None)
            self.bind(first, first.type if typed(first) else other)
            for a in rest:
                self.bind(a, first.type if typed(first) else None if node.op == "in" else other)
        elif node.op == "between":
            bounds = [a for a in node.args[1:] if typed(a)]
            self.bind(node.args[0], self.common(bounds))
            first = node.args[0]
            for a in node.args[1:]:
                self.bind(a, first.type if typed(first) else self.common(bounds))
        elif node.op in ("arith", "neg", "pick", "coalesce"):
            inner = self.common([a for a in node.args if typed(a)]) or wanted
            for a in node.args:
                self.bind(a, inner)
        else:
            for a in node.args:
                self.bind(a, Type("bool") if node.op in ("and", "or", "not") and a.kind == "open" and False else None)

    def common(self, nodes: list[Node]) -> Type | None:
        return reduce(merged, [n.type for n in nodes if n.type]) if nodes else None

    def infer(self, node: Node, final: bool = False) -> None:
        for a in node.args:
            self.infer(a, final)
        kinds = [a.kind for a in node.args]
        if node.op == "param":
            node.kind = node.kind or "open"
        elif node.op == "col":
            column = self.schema.column(node.value)
            node.type, node.kind = column.type, column.type.family
        elif node.op == "chunk":
            column = self.schema.column(node.value, "chunk")
            node.type, node.kind = column.type, column.type.family
        elif node.op == "pos":
            if node.value == "z" and self.dims == 2:
                raise invalid("the table has two axes")
            node.type, node.kind = I64, "int"
        elif node.op == "now":
            node.type, node.kind = U64, "int"
        elif node.op in ("neg", "arith", "pick"):
            if bad := [k for k in kinds if k not in ("int", "float", "null", "open")]:
                raise invalid(f"{node.value or '-'} takes numbers, not {bad[0]}")
            self.number(node)
        elif node.op == "coalesce":
            known = {(k, a.type.size if k == "bits" and a.type else 0) for k, a in zip(kinds, node.args) if k not in ("null", "open")}
            if known <= {("int", 0), ("float", 0)} and known:
                self.number(node)
            elif len(known) > 1:
                raise invalid("COALESCE takes arguments of one type")
            else:
                node.kind = known.copy().pop()[0] if known else "open" if "open" in kinds else "null"
                node.type = next((a.type for a in node.args if a.type), None)
        elif node.op in ("cmp", "in", "between"):
            order = node.op == "between" or node.op == "cmp" and node.value not in ("=", "<>")
            for k, a in enumerate(node.args):
                for b in node.args[k + 1 :]:
                    comparable(a, b, order)
            node.kind = "bool"
        elif node.op in ("and", "or", "not"):
            if bad := [k for k in kinds if k not in ("bool", "null")]:
                raise invalid(f"{node.op.upper()} takes conditions, not {bad[0]}")
            node.kind = "bool"
        elif node.op in ("isnull", "exists"):
            node.kind = "bool"

    def number(self, node: Node) -> None:
        kinds = [a.kind for a in node.args if a.kind not in ("null", "open")]
        node.kind = "float" if "float" in kinds else "int" if kinds else "open" if any(a.kind == "open" for a in node.args) else "null"
        types = [a.type for a in node.args if a.type and a.kind in ("int", "float")]
        node.type = reduce(merged, types) if types else None
        if node.kind == "float" and types and (node.type.family != "float" or any(a.kind == "float" and not a.type for a in node.args)):
            node.type = F64


def merged(a: Type, b: Type) -> Type:
    """The common type of two column types, for parameters."""
    if a == b:
        return a
    if "float" in (a.family, b.family):
        return F64
    return I64 if "i" in (a.kind, b.kind) else U64


def typed(node: Node) -> bool:
    return node.type is not None and node.kind not in ("open", "null") and node.op != "lit"


def comparable(a: Node, b: Node, order: bool) -> None:
    known = [n for n in (a, b) if n.kind not in ("null", "open")]
    if len(known) == 2:
        numbers = {a.kind, b.kind} <= {"int", "float"}
        same = a.kind == b.kind and (a.kind != "bits" or a.type.size == b.type.size)
        if not numbers and not same:
            raise invalid(f"cannot compare {a.kind} with {b.kind}")
    if order and any(n.kind in ("bool", "bits") for n in known):
        raise invalid(f"{known[0].kind} supports only = and <>")


def walk(node: Node):
    yield node
    for a in node.args:
        yield from walk(a)


def fail(code: str, message: str, kind: str) -> Col:
    return F.raise_error(F.lit(f"{code} {message}")).cast(kind)


def exact_floor(f: Col) -> Col:
    """Floor of a finite float below 1e38 as a decimal, bit for bit; Spark's own cast goes through rounded text."""
    big = F.lit(2.0**64)
    high = F.floor(f / big).cast("double")
    rest = f - high * big  # a float this large is whole
    middle = F.floor(rest / F.lit(2.0**32)).cast("double")
    low = rest - middle * F.lit(2.0**32)
    part = lambda c: c.cast("bigint").cast(WIDE)
    shift = lambda c, n: (c * F.lit(str(n)).cast(WIDE)).cast(WIDE)
    wide = (shift(part(high), 1 << 64) + shift(part(middle), 1 << 32) + part(low)).cast(WIDE)
    return F.when(F.abs(f) < F.lit(2.0**62), F.floor(f).cast("bigint").cast(WIDE)).otherwise(wide)


def order_int_float(i: Col, f: Col) -> Col:
    """-1, 0 or 1 as an integer is below, equal to or above a float that isn't NaN; null if either is."""
    bound = F.lit(9.9e37)
    whole = exact_floor(f)
    inside = F.when(i < whole, -1).when(i > whole, 1).when((F.abs(f) < F.lit(2.0**62)) & (f > F.floor(f)), -1).otherwise(0)
    return F.when(i.isNull() | f.isNull(), F.lit(None).cast("int")).when(f >= bound, -1).when(f <= -bound, 1).otherwise(inside)


class Builder:
    """Columns of planned nodes.  Block columns are the row's own, chunk columns carry ``chunk_prefix``; ``exists`` says whether the block is present."""

    def __init__(self, parameters: list[Any], now_ms: int, exists: Col | None, chunk_prefix: str) -> None:
        self.parameters, self.now_ms, self.chunk_prefix = parameters, now_ms, chunk_prefix
        self.exists = F.lit(True) if exists is None else exists

    def value(self, node: Node, kind: str | None = None) -> Col:
        """A node's value; ``kind`` float turns an integer into a double."""
        kind = kind or node.kind
        found = getattr(self, f"_{node.op}")(node)
        if node.kind in ("null", "open"):
            return found if kind in ("null", "open") else found.cast({"int": WIDE, "float": "double", "bool": "boolean", "bytes": "binary"}.get(kind, "string"))
        return found.cast("double") if kind == "float" else found

    def _lit(self, node: Node) -> Col:
        if node.kind == "int":
            return F.lit(str(node.value)).cast(WIDE)
        return F.lit(node.value) if node.kind != "null" else F.lit(None)

    def _param(self, node: Node) -> Col:
        value = self.parameters[node.value - 1]
        if value is None:
            return F.lit(None).cast(WIDE if node.kind == "int" else node.type.spark)
        return F.lit(str(value)).cast(WIDE) if node.kind == "int" else F.lit(value).cast("double" if node.kind == "float" else node.type.spark)

    def _column(self, name: str, node: Node) -> Col:
        found = F.when(self.exists, F.col(f"`{name}`")) if node.op == "col" else F.col(f"`{self.chunk_prefix}{name}`")
        return found.cast(WIDE) if node.kind == "int" else found.cast("double") if node.kind == "float" else found

    def _col(self, node: Node) -> Col:
        return self._column(node.value, node)

    _chunk = _col

    def _pos(self, node: Node) -> Col:
        return F.col(node.value).cast(WIDE)

    def _now(self, node: Node) -> Col:
        return F.lit(str(self.now_ms)).cast(WIDE)

    def _exists(self, node: Node) -> Col:
        return self.exists

    def _neg(self, node: Node) -> Col:
        return -self.value(node.args[0], node.kind)

    def _arith(self, node: Node) -> Col:
        a, b = (self.value(x, node.kind) for x in node.args)
        if node.kind in ("null", "open"):
            return F.lit(None)
        return (float_op if node.kind == "float" else int_op)(node.value, a, b)

    def _pick(self, node: Node) -> Col:
        args = [self.value(x, node.kind) for x in node.args]
        if node.kind != "float":
            return args[0] if len(args) == 1 else (F.least if node.value == "least" else F.greatest)(*args)

        def better(acc: Col, x: Col) -> Col:
            wins = x < acc if node.value == "least" else x > acc
            return F.when(x.isNull(), acc).when(acc.isNull(), x).when(F.isnan(acc), acc).when(F.isnan(x), x).when(wins, x).otherwise(acc)

        return reduce(better, args)

    def _coalesce(self, node: Node) -> Col:
        return F.coalesce(*[self.value(x, node.kind) for x in node.args])

    def compare(self, op: str, left: Node, right: Node) -> Col:
        kinds = {left.kind, right.kind}
        if kinds == {"int", "float"}:
            whole, real = (left, right) if left.kind == "int" else (right, left)
            f = self.value(real)
            sign = order_int_float(self.value(whole), f)
            if whole is right:
                sign = -sign
            return F.when(F.isnan(f), F.when(self.value(whole).isNotNull(), F.lit(op == "<>"))).otherwise(relation(op, sign, F.lit(0)))
        kind = next((k for k in (left.kind, right.kind) if k not in ("null", "open")), "null")
        if kind == "null":
            return F.lit(None).cast("boolean")
        plain = self.native(left, right)
        a, b = plain or (self.value(left, kind), self.value(right, kind))
        found = relation(op, a, b)
        if kind != "float":
            return found
        known = a.isNotNull() & b.isNotNull()
        return F.when(known & (F.isnan(a) | F.isnan(b)), F.lit(op == "<>")).otherwise(found)

    def native(self, left: Node, right: Node) -> tuple[Col, Col] | None:
        """A 64-bit column against a literal keeps its type, so that a scan can use the comparison."""
        if left.op == "col" and right.op == "lit" and left.kind == right.kind == "int" and left.type != U64 and -(1 << 63) <= right.value < 1 << 63:
            return F.when(self.exists, F.col(f"`{left.value}`")) if not self.always else F.col(f"`{left.value}`"), F.lit(right.value)
        return None

    always = False

    def _cmp(self, node: Node) -> Col:
        return self.compare(node.value, *node.args)

    def _isnull(self, node: Node) -> Col:
        found = self.value(node.args[0])
        return found.isNotNull() if node.value else found.isNull()

    def _in(self, node: Node) -> Col:
        found = reduce(lambda a, b: a | b, [self.compare("=", node.args[0], x) for x in node.args[1:]])
        return ~found if node.value else found

    def _between(self, node: Node) -> Col:
        found = self.compare(">=", node.args[0], node.args[1]) & self.compare("<=", node.args[0], node.args[2])
        return ~found if node.value else found

    def _not(self, node: Node) -> Col:
        return ~self.value(node.args[0], "bool")

    def _and(self, node: Node) -> Col:
        a, b = (self.value(x, "bool") for x in node.args)
        return a & b if not raises(node.args[1]) else F.when(~a, F.lit(False)).otherwise(a & b)

    def _or(self, node: Node) -> Col:
        a, b = (self.value(x, "bool") for x in node.args)
        return a | b if not raises(node.args[1]) else F.when(a, F.lit(True)).otherwise(a | b)


def raises(node: Node) -> bool:
    """Whether evaluating a node may raise; without that, Spark may reorder conditions and push them down."""
    return any(n.op == "arith" and n.kind == "int" or n.op == "neg" for n in walk(node))


def relation(op: str, a: Col, b: Col) -> Col:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def int_op(op: str, a: Col, b: Col) -> Col:
    known = a.isNotNull() & b.isNotNull()
    none = F.lit(None).cast(WIDE)
    if op in "+-*":
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b).cast(WIDE)
        return F.when(known, F.coalesce(made, fail("OUT_OF_RANGE", "integer result is out of range", WIDE))).otherwise(none)
    zero = fail("INVALID_ARGUMENT", "division by zero", WIDE)
    if op == "%":
        return F.when(known & (b == 0), zero).when(known, (a % b).cast(WIDE)).otherwise(none)
    cut = lambda p, q: ((p - p % q) / q).cast(WIDE)  # noqa: E731  exact: the remainder is taken off first
    unit = F.lit(str(10**19)).cast(WIDE)
    # a quotient has 32 whole digits at most, so a small divisor takes the dividend in two halves
    high, low = cut(a, unit), (a % unit).cast(WIDE)
    halves = (cut(high, b) * unit).cast(WIDE) + cut(((high % b).cast(WIDE) * unit + low).cast(WIDE), b)
    return F.when(known & (b == 0), zero).when(known & (F.abs(b) < 1000000), halves.cast(WIDE)).when(known, cut(a, b)).otherwise(none)


def float_op(op: str, a: Col, b: Col) -> Col:
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    known = a.isNotNull() & b.isNotNull()
    if op == "%":
        return F.when(known & (b == 0), nan).when(known, a % b)
    negative = (a < 0) != (b.cast("string") == "-0.0")
    return F.when(known & (b == 0), F.when((a == 0) | F.isnan(a), nan).when(negative, -inf).otherwise(inf)).when(known, a / b)


def condition(text: str, schema: Schema, *, dims: int = 2, parameters: list[Any] = (), now_ms: int = 0, exists: Col | None = None, chunk_prefix: str = "chunk.") -> Col:  # type: ignore[assignment]
    """A boolean Column, null where unknown; ``where`` drops those rows."""
    parser = Parser(text)
    root = parser.either()
    parser.done()
    check_parameters([root], list(parameters))
    root = Planner(schema, dims, list(parameters)).plan(root)
    if root.kind not in ("bool", "null"):
        raise invalid(f"a condition must be true or false, not {root.kind}")
    builder = Builder(list(parameters), now_ms, exists, chunk_prefix)
    builder.always = exists is None
    return builder.value(root, "bool")


def check_parameters(roots: list[Node], parameters: list[Any]) -> None:
    used = sorted(n.value for r in roots for n in walk(r) if n.op == "param")
    if used != list(range(1, len(parameters) + 1)):
        raise invalid("parameters must be numbered from 1 without gaps, and each used once")


def store(column: Any, node: Node, value: Col) -> Col:
    """A value as its column holds it, or an error."""
    kind, name = column.type, column.name
    if node.kind in ("null", "open"):
        if not column.nullable:
            raise invalid(f"column {name} can't be NULL")
        return F.lit(None).cast(kind.spark)
    ok = node.kind == kind.family or kind.family == "float" and node.kind == "int"
    if not ok or kind.kind == "bits" and node.type and node.type.size != kind.size:
        raise invalid(f"column {name} is {kind}, not {node.kind}")
    if kind.family == "int":
        low, high = (F.lit(str(x)).cast(WIDE) for x in kind.range)
        made = F.when(value.between(low, high), value.cast(kind.spark))
    elif kind == F32:
        value = value.cast("double")
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        made = F.when(~finite | (F.abs(value) <= F.lit(F32_MAX)), value.cast("float"))
    elif kind.family == "float":
        made = value.cast("double")
    elif kind.kind in ("text", "bytes"):
        made = F.when(F.octet_length(value) <= kind.size, value)
    else:
        made = value
    missing = F.lit(None).cast(kind.spark) if column.nullable else fail("INVALID_ARGUMENT", f"column {name} can't be NULL", kind.spark)
    return F.when(value.isNull(), missing).otherwise(F.coalesce(made, fail("OUT_OF_RANGE", f"column {name} doesn't hold the value", kind.spark)))


def assignments(text: str, schema: Schema, *, dims: int = 2, parameters: list[Any] = (), now_ms: int = 0, exists: Col | None = None, chunk_prefix: str = "chunk.") -> dict[str, Col]:  # type: ignore[assignment]
    """Columns by name, all from the row as it was: for one ``withColumns``."""
    parser = Parser(text)
    roots: list[tuple[str, Node]] = []
    while True:
        kind, name = parser.tokens[parser.at] if parser.at < len(parser.tokens) else ("", "")
        parser.at += 1
        if kind not in ("word", "quoted") or kind == "word" and name.lower() in KEYWORDS:
            raise syntax("expected a column")
        parser.need("=")
        roots.append((name.strip('"') if kind == "quoted" else name.lower(), parser.sum()))
        if not parser.take(","):
            break
    parser.done()
    if len({n for n, _ in roots}) < len(roots):
        raise invalid("a column is assigned twice")
    check_parameters([r for _, r in roots], list(parameters))
    out = {}
    for name, root in roots:
        column = schema.column(name)
        root = Planner(schema, dims, list(parameters)).plan(root, column.type)
        builder = Builder(list(parameters), now_ms, exists, chunk_prefix)
        builder.always = exists is None
        out[name] = store(column, root, builder.value(root, root.kind))
    return out


def scalar(text: str, schema: Schema, *, dims: int = 2, parameters: list[Any] = (), now_ms: int = 0, exists: Col | None = None, chunk_prefix: str = "chunk.") -> Col:  # type: ignore[assignment]
    """A sum's value, uncast: integers as decimals, floats as doubles."""
    parser = Parser(text)
    root = parser.sum()
    parser.done()
    check_parameters([root], list(parameters))
    root = Planner(schema, dims, list(parameters)).plan(root)
    builder = Builder(list(parameters), now_ms, exists, chunk_prefix)
    builder.always = exists is None
    return builder.value(root)
