"""The formula language of transformations: analysis on the driver, evaluation as Spark columns.

Literals, ``+ - !``, ``+ - * /``, comparisons, ``?:`` and thirteen functions. A ``Value`` is a set of columns: the kind, the payloads
and the first error. Functions look at all of their arguments; only ``?:`` skips one.

A value is used several times where it goes in (in the result, in the check that it is finite, in the error), so it is bound once:
``with_values`` numbers the distinct nodes of all formulas by their height and computes each height in one projection over the
columns of the one below, a node of each formula in the same columns. Plans grow in proportion to the formulas, and stay in generated code.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import divide, floor_mod, is_finite, round_half_up

#: Functions and how many arguments they take (None: any number).
ARITY = {"ref": (1, 1), "period_ref": (2, 2), "lag": (1, 2), "lead": (1, 2), "sum": (1, None), "average": (1, None), "min": (1, None), "max": (1, None), "when": (3, 3), "coalesce": (1, None), "abs": (1, 1), "mod": (2, 2), "round": (1, 2)}
_TOKEN = re.compile(r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>===|!==|==|!=|>=|<=|&&|\|\||[-+*/%!<>?:(),.\[\]]))""", re.S)
_LEVELS = [["||"], ["&&"], ["==", "!=", "===", "!=="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/", "%"]]


@dataclass(frozen=True)
class Node:
    kind: str  # literal, name, unary, binary, test, call, member, group
    value: object = None
    parts: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Reference:
    metric_id: str
    offset: int = 0
    period_id: str | None = None

    @property
    def key(self) -> str:
        return f"{self.metric_id}|period:{self.period_id}" if self.period_id is not None else f"{self.metric_id}|{self.offset}"


@dataclass(frozen=True)
class Issue:
    """Where in the syntax tree a formula breaks a rule (``$`` is the root), why, and what to write instead."""

    path: str
    reason: str
    suggestion: str


@dataclass
class Analysis:
    references: list[Reference] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)
    metrics: set[str] = field(default_factory=set)

    @property
    def valid(self) -> bool:
        return not self.issues

    @property
    def dependencies(self) -> list[str]:
        return sorted(self.metrics)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"unexpected character at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise SyntaxError(f"expected {op}")
        self.at += 1

    def all(self) -> Node:
        if not self.tokens:
            raise SyntaxError("empty expression")
        node = self.test()
        if self.at < len(self.tokens):
            raise SyntaxError(f"unexpected {self.tokens[self.at][1]}")
        return node

    def test(self) -> Node:
        node = self.binary(0)
        if self.peek() != "?":
            return node
        self.take("?")
        yes = self.test()
        self.take(":")
        return Node("test", None, (node, yes, self.test()))

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        node = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            op = self.peek()
            self.at += 1
            node = Node("binary", op, (node, self.binary(level + 1)))
        return node

    def unary(self) -> Node:
        if self.peek() in ("+", "-", "!"):
            op = self.peek()
            self.at += 1
            return Node("unary", op, (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise SyntaxError("unexpected end")
        group, text = self.tokens[self.at]
        self.at += 1
        if group == "num":
            node = Node("literal", float(text))
        elif group == "str":
            node = Node("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        elif group == "name":
            node = Node("literal", {"true": True, "false": False, "null": None}[text]) if text in ("true", "false", "null") else Node("name", text)
        elif text == "(":
            node = self.test()
            self.take(")")
        else:
            raise SyntaxError(f"unexpected {text}")
        while self.peek() in ("(", ".", "["):
            op = self.peek()
            self.at += 1
            if op == "(":
                args = []
                while self.peek() != ")":
                    args.append(self.test())
                    if self.peek() != ")":
                        self.take(",")
                self.take(")")
                node = Node("call", node, tuple(args))
            elif op == ".":
                self.at += 1
                node = Node("member", None, (node,))
            else:
                inner = self.test()
                self.take("]")
                node = Node("member", None, (node, inner))
        return node


def parse(text: str) -> Node:
    return _Parser(text).all()


#: Functions that refer to observations.
REFERENCES = ("ref", "period_ref", "lag", "lead")
_OPERANDS = {"unary": ("argument",), "binary": ("left", "right"), "test": ("test", "consequent", "alternate")}


def _literal_text(args: tuple[Node, ...], i: int) -> str | None:
    return args[i].value if i < len(args) and args[i].kind == "literal" and isinstance(args[i].value, str) and args[i].value else None


def _reference(name: str, args: tuple[Node, ...], path: str, found: Analysis) -> Reference | None:
    """The reference of a call; what is wrong with its arguments goes to ``found``."""
    metric = _literal_text(args, 0)
    if metric is None:
        found.issues.append(Issue(f"{path}.arguments[0]", f"{name}() needs a literal metric id", f'write the id as text, as in {name}("metric_revenue")'))
        return None
    found.metrics.add(metric)
    if name == "period_ref":
        period = _literal_text(args, 1)
        if period is None:
            found.issues.append(Issue(f"{path}.arguments[1]", "period_ref() needs a literal period id", f'write the id as text, as in period_ref("{metric}", "period_fy2025")'))
            return None
        return Reference(metric, 0, period)
    if name == "ref":
        return Reference(metric)
    n = args[1].value if len(args) > 1 and args[1].kind == "literal" else 1.0 if len(args) == 1 else None
    if not isinstance(n, float) or n < 1 or n != int(n):
        found.issues.append(Issue(f"{path}.arguments[1]", f"{name}() needs a positive whole number of periods", f'write it as a number, as in {name}("{metric}", 1)'))
        return None
    return Reference(metric, int(n) if name == "lead" else -int(n))


def analyze(text: str) -> Analysis:
    """References in order of first sight, and all rules that an expression breaks."""
    found = Analysis()
    try:
        root = parse(text)
    except (SyntaxError, KeyError) as error:
        found.issues.append(Issue("$", f"cannot be parsed: {error}", "use literals, operators and functions of the formula language alone"))
        return found

    def visit(node: Node, path: str) -> None:
        if node.kind == "name":
            found.issues.append(Issue(path, f"name {node.value} is not allowed", "use literals and calls of functions"))
        elif node.kind == "member" or node.kind == "binary" and node.value in ("&&", "||"):
            found.issues.append(Issue(path, "member access is not allowed" if node.kind == "member" else f"operator {node.value} is not allowed", "leave out members, lists, assignments and logical operators"))
        elif node.kind == "call":
            call(node, path)
        else:
            if node.kind == "binary" and node.value == "%":
                found.issues.append(Issue(path, "operator % is not allowed", "use + - * / or a comparison"))
            for part, name in zip(node.parts, _OPERANDS.get(node.kind, ()), strict=False):
                visit(part, f"{path}.{name}")

    def call(node: Node, path: str) -> None:
        name = node.value.value if node.value.kind == "name" else None
        if name is None:
            found.issues.append(Issue(f"{path}.callee", "only named functions can be called", f"use one of {', '.join(ARITY)}"))
        elif name not in ARITY:
            found.issues.append(Issue(f"{path}.callee", f"function {name} is not allowed", f"use one of {', '.join(ARITY)}"))
        else:
            low, high = ARITY[name]
            if len(node.parts) < low or (high is not None and len(node.parts) > high):
                wanted = f"{low} or more" if high is None else " or ".join(str(k) for k in range(low, high + 1))
                found.issues.append(Issue(f"{path}.arguments", f"{name}() received {len(node.parts)} arguments", f"give it {wanted}"))
            if name in REFERENCES:
                ref = _reference(name, node.parts, path, found)
                if ref and ref not in found.references:
                    found.references.append(ref)
        for i, part in enumerate(node.parts):
            visit(part, f"{path}.arguments[{i}]")

    visit(root, "$")
    return found


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass
class Value:
    """A value as columns. ``static`` is its kind where that is known without a row; what is not given is null, an error that is not given none."""

    of_kind: Column | None = None
    number: Column | None = None
    string: Column | None = None
    boolean: Column | None = None
    failure: Column | None = None
    static: str | None = None
    finite: bool = False

    @property
    def kind(self) -> Column:
        return F.lit(self.static) if self.static else _null("string") if self.of_kind is None else self.of_kind

    @property
    def num(self) -> Column:
        return _null("double") if self.number is None else self.number

    @property
    def text(self) -> Column:
        return _null("string") if self.string is None else self.string

    @property
    def flag(self) -> Column:
        return _null("boolean") if self.boolean is None else self.boolean

    @property
    def error(self) -> Column:
        return _null("string") if self.failure is None else self.failure

    def column(self, name: str) -> Column:
        return {"kind": Value.kind, "num": Value.num, "str": Value.text, "bool": Value.flag, "error": Value.error}[name].fget(self)

    def columns(self) -> list[Column]:
        if self.failure is None:
            clean = lambda c, k: F.when(self.kind == k, c)
            return [self.kind.alias("kind"), clean(self.num, "number").alias("num"), clean(self.text, "string").alias("str"), clean(self.flag, "boolean").alias("bool"), self.error.alias("error")]
        clean = lambda c, k: F.when(self.error.isNull() & (self.kind == k), c)
        return [F.when(self.error.isNull(), self.kind).alias("kind"), clean(self.num, "number").alias("num"), clean(self.text, "string").alias("str"), clean(self.flag, "boolean").alias("bool"), self.error.alias("error")]


def _value(kind: str | Column, num: Column | None = None, text: Column | None = None, flag: Column | None = None, error: Column | None = None) -> Value:
    known = isinstance(kind, str)
    return Value(None if known else kind, num, text, flag, error, kind if known else None)


def input_value(x: Column, key: str) -> Value:
    """The value of a resolved input struct (in_id, kind, num, str, bool, in_label); an unresolved one is an error."""
    period = F.coalesce(x["in_label"], F.lit("the requested period"))
    return _value(x["kind"], x["num"], x["str"], x["bool"], F.when(x["in_id"].isNull(), F.concat(F.lit(f"cannot resolve {key.split('|')[0]} for "), period)))


def _number_error(v: Value, label: str) -> Column | None:
    if v.finite:
        return v.failure
    bad = F.lit(True) if v.static not in (None, "number") else ~F.coalesce(is_finite(v.num), F.lit(False))
    return _errors(v.failure, F.when(bad if v.static else (v.kind != "number") | bad, f"{label} requires a finite number"))


def _boolean_error(v: Value, label: str) -> Column | None:
    return v.failure if v.static == "boolean" else _errors(v.failure, F.when(v.kind != "boolean", f"{label} requires a boolean"))


def _errors(*columns: Column | None) -> Column | None:
    """The first error of all that can be one."""
    found = [c for c in columns if c is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def _pick(test: Column, a: Value, b: Value, error: Column | None) -> Value:
    """One of two values; payloads that neither has stay null."""
    either = lambda x, y, kind: None if x is None and y is None else F.when(test, _null(kind) if x is None else x).otherwise(_null(kind) if y is None else y)
    same = a.static if a.static == b.static else None
    return Value(None if same else F.when(test, a.kind).otherwise(b.kind), either(a.number, b.number, "double"), either(a.string, b.string, "string"), either(a.boolean, b.boolean, "boolean"), error, same)


FIELDS = ("kind", "num", "str", "bool", "error")
#: The payload of each kind.
PAYLOAD = {"number": "num", "string": "str", "boolean": "bool", "null": None}


def _parse_valid(text: str) -> Node:
    found = analyze(text)
    if not found.valid:
        raise ValueError("; ".join(issue.reason for issue in found.issues))
    return parse(text)


def _literal(v: object) -> Value:
    if v is None:
        return _value("null")
    if isinstance(v, float):
        return Value(number=F.lit(v), static="number", finite=math.isfinite(v))
    return _value("boolean", flag=F.lit(v)) if isinstance(v, bool) else _value("string", text=F.lit(v))


def _reference_key(node: Node) -> str | None:
    return _reference(node.value.value, node.parts, "$", Analysis()).key if node.kind == "call" and node.value.value in REFERENCES else None


class _Dag:
    """The distinct nodes of a formula, operands first, each with its height; equal parts are one node."""

    def __init__(self, root: Node):
        self.nodes: list[tuple[Node, tuple[int, ...]]] = []
        self.heights: list[int] = []
        self._number: dict[tuple, int] = {}
        self.root = self.add(root)

    def add(self, node: Node) -> int:
        if node.kind == "literal":
            key, kids = ("literal", type(node.value).__name__, node.value), ()
        elif ref := _reference_key(node):
            key, kids = ("input", ref), ()
        else:
            kids = tuple(self.add(p) for p in node.parts)
            key = (node.kind, node.value.value if node.kind == "call" else node.value, kids)
        if key not in self._number:
            self._number[key] = len(self.nodes)
            self.nodes.append((node, kids))
            self.heights.append(-1 if node.kind == "literal" else 1 + max((self.heights[k] for k in kids), default=-1))
        return self._number[key]


def with_values(df: DataFrame, formulas: dict[str | None, str], lookup: Callable[[str], Value], by: str | None = None) -> DataFrame:
    """``df`` with the columns kind, num, str, bool and error: the value of each row's formula.

    formulas: expressions by the value of column ``by``, or one of any key if ``by`` is not given; a row of no formula has nulls.
    """
    dags = {key: _Dag(_parse_valid(text)) for key, text in formulas.items()}
    place: dict[tuple, tuple[int, int]] = {}
    last_use: dict[tuple[int, int], int] = {}
    at_height: dict[int, dict[int, list[tuple]]] = {}
    for key, dag in dags.items():
        used: dict[int, int] = {}
        for i, height in enumerate(dag.heights):
            if height >= 0:
                place[key, i] = (height, used.setdefault(height, 0))
                used[height] += 1
                at_height.setdefault(height, {}).setdefault(place[key, i][1], []).append((key, i))
                for kid in dag.nodes[i][1]:
                    if dag.heights[kid] >= 0:
                        last_use[place[key, kid]] = max(last_use.get(place[key, kid], 0), height)
        if dag.heights[dag.root] >= 0:
            last_use[place[key, dag.root]] = len(formulas) + max(len(d.nodes) for d in dags.values())
    name = lambda spot, f: f"_node_{spot[0]}_{spot[1]}_{f}"
    statics: dict[tuple, str | None] = {}
    held: dict[tuple, list[str]] = {}

    def varying(v: Value) -> list[str]:
        parts = {"kind": None if v.static else v.of_kind, "num": v.number, "str": v.string, "bool": v.boolean, "error": v.failure}
        return [f for f, c in parts.items() if c is not None]

    def value(key: object, i: int) -> Value:
        node = dags[key].nodes[i][0]
        if node.kind == "literal":
            return _literal(node.value)
        have = [F.col(name(place[key, i], f)) if f in held[key, i] else None for f in FIELDS]
        return Value(*have, statics[key, i])

    def computed(key: object, i: int) -> Value:
        node, kids = dags[key].nodes[i]
        return lookup(ref) if (ref := _reference_key(node)) else _apply(node, [value(key, k) for k in kids])

    def case(keys: list[object], each: list[Column]) -> Column:
        if by is None:
            return each[0]
        found = F.when(F.col(by) == F.lit(keys[0]), each[0])
        for key, c in zip(keys[1:], each[1:], strict=True):
            found = found.when(F.col(by) == F.lit(key), c)
        return found

    own, live = df.columns, {}
    for height in sorted(at_height):
        live = {spot: fields for spot, fields in live.items() if last_use.get(spot, 0) >= height}
        made, new = [], {}
        for slot, owners in at_height[height].items():
            values = [computed(*o) for o in owners]
            statics |= {o: v.static for o, v in zip(owners, values, strict=True)}
            held |= {o: varying(v) for o, v in zip(owners, values, strict=True)}
            new[height, slot] = [f for f in FIELDS if any(f in held[o] for o in owners)]
            for f in new[height, slot]:
                having = [(key, v.column(f)) for (key, i), v in zip(owners, values, strict=True) if f in held[key, i]]
                made.append(case([key for key, _ in having], [c for _, c in having]).alias(name((height, slot), f)))
        df = df.select(*own, *(name(spot, f) for spot, fields in live.items() for f in fields), *made)
        live |= new
    roots = {key: value(key, dag.root) for key, dag in dags.items()}
    if by is None:
        return df.select(*own, *next(iter(roots.values())).columns())
    whole = [case(list(roots), [v.column(f) for v in roots.values()]) if roots else None for f in FIELDS]
    return df.select(*own, *Value(*whole).columns())


def _apply(node: Node, parts: list[Value]) -> Value:
    """The value of an operator or a function over the values of its operands."""
    if node.kind == "call":
        return _call(node.value.value, node.parts, parts)
    if node.kind == "unary":
        (v,) = parts
        if node.value == "!":
            return _value("boolean", flag=~v.flag, error=_boolean_error(v, "!"))
        return _value("number", num=-v.num if node.value == "-" else v.num, error=_number_error(v, f"unary {node.value}"))
    if node.kind == "test":
        test, yes, no = parts
        chosen = F.coalesce(test.flag, F.lit(False))
        branch = None if yes.failure is None and no.failure is None else F.when(chosen, yes.error).otherwise(no.error)
        return _pick(chosen, yes, no, _errors(_boolean_error(test, "?:"), branch))
    a, b = parts
    op = node.value
    if op in ("==", "===", "!=", "!=="):
        if a.static == b.static == "number":
            same = (a.num == b.num) & ~F.isnan(a.num)
        else:
            same = (a.kind == b.kind) & F.when(a.kind == "null", F.lit(True)).when(a.kind == "number", (a.num == b.num) & ~F.isnan(a.num)).when(a.kind == "string", a.text == b.text).otherwise(a.flag == b.flag)
        same = F.coalesce(same, F.lit(False))
        return _value("boolean", flag=same if op[0] == "=" else ~same, error=_errors(a.failure, b.failure))
    error = _errors(_number_error(a, op), _number_error(b, op))
    if op in (">", ">=", "<", "<="):
        flag = {">": a.num > b.num, ">=": a.num >= b.num, "<": a.num < b.num, "<=": a.num <= b.num}[op]
        return _value("boolean", flag=flag, error=error)
    num = a.num + b.num if op == "+" else a.num - b.num if op == "-" else a.num * b.num if op == "*" else divide(a.num, b.num)
    return _value("number", num=num, error=error)


def _call(name: str, args: tuple[Node, ...], parts: list[Value]) -> Value:
    if name == "when":
        test, yes, no = parts
        return _pick(F.coalesce(test.flag, F.lit(False)), yes, no, _errors(test.failure, yes.failure, no.failure, None if test.static == "boolean" else F.when(test.kind != "boolean", "when() requires a boolean")))
    if name == "coalesce":
        out = parts[-1]
        for v in reversed(parts[:-1]):
            out = _pick(v.kind != "null", v, out, None)
        out.failure = _errors(*(v.failure for v in parts))
        return out
    error = _errors(*(_number_error(v, f"{name}()") for v in parts))
    nums = [v.num for v in parts]
    if name in ("sum", "average"):
        total = F.lit(0.0)
        for n in nums:
            total = total + n
        return _value("number", num=total if name == "sum" else total / len(nums), error=error)
    if name in ("min", "max"):
        return _value("number", num=nums[0] if len(nums) == 1 else (F.least if name == "min" else F.greatest)(*nums), error=error)
    if name == "abs":
        return _value("number", num=F.abs(nums[0]), error=error)
    if name == "mod":
        return _value("number", num=floor_mod(*nums), error=_errors(error, F.when(nums[1] == 0, "mod() divisor must not be zero")))
    scale = F.lit(1.0) if len(parts) == 1 else F.lit(10.0 ** args[1].value) if args[1].kind == "literal" and isinstance(args[1].value, float) else F.pow(F.lit(10.0), nums[1])
    return _value("number", num=round_half_up(nums[0], scale), error=error)
