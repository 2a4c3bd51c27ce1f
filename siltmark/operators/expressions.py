"""Expressions of rules as Columns, typed before they are compiled, with a second Column that tells the rows on which Python would raise.

Every node has a kind: number, text, date, truth, span (seconds between dates) or none. Kinds decide what an operation means and where it is a
clash, so that nothing is cast that cannot be, and no row can end a query: casts and sums are the forms that give a gap. `and`, `or`, chains and
conditional expressions pass over what they do not reach, errors included.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import DEFAULT, Config
from siltmark.functions import canon, patterns


class Unsupported(ValueError):
    """The rule cannot be compiled."""


@dataclass(frozen=True)
class Node:
    """A value, its kind, and whether the row raises (None: never)."""

    value: Column
    kind: str
    raises: Column | None = None


@dataclass(frozen=True)
class Compiled:
    """`mask`: rows for which the expression is true; `raises`: rows on which it cannot be evaluated, None where there can be none."""

    mask: Column
    raises: Column | None


KINDS = ((T.BooleanType, "truth"), (T.NumericType, "number"), (T.StringType, "text"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"))
_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_ARITHMETIC = {ast.Add: "try_add", ast.Sub: "try_subtract", ast.Mult: "try_multiply"}
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DAY = 86_400


def kind_of(t: T.DataType) -> str | None:
    return next((k for types, k in KINDS if isinstance(t, types)), None)


def _or(*parts: Column | None) -> Column | None:
    some = [p for p in parts if p is not None]
    return reduce(lambda a, b: a | b, some) if some else None


def _and(a: Column, b: Column | None) -> Column | None:
    return None if b is None else a & b


def _modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor, null for a divisor of 0."""
    return F.when(b > 0, F.pmod(a, F.nullif(b, F.lit(0)))).when(b < 0, -F.pmod(-a, F.nullif(-b, F.lit(0))))


def _both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


class Compiler:
    """One expression over the columns of a table."""

    def __init__(self, df: DataFrame, text: str, config: Config) -> None:
        self.df, self.text, self.config = df, text, config

    def refuse(self, what: object) -> Unsupported:
        name = what if isinstance(what, str) else type(what).__name__
        return Unsupported(f"{name} in {self.text!r}")

    # values

    def go(self, n: ast.AST) -> Node:
        if isinstance(n, ast.Constant):
            return self.constant(n.value)
        if isinstance(n, ast.Subscript):
            return self.column(n) or self.part(n)
        if isinstance(n, ast.BoolOp):
            return self.chain([self.go(v) for v in n.values], isinstance(n.op, ast.And))
        if isinstance(n, ast.UnaryOp):
            return self.unary(n)
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitAnd, ast.BitOr)):
            a, b = self.truth(self.go(n.left)), self.truth(self.go(n.right))
            return Node(a.value & b.value if isinstance(n.op, ast.BitAnd) else a.value | b.value, "truth", _or(a.raises, b.raises))
        if isinstance(n, ast.BinOp):
            return self.arithmetic(n)
        if isinstance(n, ast.Compare):
            return self.comparison(n)
        if isinstance(n, ast.IfExp):
            test, a, b = self.truth(self.go(n.test)), self.go(n.body), self.go(n.orelse)
            if a.kind != b.kind and "none" not in (a.kind, b.kind):
                raise self.refuse("branches of two kinds")
            yes = F.coalesce(test.value, F.lit(False))
            return Node(F.when(yes, a.value).otherwise(b.value), a.kind if a.kind != "none" else b.kind, _or(test.raises, _and(yes, a.raises), _and(~yes, b.raises)))
        if isinstance(n, ast.Attribute):
            return self.attribute(n)
        if isinstance(n, ast.Call):
            return self.call(n)
        raise self.refuse(n)

    def constant(self, v: object) -> Node:
        if v is None:
            return Node(F.lit(None), "none")
        kind = "truth" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else None
        if kind is None or (kind == "number" and isinstance(v, int) and abs(v) >= 1 << 63):
            raise self.refuse(f"constant {v!r}")
        return Node(F.lit(v), kind)

    def column(self, n: ast.Subscript) -> Node | None:
        if not (isinstance(n.value, ast.Name) and n.value.id in ("row", "df") and isinstance(n.slice, ast.Constant)):
            return None
        name = n.slice.value
        if name not in self.df.columns:
            raise self.refuse(f"column {name!r} that is not there")
        kind = kind_of(self.df.schema[name].dataType)
        if kind is None:
            raise self.refuse(f"column {name!r} of nested values")
        return Node(self.df["`" + name.replace("`", "``") + "`"], kind)

    def part(self, n: ast.Subscript) -> Node:
        """A character or a slice of a text, by whole numbers that stand there."""
        x = self.needs(self.go(n.value), "text")
        whole = lambda e: None if e is None else ast.literal_eval(e)
        size = F.char_length(x.value)
        try:
            if isinstance(n.slice, ast.Slice) and n.slice.step is None:
                low, high = whole(n.slice.lower), whole(n.slice.upper)
                place = lambda k, default: default if k is None else F.least(size, F.lit(k)) if k >= 0 else F.greatest(F.lit(0), size + k)
                a, b = place(low, F.lit(0)), place(high, size)
                return Node(x.value.substr(a + 1, F.greatest(F.lit(0), b - a)), "text", x.raises)
            at = whole(n.slice)
            if isinstance(at, int):
                beyond = F.coalesce(size < (at + 1 if at >= 0 else -at), F.lit(False))
                return Node(x.value.substr(F.lit(at + 1) if at >= 0 else size + at + 1, F.lit(1)), "text", _or(x.raises, beyond))
        except (ValueError, TypeError):
            pass
        raise self.refuse(n)

    def needs(self, x: Node, *kinds: str) -> Node:
        """The value as one of these kinds: rows that have another one raise."""
        if x.kind in kinds:
            return x
        return Node(F.lit(None).cast({"text": "string", "number": "double", "date": "timestamp"}.get(kinds[0], "boolean")), kinds[0], _or(x.raises, x.value.isNotNull()) if x.kind != "none" else x.raises)

    def truth(self, x: Node) -> Node:
        made = {"truth": lambda: x.value, "number": lambda: x.value != 0, "span": lambda: x.value != 0, "text": lambda: x.value != "", "date": lambda: x.value.isNotNull(), "none": lambda: F.lit(False)}
        return Node(made[x.kind](), "truth", x.raises)

    # operations

    def chain(self, parts: list[Node], every: bool) -> Node:
        """`and` and `or`: a part is reached where those before it do not decide."""
        out = self.truth(parts[0])
        for p in parts[1:]:
            p = self.truth(p)
            known = F.coalesce(out.value, F.lit(False))
            raises = _or(out.raises, _and(known if every else ~known, p.raises))
            out = Node(out.value & p.value if every else out.value | p.value, "truth", raises)
        return out

    def unary(self, n: ast.UnaryOp) -> Node:
        x = self.go(n.operand)
        if isinstance(n.op, (ast.Not, ast.Invert)):
            t = self.truth(x)
            return Node(~t.value, "truth", t.raises)
        x = self.number(x)
        return Node(F.negative(x.value) if isinstance(n.op, ast.USub) else x.value, "number", x.raises)

    def number(self, x: Node) -> Node:
        return Node(x.value.cast("int"), "number", x.raises) if x.kind == "truth" else self.needs(x, "number")

    def arithmetic(self, n: ast.BinOp) -> Node:
        a, b = self.go(n.left), self.go(n.right)
        if a.kind == b.kind == "text" and isinstance(n.op, ast.Add):
            return Node(F.concat(a.value, b.value), "text", _or(a.raises, b.raises))
        if a.kind == b.kind == "date" and isinstance(n.op, ast.Sub):
            seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
            return Node(seconds(a.value) - seconds(b.value), "span", _or(a.raises, b.raises))
        if {a.kind, b.kind} & {"none", "date", "span"} or ("text" in (a.kind, b.kind) and isinstance(n.op, (ast.Mult, ast.Mod))):
            raise self.refuse(f"{type(n.op).__name__} of {a.kind} and {b.kind}")
        if "text" in (a.kind, b.kind):  # a number and a text
            return Node(F.lit(None).cast("double"), "number", _or(a.raises, b.raises, _both(a.value, b.value)))
        a, b = self.number(a), self.number(b)
        if isinstance(n.op, ast.Div):
            return Node(F.try_divide(a.value, b.value), "number", _or(a.raises, b.raises))
        if isinstance(n.op, ast.Mod):
            return Node(_modulo(a.value, b.value), "number", _or(a.raises, b.raises))
        if type(n.op) not in _ARITHMETIC:
            raise self.refuse(n.op)
        value = getattr(F, _ARITHMETIC[type(n.op)])(a.value, b.value)
        # what does not fit is no number here
        return Node(value, "number", _or(a.raises, b.raises, _both(a.value, b.value) & value.isNull()))

    def compared(self, op: ast.cmpop, a: Node, b: Node) -> tuple[Column, Column | None]:
        """Whether a stands in this order to b, without gaps, and where that is a clash."""
        if type(op) not in _COMPARE:
            raise self.refuse(op)
        same = isinstance(op, (ast.Eq, ast.NotEq))
        differ = F.lit(isinstance(op, ast.NotEq))
        if "none" in (a.kind, b.kind):
            return differ, None if same else _or(a.value.isNotNull() if a.kind != "none" else None, b.value.isNotNull() if b.kind != "none" else None)
        if {a.kind, b.kind} == {"truth", "number"}:
            a, b = self.number(a), self.number(b)
        if {a.kind, b.kind} == {"date", "text"}:  # a text that reads as a date is one
            a, b = (x if x.kind == "date" else Node(canon.try_date(x.value, self.config.date_formats), "date", x.raises) for x in (a, b))
        if a.kind != b.kind:
            return differ, None if same else _both(a.value, b.value)
        return F.coalesce(getattr(a.value, _COMPARE[type(op)])(b.value), differ), None

    def inside(self, op: ast.cmpop, left: Node, right: ast.expr) -> tuple[Column, Column | None]:
        if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
            items = [self.go(e) for e in right.elts]
            raises = _or(*[x.raises for x in items])
            hit = reduce(lambda a, b: a | b, [self.compared(ast.Eq(), left, x)[0] for x in items], F.lit(False))
        else:
            x = self.go(right)
            hit, raises = F.lit(False), _or(x.raises)
            if x.kind == "text" and left.kind == "text":
                hit = F.coalesce(F.contains(x.value, left.value), F.lit(False))
            else:
                raises = _or(raises, x.value.isNotNull())
        return (~hit if isinstance(op, ast.NotIn) else hit), raises

    def comparison(self, n: ast.Compare) -> Node:
        left = self.go(n.left)
        done, raises = F.lit(True), left.raises
        for op, right in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                hit, clash = self.inside(op, left, right)
                then = left
            else:
                then = self.go(right)
                hit, clash = self.compared(op, left, then)
                clash = _or(then.raises, clash)
            raises = _or(raises, _and(done, clash))
            done, left = done & hit, then
        return Node(done, "truth", raises)

    # names

    def attribute(self, n: ast.Attribute) -> Node:
        x = self.go(n.value)
        if n.attr in ("year", "month", "day") and x.kind in ("date", "text", "number"):
            x = self.needs(x, "date")
            return Node({"year": F.year, "month": F.month, "day": F.dayofmonth}[n.attr](x.value), "number", x.raises)
        if n.attr == "days" and x.kind == "span":
            return Node(F.floor(x.value / DAY), "number", x.raises)
        raise self.refuse(f"attribute {n.attr}")

    def read(self, x: Node, how: Callable[[Column], Column], kind: str, coerce: bool) -> Node:
        """A value read from text; rows that do not read raise, unless they are coerced to gaps."""
        value = how(x.value.cast("string"))
        return Node(value, kind, x.raises if coerce else _or(x.raises, x.value.isNotNull() & value.isNull()))

    def call(self, n: ast.Call) -> Node:
        f, keywords = n.func, {k.arg: k.value.value for k in n.keywords if k.arg and isinstance(k.value, ast.Constant)}
        if len(keywords) != len(n.keywords):
            raise self.refuse(n)
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "pd" and len(n.args) == 1:
            return self.of_pandas(f.attr, n.args[0], keywords)
        if keywords:
            raise self.refuse("keywords")
        if isinstance(f, ast.Name):
            return self.function(f.id, n.args)
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "re" and f.attr in ("match", "search", "fullmatch") and len(n.args) == 2 and isinstance(n.args[0], ast.Constant):
            x = self.needs(self.go(n.args[1]), "text")
            return Node(patterns.matches(x.value, n.args[0].value, full=f.attr == "fullmatch", search=f.attr == "search"), "truth", x.raises)
        if isinstance(f, ast.Attribute):
            return self.method(f.attr, self.needs(self.go(f.value), "text"), [self.go(a) for a in n.args])
        raise self.refuse(n)

    def of_pandas(self, name: str, arg: ast.expr, keywords: dict[str, object]) -> Node:
        if name in ("isna", "isnull", "notna", "notnull") and not keywords:
            x = self.go(arg)
            return Node(x.value.isNull() if name in ("isna", "isnull") else x.value.isNotNull(), "truth", x.raises)
        if name in ("to_numeric", "to_datetime") and set(keywords) <= {"errors", "format"} and keywords.get("format", "mixed") == "mixed":
            x, coerce = self.go(arg), keywords.get("errors") == "coerce"
            if name == "to_numeric":
                return self.number(x) if x.kind in ("number", "truth") else self.read(x, canon.try_number, "number", coerce)
            return x if x.kind == "date" else self.read(x, lambda c: canon.try_date(c, self.config.date_formats), "date", coerce)
        raise self.refuse(f"pd.{name}")

    def function(self, name: str, args: list[ast.expr]) -> Node:
        if name == "isinstance" and len(args) == 2:
            kinds = {e.id for e in (args[1].elts if isinstance(args[1], ast.Tuple) else [args[1]]) if isinstance(e, ast.Name)}
            x = self.go(args[0])
            hit = {"text": "str", "truth": "bool"}.get(x.kind) in kinds or (x.kind == "number" and kinds & {"int", "float"})
            return Node(x.value.isNotNull() & F.lit(bool(hit)), "truth", x.raises)
        if len(args) != 1:
            raise self.refuse(name)
        x = self.go(args[0])
        if name == "len":
            x = self.needs(x, "text")
            return Node(F.char_length(x.value), "number", x.raises)
        if name == "str":
            return Node(x.value.cast("string"), "text", x.raises)
        if name == "bool":
            return self.truth(x)
        if name == "abs":
            x = self.number(x)
            return Node(F.abs(x.value), "number", x.raises)
        if name == "float":
            return self.number(x) if x.kind in ("number", "truth") else self.read(x, canon.try_number, "number", False)
        if name == "int":
            if x.kind in ("number", "truth"):
                x = self.number(x)
                return self.read(x, lambda c: F.when(x.value < 0, F.ceil(x.value)).otherwise(F.floor(x.value)).try_cast("bigint"), "number", False)
            return self.read(x, lambda c: F.when(c.rlike(INTEGER), F.trim(c).try_cast("decimal(38,0)")), "number", False)
        raise self.refuse(name)

    def method(self, name: str, x: Node, args: list[Node]) -> Node:
        raises, c = _or(x.raises, *[a.raises for a in args]), x.value
        if not args:
            texts = {"strip": canon.strip, "lower": F.lower, "upper": F.upper, "title": F.initcap, "lstrip": lambda t: F.regexp_replace(t, r"^\s+", ""), "rstrip": lambda t: F.regexp_replace(t, r"\s+\z", "")}
            tests = {"isdigit": r"\A\p{Nd}+\z", "isnumeric": r"\A\p{N}+\z", "isdecimal": r"\A\p{Nd}+\z", "isalpha": r"\A\p{L}+\z", "isalnum": r"\A[\p{L}\p{N}]+\z", "isspace": r"\A\s+\z"}
            if name in texts:
                return Node(texts[name](c), "text", raises)
            if name in tests:
                return Node(c.rlike(tests[name]), "truth", raises)
            if name in ("isupper", "islower"):
                return Node((c == (F.upper if name == "isupper" else F.lower)(c)) & c.rlike(r"\p{L}"), "truth", raises)
        if all(a.kind == "text" for a in args):
            if name in ("startswith", "endswith") and len(args) == 1:
                return Node(getattr(c, name)(args[0].value), "truth", raises)
            if name == "replace" and len(args) == 2:
                return Node(F.replace(c, args[0].value, args[1].value), "text", raises)
        raise self.refuse(f"method {name}")


def _columns(n: ast.AST) -> str | None:
    return n.slice.value if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == "row" and isinstance(n.slice, ast.Constant) else None


def compiled(df: DataFrame, text: str, config: Config = DEFAULT) -> Compiled:
    """A Python-like expression over row['c'] or df['c'], by a whitelist of syntax; anything else is Unsupported.

    A gap compares as not-a-number does there: it is neither equal, less nor greater, is unequal to everything, and is in no list; other operations on a
    gap give a gap. Remainders have the sign of the divisor; what is divided by 0 is a gap. A number and a text are unequal, and raise where they are
    ordered or added; so does what a function cannot read. Two forms say what should hold or be read, and are turned
    round: `row['a'] == row['b']` marks rows where both differ, and `pd.isna(pd.to_numeric(row['a']))`, or to_datetime, those with a value that does not read.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Unsupported(f"no expression: {text!r}") from e
    c = Compiler(df, text, config)
    if isinstance(tree, ast.Compare) and len(tree.ops) == 1 and isinstance(tree.ops[0], ast.Eq) and _columns(tree.left) and _columns(tree.comparators[0]):
        node = c.go(tree)
        return Compiled(~F.coalesce(node.value, F.lit(False)), node.raises)
    if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Attribute) and tree.func.attr in ("isna", "isnull") and len(tree.args) == 1 and isinstance(tree.args[0], ast.Call):
        inner = tree.args[0]
        if isinstance(inner.func, ast.Attribute) and inner.func.attr in ("to_numeric", "to_datetime") and inner.args and _columns(inner.args[0]):
            inner.keywords = [ast.keyword("errors", ast.Constant("coerce"))]
            source, node = c.go(inner.args[0]), c.go(inner)
            return Compiled(source.value.isNotNull() & node.value.isNull(), None)
    node = c.truth(c.go(tree))
    raises = None if node.raises is None else F.coalesce(node.raises, F.lit(False))
    mask = F.coalesce(node.value, F.lit(False))
    return Compiled(mask if raises is None else mask & ~raises, raises)
