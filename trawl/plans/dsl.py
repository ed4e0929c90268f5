"""The filter language: text to syntax tree to Column.

    expr := or ['?' branch ':' branch]      branch := literal | expr
    or := and {(OR | '||' | '|') and}       and := not {(AND | '&&' | '&') not}
    not := (NOT | '!') not | '(' expr ')' | field condition
    condition := (= | != | < | <= | > | >=) value | BETWEEN value AND value | IN '(' value {[','] value} ')'
               | CONTAINS value | STARTS WITH value | ENDS WITH value | LIKE value | MATCHES value | IS [NOT] NULL

Keywords are read in any case. A value is a quoted string (no escapes) or an unsigned number. Logic has two values: a predicate
on a missing field is false, but `<` and `<=`, for which null lies below everything, and what negates such a predicate.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import net_string, number


class FilterParseError(ValueError):
    def __init__(self, message: str, expression: str, position: int, suggestion: str = ""):
        self.message, self.expression, self.position, self.suggestion = message, expression, position, suggestion
        pointer = f"\n  {expression}\n  {' ' * position}^" if expression else ""
        super().__init__(f"{message} at {position}{pointer}" + (f"\n{suggestion}" if suggestion else ""))


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Between:
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Text:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class IsNull:
    field: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class If:
    cond: object
    then: object
    other: object


@dataclass(frozen=True)
class Literal:
    value: str


NODES = {c.__name__: c for c in (Compare, Between, In, Text, IsNull, Not, And, Or, If, Literal)}
_KEYWORDS = {"and", "or", "not", "between", "in", "contains", "starts", "ends", "with", "like", "matches", "is", "null"}
_TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>\d[\d.]*)|(?P<name>[^\W\d]\w*)|(?P<op><=|>=|!=|&&|\|\||[=<>()?:,!&|]))""")


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, position); kind is string, number, name, op or, for keywords, the keyword."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            bad = at + len(text[at:]) - len(text[at:].lstrip())
            hint = "a quote is not closed" if text[bad] in "'\"" else "values are quoted strings or unsigned numbers" if text[bad] == "-" else ""
            raise FilterParseError(f"unexpected {text[bad]!r}", text, bad, hint)
        kind, own = m.lastgroup, m[m.lastgroup]
        out.append((own.lower() if kind == "name" and own.lower() in _KEYWORDS else kind, own[1:-1] if kind == "string" else own, m.start(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.all, self.at = text, tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.all[self.at + ahead] if self.at + ahead < len(self.all) else ("end", "", len(self.text))

    def fail(self, message: str, hint: str = ""):
        raise FilterParseError(message, self.text, self.peek()[2], hint)

    def accept(self, *wanted: str) -> bool:
        kind, own, _ = self.peek()
        if kind in wanted or (kind == "op" and own in wanted):
            self.at += 1
            return True
        return False

    def expect(self, wanted: str, hint: str = "") -> None:
        if not self.accept(wanted):
            self.fail(f"expected {wanted.upper()}, found {self.peek()[1] or 'the end'!r}", hint)

    def value(self) -> str:
        kind, own, _ = self.peek()
        if kind not in ("string", "number"):
            self.fail(f"expected a value, found {own or 'the end'!r}", "values are quoted strings or unsigned numbers")
        self.at += 1
        return own

    def branch(self):
        kind, own, _ = self.peek()
        if kind in ("string", "number"):
            self.at += 1
            return Literal(own)
        return self.expression()

    def expression(self):
        cond = self.disjunction()
        if not self.accept("?"):
            return cond
        then = self.branch()
        self.expect(":", "a conditional is written: condition ? a : b")
        return If(cond, then, self.branch())

    def disjunction(self):
        left = self.conjunction()
        while self.accept("or", "||", "|"):
            left = Or(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.accept("and", "&&", "&"):
            left = And(left, self.negation())
        return left

    def negation(self):
        if self.accept("not", "!"):
            return Not(self.negation())
        if self.accept("("):
            inner = self.expression()
            self.expect(")", "a parenthesis is not closed")
            return inner
        kind, own, _ = self.peek()
        if kind in ("string", "number"):
            self.at += 1
            return Literal(own)
        if kind != "name":
            self.fail(f"expected a field, found {own or 'the end'!r}")
        self.at += 1
        return self.condition(own)

    def condition(self, name: str):
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.accept(op):
                v = self.value()
                return Not(Compare(name, "=", v)) if op == "!=" else Compare(name, op, v)
        if self.accept("between"):
            low = self.value()
            self.expect("and", "a range is written: field BETWEEN a AND b")
            return Between(name, low, self.value())
        if self.accept("in"):
            self.expect("(", "a list is written: field IN ('a', 'b')")
            got = []
            while not self.accept(")"):
                got.append(self.value())
                self.accept(",")
            return In(name, tuple(got))
        for op in ("contains", "like", "matches"):
            if self.accept(op):
                v = self.value()
                return Text(name, op, v)
        for op in ("starts", "ends"):
            if self.accept(op):
                self.expect("with", f"written: field {op.upper()} WITH 'text'")
                return Text(name, op, self.value())
        if self.accept("is"):
            negated = self.accept("not")
            self.expect("null")
            return Not(IsNull(name)) if negated else IsNull(name)
        return self.fail(f"expected an operator after {name}", "operators: = != < <= > >= BETWEEN IN CONTAINS STARTS ENDS LIKE MATCHES IS")


def parse(text: str):
    if not text or not text.strip():
        raise FilterParseError("the filter is empty", text or "", 0)
    p = _Parser(text)
    tree = p.expression()
    if p.at < len(p.all):
        p.fail(f"unexpected {p.peek()[1]!r}", "join conditions with AND or OR")
    _check(tree, text)
    return tree


def _check(node, text: str) -> None:
    for value in vars(node).values():
        if type(value).__name__ in NODES:
            _check(value, text)
    if isinstance(node, Text) and node.op == "matches":
        if re.search(r"\(\?<[A-Za-z_]\w*-|\(\?'", node.value):
            raise FilterParseError("balancing groups are not supported", text, max(text.find(node.value), 0))
        try:
            re.compile(node.value)
        except re.error as e:
            raise FilterParseError(f"bad pattern: {e}", text, max(text.find(node.value), 0)) from None


def to_json(node) -> str:
    """The tree as text that from_json reads back, with a version."""

    def plain(n):
        return {"node": type(n).__name__} | {k: plain(v) if type(v).__name__ in NODES else v for k, v in vars(n).items()} if type(n).__name__ in NODES else n

    return json.dumps({"version": 1, "filter": plain(node)})


def from_json(text: str):
    """Raises ValueError on anything that to_json has not written."""

    def node(d):
        if not isinstance(d, dict) or d.get("node") not in NODES:
            raise ValueError("not a stored filter")
        return NODES[d["node"]](**{k: node(v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "node"})

    try:
        got = json.loads(text)
        if got.get("version") != 1:
            raise ValueError("stored by another version")
        return node(got["filter"])
    except (TypeError, KeyError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError(f"not a stored filter: {e}") from None


def save_filter(spark, node, path: str) -> None:
    """Write the tree of a filter (or of its text) to a file, in place of one that may be there."""
    from trawl.sources.store import write_text

    write_text(spark, path, to_json(parse(node) if isinstance(node, str) else node))


def load_filter(spark, path: str):
    """The tree that save_filter wrote; ValueError on anything else."""
    from trawl.sources.store import read_text

    return from_json(read_text(spark, path))


def is_stored_filter(spark, path: str) -> bool:
    try:
        load_filter(spark, path)
    except (ValueError, FileNotFoundError):
        return False
    return True


def pretty(node) -> str:
    """The tree, fully parenthesised, in the filter language."""
    q = lambda v: f"'{v}'" if "'" not in v else f'"{v}"'
    match node:
        case Compare(f, op, v):
            return f"{f} {op} {q(v)}"
        case Between(f, a, b):
            return f"{f} BETWEEN {q(a)} AND {q(b)}"
        case In(f, vs):
            return f"{f} IN ({', '.join(map(q, vs))})"
        case Text(f, op, v):
            return f"{f} {op.upper()}{' WITH' if op in ('starts', 'ends') else ''} {q(v)}"
        case IsNull(f):
            return f"{f} IS NULL"
        case Not(x):
            return f"NOT ({pretty(x)})"
        case And(a, b):
            return f"({pretty(a)}) AND ({pretty(b)})"
        case Or(a, b):
            return f"({pretty(a)}) OR ({pretty(b)})"
        case If(c, a, b):
            return f"({pretty(c)}) ? {pretty(a)} : {pretty(b)}"
        case Literal(v):
            return q(v)
    raise TypeError(node)


class Builder:
    """Filters put together in code: Builder().where(...).and_(...).build()."""

    def __init__(self):
        self.tree = None

    def where(self, field: str, value: object):
        self.tree = Compare(field, "=", str(value))
        return self

    def where_range(self, field: str, low: object, high: object):
        self.tree = Between(field, str(low), str(high))
        return self

    def and_(self, field: str, value: object):
        self.tree = And(self.tree, Compare(field, "=", str(value)))
        return self

    def and_range(self, field: str, low: object, high: object):
        self.tree = And(self.tree, Between(field, str(low), str(high)))
        return self

    def or_(self, field: str, value: object):
        self.tree = Or(self.tree, Compare(field, "=", str(value)))
        return self

    def or_range(self, field: str, low: object, high: object):
        self.tree = Or(self.tree, Between(field, str(low), str(high)))
        return self

    def not_(self):
        self.tree = Not(self.tree)
        return self

    def build(self):
        if self.tree is None:
            raise ValueError("nothing to build: begin with where()")
        return self.tree


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _typed(name: str, dtypes: dict[str, str]) -> tuple[Column, str]:
    if name not in dtypes:
        return F.lit(None).cast("string"), "string"
    dtype = dtypes[name]
    if dtype.startswith(("array", "map", "struct", "binary")):
        raise TypeError(f"field {name} is of type {dtype}; filters compare single values")
    return F.col(name), dtype


def _compare(name: str, op: str, value: str, dtypes: dict[str, str]) -> Column:
    col, dtype = _typed(name, dtypes)
    text = net_string(col, dtype)
    if op == "=":
        if dtype in _NUMERIC[:4] and re.fullmatch(r"0|[1-9]\d{0,17}", value):
            return col.isNotNull() & (col == int(value))
        return text.isNotNull() & (F.lower(text) == value.lower())
    below = op in ("<", "<=")
    numeric = re.fullmatch(r"\d+\.?\d*|\.\d+", value)
    ordered = lambda a, b: {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if dtype in _NUMERIC and numeric:
        # plain comparisons, so that scans can skip row groups
        own = ordered(col, F.lit(float(value)) if "." in value or dtype in ("float", "double") else F.lit(int(value)))
    elif numeric:
        as_number = number(text)
        own = F.when(as_number.isNotNull(), ordered(as_number, F.lit(float(value)))).otherwise(ordered(F.lower(text), F.lit(value.lower())))
    else:
        own = ordered(F.lower(text), F.lit(value.lower()))
    return (col.isNull() | own) if below else (col.isNotNull() & own)


def _like(pattern: str) -> str:
    return "(?id)^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern) + "$"


def _leaf(node, dtypes: dict[str, str]) -> Column:
    match node:
        case Compare(f, op, v):
            return _compare(f, op, v, dtypes)
        case Between(f, a, b):
            return _compare(f, ">=", a, dtypes) & _compare(f, "<=", b, dtypes)
        case In(f, vs):
            col, dtype = _typed(f, dtypes)
            text = net_string(col, dtype)
            return text.isNotNull() & F.lower(text).isin(*(v.lower() for v in vs)) if vs else F.lit(False)
        case IsNull(f):
            col, dtype = _typed(f, dtypes)
            return col.isNull() | (col == "") if dtype == "string" else col.isNull()
        case Text(f, op, v):
            col, dtype = _typed(f, dtypes)
            text = F.coalesce(net_string(col, dtype), F.lit(""))
            if op == "like":
                return text.rlike(_like(v))
            if op == "matches":
                return text.rlike("(?id)" + v)
            low, want = F.lower(text), F.lit(v.lower())
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[op](low, want)
    raise TypeError(f"no filter: {node!r}")


def to_column(node, dtypes: dict[str, str]) -> Column:
    """Whether a row passes: the expression's value is the boolean true. Never null. A field that is not in dtypes is missing.

    A string or number is no boolean: it passes nothing, to the left of AND and OR the other side alone counts, NOT of it is true, and as
    a condition it takes the first branch.
    """
    match node:
        case Literal():
            return F.lit(False)
        case Not(x):
            return _negated(x, dtypes)
        case And(If(c, a, b), r):
            return to_column(If(c, And(a, r), And(b, r)), dtypes)
        case Or(If(c, a, b), r):
            return to_column(If(c, Or(a, r), Or(b, r)), dtypes)
        case And(Literal(), r) | Or(Literal(), r):
            return to_column(r, dtypes)
        case And(a, b):
            return to_column(a, dtypes) & to_column(b, dtypes)
        case Or(a, b):
            return to_column(a, dtypes) | to_column(b, dtypes)
        case If(Literal(), a, _):
            return to_column(a, dtypes)
        case If(If(c, x, y), a, b):
            return to_column(If(c, If(x, a, b), If(y, a, b)), dtypes)
        case If(c, a, b):
            return F.when(to_column(c, dtypes), to_column(a, dtypes)).otherwise(to_column(b, dtypes))
    return _leaf(node, dtypes)


def _negated(node, dtypes: dict[str, str]) -> Column:
    match node:
        case Literal():
            return F.lit(True)
        case If(c, a, b):
            return to_column(If(c, Not(a), Not(b)), dtypes)
        case And(Literal(), r) | Or(Literal(), r):
            return _negated(r, dtypes)
        case And(If(), _) | Or(If(), _):
            first = node.left
            kind = type(node)
            return to_column(If(first.cond, Not(kind(first.then, node.right)), Not(kind(first.other, node.right))), dtypes)
        case And(a, b):
            return ~to_column(a, dtypes) | _negated(b, dtypes)
        case Or(a, b):
            return ~to_column(a, dtypes) & _negated(b, dtypes)
    return ~to_column(node, dtypes)


def to_value(node, dtypes: dict[str, str]) -> Column:
    """The expression's value as text: of a conditional the literal taken, of a predicate true or false."""
    match node:
        case Literal(v):
            return F.lit(v)
        case If(Literal(), a, _):
            return to_value(a, dtypes)
        case If(c, a, b):
            return F.when(to_column(c, dtypes), to_value(a, dtypes)).otherwise(to_value(b, dtypes))
    return to_column(node, dtypes).cast("string")


def where(df: DataFrame, filter_: object) -> DataFrame:
    """The rows that pass: filter_ is text in the filter language, a tree, or a Column of one's own."""
    if isinstance(filter_, Column):
        return df.where(F.coalesce(filter_, F.lit(False)))
    return df.where(to_column(parse(filter_) if isinstance(filter_, str) else filter_, dict(df.dtypes)))


def tree_dict(node) -> dict:
    return asdict(node)
