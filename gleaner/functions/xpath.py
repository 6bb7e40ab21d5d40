"""Selector strings (an XPath 1.0 subset) compiled to Spark Columns over the ``dom`` row.

A selector is parsed once on the driver and turned into Catalyst expressions over the
page's ``nodes`` array and ``text`` column; nothing is evaluated in Python per row.

Values during compilation:
* node set  -> ``ARRAY<INT>`` of pre-order numbers in document order, no duplicates
  (``single`` form: one INT Column, e.g. the context node);
* attribute set -> ``ARRAY<STRING>`` of values (``single`` form: nullable STRING);
* string / number / boolean -> scalar Columns.

Supported: axes child, descendant, descendant-or-self, self, parent, ancestor,
ancestor-or-self, following-sibling, preceding-sibling, following, preceding, attribute;
abbreviations ``/ // . .. @``; node tests name, ``*``, ``text()``, ``node()``,
``comment()``; predicates (positional or boolean, any number); ``|``; ``or and = != < <=
> >= + - * div mod``; functions last position count local-name name string concat
starts-with contains substring substring-before substring-after string-length
normalize-space translate not true false boolean number sum floor ceiling round.
Anything else raises :class:`UnsupportedXPath`; malformed input raises
:class:`XPathSyntaxError`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import normalize_space, xp_substring_after, xp_substring_before


class XPathSyntaxError(ValueError):
    """The selector is not a valid expression (the reference reports 'Invalid XPath')."""


class UnsupportedXPath(NotImplementedError):
    """Valid XPath outside the compiled subset."""


# --------------------------------------------------------------------------------------
# Parsing
# --------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<str>"[^"]*"|'[^']*')
     |(?P<num>\d+(?:\.\d*)?|\.\d+)
     |(?P<op>//|::|\.\.|!=|<=|>=|[/()\[\]@,|=<>+*.$-])
     |(?P<name>[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)
    )""",
    re.X,
)

AXES = frozenset(
    "child descendant descendant-or-self self parent ancestor ancestor-or-self "
    "following-sibling preceding-sibling following preceding attribute namespace".split()
)
REVERSE_AXES = frozenset("ancestor ancestor-or-self preceding-sibling preceding".split())
NODE_TYPES = frozenset("node text comment processing-instruction".split())
_DOS = ("step", "descendant-or-self", ("node",), ())


def _tokenize(s: str) -> list[tuple[str, str]]:
    out, pos, s = [], 0, s.rstrip()
    while pos < len(s):
        m = _TOKEN.match(s, pos)
        if not m or m.end() == pos:
            raise XPathSyntaxError(f"Invalid XPath: unexpected character at {pos}: {s!r}")
        kind = m.lastgroup
        out.append((kind, m.group(kind)))
        pos = m.end()
    return out


class _Parser:
    def __init__(self, s: str):
        self.toks = _tokenize(s)
        self.i = 0

    def peek(self, k: int = 0):
        j = self.i + k
        return self.toks[j] if j < len(self.toks) else (None, None)

    def at(self, *vals) -> bool:
        kind, v = self.peek()
        return kind in ("op", "name") and v in vals

    def take(self):
        t = self.peek()
        if t[0] is None:
            raise XPathSyntaxError("Invalid XPath: unexpected end")
        self.i += 1
        return t

    def expect(self, v: str) -> None:
        kind, got = self.take()
        if got != v or kind not in ("op", "name"):
            raise XPathSyntaxError(f"Invalid XPath: expected {v!r}, got {got!r}")

    def parse(self):
        if not self.toks:
            raise XPathSyntaxError("Invalid XPath: empty expression")
        e = self.or_expr()
        if self.i != len(self.toks):
            raise XPathSyntaxError(f"Invalid XPath: trailing {self.peek()[1]!r}")
        return e

    def _binary(self, sub, ops, tag):
        a = sub()
        while self.peek()[0] in ("op", "name") and self.peek()[1] in ops:
            op = self.take()[1]
            a = (tag, op, a, sub())
        return a

    def or_expr(self):
        return self._binary(self.and_expr, ("or",), "bool")

    def and_expr(self):
        return self._binary(self.eq_expr, ("and",), "bool")

    def eq_expr(self):
        return self._binary(self.rel_expr, ("=", "!="), "cmp")

    def rel_expr(self):
        return self._binary(self.add_expr, ("<", "<=", ">", ">="), "cmp")

    def add_expr(self):
        return self._binary(self.mul_expr, ("+", "-"), "arith")

    def mul_expr(self):
        return self._binary(self.unary_expr, ("*", "div", "mod"), "arith")

    def unary_expr(self):
        if self.at("-"):
            self.take()
            return ("neg", self.unary_expr())
        return self.union_expr()

    def union_expr(self):
        a = self.path_expr()
        while self.at("|"):
            self.take()
            a = ("union", a, self.path_expr())
        return a

    def _starts_step(self) -> bool:
        kind, v = self.peek()
        return kind == "name" or (kind == "op" and v in (".", "..", "@", "*"))

    def path_expr(self):
        kind, v = self.peek()
        if kind == "op" and v == "/":
            self.take()
            steps = self.relative_path() if self._starts_step() else []
            return ("path", "root", tuple(steps))
        if kind == "op" and v == "//":
            self.take()
            return ("path", "root", tuple([_DOS] + self.relative_path()))
        is_call = kind == "name" and self.peek(1) == ("op", "(") and v not in NODE_TYPES
        if kind in ("str", "num") or (kind == "op" and v in ("(", "$")) or is_call:
            e = self.primary()
            preds = self.predicates()
            if preds:
                e = ("filter", e, tuple(preds))
            if self.at("/", "//"):
                steps = []
                if self.take()[1] == "//":
                    steps.append(_DOS)
                steps += self.relative_path()
                return ("path", e, tuple(steps))
            return e
        if not self._starts_step():
            raise XPathSyntaxError(f"Invalid XPath: unexpected {v!r}")
        return ("path", "ctx", tuple(self.relative_path()))

    def relative_path(self):
        steps = [self.step()]
        while self.at("/", "//"):
            if self.take()[1] == "//":
                steps.append(_DOS)
            steps.append(self.step())
        return steps

    def step(self):
        kind, v = self.peek()
        if kind == "op" and v == ".":
            self.take()
            return ("step", "self", ("node",), ())
        if kind == "op" and v == "..":
            self.take()
            return ("step", "parent", ("node",), ())
        axis = "child"
        if kind == "op" and v == "@":
            self.take()
            axis = "attribute"
        elif kind == "name" and self.peek(1) == ("op", "::"):
            axis = self.take()[1]
            self.take()
            if axis not in AXES:
                raise XPathSyntaxError(f"Invalid XPath: unknown axis {axis!r}")
        test = self.node_test()
        return ("step", axis, test, tuple(self.predicates()))

    def node_test(self):
        kind, v = self.take()
        if kind == "op" and v == "*":
            return ("any",)
        if kind != "name":
            raise XPathSyntaxError(f"Invalid XPath: expected a node test, got {v!r}")
        if v in NODE_TYPES and self.at("("):
            self.take()
            if v == "processing-instruction" and self.peek()[0] == "str":
                self.take()
            self.expect(")")
            return (v,)
        if v.endswith(":*"):
            raise UnsupportedXPath("namespace wildcards are not supported")
        if self.at(":") or (self.peek()[0] == "op" and self.peek()[1] == "*" and v.endswith(":")):
            raise UnsupportedXPath("namespaces are not supported")
        return ("name", v)

    def predicates(self):
        preds = []
        while self.at("["):
            self.take()
            preds.append(self.or_expr())
            self.expect("]")
        return preds

    def primary(self):
        kind, v = self.take()
        if kind == "str":
            return ("str", v[1:-1])
        if kind == "num":
            return ("num", float(v))
        if kind == "op" and v == "(":
            e = self.or_expr()
            self.expect(")")
            return e
        if kind == "op" and v == "$":
            raise UnsupportedXPath("variables are not supported")
        if kind == "name":
            self.expect("(")
            args = []
            if not self.at(")"):
                args.append(self.or_expr())
                while self.at(","):
                    self.take()
                    args.append(self.or_expr())
            self.expect(")")
            return ("call", v, tuple(args))
        raise XPathSyntaxError(f"Invalid XPath: unexpected {v!r}")


def parse(selector: str):
    """Parse a selector into a small tuple AST; raises XPathSyntaxError."""
    if selector is None:
        raise XPathSyntaxError("Invalid XPath: null")
    return _Parser(selector).parse()


# --------------------------------------------------------------------------------------
# Compilation
# --------------------------------------------------------------------------------------

NODES, ATTRS, STR, NUM, BOOL = "nodes", "attrs", "str", "num", "bool"
def _empty_int() -> Column:
    return F.array().cast("array<int>")


def _empty_str() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column
    single: bool = False
    root: bool = False


@dataclass(frozen=True)
class Env:
    nodes: Column
    text: Column
    node: Column  # context node (pre, INT)
    pos: Callable[[], Column] | None = None
    size: Callable[[], Column] | None = None

    def at(self, node, pos=None, size=None) -> "Env":
        return Env(self.nodes, self.text, node, pos, size)


def _n(env: Env, i) -> Column:
    return F.get(env.nodes, i)


def _f(env: Env, i, name: str) -> Column:
    return F.get(env.nodes, i)[name]


def _rng(lo: Column, hi: Column) -> Column:
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(_empty_int())


def strval(env: Env, i) -> Column:
    """XPath string-value of node ``i`` (textContent; '' for comments)."""
    n = _n(env, i)
    return env.text.substr(n["t0"] + 1, n["t1"] - n["t0"]).cast("string")  # bytes of the page's text


def attr_of(env: Env, i, name: str) -> Column:
    return F.try_element_at(_f(env, i, "attrs"), F.lit(name))


def _test(env: Env, i, t) -> Column:
    k = t[0]
    if k == "name":
        return _f(env, i, "tag") == F.lit(t[1].lower())
    if k == "any":
        return _f(env, i, "child") > 0
    if k == "text":
        return _f(env, i, "tag") == F.lit("#text")
    if k == "comment":
        return _f(env, i, "tag") == F.lit("#comment")
    if k == "node":
        return F.lit(True)
    raise UnsupportedXPath(f"node test {k}() is not supported")


def _as_array(v: Val) -> Column:
    if not v.single:
        return v.col
    if v.kind == NODES:
        return F.array(v.col)
    return F.filter(F.array(v.col), lambda x: x.isNotNull())


def _values(env: Env, v: Val) -> Column:
    """String values of a node/attribute set as ARRAY<STRING>."""
    if v.kind == ATTRS:
        return _as_array(v)
    return F.transform(_as_array(v), lambda i: strval(env, i))


def _uses_context_pos(e) -> bool:
    """Does expression ``e`` (a predicate) depend on position() or last() of its context?"""
    if not isinstance(e, tuple):
        return False
    if e[0] == "call" and e[1] in ("position", "last"):
        return True
    if e[0] == "path":
        return e[1] not in ("root", "ctx") and _uses_context_pos(e[1])
    if e[0] == "filter":
        return _uses_context_pos(e[1])
    return any(_uses_context_pos(x) for x in e[1:] if isinstance(x, tuple))


class Compiler:
    def __init__(self, env: Env):
        self.env = env

    # -- conversions ------------------------------------------------------------------
    def to_str(self, v: Val, env: Env | None = None) -> Column:
        env = env or self.env
        if v.kind == STR:
            return v.col
        if v.kind == NODES:
            first = v.col if v.single else F.get(v.col, 0)
            return F.coalesce(strval(env, first), F.lit(""))
        if v.kind == ATTRS:
            first = v.col if v.single else F.get(v.col, 0)
            return F.coalesce(first, F.lit(""))
        if v.kind == NUM:
            return num_to_str(v.col)
        return F.when(v.col, F.lit("true")).otherwise(F.lit("false"))

    def to_num(self, v: Val, env: Env | None = None) -> Column:
        if v.kind == NUM:
            return v.col.cast("double")
        if v.kind == BOOL:
            return F.when(v.col, F.lit(1.0)).otherwise(F.lit(0.0))
        s = self.to_str(v, env)
        return F.coalesce(F.trim(s).try_cast("double"), F.lit(float("nan")))

    def to_bool(self, v: Val) -> Column:
        if v.kind == BOOL:
            return v.col
        if v.kind in (NODES, ATTRS):
            return v.col.isNotNull() if v.single else F.size(v.col) > 0
        if v.kind == STR:
            return F.length(v.col) > 0
        return F.coalesce((v.col != 0) & ~F.isnan(v.col.cast("double")), F.lit(False))

    # -- expressions ------------------------------------------------------------------
    def compile(self, e, env: Env | None = None) -> Val:
        env = env or self.env
        k = e[0]
        if k == "str":
            return Val(STR, F.lit(e[1]))
        if k == "num":
            return Val(NUM, F.lit(e[1]))
        if k == "path":
            return self.path(e, env)
        if k == "filter":
            base = self.compile(e[1], env)
            if base.kind != NODES:
                raise UnsupportedXPath("predicates on a non node-set expression")
            return Val(NODES, self._filter_positions(_as_array(base), e[2], env, reverse=False))
        if k == "union":
            a, b = self.compile(e[1], env), self.compile(e[2], env)
            if a.kind == NODES and b.kind == NODES:
                return Val(NODES, F.array_sort(F.array_distinct(F.concat(_as_array(a), _as_array(b)))))
            if a.kind == ATTRS and b.kind == ATTRS:
                return Val(ATTRS, F.concat(_as_array(a), _as_array(b)))
            raise XPathSyntaxError("Invalid XPath: union of non node-sets")
        if k == "bool":
            a, b = self.to_bool(self.compile(e[2], env)), self.to_bool(self.compile(e[3], env))
            return Val(BOOL, (a & b) if e[1] == "and" else (a | b))
        if k == "cmp":
            return Val(BOOL, self._compare(e[1], self.compile(e[2], env), self.compile(e[3], env), env))
        if k == "arith":
            a, b = self.to_num(self.compile(e[2], env), env), self.to_num(self.compile(e[3], env), env)
            op = e[1]
            if op == "+":
                return Val(NUM, a + b)
            if op == "-":
                return Val(NUM, a - b)
            if op == "*":
                return Val(NUM, a * b)
            if op == "div":
                return Val(NUM, F.try_divide(a, b))
            return Val(NUM, F.when(b != 0, a - b * F.when(a / b >= 0, F.floor(a / b)).otherwise(F.ceil(a / b))))
        if k == "neg":
            return Val(NUM, -self.to_num(self.compile(e[1], env), env))
        if k == "call":
            return self.call(e[1], e[2], env)
        raise XPathSyntaxError(f"Invalid XPath: {k}")

    def _compare(self, op: str, a: Val, b: Val, env: Env) -> Column:
        def cmp(x, y):
            return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

        sets = (NODES, ATTRS)
        if a.kind in sets or b.kind in sets:
            if a.kind not in sets:  # keep the set on the left
                flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
                op = flip.get(op, op)
                a, b = b, a
            av = _values(env, a)
            if b.kind == BOOL:
                res = cmp(self.to_bool(a), b.col)
            elif b.kind in sets:
                bv = _values(env, b)
                if op in ("=", "!="):
                    res = F.exists(av, lambda x: F.exists(bv, lambda y: cmp(x, y)))
                else:
                    res = F.exists(av, lambda x: F.exists(bv, lambda y: cmp(_num(x), _num(y))))
            elif b.kind == NUM or op not in ("=", "!="):
                bn = self.to_num(b, env)
                res = F.exists(av, lambda x: cmp(_num(x), bn))
            else:
                bs = self.to_str(b, env)
                res = F.exists(av, lambda x: cmp(x, bs))
            return F.coalesce(res, F.lit(False))
        if op in ("=", "!=") and (a.kind == BOOL or b.kind == BOOL):
            res = cmp(self.to_bool(a), self.to_bool(b))
        elif op in ("=", "!=") and a.kind == STR and b.kind == STR:
            res = cmp(a.col, b.col)
        else:
            res = cmp(self.to_num(a, env), self.to_num(b, env))
        return F.coalesce(res, F.lit(False))

    # -- location paths ---------------------------------------------------------------
    def path(self, e, env: Env) -> Val:
        start, steps = e[1], e[2]
        if start == "root":
            cur = Val(NODES, F.lit(0), single=True, root=True)
        elif start == "ctx":
            cur = Val(NODES, env.node, single=True)
        else:
            cur = self.compile(start, env)
            if cur.kind != NODES:
                raise XPathSyntaxError("Invalid XPath: path step after a non node-set")
        i = 0
        while i < len(steps):
            st = steps[i]
            nxt = steps[i + 1] if i + 1 < len(steps) else None
            if cur.kind == ATTRS:
                raise UnsupportedXPath("steps after an attribute step")
            if st == _DOS and nxt is not None and nxt[1] in ("child", "attribute"):
                cur = self._descendant_step(cur, nxt, env)
                i += 2
                continue
            cur = self._step(cur, st, env)
            i += 1
        return cur

    def _over(self, cur: Val, fn: Callable[[Column], Column], sort: bool) -> Column:
        """Apply per-context ``fn`` (context pre -> ARRAY<INT>) to a node value."""
        if cur.single:
            return fn(cur.col)
        out = F.flatten(F.transform(cur.col, fn))
        return F.array_sort(F.array_distinct(out)) if sort else out

    def _axis(self, env: Env, c: Column, axis: str, test) -> Column:
        last = _f(env, c, "last")
        if axis == "child":
            return F.filter(_rng(c + 1, last), lambda m: (_f(env, m, "parent") == c) & _test(env, m, test))
        if axis == "descendant":
            return F.filter(_rng(c + 1, last), lambda m: _test(env, m, test))
        if axis == "descendant-or-self":
            return F.filter(_rng(c, last), lambda m: _test(env, m, test))
        if axis == "self":
            return F.filter(F.array(c), lambda m: _test(env, m, test))
        par = _f(env, c, "parent")
        if axis == "parent":
            return F.filter(F.array(par), lambda m: (m >= 0) & _test(env, m, test))
        if axis == "ancestor":
            return F.filter(_rng(F.lit(0), c - 1), lambda m: (_f(env, m, "last") >= c) & _test(env, m, test))
        if axis == "ancestor-or-self":
            return F.filter(_rng(F.lit(0), c), lambda m: (_f(env, m, "last") >= c) & _test(env, m, test))
        if axis == "following-sibling":
            return F.filter(
                _rng(last + 1, _f(env, par, "last")),
                lambda m: (_f(env, m, "parent") == par) & _test(env, m, test),
            )
        if axis == "preceding-sibling":
            return F.filter(_rng(par + 1, c - 1), lambda m: (_f(env, m, "parent") == par) & _test(env, m, test))
        if axis == "following":
            return F.filter(_rng(last + 1, F.size(env.nodes) - 1), lambda m: _test(env, m, test))
        if axis == "preceding":
            return F.filter(_rng(F.lit(0), c - 1), lambda m: (_f(env, m, "last") < c) & _test(env, m, test))
        raise UnsupportedXPath(f"axis {axis} is not supported")

    def _attr_step(self, cur: Val, test, preds, env: Env, self_or_desc: bool) -> Val:
        if preds:
            raise UnsupportedXPath("predicates on attributes")
        if test[0] not in ("name", "any", "node"):
            raise XPathSyntaxError("Invalid XPath: bad attribute test")
        name = test[1].lower() if test[0] == "name" else None

        def one(c):  # ARRAY<STRING> of matching attribute values of node c
            if name is None:
                return F.coalesce(F.map_values(_f(env, c, "attrs")), _empty_str())
            return F.filter(F.array(attr_of(env, c, name)), lambda v: v.isNotNull())

        if self_or_desc:
            def fn(c):
                if name is None:
                    return F.flatten(F.transform(_rng(c, _f(env, c, "last")), one))
                hits = F.filter(_rng(c, _f(env, c, "last")), lambda m: attr_of(env, m, name).isNotNull())
                return F.transform(hits, lambda m: attr_of(env, m, name))

            if cur.single:
                return Val(ATTRS, fn(cur.col))
            # nested contexts may repeat nodes: de-duplicate on nodes before taking values
            hits = self._over(cur, lambda c: _rng(c, _f(env, c, "last")), sort=True)
            if name is None:
                return Val(ATTRS, F.flatten(F.transform(hits, one)))
            hits = F.filter(hits, lambda m: attr_of(env, m, name).isNotNull())
            return Val(ATTRS, F.transform(hits, lambda m: attr_of(env, m, name)))
        if cur.single and name is not None:
            return Val(ATTRS, attr_of(env, cur.col, name), single=True)
        if cur.single:
            return Val(ATTRS, one(cur.col))
        if name is None:
            return Val(ATTRS, F.flatten(F.transform(cur.col, one)))
        return Val(ATTRS, F.filter(F.transform(cur.col, lambda c: attr_of(env, c, name)), lambda v: v.isNotNull()))

    def _step(self, cur: Val, st, env: Env) -> Val:
        _, axis, test, preds = st
        if axis == "attribute":
            return self._attr_step(cur, test, preds, env, self_or_desc=False)
        if axis == "namespace":
            raise UnsupportedXPath("namespace axis")
        if axis == "self" and test == ("node",) and not preds:
            return cur
        reverse = axis in REVERSE_AXES

        def fn(c):
            return self._filter_positions(self._axis(env, c, axis, test), preds, env, reverse)

        return Val(NODES, self._over(cur, fn, sort=True))

    def _filter_positions(self, arr: Column, preds, env: Env, reverse: bool) -> Column:
        """Apply predicates in turn; positions are indexes into the current array."""
        for p in preds:
            if p[0] == "num":
                k = p[1]
                if k != int(k) or k < 1:
                    arr = _empty_int()
                elif reverse:
                    arr = F.filter(arr, _nth_from_end(arr, int(k)))
                else:
                    arr = F.slice(arr, int(k), 1)
            elif _uses_context_pos(p) or self._is_numeric(p, env):
                arr = F.filter(arr, self._positional_filter(arr, p, env, reverse))
            else:
                arr = F.filter(arr, self._plain_filter(p, env))
        return arr

    def _is_numeric(self, p, env: Env) -> bool:
        try:
            return self.compile(p, env.at(F.lit(0), lambda: F.lit(1), lambda: F.lit(1))).kind == NUM
        except UnsupportedXPath:
            return False

    def _positional_filter(self, arr: Column, p, env: Env, reverse: bool):
        def keep(m, i):
            pos = (lambda: F.size(arr) - i) if reverse else (lambda: i + 1)
            v = self.compile(p, env.at(m, pos, lambda: F.size(arr)))
            if v.kind == NUM:
                return F.coalesce(v.col.cast("double") == pos().cast("double"), F.lit(False))
            return F.coalesce(self.to_bool(v), F.lit(False))

        return keep

    def _plain_filter(self, p, env: Env):
        def keep(m):
            v = self.compile(p, env.at(m))
            return F.coalesce(self.to_bool(v), F.lit(False))

        return keep

    def _descendant_step(self, cur: Val, st, env: Env) -> Val:
        """``//step``: descendant-or-self::node()/child::step without per-node fan-out.

        Candidates are the descendants passing the node test; a positional predicate is
        resolved against the candidate's own siblings (its position in ``child::step`` of
        its parent), which is what the XPath expansion means.
        """
        _, axis, test, preds = st
        if axis == "attribute":
            return self._attr_step(cur, test, preds, env, self_or_desc=True)
        if cur.single:
            c = cur.col
            if cur.root:
                cand = F.filter(_rng(F.lit(1), F.size(env.nodes) - 1), lambda m: _test(env, m, test))
            else:
                cand = F.filter(_rng(c + 1, _f(env, c, "last")), lambda m: _test(env, m, test))
        else:
            cand = self._over(
                cur, lambda c: F.filter(_rng(c + 1, _f(env, c, "last")), lambda m: _test(env, m, test)), sort=True
            )
        for k in range(len(preds)):
            cand = F.filter(cand, self._sibling_filter(test, preds, k, env))
        return Val(NODES, cand)

    def _sibling_filter(self, test, preds, k: int, env: Env):
        def keep(m):
            return self._sibling_pred(m, test, preds, k, env)

        return keep

    def _sibling_ok(self, j: Column, par: Column, test, preds, k: int, env: Env) -> Column:
        ok = (_f(env, j, "parent") == par) & _test(env, j, test)
        for q in range(k):
            ok = ok & self._sibling_pred(j, test, preds, q, env)
        return ok

    def _sibling_pred(self, m: Column, test, preds, k: int, env: Env) -> Column:
        p = preds[k]
        par = _f(env, m, "parent")
        if k == 0 and test[0] in ("name", "text", "comment"):
            pos = lambda: _f(env, m, "sib")
            size = lambda: _f(env, m, "sib_n")
        elif k == 0 and test[0] == "any":
            pos = lambda: _f(env, m, "child")
            size = lambda: F.size(
                F.filter(_rng(par + 1, _f(env, par, "last")), lambda j: (_f(env, j, "parent") == par) & (_f(env, j, "child") > 0))
            )
        else:
            pos = lambda: F.size(F.filter(_rng(par + 1, m - 1), lambda j: self._sibling_ok(j, par, test, preds, k, env))) + 1
            size = lambda: F.size(
                F.filter(_rng(par + 1, _f(env, par, "last")), lambda j: self._sibling_ok(j, par, test, preds, k, env))
            )
        if p[0] == "num":
            return pos() == F.lit(p[1])
        v = self.compile(p, env.at(m, pos, size))
        if v.kind == NUM:
            return F.coalesce(v.col.cast("double") == pos().cast("double"), F.lit(False))
        return F.coalesce(self.to_bool(v), F.lit(False))

    # -- functions --------------------------------------------------------------------
    def call(self, name: str, args, env: Env) -> Val:
        n = len(args)

        def arity(lo, hi=None):
            hi = lo if hi is None else hi
            if not lo <= n <= hi:
                raise XPathSyntaxError(f"Invalid XPath: {name}() takes {lo}..{hi} arguments")

        a = [self.compile(x, env) for x in args]
        S = lambda i: self.to_str(a[i], env)
        if name == "position":
            arity(0)
            if env.pos is None:
                raise UnsupportedXPath("position() outside a predicate")
            return Val(NUM, env.pos())
        if name == "last":
            arity(0)
            if env.size is None:
                raise UnsupportedXPath("last() outside a predicate")
            return Val(NUM, env.size())
        if name == "count":
            arity(1)
            if a[0].kind not in (NODES, ATTRS):
                raise XPathSyntaxError("Invalid XPath: count() needs a node-set")
            return Val(NUM, F.size(_as_array(a[0])))
        if name in ("local-name", "name"):
            arity(0, 1)
            if n == 0:
                node = env.node
            elif a[0].kind == NODES:
                node = a[0].col if a[0].single else F.get(a[0].col, 0)
            else:
                raise UnsupportedXPath(f"{name}() of attributes")
            tag = _f(env, node, "tag")
            return Val(STR, F.coalesce(F.when(tag.startswith("#"), F.lit("")).otherwise(tag), F.lit("")))
        if name == "string":
            arity(0, 1)
            return Val(STR, F.coalesce(strval(env, env.node), F.lit("")) if n == 0 else S(0))
        if name == "concat":
            if n < 2:
                raise XPathSyntaxError("Invalid XPath: concat() takes 2+ arguments")
            return Val(STR, F.concat(*[S(i) for i in range(n)]))
        if name == "starts-with":
            arity(2)
            return Val(BOOL, F.startswith(S(0), S(1)))
        if name == "contains":
            arity(2)
            return Val(BOOL, F.contains(S(0), S(1)))
        if name == "substring-before":
            arity(2)
            return Val(STR, xp_substring_before(S(0), S(1)))
        if name == "substring-after":
            arity(2)
            return Val(STR, xp_substring_after(S(0), S(1)))
        if name == "substring":
            arity(2, 3)
            return Val(STR, self._substring(S(0), args, a, env))
        if name == "string-length":
            arity(0, 1)
            s = F.coalesce(strval(env, env.node), F.lit("")) if n == 0 else S(0)
            return Val(NUM, F.length(s))
        if name == "normalize-space":
            arity(0, 1)
            s = F.coalesce(strval(env, env.node), F.lit("")) if n == 0 else S(0)
            return Val(STR, normalize_space(s))
        if name == "translate":
            arity(3)
            if args[1][0] != "str" or args[2][0] != "str":
                raise UnsupportedXPath("translate() with non-literal character lists")
            return Val(STR, F.translate(S(0), _dedupe(args[1][1]), _dedupe_map(args[1][1], args[2][1])))
        if name == "not":
            arity(1)
            return Val(BOOL, ~self.to_bool(a[0]))
        if name == "boolean":
            arity(1)
            return Val(BOOL, self.to_bool(a[0]))
        if name in ("true", "false"):
            arity(0)
            return Val(BOOL, F.lit(name == "true"))
        if name == "number":
            arity(0, 1)
            if n == 0:
                return Val(NUM, self.to_num(Val(STR, F.coalesce(strval(env, env.node), F.lit(""))), env))
            return Val(NUM, self.to_num(a[0], env))
        if name == "sum":
            arity(1)
            vals = _values(env, a[0])
            return Val(NUM, F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + _num(x)))
        if name in ("floor", "ceiling", "round"):
            arity(1)
            x = self.to_num(a[0], env)
            f = {"floor": F.floor, "ceiling": F.ceil, "round": lambda y: F.floor(y + 0.5)}[name]
            return Val(NUM, f(x).cast("double"))
        if name in ("id", "lang", "namespace-uri"):
            raise UnsupportedXPath(f"{name}() is not supported")
        raise XPathSyntaxError(f"Invalid XPath: unknown function {name}()")

    def _substring(self, s: Column, args, a, env: Env) -> Column:
        # XPath: characters at positions p with round(start) <= p < round(start)+round(len)
        if all(x[0] == "num" for x in args[1:]):
            st = _xround(args[1][1])
            if st != st:
                return F.lit("")
            lo = int(max(st, 1))
            if len(args) == 2:
                return s.substr(F.lit(lo), F.lit(2**31 - 1))
            en = st + _xround(args[2][1])
            if en != en:
                return F.lit("")
            ln = int(min(max(en - lo, 0), 2**31 - 1))
            return s.substr(F.lit(lo), F.lit(ln))
        st = F.floor(self.to_num(a[1], env) + 0.5)
        lo = F.greatest(st, F.lit(1.0))
        if len(args) == 2:
            out = F.when(F.isnan(st), F.lit("")).otherwise(s.substr(lo.cast("int"), F.lit(2**31 - 1)))
            return out
        en = st + F.floor(self.to_num(a[2], env) + 0.5)
        ln = F.least(F.greatest(en - lo, F.lit(0.0)), F.lit(2.0**31 - 1))
        return F.when(F.isnan(st) | F.isnan(en), F.lit("")).otherwise(s.substr(lo.cast("int"), ln.cast("int")))


def _nth_from_end(arr: Column, k: int):
    def keep(m, i):
        return F.size(arr) - i == k

    return keep


def _xround(x: float) -> float:
    import math

    if x != x or math.isinf(x):
        return x
    return float(math.floor(x + 0.5))


def _num(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(float("nan")))


def num_to_str(x: Column) -> Column:
    """XPath number -> string: integers without a fraction, NaN as 'NaN'."""
    d = x.cast("double")
    return (
        F.when(d.isNull() | F.isnan(d), F.lit("NaN"))
        .when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string"))
        .otherwise(d.cast("string"))
    )


def _dedupe(src: str) -> str:
    seen, out = set(), []
    for ch in src:
        if ch not in seen:
            seen.add(ch)
            out.append(ch)
    return "".join(out)


def _dedupe_map(src: str, dst: str) -> str:
    # first occurrence of a source character decides its replacement (XPath rule)
    seen, out = set(), []
    for idx, ch in enumerate(src):
        if ch not in seen:
            seen.add(ch)
            if idx < len(dst):
                out.append(dst[idx])
            else:
                break
    return "".join(out)


def compile_nodes(selector: str, env: Env) -> Column:
    """Node-set selector -> ARRAY<INT> of matching pre numbers (document order)."""
    v = Compiler(env).compile(parse(selector))
    if v.kind != NODES:
        raise XPathSyntaxError("Invalid XPath: the expression does not select nodes")
    return _as_array(v)


def compile_set(selector: str, env: Env) -> tuple[Column, bool]:
    """Node or attribute set -> its array (pre numbers or values), and whether it holds nodes."""
    v = Compiler(env).compile(parse(selector))
    if v.kind not in (NODES, ATTRS):
        raise XPathSyntaxError("Invalid XPath: the expression does not select nodes")
    return _as_array(v), v.kind == NODES


def compile_value(selector: str, env: Env) -> tuple[Val, Compiler]:
    c = Compiler(env)
    return c.compile(parse(selector)), c
