"""Templates as columns.

A template is text with ``{{ expression }}``, ``{% if %}``, ``{% for %}`` and ``{% set %}``. It is parsed once on the
driver into a small tree and translated into a column over the record's columns; nothing is interpreted per row.

Forms: text alone is a literal; a single ``{{ }}`` (also behind guards) keeps its value's type; text around plain
references is a composite, null as soon as one of them is null or empty; anything else renders to text, in which an
absent value fails the template (null).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, geo, math, temporal, text, units


class TemplateError(ValueError):
    """A template that can't be compiled, with a hint."""


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>"[^"]*"|'[^']*'|`[^`]*`)|(?P<name>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|[-+*/%~|.,:()\[\]{}<>=]))""")
_PART = re.compile(r"\{\{-?(?P<expr>.*?)-?\}\}|\{%-?\s*(?P<stmt>.*?)\s*-?%\}|\{#.*?#\}", re.S)
_WORDS = {"and", "or", "not", "is", "in", "true", "false", "none", "null"}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unreadable at {source[at : at + 12]!r} in {source!r}")
        kind = m.lastgroup
        value = m[kind]
        out.append(("word" if kind == "name" and value.lower() in _WORDS else kind, value[1:-1] if kind == "str" else value))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """Precedence climbing: or, and, not, comparisons and tests, filters, ~, + -, * / %, unary, member access."""

    BINARY = ({"~"}, {"+", "-"}, {"*", "/", "%"})

    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, _lex(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("op", "word") and self.peek()[1].lower() in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r} before {self.peek()[1]!r} in {self.source!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind not in ("name", "word"):
            raise TemplateError(f"expected a name before {value!r} in {self.source!r}")
        self.at += 1
        return value

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return out

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.filtered()
        while True:
            for op in ("==", "!=", "<=", ">=", "<", ">"):
                if self.take(op):
                    left = ("compare", op, left, self.filtered())
                    break
            else:
                if self.take("in"):
                    left = ("in", left, self.filtered())
                elif self.take("is"):
                    flip = self.take("not")
                    name = self.name()
                    test = ("test", name, left, self.arguments() if self.take("(") else ([], {}))
                    left = ("not", test) if flip else test
                else:
                    return left

    def filtered(self):
        left = self.arithmetic(0)
        while self.take("|"):
            name = self.name()
            left = ("filter", name, left, self.arguments() if self.take("(") else ([], {}))
        return left

    def arithmetic(self, level: int):
        if level == len(self.BINARY):
            return self.unary()
        left = self.arithmetic(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in self.BINARY[level]:
            op = self.peek()[1]
            self.at += 1
            left = ("math", op, left, self.arithmetic(level + 1))
        return left

    def unary(self):
        return ("minus", self.unary()) if self.take("-") else self.member()

    def member(self):
        out = self.atom()
        while True:
            if self.take("."):
                kind, value = self.peek()
                self.at += 1
                out = ("item", out, ("literal", int(value))) if kind == "num" else ("item", out, ("literal", value))
            elif self.take("["):
                key = self.either()
                self.need("]")
                out = ("item", out, key)
            else:
                return out

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return ("literal", float(value) if "." in value else int(value))
        if kind == "str":
            return ("literal", value)
        if kind == "word" and value.lower() in ("true", "false"):
            return ("literal", value.lower() == "true")
        if kind == "word" and value.lower() in ("none", "null"):
            return ("literal", None)
        if kind == "name":
            return ("call", value, self.arguments()) if self.take("(") else ("name", value)
        if value == "(":
            out = self.either()
            self.need(")")
            return out
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.either())
                self.take(",")
            return ("array", items)
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")

    def arguments(self) -> tuple[list, dict]:
        given, named = [], {}
        while not self.take(")"):
            if self.peek()[0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                key = self.name()
                self.at += 1
                named[key] = self.either()
            else:
                given.append(self.either())
            if not self.take(","):
                self.need(")")
                break
        return given, named


def parse(source: str) -> list:
    """The parts of a template: ('text', t), ('out', tree), ('if', [(condition or None, parts)...]),
    ('for', name, tree, parts), ('set', name, tree)."""
    stack: list[tuple[str, list, list]] = [("top", [], [])]
    at = 0
    raw = False
    for m in _PART.finditer(source):
        if raw and not (m["stmt"] or "").strip() == "endraw":
            continue
        before = source[at : m.start()]
        if m[0].startswith(("{{-", "{%-")):
            before = before.rstrip()
        if before:
            stack[-1][1].append(("text", before))
        at = m.end()
        if m[0].endswith(("-}}", "-%}")):
            while at < len(source) and source[at].isspace():
                at += 1
        if m["expr"] is not None:
            stack[-1][1].append(("out", Parser(m["expr"]).parse()))
        elif m["stmt"] is not None:
            word, _, rest = m["stmt"].partition(" ")
            if word == "if":
                stack.append(("if", [], [[Parser(rest).parse(), None]]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                _, body, arms = stack[-1]
                arms[-1][1] = body[:]
                body.clear()
                arms.append([Parser(rest).parse() if word == "elif" else None, None])
            elif word == "for":
                name, _, over = rest.partition(" in ")
                stack.append(("for", [], [name.strip(), Parser(over).parse()]))
            elif word == "set":
                name, _, value = rest.partition("=")
                stack[-1][1].append(("set", name.strip(), Parser(value).parse()))
            elif word == "raw":
                raw = True
            elif word == "endraw":
                raw = False
            elif word in ("endif", "endfor") and stack[-1][0] == word[3:]:
                kind, body, arms = stack.pop()
                if kind == "if":
                    arms[-1][1] = body
                    stack[-1][1].append(("if", [tuple(a) for a in arms]))
                else:
                    stack[-1][1].append(("for", arms[0], arms[1], body))
            else:
                raise TemplateError(f"unexpected {{% {m['stmt']} %}} in {source!r}")
    if len(stack) > 1:
        raise TemplateError(f"unclosed {{% {stack[-1][0]} %}} in {source!r}")
    if source[at:]:
        stack[0][1].append(("text", source[at:]))
    if "{{" in source[at:] or "{%" in source[at:]:
        raise TemplateError(f"unclosed block in {source!r}")
    return stack[0][1]


def reads(source: str) -> set[str]:
    """Top-level columns that a template reads, for pruning; {'*'} for the whole record."""
    out: set[str] = set()

    def tree(x):
        if isinstance(x, tuple):
            if x[:1] == ("item",) and x[1] == ("name", "this") and x[2][0] == "literal":
                out.add(str(x[2][1]))
                return
            if x[:1] == ("name",):
                out.add("*" if x[1] in ("context", "this") else x[1])
            for y in x:
                tree(y)
        elif isinstance(x, list):
            for y in x:
                tree(y)
        elif isinstance(x, dict):
            for y in x.values():
                tree(y)

    tree(parse(source))
    return out - {"vars"}


@dataclass
class Value:
    """A column with what is known of it at compile time."""

    column: Column
    literal: object = None


@dataclass
class Compiler:
    """Translates templates over the columns of one DataFrame."""

    df: DataFrame
    vars: dict[str, object] = field(default_factory=dict)

    def kind(self, column: Column) -> T.DataType:
        return self.df.limit(0).select(column.alias("x")).schema["x"].dataType

    # expressions
    def value(self, tree, env: dict[str, Column]) -> Column:
        op = tree[0]
        if op == "literal":
            return F.lit(tree[1])
        if op == "array":
            return F.array(*[self.value(x, env) for x in tree[1]])
        if op == "name":
            return self._name(tree[1], env)
        if op == "item":
            return self._item(tree, env)
        if op == "minus":
            return -self.value(tree[1], env)
        if op == "math":
            return self._math(tree[1], self.value(tree[2], env), self.value(tree[3], env))
        if op in ("and", "or"):
            a, b = self.truth(tree[1], env), self.truth(tree[2], env)
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.truth(tree[1], env)
        if op == "compare":
            a, b = self.value(tree[2], env), self.value(tree[3], env)
            if tree[1] == "==":
                return a.eqNullSafe(b)
            if tree[1] == "!=":
                return ~a.eqNullSafe(b)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree[1]]
        if op == "in":
            a, b = self.value(tree[1], env), self.value(tree[2], env)
            found = F.array_contains(b, a) if isinstance(self.kind(b), T.ArrayType) else b.contains(a)
            return F.coalesce(found, F.lit(False))
        if op == "test":
            return self._test(tree[1], tree[2], tree[3], env)
        if op == "filter":
            return self._call(FILTERS, "filter", tree[1], tree[3], env, self.value(tree[2], env))
        if op == "call":
            return self._call(CALLS, "function", tree[1], tree[2], env)
        raise TemplateError(f"unknown {op}")

    def truth(self, tree, env) -> Column:
        """Absent, false, zero and empty are false."""
        x = self.value(tree, env)
        kind = self.kind(x)
        if isinstance(kind, T.BooleanType):
            yes = x
        elif isinstance(kind, T.StringType):
            yes = x != ""
        elif isinstance(kind, T.ArrayType):
            yes = F.size(x) > 0
        elif isinstance(kind, T.NumericType):
            yes = x != 0
        else:
            yes = x.isNotNull()
        return F.coalesce(yes, F.lit(False))

    def _name(self, name: str, env) -> Column:
        if name in env:
            return env[name]
        if name in ("context", "this"):
            return F.struct(*[F.col(f"`{c}`") for c in self.df.columns])
        if name == "vars":
            return F.struct(*[F.lit(v).alias(k) for k, v in self.vars.items()])
        if name in self.df.columns:
            return F.col(f"`{name}`")
        return F.lit(None)

    def _item(self, tree, env) -> Column:
        base, key = tree[1], tree[2]
        if base[0] == "name" and base[1] in ("this", "context") and key[0] == "literal":
            return F.col(f"`{key[1]}`") if str(key[1]) in self.df.columns else F.lit(None)
        if base[0] == "name" and base[1] == "vars" and key[0] == "literal":
            return F.lit(self.vars.get(key[1]))
        whole = self.value(base, env)
        kind = self.kind(whole)
        if isinstance(kind, T.StructType):
            return whole.getField(key[1]) if key[0] == "literal" and key[1] in kind.names else F.lit(None)
        if isinstance(kind, T.VariantType):
            path = f"$[{key[1]}]" if isinstance(key[1], int) else f"$['{key[1]}']"
            return F.try_variant_get(whole, path, "variant")
        if isinstance(kind, T.ArrayType):
            return F.get(whole, self.value(key, env))
        if isinstance(kind, T.MapType):
            return F.try_element_at(whole, self.value(key, env))
        return F.lit(None)

    def _math(self, op: str, a: Column, b: Column) -> Column:
        if op == "~":
            return F.concat(*[F.coalesce(self.as_text(x), F.lit("")) for x in (a, b)])
        if op == "/":
            return math.divide(a, b)
        if op == "%":
            return F.try_mod(a, b)
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)

    def as_text(self, x: Column) -> Column:
        kind = self.kind(x)
        if isinstance(kind, T.StringType):
            return x
        if isinstance(kind, T.FloatType | T.DoubleType):
            return casts.number_text(x)
        if isinstance(kind, T.TimestampType):
            return temporal.datetime_text(x)
        if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
            return F.to_json(x)
        return x.cast("string")

    def _arguments(self, arguments, env) -> tuple[list, dict]:
        def one(tree):
            return tree[1] if tree[0] == "literal" else ("minus" == tree[0] and tree[1][0] == "literal" and -tree[1][1]) or self.value(tree, env)

        return [one(x) for x in arguments[0]], {k: one(x) for k, x in arguments[1].items()}

    def _call(self, among, what, name, arguments, env, *first) -> Column:
        if name not in among:
            near = get_close_matches(name, among, 1)
            raise TemplateError(f"unknown {what} {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        given, named = self._arguments(arguments, env)
        return among[name](self, *first, *given, **named)

    def _test(self, name, tree, arguments, env) -> Column:
        if name not in TESTS:
            near = get_close_matches(name, TESTS, 1)
            raise TemplateError(f"unknown test {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        x = self.value(tree, env)
        given, named = self._arguments(arguments, env)
        return F.coalesce(TESTS[name](self, x, *given, **named), F.lit(False))

    # templates
    def compile(self, source: str) -> Column:
        return self._typed(parse(source), {})

    def _typed(self, parts: list, env: dict[str, Column]) -> Column:
        env = dict(env)
        solid = []
        for p in parts:
            if p[0] == "set":
                env[p[1]] = self.value(p[2], env)
            elif p[0] != "text" or p[1].strip() or len(parts) == 1:
                solid.append(p)
        if len(solid) == 1 and solid[0][0] == "out" and not any(p[0] == "text" and p[1] for p in parts):
            return self.value(solid[0][1], env)
        if len(solid) == 1 and solid[0][0] == "if" and all(p[0] != "text" or not p[1].strip() for p in parts):
            out = None
            for condition, body in solid[0][1]:
                if condition is None:
                    return out.otherwise(self._typed(body, env))
                met, then = self.truth(condition, env), self._typed(body, env)
                out = F.when(met, then) if out is None else out.when(met, then)
            return out
        pieces = [p for p in parts if p[0] != "set"]
        if all(p[0] in ("text", "out") for p in pieces):
            plain = all(p[0] == "text" or _is_path(p[1]) for p in pieces)
            texts = []
            for p in pieces:
                if p[0] == "text":
                    texts.append(F.lit(p[1]))
                else:
                    t = self.as_text(self.value(p[1], env))
                    texts.append(F.when(t != "", t) if plain else t)
            return F.concat(*texts) if texts else F.lit("")
        return self._rendered(pieces, env)

    def _rendered(self, parts: list, env: dict[str, Column]) -> Column:
        texts, env = [], dict(env)
        for p in parts:
            if p[0] == "text":
                texts.append(F.lit(p[1]))
            elif p[0] == "set":
                env[p[1]] = self.value(p[2], env)
            elif p[0] == "out":
                texts.append(self.as_text(self.value(p[1], env)))
            elif p[0] == "if":
                out, last = None, F.lit("")
                for condition, body in p[1]:
                    then = self._rendered(body, env)
                    if condition is None:
                        last = then
                    else:
                        met = self.truth(condition, env)
                        out = F.when(met, then) if out is None else out.when(met, then)
                texts.append(out.otherwise(last))
            else:
                texts.append(self._loop(p, env))
        return F.concat(*texts) if texts else F.lit("")

    def _loop(self, p, env) -> Column:
        over = self.value(p[2], env)
        item = self.kind(over).elementType

        def body(x: Column) -> Column:
            # Types of what the loop variable gives rise to are found on a column of the item's type.
            inner = Compiler(self.df.limit(0).withColumn(p[1], F.lit(None).cast(item)), self.vars)
            return _Loop(inner, p[1], x)._rendered(p[3], env)

        return F.array_join(F.transform(over, body), "")


class _Loop(Compiler):
    """A compiler in which one name stands for a lambda variable."""

    def __init__(self, outer: Compiler, name: str, item: Column):
        super().__init__(outer.df, outer.vars)
        self.variable, self.item = name, item
        self.typed = outer

    def _name(self, name, env):
        return self.item if name == self.variable else super()._name(name, env)

    def kind(self, column):
        item, shown = str(self.item._jc.toString()), str(column._jc.toString())
        if shown == item:
            return self.typed.df.schema[self.variable].dataType
        # What is made of a lambda variable can't be analysed by itself; filters of a loop's text give text.
        return T.StringType() if item in shown else super().kind(column)


def _is_path(tree) -> bool:
    return tree[0] == "name" or tree[0] == "item" and tree[2][0] == "literal" and _is_path(tree[1])


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _is_array(c: Compiler, x: Column) -> bool:
    return isinstance(c.kind(x), T.ArrayType)


def _plain(fn: Callable) -> Callable:
    return lambda c, x, *a, **k: fn(x, *a, **k)


def _texts(fn: Callable) -> Callable:
    return lambda c, x, *a, **k: fn(c.as_text(x), *a, **k)


def _sized(c: Compiler, x: Column) -> Column:
    return text.length(x, _is_array(c, x))


def _instant(c: Compiler, x) -> Column:
    x = _col(x)
    kind = c.kind(x)
    if isinstance(kind, T.TimestampType | T.DateType):
        return x.cast("timestamp")
    return temporal.epoch(x) if isinstance(kind, T.NumericType) else temporal.datetime(x)


def _map_parts(c: Compiler, x: Column, what: str) -> Column:
    kind = c.kind(x)
    if isinstance(kind, T.StructType):
        x = F.map_from_arrays(F.array(*[F.lit(n) for n in kind.names]), F.array(*[c.as_text(x.getField(n)) for n in kind.names]))
    return {"keys": F.map_keys, "values": F.map_values, "pairs": F.map_entries}[what](x)


def _grouped(c: Compiler, x: Column, attribute: str) -> Column:
    """Items of an array of objects by the text of one of their members."""
    keys = F.array_distinct(F.transform(x, lambda i: i.getField(attribute).cast("string")))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(x, lambda i: i.getField(attribute).cast("string") == k)))


def _get(c: Compiler, x: Column, key, default=None) -> Column:
    kind = c.kind(x)
    if isinstance(kind, T.StructType):
        found = x.getField(key) if key in kind.names else F.lit(None)
    elif isinstance(kind, T.StringType):
        found = text.get(x, key)
    elif isinstance(kind, T.VariantType):
        found = F.try_variant_get(x, f"$['{key}']", "string")
    else:
        found = F.try_element_at(x, F.lit(key))
    return found if default is None else F.coalesce(found, _col(default))


FILTERS: dict[str, Callable] = {
    **{n: _texts(getattr(text, n)) for n in ("upper", "lower", "capitalize", "title", "trim", "trim_start", "trim_end", "truncate", "wordcount", "escape", "newlines_to_br", "indent", "clean", "json_decode", "b64_encode", "b64_decode", "striptags", "spaceless", "slug")},
    "escape_html": _texts(text.escape), "escape_xml": _texts(text.escape), "safe": _plain(lambda x: x),
    "replace": _texts(lambda x, old=None, new=None, **k: text.replace(x, k.get("from", old), k.get("to", new))),
    "regex_replace": _texts(lambda x, pattern, rep: text.regex_replace(x, pattern, rep)),
    "urlencode": _texts(lambda x: text.urlencode(x, False)), "urlencode_strict": _texts(text.urlencode),
    "pluralize": _plain(text.pluralize), "filesize_format": _plain(text.filesize_format), "json_encode": lambda c, x: F.to_json(x),
    "split": _texts(lambda x, pat: text.split(x, pat)), "join": _plain(lambda x, sep="": text.join(x, sep)),
    "default": lambda c, x, value, boolean=False: text.default(x, _col(value), boolean),
    "length": _sized, "reverse": _plain(text.reverse), "first": _plain(text.first), "last": _plain(text.last), "nth": _plain(lambda x, n: text.nth(x, n)),
    "sort": _plain(text.sort), "unique": _plain(text.unique), "keys": lambda c, x: _map_parts(c, x, "keys"), "values": lambda c, x: _map_parts(c, x, "values"), "pairs": lambda c, x: _map_parts(c, x, "pairs"),
    "group_by": _grouped, "get": _get, "shuffle": _plain(F.shuffle),
    "str": lambda c, x: c.as_text(x), "int": lambda c, x: casts.integer(c.as_text(x)), "float": lambda c, x: casts.float_(c.as_text(x)),
    "cefact_unit": _texts(units.code), "date": lambda c, x, format="%Y-%m-%d": temporal.date_format(_instant(c, x), format),
    "date_subtract_seconds": lambda c, x, seconds, format=None: temporal.subtract_seconds(_instant(c, x), seconds, format),
    "format": lambda c, x, spec: F.format_string("%" + spec, x),
    **{n: _plain(getattr(math, n)) for n in ("sqrt", "cbrt", "sign", "exp", "ln", "log10", "log2", "floor", "ceil", "trunc", "sin", "cos", "tan", "asin", "acos", "atan", "radians", "degrees")},
    "abs": _plain(F.abs), "round": _plain(lambda x, precision=0: math.round_(x, precision)),
}


def _number(fn: Callable) -> Callable:
    return lambda c, *a, **k: fn(*[_col(x) for x in a], **{n: x if n == "convention" else _col(x) for n, x in k.items()})


CALLS: dict[str, Callable] = {
    "hypot": _number(lambda x, y: math.hypot(x, y)), "clamp": _number(lambda value, min, max: math.clamp(value, min, max)),
    "map_range": _number(lambda value, from_min, from_max, to_min, to_max: math.map_range(value, from_min, from_max, to_min, to_max)),
    "atan2": _number(lambda y, x: math.atan2(y, x)), "pi": lambda c: F.pi(), "tau": lambda c: F.lit(math.TAU), "e": lambda c: F.e(),
    "bearing": _number(lambda east, north, convention="to": math.bearing(east, north, convention)),
    "wind_speed": _number(lambda u, v: math.wind_speed(u, v)), "wind_direction": _number(lambda u, v: math.wind_direction(u, v)),
    "now": lambda c: F.current_timestamp(), "get_random": lambda c, start=0, end=1: F.floor(F.rand() * (end - start) + start),
    "range": lambda c, end, start=0, step_by=1: text.range_(_col(end), start, step_by), "throw": lambda c, message="": F.raise_error(F.lit(message)),
    "geohash": lambda c, lat, lon, precision=9: geo.geohash(_col(lat), _col(lon), precision), "dms_point": lambda c, value: geo.dms_point(_col(value)),
    "geo_convert": lambda c, value, to, using=None: geo.convert(_col(value), to, using), "geo_centroid": lambda c, value: geo.apply("centroid", _col(value)),
    "geo_bbox": lambda c, value: geo.bbox(_col(value)), "geo_area": lambda c, value: geo.area(_col(value)), "geo_length": lambda c, value: geo.length(_col(value)),
}


def _typed(*kinds) -> Callable:
    return lambda c, x: x.isNotNull() if isinstance(c.kind(x), kinds) else F.lit(False)


TESTS: dict[str, Callable] = {
    "string": _typed(T.StringType), "number": _typed(T.NumericType), "bool": _typed(T.BooleanType), "array": _typed(T.ArrayType), "map": _typed(T.StructType, T.MapType),
    "integer": _typed(T.IntegralType), "float": _typed(T.FractionalType), "iterable": _typed(T.ArrayType, T.MapType, T.StructType),
    "none": lambda c, x: x.isNull(), "defined": lambda c, x: x.isNotNull(), "undefined": lambda c, x: x.isNull(),
    "odd": lambda c, x: F.try_mod(x, F.lit(2)) != 0, "even": lambda c, x: F.try_mod(x, F.lit(2)) == 0, "divisible_by": lambda c, x, n: F.try_mod(x, _col(n)) == 0,
    "starting_with": lambda c, x, t: x.startswith(t), "ending_with": lambda c, x, t: x.endswith(t),
    "containing": lambda c, x, t: F.array_contains(x, t) if _is_array(c, x) else x.contains(t),
    "matching": lambda c, x, pattern: x.rlike(pattern), "after": lambda c, x, t: _instant(c, x) > _instant(c, t), "before": lambda c, x, t: _instant(c, x) < _instant(c, t),
}
