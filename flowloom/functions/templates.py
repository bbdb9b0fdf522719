"""Templates with control flow, compiled to column expressions.

`{{ expression }}`, `{% if %} / {% elif %} / {% else %} / {% endif %}`, `{% for x in list %} /
{% else %} / {% endfor %}` (with loop.index, loop.index0, loop.first, loop.last), `{# comment #}`,
and blanks trimmed by `-`. Expressions: names, fields and items (a.b, a[0], a["k"]), literals,
comparisons, in, and, or, not, +, -, *, /, ~, parentheses, and filters (length is a text's,
count an array's). A loop is a
`transform` over the array and a condition a CASE, so a template is one native expression.
Names that aren't given raise; null values are written as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PromptError

Scope = Mapping[str, Column]

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(\d+\.\d+|\d+)|("[^"]*"|'[^']*')|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/~()\[\].,|<>]))""")

FILTERS: dict[str, Callable[..., Column]] = {
    "upper": F.upper, "lower": F.lower, "trim": F.trim, "title": F.initcap, "capitalize": lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substr(v, F.lit(2)))),
    "length": F.char_length, "count": F.size,
    "default": lambda v, d: F.coalesce(v, d.cast("string")), "join": lambda v, sep=None: F.array_join(v.cast("array<string>"), "") if sep is None else _joined(v, sep),
    "replace": lambda v, a, b: F.replace(v, a, b), "first": lambda v: F.get(v, F.lit(0)), "last": lambda v: F.element_at(v, -1), "int": lambda v: v.try_cast("long"),
    "float": lambda v: v.try_cast("double"), "string": lambda v: v.cast("string"), "round": lambda v: F.round(v), "abs": F.abs, "sort": F.sort_array, "reverse": F.reverse,
}


def _joined(v: Column, sep: Column) -> Column:
    texts = v.cast("array<string>")
    return F.coalesce(F.reduce(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), F.get(texts, F.lit(0)), lambda a, x: F.concat(a, sep, x)), F.lit(""))


class _Parser:
    """Expressions by precedence climbing; gives a function from scope to column."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise PromptError("prompt_render_error", f"can't read {text[at:]!r}")
            self.tokens.append(next((k, t) for k, t in zip(("number", "string", "name", "sign"), m.groups(), strict=True) if t is not None))
            at = m.end()
        self.k = 0

    def peek(self) -> str | None:
        return self.tokens[self.k][1] if self.k < len(self.tokens) and self.tokens[self.k][0] != "string" else None

    def take(self, *want: str) -> str | None:
        if self.peek() in want:
            self.k += 1
            return self.tokens[self.k - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise PromptError("prompt_render_error", f"{sign} is missing in {self.text!r}")

    def whole(self):
        e = self.either()
        if self.k < len(self.tokens):
            raise PromptError("prompt_render_error", f"can't read {self.text!r}")
        return e

    def either(self):
        left = self.both()
        while self.take("or"):
            left = (lambda a, b: lambda s: truth(a(s)) | truth(b(s)))(left, self.both())
        return left

    def both(self):
        left = self.inverse()
        while self.take("and"):
            left = (lambda a, b: lambda s: truth(a(s)) & truth(b(s)))(left, self.inverse())
        return left

    def inverse(self):
        if self.take("not"):
            inner = self.inverse()
            return lambda s: ~truth(inner(s))
        return self.compared()

    def compared(self):
        left = self.sum()
        ops = {"==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        if (op := self.take(*ops)) is not None:
            right = self.sum()
            return lambda s: F.coalesce(ops[op](left(s), right(s)), F.lit(False))
        if self.take("in"):
            right = self.sum()
            return lambda s: F.coalesce(F.array_contains(right(s), left(s)), F.lit(False))
        return left

    def sum(self):
        left = self.product()
        while (op := self.take("+", "-", "~")) is not None:
            of = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: F.concat(a.cast("string"), b.cast("string"))}[op]
            left = (lambda f, a, b: lambda s: f(a(s), b(s)))(of, left, self.product())
        return left

    def product(self):
        left = self.filtered()
        while (op := self.take("*", "/")) is not None:
            of = (lambda a, b: a * b) if op == "*" else (lambda a, b: a / b)
            left = (lambda f, a, b: lambda s: f(a(s), b(s)))(of, left, self.filtered())
        return left

    def filtered(self):
        value = self.field()
        while self.take("|"):
            name = self.tokens[self.k][1] if self.k < len(self.tokens) else ""
            self.k += 1
            if name not in FILTERS:
                raise PromptError("prompt_render_error", f"no filter {name}", name)
            args = []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
                    if self.k >= len(self.tokens):
                        raise PromptError("prompt_render_error", f") is missing in {self.text!r}")
            value = (lambda f, v, xs: lambda s: f(v(s), *(x(s) for x in xs)))(FILTERS[name], value, args)
        return value

    def field(self):
        value = self.atom()
        while True:
            if self.take("."):
                name = self.tokens[self.k][1] if self.k < len(self.tokens) else ""
                self.k += 1
                value = (lambda v, n: lambda s: v(s)[n])(value, name)
            elif self.take("["):
                key = self.either()
                self.need("]")
                value = (lambda v, q: lambda s: v(s)[q(s)])(value, key)
            else:
                return value

    def atom(self):
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        if self.k >= len(self.tokens):
            raise PromptError("prompt_render_error", f"an expression is missing in {self.text!r}")
        kind, t = self.tokens[self.k]
        self.k += 1
        if kind == "number":
            return lambda s: F.lit(float(t) if "." in t else int(t))
        if kind == "string":
            return lambda s: F.lit(t[1:-1])
        if kind != "name":
            raise PromptError("prompt_render_error", f"can't read {t!r} in {self.text!r}")
        if t.lower() in ("true", "false", "none"):
            return lambda s: F.lit({"true": True, "false": False, "none": None}[t.lower()])

        def name(s: Scope) -> Column:
            if t not in s:
                raise PromptError("prompt_render_error", f"{t} is not defined", t)
            return s[t]

        return name


#: Types whose zero counts as false.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def truth(value: Column) -> Column:
    """Whether a value counts as true, by its type: a boolean itself, a number unless it is
    zero, a text, list or map unless it is empty, anything else unless it is null.

    The type is known when the query is planned, so one branch is left of the choice.
    """
    kind, text, inside = F.typeof(value), value.cast("string"), F.to_json(F.struct(value.alias("v")))
    number = kind.isin(*_NUMBERS) | kind.startswith("decimal")
    said = (
        F.when(kind == "boolean", text == "true").when(kind.startswith("string") | kind.startswith("varchar") | kind.startswith("char"), text != "")
        .when(kind.startswith("array"), value.isNotNull() & (inside != '{"v":[]}')).when(kind.startswith("map"), value.isNotNull() & (inside != '{"v":{}}')).when(number, text.try_cast("double") != 0).otherwise(value.isNotNull())
    )
    return F.coalesce(said, F.lit(False))


def compiled(template: str) -> Callable[[Scope], Column]:
    """The template as a function from named columns to a text column."""
    parts = [p for p in _PARTS.split(template) if p]
    for k, p in enumerate(parts):  # a dash takes the blanks beside a tag
        if p[:2] in ("{{", "{%", "{#"):
            if p[2] == "-" and k:
                parts[k - 1] = parts[k - 1].rstrip() if parts[k - 1][:2] not in ("{{", "{%", "{#") else parts[k - 1]
            if p[-3] == "-" and k + 1 < len(parts):
                parts[k + 1] = parts[k + 1].lstrip()
    tags = [(p[:2], p[2:-2].strip("-").strip()) if p[:2] in ("{{", "{%", "{#") else ("", p) for p in parts]
    at = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        out = []
        while at < len(tags):
            kind, body = tags[at]
            at += 1
            if kind == "":
                out.append((lambda t: lambda s: F.lit(t))(body))
            elif kind == "{{":
                out.append((lambda e: lambda s: F.coalesce(e(s).cast("string"), F.lit("")))(_Parser(body).whole()))
            elif kind == "{%":
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return out, body
                if word == "if":
                    out.append(condition(body))
                elif word == "for":
                    out.append(loop(body))
                else:
                    raise PromptError("prompt_render_error", f"unknown block {word!r}", word)
        if ends:
            raise PromptError("prompt_render_error", f"one of {ends} is missing")
        return out, ""

    def text(nodes: list) -> Callable[[Scope], Column]:
        return lambda s: F.concat(F.lit(""), *(n(s) for n in nodes))

    def condition(body: str):
        cases, other = [], None
        while True:
            test = _Parser(body.split(None, 1)[1]).whole()
            nodes, body = block("elif", "else", "endif")
            cases.append((test, text(nodes)))
            if body.startswith("elif"):
                continue
            if body == "else":
                nodes, body = block("endif")
                other = text(nodes)
            break

        def value(s: Scope) -> Column:
            out = F
            for test, then in cases:
                out = out.when(truth(test(s)), then(s))
            return out.otherwise(other(s) if other is not None else F.lit(""))

        return value

    def loop(body: str):
        m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", body, re.S)
        if not m:
            raise PromptError("prompt_render_error", f"can't read {body!r}")
        name, items = m.group(1), _Parser(m.group(2)).whole()
        nodes, body = block("else", "endfor")
        inner, other = text(nodes), None
        if body == "else":
            nodes, _ = block("endfor")
            other = text(nodes)

        def value(s: Scope) -> Column:
            xs = items(s)
            n = F.size(xs)

            def one(x: Column, i: Column) -> Column:
                state = F.struct((i + 1).alias("index"), i.alias("index0"), (i == 0).alias("first"), (i == n - 1).alias("last"))
                return inner({**s, name: x, "loop": state})

            said = F.array_join(F.transform(xs, one), "")
            empty = other(s) if other is not None else F.lit("")
            return F.when(F.coalesce(n > 0, F.lit(False)), said).otherwise(empty)

        return value

    nodes, _ = block()
    return text(nodes)


def rendered_template(template: str, **scope: Column) -> Column:
    """A template's text with names given as columns."""
    return compiled(template)(scope)


#: Templates that hold more than text and plain {{ name }}.
_BLOCKS = r"\{%|\{#|\{\{(?!-?\s*[A-Za-z_][A-Za-z0-9_]*\s*-?\}\})|\{\{-|-\}\}"


class Dispatcher:
    """Rows with templates of their own: text and error of a template column.

    Templates with blocks, filters or expressions are compiled once each and chosen by their
    hash; those of plain names are filled in by one expression, however many there are. What
    can't be read, or names something that isn't given, is an error of its rows only.
    """

    def __init__(self, templates: list[str], scope: Scope):
        self.plain = F.map_from_arrays(F.array(*(F.lit(k) for k in scope)).cast("array<string>"), F.array(*(c.cast("string") for c in scope.values())).cast("array<string>"))
        self.texts: list[tuple[str, Column]] = []
        self.errors: list[tuple[str, str]] = []
        for t in templates:
            try:
                self.texts.append((t, rendered_template(t, **scope)))
            except PromptError as e:
                self.errors.append((t, e.message or e.category))

    @classmethod
    def of(cls, df: DataFrame, template: Column, scope: Scope, most: int = 500) -> Dispatcher:
        """The dispatcher of a column's templates; more than `most` with blocks raise."""
        found = df.where(template.rlike(_BLOCKS)).select(template.alias("t")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise PromptError("prompt_render_error", f"more than {most} templates with blocks")
        return cls(sorted(r["t"] for r in found), scope)

    def _chosen(self, template: Column, made: list[tuple[str, Column]], otherwise: Column) -> Column:
        out = F
        for t, value in made:  # hashes are compared first, texts only where they agree
            out = out.when((F.xxhash64(template) == F.xxhash64(F.lit(t))) & (template == F.lit(t)), value)
        return out.otherwise(otherwise) if made else otherwise

    def text(self, template: Column) -> Column:
        """The rendered text; null where there is an error."""
        from .prompts import rendered

        return F.when(self.error(template).isNull(), self._chosen(template, self.texts, rendered(template, self.plain)))

    def error(self, template: Column) -> Column:
        """Why a template can't be rendered, or null: `x is not defined`, or what can't be read."""
        from .prompts import undefined

        lost = F.get(undefined(template, self.plain), F.lit(0))
        missing = F.when(lost.isNotNull(), F.concat(lost, F.lit(" is not defined")))
        known = [(t, F.lit(None).cast("string")) for t, _ in self.texts] + [(t, F.lit(why)) for t, why in self.errors]
        return F.when(template.isNull(), "no template").otherwise(self._chosen(template, known, missing))
