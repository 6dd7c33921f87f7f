"""Chat formatting with a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree is
turned into Python closures.  The language is closed: names, keys of mappings,
literals, comparisons, ``and or not in + ~``, a conditional expression, the filters
in ``FILTERS``; the tags ``for if elif else set generation``.  There is no call, no
attribute access and no index into anything but mappings, so a template can
reach nothing that it has not been given.

Rendering is a stream of (text, in_generation) segments.  ``generation`` blocks
mark what a model is trained on; loops read their sequence one element at a time, so a
conversation of any length is formatted in constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

#: Strings with a meaning in the formatted text; none may come out of a message.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}"
    "<s>[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>\n"
    "{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Double each backslash, then put one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(str(v)),
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
    "default": lambda v, other="": other if v is None else v,
}


class TemplateError(ValueError):
    """The template is not in the language."""


# -- syntax tree: tuples whose first item names the node ---------------------------------

_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~|.()\[\],=]))""")
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        if not (m := _TOKEN.match(code, at)):
            raise TemplateError(f"cannot read {code[at:]!r}")
        at = m.end()
        if m["num"]:
            out.append(("const", int(m["num"])))
        elif m["str"]:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m["str"][1:-1])))
        elif m["name"] in _WORDS:
            out.append(("const", _WORDS[m["name"]]))
        elif m["name"]:
            out.append(("name", m["name"]))
        else:
            out.append(("op", m["op"]))
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, code: str):
        self.code, self.rest = code, _tokens(code)

    def next_is(self, *values: str) -> str | None:
        return self.rest[0][1] if self.rest and self.rest[0][0] != "const" and self.rest[0][1] in values else None

    def take(self, *values: str) -> str:
        if not (got := self.next_is(*values)):
            raise TemplateError(f"expected {' or '.join(values)} in {self.code!r}")
        self.rest.pop(0)
        return got

    def name(self) -> str:
        if not self.rest or self.rest[0][0] != "name":
            raise TemplateError(f"expected a name in {self.code!r}")
        return self.rest.pop(0)[1]

    def end(self) -> None:
        if self.rest:
            raise TemplateError(f"unread {self.rest[0][1]!r} in {self.code!r}")

    def value(self) -> tuple:
        then = self.either()
        if self.next_is("if"):
            self.take("if")
            test = self.either()
            other = ("const", "")
            if self.next_is("else"):
                self.take("else")
                other = self.value()
            return ("choice", test, then, other)
        return then

    def either(self) -> tuple:
        left = self.both()
        while self.next_is("or"):
            self.take("or")
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.next_is("and"):
            self.take("and")
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.next_is("not"):
            self.take("not")
            return ("not", self.negated())
        left = self.sum()
        if op := self.next_is("==", "!=", "<", ">", "<=", ">=", "in"):
            self.take(op)
            return ("compare", op, left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.filtered()
        while op := self.next_is("+", "-", "~"):
            self.take(op)
            left = ("binary", op, left, self.filtered())
        return left

    def filtered(self) -> tuple:
        node = self.item()
        while self.next_is("|"):
            self.take("|")
            if (name := self.name()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = []
            if self.next_is("("):
                self.take("(")
                while not self.next_is(")"):
                    args.append(self.value())
                    if not self.next_is(")"):
                        self.take(",")
                self.take(")")
            node = ("filter", name, node, tuple(args))
        return node

    def item(self) -> tuple:
        if self.next_is("("):
            self.take("(")
            node = self.value()
            self.take(")")
        elif self.rest and self.rest[0][0] == "const":
            node = self.rest.pop(0)
        else:
            node = ("name", self.name())
        while op := self.next_is(".", "["):
            self.take(op)
            if op == ".":
                node = ("key", node, ("const", self.name()))
            else:
                node = ("key", node, self.value())
                self.take("]")
        return node


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """('text', ...), ('print', code), ('tag', code); a dash inside a tag trims white space beside it."""
    at, trim = 0, False
    while m := _TAG.search(source, at):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if m[0].endswith("-") else text
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = _closing(source, m.end(), close)
        code = source[m.end() : end]
        trim = code.endswith("-") and close != "#}"
        if close != "#}":
            yield ("print" if close == "}}" else "tag"), code[:-1] if trim else code
        at = end + 2
    yield "text", source[at:].lstrip() if trim else source[at:]


def _closing(source: str, at: int, close: str) -> int:
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"" and close != "#}":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    raise TemplateError(f"{close} is missing")


def parse(source: str) -> tuple:
    """The syntax tree of a template: ('block', (nodes...))."""
    rows = [(k, v) for k, v in _pieces(source) if k != "text" or v]
    tree, at = _block(rows, 0, ())
    if at != len(rows):
        raise TemplateError(f"unexpected tag {rows[at][1].strip()!r}")
    return tree


def _expression(code: str) -> tuple:
    e = _Expression(code)
    node = e.value()
    e.end()
    return node


def _block(rows: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    nodes: list[tuple] = []
    while at < len(rows):
        kind, code = rows[at]
        if kind == "text":
            nodes.append(("text", code))
            at += 1
            continue
        if kind == "print":
            nodes.append(("print", _expression(code)))
            at += 1
            continue
        e = _Expression(code)
        word = e.name()
        if word in ends:
            return ("block", tuple(nodes)), at
        at += 1
        if word == "for":
            name = e.name()
            e.take("in")
            seq = e.value()
            e.end()
            body, at = _block(rows, at, ("endfor",))
            nodes.append(("for", name, seq, body))
        elif word == "if":
            node, at = _branches(rows, at, e)
            nodes.append(node)
        elif word == "set":
            name = e.name()
            e.take("=")
            nodes.append(("set", name, e.value()))
            e.end()
            continue
        elif word == "generation":
            e.end()
            body, at = _block(rows, at, ("endgeneration",))
            nodes.append(("generation", body))
        else:
            raise TemplateError(f"unknown tag {word!r}")
        if at >= len(rows):
            raise TemplateError(f"{word} is not ended")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return ("block", tuple(nodes)), at


def _branches(rows: list[tuple[str, str]], at: int, e: _Expression) -> tuple[tuple, int]:
    test = e.value()
    e.end()
    then, at = _block(rows, at, ("elif", "else", "endif"))
    word = _Expression(rows[at][1])
    kind = word.name()
    if kind == "elif":
        other, at = _branches(rows, at + 1, word)
        return ("if", test, then, ("block", (other,))), at
    if kind == "else":
        other, at = _block(rows, at + 1, ("endif",))
        return ("if", test, then, other), at
    return ("if", test, then, ("block", ())), at


# -- folding ----------------------------------------------------------------------------

_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def _text(value: object) -> str:
    return "" if value is None else str(value)


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions evaluated, dead branches cut and constant output joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind in ("not", "and", "or", "binary", "compare", "choice", "filter", "key"):
        parts = tuple(
            fold(x) if isinstance(x, tuple) and x and isinstance(x[0], str) else tuple(map(fold, x)) if isinstance(x, tuple) else x for x in node[1:]
        )
        flat = [y for x in parts for y in (x if isinstance(x, tuple) and (not x or isinstance(x[0], tuple)) else (x,))]
        node = (kind, *parts)
        if all(x[0] == "const" for x in flat if isinstance(x, tuple)):
            try:
                return ("const", _value(node)({}))
            except Exception as error:
                raise TemplateError(f"constant expression fails: {error}") from error
        if kind == "choice" and node[1][0] == "const":
            return node[2] if node[1][1] else node[3]
        return node
    if kind == "print":
        value = fold(node[1])
        return ("text", _text(value[1])) if value[0] == "const" else ("print", value)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        test, then, other = fold(node[1]), fold(node[2]), fold(node[3])
        if test[0] == "const":
            return then if test[1] else other
        return ("if", test, then, other)
    out: list[tuple] = []
    for child in map(fold, node[1]):
        for x in child[1] if child[0] == "block" else (child,):
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return ("block", tuple(out))


# -- closures -----------------------------------------------------------------------------


def _value(node: tuple) -> Callable[[dict], object]:
    """A closure that computes an expression in an environment."""
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "key":
        of, key = _value(node[1]), _value(node[2])

        def lookup(env: dict) -> object:
            got = of(env)
            return got.get(key(env)) if isinstance(got, Mapping) else None

        return lookup
    if kind == "not":
        inner = _value(node[1])
        return lambda env: not inner(env)
    if kind in ("and", "or"):
        a, b = _value(node[1]), _value(node[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "compare":
        test, a, b = _COMPARE[node[1]], _value(node[2]), _value(node[3])
        return lambda env: test(a(env), b(env))
    if kind == "binary":
        a, b = _value(node[2]), _value(node[3])
        if node[1] == "~":
            return lambda env: _text(a(env)) + _text(b(env))
        return (lambda env: a(env) + b(env)) if node[1] == "+" else (lambda env: a(env) - b(env))
    if kind == "choice":
        test, a, b = map(_value, node[1:])
        return lambda env: a(env) if test(env) else b(env)
    call, of, args = FILTERS[node[1]], _value(node[2]), [_value(x) for x in node[3]]
    return lambda env: call(of(env), *[x(env) for x in args])


Segment = tuple[str, bool]


def _render(node: tuple, marked: bool) -> Callable[[dict], Iterator[Segment]]:
    """A closure that yields the segments of a statement."""
    kind = node[0]
    if kind == "text":
        segment = (node[1], marked)

        def constant(env: dict) -> Iterator[Segment]:
            yield segment

        return constant
    if kind == "print":
        value = _value(node[1])

        def printed(env: dict) -> Iterator[Segment]:
            yield _text(value(env)), marked

        return printed
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assigned(env: dict) -> Iterator[Segment]:
            env[name] = value(env)
            yield from ()

        return assigned
    if kind == "generation":
        return _render(node[1], True)
    if kind == "if":
        test, then, other = _value(node[1]), _render(node[2], marked), _render(node[3], marked)
        return lambda env: then(env) if test(env) else other(env)
    if kind == "for":
        name, seq, body = node[1], _value(node[2]), _render(node[3], marked)

        def loop(env: dict) -> Iterator[Segment]:
            items = iter(seq(env) or ())
            done = object()
            item, k = next(items, done), 0
            while item is not done:
                after = next(items, done)
                inner = {**env, name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": after is done}}
                yield from body(inner)
                item, k = after, k + 1

        return loop
    parts = [_render(x, marked) for x in node[1]]

    def block(env: dict) -> Iterator[Segment]:
        for part in parts:
            yield from part(env)

    return block


def compile_template(source: str) -> Callable[[Iterable[Mapping]], Iterator[Segment]]:
    """A function from messages to segments."""
    run = _render(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


# -- reading formatted text back ------------------------------------------------------------


class Reader:
    """Parses segments of TEMPLATE's output; holds one turn at a time."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self._open, self._loss = "", ""

    def feed(self, text: str, marked: bool) -> None:
        self.chars += len(text)
        self._open += text
        self._loss += text if marked else ""
        while (end := self._open.find("</s>\n")) >= 0:
            head, _, body = self._open[:end].partition("[/INST]")
            self._open = self._open[end + 5 :]
            if not head.startswith("<s>[INST]"):
                raise ValueError("formatted text does not read back")
            role, said, loss = unescape(head[9:]), unescape(body), unescape(self._loss)
            self.turns += 1
            self.turn_hash.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.loss_hash.update(loss.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(loss)
            self._loss = ""

    def close(self) -> None:
        if self._open:
            raise ValueError("formatted text ends inside a turn")


# -- operators -----------------------------------------------------------------------------


def _sorted(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = df.select(col(conv_col), col(turn_col), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("_role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("_text"))
    return said.repartition(conv_col).sortWithinPartitions(conv_col, turn_col, "_role", "_text").select(conv_col, "_role", "_text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for b in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield conv, {"role": role, "text": text}


def format_conversations(
    df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Formatted segments: conv_id, segment (number within the conversation), text, in_generation.

    Turns stand in the order of ``turn`` (null first), ties by role, then text;
    repeated rows are repeated turns.  Null roles and texts count as empty; rows with
    a null conv_id form one conversation.  Neighbouring segments of equal kind are
    joined turn by turn, so no row grows with the conversation.
    """
    kind = df.schema[conv_col].dataType
    schema = T.StructType([T.StructField(conv_col, kind), T.StructField("segment", T.LongType()), T.StructField("text", T.StringType()), T.StructField("in_generation", T.BooleanType())])
    compile_template(template)  # errors show before the job starts
    arrow_kind = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(template), []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [arrow_kind, pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        for conv, turns in groupby(_messages(batches), key=lambda m: m[0]):
            for k, (text, marked) in enumerate(render(m for _, m in turns)):
                rows.append((conv, k, text, marked))
                if len(rows) >= 2000:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return _sorted(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def conversation_digests(
    df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Format each conversation, read it back, and return digests of what was read.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  The
    template must mark turns as TEMPLATE does.  Nulls, ties and repeats as in
    ``format_conversations``.  A conversation streams through; none is held.
    """
    kind = df.schema[conv_col].dataType
    names = [(conv_col, kind), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in names])
    arrow_kind = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(template), []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [arrow_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        for conv, turns in groupby(_messages(batches), key=lambda m: m[0]):
            reader = Reader()
            for text, marked in render(m for _, m in turns):
                reader.feed(text, marked)
            reader.close()
            rows.append((conv, reader.turns, reader.turn_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars))
            if len(rows) >= 2000:
                yield out()
                rows = []
        if rows:
            yield out()

    return _sorted(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)
