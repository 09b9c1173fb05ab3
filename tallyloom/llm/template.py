"""Chat formatting: a compiler for a small, sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures. There is no attribute access beyond the fields of a message, no call but to the
listed filters, no import and no loop but over the messages, so a template can do nothing else.
Messages are drawn one at a time and output is yielded in pieces, so a conversation of any
length needs the memory of one turn.

Language: text; ``{{ expression }}``; ``{% for m in messages %} .. {% endfor %}``;
``{% if e %} .. {% elif e %} .. {% else %} .. {% endif %}``;
``{% generation %} .. {% endgeneration %}`` around what the loss is taken of; ``{# comment #}``.
A ``-`` inside a delimiter trims the white space next to it. Expressions: strings, integers,
``true``, ``false``, ``m.role``, ``m.text``, ``loop.first``, ``loop.last``, ``loop.index``,
``+`` (joins), ``==``, ``!=``, ``and``, ``or``, ``not``, parentheses, and ``| filter``.

The chat template escapes control strings reversibly: ``<`` , any backslashes and ``|`` get one
backslash more between them, so ``<|`` never stands in an escaped text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Piece = tuple[str, bool]
Scope = dict[str, object]

CHAT = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_name }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
START, END = "<|im_start|>", "<|im_end|>\n"


class TemplateError(ValueError):
    """A template that the language does not allow."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_name(text: str) -> str:
    """For one line: line feeds as ``\\n``, backslashes doubled."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(text: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper,
    "lower": str.lower,
}
FIELDS = {"role", "text"}
LOOP = {"first", "last", "index"}


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    base: str
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Branch:
    arms: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


TAG = re.compile(r"\{(?P<open>[{%#])(?P<left>-?)(?P<body>.*?)(?P<right>-?)(?P<close>[}%#])\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)"""
                   r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.+|()]))""")
PAIR = {"{": "}", "%": "%", "#": "#"}
ESCAPES = {"n": "\n", "t": "\t"}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, names: frozenset[str]) -> None:
        self.tokens, self.at, self.names = _lex(source), 0, names

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def parse(self) -> object:
        out = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def chain(self, kind: str, below: Callable[[], object]) -> object:
        parts = [below()]
        while self.take(kind):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def either(self) -> object:
        return self.chain("or", lambda: self.chain("and", self.negated))

    def negated(self) -> object:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        left = self.joined()
        sign = self.take("==", "!=")
        return Op(sign, (left, self.joined())) if sign else left

    def joined(self) -> object:
        return self.chain("+", self.filtered)

    def filtered(self) -> object:
        value = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at]
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Op("|", (value, name))
        return value

    def atom(self) -> object:
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis stays open")
            return value
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "name" and value in self.names:
            if not self.take("."):
                raise TemplateError(f"{value} is no value of its own")
            name = self.tokens[self.at][1]
            self.at += 1
            if name not in (LOOP if value == "loop" else FIELDS):
                raise TemplateError(f"no field {value}.{name}")
            return Field(value, name)
        raise TemplateError(f"unexpected {value!r}")


def _parts(source: str) -> list[tuple[str, str]]:
    """Text, output and statement parts in order, white space trimmed, comments gone."""
    out, at, trim = [], 0, False
    for m in TAG.finditer(source):
        if m["close"] != PAIR[m["open"]]:
            raise TemplateError(f"delimiters do not match in {m[0]!r}")
        text = source[at:m.start()]
        text = text.lstrip() if trim else text
        out.append(("text", text.rstrip() if m["left"] else text))
        if m["open"] != "#":
            out.append(("output" if m["open"] == "{" else "statement", m["body"].strip()))
        at, trim = m.end(), bool(m["right"])
    out.append(("text", source[at:].lstrip() if trim else source[at:]))
    return [(kind, text) for kind, text in out if kind != "text" or text]


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = _parts(source), 0

    def block(stops: tuple[str, ...], names: frozenset[str], marked: bool) -> tuple[tuple, str]:
        nonlocal at
        out: list[object] = []
        while at < len(parts):
            kind, text = parts[at]
            at += 1
            if kind == "text":
                out.append(Output(Const(text)))
                continue
            if kind == "output":
                out.append(Output(_Expression(text, names).parse()))
                continue
            word, _, rest = text.partition(" ")
            if word in stops:
                return tuple(out), text
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not m or "loop" in names or m[1] == "loop":
                    raise TemplateError("the only loop is one over messages")
                body, _ = block(("endfor",), names | {m[1], "loop"}, marked)
                out.append(Loop(m[1], body))
            elif word == "generation" and not rest.strip() and not marked:
                out.append(Generation(block(("endgeneration",), names, True)[0]))
            elif word == "if":
                arms, test = [], rest
                while True:
                    body, stop = block(("elif", "else", "endif"), names, marked)
                    arms.append((_Expression(test, names).parse(), body))
                    if stop.startswith("elif"):
                        test = stop[4:]
                        continue
                    if stop == "else":
                        arms.append((Const(True), block(("endif",), names, marked)[0]))
                    break
                out.append(Branch(tuple(arms)))
            else:
                raise TemplateError(f"unexpected statement {text!r}")
        if stops:
            raise TemplateError(f"no {stops[-1]}")
        return tuple(out), ""

    return block((), frozenset(), False)[0]


def _compute(kind: str, values: list[object]) -> object:
    if kind == "+":
        return "".join(map(str, values))
    if kind == "==":
        return values[0] == values[1]
    if kind == "!=":
        return values[0] != values[1]
    return not values[0]


def fold(node: object) -> object:
    """The same tree with constant expressions computed, dead arms dropped, texts joined."""
    if isinstance(node, tuple):
        out: list[object] = []
        for part in map(fold, node):
            for x in part if isinstance(part, tuple) else (part,):
                if out and isinstance(x, Output) and isinstance(out[-1], Output) \
                        and isinstance(x.value, Const) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(f"{_shown(out[-1].value.value)}{_shown(x.value.value)}"))
                else:
                    out.append(x)
        return tuple(out)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Branch):
        arms = []
        for test, body in node.arms:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            arms.append((test, fold(body)))
            if isinstance(test, Const):
                break
        if not arms:
            return ()
        return arms[0][1] if isinstance(arms[0][0], Const) else Branch(tuple(arms))
    if isinstance(node, Op) and node.kind == "|":
        value = fold(node.parts[0])
        if isinstance(value, Const):
            return Const(FILTERS[node.parts[1]](_shown(value.value)))
        return Op("|", (value, node.parts[1]))
    if isinstance(node, Op):
        parts = [fold(p) for p in node.parts]
        if node.kind in ("and", "or"):
            left = []
            for p in parts:
                if isinstance(p, Const) and bool(p.value) == (node.kind == "and") and p is not parts[-1]:
                    continue
                left.append(p)
                if isinstance(p, Const):
                    break
            return left[0] if len(left) == 1 else Op(node.kind, tuple(left))
        if all(isinstance(p, Const) for p in parts):
            return Const(_compute(node.kind, [p.value for p in parts]))
        return Op(node.kind, tuple(parts))
    return node


def _shown(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _evaluator(node: object) -> Callable[[Scope], object]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Field):
        return lambda scope, base=node.base, name=node.name: scope[base][name]
    if node.kind == "|":
        inner, filter_ = _evaluator(node.parts[0]), FILTERS[node.parts[1]]
        return lambda scope: filter_(_shown(inner(scope)))
    parts = [_evaluator(p) for p in node.parts]
    if node.kind in ("and", "or"):
        def chosen(scope: Scope, stop: bool = node.kind == "or") -> object:
            value: object = None
            for part in parts:
                value = part(scope)
                if bool(value) == stop:
                    break
            return value
        return chosen
    return lambda scope, kind=node.kind: _compute(kind, [p(scope) for p in parts])


def _renderer(nodes: tuple, marked: bool) -> Callable[[Scope], Iterator[Piece]]:
    steps: list[Callable[[Scope], Iterator[Piece]]] = []
    for node in nodes:
        if isinstance(node, Output):
            def output(scope: Scope, value=_evaluator(node.value)) -> Iterator[Piece]:
                yield _shown(value(scope)), marked
            steps.append(output)
        elif isinstance(node, Generation):
            steps.append(_renderer(node.body, True))
        elif isinstance(node, Branch):
            def branch(scope: Scope, arms=[(_evaluator(t), _renderer(b, marked))
                                           for t, b in node.arms]) -> Iterator[Piece]:
                for test, body in arms:
                    if test(scope):
                        yield from body(scope)
                        return
            steps.append(branch)
        else:
            def loop(scope: Scope, name=node.name, body=_renderer(node.body, marked)) -> Iterator[Piece]:
                messages = iter(scope["messages"])
                current, index = next(messages, None), 1
                while current is not None:
                    following = next(messages, None)
                    place = {"first": index == 1, "last": following is None, "index": index}
                    yield from body({**scope, name: current, "loop": place})
                    current, index = following, index + 1
            steps.append(loop)

    def run(scope: Scope) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)
    return run


def compile_template(source: str) -> Callable[[Iterable[dict[str, str]]], Iterator[Piece]]:
    """A function from messages (``role``, ``text``) to pieces of output and whether the loss is
    taken of them."""
    run = _renderer(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})


class Reader:
    """Reads turns and masked text back from the pieces of a formatted conversation.

    Holds one turn at a time; digests are of everything read.
    """

    def __init__(self) -> None:
        self.turns = self.chars = self.loss_chars = 0
        self.text_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.turn: list[str] = []
        self.masked: list[str] = []

    def feed(self, pieces: Iterable[Piece]) -> None:
        for text, marked in pieces:
            self.chars += len(text)
            if marked:
                self.masked.append(text)
            elif self.masked:
                self._close_mask()
            while END in text:
                head, _, text = text.partition(END)
                self.turn.append(head)
                self._close_turn()
            self.turn.append(text)
        if self.masked:
            self._close_mask()
        if "".join(self.turn):
            raise ValueError("the output ends inside a turn")

    def _close_mask(self) -> None:
        text = unescape("".join(self.masked))
        self.masked = []
        self.loss_chars += len(text)
        self.loss_digest.update(text.encode())

    def _close_turn(self) -> None:
        whole = "".join(self.turn)
        self.turn = []
        if not whole.startswith(START) or "\n" not in whole:
            raise ValueError("a turn does not begin with its mark")
        role, _, text = whole.removeprefix(START).partition("\n")
        self.turns += 1
        self.text_digest.update(f"{unescape_name(role)}\n{unescape(text)}\n".encode())


RESULT = [
    ("n_turns", pa.int64(), T.LongType()), ("turns_sha256", pa.string(), T.StringType()),
    ("loss_chars", pa.int64(), T.LongType()), ("loss_sha256", pa.string(), T.StringType()),
    ("formatted_chars", pa.int64(), T.LongType()),
]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, iterator of messages) for rows sorted by id; each iterator is to be used up."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "role", "text")]
            yield from zip(*columns, strict=True)

    source = rows()
    head = next(source, None)
    while head is not None:
        key = head[0]

        def messages() -> Iterator[dict[str, str]]:
            nonlocal head
            while head is not None and head[0] == key:
                yield {"role": head[1] or "", "text": head[2] or ""}
                head = next(source, None)

        yield key, messages()


def _digest(template: str, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        id_type: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                id_type[:] = [batch.schema.field("id").type]
                yield batch

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = [id_type[0], *[k for _, k, _ in RESULT]]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [name, *[n for n, _, _ in RESULT]])
            held.clear()
            return out

        for key, messages in _conversations(seen()):
            reader = Reader()
            reader.feed(render(messages))
            for _ in messages:
                pass
            held.append((key, reader.turns, reader.text_digest.hexdigest(), reader.loss_chars,
                         reader.loss_digest.hexdigest(), reader.chars))
            if len(held) >= 1000:
                yield flush()
        if held:
            yield flush()
    return run


def _ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str,
             text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"))
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")


def format_digests(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", template: str = CHAT,
) -> DataFrame:
    """Format every conversation and read it back: one row per conversation.

    ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed per turn), ``loss_chars`` and
    ``loss_sha256`` (unescaped text under the generation marks), ``formatted_chars``. Turns go by
    number, null first; equal numbers by role and text. Null roles and texts are empty. Rows
    without an id are one conversation. A conversation is read as a stream of its sorted rows.
    The template must mark turns as ``CHAT`` does, to be read back.
    """
    compile_template(template)
    schema = T.StructType([
        T.StructField(id_col, conversations.schema[id_col].dataType),
        *[T.StructField(n, t) for n, _, t in RESULT]])
    return _ordered(conversations, id_col, turn_col, role_col, text_col).mapInArrow(
        _digest(template, id_col), schema)


def _render(template: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        id_type: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                id_type[:] = [batch.schema.field("id").type]
                yield batch

        for key, messages in _conversations(seen()):
            parts, spans, at = [], [], 0
            for text, marked in render(messages):
                if marked and text:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + len(text))
                    else:
                        spans.append((at, at + len(text)))
                parts.append(text)
                at += len(text)
            for _ in messages:
                pass
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                pa.array([key], id_type[0]), pa.array(["".join(parts)], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in spans]], kind),
            ], ["id", "formatted", "loss_spans"])
    return run


def format_conversations(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", template: str = CHAT,
) -> DataFrame:
    """``formatted`` text of every conversation and ``loss_spans`` in it, in code points.

    A row holds one whole conversation; see ``format_digests`` for order, nulls and ids.
    """
    compile_template(template)
    kind = conversations.schema[id_col].dataType.simpleString()
    return _ordered(conversations, id_col, turn_col, role_col, text_col).mapInArrow(
        _render(template),
        f"id {kind}, formatted string, loss_spans array<struct<start: long, end: long>>",
    ).withColumnRenamed("id", id_col)
