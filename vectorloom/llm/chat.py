"""Chat formatting with a sandboxed template compiler.

A template is parsed into a syntax tree, constants are folded, and each node becomes a Python closure;
rendering a conversation calls closures only. The language has text, ``{{ expression }}``,
``{% for x in messages %} .. {% endfor %}``, ``{% if %} {% elif %} {% else %} {% endif %}`` and
``{% generation %} .. {% endgeneration %}``; expressions have string, integer and boolean literals,
names, ``a.b`` and ``a['b']`` on records, ``== != in``, ``and or not``, ``+`` and ``~`` for joining,
and the filters ``escape``, ``escape_line``, ``trim``, ``upper``, ``lower``. There are no calls, no
attributes of Python objects and no assignments, so a template can read nothing but its messages.

Text put out inside a generation block is under the loss mask; spans of the mask come with the text.

Escaping is reversible: a backslash goes before every backslash and before every control string
(``<turn``, ``</turn``) inside a text, so an unescaped control string is always the template's own.

Edge cases: null roles and texts are empty; a null conv_id is a conversation of its own; turns are
ordered by turn (nulls first), then role and text; an empty table gives an empty result; other columns
of the input are ignored. Rows stream through a sorted partition one turn at a time and long
conversations are put out in chunks, so memory is bounded by a chunk, whatever a conversation's length.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = "{% for m in messages %}{{ '<turn ' + m.role | escape_line + '\\n' }}{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ '</turn>' ~ '\\n' }}{% endfor %}"

_CONTROL = re.compile(r"\\|</?turn")
_CONTROL_LINE = re.compile(r"\\|</?turn|\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    return _CONTROL_LINE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not in the language."""


# -- lexing and parsing --------------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_TOKENS = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+~|.\[\]()]))", re.DOTALL)
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, object]]:
    tokens, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 12]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            tokens.append(("const", re.sub(r"\\(.)", lambda x: _UNQUOTE.get(x[1], x[1]), text[1:-1], flags=re.DOTALL)))
        elif number is not None:
            tokens.append(("const", int(number)))
        elif name in ("true", "false"):
            tokens.append(("const", name == "true"))
        else:
            tokens.append(("name", name) if name is not None and name not in ("and", "or", "not", "in") else ("sign", name or sign))
        at = m.end()
    return tokens


class _Expression:
    """Recursive descent; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def sign(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs:
            self.at += 1
            return str(self.tokens[self.at - 1][1])
        return None

    def expect(self, kind: str):
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self):
        node = self.both()
        while self.sign("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.sign("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.sign("not") else self.compared()

    def compared(self):
        node = self.joined()
        while op := self.sign("==", "!=", "in"):
            node = (op, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while op := self.sign("+", "~"):
            node = (op, node, self.filtered())
        return node

    def filtered(self):
        node = self.field()
        while self.sign("|"):
            name = self.expect("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", node, name)
        return node

    def field(self):
        if self.sign("("):
            node = self.either()
            if not self.sign(")"):
                raise TemplateError("a ) is missing")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            node = ("const", self.expect("const"))
        else:
            node = ("name", self.expect("name"))
        while s := self.sign(".", "["):
            if s == ".":
                node = ("field", node, ("const", self.expect("name")))
            else:
                node = ("field", node, self.either())
                if not self.sign("]"):
                    raise TemplateError("a ] is missing")
        return node


def parse(template: str) -> list[tuple]:
    """Statements: (text, s), (put, e), (for, name, e, body), (if, [(e, body)..]), (generation, body)."""
    parts, at = [p for p in _PARTS.split(template) if p], 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                body.append(("put", _Expression(part[2:-2]).tree))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return body, part[2:-2].strip()
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError("for NAME in EXPRESSION is expected")
                    inner, _ = block(("endfor",))
                    body.append(("for", m[1], _Expression(m[2]).tree, inner))
                elif word == "if":
                    arms, test = [], _Expression(rest).tree
                    while True:
                        inner, end = block(("elif", "else", "endif"))
                        arms.append((test, inner))
                        if end == "endif":
                            break
                        test = ("const", True) if end == "else" else _Expression(end.partition(" ")[2]).tree
                    body.append(("if", arms))
                elif word == "generation":
                    inner, _ = block(("endgeneration",))
                    body.append(("generation", inner))
                else:
                    raise TemplateError(f"unknown statement {word!r}")
            else:
                body.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return block(())[0]


# -- constant folding ----------------------------------------------------------------------------

_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only strings, integers and booleans can be put out")


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold_expression(node[1])
        return ("const", FILTERS[node[2]](_text(inner[1]))) if inner[0] == "const" else ("filter", inner, node[2])
    if kind == "not":
        inner = fold_expression(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    left, right = fold_expression(node[1]), fold_expression(node[2])
    if kind in ("and", "or") and left[0] == "const":
        return right if bool(left[1]) == (kind == "and") else left
    if kind in _BINARY and left[0] == right[0] == "const":
        return ("const", _BINARY[kind](left[1], right[1]))
    return (kind, left, right)


def fold(body: list[tuple]) -> list[tuple]:
    """Folded expressions, settled branches, merged neighbouring text."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "put":
            e = fold_expression(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("put", e))
        elif node[0] == "if":
            arms = []
            for test, inner in ((fold_expression(t), fold(b)) for t, b in node[1]):
                if test[0] != "const":
                    arms.append((test, inner))
                elif test[1]:
                    arms.append((("const", True), inner))
                    break
            if arms and arms[0][0] == ("const", True):
                for inner_node in arms[0][1]:
                    add(inner_node)
            elif arms:
                add(("if", arms))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        else:
            add(node)
    return out


# -- closures ------------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        name = node[1]

        def look_up(scope: dict):
            if name not in scope:
                raise TemplateError(f"no variable {name!r}")
            return scope[name]

        return look_up
    if kind == "filter":
        inner, f = _value(node[1]), FILTERS[node[2]]
        return lambda scope: f(_text(inner(scope)))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    left, right = _value(node[1]), _value(node[2])
    if kind == "field":

        def read(scope: dict):
            record, key = left(scope), right(scope)
            if not isinstance(record, dict):
                raise TemplateError("only records have fields")
            return record.get(key)

        return read
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    f = _BINARY[kind]
    return lambda scope: f(left(scope), right(scope))


def _statement(node: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], masked)

        def put_text(scope: dict) -> Iterator[Piece]:
            yield piece

        return put_text
    if kind == "put":
        value = _value(node[1])

        def put(scope: dict) -> Iterator[Piece]:
            yield _text(value(scope)), masked

        return put
    if kind == "generation":
        return _block(node[1], True)
    if kind == "if":
        arms = [(_value(test), _block(body, masked)) for test, body in node[1]]

        def branch(scope: dict) -> Iterator[Piece]:
            for test, body in arms:
                if test(scope):
                    yield from body(scope)
                    return

        return branch
    name, source, body = node[1], _value(node[2]), _block(node[3], masked)

    def loop(scope: dict) -> Iterator[Piece]:
        items = iter(source(scope))
        index, item, none = 0, None, object()
        item = next(items, none)
        while item is not none:
            after = next(items, none)
            yield from body({**scope, name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": after is none}})
            index, item = index + 1, after

    return loop


def _block(body: list[tuple], masked: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_statement(node, masked) for node in body]

    def run(scope: dict) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope)

    return run


@functools.lru_cache(maxsize=16)
def compile_template(template: str) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """messages -> pieces (text, under the loss mask)."""
    render = _block(fold(parse(template)), False)
    return lambda messages: render({"messages": messages})


# -- DataFrame operators -------------------------------------------------------------------------

FORMATTED = "conv_id long, chunk long, formatted string, loss_spans array<struct<start:long,stop:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(key, rows of that key) of rows sorted by their first field, one row in memory at a time."""
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


def _spans(pieces: list[Piece], at: int) -> list[dict]:
    spans: list[dict] = []
    for text, masked in pieces:
        if masked and text:
            if spans and spans[-1]["stop"] == at:
                spans[-1]["stop"] = at + len(text)
            else:
                spans.append({"start": at, "stop": at + len(text)})
        at += len(text)
    return spans


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, chunk_chars: int = 1 << 20) -> DataFrame:
    """Rendered conversations with the code-point spans of their loss mask.

    One row per conversation; one longer than chunk_chars goes on in further rows (chunk 1, 2, ..).
    Spans count from the conversation's start. Rows of a partition are in order of conversation and chunk.
    """
    compile_template(template)  # errors show on the driver

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
        out: list[dict] = []
        held = 0
        for conv_id, rows in _runs(_turns(batches)):
            pieces: list[Piece] = []
            chunk, start, size = 0, 0, 0
            for text, masked in compiled({"role": role or "", "text": text or ""} for _, role, text in rows):
                pieces.append((text, masked))
                size += len(text)
                if size >= chunk_chars:
                    yield pa.RecordBatch.from_pylist([*out, {"conv_id": conv_id, "chunk": chunk, "formatted": "".join(t for t, _ in pieces), "loss_spans": _spans(pieces, start)}], schema)
                    out, held, pieces, chunk, start, size = [], 0, [], chunk + 1, start + size, 0
            if pieces or not chunk:
                out.append({"conv_id": conv_id, "chunk": chunk, "formatted": "".join(t for t, _ in pieces), "loss_spans": _spans(pieces, start)})
                held += size
            if held >= chunk_chars:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(render, FORMATTED)


class TurnReader:
    """Parses formatted text fed in chunks back into turns, by the template's own control strings."""

    _mark = re.compile(r"\\.|<turn |</turn>\n|\n", re.DOTALL)

    def __init__(self, on_turn: Callable[[str, str], None]):
        self.on_turn, self.rest, self.role = on_turn, "", None
        self.scanned = 0

    def feed(self, text: str) -> None:
        buffer, at, scan = self.rest + text, 0, self.scanned
        while True:
            m = self._mark.search(buffer, scan)
            if not m or (m[0][0] == "\\" and m.end() > len(buffer)):
                break
            scan = m.end()
            if m[0] == "<turn " and self.role is None:
                at = m.end()
            elif m[0] == "\n" and self.role is None:
                self.role, at = unescape(buffer[at : m.start()]), m.end()
            elif m[0] == "</turn>\n" and self.role is not None:
                self.on_turn(self.role, unescape(buffer[at : m.start()]))
                self.role, at = None, m.end()
        self.rest = buffer[at:]
        self.scanned = max(0, scan - at)


def read_back(formatted: DataFrame, presorted: bool = False) -> DataFrame:
    """Digests of the turns and of the text under the mask, from the formatted text alone.

    presorted: the rows come straight from ``format_conversations``, in order within each partition;
    rows read from storage are brought together and sorted first.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        for conv_id, rows in _runs(_turns(batches)):
            turns, loss, seen, loss_chars, at = hashlib.sha256(), hashlib.sha256(), [0], 0, 0

            def on_turn(role: str, text: str) -> None:
                seen[0] += 1
                turns.update(f"{role}\n{text}\n".encode())

            reader, carry, last_stop = TurnReader(on_turn), "", -1
            for _, text, spans in rows:
                reader.feed(text)
                for span in spans:
                    if carry and span["start"] != last_stop:
                        plain = unescape(carry)
                        loss.update(plain.encode())
                        loss_chars, carry = loss_chars + len(plain), ""
                    carry += text[span["start"] - at : span["stop"] - at]
                    last_stop = span["stop"]
                at += len(text)
            plain = unescape(carry)
            loss.update(plain.encode())
            out.append((conv_id, seen[0], turns.hexdigest(), loss_chars + len(plain), loss.hexdigest(), at))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    if not presorted:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(digest, DIGESTS)
