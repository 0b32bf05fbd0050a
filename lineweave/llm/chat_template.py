"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}``, ``{% for x in list %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}``,
``{% generation %}`` (what it wraps is under the loss mask) and ``{# comments #}``. It is parsed into a syntax tree, whose
constant parts are folded, and the tree becomes Python closures that render a conversation. A template can reach nothing
but the turns that it is given: it has no calls, an attribute is a key of a turn or of ``loop``, filters are the four of
FILTERS, and nothing is evaluated as Python.

Conversations are rendered as streams: the turns of a conversation come in order from Spark's sort, closures yield pieces
of text while they read them, and pieces go out as rows. So a conversation that holds a third of all rows takes the
memory of two turns.

Texts are escaped by the template's own filters, reversibly: a backslash goes before each backslash, before a number sign that
follows another and before a slash that follows ``<``, so that no text can hold a mark of the template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import pick

#: A turn is "### role: text</turn>" and a line end; what assistants say is learned.
TEMPLATE = (
    "{# one line of marks for each turn #}{% for turn in turns %}{{ '#' + '##' }} {{ turn.role | label }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
#: A conversation's text goes out in pieces of at least so many characters, but for the last.
PIECE_CHARS = 1 << 16
BATCH_ROWS = 512
#: Nesting of blocks and of expressions in a template.
DEEPEST = 50

_RISKY, _RISKY_LABEL, _SLASHED = re.compile(r"\\|(?<=#)#|(?<=<)/"), re.compile(r"\\|(?<=#)#|(?<=<)/|:"), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _RISKY.sub(r"\\\g<0>", text)


def label(text: str) -> str:
    """escape() that also marks colons, for what stands before one."""
    return _RISKY_LABEL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _SLASHED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "label": label, "trim": str.strip, "upper": str.upper}


class TemplateError(ValueError):
    """A template that can't be parsed, or that asks a turn for what it doesn't have."""


# The syntax tree. Expressions: Const, Name, Get, Filter, Binary, Not; statements: Text, Show, For, If, Generation.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: str


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Show:
    of: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    ways: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()]))", re.S)


def _tokens(code: str) -> list[tuple[str, object]]:
    found, at, code = [], 0, code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"not understood: {code[at : at + 20]!r}")
        text, number, name, sign = m.groups()
        found.append(("const", _SLASHED.sub(lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1])) if text else ("const", int(number)) if number else ("word", name) if name else ("sign", sign))
        at = m.end()
    return found


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters and attributes, from loose to tight."""

    def __init__(self, code: str) -> None:
        self.left, self.deep = _tokens(code), 0

    def take(self, *wanted: tuple[str, object]) -> object | None:
        return self.left.pop(0)[1] if self.left and self.left[0] in wanted else None

    def whole(self) -> object:
        tree = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r}")
        return tree

    def either(self) -> object:
        tree = self.both()
        while self.take(("word", "or")):
            tree = Binary("or", tree, self.both())
        return tree

    def both(self) -> object:
        tree = self.negated()
        while self.take(("word", "and")):
            tree = Binary("and", tree, self.negated())
        return tree

    def negated(self) -> object:
        self.deep += 1
        if self.deep > DEEPEST:
            raise TemplateError("an expression is nested too deeply")
        tree = Not(self.negated()) if self.take(("word", "not")) else self.compared()
        self.deep -= 1
        return tree

    def compared(self) -> object:
        tree = self.sum()
        op = self.take(("sign", "=="), ("sign", "!="))
        return Binary(op, tree, self.sum()) if op else tree

    def sum(self) -> object:
        tree = self.filtered()
        while self.take(("sign", "+")):
            tree = Binary("+", tree, self.filtered())
        return tree

    def filtered(self) -> object:
        tree = self.atom()
        while op := self.take(("sign", "."), ("sign", "|")):
            kind, name = self.left.pop(0) if self.left else ("end", "the end")
            if kind != "word" or name.startswith("_") or op == "|" and name not in FILTERS:
                raise TemplateError(f"no {'filter' if op == '|' else 'attribute'} {name!r}")
            tree = Filter(tree, name) if op == "|" else Get(tree, name)
        return tree

    def atom(self) -> object:
        kind, value = self.left.pop(0) if self.left else ("end", "the end")
        if kind == "const":
            return Const(value)
        if kind == "word" and value not in ("or", "and", "not", "in"):
            return Const({"true": True, "false": False}[value]) if value in ("true", "false") else Name(value)
        if (kind, value) == ("sign", "("):
            tree = self.either()
            if self.take(("sign", ")")):
                return tree
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The statements of a template."""
    parts, at = [], 0
    for m in _PARTS.finditer(template):
        parts += [("text", template[at : m.start()])] * (m.start() > at) + [("show", m[1])] * (m[1] is not None) + [("tag", m[2])] * (m[2] is not None)
        at = m.end()
    parts = (parts + [("text", template[at:])] * (at < len(template)))[::-1]

    def block(ends: tuple[str, ...], deep: int) -> tuple[tuple, str]:
        """Statements to the first of the tags ``ends``, and that tag."""
        if deep > DEEPEST:
            raise TemplateError("blocks are nested too deeply")
        body: list = []
        while parts:
            kind, code = parts.pop()
            if kind != "tag":
                body.append(Text(code) if kind == "text" else Show(_Expression(code).whole()))
                continue
            word, _, rest = code.strip().partition(" ")
            if word in ends:
                return tuple(body), code.strip()
            if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                body.append(For(m[1], _Expression(m[2]).whole(), block(("endfor",), deep + 1)[0]))
            elif word == "generation" and not rest:
                body.append(Generation(block(("endgeneration",), deep + 1)[0]))
            elif word == "if":
                ways, other, end = [], (), code.strip()
                while end.split(" ")[0] in ("if", "elif"):
                    condition = _Expression(end.partition(" ")[2]).whole()
                    inner, end = block(("elif", "else", "endif"), deep + 1)
                    ways.append((condition, inner))
                if end == "else":
                    other = block(("endif",), deep + 1)[0]
                body.append(If(tuple(ways), other))
            else:
                raise TemplateError(f"unexpected tag {code.strip()!r}")
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return tuple(body), ""

    return block((), 0)[0]


def _text(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, str | int):
        raise TemplateError(f"only texts and numbers can be shown, not {type(value).__name__}")
    return str(value)


_APPLY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)}


def folded(tree: object) -> object:
    """The tree with constant parts computed: expressions of constants, conditions that are known, neighbouring texts."""
    match tree:
        case tuple():
            out: list = []
            for x in map(folded, tree):
                for y in x if isinstance(x, tuple) else (x,):
                    if isinstance(y, Text) and out and isinstance(out[-1], Text):
                        out[-1] = Text(out[-1].text + y.text)
                    elif y != Text(""):
                        out.append(y)
            return tuple(out)
        case Get(of, key):
            return Get(folded(of), key)
        case Filter(of, name):
            of = folded(of)
            return Const(FILTERS[name](_text(of.value))) if isinstance(of, Const) else Filter(of, name)
        case Not(of):
            of = folded(of)
            return Const(not of.value) if isinstance(of, Const) else Not(of)
        case Binary(op, left, right):
            left, right = folded(left), folded(right)
            if op in ("and", "or"):
                return (right if bool(left.value) == (op == "and") else left) if isinstance(left, Const) else Binary(op, left, right)
            return Const(_APPLY[op](left.value, right.value)) if isinstance(left, Const) and isinstance(right, Const) else Binary(op, left, right)
        case Show(of):
            of = folded(of)
            return Text(_text(of.value)) if isinstance(of, Const) else Show(of)
        case For(name, over, body):
            return For(name, folded(over), folded(body))
        case Generation(body):
            return Generation(folded(body))
        case If(ways, other):
            left = []
            for condition, body in ways:
                condition = folded(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                if isinstance(condition, Const):
                    return If(tuple(left), folded(body)) if left else folded(body)
                left.append((condition, folded(body)))
            return If(tuple(left), folded(other)) if left else folded(other)
    return tree


class _Mark:
    """The begin or the end of what is under the loss mask, among pieces of text."""


BEGIN, END = _Mark(), _Mark()
Scope = dict[str, object]


def _value(tree: object) -> Callable[[Scope], object]:
    """A closure that computes an expression."""
    match tree:
        case Const(value):
            return lambda scope: value
        case Name(name):

            def named(scope: Scope) -> object:
                if name not in scope:
                    raise TemplateError(f"no name {name!r}")
                return scope[name]

            return named
        case Get(of, key):
            of = _value(of)

            def got(scope: Scope) -> object:
                record = of(scope)
                if not isinstance(record, dict) or key not in record:
                    raise TemplateError(f"no attribute {key!r}")
                return record[key]

            return got
        case Filter(of, name):
            of, how = _value(of), FILTERS[name]
            return lambda scope: how(_text(of(scope)))
        case Not(of):
            of = _value(of)
            return lambda scope: not of(scope)
        case Binary("and", left, right):
            left, right = _value(left), _value(right)
            return lambda scope: left(scope) and right(scope)
        case Binary("or", left, right):
            left, right = _value(left), _value(right)
            return lambda scope: left(scope) or right(scope)
        case Binary(op, left, right):
            left, right, how = _value(left), _value(right), _APPLY[op]
            return lambda scope: how(left(scope), right(scope))
    raise TemplateError(f"not an expression: {tree!r}")


Render = Callable[[Scope], Iterator[str | _Mark]]


def _render(tree: object) -> Render:
    """A closure that yields the pieces of a statement, or of several."""
    match tree:
        case tuple():
            parts = [_render(x) for x in tree]

            def all_of(scope: Scope) -> Iterator[str | _Mark]:
                for part in parts:
                    yield from part(scope)

            return parts[0] if len(parts) == 1 else all_of
        case Text(text):
            return lambda scope: iter((text,))
        case Show(of):
            of = _value(of)
            return lambda scope: iter((_text(of(scope)),))
        case Generation(body):
            body = _render(body)

            def learned(scope: Scope) -> Iterator[str | _Mark]:
                yield BEGIN
                yield from body(scope)
                yield END

            return learned
        case If(ways, other):
            ways, other = [(_value(c), _render(b)) for c, b in ways], _render(other)
            return lambda scope: next((body for condition, body in ways if condition(scope)), other)(scope)
        case For(name, over, body):
            over, body = _value(over), _render(body)

            def each(scope: Scope) -> Iterator[str | _Mark]:
                items, nothing = iter(over(scope)), object()
                item, index = next(items, nothing), 0
                while item is not nothing:
                    after = next(items, nothing)  # one turn ahead tells the last one
                    loop = {"index": index + 1, "first": index == 0, "last": after is nothing}
                    yield from body({**scope, name: item, "loop": loop})
                    item, index = after, index + 1

            return each
    raise TemplateError(f"not a statement: {tree!r}")


def compiled(template: str) -> Render:
    """A closure that renders {"turns": an iterable of turns} into pieces of text and marks."""
    return _render(folded(parse(template)))


# Formatting and reading back, as streams over conversations that lie together in a partition.
PIECES = "conv_id long, made boolean, piece long, formatted string, start long, spans array<struct<start: long, end: long>>"


def _pieces(events: Iterator[str | _Mark], piece_chars: int) -> Iterator[tuple[int, str, int, list[dict]]]:
    """piece, text, start and spans: places count characters of the whole conversation; a span that goes on is cut at a piece's end."""
    texts: list[str] = []
    number = start = size = 0
    spans: list[dict] = []
    open_at: int | None = None
    for x in events:
        if x is BEGIN or x is END:
            if (x is BEGIN) == (open_at is not None):
                raise TemplateError("generation blocks can't be nested")
            if x is END and open_at < start + size:
                spans.append({"start": open_at, "end": start + size})
            open_at = start + size if x is BEGIN else None
            continue
        texts.append(x)
        size += len(x)
        if size >= piece_chars:
            if open_at is not None:
                spans.append({"start": open_at, "end": start + size})
                open_at = start + size
            yield number, "".join(texts), start, spans
            texts, number, start, size, spans = [], number + 1, start + size, 0, []
    if size or not number:
        yield number, "".join(texts), start, spans


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of so many rows or characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) if len(row) > 3 and isinstance(row[3], str) else 0
        if len(held) >= BATCH_ROWS or size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PIECES = pa.schema([("conv_id", pa.int64()), ("made", pa.bool_()), ("piece", pa.int64()), ("formatted", pa.string()), ("start", pa.int64()), ("spans", _SPAN)])


def format_turns(conversations: DataFrame, template: str = TEMPLATE, made: Column | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, made, piece, formatted, start, spans: the formatted conversations in pieces, in order within a partition.

    Rows of a conversation go by turn, null first, equal turns by role and text; null texts and roles are empty ones. Null ids
    are one conversation. Repeated rows are turns of their own. ``made`` parts conversations of equal ids
    (given rows from added ones). An empty table gives no rows; long texts are formatted whole.
    """
    compiled(template)  # a wrong template fails here; tasks compile it again, as closures aren't sent
    rows = pick(conversations, "conv_id", "turn", "role", "text") if made is None else pick(conversations, "conv_id", "turn", "role", "text", "made")
    rows = rows.withColumn("made", F.lit(False) if made is None else made).select("conv_id", "made", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        turns = ((c, m, {"role": r, "text": t}) for b in batches for c, m, r, t in zip(*[b.column(n).to_pylist() for n in ("conv_id", "made", "role", "text")], strict=True))
        out = ((*key, *piece) for key, group in groupby(turns, key=lambda x: x[:2]) for piece in _pieces(render({"turns": (t for _, _, t in group)}), piece_chars))
        yield from _batches(out, _PIECES)

    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "made", "turn", "role", "text")
    return together.select("conv_id", "made", "role", "text").mapInArrow(run, PIECES)


_HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)
_CLOSE = "</turn>\n"


@dataclass
class _Reading:
    """What is read of one conversation so far; ``left`` is the begin of a turn whose end is still to come."""

    left: list[str] = field(default_factory=list)
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    of_turns: object = field(default_factory=hashlib.sha256)
    of_loss: object = field(default_factory=hashlib.sha256)

    def piece(self, text: str, start: int, spans: list[dict]) -> None:
        if start != self.chars:
            raise ValueError("pieces are missing or out of order")
        for span in spans:
            said = unescape(text[span["start"] - start : span["end"] - start])
            self.loss_chars += len(said)
            self.of_loss.update(said.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        # Only the last characters held can be the begin of a mark that ends in this piece.
        held = self.left[-1][-len(_CLOSE) :] if self.left else ""
        if _CLOSE not in held + text:
            self.left.append(text)
            return
        text, at = "".join([*self.left, text]), 0
        while (end := text.find(_CLOSE, at)) >= 0:
            head = _HEAD.match(text, at)
            if not head or head.end() > end:
                raise ValueError("a turn without its mark")
            turn = f"{unescape(head[1])}\n{unescape(text[head.end() : end])}\n"
            self.turns += 1
            self.of_turns.update(turn.encode("utf-8", "surrogatepass"))
            at = end + len(_CLOSE)
        self.left = [text[at:]] if at < len(text) else []

    def result(self) -> tuple:
        if self.left:
            raise ValueError("a turn without an end")
        return self.turns, self.of_turns.hexdigest(), self.loss_chars, self.of_loss.hexdigest(), self.chars


READ = "conv_id long, made boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([("conv_id", pa.int64()), ("made", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, made, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from what format_turns() gave with TEMPLATE.

    ``in_order``: the pieces come straight from format_turns(); pieces that were stored are brought together and sorted first.
    A conversation whose pieces are missing or broken raises. No pieces give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())

        def read() -> Iterator[tuple]:
            for key, group in groupby(rows, key=lambda r: (r["conv_id"], r["made"])):
                reading = _Reading()
                for r in group:
                    reading.piece(r["formatted"], r["start"], r["spans"])
                yield (*key, *reading.result())

        yield from _batches(read(), _READ)

    together = pieces if in_order else pieces.repartition("conv_id").sortWithinPartitions("conv_id", "made", "piece")
    return together.mapInArrow(run, READ)


#: The conversation that is added: texts that look like the template's own marks.
TRIAL_ID, TRIAL_ROLES, TRIAL_TEXT = -7, ("user", "assistant"), r"\### Assistant: </turn> ok"


def with_trial(conversations: DataFrame) -> DataFrame:
    """The conversations and the added one (``made`` true), which stays apart from a given one of the same id."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.lit(False).alias("made"))
    trial = rows.sparkSession.createDataFrame([(TRIAL_ID, k, role, TRIAL_TEXT, True) for k, role in enumerate(TRIAL_ROLES)], rows.schema)
    return rows.unionByName(trial)


def digests(conversations: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: each conversation, and the added one, formatted and read back."""
    return read_back(format_turns(with_trial(conversations), TEMPLATE, F.col("made"), piece_chars), in_order=True).drop("made")
