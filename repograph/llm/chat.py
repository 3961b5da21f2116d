"""Chat formatting with a small template compiler.

A template has text, ``{{ expression }}`` and the tags ``{% for m in messages %}``, ``{% if %}`` with
``elif`` and ``else``, and ``{% generation %}`` around what a model shall learn to write.  Expressions are
strings, numbers, names, ``m.role`` and ``m.text``, ``loop.first``, ``loop.last`` and ``loop.index0``, ``==``,
``!=``, ``and``, ``or``, ``not``, ``+``, parentheses and the filters ``escape``, ``trim``, ``upper``
and ``lower``.  There are no calls, no subscripts and no other attributes, so a template reaches nothing but
the turns.  A template is parsed into a tree, constants are folded, and the tree becomes Python
closures that yield the output piece by piece.

Turns are dealt by conversation, sorted, and rendered as they arrive, so a conversation is never held in
memory; its output comes in segments that end with a turn.  A conversation is one task's work, as is its
digest.

``escape`` puts a backslash into every control string of a text and doubles the text's own backslashes,
so ``unescape`` gives the text back and no text can fake a mark.

Turns are ordered by turn, then role and text; null texts and roles are empty.  Rows without a
conversation id form one conversation with a null id.  Repeated rows are repeated turns.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}<s>[INST] {{ m.role | escape }} [/INST] "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>\n{% endfor %}"
)
SEGMENT_CHARS = 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: f"{a}{b}",
    "and": lambda a, b: a and b, "or": lambda a, b: a or b}
FIELDS = {"loop": ("first", "last", "index0"), None: ("role", "text")}
TURN_END = None


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    children: tuple[Node, ...] = ()


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; the loosest operators first."""

    LEVELS = (("or",), ("and",), ("==", "!="), ("+",))
    TOKEN = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|(\w+(?:\.\w+)?)|(==|!=|[+|()]))")

    def __init__(self, source: str):
        self.tokens: list[str] = []
        at = 0
        while source[at:].strip():
            found = self.TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(found[0].strip())
            at = found.end()
        self.tokens.reverse()

    def whole(self) -> Node:
        node = self.level(0)
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[-1]!r}")
        return node

    def next_is(self, *wanted: str) -> str | None:
        return self.tokens.pop() if self.tokens and self.tokens[-1] in wanted else None

    def level(self, depth: int) -> Node:
        if depth == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[depth] == ("==", "!=") and self.next_is("not"):
            return Node("not", None, (self.level(depth),))
        left = self.level(depth + 1)
        while operator := self.next_is(*self.LEVELS[depth]):
            left = Node("operator", operator, (left, self.level(depth + 1)))
        return left

    def filtered(self) -> Node:
        node = self.single()
        while self.next_is("|"):
            name = self.tokens.pop() if self.tokens else ""
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = Node("filter", name, (node,))
        return node

    def single(self) -> Node:
        if self.next_is("("):
            node = self.level(0)
            if not self.next_is(")"):
                raise TemplateError("a parenthesis is open")
            return node
        token = self.tokens.pop() if self.tokens else ""
        if token[:1] in "'\"" and token:
            return Node("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1]))
        if token.isdigit():
            return Node("constant", int(token))
        owner, _, name = token.partition(".")
        if not name or name not in FIELDS["loop" if owner == "loop" else None]:
            raise TemplateError(f"unknown name {token!r}")
        return Node("field", (owner, name))


def parse(template: str) -> Node:
    """Syntax tree of a template."""

    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.DOTALL)
    parts.reverse()

    def block(*ends: str) -> tuple[Node, str]:
        children: list[Node] = []
        while parts:
            part = parts.pop()
            if part.startswith("{{") and part.endswith("}}"):
                children.append(Node("print", None, (_Expression(part[2:-2]).whole(),)))
            elif part.startswith("{%") and part.endswith("%}"):
                name, _, rest = part[2:-2].strip().partition(" ")
                if name in ends:
                    return Node("list", None, tuple(children)), part[2:-2].strip()
                children.append(tag(name, rest.strip()))
            elif part:
                children.append(Node("text", part))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return Node("list", None, tuple(children)), ""

    def condition(test: str) -> Node:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            other = condition(end[4:])
        elif end.startswith("else"):
            other, _ = block("endif")
        else:
            other = Node("list")
        return Node("if", None, (_Expression(test).whole(), then, other))

    def tag(name: str, rest: str) -> Node:
        if name == "if":
            return condition(rest)
        if name == "generation":
            return Node("generation", None, (block("endgeneration")[0],))
        loop = re.fullmatch(r"(\w+) in messages", rest)
        if name == "for" and loop and loop[1] != "loop":
            return Node("for", loop[1], (block("endfor")[0],))
        raise TemplateError(f"unknown tag {name!r} {rest!r}")

    return fold(block()[0])


def fold(node: Node) -> Node:
    """The tree with constant expressions and tests worked out and neighbouring texts joined."""

    children = tuple(map(fold, node.children))
    known = [c.value for c in children if c.kind == "constant"]
    if children and len(known) == len(children):
        if node.kind == "operator":
            return Node("constant", OPERATORS[node.value](*known))
        if node.kind == "filter":
            return Node("constant", FILTERS[node.value](str(known[0])))
        if node.kind == "not":
            return Node("constant", not known[0])
        if node.kind == "print":
            return Node("text", str(known[0]))
    if node.kind == "if" and children[0].kind == "constant":
        return children[1] if children[0].value else children[2]
    if node.kind == "list":
        flat = [d for c in children for d in (c.children if c.kind == "list" else (c,))]
        joined: list[Node] = []
        for kind, run in groupby(flat, lambda c: c.kind):
            joined += [Node("text", "".join(c.value for c in run))] if kind == "text" else run
        return Node("list", None, tuple(joined))
    return Node(node.kind, node.value, children)


def _evaluate(node: Node) -> Callable[[dict], object]:
    if node.kind == "constant":
        return lambda scope, value=node.value: value
    if node.kind == "field":
        owner, name = node.value

        def field(scope: dict) -> object:
            if owner not in scope:
                raise TemplateError(f"unknown name {owner!r}")
            return scope[owner][name]

        return field
    parts = [_evaluate(c) for c in node.children]
    if node.kind == "not":
        return lambda scope: not parts[0](scope)
    if node.kind == "filter":
        apply = FILTERS[node.value]
        return lambda scope: apply(str(parts[0](scope)))
    operate = OPERATORS[node.value]
    return lambda scope: operate(parts[0](scope), parts[1](scope))


Pieces = Iterator[tuple[object, bool]]


def generate(node: Node) -> Callable[[dict, bool], Pieces]:
    """A closure that yields (text, is generated) pieces, and ``TURN_END`` after each turn."""

    if node.kind == "text":
        return lambda scope, made, text=node.value: iter([(text, made)])
    if node.kind == "print":
        value = _evaluate(node.children[0])
        return lambda scope, made: iter([(str(value(scope)), made)])
    if node.kind == "if":
        test, then, other = _evaluate(node.children[0]), generate(node.children[1]), generate(node.children[2])
        return lambda scope, made: (then if test(scope) else other)(scope, made)
    if node.kind == "generation":
        inner = generate(node.children[0])
        return lambda scope, made: inner(scope, True)
    if node.kind == "for":
        body = generate(node.children[0])

        def repeat(scope: dict, made: bool) -> Pieces:
            messages = scope["messages"]
            message, index = next(messages, None), 0
            while message is not None:
                after = next(messages, None)
                place = {"first": index == 0, "last": after is None, "index0": index}
                yield from body({**scope, node.value: message, "loop": place}, made)
                yield TURN_END, made
                message, index = after, index + 1

        return repeat
    children = [generate(c) for c in node.children]

    def together(scope: dict, made: bool) -> Pieces:
        for child in children:
            yield from child(scope, made)

    return together


SEGMENTS = "conv_id long, segment int, text string, starts array<long>, stops array<long>"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _render(template: str):
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = generate(parse(template))
        rows: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, chars
            columns = list(zip(*rows, strict=True))
            rows, chars = [], 0
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ("conv_id", "segment", "text", "starts", "stops")
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        for conv_id, turns in groupby(_turns(batches), lambda t: t[0]):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            segment, length, texts, starts, stops = 0, 0, [], [], []
            for piece, made in write({"messages": messages}, False):
                if piece is TURN_END:
                    if length >= SEGMENT_CHARS:
                        rows.append((conv_id, segment, "".join(texts), starts, stops))
                        yield flush()
                        segment, length, texts, starts, stops = segment + 1, 0, [], [], []
                    continue
                if made and piece:
                    starts.append(length)
                    stops.append(length + len(piece))
                texts.append(piece)
                length += len(piece)
            rows.append((conv_id, segment, "".join(texts), starts, stops))
            chars += length
            if chars >= SEGMENT_CHARS:
                yield flush()
        if rows:
            yield flush()

    return render


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, segment, text, starts, stops): the formatted text and the spans to learn from.

    Takes conv_id, turn, role and text.  A conversation's segments follow each other in one partition;
    spans count code points from the start of their segment.
    """

    parse(template)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        _render(template), SEGMENTS)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def segments() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    rows = []
    for conv_id, run in groupby(segments(), lambda s: s[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = formatted = 0
        for _, _, text, starts, stops in run:
            formatted += len(text)
            for role, said in _TURN.findall(text):
                n_turns += 1
                turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            for start, stop in zip(starts, stops, strict=True):
                learnt = unescape(text[start:stop])
                loss_chars += len(learnt)
                loss.update(learnt.encode())
        rows.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted))
        if len(rows) >= 1000:
            yield _digest_rows(rows)
            rows = []
    if rows:
        yield _digest_rows(rows)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the output of ``format_conversations`` with the default template."""

    return formatted.mapInArrow(_digest, DIGESTS)
