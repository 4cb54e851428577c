"""Chat formatting: a small sandboxed template language, compiled to Python closures that stream conversations.

A template holds text, ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %} {% elif %} {% else %}``, ``{% set x = e %}``
and ``{% generation %} ... {% endgeneration %}`` around what a model should learn to write. Expressions have names,
string and number literals, true, false and none, fields of a mapping (``m.role``), ``==  !=  and  or  not  +`` and the
filters of FILTERS. There are no calls, no indexing and no attributes of Python objects, so a template reaches nothing
but the values that it is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Marks around a turn's role and text; their strings inside a text are escaped.
OPEN, MID, CLOSE = "[INST]", "[/INST]", "</s>"
TEMPLATE = (
    "{% for m in messages %}" + OPEN + "{{ m.role | escape }}" + MID + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + CLOSE + "{% endfor %}"
)
#: Characters of a part, about; a turn's piece is never split, so a part is as long as the longest piece at least.
PART = 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, ("\\", OPEN, MID, CLOSE))))


def escape(text: str) -> str:
    """Doubles each backslash and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """What escape() was given: a backslash stands for the character after it."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template isn't in the language, or it asks for what it isn't given."""


# --- syntax tree: tuples (kind, ...) ---------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.|+()=]))")
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in", *_CONSTANTS}


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while source[at:].strip():
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"can't read {source[at:].strip()!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return found


class _Expression:
    """Reads one expression from tokens, from the loosest binding to the tightest."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.left = tokens

    def take(self, *values: str) -> str | None:
        if self.left and self.left[0][1] in values and self.left[0][0] in ("name", "sign"):
            return self.left.pop(0)[1]
        return None

    def chain(self, below: Callable[[], tuple], *signs: str) -> tuple:
        node = below()
        while sign := self.take(*signs):
            node = (sign, node, below())
        return node

    def whole(self) -> tuple:
        node = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r}")
        return node

    def either(self) -> tuple:
        return self.chain(lambda: self.chain(self.negated, "and"), "or")

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.chain(lambda: self.chain(self.filtered, "+"), "==", "!=")

    def filtered(self) -> tuple:
        node = self.single()
        while self.take("|"):
            kind, name = self.left.pop(0) if self.left else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def single(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return node
        kind, value = self.left.pop(0) if self.left else ("", "")
        if kind == "text":
            return ("constant", value[1:-1])
        if kind == "number":
            return ("constant", float(value) if "." in value else int(value))
        if kind != "name" or value in _WORDS - _CONSTANTS.keys():
            raise TemplateError(f"unexpected {value!r}")
        node = ("constant", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        while self.take("."):
            kind, field = self.left.pop(0) if self.left else ("", "")
            if kind != "name":
                raise TemplateError("a field's name is missing")
            node = ("field", node, field)
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        parts += [("text", source[at : m.start()])] * (m.start() > at)
        parts.append(("show", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", source[at:])] * (len(source) > at)
    if any("{{" in x[1] or "{%" in x[1] for x in parts if x[0] == "text"):
        raise TemplateError("a tag is open")
    node, end = _block(parts, ())
    return node


def _block(parts: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[tuple, str]:
    """The nodes up to one of the ending tags, which it returns too."""
    found = []
    while parts:
        kind, body = parts.pop(0)
        word, _, rest = body.partition(" ")
        if kind == "text":
            found.append(("text", body))
        elif kind == "show":
            found.append(("show", _Expression(_tokens(body)).whole()))
        elif word in ends:
            return ("block", *found), body
        elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            inner, _ = _block(parts, ("endfor",))
            found.append(("for", m[1], _Expression(_tokens(m[2])).whole(), inner))
        elif word == "if":
            found.append(_branch(parts, rest))
        elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)):
            found.append(("set", m[1], _Expression(_tokens(m[2])).whole()))
        elif word == "generation":
            found.append(("generation", _block(parts, ("endgeneration",))[0]))
        else:
            raise TemplateError(f"no tag {body!r} here")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return ("block", *found), ""


def _branch(parts: list[tuple[str, str]], condition: str) -> tuple:
    then, end = _block(parts, ("elif", "else", "endif"))
    test = _Expression(_tokens(condition)).whole()
    if end.startswith("elif"):
        return ("if", test, then, ("block", _branch(parts, end[4:])))
    return ("if", test, then, _block(parts, ("endif",))[0] if end == "else" else ("block",))


# --- folding ---------------------------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else str(value)


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _text(a) + _text(b),
}


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions computed, decided branches taken and neighbouring texts joined."""
    kind = node[0]
    if kind in _OPERATORS or kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "constant" and kind in ("and", "or"):
            return b if bool(a[1]) == (kind == "and") else a
        return ("constant", _OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "constant" else (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("constant", not a[1]) if a[0] == "constant" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("constant", FILTERS[node[1]](_text(a[1]))) if a[0] == "constant" else ("filter", node[1], a)
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "show":
        a = fold(node[1])
        return ("text", _text(a[1])) if a[0] == "constant" else ("show", a)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        a = fold(node[1])
        return fold(node[2] if a[1] else node[3]) if a[0] == "constant" else ("if", a, fold(node[2]), fold(node[3]))
    if kind == "block":
        found: list[tuple] = []
        for x in map(fold, node[1:]):
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and found and found[-1][0] == "text":
                    found[-1] = ("text", found[-1][1] + y[1])
                elif y != ("text", ""):
                    found.append(y)
        return ("block", *found)
    return node


# --- closures --------------------------------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "constant":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k)
    if kind == "field":
        of, key = _value(node[1]), node[2]
        return lambda env: x.get(key) if isinstance(x := of(env), dict) else None
    if kind == "filter":
        f, of = FILTERS[node[1]], _value(node[2])
        return lambda env: f(_text(of(env)))
    if kind == "not":
        of = _value(node[1])
        return lambda env: not of(env)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    f = _OPERATORS[kind]
    return lambda env: f(a(env), b(env))


def _writer(node: tuple, learned: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda env, x=(node[1], learned): iter((x,))
    if kind == "show":
        of = _value(node[1])
        return lambda env: iter(((_text(of(env)), learned),))
    if kind == "generation":
        return _writer(node[1], True)
    if kind == "set":
        of = _value(node[2])

        def put(env: dict) -> Iterator[Piece]:
            env[node[1]] = of(env)
            return iter(())

        return put
    if kind == "if":
        test, then, other = _value(node[1]), _writer(node[2], learned), _writer(node[3], learned)
        return lambda env: then(env) if test(env) else other(env)
    if kind == "for":
        of, inner = _value(node[2]), _writer(node[3], learned)

        def loop(env: dict) -> Iterator[Piece]:
            """Reads one item ahead, so that loop.last is known; items may come from an iterator."""
            items = iter(of(env) or ())
            item, index = next(items, loop), 0
            while item is not loop:
                after = next(items, loop)
                index += 1
                yield from inner(env | {node[1]: item, "loop": {"index": index, "first": index == 1, "last": after is loop}})
                item = after

        return loop
    inners = [_writer(x, learned) for x in node[1:]]

    def block(env: dict) -> Iterator[Piece]:
        for f in inners:
            yield from f(env)

    return block


def compiled(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from values to the pieces of the formatted text, each with whether it is under a generation marker."""
    write = _writer(fold(parse(source)))
    return lambda values: write(dict(values))


# --- Spark -----------------------------------------------------------------------------------------------------------

PARTS = "conv_id long, part long, text string, generated boolean"
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("generated", pa.bool_())])


def format_parts(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Renders conversations(conv_id, turn, role, text) with a template; other columns are ignored.

    Returns conv_id, part, text and generated: the formatted text of a conversation is the text of its parts, in order,
    and generated says whether a part is under a generation marker. Turns go by turn, then role and text where turns tie;
    repeated rows count as often as they come. Null roles and texts count as empty; rows without conv_id are one
    conversation; an empty table gives no parts. A conversation is streamed from its sorted rows in one task, holding a turn or two, so its length is
    not bounded by memory; conversations are never in one task for lack of a key.
    """
    write = compiled(template)

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for conv_id, turns in groupby(messages(batches), key=lambda r: r[0]):
            part = 0
            pieces = write({"messages": ({"turn": r[1], "role": r[2] or "", "text": r[3] or ""} for r in turns)})
            for generated, same in groupby(pieces, key=lambda p: p[1]):
                held: list[str] = []
                for text, _ in same:
                    held.append(text)
                    size += len(text)
                    if size >= PART:
                        rows.append((conv_id, part, "".join(held), generated))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)
                        rows, held, size, part = [], [], 0, part + 1
                if held:
                    rows.append((conv_id, part, "".join(held), generated))
                    part += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)

    turns = conversations.selectExpr("CAST(conv_id AS long) conv_id", "CAST(turn AS long) turn", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


def _read_back(parts: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
    """Turns of a formatted text: role, text, and what of the text is under the mask, all unescaped."""
    text, mask = "", []
    for piece, generated in parts:
        mask += [(len(text), len(text) + len(piece))] * generated
        text += piece
        at = 0
        while (end := text.find(CLOSE, at)) >= 0:
            middle = text.index(MID, at)
            if not text.startswith(OPEN, at):
                raise ValueError("a turn doesn't begin with its mark")
            learned = "".join(text[max(a, at) : min(b, end)] for a, b in mask if a < end and b > at)
            yield unescape(text[at + len(OPEN) : middle]), unescape(text[middle + len(MID) : end]), unescape(learned)
            at = end + len(CLOSE)
        text, mask = text[at:], [(max(a - at, 0), b - at) for a, b in mask if b > at]
    if text:
        raise ValueError("the last turn has no end")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame, gathered: bool = False) -> DataFrame:
    """What can be read back from the parts of format_parts() with the standard template, one row per conversation.

    Returns conv_id, n_turns, turns_sha256 (over role, newline, text, newline of each turn), loss_chars and loss_sha256
    (over all text under the mask), formatted_chars. Lengths are in code points and texts are unescaped, but for
    formatted_chars. Parts without conv_id are one conversation; no parts give no rows. gathered says that parts come
    straight from format_parts(), where those of a conversation lie together and in order; else, as when they were stored,
    they are gathered and sorted first. A conversation is streamed, so memory is bounded by its longest turn.
    """
    if not gathered:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[0], r[2], r[3]) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = []
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def counted(own=own):
                nonlocal chars
                for _, text, generated in own:
                    chars += len(text)
                    yield text, generated

            for role, text, mine in _read_back(counted()):
                n += 1
                learned += len(mine)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(mine.encode())
            found.append((conv_id, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=schema)

    names = [x.split()[0] for x in DIGEST.split(", ")]
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in DIGEST.split(", ")])
    return parts.mapInArrow(run, DIGEST)


def digest_sql() -> str:
    """The digests of conversations and conversation -7 for DuckDB."""
    marks = len(OPEN + MID + CLOSE)
    grown = " + ".join([f"(length({{x}}) - length(replace({{x}}, '{c}', ''))) // {len(c)}" for c in ("\\", OPEN, MID, CLOSE)])
    sure = f"</s>{OPEN} ok {MID}"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{sure}'), (-7, 1, 'assistant', '{sure}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length(role) + length(text) + {grown.format(x="role")} + {grown.format(x="text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
