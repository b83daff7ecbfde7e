"""Chat formatting by a small template language, and reading the result back.

A template is text with ``{{ expression }}``, ``{% for x in y %} {% endfor %}``,
``{% if e %} {% else %} {% endif %}`` and ``{% generation %} {% endgeneration %}``
around what a model is to learn. Expressions know string literals, names, one
level of fields (``m.role``), ``+ == != and or not``, brackets and the filters in
``FILTERS``. Nothing else can be named or called, so a template reaches only the
values it is given.

``compile_template`` parses to a tree, folds constants (joined literals, filters of
literals, decided branches) and makes one Python closure per node; rendering calls
closures that yield ``(piece, generated)``. Conversations are rendered as streams
over rows sorted by conversation and turn, and written in parts of whole turns, so
a conversation of any length needs the memory of one part.

Null texts and roles are empty. Rows are ordered by turn (null first), then role,
then text, so repeated turns have a defined order. A null conversation id is a
conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixweave.llm.arrow import Output, rows

TURN_END = "</turn>"
TURN_START = "### "
TEMPLATE = (
    "{% for m in messages %}{{ '### ' }}{{ m.role | role }}{{ ':' + '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' + '\n' }}{% endfor %}"
)
# Characters after which a part ends at the next turn.
PART = 1 << 16

_CONTROL = re.compile(r"\\|</turn>|### ")
_CONTROL_ROLE = re.compile(r"[\\:\n]|</turn>|### ")
_ESCAPED = re.compile(r"\\(.)", re.S)


def _broken(match: re.Match) -> str:
    """A single character gets a backslash in front, a control string one inside."""
    found = match.group()
    return "\\" + found if len(found) == 1 else found[0] + "\\" + found[1:]


def escape(text: str) -> str:
    """Text in which no control string stands; ``unescape`` gives it back."""
    return _CONTROL.sub(_broken, text)


def escape_role(role: str) -> str:
    return _CONTROL_ROLE.sub(_broken, role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}


class TemplateError(ValueError):
    """The template cannot be read, or names something that is not there."""


# ---- parsing: nodes are tuples whose first member is their kind -----------------------
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[+|().]))", re.S)
_WORDS = {"and", "or", "not"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            kind = "text" if match[1] else "word" if match[2] in _WORDS else "name" if match[2] else "sign"
            self.tokens.append((kind, match.group().strip()))
            at = match.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") and self.tokens[self.at][1] in values:
            self.at += 1
            return values[0] if len(values) == 1 else self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"not expected: {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.take("not"):
            return ("not", self.negated())
        node = self.joined()
        while sign := self.take("==", "!="):
            node = (sign, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.value()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            node = ("filter", name, node)
        return node

    def value(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is missing")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            self.at += 1
            body = self.tokens[self.at - 1][1][1:-1]
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body, flags=re.S))
        node = ("name", self.name())
        if self.take("."):
            node = ("field", node, self.name())
        return node


def _is_truth(node: tuple) -> bool:
    """Whether an expression may come to true or false instead of a text."""
    if node[0] in ("and", "or"):
        return any(map(_is_truth, node[1:]))
    return node[0] in ("==", "!=", "not")


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    root: list = []
    open_: list[tuple[str, tuple, list]] = [("", (), root)]
    at = 0

    def close(kind: str) -> tuple:
        if open_[-1][0] != kind:
            raise TemplateError(f"end{kind} without {kind}")
        return open_.pop()

    for tag in _TAG.finditer(source):
        if tag.start() > at:
            open_[-1][2].append(("const", source[at:tag.start()]))
        at = tag.end()
        body = open_[-1][2]
        if tag[1] is not None:
            shown = _Expression(tag[1]).whole()
            if _is_truth(shown):
                raise TemplateError(f"no text to show: {tag[1].strip()!r}")
            body.append(shown)
            continue
        word, _, rest = tag[2].strip().partition(" ")
        if word == "for":
            match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)\s*", rest)
            if not match:
                raise TemplateError("for needs: for x in y")
            open_.append(("for", (match[1], match[2]), []))
        elif word == "if":
            open_.append(("if", (_Expression(rest).whole(),), []))
        elif word == "else":
            _, head, then = close("if")
            if len(head) == 2:
                raise TemplateError("a second else")
            open_.append(("if", (*head, then), []))
        elif word == "endif":
            _, head, last = close("if")
            then, other = (head[1], last) if len(head) == 2 else (last, [])
            open_[-1][2].append(("if", head[0], ("all", then), ("all", other)))
        elif word == "endfor":
            _, head, inside = close("for")
            open_[-1][2].append(("for", *head, ("all", inside)))
        elif word == "generation":
            open_.append(("generation", (), []))
        elif word == "endgeneration":
            inside = close("generation")[2]
            open_[-1][2].append(("generation", ("all", inside)))
        else:
            raise TemplateError(f"no such statement: {word!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not closed")
    if at < len(source):
        root.append(("const", source[at:]))
    return ("all", root)


def fold(node: tuple) -> tuple:
    """The same tree with everything worked out that does not depend on the values."""
    kind = node[0]
    if kind == "all":
        out: list[tuple] = []
        for part in map(fold, node[1]):
            parts = part[1] if part[0] == "all" else [part]
            for p in parts:
                if p[0] == "const" and out and out[-1][0] == "const":
                    out[-1] = ("const", out[-1][1] + p[1])
                elif p != ("const", ""):
                    out.append(p)
        return out[0] if len(out) == 1 else ("all", out)
    if kind == "if":
        test, then, other = map(fold, node[1:])
        if test[0] == "const":
            return then if test[1] else other
        return ("if", test, then, other)
    if kind == "for":
        return (*node[:3], fold(node[3]))
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "field":
        return node
    parts = [fold(p) for p in node[1:]]
    if kind != "generation" and all(p[0] == "const" for p in parts):
        return ("const", _operate(kind, *[p[1] for p in parts]))
    return (kind, *parts)


def _operate(kind: str, left, right=None):
    if kind == "+":
        return left + right
    if kind == "==":
        return left == right
    if kind == "!=":
        return left != right
    return (not left) if kind == "not" else (left and right) if kind == "and" else (left or right)


# ---- closures ------------------------------------------------------------------------------
def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: _known(env, name)
    if kind == "field":
        return lambda env, inner=_value(node[1]), name=node[2]: _known(inner(env), name)
    if kind == "filter":
        return lambda env, run=FILTERS[node[1]], inner=_value(node[2]): run(inner(env))
    if kind == "not":
        return lambda env, inner=_value(node[1]): not inner(env)
    left, right = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    return lambda env: _operate(kind, left(env), right(env))


def _known(values, name: str):
    if not isinstance(values, dict) or name not in values:
        raise TemplateError(f"not known: {name}")
    return values[name]


Pieces = Iterator[tuple[str, bool]]


def _renderer(node: tuple, generated: bool = False) -> Callable[[dict], Pieces]:
    kind = node[0]
    if kind == "all":
        parts = [_renderer(p, generated) for p in node[1]]

        def every(env):
            for part in parts:
                yield from part(env)

        return every
    if kind == "for":
        variable, over, body = node[1], node[2], _renderer(node[3], generated)

        def loop(env):
            for item in _known(env, over):
                yield from body({**env, variable: item})

        return loop
    if kind == "if":
        test, then, other = _value(node[1]), _renderer(node[2], generated), _renderer(node[3], generated)
        return lambda env: then(env) if test(env) else other(env)
    if kind == "generation":
        return _renderer(node[1], True)
    value = _value(node)

    def one(env):
        yield value(env), generated

    return one


def compile_template(source: str) -> Callable[[dict], Pieces]:
    return _renderer(fold(parse(source)))


# ---- conversations in Spark -----------------------------------------------------------------
_PARTS = "conv_id long, part long, content string, starts array<long>, ends array<long>"


class _Parts:
    """Joins pieces to parts that end with a turn, with the generated ranges of each part."""

    def __init__(self):
        self.pieces, self.length, self.starts, self.ends = [], 0, [], []

    def add(self, piece: str, generated: bool) -> None:
        if generated:
            self.starts.append(self.length)
            self.ends.append(self.length + len(piece))
        self.pieces.append(piece)
        self.length += len(piece)

    def whole(self) -> bool:
        return self.length >= PART and self.pieces[-1].endswith(TURN_END + "\n")

    def take(self) -> tuple:
        out = ("".join(self.pieces), self.starts, self.ends)
        self.__init__()
        return out


def _format(template: str):
    def run(batches):
        render, out = compile_template(template), Output(_PARTS, 64)
        stream = rows(batches, "conv_id", "role", "text")
        ahead = next(stream, None)
        while ahead is not None:
            conv_id, part, parts = ahead[0], 0, _Parts()

            def turns():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv_id:
                    yield {"role": ahead[1] or "", "text": ahead[2] or ""}
                    ahead = next(stream, None)

            messages = turns()
            for piece, generated in render({"messages": messages}):
                parts.add(piece, generated)
                if parts.whole():
                    yield from out.add(conv_id, part, *parts.take())
                    part += 1
            for _ in messages:  # a template that leaves turns out
                pass
            if parts.pieces or not part:
                yield from out.add(conv_id, part, *parts.take())
        yield from out.flush()

    return run


def format_conversations(
    df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Formatted conversations in parts: ``conv_id``, ``part``, ``content``, and the generated ranges in it.

    Parts of a conversation come next to each other and in order.
    """
    compile_template(template)
    plain = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(template), _PARTS)


_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n(.*?)</turn>\n", re.S)


def turns_of(content: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a part made with ``TEMPLATE``."""
    at = 0
    while at < len(content):
        turn = _TURN.match(content, at)
        if not turn:
            raise ValueError(f"not a turn: {content[at:at + 40]!r}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    out, last, state = Output(_READ), object(), None
    for conv_id, content, starts, ends in rows(batches, "conv_id", "content", "starts", "ends"):
        if conv_id != last or state is None:
            if state is not None:
                yield from out.add(last, *_read_row(state))
            last, state = conv_id, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "learnt": 0, "chars": 0}
        for role, text in turns_of(content):
            state["turns"] += 1
            state["all"].update(f"{role}\n{text}\n".encode())
        for start, end in zip(starts, ends):
            learnt = unescape(content[start:end])
            state["learnt"] += len(learnt)
            state["loss"].update(learnt.encode())
        state["chars"] += len(content)
    if state is not None:
        yield from out.add(last, *_read_row(state))
    yield from out.flush()


def _read_row(state: dict) -> tuple:
    return state["turns"], state["all"].hexdigest(), state["learnt"], state["loss"].hexdigest(), state["chars"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the output of ``format_conversations`` as it comes."""
    return formatted.mapInArrow(_read_back, _READ)


def joined(pieces: Iterable[tuple[str, bool]]) -> tuple[str, str]:
    """All text, and the generated text, of a rendering."""
    pieces = list(pieces)
    return "".join(p for p, _ in pieces), "".join(p for p, g in pieces if g)
