"""Prompt templates as column expressions.

``{name}`` and ``{{ name }}`` stand for columns or values, ``{{ x.field | upper }}`` for a field of one through a filter;
``{% for x in xs %} ... {% endfor %}`` repeats its body for the elements of an array (``loop.index`` counts from 1), and
``{% if x %} ... {% elif not y %} ... {% elif z == 'text' %} ... {% else %} ... {% endif %}`` chooses. A rendering is one
expression, evaluated in the JVM; null, "", "false", "0" and empty arrays are false, and null renders as nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from .text import strip

_MARK = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}|\{(\w+)\}")
_PATH = r"[A-Za-z_]\w*(?:\.\w+)*"
FILTERS = {
    "upper": (F.upper, lambda x: str(x).upper()),
    "lower": (F.lower, lambda x: str(x).lower()),
    "trim": (strip, lambda x: str(x).strip()),
    "length": (lambda c: F.char_length(c.cast("string")), lambda x: len(str(x))),
}


@dataclass(frozen=True)
class _Slot:
    path: str
    filters: tuple[str, ...] = ()


@dataclass(frozen=True)
class _Loop:
    name: str
    path: str
    body: tuple


@dataclass(frozen=True)
class _Choice:
    ways: tuple  # of (condition or None, body)


class _Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        for m in _MARK.finditer(text):
            self.items.append(("text", text[at : m.start()]))
            self.items.append(("tag", m[1]) if m[1] is not None else ("slot", m[2] if m[2] is not None else m[3]))
            at = m.end()
        self.items.append(("text", text[at:]))
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag whose first word is one of ``ends``, and that tag."""
        out = []
        while self.at < len(self.items):
            kind, value = self.items[self.at]
            self.at += 1
            if kind == "text":
                out.append(value)
            elif kind == "slot":
                path, *filters = (x.strip() for x in value.split("|"))
                if not re.fullmatch(_PATH, path) and not path.isdigit() or set(filters) - set(FILTERS):
                    raise ConfigError(f"cannot read the slot {value!r}")
                out.append(_Slot(path, tuple(filters)))
            elif (word := value.split(" ", 1)[0]) in ends:
                return tuple(out), value
            elif m := re.fullmatch(rf"for (\w+) in ({_PATH})", value):
                out.append(_Loop(m[1], m[2], self.body("endfor")[0]))
            elif word == "if":
                out.append(self._choice(value))
            else:
                raise ConfigError(f"cannot read the tag {value!r}")
        if ends:
            raise ConfigError(f"the template ends before {ends[-1]}")
        return tuple(out), ""

    def _choice(self, tag: str) -> _Choice:
        ways = []
        while tag != "endif":
            test = None
            if tag != "else":
                m = re.fullmatch(rf"(?:el)?if (not )?({_PATH})(?: (==|!=) '([^']*)')?", tag)
                if not m:
                    raise ConfigError(f"cannot read the condition {tag!r}")
                test = (bool(m[1]), m[2], m[3], m[4])
            body, tag = self.body("elif", "else", "endif")
            ways.append((test, body))
        return _Choice(tuple(ways))


def _names(body: tuple, bound: frozenset[str] = frozenset({"loop"})) -> set[str]:
    out: set[str] = set()
    for x in body:
        if isinstance(x, _Slot):
            out |= {x.path.split(".")[0]} - bound
        elif isinstance(x, _Loop):
            out |= {x.path.split(".")[0]} - bound | _names(x.body, bound | {x.name})
        elif isinstance(x, _Choice):
            for test, own in x.ways:
                out |= ({test[1].split(".")[0]} - bound if test else set()) | _names(own, bound)
    return out


def _column(path: str, env: dict[str, Column]) -> Column:
    head, *fields = path.split(".")
    out = env[path] if path in env else env[head]
    for f in fields if path not in env else []:
        out = out[f]
    return out


def _value(path: str, env: dict[str, object]) -> object:
    head, *fields = path.split(".")
    if path in env:
        return env[path]
    out = env[head]
    for f in fields:
        out = None if out is None else out.get(f) if isinstance(out, dict) else getattr(out, f, None)
    return out


def _repeated(loop: _Loop, env: dict[str, Column]):
    return lambda v, i: _expression(loop.body, env | {loop.name: v, "loop.index": i + 1})


def _expression(body: tuple, env: dict[str, Column]) -> Column:
    pieces = []
    for x in body:
        if isinstance(x, str):
            pieces.append(F.lit(x))
        elif isinstance(x, _Slot):
            value = _column(x.path, env)
            for f in x.filters:
                value = FILTERS[f][0](value)
            pieces.append(value.cast("string"))
        elif isinstance(x, _Loop):
            pieces.append(F.array_join(F.transform(_column(x.path, env), _repeated(x, env)), ""))
        else:
            chosen = None
            for test, own in x.ways:
                text = _expression(own, env)
                if test is None:
                    chosen = text if chosen is None else chosen.otherwise(text)
                else:
                    negated, path, op, literal = test
                    shown = F.coalesce(_column(path, env).cast("string"), F.lit(""))
                    ok = shown == F.lit(literal) if op else ~shown.isin("", "false", "0", "[]")
                    ok = ~ok if negated != (op == "!=") else ok
                    chosen = F.when(ok, text) if chosen is None else chosen.when(ok, text)
            pieces.append(chosen)
    return F.concat(*(F.coalesce(p, F.lit("")) for p in pieces)) if pieces else F.lit("")


def _text(body: tuple, env: dict[str, object]) -> str:
    out = []
    for x in body:
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, _Slot):
            value = _value(x.path, env)
            for f in x.filters:
                value = FILTERS[f][1]("" if value is None else value)
            out.append("" if value is None else str(value))
        elif isinstance(x, _Loop):
            out += [_text(x.body, env | {x.name: v, "loop.index": i + 1}) for i, v in enumerate(_value(x.path, env) or [])]
        else:
            for test, own in x.ways:
                if test is not None:
                    negated, path, op, literal = test
                    value = _value(path, env)
                    ok = ("" if value is None else str(value)) == literal if op else bool(value) and str(value) not in ("false", "0")
                    if ok == (negated != (op == "!=")):
                        continue
                out.append(_text(own, env))
                break
    return "".join(out)


class PromptTemplate:
    """A template whose rendering is one expression, evaluated in the JVM."""

    def __init__(self, text: str):
        self.text = text
        self.body = _Parser(text).body()[0]
        self.variables = sorted(_names(self.body))

    @classmethod
    def from_file(cls, path: str) -> PromptTemplate:
        try:
            with open(path, encoding="utf-8") as f:
                return cls(f.read())
        except OSError as e:
            raise ConfigError(f"cannot read template {path}: {e}") from e

    def missing(self, given: set[str]) -> list[str]:
        """Variables that are not given."""
        return sorted(set(self.variables) - given)

    def _check(self, given: set[str]) -> None:
        if missing := self.missing(given):
            raise ConfigError(f"missing template variables: {', '.join(missing)}")

    def render(self, **values: Column | str) -> Column:
        """A column; strings are literal text."""
        self._check(set(values))
        return _expression(self.body, {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})

    def format(self, **values: object) -> str:
        """The text for one set of values, on the driver."""
        self._check(set(values))
        return _text(self.body, values)


def numbered_context(chunks: Column) -> Column:
    """[1] first chunk, blank line, [2] second chunk ...; a note where there is none."""
    lines = F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), strip(c)))
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, "(No context available)").otherwise(F.array_join(lines, "\n\n"))


def chat_history(turns: Column) -> Column:
    """Lines "role: text" of an array of structs (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit(": "), t.text)), "\n")


QA = PromptTemplate("Answer the question from the context alone. Say so if the context does not hold the answer.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:")
SUMMARY = PromptTemplate("Summarise the following text in at most {sentences} sentences.\n\n{text}\n\nSummary:")
CHAT = PromptTemplate("You are a helpful assistant with access to these sources:\n{context}\n\nConversation so far:\n{history}\n\nuser: {question}\nassistant:")
SYNTHETIC_QA = PromptTemplate('Write {num_questions} questions with answers about each numbered text.\nReply with JSON: {"chunks": [{"chunk_id": 1, "qa_pairs": [{"question": "...", "answer": "...", "confidence": 0.9}]}]}\n\n{chunks}')
BUILTIN = {"qa": QA, "summary": SUMMARY, "chat": CHAT, "synthetic_qa": SYNTHETIC_QA}
