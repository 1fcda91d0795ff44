"""The command language: a line becomes a command, which names a plan for the session to build.

Grammar, in any case of the operation names::

    [name =] source {. operation}
    source     := literal | name | open(…) | keyword_search(…) | table_search(…) | join(…) | joinable(…)
    operation  := related | xr | xc | fill | <number> | insert(…) | … | export("file")
    import("file") | export("file") | set parameter value | params | help | quit
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class CommandError(ValueError):
    """A line that isn't a command."""


@dataclass(frozen=True)
class Call:
    """An operation with its arguments as text, quotes removed."""

    name: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class Command:
    target: str | None
    source: Call | None
    literal: str | None = None
    operations: tuple[Call, ...] = field(default=())


_NAME = re.compile(r"[A-Za-z_]\w*")
#: Operations that give a table and can be followed by others.
CHAINED = {"related", "xr", "xc", "fill"}
FUNCTIONS = {"open", "import", "export", "keyword_search", "table_search", "join", "joinable"}
WORDS = {"set", "params", "help", "quit", "exit"}
CHANGES = {"insert", "delete", "delrow", "delcol", "delcell", "updatecell", "swap"}
OPERATIONS = CHAINED | CHANGES | {"sort", "export"}


def split_args(text: str) -> tuple[str, ...]:
    """Arguments at the top level; quotes and parentheses hide commas."""
    out, cell, quote, depth = [], [], "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not "".join(cell).strip():
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append("".join(cell).strip())
            cell = []
            continue
        cell.append(c)
    if quote or depth:
        raise CommandError("a quote or parenthesis isn't closed")
    last = "".join(cell).strip()
    if last or out:
        out.append(last)
    return tuple(a[1:-1] if len(a) > 1 and a[0] == a[-1] and a[0] in "\"'" else a for a in out)


def _body(text: str, at: int) -> tuple[str, int]:
    """What stands between the parenthesis at a place and its partner, and where it ends."""
    depth, quote, before = 0, "", "("
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and before in "(,":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
        if not c.isspace():
            before = c
    raise CommandError("a parenthesis isn't closed")


def parse(line: str) -> Command:
    text, target = line.strip(), None
    if not text:
        raise CommandError("an empty line")
    first = text.split(None, 1)
    if first[0].lower() in WORDS and not (len(first) > 1 and first[1].startswith("=")):
        return Command(None, Call(first[0].lower(), tuple(first[1].split()) if len(first) > 1 else ()))
    if m := re.match(r"([A-Za-z_]\w*)\s*=\s*(?!=)", text):
        target, text = m[1], text[m.end() :]
    if text.startswith("("):
        _, end = _body(text, 0)
        if text[end:].strip():
            raise CommandError("a literal stands alone")
        return Command(target, None, literal=text)
    m = _NAME.match(text)
    if not m:
        raise CommandError(f"not a command: {line!r}")
    at, name = m.end(), m[0]
    if text[at : at + 1] == "(":
        if name.lower() not in FUNCTIONS:
            raise CommandError(f"no such function: {name}")
        body, at = _body(text, at)
        source = Call(name.lower(), split_args(body))
    else:
        source = Call("table", (name,))
    operations = []
    while at < len(text):
        m = re.compile(r"\s*\.\s*(\w+)\s*").match(text, at)
        if not m:
            raise CommandError(f"can't read {text[at:]!r}")
        at, op, args = m.end(), m[1].lower(), ()
        if text[at : at + 1] == "(":
            body, at = _body(text, at)
            args = split_args(body)
        if not op.isdigit() and op not in OPERATIONS:
            raise CommandError(f"no such operation: {op}")
        operations.append(Call(op, args))
    names = [o.name for o in operations]
    if len(names) > 1 and any(n not in CHAINED and not n.isdigit() for n in names) and not source.name == "joinable":
        raise CommandError("only related, xr, xc and fill can be chained")
    return Command(target, source, operations=tuple(operations))
