"""From spans to the arrays of an extraction."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

SIGNATURE_BYTES = 200
BODY_BYTES = 32 * 1024

#: Kinds that own members.
CLASS_KINDS = {"class"}


@dataclass
class Def:
    start: int
    end: int
    name: str
    kind: str
    container: str | None = None


@dataclass
class Call:
    at: int
    callee: str
    receiver: str | None = None


@dataclass
class Bind:
    at: int
    name: str
    type: str
    in_class: bool = False


def cut_bytes(text: str, most: int) -> str:
    """The longest prefix of at most ``most`` bytes that ends between characters."""
    data = text.encode()
    return text if len(data) <= most else data[:most].decode("utf-8", "ignore")


def signature(text: str) -> str:
    """First line, trimmed, without an opening brace at its end, at most 200 bytes."""
    line = text.split("\n", 1)[0].strip()
    line = line.removesuffix("{").rstrip()
    short = cut_bytes(line, SIGNATURE_BYTES)
    return short if short == line else short + "…"


def type_basename(text: str) -> str:
    """The last name of a type, without generics, path and qualifiers."""
    head = text.strip().split("<")[0].strip()
    last = head.rsplit("::", 1)[-1].split()
    return re.sub(r"^[^\w]+|[^\w]+$", "", last[-1] if last else head)


class Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)


class Owners:
    """The narrowest span around an offset; spans nest."""

    def __init__(self, defs: list[Def]):
        order = sorted(range(len(defs)), key=lambda i: (defs[i].start, -defs[i].end, i))
        self.parents: list[int | None] = [None] * len(defs)
        events: list[tuple[int, int | None]] = []
        stack: list[int] = []

        def leave(until: int) -> None:
            while stack and defs[stack[-1]].end <= until:
                done = stack.pop()
                events.append((defs[done].end, stack[-1] if stack else None))

        for i in order:
            leave(defs[i].start)
            self.parents[i] = stack[-1] if stack else None
            stack.append(i)
            events.append((defs[i].start, i))
        leave(1 << 62)
        self.at = [e[0] for e in events]
        self.who = [e[1] for e in events]

    def of(self, at: int) -> int | None:
        k = bisect.bisect_right(self.at, at) - 1
        return self.who[k] if k >= 0 else None


def finish(text: str, defs: list[Def], calls: list[Call], binds: list[Bind], imports: list[str]) -> dict:
    defs = sorted(defs, key=lambda d: (d.start, -d.end))
    lines, owners = Lines(text), Owners(defs)
    classes: list[int | None] = []
    for i, d in enumerate(defs):
        p = owners.parents[i]
        outer = None
        while p is not None:
            if defs[p].kind in CLASS_KINDS:
                outer = p
                break
            p = owners.parents[p]
        classes.append(outer)
        direct = owners.parents[i]
        if d.kind == "function" and direct is not None and defs[direct].kind in CLASS_KINDS:
            d.kind = "method"
    containers = [d.container or (defs[c].name if c is not None else None) for d, c in zip(defs, classes)]

    def bind_owner(b: Bind) -> int | None:
        own = owners.of(b.at)
        if b.in_class and own is not None and defs[own].kind not in CLASS_KINDS:
            return classes[own] if classes[own] is not None else own
        return own

    return {
        "symbols": [
            {
                "name": d.name,
                "kind": d.kind,
                "start_line": lines.of(d.start),
                "end_line": lines.of(max(d.start, d.end - 1)),
                "signature": signature(text[d.start:d.end]),
                "search_text": cut_bytes(text[d.start:d.end], BODY_BYTES),
            }
            for d in defs
        ],
        "calls": [{"from": owners.of(c.at), "callee": c.callee, "receiver": c.receiver} for c in sorted(calls, key=lambda c: c.at)],
        "bindings": [{"owner": bind_owner(b), "name": b.name, "ty": b.type} for b in sorted(binds, key=lambda b: b.at) if b.type],
        "containers": containers,
        "parents": owners.parents,
        "imports": [s for s in (x.strip().strip("\"'`") for x in imports) if s],
    }
