"""Memoised parsing with derivatives.

A grammar is a set of regular right-hand sides over terminals and rule names. The
derivative of a language by a token is the language of the rests of its words that
begin with the token; parsing a file is deriving the start rule by its tokens one after
the other. Derivatives are kept in Antimirov's form: a state is a set of stacks of
grammar nodes, any of which may be what remains to be read. The stacks form a shared
graph: those that begin with the same node are one entry, a node and the set of what may
follow it, so ambiguity that piles up (2^n ways to read n open brackets) stays a chain of
n small sets. Nodes, entries, sets and states are hash-consed, so equal contexts are one
object, and three memo tables hold

* the derivative of a node by a token (finite, computed once per grammar),
* the nullability of an entry, and
* the derivative of a state by a token, as a dictionary on the state itself.

After a few files nearly every step is one dictionary lookup. A token whose derivative
is empty is the exact token that fails; a file that ends in a state that is not
nullable was cut off.

Left recursion is not allowed (repetition is written with ``*``). Memory is bounded, within
a file too: beyond ``max_states`` states or ten times as many entries, tables are begun anew
with what the current state needs.
"""

from __future__ import annotations

import re

_META = re.compile(r"'[^']+'|[A-Za-z_]\w*|[|*+?()%;:]")


class Grammar:
    """Rules from text: ``name: a b | 'x' (c % ',')? d* ;``.

    Quoted strings and upper-case names are terminals, lower-case names are rules;
    ``x % s`` is x, or several x separated by s. ``also`` maps a kind of the lexer to
    further terminals that it matches (a soft keyword is a name as well); ``any_but``
    names a terminal that matches every kind except some.
    """

    def __init__(
        self,
        text: str,
        start: str,
        also: dict[str, tuple[str, ...]] | None = None,
        any_but: tuple[str, frozenset[str]] = ("", frozenset()),
    ):
        self._any, self._any_but = any_but
        self._index: dict[tuple, int] = {}
        self._node: list[tuple] = []
        self.eps = self._make(("seq",))
        self.rules: dict[str, int] = {}
        self._also = {k: frozenset((k, *v)) for k, v in (also or {}).items()}
        self._read(text)
        missing = {n[1] for n in self._node if n[0] == "ref"} - set(self.rules)
        if missing:
            raise ValueError(f"rules that are used but not given: {sorted(missing)}")
        self.start = self._make(("ref", start))
        self._nullable = self._fix_nullable()
        self._memo: dict[tuple[int, str], tuple[tuple[int, ...], ...]] = {}

    def _make(self, node: tuple) -> int:
        at = self._index.get(node)
        if at is None:
            at = self._index[node] = len(self._node)
            self._node.append(node)
        return at

    # -- reading the rules

    def _read(self, text: str) -> None:
        toks = _META.findall(text)
        self._toks, self._at = toks, 0
        while self._at < len(toks):
            name = toks[self._at]
            if toks[self._at + 1] != ":":
                raise ValueError(f"after {name}")
            self._at += 2
            self.rules[name] = self._alternatives()
            if toks[self._at] != ";":
                raise ValueError(f"in {name}, at {toks[self._at - 2: self._at + 3]}")
            self._at += 1

    def _alternatives(self) -> int:
        parts = [self._sequence()]
        while self._toks[self._at] == "|":
            self._at += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else self._make(("alt", *dict.fromkeys(parts)))

    def _sequence(self) -> int:
        parts: list[int] = []
        while self._toks[self._at] not in ("|", ";", ")", "%"):
            parts.append(self._item())
        return parts[0] if len(parts) == 1 else self._make(("seq", *parts))

    def _item(self) -> int:
        t = self._toks[self._at]
        self._at += 1
        if t == "(":
            x = self._alternatives()
            if self._toks[self._at] == "%":
                self._at += 1
                sep = self._item()
                x = self._make(("seq", x, self._make(("star", self._make(("seq", sep, x))))))
            if self._toks[self._at] != ")":
                raise ValueError(f"no ) at {self._toks[self._at - 3: self._at + 3]}")
            self._at += 1
        elif t[0] == "'":
            x = self._make(("tok", t[1:-1]))
        elif t.isupper():
            x = self._make(("tok", t))
        else:
            x = self._make(("ref", t))
        while self._at < len(self._toks) and self._toks[self._at] in "*+?":
            op = self._toks[self._at]
            self._at += 1
            if op == "*":
                x = self._make(("star", x))
            elif op == "+":
                x = self._make(("seq", x, self._make(("star", x))))
            else:
                x = self._make(("alt", x, self.eps))
        return x

    # -- nullability and derivatives of nodes

    def _fix_nullable(self) -> list[bool]:
        null = [n[0] == "star" for n in self._node]
        changed = True
        while changed:
            changed = False
            for i, n in enumerate(self._node):
                if null[i]:
                    continue
                kind = n[0]
                now = (
                    all(null[x] for x in n[1:]) if kind == "seq"
                    else any(null[x] for x in n[1:]) if kind == "alt"
                    else null[self.rules[n[1]]] if kind == "ref"
                    else False
                )
                if now:
                    null[i] = changed = True
        return null

    def nullable(self, node: int) -> bool:
        return self._nullable[node]

    def derive(self, node: int, kind: str) -> tuple[tuple[int, ...], ...]:
        """The rests after ``kind``, each a sequence of nodes still to be read."""
        key = (node, kind)
        got = self._memo.get(key)
        if got is None:
            self._memo[key] = ()  # left recursion would find this; there is none
            got = self._memo[key] = tuple(dict.fromkeys(self._derive(node, kind)))
        return got

    def _derive(self, node: int, kind: str):
        n = self._node[node]
        what = n[0]
        if what == "tok":
            if n[1] == kind or n[1] in self._also.get(kind, ()) or n[1] == self._any and kind not in self._any_but:
                yield ()
        elif what == "ref":
            yield from self.derive(self.rules[n[1]], kind)
        elif what == "alt":
            for x in n[1:]:
                yield from self.derive(x, kind)
        elif what == "star":
            for rest in self.derive(n[1], kind):
                yield (*rest, node)
        else:
            for i, x in enumerate(n[1:], 1):
                for rest in self.derive(x, kind):
                    yield (*rest, *n[i + 1:])
                if not self._nullable[x]:
                    break

    def terminal(self, node: int) -> str | None:
        n = self._node[node]
        return n[1] if n[0] == "tok" else None


class State(dict):
    """A state; its items are its derivatives by kind of token, made on demand."""

    __slots__ = ("machine", "tables", "entries", "complete", "inside", "alive")

    def __missing__(self, kind):
        nxt = self[kind] = self.machine.step(self, kind)
        return nxt


class _Tables:
    """Entries (node, set of entries that may follow) and sets of entries, each made once; entry 0 is the end."""

    def __init__(self, machine: "Machine"):
        self.machine = machine
        self.cons: dict[tuple[int, int], int] = {}
        self.entry: list[tuple[int, int]] = [(0, 0)]
        self.null: list[bool] = [True]
        self.inside: list[bool] = [False]
        self.set_of: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.set_null: list[bool] = []
        self.set_inside: list[bool] = []
        self.states: dict[frozenset, State] = {}
        self.limit = machine.max_states
        self.end = self.tail(frozenset([0]))

    def tail(self, entries: frozenset) -> int:
        at = self.set_of.get(entries)
        if at is None:
            at = self.set_of[entries] = len(self.sets)
            self.sets.append(entries)
            null, inside = self.null, self.inside
            is_null = is_inside = False
            for x in entries:
                is_null = is_null or null[x]
                is_inside = is_inside or inside[x]
            self.set_null.append(is_null)
            self.set_inside.append(is_inside)
        return at

    def push(self, node: int, tail: int) -> int:
        key = (node, tail)
        at = self.cons.get(key)
        if at is None:
            at = self.cons[key] = len(self.entry)
            self.entry.append(key)
            g = self.machine.grammar
            self.null.append(g._nullable[node] and self.set_null[tail])
            self.inside.append(self.set_inside[tail] or g.terminal(node) in self.machine.closers)
        return at

    def state(self, entries: frozenset) -> State:
        got = self.states.get(entries)
        if got is None:
            got = self.states[entries] = State()
            got.machine, got.tables, got.entries = self.machine, self, entries
            got.complete = any([self.null[x] for x in entries])
            got.inside = any([self.inside[x] for x in entries])
            got.alive = bool(entries)
        return got

    def merged(self, by_node: dict[int, set[int]], ended: bool) -> State:
        """One entry per node."""
        out = [self.push(node, self.tail(frozenset(after))) for node, after in by_node.items()]
        return self.state(frozenset([*out, 0] if ended else out))

    def joined(self, a: State, b: State) -> State:
        by_node: dict[int, set[int]] = {}
        for x in a.entries | b.entries:
            if x:
                node, tail = self.entry[x]
                by_node.setdefault(node, set()).update(self.sets[tail])
        return self.merged(by_node, 0 in a.entries or 0 in b.entries)

    def full(self) -> bool:
        return len(self.states) > self.limit or len(self.entry) > 10 * self.limit

    def moved(self, state: State) -> State:
        """The state in tables of its own, made of what it needs."""
        need, todo = {0}, list(state.entries)
        while todo:
            x = todo.pop()
            if x not in need:
                need.add(x)
                todo.extend(self.sets[self.entry[x][1]])
        new = _Tables(self.machine)
        place = {0: 0}
        for x in sorted(need - {0}):  # what follows an entry is older than the entry
            node, tail = self.entry[x]
            place[x] = new.push(node, new.tail(frozenset(place[y] for y in self.sets[tail])))
        new.limit = max(self.machine.max_states, len(need))
        self.machine.tables = new
        return new.state(frozenset(place[x] for x in state.entries))


class Machine:
    """The lazily built automaton of one grammar.

    ``closers``: terminals that, while pending, mean that the parse is inside brackets
    (``State.inside``). ``virtual``: the kind that may be supplied where a token
    preceded by a line break, a closing brace or the end does not fit (ECMAScript's
    automatic semicolon); kinds of tokens preceded by a line break are then passed as
    ``(kind,)``.
    """

    def __init__(self, grammar: Grammar, closers=(), virtual: str | None = None, max_states: int = 100_000):
        self.grammar, self.virtual, self.max_states = grammar, virtual, max_states
        self.closers = frozenset(closers)
        self.tables = _Tables(self)

    def start(self, rule: str | None = None) -> State:
        t = self.tables
        if len(t.states) > self.max_states or len(t.entry) > 10 * self.max_states:
            t = self.tables = _Tables(self)
        node = self.grammar._make(("ref", rule)) if rule else self.grammar.start
        if node >= len(self.grammar._nullable):
            self.grammar._nullable.append(self.grammar._nullable[self.grammar.rules[rule]])
        return t.state(frozenset([t.push(node, t.end)]))

    def _plain(self, state: State, kind: str) -> State:
        t, g = state.tables, self.grammar
        out: dict[int, set[int]] = {}
        seen: set[int] = set()
        todo = list(state.entries)
        ended = False
        while todo:
            x = todo.pop()
            if x == 0 or x in seen:
                continue
            seen.add(x)
            node, tail = t.entry[x]
            for nodes in g.derive(node, kind):
                if nodes:
                    at = tail
                    for y in reversed(nodes[1:]):
                        at = t.tail(frozenset([t.push(y, at)]))
                    out.setdefault(nodes[0], set()).update(t.sets[at])
                    continue
                for y in t.sets[tail]:
                    if y:
                        n, after = t.entry[y]
                        out.setdefault(n, set()).update(t.sets[after])
                    else:
                        ended = True
            if g.nullable(node):
                todo.extend(t.sets[tail])
        return t.merged(out, ended)

    def step(self, state: State, kind) -> State:
        if kind is None:
            return state
        if not state.entries:
            return state
        broken = kind.__class__ is tuple
        if broken:
            if len(kind) > 1:  # several tokens that the lexer had to take as one
                for k in kind:
                    state = state[k]
                return state
            kind = kind[0]
        nxt = self._plain(state, kind)
        if self.virtual and (broken or kind == "}") and (not nxt.entries or kind in ("++", "--")):
            other = self._plain(self._plain(state, self.virtual), kind)
            nxt = state.tables.joined(nxt, other)
        return nxt.tables.moved(nxt) if state.tables.full() else nxt

    def ended(self, state: State) -> bool:
        if state.complete:
            return True
        return bool(self.virtual) and self._plain(state, self.virtual).complete
