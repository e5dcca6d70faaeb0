"""YAML 1.1/1.2: a scanner that turns indentation into block tokens, and a grammar of nodes."""

from __future__ import annotations

import re

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax.base import line_of

RULES = r"""
stream: (block DOCEND*)? (DIRECTIVE* DOCSTART block? DOCEND*)* ;
block: ALIAS | props? (SCALAR | flow | seq | map) | props ;
props: ANCHOR TAG? | TAG ANCHOR? ;
seq: BSEQ (ENTRY block?)* BEND ;
map: BMAP (KEY value? (VALUE value?)? | VALUE value?)* BEND ;
value: block | props? (ENTRY block?)+ ;
flow: '[' ((fentry % ',') ','?)? ']' | '{' ((fentry % ',') ','?)? '}' ;
fentry: fnode | KEY fnode? (VALUE fnode?)? | VALUE fnode? ;
fnode: ALIAS | props? (SCALAR | flow) | props ;
"""

_PLAIN_BLOCK = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]++(?=[^\s#]))++")
_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]++(?=[^\s#,\[\]{}]))++")
_DQ = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))*+"')
_SQ = re.compile(r"'(?:[^']|'')*+'")
_ANCHOR = re.compile(r"[&*][^\s,\[\]{}]+")
_TAG = re.compile(r"!(?:<[^>\s]*>|[^\s,\[\]{}]*)")
_BLOCKHEAD = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:(?<=\s)#[^\n]*)?(?=\n|\Z)")
_CONTROL = re.compile(r"[^\t\n\r\x20-\x7e\x85\xa0-퟿-﻿！-�\U00010000-\U0010ffff]")


class Stop(Exception):
    def __init__(self, at: int, token: str, reason: str = "token"):
        self.at, self.token, self.reason = at, token, reason


class Yaml:
    def __init__(self):
        self.machine = Machine(Grammar(RULES, "stream"))

    def failure(self, text: str):
        try:
            m = _CONTROL.search(text)
            if m:
                raise Stop(m.start(), repr(m.group()))
            state = self.machine.start()
            for kind, at in _Scanner(text).tokens():
                state = state[kind]
                if not state.alive:
                    raise Stop(at, text[at:at + 30].split("\n")[0])
            if not state.complete:
                raise Stop(len(text), "", "end")
        except Stop as s:
            return line_of(text, min(s.at, len(text.rstrip()))), s.token[:80], s.reason
        return None


class _Scanner:
    def __init__(self, text: str):
        self.text, self.n, self.at = text, len(text), 0
        self.out: list[tuple[str, int]] = []
        self.indents = [-1]
        self.flow = 0
        #: By flow level: (index in out, line start, position, required) of what may be a key.
        self.candidate: dict[int, tuple[int, int, int, bool] | None] = {}
        self.fresh = True  # a block structure or key may begin here
        self.bol = 0

    def tokens(self):
        while self._next():
            pass
        return self.out

    def _col(self, at: int) -> int:
        return at - self.bol

    def _emit(self, kind: str, at: int) -> None:
        self.out.append((kind, at))

    def _unwind(self, col: int) -> None:
        if self.flow:
            return
        while self.indents[-1] > col:
            self.indents.pop()
            self._emit("BEND", self.at)

    def _drop_candidate(self) -> None:
        got = self.candidate.pop(self.flow, None)
        if got and got[3]:
            raise Stop(got[2], self.text[got[2]:got[2] + 30].split("\n")[0])

    def _maybe_key(self, at: int) -> None:
        if self.fresh:
            self._drop_candidate()
            required = not self.flow and self.indents[-1] == self._col(at)
            self.candidate[self.flow] = (len(self.out), self.bol, at, required)

    def _skip(self) -> None:
        """Blanks, comments and line breaks; a break ends what may be a key."""
        text, n = self.text, self.n
        while self.at < n:
            c = text[self.at]
            if c == " " or c == "\t" and (self.flow or not self.fresh or self._tab_ok()):
                self.at += 1
            elif c == "#" and (self.at == self.bol or text[self.at - 1] in " \t\n"):
                e = text.find("\n", self.at)
                self.at = n if e < 0 else e
            elif c == "\n":
                self.at += 1
                self.bol = self.at
                if not self.flow:
                    self.fresh = True
            else:
                break

    def _tab_ok(self) -> bool:
        """A tab before anything but a comment or break may not indent."""
        e = self.at
        while e < self.n and self.text[e] in " \t":
            e += 1
        return e >= self.n or self.text[e] in "\n#"

    def _next(self) -> bool:
        self._skip()
        text, n, at = self.text, self.n, self.at
        for level, got in list(self.candidate.items()):
            if got and (got[1] != self.bol or at - got[2] > 1024):
                if got[3]:
                    raise Stop(got[2], text[got[2]:got[2] + 30].split("\n")[0], "end" if at >= n else "token")
                self.candidate.pop(level)
        if at >= n:
            if self.flow:
                raise Stop(n, "", "end")
            self._drop_candidate()
            self._unwind(-1)
            return False
        col = self._col(at)
        self._unwind(col)
        c = text[at]
        nxt = text[at + 1:at + 2]
        if col == 0 and text[at:at + 3] in ("---", "...") and (at + 3 >= n or text[at + 3].isspace()):
            if self.flow:
                raise Stop(at, text[at:at + 3])
            self._drop_candidate()
            self._unwind(-1)
            self._emit("DOCSTART" if c == "-" else "DOCEND", at)
            self.at = at + 3
            self.fresh = False
            return True
        if c == "%" and col == 0 and not self.flow:
            self._drop_candidate()
            self._unwind(-1)
            self._emit("DIRECTIVE", at)
            e = text.find("\n", at)
            self.at = n if e < 0 else e
            self.fresh = False
            return True
        if c in "[{":
            self._maybe_key(at)
            self.flow += 1
            self._emit(c, at)
            self.fresh = True
            self.at += 1
            return True
        if c in "]}" and self.flow:
            self._drop_candidate()
            self.flow -= 1
            self.fresh = False
            self._emit(c, at)
            self.at += 1
            return True
        if c == "," and self.flow:
            self._drop_candidate()
            self.fresh = True
            self._emit(c, at)
            self.at += 1
            return True
        space = nxt == "" or nxt.isspace()
        if c == "-" and space and not self.flow:
            if not self.fresh:
                raise Stop(at, "-")
            self._drop_candidate()
            if self.indents[-1] < col:
                self.indents.append(col)
                self._emit("BSEQ", at)
            self._emit("ENTRY", at)
            self.at += 1
            return True
        if c == "?" and space:
            if not self.flow:
                if not self.fresh:
                    raise Stop(at, "?")
                if self.indents[-1] < col:
                    self.indents.append(col)
                    self._emit("BMAP", at)
            self.fresh = not self.flow
            self._drop_candidate()
            self._emit("KEY", at)
            self.at += 1
            return True
        if c == ":" and (space or self.flow and (nxt in ",[]{}" or self._after_json(at))):
            return self._value(at, col)
        if c in "*&":
            m = _ANCHOR.match(text, at)
            if not m:
                raise Stop(at, c)
            self._maybe_key(at)
            self.fresh = False
            self._emit("ALIAS" if c == "*" else "ANCHOR", at)
            self.at = m.end()
            return True
        if c == "!":
            m = _TAG.match(text, at)
            self._maybe_key(at)
            self.fresh = False
            self._emit("TAG", at)
            self.at = m.end()
            return True
        if c in "|>" and not self.flow:
            return self._literal(at)
        if c in "'\"":
            m = (_SQ if c == "'" else _DQ).match(text, at)
            if not m:
                raise Stop(n if text.find(c, at + 1) < 0 else at, c, "end" if text.find(c, at + 1) < 0 else "token")
            self._maybe_key(at)
            self.fresh = False
            self._emit("SCALAR", at)
            body = m.group()
            if "\n" in body:
                if re.search(r"\n(?:---|\.\.\.)(?=\s)", body):
                    raise Stop(at, c)
                self.bol = at + body.rfind("\n") + 1
                self.candidate.pop(self.flow, None) if not (self.candidate.get(self.flow) or (0, 0, 0, False))[3] else self._drop_candidate()
            self.at = m.end()
            return True
        if c not in "-?:,[]{}#&*!|>'\"%@`" or c in "-?:" and not space and not (self.flow and c in "?:" and nxt in ",[]{}"):
            return self._plain(at)
        raise Stop(at, c)

    def _after_json(self, at: int) -> bool:
        return bool(self.out) and self.out[-1][0] in ("SCALAR", "]", "}") and self.text[at - 1] in "\"']}"

    def _value(self, at: int, col: int) -> bool:
        got = self.candidate.pop(self.flow, None)
        if got:
            index, _, pos, _ = got
            self.out.insert(index, ("KEY", pos))
            if not self.flow and self.indents[-1] < self._col(pos):
                self.indents.append(self._col(pos))
                self.out.insert(index, ("BMAP", pos))
            self.fresh = False
        else:
            if not self.flow:
                if not self.fresh:
                    raise Stop(at, ":")
                if self.indents[-1] < col:
                    self.indents.append(col)
                    self._emit("BMAP", at)
            self.fresh = not self.flow
        self._emit("VALUE", at)
        self.at = at + 1
        return True

    def _literal(self, at: int) -> bool:
        m = _BLOCKHEAD.match(self.text, at)
        if not m:
            raise Stop(at, self.text[at:at + 30].split("\n")[0])
        self._drop_candidate()
        parent = max(0, self.indents[-1])
        if self.indents[-1] < 0:
            parent = -1
        digits = re.search(r"[1-9]", m.group())
        indent = max(parent, 0) + int(digits.group()) if digits else None
        text, n, e = self.text, self.n, min(self.n, m.end() + 1)
        self._emit("SCALAR", at)
        blank = 0
        while e < n:
            stop = text.find("\n", e)
            stop = n if stop < 0 else stop
            line = text[e:stop]
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" ") == "":
                blank = max(blank, lead)
            else:
                if indent is None:
                    if lead <= parent:
                        break
                    indent = lead
                    if blank > lead:
                        raise Stop(e, line)
                elif lead < indent:
                    break
                if lead == 0 and re.match(r"(?:---|\.\.\.)(?:\s|\Z)", line):
                    break
            e = stop + 1
        self.at = min(e, n)
        self.bol = self.at
        self.fresh = True
        return True

    def _plain(self, at: int) -> bool:
        """A plain scalar, over several lines where the following ones are indented more."""
        self._maybe_key(at)
        self.fresh = False
        text, n = self.text, self.n
        pattern = _PLAIN_FLOW if self.flow else _PLAIN_BLOCK
        m = pattern.match(text, at)
        end = m.end() if m else at + 1
        while True:
            e = end
            while e < n and text[e] in " \t":
                e += 1
            if e >= n or text[e] != "\n":
                break
            bol = e + 1
            while e < n and text[e] in " \t\n":
                if text[e] == "\n":
                    bol = e + 1
                elif text[e] == "\t":  # a tab may not indent, nor may it here
                    raise Stop(e, "\t")
                e += 1
            if e >= n or text[e] == "#":
                break
            if not self.flow and e - bol <= self.indents[-1]:
                break
            if e == bol and re.compile(r"(?:---|\.\.\.)(?:\s|\Z)").match(text, e):
                break
            if self.flow and text[e] in ",[]{}" or text[e] == ":" and (e + 1 >= n or text[e + 1].isspace()):
                break
            m = pattern.match(text, e)
            if not m:
                break
            self.bol, end = bol, m.end()
            got = self.candidate.get(self.flow)
            if got and got[1] != self.bol:
                self._drop_candidate()
        self._emit("SCALAR", at)
        self.at = end
        return True


def make(_: str) -> Yaml:
    return Yaml()
