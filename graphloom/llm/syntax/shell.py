"""Bash: a lexer that follows quotes, expansions and here-documents, and a grammar of commands.

Command substitutions are parsed by the same grammar; where one of them ends is asked of
the parser's state (a closing parenthesis that no rule can take ends it). Conditions,
arrays and parenthesised patterns are derived by rules of their own. What nests is followed
by generators that a loop runs, so depth costs memory and not the interpreter's stack, and
what was once read from a position is not read again.
"""

from __future__ import annotations

import re

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax.base import line_of

RULES = r"""
script: (NL | andor (';' | '&' | NL))* andor? ;
list: NL* andor (sep andor)* sep? ;
sep: (';' | '&' | NL) NL* ;
andor: (pipeline % join) ;
join: ('&&' | '||') NL* ;
pipeline: 'time'* '!'* (command % pipe) | 'time' ;
pipe: ('|' | '|&') NL* ;
command: simple | compound redir* | CMD '(' ')' NL* compound redir*
  | 'function' WORD ('(' ')')? NL* compound redir* | 'coproc' CMD? (compound redir* | simple) ;
simple: (ASSIGN | redir)* CMD (WORD | ASSIGN | redir)* | (ASSIGN | redir)+ ;
redir: REDIR WORD | HERE ;
compound: '{' list '}' | '(' list ')' | ARITH | COND
  | 'if' list 'then' list ('elif' list 'then' list)* ('else' list)? 'fi'
  | ('while' | 'until') list 'do' list 'done'
  | 'for' WORD (NL* 'in' WORD* (';' | NL) | ';')? NL* dogroup | 'for' ARITH ';'? NL* dogroup
  | 'select' WORD (NL* 'in' WORD* (';' | NL) | ';')? NL* dogroup
  | 'case' WORD NL* 'in' NL* (clause NL*)* lastclause? 'esac' ;
dogroup: 'do' list 'done' | '{' list '}' ;
clause: '('? (WORD % '|') ')' NL* list? (';;' | ';&' | ';;&') ;
lastclause: '('? (WORD % '|') ')' NL* list? ;
cond: (cterm % cjoin) ;
cjoin: '&&' | '||' ;
cterm: WORD+ | WORD* '(' cond ')' ;
array: WORD* ;
parens: ('X' | '(' parens ')')* ;
"""

RESERVED = set("if then elif else fi do done case esac while until for function select time { } ! coproc".split())
_OP = re.compile(r"&>>|&>|\|&|\|\||\||&&|&|;;&|;;|;&|;|\(|\)")
_REDIR = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-|<<|<>|<&|>>|>\||>&|<(?!\()|>(?!\())|&>>|&>")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
_PLAIN = re.compile(r"[^\s;&|<>()\\'\"$`#]+")
_BLANK = re.compile(r"(?:[ \t\r\f\v]|\\\n)+")
_IN_DOUBLE = re.compile(r"[\"\\`$]")
_IN_BRACE = re.compile(r"[}\\\"`$']")
_IN_PARENS = re.compile(r"[()\\\"'`$]")


class Stop(Exception):
    def __init__(self, at: int, token: str, reason: str):
        self.at, self.token, self.reason = at, token, reason


def _run(job):
    """The value of a generator that yields the generators it waits for."""
    stack, value, error = [job], None, None
    while stack:
        try:
            got = stack[-1].send(value) if error is None else stack[-1].throw(error)
        except StopIteration as e:
            stack.pop()
            value, error = e.value, None
        except Stop as e:
            stack.pop()
            value, error = None, e
        else:
            stack.append(got)
            value = error = None
    if error is not None:
        raise error
    return value


class Shell:
    def __init__(self):
        also = {w: ("WORD",) for w in RESERVED} | {"W": ("WORD", "CMD"), "in": ("WORD", "CMD"), "ASSIGN": ("WORD",)}
        also["coproc"] = ("WORD",)
        self.machine = Machine(Grammar(RULES, "script", also))

    def failure(self, text: str):
        try:
            _run(_Text(self.machine, text).script(0, False))
        except Stop as s:
            return line_of(text, min(s.at, len(text.rstrip()))), s.token[:80], s.reason
        return None


class _Text:
    """One text; its methods are generators that give the position after what they read."""

    def __init__(self, machine: Machine, text: str):
        self.machine, self.text, self.n = machine, text, len(text)
        self._scripts: dict[int, int | Stop] = {}
        self._sums: dict[int, int] = {}

    def substitution(self, at: int):
        """Past the parenthesis that closes the commands at ``at``."""
        got = self._scripts.get(at)
        if got is None:
            try:
                got = yield self.script(at, True)
            except Stop as s:
                got = s
            self._scripts[at] = got
        if got.__class__ is Stop:
            raise Stop(got.at, got.token, got.reason)
        return got

    def script(self, at: int, closed: bool):
        """Commands from ``at`` to the end of the text, or past the closing parenthesis."""
        text, n = self.text, self.n
        state, waiting = self.machine.start("script" if closed else None), []
        while True:
            m = _BLANK.match(text, at)
            if m:
                at = m.end()
            if at >= n:
                break
            c = text[at]
            if c == "#":
                at = text.find("\n", at)
                if at < 0:
                    at = n
                continue
            if c == "\n":
                at += 1
                for word, strip in waiting:
                    at = self.here(at, word, strip)
                waiting = []
                kind, token, end = "NL", "\n", at
            else:
                r = _REDIR.match(text, at)
                if r:
                    token, end = r.group(), r.end()
                    kind = "REDIR"
                    if token.endswith(("<<", "<<-")) and not token.endswith("<<<"):
                        b = _BLANK.match(text, end)
                        end = b.end() if b else end
                        stop = yield self.word(end)
                        if stop == end:
                            raise Stop(at, token, "token" if end < n else "end")
                        raw = text[end:stop]
                        waiting.append((re.sub(r"[\\'\"]", "", raw.lstrip("$") if raw[:2] in ("$'", '$"') else raw), token.endswith("-")))
                        kind, end = "HERE", stop
                elif text.startswith("((", at) and state["ARITH"].alive and (e := (yield self.arith(at + 2))) >= 0:
                    kind, token, end = "ARITH", "((", e
                elif c in ";&|()":
                    o = _OP.match(text, at)
                    token, end = o.group(), o.end()
                    if token in ("&>", "&>>"):
                        kind = "REDIR"
                    else:
                        kind = token
                    if kind == ")" and closed and not state[")"].alive:
                        if not state.complete:
                            raise Stop(at, ")", "token")
                        return end
                elif text.startswith("[[", at) and text[at + 2:at + 3].isspace() and state["COND"].alive:
                    kind, token = "COND", "[["
                    end = yield self.cond(at + 2)
                else:
                    a = _ASSIGN.match(text, at)
                    if a and text.startswith("(", a.end()):
                        end = yield self.array(a.end() + 1)
                        kind = "ASSIGN"
                    else:
                        p = _PLAIN.match(text, at)
                        if p and (p.end() >= n or text[p.end()] in " \t\n;&|)"):
                            end = p.end()
                        else:
                            end = yield self.word(at)
                        kind = "ASSIGN" if a else "W"
                        token = text[at:end]
                        if token in RESERVED or token == "in":
                            kind = token
                    token = text[at:end]
            state = state[kind]
            if not state.alive:
                raise Stop(at, token, "token")
            at = end
        if closed or not state.complete:
            raise Stop(n, "", "end")
        return n

    def here(self, at: int, word: str, strip: bool) -> int:
        """Past the body of a here-document; one that is not closed runs to the end."""
        text, n = self.text, self.n
        while at < n:
            e = text.find("\n", at)
            e = n if e < 0 else e
            line = text[at:e]
            if (line.lstrip("\t") if strip else line) == word:
                return min(n, e + 1)
            at = e + 1
        return n

    def word(self, at: int):
        text, n, begin = self.text, self.n, at
        while at < n:
            m = _PLAIN.match(text, at)
            if m:
                at = m.end()
                if at >= n:
                    break
            c = text[at]
            if c in " \t\n;&|)\r\f\v":
                break
            if c in "<>":
                if text[at + 1:at + 2] == "(":
                    at = yield self.substitution(at + 2)
                    continue
                break
            if c == "(":
                if at > begin and text[at - 1] in "@?*+!":
                    at = yield self.parens(at + 1)
                    continue
                break
            at = yield self.piece(at)
        return at

    def piece(self, at: int):
        """Past one quote, escape or expansion at ``at``, or one plain character."""
        text, n = self.text, self.n
        c = text[at]
        if c == "\\":
            return min(n, at + 2)
        if c == "'":
            e = text.find("'", at + 1)
            if e < 0:
                raise Stop(n, "'", "end")
            return e + 1
        if c == '"':
            return (yield self.double(at + 1))
        if c == "`":
            return (yield self.backquote(at + 1))
        if c != "$":
            return at + 1
        d = text[at + 1:at + 2]
        if d == "(":
            if text.startswith("((", at + 1):
                e = yield self.arith(at + 3)
                if e >= 0:
                    return e
            return (yield self.substitution(at + 2))
        if d == "{":
            return (yield self.brace(at + 2))
        if d == "[":
            e = text.find("]", at)
            if e < 0:
                raise Stop(n, "$[", "end")
            return e + 1
        if d == "'":
            e = at + 2
            while e < n and text[e] != "'":
                e += 2 if text[e] == "\\" else 1
            if e >= n:
                raise Stop(n, "$'", "end")
            return e + 1
        return at + 1

    def double(self, at: int):
        text, n = self.text, self.n
        while m := _IN_DOUBLE.search(text, at):
            at, c = m.start(), m.group()
            if c == '"':
                return at + 1
            if c == "\\":
                at += 2
            elif c == "`" or text[at + 1:at + 2] in ("(", "{", "["):
                at = yield self.piece(at)
            else:
                at += 1
        raise Stop(n, '"', "end")

    def backquote(self, at: int):
        text, n, e = self.text, self.n, at
        while e < n and text[e] != "`":
            e += 2 if text[e] == "\\" else 1
        if e >= n:
            raise Stop(n, "`", "end")
        inner = re.sub(r"\\([`$\\])", r"\1", text[at:e])
        try:
            yield _Text(self.machine, inner).script(0, False)
        except Stop as s:
            raise Stop(at, s.token, "token") from None
        return e + 1

    def brace(self, at: int):
        text, n = self.text, self.n
        while m := _IN_BRACE.search(text, at):
            at = m.start()
            if m.group() == "}":
                return at + 1
            at = yield self.piece(at)
        raise Stop(n, "${", "end")

    def parens(self, at: int):
        """Past the parenthesis that closes a pattern."""
        text, n, state = self.text, self.n, self.machine.start("parens")
        while m := _IN_PARENS.search(text, at):
            at, c = m.start(), m.group()
            if c in "()":
                after = state[c]
                at += 1
                if not after.alive:
                    return at
                state = after
            else:
                at = yield self.piece(at)
        raise Stop(n, "(", "end")

    def arith(self, at: int):
        """Past the ``))`` of an arithmetic expression, or -1 if it is none.

        What is learnt of the parentheses within is kept: each may be asked for later.
        """
        got = self._sums.get(at)
        if got is not None:
            return got
        text, n, begin, open_ = self.text, self.n, at, []
        while m := _IN_PARENS.search(text, at):
            at, c = m.start(), m.group()
            if c == "(":
                at += 1
                open_.append(at)
            elif c == ")":
                end = at + 2 if text[at + 1:at + 2] == ")" else -1
                inner = open_.pop() if open_ else begin
                self._sums[inner] = end
                if inner == begin:
                    return end
                at += 1
            else:
                at = yield self.piece(at)
        raise Stop(n, "((", "end")

    def array(self, at: int):
        text, n, state = self.text, self.n, self.machine.start("array")
        while True:
            while at < n and (text[at].isspace() or text.startswith("\\\n", at)):
                at += 1
            if at >= n:
                raise Stop(n, "(", "end")
            c = text[at]
            if c == ")":
                return at + 1
            if c == "#":
                e = text.find("\n", at)
                at = n if e < 0 else e
                continue
            end = at if c in ";&|<>(" else (yield self.word(at))
            state = state["W" if end > at else c]
            if not state.alive:
                raise Stop(at, c, "token")
            at = end

    def cond(self, at: int):
        """Past the ``]]`` of a conditional expression."""
        text, n, state = self.text, self.n, self.machine.start("cond")
        while True:
            while at < n and (text[at].isspace() or text.startswith("\\\n", at)):
                at += 1
            if at >= n:
                raise Stop(n, "[[", "end")
            begin = at
            if text.startswith("]]", at) and (at + 2 >= n or text[at + 2] in " \t\n;&|)"):
                if not state.complete:
                    raise Stop(at, "]]", "token")
                return at + 2
            if text.startswith(("&&", "||"), at):
                kind, at = text[at:at + 2], at + 2
            elif text[at] in "()":
                kind, at = text[at], at + 1
            elif text[at] in "<>":
                kind, at = "W", at + 1
            elif text[at] in ";&|":
                kind = text[at]
            else:
                regex = text.startswith("=~", at)
                at = yield self.word(at)
                kind = "W"
                if regex:
                    while at < n and text[at] in " \t":
                        at += 1
                    while at < n and not text[at].isspace():
                        at = (yield self.parens(at + 1)) if text[at] == "(" else (yield self.piece(at))
            state = state[kind]
            if not state.alive:
                raise Stop(begin, kind if kind != "W" else text[begin:at], "token")


def make(_: str) -> Shell:
    return Shell()
