"""Go, with the semicolons that its lexical rules insert."""

from __future__ import annotations

import re

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax.base import Kinds, line_of

RULES = r"""
file: 'package' NAME ';' (import ';')* (top ';')* ;
import: 'import' (ispec | '(' (ispec ';')* ispec? ')') ;
ispec: ('.' | NAME)? STR ;
top: decl | 'func' params? NAME tparams? sig block? ;
decl: 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'var' (vspec | '(' (vspec ';')* vspec? ')')
  | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
cspec: (NAME % ',') (type? '=' exprs)? ;
vspec: (NAME % ',') (type ('=' exprs)? | '=' exprs) ;
tspec: NAME tparams? '='? type ;
tparams: '[' ((NAME % ',') union % ',') ','? ']' ;
sig: params (params | type)? ;
params: '(' ((param % ',') ','?)? ')' ;
param: NAME? '...'? type ;
type: (NAME % '.') targs? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type
  | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | struct | iface | '(' type ')' ;
targs: '[' (type % ',') ','? ']' ;
struct: 'struct' '{' (field ';')* field? '}' ;
field: ((NAME % ',') type | '*'? (NAME % '.') targs?) STR? ;
iface: 'interface' '{' (imember ';')* imember? '}' ;
imember: NAME sig | union ;
union: ('~'? type % '|') ;
block: '{' stmts '}' ;
stmts: (stmt? ';')* stmt? ;
stmt: decl | simple | ('go' | 'defer') expr | 'return' exprs? | ('break' | 'continue') NAME? | 'goto' NAME
  | 'fallthrough' | block | if | NAME ':' stmt?
  | 'switch' (simple? ';')? simple? '{' (('case' targlist | 'default') ':' stmts)* '}'
  | 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
  | 'for' (expr | simple? ';' expr? ';' simple? | (exprs (':=' | '='))? 'range' expr)? block ;
simple: exprs ((':=' | '=' | ASSIGN) exprs | '++' | '--' | '<-' expr)? ;
if: 'if' (simple? ';')? simple block ('else' (if | block))? ;
targlist: (exprortype % ',') ;
exprs: (expr % ',') ;
expr: (unary % bin) ;
bin: BIN | '*' | '|' | '-' | '+' | '&' ;
unary: ('*' | '-' | '+' | '&' | '<-' | '!' | '^')* operand suffix* ;
operand: NAME | NUM | STR | CHAR | '(' exprortype ')' | 'func' sig block | ctype litvalue? ;
ctype: '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | struct | iface ;
exprortype: expr | type ;
suffix: '.' NAME | '.' '(' (type | 'type') ')' | '[' ((exprortype % ',') ','? | expr? ':' expr? (':' expr)?) ']'
  | '(' ((exprortype % ',') '...'? ','?)? ')' | litvalue ;
litvalue: '{' ((elem % ',') ','?)? '}' ;
elem: (elemval ':')? elemval ;
elemval: expr | litvalue ;
"""

_KEYWORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package "
    "range return select struct switch type var".split()
)
_ENDS = {"NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_OP = r"\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|:=|<<|>>|&\^|[=!<>+\-*/%&|^]=|[-+*/%&|^~<>=!()\[\]{},;.:]"
TOKEN = re.compile(
    r"[^\S\n]*+((?:\n\s*+)?(?:[^\W\d]\w*+|\"(?:[^\"\\\n]|\\[^\n])*+\"|`[^`]*+`|'(?:[^'\\\n]|\\[^\n])[^'\n]{0,10}'"
    r"|0[xXbBoO][\da-fA-F_.]++(?:[pP][+-]?\d+)?i?|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][+-]?\d++)?i?"
    rf"|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|{_OP}|\S))"
)
_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}
_BIN = {"==", "!=", "<", "<=", ">", ">=", "/", "%", "<<", ">>", "&^", "&&", "||", "^"}


class Go:
    def __init__(self):
        also = {x: ("BIN",) for x in _BIN} | {x: ("ASSIGN",) for x in _ASSIGN}
        self.machine = Machine(Grammar(RULES, "file", also))
        self.kinds = Kinds(self._kind)

    def _kind(self, token: str):
        if token[0] == "\n":
            return (self.kinds[token.lstrip()],)
        if token.startswith(("//", "/*")):
            return None
        c = token[0]
        if c.isalpha() or c == "_":
            return token if token in _KEYWORDS else "NAME"
        if c in "\"`":
            return "STR" if len(token) > 1 else "BAD"
        if c == "'":
            return "CHAR" if len(token) > 1 else "BAD"
        if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            return "NUM"
        return token if re.fullmatch(_OP, token) else "BAD"

    def _steps(self, text: str):
        """(kind, match) with inserted semicolons."""
        last = None
        for m in TOKEN.finditer(text):
            k = self.kinds[m.group(1)]
            if k.__class__ is tuple:
                k = k[0]
                if last in _ENDS:
                    yield ";", m
                    last = ";"
            if k is not None:
                last = k
                yield k, m

    def failure(self, text: str):
        row, kinds, last, ends = self.machine.start(), self.kinds, None, _ENDS
        for t in TOKEN.findall(text):
            k = kinds[t]
            if k.__class__ is tuple:
                if last in ends:
                    row = row[";"]
                    last = ";"
                k = k[0]
            if k is not None:
                row = row[k]
                last = k
        if row.alive:
            if last in ends:
                row = row[";"]
            return None if row.complete else (line_of(text, len(text.rstrip())), "", "end")
        row = self.machine.start()
        for k, m in self._steps(text):
            row = row[k]
            if not row.alive:
                return line_of(text, m.end() - 1), m.group(1).strip()[:80], "token"
        return line_of(text, len(text.rstrip())), "", "end"


def make(_: str) -> Go:
    return Go()
