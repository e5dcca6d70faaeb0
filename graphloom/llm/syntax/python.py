"""Python 3 with match, by tokens of logical lines."""

from __future__ import annotations

import keyword
import re

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax.base import Kinds, line_of

RULES = r"""
file: stmt* ;
stmt: simple | compound ;
simple: (small % ';') ';'? NEWLINE ;
small: starexprs | assign | 'pass' | 'break' | 'continue' | 'return' starexprs? | 'raise' (expr ('from' expr)?)?
  | ('global' | 'nonlocal') (NAME % ',') | 'del' targets | 'assert' expr (',' expr)? | import | yieldx
  | 'type' NAME typarams? '=' expr ;
import: 'import' (dotted ('as' NAME)? % ',')
  | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported ;
imported: '*' | (NAME ('as' NAME)? % ',') | '(' (NAME ('as' NAME)? % ',') ','? ')' ;
dotted: (NAME % '.') ;
assign: (targets '=')+ (starexprs | yieldx) | single ':' expr ('=' (starexprs | yieldx))?
  | single AUG (starexprs | yieldx) ;
single: NAME | '(' single ')' | atom trailer* member ;
target: '*'? plaintarget ;
plaintarget: NAME | '(' targets? ')' | '[' targets? ']' | atom trailer* member ;
targets: (target % ',') ','? ;
member: '.' NAME | '[' slices ']' ;
yieldx: 'yield' ('from' expr | starexprs)? ;
starexprs: (starexpr % ',') ','? ;
starexpr: '*' arith | expr ;
expr: disj ('if' disj 'else' expr)? | 'lambda' lparams? ':' expr ;
named: NAME ':=' expr | expr ;
starnamed: '*' arith | named ;
disj: (inv % orand) ;
orand: 'and' | 'or' ;
inv: 'not'* (arith % cmp) ;
cmp: CMP | 'in' | 'not' 'in' | 'is' 'not'? ;
arith: (unary % binop) ;
binop: ARITH | '*' | '-' | '**' | '@' | '|' ;
unary: ('-' | PRE)* 'await'? atom trailer* ;
trailer: member | '(' args? ')' ;
args: (arg % ',') ','? ;
arg: starnamed comp? | NAME '=' expr | '**' expr ;
slices: (slice % ',') ','? ;
slice: expr? ':' expr? (':' expr?)? | starnamed ;
atom: NAME | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yieldx | items)? ')' | '[' items? ']'
  | '{' (items | ditem (comp | (',' ditem)* ','?))? '}' ;
items: starnamed (comp | (',' starnamed)* ','?) ;
ditem: expr ':' expr | '**' arith ;
comp: ('async'? 'for' targets 'in' disj ('if' (disj | 'lambda' lparams? ':' expr))*)+ ;
lparams: (lparam % ',') ','? ;
lparam: NAME ('=' expr)? | '/' | '*' NAME? | '**' NAME ;
params: (param % ',') ','? ;
param: NAME (':' expr)? ('=' expr)? | '/' | '*' (NAME (':' starexpr)?)? | '**' NAME (':' expr)? ;
typarams: '[' (typaram % ',') ','? ']' ;
typaram: ('*' | '**')? NAME (':' expr)? ('=' expr)? ;
block: NEWLINE INDENT stmt+ DEDENT | simple ;
compound: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
  | 'while' named ':' block ('else' ':' block)?
  | 'async'? 'for' targets 'in' starexprs ':' block ('else' ':' block)?
  | 'try' ':' block (('except' '*'? (expr ('as' NAME)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)?
      | 'finally' ':' block)
  | 'async'? 'with' ((withitem % ',') | '(' (withitem % ',') ','? ')') ':' block
  | ('@' named NEWLINE)* ('async'? 'def' NAME typarams? '(' params? ')' ('->' expr)? ':' block
      | 'class' NAME typarams? ('(' args? ')')? ':' block)
  | 'match' (starnamed % ',') ','? ':' NEWLINE INDENT case+ DEDENT ;
withitem: expr ('as' target)? ;
case: 'case' patterns ('if' named)? ':' block ;
patterns: (patstar % ',') ','? ;
patstar: '*' NAME | pattern ;
pattern: (closed % '|') ('as' NAME)? ;
closed: literal | dotted ('(' ((patarg % ',') ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']'
  | '{' ((mapitem % ',') ','?)? '}' ;
literal: '-'? NUM (('-' | PRE) NUM)? | STR+ | 'None' | 'True' | 'False' ;
patarg: (NAME '=')? pattern ;
mapitem: (literal | dotted) ':' pattern | '**' NAME ;
"""

_DQ3 = r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
_SQ3 = r"'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
_PLAIN = rf'(?:[rRbBuU]|[rR][bB]|[bB][rR])?(?:{_DQ3}|{_SQ3}|"(?:[^"\\\n]|\\.)++"|""(?!")|\'(?:[^\'\\\n]|\\.)++\'|\'\'(?!\'))'
_HOLE = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_FMT = (
    r"(?:[fF][rR]?|[rR][fF])(?:"
    rf'"""(?:[^"\\{{]|\\.|\{{\{{|{_HOLE}|"(?!""))*+"""'
    rf"|'''(?:[^'\\{{]|\\.|\{{\{{|{_HOLE}|'(?!''))*+'''"
    rf'|"(?:[^"\\\n{{]|\\.|\{{\{{|{_HOLE})++"|""(?!")'
    rf"|'(?:[^'\\\n{{]|\\.|\{{\{{|{_HOLE})++'|''(?!'))"
)
_NUM = r"(?:0[xXbBoO][\da-fA-F_]++|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?[jJ]?)"
_OP = r"\*\*=?|//=?|>>=?|<<=?|\.\.\.|->|:=|[-+*/%@&|^=!<>]=|[-+*/%@&|^~<>=()\[\]{},:;.]"
TOKEN = re.compile(
    rf"(?:[ \t\f]|\\\n)*+((?:\n\s*+)?(?:{_PLAIN}|{_FMT}|[^\W\d]\w*+|{_NUM}|#[^\n]*+|{_OP}|\S))", re.S
)
_STRING = re.compile(rf"(?:{_PLAIN})\Z|(?:{_FMT})\Z", re.S)
_FMT_OPEN = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|\'\'\'|\"|\')")
_STR = re.compile(_PLAIN, re.S)
_NAME = re.compile(r"[^\W\d]\w*|\d\w*")
_CONVERSION = re.compile(r"\s*![^\W\d]\w*\s*(?=[:}])")
_CMP = {"==", "!=", "<", ">", "<=", ">="}
_AUG = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
_ARITH = {"//", "%", "&", "^", "<<", ">>"}
_ASIS = {"(", ")", "[", "]", "{", "}", ",", ":", ";", ".", "...", "=", "->", ":=", "*", "**", "-", "@", "|", "/"}
_SOFT = {"match", "case", "type", "_"}


class Python:
    def __init__(self):
        also = {k: ("NAME",) for k in _SOFT} | {"+": ("ARITH", "PRE"), "~": ("PRE",), "/": ("ARITH",)}
        self.machine = Machine(Grammar(RULES, "file", also), closers=(")", "]", "}"))
        self.kinds = Kinds(self._kind)

    def _kind(self, token: str):
        if token[0] == "\n":
            body = token.lstrip()
            lead = token[: len(token) - len(body)]
            width = len(lead[lead.rfind("\n") + 1:].replace("\f", "").expandtabs(8))
            return (width, self.kinds[body])
        c = token[0]
        if c == "#":
            return None
        if token[-1] in "\"'":
            return self._string(token)
        if c == "_" or c.isalpha():
            if keyword.iskeyword(token):
                return token
            return token if token in _SOFT else "NAME"
        if c.isdigit() or c == "." and token != "." and token != "...":
            return "NUM" if not re.fullmatch(r"0[\d_]*[1-9][\d_]*", token) else "BAD"
        if token in _ASIS or token in "+~":
            return token
        for name, group in (("CMP", _CMP), ("AUG", _AUG), ("ARITH", _ARITH)):
            if token in group:
                return name
        return "NAME" if token.isidentifier() else "BAD"

    def _string(self, token: str) -> str:
        if not _STRING.match(token):
            return "BAD"
        quote = min(i for i in (token.find('"'), token.find("'")) if i >= 0)
        if "f" not in token[:quote].lower() or "{" not in token:
            return "STR"
        body = token[quote:]
        n = 3 if len(body) >= 6 and body[:3] in ('"""', "'''") else 1
        return "STR" if self._holes(body[n:-n]) else "BAD"

    def _holes(self, body: str) -> bool:
        """Whether the replacement fields of a formatted string hold expressions."""
        i, n = 0, len(body)
        while i < n:
            c = body[i]
            if c == "}":
                if body[i:i + 2] != "}}":
                    return False
                i += 2
            elif c != "{":
                i += 1
            elif body[i:i + 2] == "{{":
                i += 2
            else:
                end, depth, quote, cut = i + 1, 0, "", -1
                while end < n:
                    d = body[end]
                    if quote:
                        quote = "" if d == quote else quote
                    elif d in "\"'" and cut < 0:
                        quote = d
                    elif d in "([{":
                        depth += 1
                    elif d in ")]}" and depth:
                        depth -= 1
                    elif d == "}":
                        break
                    elif cut < 0 and not depth and (d == ":" or d == "!" and body[end:end + 2] != "!="):
                        cut = end
                    end += 1
                if end >= n:
                    return False
                inner = (body[i + 1:cut] if cut > 0 else body[i + 1:end]).rstrip()
                if inner.endswith("=") and inner[-2:-1] not in ("=", "!", "<", ">"):
                    inner = inner[:-1]
                if not self._expression(inner):
                    return False
                i = end + 1
        return True

    def _expression(self, inner: str) -> bool:
        state = self.machine.start("small")
        for t in TOKEN.findall("(" + inner + ")"):
            k = self.kinds[t]
            state = state[k[1] if k.__class__ is tuple else k]
        return state.complete

    def _deep_end(self, text: str, m: re.Match) -> int:
        """End of the formatted string that ``m`` opens, by a stack of strings, fields and formats; -1 if it is none.

        A field keeps the pieces of its expression, with an empty string for each formatted one.
        """
        stack: list[list] = [["string", m.group(1)]]
        i, n = m.end(), len(text)
        while i < n:
            top, c = stack[-1], text[i]
            if top[0] == "string":
                quote = top[1]
                if c == "\\" or text.startswith(("{{", "}}"), i):
                    i += 2
                elif text.startswith(quote, i):
                    i += len(quote)
                    stack.pop()
                    if not stack:
                        return i
                    stack[-1][2].append("''")
                elif c == "}" or c == "\n" and len(quote) == 1:
                    return -1
                else:
                    i += 1
                    if c == "{":
                        stack.append(["field", 0, []])
            elif top[0] == "format":
                i += 1
                if c == "{":
                    stack.append(["field", 0, []])
                elif c == "}":
                    stack.pop()
                elif c == "\n" or c in "\"'" and top[1] == c:
                    return -1
            else:
                pieces = top[2]
                conversion = _CONVERSION.match(text, i) if not top[1] else None
                if conversion or not top[1] and c in ":}":
                    inner = "".join(pieces).rstrip()
                    if inner.endswith("=") and inner[-2:-1] not in ("=", "!", "<", ">"):
                        inner = inner[:-1]
                    if not self._expression(inner):
                        return -1
                    i = conversion.end() if conversion else i
                    stack.pop()
                    if text[i] == ":":
                        stack.append(["format", next(x[1] for x in reversed(stack) if x[0] == "string")])
                    i += 1
                    continue
                inside = _FMT_OPEN.match(text, i)
                if inside:
                    stack.append(["string", inside.group(1)])
                    i = inside.end()
                    continue
                word = _STR.match(text, i) or _NAME.match(text, i)
                if word:
                    pieces.append(word.group())
                    i = word.end()
                    continue
                top[1] += (c in "([{") - (c in ")]}")
                pieces.append(c)
                i += 1
        return -1

    def _flat(self, text: str) -> str:
        """The text with empty strings for formatted ones that the pattern of tokens is not exact for."""
        out, at, done = [], 0, 0
        while m := TOKEN.match(text, at):
            at = m.end()
            start = at - len(m.group(1).lstrip())
            opened = _FMT_OPEN.match(text, start)
            if opened and self.kinds[m.group(1).lstrip()] != "STR":
                end = self._deep_end(text, opened)
                if end > 0:
                    lines = text.count("\n", start, end)
                    out += [text[done:start], "''" if not lines else "\"\"\"" + "\n" * lines + "\"\"\""]
                    at = done = end
        return "".join([*out, text[done:]])

    def _first_failure(self, text: str):
        row, indents, started = self.machine.start(), [0], False
        for m in TOKEN.finditer("\n" + text):
            k = self.kinds[m.group(1)]
            if k.__class__ is tuple:
                width, k = k
                if k is None:
                    continue
                if not row.inside:
                    for x in self._line(width, indents, started):
                        row = row[x]
                    started = True
            if k is not None:
                row = row[k]
                if not row.alive:
                    return line_of(text, max(0, m.end() - 1)), m.group(1).strip()[:80], "token"
        return None

    @staticmethod
    def _line(width: int, indents: list[int], started: bool) -> list[str]:
        out = ["NEWLINE"] if started else []
        if width > indents[-1]:
            indents.append(width)
            out.append("INDENT")
        else:
            while width < indents[-1]:
                indents.pop()
                out.append("DEDENT")
            if width != indents[-1]:
                out.append("BAD")
        return out

    def failure(self, text: str):
        found = self._failure(text)
        if found and _FMT_OPEN.search(text) and (flat := self._flat(text)) != text:
            return self._failure(flat)
        return found

    def _failure(self, text: str):
        row, kinds, indents, started = self.machine.start(), self.kinds, [0], False
        for t in TOKEN.findall("\n" + text):
            k = kinds[t]
            if k.__class__ is tuple:
                width, k = k
                if k is None:
                    continue
                if not row.inside:
                    if width == indents[-1]:
                        if started:
                            row = row["NEWLINE"]
                    else:
                        for x in self._line(width, indents, started):
                            row = row[x]
                    started = True
            if k is not None:
                row = row[k]
        if row.alive:
            if started:
                row = row["NEWLINE"]
                for _ in indents[1:]:
                    row = row["DEDENT"]
            if row.complete:
                return None
            return line_of(text, len(text.rstrip())), "", "end"
        return self._first_failure(text) or (line_of(text, len(text.rstrip())), "", "end")


def make(_: str) -> Python:
    return Python()
