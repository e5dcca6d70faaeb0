"""Rust 2021."""

from __future__ import annotations

import re

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax.base import Kinds, line_of

RULES = r"""
file: inner* item* ;
inner: '#' '!' '[' tt* ']' ;
attr: '#' '[' tt* ']' ;
tt: ANY | '(' tt* ')' | '[' tt* ']' | '{' tt* '}' ;
group: '(' tt* ')' | '[' tt* ']' | '{' tt* '}' ;
item: attr* vis? (fn | struct | enum | trait | impl | alias | const | static | mod | use | extern) | attr* macroitem ;
vis: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')? | 'crate' ;
macroitem: path '!' NAME? ('{' tt* '}' | ('(' tt* ')' | '[' tt* ']') ';') ;
fn: ('const' | 'async' | 'unsafe' | 'safe' | 'extern' STR?)* 'fn' NAME generics? '(' ((fnparam % ',') ','?)? ')' ('->' type)?
  where? (block | ';') ;
fnparam: attr* ('&' LIFE? 'mut'? 'self' | 'mut'? 'self' (':' type)? | patone ':' ('...' | type) | '...') ;
struct: ('struct' | 'union') NAME generics? (where? '{' fields? '}' | '(' tfields? ')' where? ';' | where? ';') ;
fields: (attr* vis? NAME ':' type % ',') ','? ;
tfields: (attr* vis? type % ',') ','? ;
enum: 'enum' NAME generics? where? '{' ((variant % ',') ','?)? '}' ;
variant: attr* vis? NAME ('{' fields? '}' | '(' tfields? ')')? ('=' expr)? ;
trait: 'unsafe'? 'auto'? 'trait' NAME generics? (':' bounds?)? where? ('{' inner* assoc* '}' | '=' bounds ';') ;
impl: 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' inner* assoc* '}' ;
assoc: attr* vis? 'default'? (fn | const | alias) | attr* macroitem ;
alias: 'type' NAME generics? (':' bounds?)? where? ('=' type)? where? ';' ;
const: 'const' (NAME | '_') generics? ':' type ('=' expr)? ';' ;
static: 'static' 'mut'? NAME ':' type ('=' expr)? ';' ;
mod: 'unsafe'? 'mod' NAME (';' | '{' inner* item* '}') ;
use: 'use' tree ';' ;
tree: '::'? (seg '::')* (seg ('as' (NAME | '_'))? | '*' | '{' ((tree % ',') ','?)? '}') ;
extern: 'extern' 'crate' (NAME | 'self') ('as' (NAME | '_'))? ';' | 'unsafe'? 'extern' STR? '{' inner* extitem* '}' ;
extitem: attr* vis? (fn | static | alias) | attr* macroitem ;
generics: '<' ((gparam % ',') ','?)? '>' ;
gparam: attr* (LIFE (':' (LIFE % '+')?)? | NAME (':' bounds?)? ('=' type)? | 'const' NAME ':' type ('=' (block | '-'? lit | path))?) ;
where: 'where' ((wpred % ',') ','?)? ;
wpred: LIFE ':' (LIFE % '+')? | forlt? type ':' bounds? ;
forlt: 'for' generics ;
bounds: (bound % '+') '+'? ;
bound: LIFE | ('?' | '~' 'const' | 'async')? forlt? path | '(' bound ')' | 'use' '<' ((garg % ',') ','?)? '>' ;
type: '(' ((type % ',') ','?)? ')' | '!' | '&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']'
  | path ('+' bounds)? ('!' group)? | ('impl' | 'dyn') bounds | qpath | '_'
  | forlt? 'unsafe'? ('extern' STR?)? 'fn' '(' ((attr* ((NAME | '_') ':')? (type | '...') % ',') ','?)? ')' ('->' type)? ;
qpath: '<' type ('as' path)? '>' ('::' pseg)+ ;
path: '::'? pseg ('::' pseg)* ;
pseg: seg ('::'? gargs | '(' ((type % ',') ','?)? ')' ('->' type)?)? ;
seg: NAME | 'self' | 'Self' | 'super' | 'crate' | '$' 'crate' ;
gargs: '<' ((garg % ',') ','?)? '>' ;
garg: LIFE | type | pseg ('=' (type | lit) | ':' bounds) | '-'? lit | block ;
block: '{' inner* stmt* (attr* expr)? '}' ;
stmt: ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* blocky | attr* expr ';' ;
blocky: (LIFE ':')? (block | 'loop' block | 'while' expr block | 'for' pattern 'in' expr block)
  | ('unsafe' | 'const' | 'async' 'move'? | 'try') block | if | 'match' expr '{' inner* arms? '}' | epath '!' '{' tt* '}' ;
if: 'if' expr block ('else' (if | block))? ;
arms: (armhead (expr ',' | blocky ','?))* (armhead expr)? ;
armhead: attr* pattern ('if' expr)? '=>' ;
expr: rel (low rel | range rel?)* | range (rel (low rel)*)? ;
range: '..' | '..=' ;
rel: arith (cmp arith)? ;
arith: operand (high operand)* ;
low: SET | '=' | '&' '&' | '|' '|' | '>' '>' '=' ;
cmp: CMP | '<' | '>' '='? ;
high: BIN | '*' | '-' | '+' | '&' | '|' | '<' '<' | '>' '>' ;
operand: ('-' | '!' | '*' | '&' ('mut' | 'raw' ('const' | 'mut'))?)* primary suffix* | closure | 'return' expr?
  | 'break' LIFE? expr? | 'continue' LIFE? | 'let' pattern '=' operand | 'yield' expr? ;
closure: ('static' | 'async' | 'move' | 'const')* '|' ((attr* patone (':' type)? % ',') ','?)? '|' ('->' type block | expr) ;
suffix: '?' | '.' (NAME ('::' gargs)? | NUM | 'await') | '(' ((attr* expr % ',') ','?)? ')' | '[' expr ']' | 'as' type ;
primary: lit | epath ('!' group | '{' ((sfield % ',') ','?)? '}')? | '(' ((attr* expr % ',') ','?)? ')'
  | '[' (expr ';' expr | (attr* expr % ',') ','?)? ']' | blocky | '_' ;
sfield: attr* (NAME | NUM) (':' expr)? | '..' expr? ;
epath: '::'? seg ('::' (seg | gargs))* | '<' type ('as' path)? '>' ('::' (seg | gargs))+ ;
lit: NUM | STR | CHAR | 'true' | 'false' ;
pattern: '|'? (patone % '|') ;
patone: ('ref' | 'mut')* NAME ('@' patone)? | patlit (range patlit?)? | range patlit? | '_' | '&' 'mut'? patone
  | '(' ((pattern % ',') ','?)? ')' | '[' ((pattern % ',') ','?)? ']'
  | epath ('!' group | '(' ((pattern % ',') ','?)? ')' | '{' ((fieldpat % ',') ','?)? '}')? | 'box' patone | 'const' block ;
patlit: '-'? lit | epath ;
fieldpat: attr* ('..' | ('ref' | 'mut' | 'box')* NAME | (NAME | NUM) ':' pattern) ;
"""

_KEYWORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub "
    "ref return self Self static struct super trait true type unsafe use where while yield box".split()
)
_SOFT = set("union auto default raw safe try".split())
_OP = (
    r"<<=|>>=|\.\.\.|\.\.=|\.\.|::|->|=>|==|!=|<=(?!=)|[-+*/%^&|]=|[-+*/%^&|!<>=@.,;:#$?~(){}\[\]]"
)
_RAW = "|".join(rf'[bc]?r{"#" * n}"(?:[^"]|"(?!{"#" * n}))*+"{"#" * n}' for n in (1, 2, 3, 4)) + r'|[bc]?r"[^"]*+"'
_BLOCK = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/)*+\*/"
_NUM = (
    r"0[xob][\da-fA-F_]++(?:[iu](?:8|16|32|64|128|size))?"
    r"|\d[\d_]*+(?:\.(?![._\w])|\.\d[\d_]*+)?(?:[eE][+-]?_*\d[\d_]*+)?_?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?"
)
TOKEN = re.compile(
    rf"\s*+({_RAW}|[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{{2}}|u\{{[\da-fA-F_]+\}}|[^\n]))'"
    rf"|'[^\W\d]\w*+(?!')|r\#[^\W\d]\w*+|[^\W\d]\w*+|{_NUM}|//[^\n]*+|{_BLOCK}|{_OP}|\S)"
)
#: What the patterns above are not exact for: comments in comments, and raw strings with more marks.
_DEEP = re.compile(r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+/\*|r#####+\"")
_DEEP_RAW = re.compile(r"[bc]?r(#{5,})\"")
_ENDS = re.compile(r"/\*|\*/")
_BIN = {"/", "%", "^"}
_CMP = {"==", "!=", "<="}
_SET = {"+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}


class Rust:
    def __init__(self):
        also = {x: (n,) for n, items in (("BIN", _BIN), ("CMP", _CMP), ("SET", _SET)) for x in items} | {x: ("NAME",) for x in _SOFT}
        self.machine = Machine(Grammar(RULES, "file", also, any_but=("ANY", frozenset("()[]{}") | {"BAD"})))
        self.kinds = Kinds(self._kind)

    def _kind(self, token: str):
        if token.startswith(("//", "/*")):
            return None
        c = token[0]
        if token[-1] == '"' or c == "r" and token[-1] == "#" and '"' in token or c in "bc" and token[-1] == "#":
            return "STR" if len(token) > 1 else "BAD"
        if c == "'" or token.startswith("b'"):
            return "BAD" if len(token) == 1 else "CHAR" if token[-1] == "'" else "LIFE"
        if c.isdigit():
            return "NUM"
        if c.isalpha() or c == "_":
            return token if token in _KEYWORDS or token in _SOFT or token == "_" else "NAME"
        return token if re.fullmatch(_OP, token) else "BAD"

    def _scan(self, text: str):
        """Token by token, comments by their depth and raw strings by their number of marks."""
        row, at = self.machine.start(), 0
        while m := TOKEN.match(text, at):
            start, at = m.start(1), m.end()
            kind = self.kinds[m.group(1)]
            raw = _DEEP_RAW.match(text, start)
            if raw:
                end = text.find('"' + raw.group(1), raw.end())
                kind, at = ("STR", end + 1 + len(raw.group(1))) if end >= 0 else ("BAD", at)
            elif text.startswith("/*", start):
                depth = 0
                for e in _ENDS.finditer(text, start):
                    depth += 1 if e.group() == "/*" else -1
                    if not depth:
                        break
                kind, at = (None, e.end()) if not depth else ("BAD", at)
            row = row[kind]
            if not row.alive:
                return line_of(text, at - 1), text[start:at][:80], "token"
        return None if row.complete else (line_of(text, len(text.rstrip())), "", "end")

    def failure(self, text: str):
        if text.startswith("#!") and not text.startswith("#!["):
            text = "//" + text
        row, kinds = self.machine.start(), self.kinds
        if _DEEP.search(text):
            return self._scan(text)
        for t in TOKEN.findall(text):
            row = row[kinds[t]]
        if row.complete:
            return None
        if not row.alive:
            row = self.machine.start()
            for m in TOKEN.finditer(text):
                row = row[kinds[m.group(1)]]
                if not row.alive:
                    return line_of(text, m.end() - 1), m.group(1)[:80], "token"
        return line_of(text, len(text.rstrip())), "", "end"


def make(_: str) -> Rust:
    return Rust()
