"""ECMAScript modules, TypeScript and TSX: one grammar with optional parts."""

from __future__ import annotations

import re

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax.base import Kinds, line_of

#: <TS ... > parts hold for TypeScript and TSX, <JSX ... > for TSX, <CAST ... > for TypeScript.
#: Rules with a suffix are the same rule with a restricted first token: _b not "{", _s also
#: not "function" or "class".
RULES = r"""
program: item* ;
item: import | export | sitem <TS | ambient > ;
sitem: stmt | funcd | class | lexical <TS | interface | alias | enum | namespace > ;
eos: ';' | ASI ;
block: '{' sitem* '}' ;
lexical: 'const' (constd % ',') eos | 'let' (letd % ',') eos ;
constd: binding <TS '!'? annot? > '=' assign ;
letd: NAME <TS '!'? annot? > ('=' assign)? | pattern <TS annot? > '=' assign ;
stmt: block | ';' | expr_s eos | NAME ':' stmt | 'debugger' eos | 'var' (letd % ',') eos
  | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt
  | 'do' stmt 'while' '(' expr ')' eos? | 'for' 'await'? '(' forhead ')' stmt
  | ('continue' | 'break') NAME? eos | 'return' expr? eos | 'throw' expr eos
  | 'try' block ('catch' ('(' binding <TS annot? > ')')? block ('finally' block)? | 'finally' block)
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' sitem*)* '}' ;
forhead: (expr | 'var' (letd % ',') | 'let' (letd % ',') | 'const' (constd % ','))? ';' expr? ';' expr?
  | ('var' | 'let' | 'const') binding <TS annot? > ('of' assign | 'in' expr) | unary ('of' assign | 'in' expr) ;
binding: NAME | pattern ;
pattern: '{' ((pprop % ',') ','?)? '}' | '[' ','* (pelem (','+ pelem)* ','*)? ']' ;
pprop: propname ':' binding ('=' assign)? | NAME ('=' assign)? | '...' binding ;
pelem: '...'? binding ('=' assign)? ;
expr: (assign % ',') ;
expr_s: assign_s (',' assign)* ;
assign: unary tail ;
assign_b: unary_b tail ;
assign_s: unary_s tail ;
tail: (binop unary <TS | ('as' | 'satisfies') (type | 'const') >)* ('?' assign ':' assign)? ;
binop: BIN | '=' | '*' | '+' | '-' | '/' | '<' | '>' ('>' '>'?)? '='? | 'in' | '|' | '&' ;
unary: prefix* postfix | arrow | 'yield' ('*'? assign)? ;
unary_b: prefix+ postfix | postfix_b | arrow | 'yield' ('*'? assign)? ;
unary_s: prefix+ postfix | postfix_s | arrow | 'yield' ('*'? assign)? ;
prefix: PRE | '+' | '-' | '++' | '--' | 'new' | 'await' <CAST | targs > ;
postfix: primary suffix* ('++' | '--')? ;
postfix_b: primary_b suffix* ('++' | '--')? ;
postfix_s: primary_s suffix* ('++' | '--')? ;
arrow: 'async'? (NAME | <TS tparams? > params <TS rtype? >) '=>' (block | assign_b) ;
suffix: '.' (IDN | PRIVATE) | '?.' (IDN | PRIVATE | '[' expr ']' | args | <TS targs args > <JS PRIVATE >) | '[' expr ']'
  | args | TPL <TS | '!' | targs (args | TPL) > ;
args: '(' ((arg % ',') ','?)? ')' ;
arg: '...'? assign ;
primary: object | primary_b ;
primary_b: func | classx | primary_s ;
primary_s: NAME | NUM | STR | REGEX | TPL | CONST | 'this' | 'super' | PRIVATE | '(' expr ')' | array
  | 'import' (args | '.' IDN) | 'new' '.' IDN <JSX | element > ;
array: '[' ','* (arg (','+ arg)* ','*)? ']' ;
object: '{' ((prop % ',') ','?)? '}' ;
prop: propname ':' assign | NAME ('=' assign)? | '...' assign | method ;
propname: IDN | STR | NUM | '[' assign ']' ;
method: ('async'? '*'? | 'get' | 'set') propname <TS '?'? tparams? > params <TS rtype? > block ;
params: '(' ((param % ',') ','?)? ')' ;
param: deco* <TS ('public' | 'private' | 'protected' | 'readonly' | 'override')* > '...'? binding <TS '?'? annot? > ('=' assign)?
  <TS | 'this' annot > ;
deco: '@' primary_s suffix* ;
funcd: 'async'? 'function' '*'? NAME <TS tparams? > params <TS rtype? > (block <TS | eos >) ;
func: 'async'? 'function' '*'? NAME? <TS tparams? > params <TS rtype? > (block <TS | eos >) ;
class: deco* <TS 'abstract'? > 'class' NAME ctail ;
classa: deco* <TS 'abstract'? > classx ;
classx: 'class' NAME? ctail ;
ctail: <TS tparams? > ('extends' primary suffix* <TS targs? >)? <TS ('implements' (type % ','))? > '{' member* '}' ;
member: ';' | 'static' block | deco* mod* (('async'? '*'? | 'get' | 'set') mname <TS '?'? tparams? > params <TS rtype? > (block <TS | eos >)
  | mname <TS ('?' | '!')? annot? > ('=' assign)? eos) <TS | mod* '[' NAME annot ']' annot eos > ;
mname: propname | PRIVATE ;
mod: 'static' | 'accessor' <TS | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' > ;
import: 'import' STR attrs? eos | 'import' <TS 'type'? > clause 'from' STR attrs? eos
  <TS | 'import' NAME '=' ('require' '(' STR ')' | (NAME % '.')) eos > ;
attrs: ('with' | 'assert') object ;
clause: NAME (',' (ns | names))? | ns | names ;
ns: '*' 'as' NAME ;
names: '{' ((spec % ',') ','?)? '}' ;
spec: <TS 'type'? > (IDN | STR) ('as' (IDN | STR))? ;
export: 'export' ('*' ('as' (IDN | STR))? 'from' STR attrs? eos | <TS 'type'? > names ('from' STR attrs?)? eos
  | funcd | class | lexical | 'var' (letd % ',') eos | 'default' (func | classa | assign_s eos | object suffix* tail eos)
  <TS | interface | alias | enum | namespace | ambient | 'default' interface | '=' expr eos | 'as' 'namespace' NAME eos
      | 'type' '*' ('as' NAME)? 'from' STR eos >) ;
<TS
annot: ':' type ;
rtype: ':' (type | predicate) ;
predicate: 'asserts' (NAME | 'this') ('is' type)? | (NAME | 'this') 'is' type ;
type: union ('extends' union '?' type ':' type)? | tparams? params '=>' (type | predicate)
  | 'abstract'? 'new' tparams? params '=>' type ;
union: '|'? (inter % '|') ;
inter: '&'? (typeop % '&') ;
typeop: ('keyof' | 'unique' | 'readonly')* (artype | 'infer' NAME ('extends' union)?) ;
artype: primtype ('[' type? ']')* ;
primtype: '(' type ')' | (NAME | 'this' | 'void') ('.' IDN)* targs? | CONST | STR | '-'? NUM | TPL | objtype | tuple
  | 'typeof' (NAME | 'this' | 'import' '(' type ')') ('.' IDN)* targs? | 'import' '(' type ')' ('.' IDN)* targs? ;
objtype: '{' (tmember (';' | ',' | ASI))* tmember? '}' ;
tmember: ('get' | 'set')? 'readonly'? propname '?'? tparams? params rtype? | 'readonly'? propname '?'? annot?
  | 'new'? tparams? params rtype? | ('+' | '-')? 'readonly'? '[' NAME ('in' type ('as' type)? ']' (('+' | '-')? '?')? annot? | annot ']' annot) ;
tuple: '[' ((telem % ',') ','?)? ']' ;
telem: '...'? (IDN '?'? ':')? type '?'? ;
tparams: '<' (tparam % ',') ','? '>' ;
tparam: ('const' | 'in' | 'out')* NAME ('extends' type)? ('=' type)? ;
targs: '<' (type % ',') ','? '>' ;
interface: 'interface' NAME tparams? ('extends' (type % ','))? objtype ;
alias: 'type' NAME tparams? '=' type eos ;
enum: 'const'? 'enum' NAME '{' ((emember % ',') ','?)? '}' ;
emember: propname ('=' assign)? ;
namespace: ('namespace' | 'module') ((NAME % '.') | STR) '{' item* '}' ;
ambient: 'declare' (funcd | class | interface | alias | enum | 'module' STR eos
  | (('namespace' | 'module') ((NAME % '.') | STR) | 'global') '{' (item | 'export'? unset)* '}' | unset) ;
unset: ('const' | 'let' | 'var') (binding annot? ('=' assign)? % ',') eos ;
>
<JSX
element: '<' (tag targs? attr* ('/' '>' | '>' child* '<' '/' tag '>') | '>' child* '<' '/' '>') ;
tag: jid (':' jid | ('.' IDN)+)? ;
jid: IDN ('-' (IDN | NUM))* ;
attr: jid (':' jid)? ('=' (STR | '{' assign '}' | element))? | '{' '...' assign '}' ;
child: JSXTEXT | '{' ('...'? expr)? '}' | element ;
>
"""

RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with false enum"
).split()
CONTEXTUAL = (
    "as async await from get let of set static yield accessor assert target type interface namespace module declare "
    "abstract public private protected readonly override implements is asserts keyof unique infer satisfies require "
    "global out"
).split()

_S2, _S1 = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
_T0 = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+`"


def _template(inner: str) -> str:
    """A template literal whose substitutions hold templates of the form ``inner``."""
    flat = rf"[^{{}}`\"']|{_S2}|{_S1}|{inner}"
    one = rf"\{{(?:{flat})*+\}}"
    two = rf"\{{(?:{flat}|{one})*+\}}"
    three = rf"\{{(?:{flat}|{two})*+\}}"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${three})*+`"


_TPL = _template(_template(_T0))
_NUM = r"0[xXbBoO][\da-fA-F_]++n?|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?n?"
_RE = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+"
_IDENT = r"(?:[^\W\d]|[$\\])[\w$\\]*+"
_OP = (
    r"=>|\?\.(?!\d)|\.\.\.|===?|!==?|\*\*=?|&&=?|\|\|=?|\?\?=?|\+\+|--|<<=?|<=|[-+*/%&|^]=|[-+*/%&|^!~?:=.,;@(){}\[\]<>]"
)
_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
_AFTER = r"[(,=:\[!&|?{;+\-*%^~]|\b(?:return|typeof|case|in|of|delete|void|throw|else|do|await|yield)\b"
TOKEN = re.compile(
    rf"[^\S\n]*+((?:\n\s*+)?(?:(?:{_AFTER})\s*+{_RE}|{_IDENT}|{_NUM}|{_S2}|{_S1}|{_COMMENT}|{_TPL}|\#{_IDENT}|{_OP}|\S))"
)
_COMPOSITE = re.compile(rf"({_AFTER})\s*+{_RE}\Z")
_REGEX = re.compile(_RE)
_JSXTEXT = re.compile(r"[^<{}>]++")
_JSXSTR = re.compile(r"\s*+(\"[^\"]*+\"|'[^']*+')")
_BIN = {
    "===", "!==", "==", "!=", "**", "%", "&&", "||", "??", "<<", "<=", "^", "instanceof", "+=", "-=", "*=", "/=", "%=",
    "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??=",
}
_PREFIX = {"!", "~", "typeof", "void", "delete"}
_NUMBER = re.compile(rf"(?:{_NUM})\Z")


def _rules(dialect: str) -> str:
    on = {"JS"} if dialect == "javascript" else {"TS", "CAST"} if dialect == "typescript" else {"TS", "JSX"}
    out, text = [], RULES
    part = re.compile(r"<(TS|JS|JSX|CAST)\s((?:[^<>']|'[^']*'|<(?:TS|JS|JSX|CAST)\s(?:[^<>']|'[^']*')*>)*)>")
    while part.search(text):
        text = part.sub(lambda m: m.group(2) if m.group(1) in on else "", text)
    out.append(text)
    return "".join(out)


class Ecma:
    def __init__(self, dialect: str):
        self.jsx = dialect == "tsx"
        also = {w: ("IDN",) for w in RESERVED} | {w: ("NAME", "IDN") for w in CONTEXTUAL} | {"NAME": ("IDN",)}
        also |= {w: ("CONST", "IDN") for w in ("null", "true", "false")}
        also |= {"!": ("PRE",), "~": ("PRE",), "typeof": ("PRE", "IDN"), "void": ("PRE", "IDN"), "delete": ("PRE", "IDN")}
        also |= {"instanceof": ("BIN", "IDN")}
        also |= {x: ("BIN",) for x in _BIN if x != "instanceof"}
        self.machine = Machine(Grammar(_rules(dialect), "program", also), virtual="ASI")
        self.words = set(RESERVED) | set(CONTEXTUAL)
        self.kinds = Kinds(self._kind)

    def _kind(self, token: str):
        if token[0] == "\n":
            body = token.lstrip()
            kind = self.kinds[body]
            if kind is None:
                return None
            if kind.__class__ is tuple:
                return ((kind[0],), *kind[1:])
            return (kind,)
        c = token[0]
        if token.startswith(("//", "/*")):
            return None
        m = _COMPOSITE.match(token)
        if m:
            return (self.kinds[m.group(1)], "REGEX")
        if c in "\"'":
            return "STR" if len(token) > 1 else "BAD"
        if c == "`":
            return self._template(token) if len(token) > 1 else "BAD"
        if _NUMBER.match(token):
            return "NUM"
        if c == "#":
            return "PRIVATE" if len(token) > 1 else "BAD"
        if c.isalpha() or c in "_$\\":
            return token if token in self.words else "NAME"
        if token == "\\" or not re.fullmatch(_OP, token):
            return "BAD"
        return token

    def _template(self, token: str) -> str:
        """Every substitution must hold an expression."""
        i, n = 1, len(token) - 1
        while i < n:
            c = token[i]
            if c == "\\":
                i += 2
                continue
            if c != "$" or token[i + 1] != "{":
                i += 1
                continue
            state, at = self.machine.start("expr"), i + 2
            while True:
                m = TOKEN.match(token, at)
                if not m or m.end() > n:
                    return "BAD"
                if m.group(1).lstrip() == "}" and not state["}"].alive:
                    break
                state = state[self.kinds[m.group(1)]]
                if not state.alive:
                    return "BAD"
                at = m.end()
            if not state.complete:
                return "BAD"
            i = m.end()
        return "TPL"

    def _deep_template(self, text: str, start: int) -> int:
        """End of the template that begins at ``start``, by a stack of open substitutions; -1 if it is none."""
        open_, i, n = [], start + 1, len(text)
        while i < n:
            c = text[i]
            if c == "`":
                i += 1
                if not open_:
                    return i
                state = open_.pop()["TPL"]
                if not state.alive:
                    return -1
            elif c == "$" and text.startswith("{", i + 1):
                state, i = self.machine.start("expr"), i + 2
            else:
                i += 2 if c == "\\" else 1
                continue
            while True:
                m = TOKEN.match(text, i)
                if not m:
                    return -1
                i, body = m.end(), m.group(1).lstrip()
                if body == "`":
                    open_.append(state)
                    break
                if body == "}" and not state["}"].alive:
                    if not state.complete:
                        return -1
                    break
                state = state[self.kinds[m.group(1)]]
                if not state.alive:
                    return -1
        return -1

    def _scan(self, text: str):
        """Token by token, asking the state whether a regular expression or JSX text can come."""
        state, at, n = self.machine.start(), 0, len(text)
        while True:
            if self.jsx and state["JSXTEXT"].alive:
                m = _JSXTEXT.match(text, at)
                if m:
                    if not m.group().isspace():
                        state = state["JSXTEXT"]
                    at = m.end()
                    if at < n and text[at] in ">}" :
                        return line_of(text, at), text[at], "token"
            m = TOKEN.match(text, at)
            if not m:
                break
            token, end = m.group(1), m.end()
            kind = self.kinds[token]
            body = token.lstrip()
            if body == "`":
                # Nested deeper than the pattern, or broken.
                r = self._deep_template(text, end - 1)
                if r > 0:
                    kind, end = ("TPL",) if token[0] == "\n" else "TPL", r
            elif self.jsx or kind.__class__ is tuple and len(kind) > 1:
                # A composite is taken apart; the state decides what a slash is.
                c = body[0]
                if kind.__class__ is tuple and len(kind) > 1:
                    head = _COMPOSITE.match(body).group(1)
                    end = m.start(1) + token.index(head) + len(head)
                    kind = kind[0]
                elif c == "/" and kind is not None and state["REGEX"].alive and not state[kind].alive:
                    start = m.start(1) + len(token) - len(body)
                    r = _REGEX.match(text, start)
                    if r:
                        kind, end = ("REGEX",) if token[0] == "\n" else "REGEX", r.end()
                elif c in "\"'" and kind in ("BAD", ("BAD",)) and self.jsx:
                    start = m.start(1) + len(token) - len(body)
                    r = _JSXSTR.match(text, start)
                    if r and state["STR"].alive:
                        kind, end = "STR", r.end()
            elif body[0] == "/" and kind is not None and not state[kind].alive and state["REGEX"].alive:
                start = m.start(1) + len(token) - len(body)
                r = _REGEX.match(text, start)
                if r:
                    kind, end = ("REGEX",) if token[0] == "\n" else "REGEX", r.end()
            state = state[kind]
            if not state.alive:
                return line_of(text, m.end() - 1), body[:80], "token"
            at = end
        if self.machine.ended(state):
            return None
        return line_of(text, len(text.rstrip())), "", "end"

    def failure(self, text: str):
        if text.startswith("#!"):
            text = "//" + text
        if not self.jsx:
            state, kinds = self.machine.start(), self.kinds
            for t in TOKEN.findall(text):
                state = state[kinds[t]]
            if state.alive and self.machine.ended(state):
                return None
        return self._scan(text)


def make(dialect: str) -> Ecma:
    return Ecma(dialect)
