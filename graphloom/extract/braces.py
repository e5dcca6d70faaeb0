"""TypeScript/JavaScript, Go and Rust, read from masked text and matched brackets."""

from __future__ import annotations

import re

from graphloom.extract.common import Bind, Call, Def, type_basename

_MASKS = {
    "ts": re.compile(
        r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)"
        r"|(?<=[(,=:\[!&|?{;])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    ),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)+'"),
    "rust": re.compile(
        r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|b?r(#*)\"[\s\S]*?\"\1|b?\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|b?'(?:[^'\\\n]|\\(?:x..|u\{[^}]*\}|.))'"
    ),
}
_PAIR = {"{": "}", "(": ")", "[": "]"}


def mask(text: str, lang: str) -> str:
    """The text with comments and literals blanked; offsets and lines stay."""
    return _MASKS[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


class Source:
    def __init__(self, text: str, lang: str):
        self.text, self.code = text, mask(text, lang)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}()\[\]]", self.code):
            c = m.group()
            if c in _PAIR:
                stack.append(m.start())
            else:
                while stack and _PAIR[self.code[stack[-1]]] != c:
                    stack.pop()
                if stack:
                    self.close[stack.pop()] = m.start()

    def past(self, at: int, opening: str = "{") -> int:
        """Past the bracket that opens at or after ``at`` on this declaration; the text's end if it never closes."""
        n = len(self.code)
        while at < n:
            c = self.code[at]
            if c == opening:
                return self.close.get(at, n - 1) + 1
            if c in "([":
                at = self.close.get(at, n - 1) + 1
                continue
            if c == ";" or c == "}":
                return at + (c == ";")
            at += 1
        return n

    def statement_end(self, at: int) -> int:
        """Past a declaration that ends with a semicolon or line break outside brackets."""
        n, seen = len(self.code), False
        while at < n:
            c = self.code[at]
            if c in "{([":
                at, seen = self.close.get(at, n - 1) + 1, True
                continue
            if c == ";":
                return at + 1
            if c in "})]":
                return at
            if c == "\n":
                rest = self.code[at:].lstrip()
                if seen and not rest.startswith((".", "?", ":", "=", "&", "|", "+", ",")):
                    return at
                if not seen and rest and not rest.startswith((".", "?", "|", "&", "=", "(", "{", "[")) and self.code[:at].rstrip()[-1:] not in "=|&,(":
                    return at
            else:
                seen = seen or not c.isspace()
            at += 1
        return n


_TS_WORDS = set("if for while switch catch return function typeof await new super import class do else case in of void delete throw yield".split())
_RETURN = r"(?:\s*:\s*[^={;()]*(?:\([^()]*\)[^={;()]*)?)?"
_PARAMS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"


def read_ts(text: str):
    s = Source(text, "ts")
    code = s.code
    defs, calls, binds = [], [], []
    named: set[int] = set()

    def add(m: re.Match, kind: str, end: int) -> None:
        named.add(m.start("n"))
        defs.append(Def(m.start("d"), end, m.group("n"), kind))

    for m in re.finditer(r"(?P<d>(?:async\s+)?\bfunction\b\s*\*?\s*(?P<n>[\w$]+))", code):
        add(m, "function", s.past(m.end()))
    bodies = []
    for m in re.finditer(r"(?P<d>(?:\babstract\s+)?\bclass\s+(?P<n>[\w$]+))", code):
        end = s.past(m.end())
        add(m, "class", end)
        bodies.append((code.find("{", m.end()), end))
    for m in re.finditer(r"(?P<d>\binterface\s+(?P<n>[\w$]+))[^;{=]*\{", code):
        add(m, "interface", s.past(m.end() - 1))
    for m in re.finditer(r"(?P<d>(?<![\w$.])type\s+(?P<n>[\w$]+)\s*(?:<[^=;]*>)?\s*=)", code):
        add(m, "type", s.statement_end(m.end()))
    for m in re.finditer(r"(?P<d>(?:\bconst\s+)?\benum\s+(?P<n>[\w$]+))", code):
        add(m, "enum", s.past(m.end()))
    arrow = rf"(?:async\s+)?(?:[\w$]+|(?:<[^>]*>\s*)?{_PARAMS}{_RETURN})\s*=>|(?:async\s+)?function\b"
    for m in re.finditer(rf"\b(?:const|let|var)\s+(?P<d>(?P<n>[\w$]+)(?:\s*:[^=;]*)?\s*=\s*(?:{arrow}))", code):
        add(m, "function", s.statement_end(m.end()))
    for begin, end in bodies:
        at = begin + 1
        while begin >= 0 and at < end - 1:
            m = re.compile(
                rf"\s*(?P<d>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|declare)\s+|\*\s*)*"
                rf"(?P<n>#?[\w$]+)\??\s*(?:<[^>(]*>\s*)?(?:(?P<m>{_PARAMS}){_RETURN}\s*(?P<b>\{{|;)|(?P<f>(?:\s*:[^=;]*)?=\s*(?:{arrow}))))"
            ).match(code, at)
            if m and m.group("n") not in _TS_WORDS:
                stop = (s.close.get(m.end() - 1, end - 1) + 1) if m.group("b") == "{" else m.end() if m.group("b") else s.statement_end(m.end())
                add(m, "method", stop)
                at = stop
                continue
            field = re.compile(r"\s*(?:(?:public|private|protected|static|readonly|override|declare)\s+)*([\w$]+)[?!]?\s*:\s*([A-Za-z_$][\w$]*)\s*[;=\n]").match(code, at)
            if field:
                binds.append(Bind(field.start(1), field.group(1), field.group(2), True))
                at = field.end() - 1
            c = code[at]
            at = s.close.get(at, end) + 1 if c in "{([" else at + 1
            while at < end - 1 and code[at - 1] not in ";}\n{":
                at = s.close.get(at, end) + 1 if code[at] in "{([" else at + 1
    for m in re.finditer(r"(?:\bnew\s+([\w$]+))|(?:(?P<r>[\w$\]\)]+(?:\??\.[\w$]+)*)\s*\??\.\s*)?(?P<c>[\w$]+)\s*(?:<[\w\s,.\[\]]*>)?\(", code):
        if m.group(1):
            calls.append(Call(m.start(1), m.group(1)))
        elif m.start("c") not in named and m.group("c") not in _TS_WORDS and not m.group("c")[0].isdigit():
            if not re.search(r"\bnew\s+$", code[max(0, m.start("c") - 8):m.start("c")]) and not re.search(r"\bfunction\s*\*?\s*$", code[max(0, m.start("c") - 12):m.start("c")]):
                calls.append(Call(m.start("c"), m.group("c"), m.group("r") and m.group("r").replace("?", "")))
    for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=\s*new\s+([\w$]+)", code):
        binds.append(Bind(m.start(1), m.group(1), m.group(2)))
    for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*:\s*([A-Za-z_$][\w$]*)\s*[=;]", code):
        binds.append(Bind(m.start(1), m.group(1), m.group(2)))
    for m in re.finditer(r"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*([\w$]+)\??\s*:\s*([A-Z][\w$]*)\s*(?=[,)=])", code):
        binds.append(Bind(m.start(1), m.group(1), m.group(2)))
    imports = [
        text[m.start(2):m.end(2)]
        for m in re.finditer(r"^[ \t]*(import|export)\b[^;\"'`]*?([\"'][^\"'\n]*[\"'])", text, re.M)
        if code[m.start(1):m.start(1) + 6].strip() and (m.group(1) == "import" or re.search(r"\bfrom\s*$", text[m.start():m.start(2)]))
    ]
    return defs, calls, binds, imports


_GO_WORDS = set("if for switch func return go defer select case range type var const make append len cap new panic".split()) - {
    "make", "append", "len", "cap", "new", "panic"}


def read_go(text: str):
    s = Source(text, "go")
    code = s.code
    defs, calls, binds, imports = [], [], [], []
    heads: set[int] = set()
    for m in re.finditer(r"^func\s+(?:\(\s*(?:(\w+)\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)", code, re.M):
        end = s.past(m.end())
        heads.add(m.start(3))
        defs.append(Def(m.start(), end, m.group(3), "method" if m.group(2) else "function", m.group(2)))
        if m.group(1) and m.group(1) != "_":
            binds.append(Bind(m.start(1), m.group(1), m.group(2)))
        params = code.find("(", m.end())
        if 0 <= params < end:
            for p in re.finditer(r"(?:^|,)\s*(\w+)\s+\*?(\w+)\s*(?=,|$)", code[params + 1:s.close.get(params, params)]):
                binds.append(Bind(m.start(), p.group(1), p.group(2)))
    for m in re.finditer(r"^type\s+(?:\(|(\w+))", code, re.M):
        if m.group(1):
            brace = re.compile(r"[^\n]*\{").match(code, m.end())
            end = s.past(m.end()) if brace else code.find("\n", m.end()) if "\n" in code[m.end():] else len(code)
            defs.append(Def(m.start(), end, m.group(1), "type"))
        else:
            stop = s.close.get(m.end() - 1, len(code) - 1)
            at = m.end()
            for t in re.finditer(r"^[ \t]*(\w+)\s+[^\n]+", code[at:stop], re.M):
                # A grouped declaration is one span for all its types.
                if code.count("{", at, at + t.start()) == code.count("}", at, at + t.start()):
                    defs.append(Def(m.start(), stop + 1, t.group(1), "type"))
    for m in re.finditer(r"(?:(?P<r>[\w\]\)]+(?:\.\w+)*)\.)?(?P<c>[A-Za-z_]\w*)\(", code):
        if m.start("c") not in heads and m.group("c") not in _GO_WORDS:
            calls.append(Call(m.start("c"), m.group("c"), m.group("r")))
    for m in re.finditer(r"\bvar\s+(\w+)\s+\*?(\w+)", code):
        binds.append(Bind(m.start(1), m.group(1), m.group(2)))
    for m in re.finditer(r"\b(\w+)\s*:=\s*&?([A-Za-z_]\w*)\{", code):
        binds.append(Bind(m.start(1), m.group(1), m.group(2)))
    for m in re.finditer(r"^import\s*(\()?", code, re.M):
        # Literals are blank in the code, so a plain import runs to the end of its first line.
        stop = s.close.get(m.end() - 1, len(code)) if m.group(1) else (code + "\n").find("\n", m.start())
        imports += re.findall(r"\"([^\"\n]+)\"", text[m.start():stop])
    return defs, calls, binds, imports


_RUST_WORDS = set("if for while match return loop fn as in let mut ref move unsafe impl where else".split())


def read_rust(text: str):
    s = Source(text, "rust")
    code = s.code
    defs, calls, binds, imports = [], [], [], []
    heads: set[int] = set()
    scopes: list[tuple[int, int, str]] = []
    for m in re.finditer(r"\bimpl\b\s*(?:<[^{;]*?>\s*)?([^{;]*?)\{", code):
        target = re.split(r"\bwhere\b", re.split(r"\bfor\b", m.group(1))[-1])[0]
        scopes.append((m.end() - 1, s.close.get(m.end() - 1, len(code)), type_basename(target.lstrip("&").strip())))
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "mod": "namespace"}
    lead = r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern)\s+)*"
    for m in re.finditer(rf"(?<![\w.:])(?P<d>{lead}\b(fn|struct|enum|trait|type|mod)\s+(?P<n>\w+))", code):
        word = m.group(2)
        end = s.statement_end(m.end()) if word == "type" else s.past(m.end())
        heads.add(m.start("n"))
        defs.append(Def(m.start("d"), end, m.group("n"), kinds[word]))
        if word == "trait":
            scopes.append((m.end(), end, m.group("n")))
        if word == "mod":
            imports.append(m.group("n"))
        if word == "fn":
            params = code.find("(", m.end())
            for p in re.finditer(r"(?:^|,)\s*(?:mut\s+)?(\w+)\s*:\s*([^,]+)", code[params + 1:s.close.get(params, params)]):
                binds.append(Bind(m.start("d"), p.group(1), type_basename(p.group(2))))
    for d in defs:
        around = [x for x in scopes if x[0] < d.start < x[1]]
        if around and d.kind in ("function", "type"):
            d.container = max(around)[2]
            d.kind = "method" if d.kind == "function" else d.kind
    for m in re.finditer(r"(?:(?P<r>[\w\])?]+(?:(?:\.|::)\w+)*)(?:\.|::))?(?P<c>[a-zA-Z_]\w*)\s*(?:::<[^()]*>)?\(", code):
        if m.start("c") not in heads and m.group("c") not in _RUST_WORDS:
            calls.append(Call(m.start("c"), m.group("c"), m.group("r")))
    for m in re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*:\s*([^=;]+)", code):
        binds.append(Bind(m.start(1), m.group(1), type_basename(m.group(2))))
    imports += [" ".join(m.group(1).split()) for m in re.finditer(r"\buse\s+([^;]+);", code)]
    return defs, calls, binds, imports
