"""Comments at the end of a text, told from strings, templates and here-documents.

A text is scanned once from its start, skipping strings and comments of its language, up to
the last piece of code; whole lines after that are the trailing comments. A string that is
still open at the end holds all that follows it. Languages come from the name or the first
line; where the mark of the last line is not one of that language, a mixture is scanned.
"""

from __future__ import annotations

import re

_MARKS = {"#": "#", "/": "//", "*": "//", "-": "--", ";": ";;", "<": "<!--"}
_LAST = re.compile(r"(?://|#|--|;;|<!--|/\*|\*)[^\n]*\s*\Z|[^\n]*\*/\s*\Z")
_SUFFIXES = {
    "py": "python", "pyi": "python", "sh": "shell", "bash": "shell", "bats": "shell", "zsh": "shell", "yaml": "yaml", "yml": "yaml",
    "rs": "rust", "go": "go", "ts": "ecma", "tsx": "ecma", "js": "ecma", "jsx": "ecma", "mjs": "ecma", "cjs": "ecma", "mts": "ecma", "cts": "ecma",
}
_HASH = {"python", "shell", "yaml"}

_PAIR = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_TRIPLE = r"(?P<triple>\"\"\"|''')"
_HEREDOC = r"(?P<here>(?<!<)<<(?P<dash>[-~]?)[ \t]*\\?(?P<q>['\"]?)(?P<word>[A-Za-z_][\w.-]*)(?P=q))"
_BLOCK = r"(?P<block>/\*)"
_RUNE = r"'(?:\\[^\n][^'\n]*|[^'\\\n])'"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};\n])|(?<=return)) *(?P<regex>/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)"
_SCANS = {
    "python": rf"(?P<line>#[^\n]*)|{_TRIPLE}|{_PAIR}",
    "shell": rf"(?P<line>(?<![^\s;&|()])#[^\n]*)|\\[\s\S]|\$'(?:[^'\\]|\\[\s\S])*'|'[^']*(?:'|\Z)|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|\(\((?:[^()\n]|\([^()\n]*\))*\)\)|{_HEREDOC}",
    "go": rf"(?P<line>//[^\n]*)|{_BLOCK}|\"(?:[^\"\\\n]|\\.)*\"|{_RUNE}|`[^`]*(?:`|\Z)",
    "rust": rf"(?P<line>//[^\n]*)|{_BLOCK}|\br(?P<raw>#*)\"|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|{_RUNE}",
    "ecma": rf"(?P<line>//[^\n]*|<!--[^\n]*)|{_BLOCK}|{_REGEX}|{_PAIR}|(?P<tick>`)",
    "#": rf"(?P<line>(?<!\S)#[^\n]*)|{_TRIPLE}|{_PAIR}|{_HEREDOC}",
    "//": rf"(?P<line>//[^\n]*)|{_BLOCK}|{_PAIR}|(?P<tick>`)",
    "--": rf"(?P<line>--[^\n]*)|{_BLOCK}|{_PAIR}",
    ";;": rf"(?P<line>;[^\n]*)|{_PAIR}",
    "<!--": r"(?P<line><!--[\s\S]*?(?:-->|\Z))",
}
_SCANS = {k: re.compile(v) for k, v in _SCANS.items()}
_BLOCK_ENDS = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{|[{}]")
_INSIDE = re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{_PAIR}|[`{{}}]")


def _block_end(text: str, at: int, nested: bool) -> int:
    depth = 0
    for m in _BLOCK_ENDS.finditer(text, at):
        if m.group() == "*/":
            depth -= 1
            if depth == 0:
                return m.end()
        elif nested or not depth:
            depth += 1
    return len(text)


def _template_end(text: str, at: int) -> int:
    """End of the template literal that begins at ``at``, its substitutions nested to any depth."""
    stack, at = ["`"], at + 1
    while stack:
        m = (_TEMPLATE if stack[-1] == "`" else _INSIDE).search(text, at)
        if m is None:
            return len(text)
        at, found = m.end(), m.group()
        if stack[-1] == "`":
            if found == "`":
                stack.pop()
            elif found == "${":
                stack.append("{")
        elif found in ("`", "{"):
            stack.append(found)
        elif found == "}":
            stack.pop()
    return at


def _here_end(text: str, m: re.Match) -> int:
    """End of the line that closes the here-document, or of the text."""
    line = text.find("\n", m.end())
    if line < 0:
        return len(text)
    lead = r"\n[ \t]*" if m["dash"] else r"\n"
    end = re.compile(rf"{lead}{re.escape(m['word'])}[ \t]*(?=\n|\Z)").search(text, line)
    return end.end() if end else len(text)


def _code_end(text: str, lang: str) -> int:
    """Where the last piece of code ends, strings being code and comments and blanks not."""
    scan, at, last = _SCANS[lang], 0, 0
    while True:
        m = scan.search(text, at)
        gap = text[at:m.start() if m else len(text)].rstrip()
        if gap:
            last = at + len(gap)
        if m is None:
            return last
        g = m.groupdict()
        comment = False
        if g.get("line") is not None:
            end, comment = m.end(), True
        elif g.get("block"):
            end, comment = _block_end(text, m.start(), lang == "rust"), True
        elif g.get("triple"):
            end = re.compile(rf"(?:[^\\]|\\[\s\S])*?{m['triple']}").match(text, m.end())
            end = end.end() if end else len(text)
        elif g.get("here"):
            end = _here_end(text, m)
        elif g.get("tick"):
            end = _template_end(text, m.start())
        elif g.get("raw") is not None:
            end = text.find('"' + m["raw"], m.end())
            end = len(text) if end < 0 else end + 1 + len(m["raw"])
        else:
            end = m.end()
        at = end
        if not comment:
            last = at


_SCALAR = re.compile(r"(?:^|.*?[:\-?][ \t]+|---[ \t]+)(?:[!&]\S+[ \t]+)*[|>](?:[+-]?([1-9])?[+-]?)[ \t]*(?:[ \t]#.*)?$")
_DASHES = re.compile(r" *(?:- +)*")
_QUOTE = re.compile(r"(?:^|[:\-?,\[{])[ \t]*(?:[!&]\S+[ \t]+)*([\"'])")
_QUOTED = {'"': re.compile(r'(?:[^"\\]|\\.)*"'), "'": re.compile(r"(?:[^']|'')*'(?!')")}
_COMMENT = re.compile(r"(?<!\S)#")


def _yaml_code_end(text: str) -> int:
    at = last = 0
    content = parent = None
    quote = ""
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        plain = line.strip()
        if not plain:
            continue
        indent = len(line) - len(line.lstrip(" "))
        if parent is not None:
            if content is None and indent > parent:
                content = indent
            if content is not None and indent >= content:
                last = start + len(line.rstrip())
                continue
            parent = content = None
        if not quote and plain.startswith("#"):
            continue
        last = start + len(line.rstrip())
        pos = 0
        while True:
            if quote:
                end = _QUOTED[quote].match(line, pos)
                if end is None:
                    break
                pos, quote = end.end(), ""
            m = _QUOTE.search(line, pos)
            if m is None or _COMMENT.search(line, pos, m.start()):
                break
            quote, pos = m.group(1), m.end()
        m = None if quote else _SCALAR.match(line)
        if m:
            dashes = _DASHES.match(line).group()
            only = line[len(dashes):].lstrip("!&")[:1] in "|>"
            parent = -1 if line.startswith("---") else dashes.rindex("-") if only and "-" in dashes else len(dashes)
            content = max(parent, 0) + int(m.group(1)) if m.group(1) else None
    return last


def language(rel: str | None, text: str) -> str:
    name = (rel or "").replace("\\", "/").rsplit("/", 1)[-1]
    known = _SUFFIXES.get(name.rsplit(".", 1)[-1].lower(), "") if "." in name else ""
    if not known and text.startswith("#!"):
        first = text[: text.find("\n")] if "\n" in text else text
        known = "python" if "python" in first else "ecma" if re.search(r"\b(?:node|deno|bun)\b", first) else "shell" if re.search(r"sh\b", first) else ""
    return known


def tail_comments(rel: str | None, text: str) -> list[str]:
    """Lines of the comments after the last line of code; line ends are ``\\n``."""
    line = text[text.rstrip().rfind("\n") + 1:].strip()
    if not _LAST.match(line):
        return []
    lang = language(rel, text)
    mark = _MARKS.get(line[0], "//")
    if lang and not ((mark == "#") == (lang in _HASH) and mark in ("#", "//")):
        lang = ""
    end = _yaml_code_end(text) if lang == "yaml" else _code_end(text, lang or mark)
    after = text.find("\n", end) if end else 0
    if after < 0:
        return []
    return [x.strip().lstrip("* ") for x in text[after:].split("\n") if x.strip()]
