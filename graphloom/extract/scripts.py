"""Shell and YAML."""

from __future__ import annotations

import re

from graphloom.extract.common import Call, Def

_QUOTED = re.compile(r"(?<![\w$\\])#[^\n]*|\\.|'[^']*'?|\"(?:[^\"\\]|\\.)*\"?")
_RESERVED = set("if then elif else fi do done case esac while until for in function select time { } ! [[ ]]".split())


def read_shell(text: str):
    code = _QUOTED.sub(lambda m: re.sub(r"[^\n]", "_" if m.group()[0] in "'\"" else " ", m.group()), text)
    for m in re.finditer(r"<<-?\s*_*(\w+)_*[^\n]*\n", code):
        word = re.search(r"<<-?\s*[\\'\"]?(\w+)", text[m.start():m.end()])
        stop = re.compile(rf"^\t*{re.escape(word.group(1))}$", re.M).search(text, m.end()) if word else None
        if stop:
            code = code[:m.end()] + re.sub(r"[^\n]", " ", code[m.end():stop.end()]) + code[stop.end():]
    defs, calls, imports = [], [], []
    heads = set()
    for m in re.finditer(r"^[ \t]*(?:function[ \t]+([\w.:-]+)[ \t]*(?:\(\s*\))?|([\w.:-]+)[ \t]*\(\s*\))\s*[{(]", code, re.M):
        name, at = m.group(1) or m.group(2), m.end() - 1
        depth, end = 0, at
        open_, close = ("{", "}") if code[at] == "{" else ("(", ")")
        while end < len(code):
            c = code[end]
            # A brace in a word or expansion is no bracket of a body.
            if c == open_ and (open_ == "(" or end == at or code[end - 1] in " \t\n;&|(" and code[end + 1:end + 2].isspace()):
                depth += 1
            elif c == close and (close == ")" or code[end - 1] in " \t\n;&)"):
                depth -= 1
                if not depth:
                    break
            end += 1
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        heads.add(begin)
        defs.append(Def(begin, min(end + 1, len(text)), name, "function"))
    for m in re.finditer(r"(?:^|[;&|(`]|\b(?:then|do|else|if|while|until|elif)\b|\$\()[ \t]*((?:\w+=\S*[ \t]+)*)(?!(?:if|then|elif|else|while|until|do|for|in|case)\b)([\w./:\-\[]+)([ \t]+[^\s;&|)]+)?", code, re.M):
        name = text[m.start(2):m.end(2)]
        if name in _RESERVED or m.start(2) in heads or re.match(r"\w+=|\d+$", name):
            continue
        calls.append(Call(m.start(2), name))
        if name in ("source", ".") and m.group(3):
            imports.append(text[m.start(3):m.end(3)].strip())
    return defs, calls, [], imports


_KEY = re.compile(r"^([ ]*)((?:-[ ]+)*)(?:(?P<k>\"[^\"\n]*\"|'[^'\n]*'|[^\s#&*!|>%@`\[\]{},\"'-][^\n#:]*?|[\w-][^\n#:]*?)[ ]*:)(?=\s|$)", re.M)


def read_yaml(text: str):
    defs, calls, imports = [], [], []
    lines = text.split("\n")
    offsets, at = [], 0
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    stack: list[tuple[int, str, int]] = []  # (column, key, index in defs)
    literal = -1

    def leave(column: int, row: int) -> None:
        while stack and stack[-1][0] >= column:
            _, _, i = stack.pop()
            last = row - 1
            while last > 0 and not lines[last].strip():
                last -= 1
            defs[i].end = max(defs[i].start + 1, offsets[last] + len(lines[last]))

    for row, line in enumerate(lines):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip(" "))
        if literal >= 0:
            if indent > literal:
                continue
            literal = -1
        if line.lstrip().startswith("#"):
            continue
        m = _KEY.match(line)
        body, column, shift = line[indent:], indent, indent
        if m:
            column = m.start("k")
            leave(column, row)
            key = m.group("k").strip().strip("\"'")
            defs.append(Def(offsets[row] + column, len(text), ".".join([*(k for _, k, _ in stack), key]), "key"))
            stack.append((column, key, len(defs) - 1))
            body, shift = line[m.end():], m.end()
            value = body.strip()
            if key == "uses" and value:
                imports.append(re.sub(r"\s+#.*", "", value).strip())
            if re.match(r"(?:&\S+\s+)?[|>]", value):
                literal = column
        else:
            leave(indent, row)
        clean = re.sub(r"\"[^\"]*\"|'[^']*'|\s#.*", lambda q: " " * len(q.group()), body)
        for a in re.finditer(r"(?<![\w&*])([&*])([\w-]+)", clean):
            start = offsets[row] + shift + a.start()
            if a.group(1) == "&":
                defs.append(Def(start, start + len(a.group()), a.group(2), "anchor"))
            else:
                calls.append(Call(start, a.group(2)))
        prefix = [k for _, k, _ in stack]
        for f in re.finditer(r"[{,]\s*([\w.-]+)\s*:\s*([^,{}\[\]]*)", clean):
            start = offsets[row] + shift + f.start(1)
            defs.append(Def(start, offsets[row] + shift + f.end(), ".".join([*prefix, f.group(1)]), "key"))
            if f.group(1) == "uses":
                imports.append(body[f.start(2):f.end(2)].strip())
    leave(-1, len(lines))
    return defs, calls, [], imports
