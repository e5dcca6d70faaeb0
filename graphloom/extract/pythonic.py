"""Python, by its own parser or, where that fails, by indentation."""

from __future__ import annotations

import ast
import re
import warnings

from graphloom.extract.common import Bind, Call, Def


class _Offsets:
    """Character offsets of the parser's (line, byte column) positions."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0]
        for line in text.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.plain = text.isascii()

    def at(self, line: int, column: int) -> int:
        start = self.starts[min(line - 1, len(self.starts) - 1)]
        if self.plain:
            return start + column
        return start + len(self.text[start:].encode()[:column].decode("utf-8", "ignore"))


def _module(node: ast.ImportFrom) -> str:
    return "." * node.level + (node.module or "")


def read(text: str):
    plain = text.replace("\f", " ")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(plain)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indentation(plain)
    off = _Offsets(plain)
    defs, calls, binds, imports = [], [], [], []
    pos = lambda n: off.at(n.lineno, n.col_offset)
    end = lambda n: off.at(n.end_lineno, n.end_col_offset)
    params: dict[ast.AST, dict[str, str]] = {}

    def visit(node: ast.AST, functions: list[ast.AST]) -> None:
        inner = functions
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            defs.append(Def(pos(node), end(node), node.name, "function"))
            a = node.args
            typed = [x for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if isinstance(x.annotation, ast.Name)]
            params[node] = {}
            for x in typed:
                binds.append(Bind(pos(x), x.arg, x.annotation.id))
                params[node].setdefault(x.arg, x.annotation.id)
            inner = [*functions, node]
        elif isinstance(node, ast.ClassDef):
            defs.append(Def(pos(node), end(node), node.name, "class"))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                calls.append(Call(pos(f), f.id))
            elif isinstance(f, ast.Attribute):
                calls.append(Call(pos(f), f.attr, ast.unparse(f.value)))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and isinstance(node.annotation, ast.Name):
            binds.append(Bind(pos(node), node.target.id, node.annotation.id))
        elif isinstance(node, ast.Assign) and len(node.targets) == 1:
            t, v = node.targets[0], node.value
            made = v.func.id if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) else None
            if isinstance(t, ast.Name) and made:
                binds.append(Bind(pos(node), t.id, made))
            elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name):
                if made:
                    binds.append(Bind(pos(node), t.attr, made, True))
                elif t.value.id == "self" and isinstance(v, ast.Name) and functions:
                    typ = params.get(functions[-1], {}).get(v.id)
                    if typ:
                        binds.append(Bind(pos(node), t.attr, typ, True))
        elif isinstance(node, ast.Import):
            imports.extend(x.name for x in node.names)
        elif isinstance(node, ast.ImportFrom):
            imports.append(_module(node))
        for child in ast.iter_child_nodes(node):
            visit(child, inner)

    try:
        visit(tree, [])
    except RecursionError:
        return _by_indentation(plain)
    return defs, calls, binds, imports


_STRINGS = re.compile(r"'''[\s\S]*?(?:'''|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?|#[^\n]*")
_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
_WORDS = set("if elif for while with return print not and or in def class lambda except assert raise yield await".split()) - {"print"}


def _by_indentation(text: str):
    """For texts with syntax errors: a definition ends at the next line indented no deeper."""
    code = _STRINGS.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    defs, calls, binds = [], [], []
    lines = [(m.start(), len(m.group(1).expandtabs(8))) for m in re.finditer(r"^([ \t]*)(?=\S)", code, re.M)]
    heads = set()
    for m in _HEAD.finditer(code):
        depth = len(m.group(1).expandtabs(8))
        begin = m.start() + len(m.group(1))
        stop = next((at for at, d in lines if at > m.start() and d <= depth), len(text))
        stop = len(text[:stop].rstrip()) if stop > begin else stop
        heads.add(m.start(3))
        defs.append(Def(begin, max(stop, m.end()), m.group(3), "class" if m.group(2) == "class" else "function"))
    for m in re.finditer(r"(?:(?P<r>[\w\])]+(?:\.\w+)*)\.)?(?P<c>[A-Za-z_]\w*)\(", code):
        if m.start("c") not in heads and m.group("c") not in _WORDS:
            calls.append(Call(m.start("c"), m.group("c"), m.group("r")))
    for m in re.finditer(r"^[ \t]*(self\.)?(\w+)[ \t]*=[ \t]*(\w+)\(", code, re.M):
        binds.append(Bind(m.start(2), m.group(2), m.group(3), bool(m.group(1))))
    imports = [a or b for a, b in re.findall(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import|import[ \t]+([.\w]+))", code, re.M)]
    return defs, calls, binds, imports
