"""Tokens nested to any depth."""

import ast

import pytest

from graphloom.llm.syntax import failure

SCREEN = "f'{" + "[" * 3 + "{1: {2: {3: {4: {5: 6}}}}}" + "]" * 3 + "}'"


def comment(n: int) -> str:
    return "/* a " * n + "*/ " * n


def template(n: int) -> str:
    return "`a ${" * n + "b" + "} c`" * n


def braces(n: int) -> str:
    return "`${f(" + "{a: " * n + "1" + "}" * n + ")}`"


def fstring(n: int) -> str:
    return "f'{" * n + "x" + "}'" * n


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 60])
def test_deep(n):
    assert failure("rust", f"fn a() {{}} {comment(n)} fn b() {{}}\n") is None
    assert failure("rust", "fn a() {} " + "/*" * n + "*/" * (n - 1) + " fn b() {} /* */\n")
    assert failure("rust", f"fn a() {{}} {comment(n)} */ fn b() {{}}\n")
    raw = f'r{"#" * n}"a"{"#" * (n - 1)} b"{"#" * n}'
    assert failure("rust", f"const A: &str = {raw};\nconst B: &[u8] = b{raw};\n") is None
    assert failure("rust", f"const A: &str = {raw[:-1]};\n")
    for lang in ("javascript", "typescript", "tsx"):
        for x in (template(n), braces(n)):
            assert failure(lang, f"const x = {x};\nf({x})\n") is None
            assert failure(lang, f"const x = {x[:-1]};\n")
            assert failure(lang, f"const x = {x.replace('b', 'b +', 1) if 'b' in x else x.replace('1', '1 +')};\n")
    for x in (fstring(n), "f'{ " + "{1: " * n + "2" + "}" * n + "!r:>{w}}'"):
        assert failure("python", f"x = {x}\ny = [{x}]\n") is None
        assert failure("python", f"x = {x[:-1]}\n")
    assert failure("python", f"x = {fstring(n).replace('x', 'x +')}\n")


@pytest.mark.parametrize("text", [
    SCREEN, 'f"""{\n' + "{1: " * 6 + "'}'" + "}" * 6 + '\n}"""', "f'{x:{y:{z}}}'", "f'{(lambda a: {1: {2: {3: {a: 4}}}})(1)!r}'", "rf'\\d{ {1: {2: {3: {4: 5}}}} = }'",
])
def test_against_ast(text):
    ast.parse(f"x = {text}\n")
    assert failure("python", f"x = {text}\n") is None


@pytest.mark.parametrize("text", ["f'{ {1: {2: {3: {4: 5 6}}}} }'", "f'{ {1: {2: {3: {4: 5}}} }'", "f'{ {1: {2: {3: {4: 5}}}} } }'"])
def test_against_ast_bad(text):
    with pytest.raises(SyntaxError):
        ast.parse(f"x = {text}\n")
    assert failure("python", f"x = {text}\n")


def test_lines_are_kept():
    assert failure("python", 'x = f"""{\n' + "{1: " * 6 + "2" + "}" * 6 + '\n}"""\ny = (\n)\nz = )\n')[0] == 6
