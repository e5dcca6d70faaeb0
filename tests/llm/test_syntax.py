"""Derivative parsers against real parsers where there are any, and by hand."""

import ast
import glob
import sysconfig
import warnings

import pytest

from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax import failure

GOOD = {
    "python": [
        "x = 1\n", "", "# only\n", "def f(a, /, b, *, c=1, **k) -> int:\n    return a\n", "match x:\n    case {'a': [1, *_], **r} if r:\n        pass\n",
        "match = case = type = 1\nmatch(x)\n", "f'{x!r:>{w}} {{}} {a[\"b\"]}'\n", "if (n := 1):\n\tpass", "a = [\n  1,\n\n  # c\n  2]\n", "async def f():\n    async with a as b, c: await d\n",
        "try:\n    pass\nexcept* E as e:\n    pass\nelse: pass\nfinally: pass\n", "x: int = 3; y = lambda *a: a\n", "class A[T](B, k=1): ...\n", "print((yield))\n", "s = '''<<<<<<< HEAD\n'''\n",
    ],
    "javascript": [
        "const a = b ?? c?.d?.[e]?.(f);", "let x = 1\nlet y = 2\n", "return_: for (;;) { break return_ }", "a = b / c / d", "s.replace(/[/\"'`]+/g, '')", "const {a, ...b} = c, [d,, e = 1] = f",
        "class A extends B { static #x = 1; get y() { return this.#x } static { f() } async *z() {} }", "`a ${`b ${c} }`} d`", "x => ({a: 1})", "export default class {}", "if (a) b; else c\n",
        "import a, { b as c } from 'd'; export * from 'e'; export { f }", "i\n++\nj", "#!/usr/bin/env node\nf()", "for await (const x of y) z()", "label: while (1) continue label",
    ],
    "typescript": [
        "const f = async <T extends object>(a: T[], b?: Map<string, Array<number>>): Promise<T | null> => null;", "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] };",
        "abstract class A<T> extends B<T> implements C { constructor(private readonly x: number) { super() } abstract f(): void; g?(): this; [k: string]: any }",
        "enum E { A = 'a', B }\ndeclare module 'm' { export const x: number }\n", "let v = <number>x as unknown as string; let w = a! satisfies B;", "function isA(x: any): x is A { return x < 1 && y > (2) }",
        "export type { A } from './a'; import type B from 'b'; type T = `a${string}`", "interface I extends J<K> { (x: number): string; new (x: number): I; m(): void\n n: number }", "@dec() class X { @a b = 1 }",
    ],
    "tsx": ["const a = <div className=\"x\" {...p} data-n={2}>it's {b ? <C.D /> : <></>} // no comment\n</div>;", "const f = <T,>(x: T) => x;"],
    "go": [
        "package a\n\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range 10 {\n\t\tgo func() {}()\n\t}\n\treturn\n}\n",
        "package a\nvar m = map[string][]T{\"a\": {{1, 2}}}\ntype I interface { ~int | string; M() }\n", "package a\nfunc f() { if x, ok := y.(type1); ok { switch z := x.(type) { case int, *T: default: } } }\n",
        "package a\nimport (\n\t_ \"b\"\n)\nconst (\n\tA = iota\n\tB\n)\nfunc g() { select { case v := <-c: _ = v; case d <- 1: }; a[1:2:3] = s }\n",
    ],
    "rust": [
        "fn f<'a, T: Fn(&str) -> u8 + 'a>(x: &'a mut [T; 3]) -> impl Iterator<Item = T> where T: Copy { x.iter().map(|y| *y).collect::<Vec<_>>() }",
        "impl<T> A for B<T> { const X: u8 = b'x'; type Y = Vec<Vec<T>>; }\n#[derive(Debug)] pub(crate) enum E { A(u8), B { c: char }, D = 3 }",
        "fn g() { let S { a, .. } = s else { return }; match x { 0..=9 | 11 => {}, Some(n) if n > 1 => n, _ => m!{a} } let r = r#\"\"x\"#; 'l: loop { break 'l } }",
        "use a::{b::*, c as d}; macro_rules! m { ($x:expr) => { $x } } static S: &[u8] = &[1, 2]; fn h() { if let Some(x) = y && z { } x as u8 << 2; a..; }",
    ],
    "shell": [
        "f() { local a=\"${1:-b}\"; }\nfor x in *; do echo \"$(g \"$x\" | h)\"; done\n", "cat <<'E' > \"$f\"\nunbalanced ( {\nE\n", "case \"$x\" in a*|b) shift ;; *) : ;; esac", "x=$(( 1 + ${#y} )); arr=(a b\nc); [[ -z $a && b =~ ^(c|d)$ ]] || exit",
        "if ! a; then b; elif c; then d; else e; fi", "a && {\n b; } 2>&1 | c &", "echo `date` ${a#b} ${a//\\}/x} $'it\\'s'", "=======\n", "while read -r l; do :; done < <(ls)",
    ],
    "yaml": [
        "a: 1\nb:\n- x\n- y: {c: [1, 'd', \"e\\n\"]}\n  z: |\n    text: \"\n     more\n", "---\n# c\na: &x b\nc: *x\n...\n---\nd\n", "? a\n: b\n", "plain\n  more words\n", "{\"a\": [1, {\"b\": null}]}\n", "a: >-\n\n  f\nb: !!str 1\n",
        "k: http://x.example/a#b # c\n", "\"q\": 'it''s'\n", "- - a\n  - b\n-\n  c: d\n",
    ],
}
BAD = {
    "python": ["def f(:\n", "x = (1,\n", "if x:\n", "a b\n", "<<<<<<< HEAD\nx = 1\n", "'''open\n", "f() = 1\n", "  x\n y\n", "print 'a'\n", "f'{x'\n", "f'{a b}'\n", "return = 1\n", "x = 0123\n"],
    "javascript": ["const a", "f(1", "{ \"a\": 1 }", "let a: number = 1;", "if (x) {", "a b", "=======", "`open ${x", "const x = `${a b}`;", "import logging", "x = {a: 1,, }", "class { }"],
    "typescript": ["interface A {", "const x: = 1;", "function f(a: ) {}", "package a", "let a = <div>x</div>;", ">>>>>>> theirs"],
    "tsx": ["const a = <div>;", "const a = <div>{</div>;", "const a = <div>x</div"],
    "go": ["package a\nfunc f() {\n", "func f() {}\n", "package a\nx := 1\n", "package a\nfunc f() { a( }\n", "package a\n<<<<<<< HEAD\n", "package a\nvar x = `open\n"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct S { a: }", "fn f() {", "def f():\n", "fn f() { \"open }"],
    "shell": ["if a; then\n", "f() {\n", "a )\n", "<<<<<<< HEAD\n", "echo \"open\n", "case x in\n", "foo(bar)\n", "echo $(a\n", "fi\n", "a | | b\n", "} catch (e) {\n"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", "a:\n\t- b\n", "a: 1\n- b\n", "a: \"open\n", "a: 1\n b: 2\n", "a: 1\nword\n", "%x\n", "a: @b\n"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid(lang):
    assert [t for t in GOOD[lang] if failure(lang, t)] == []
    assert [t for t in GOOD[lang] if failure(lang, "﻿" + t.replace("\n", "\r\n")) and not t.startswith("#!")] == []


@pytest.mark.parametrize("lang", BAD)
def test_invalid(lang):
    assert [t for t in BAD[lang] if not failure(lang, t)] == []


def test_where_it_fails():
    assert failure("python", "a = 1\nb = = 2\n") == (2, "=", "token")
    assert failure("javascript", "f(1,\n2")[2] == "end"
    assert failure("go", "package a\n\nfunc f() {\n}}\n")[:2] == (4, "}")
    assert failure("cobol", "x") is None and failure("python", None) is None


def test_python_agrees_with_its_own_parser():
    warnings.simplefilter("ignore")
    files = sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/[a-d]*.py"))[:60]
    assert len(files) > 20
    for f in files:
        text = open(f, encoding="utf-8").read()
        assert failure("python", text) is None, f
        cut = text[: len(text) * 2 // 3]
        try:
            ast.parse(cut)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        assert (failure("python", cut) is None) == ok, f


def test_derivatives():
    g = Grammar("s: A s B | C* ;", "s")
    m = Machine(g)

    def accepts(word):
        state = m.start()
        for k in word:
            state = state[k]
        return m.ended(state)

    assert accepts("AACBB") and accepts("") and accepts("CCC") and accepts("AB")
    assert not accepts("AAB") and not accepts("BA") and not accepts("ACCBB")
    small = Machine(g, max_states=5)
    for n in range(1, 60):
        state = small.start()
        for k in "A" * n + "B" * n:
            state = state[k]
        assert small.ended(state)
