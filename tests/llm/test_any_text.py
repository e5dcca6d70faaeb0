"""Ambiguity and nesting of any size: linear time, no recursion, and no text that fails its task."""

import time

import pytest

from graphloom.llm import parsing
from graphloom.llm.derive import Grammar, Machine
from graphloom.llm.syntax import failure

N = 10_000
DEEP = [
    ("rust", "fn f() { " + "a<" * N + "b;}", False),
    ("typescript", "a<" * N + "b;", True),
    ("tsx", "a<" * N + "b;", True),
    ("rust", "fn f() { x = " + "(" * N + "1" + ")" * N + "; }", True),
    ("javascript", "x=" + "[{a:" * N + "1" + "}]" * N, True),
    ("go", "package a\nvar x = " + "(" * N + "1" + ")" * N + "\n", True),
    ("python", "x=" + "f(" * N + "1" + ")" * N + "\n", True),
    ("yaml", "[" * N + "1" + "]" * N + "\n", True),
    ("shell", "echo " + "$(" * N + "a" + ")" * N + "\n", True),
    ("shell", "echo " + "$(a " * N, False),
    ("shell", "echo " + "$(($(" * N + "a" + ")) )" * N + "\n", True),
    ("shell", "echo " + "$(( $(a" * N + "x", False),
    ("shell", "(" * N + "a)" * N + "\n", False),
    ("shell", "echo " + "${a:-" * N + "a" + "}" * N + "\n", True),
    ("shell", 'echo "' + '$(echo "' * N + "a" + '")' * N + '"\n', True),
    ("shell", "[[ " + "( a && " * N + "a" + ")" * N + " ]]\n", True),
    ("shell", "{ " * N + "a; " + "}; " * N + "\n", True),
]


@pytest.mark.parametrize("at", range(len(DEEP)))
def test_deep_and_ambiguous(at):
    """Ten times the nesting takes about ten times as long; the limit leaves room for a slow machine."""
    lang, text, good = DEEP[at]
    failure(lang, "a")
    began = time.process_time()
    assert (failure(lang, text) is None) == good
    assert time.process_time() - began < 5


def test_comparisons_do_not_chain_in_rust():
    f = lambda e: failure("rust", f"fn f() {{ let x = {e}; }}")
    for good in ("a < b", "a < b && c < d", "(a < b) == c", "a < b || c >= d", "a << b < c", "a == b + 1", "a..b", "..=a", "a & b == c", "Vec::<Vec<u8>>::new()", "x as usize + 1 > y", "a = b == c", "a >>= b", "-a < -b", "|x| x < 1"):
        assert f(good) is None, good
    for bad in ("a < b < c", "a == b == c", "a < b == c", "a != b > c"):
        assert f(bad), bad


def test_bash_conditions_and_arrays():
    for good in ("[[ -n $a && ! ( $b == c* || $d ) ]]", "[[ a < b ]]", "[[ $x =~ ^(a|b)+$ ]]", "a=(1 'b c' $(d) # e\n f)", "[[ ! -f x ]] && y", "x=@(a|b(c))"):
        assert failure("shell", good + "\n") is None, good
    for bad in ("[[ && a ]]", "[[ a && ]]", "[[ ]]", "[[ ( a ]]", "[[ a ) ]]", "[[ a || || b ]]", "a=(b ; c)", "a=(b"):
        assert failure("shell", bad + "\n"), bad


def test_ambiguity_is_exact():
    """All words of a small ambiguous grammar against their enumeration."""
    from itertools import product

    m = Machine(Grammar("s: 'a' s 'b' | 'a' s 'c' | 'a' s | 'a' ;", "s"))

    def member(w: str) -> bool:
        return w == "a" or w[:1] == "a" and len(w) > 1 and (member(w[1:]) or w[-1] in "bc" and member(w[1:-1]))

    for n in range(1, 8):
        for word in product("abc", repeat=n):
            state = m.start()
            for c in word:
                state = state[c]
            assert state.complete == member("".join(word)), word


def test_tables_are_bounded_within_a_text():
    m = Machine(Grammar("s: ('x' | '(' s ')')* ;", "s"), max_states=50)
    state = m.start()
    for c in "(" * 3000 + "x" * 10 + ")" * 3000:
        state = state[c]
    assert state.complete and len(m.tables.states) < 7000
    state = m.start()
    for _ in range(2000):
        for c in "((x)":
            state = state[c]
        state = state[")"]
    assert state.complete and len(m.tables.entry) < 2000


def test_a_parser_that_gives_up_flags_its_row(monkeypatch):
    import graphloom.llm.syntax as syntax

    def broken(lang, text):
        raise RecursionError

    monkeypatch.setattr(syntax, "failure", broken)
    assert parsing.checked("go", "x") == (1, "RecursionError", "error")
    assert parsing.checked("go", None) is None
