"""Markers in the comments at the end of a text; none in strings there."""

import pytest

from graphloom.llm import handwritten
from graphloom.llm.comments import tail_comments

MARK = "@generated by x"
VARIED = {
    "py": 'import os\n\n\ndef read(path, *more):\n    """Don\'t # stop."""\n    with open(path) as f:\n        for x in f:\n            yield x.strip() if x else None\n\n\nclass A(dict):\n    a: int = 3\n\n    def __call__(self):\n        return [*self, -1] or {"a": self.a}\n',
    "sh": "#!/bin/sh\nset -eu\nx=$((1 << y))\ncat <<'E O' <<EOF\n# it's\nEOF\nfor i in \"$@\"; do\n  case $i in\n    *) echo \"${i#a}\" 'b' ;;\n  esac\ndone\n",
    "yaml": "a:\n  - b: |\n      # it's\n\n      text\n  - 'c # d'\n  - \"e\n    # f\"\ng: don't # h\ni: [1, {j: k}]\n",
    "go": "package a\n\nimport \"fmt\"\n\n// it's\nvar s = `// \"\n`\n\nfunc f(r rune) bool {\n\tfmt.Println('\"', \"/*\")\n\treturn r != '`'\n}\n",
    "rs": "/* a /* b */ c */\nfn f<'a>(x: &'a str) -> char {\n    let y = r#\"// \" \"#;\n    if x == y { '\"' } else { 'b' }\n}\n",
    "ts": "import { a } from 'a';\n\nconst re = /[`'\"/]/g;\nexport const t = `a ${b(`c ${ { d: '}' }.d } // e`)} f`;\nexport class G<T> {\n  h(): T | null {\n    return null; // i\n  }\n}\n",
    "unknown": "f x = '#' y\n  g \"--\"\nh\n",
}


@pytest.mark.parametrize("kind", list(VARIED))
def test_trailing_marks(kind):
    code = VARIED[kind]
    lead = "#" if kind in ("py", "sh", "yaml", "unknown") else "//"
    tails = [f"{lead} {MARK}\n", f"\n{lead} note\n{lead} {MARK}", f"{lead} {MARK}\n" + f"{lead} note\n" * 200]
    tails += [f"/*\n * {MARK}\n */\n"] if lead == "//" else []
    name = f"src/a.{kind}" if kind != "unknown" else "src/a"
    assert handwritten.text_rules(name, code)[0] == 0
    for tail in tails:
        for text in (code + tail, "\ufeff" + (code + tail).replace("\n", "\r\n")):
            assert handwritten.text_rules(name, text)[0] == handwritten.GENERATED | handwritten.COMMENT, tail
    assert handwritten.text_rules(name, f"{code}{lead} {MARK}\n{code}")[0] == 0
    assert handwritten.text_rules(name, f"{code}{lead} Scaffolded once with tool, maintained by hand since.\n")[0] == 0


@pytest.mark.parametrize("name,text", [
    ("a.py", "S = '''\n# @generated by x\n"), ("a.py", "def f():\n    \"\"\"a\n\n    # @generated by x\n    \"\"\"\n"),
    ("a.sh", "cat <<EOF\n# @generated by x\nEOF\n"), ("a.sh", "cat <<-'EOF' > a\n\t# @generated by x\n"), ("a", "#!/bin/bash\nx='\n# @generated by x\n"),
    ("a.yaml", "a: |\n  # @generated by x\n"), ("a.yaml", "- b: >-\n    c\n\n    # @generated by x\n"), ("a.yaml", "- |2\n   # @generated by x\n"),
    ("a.yaml", "b: c\n--- |\n# @generated by x\n"), ("a.yaml", "a: \"b\n  # @generated by x\n"),
    ("a.js", "const a = `${b}\n// @generated by x\n"), ("a.go", "var a = `\n// @generated by x\n"), ("a.rs", "const A: &str = r#\"\n// @generated by x\n"),
    ("a.rs", "const A: &str = \"\n// @generated by x\n"), ("a.py", "x = 1  # @generated by x\n"),
])
def test_strings_at_the_end(name, text):
    assert handwritten.text_rules(name, text)[0] == 0


def test_less_indented_comment_after_a_scalar():
    assert tail_comments("a.yaml", "a:\n  b: |\n    c\n  # d\n# e\n") == ["# d", "# e"]


def test_long_head():
    assert handwritten.text_rules("a.py", "# note\n" * 100 + f"# {MARK}\n" + VARIED["py"])[0] == handwritten.GENERATED | handwritten.COMMENT


def test_judge(spark):
    rows = [(1, 1, "a.py", VARIED["py"] + f"# {MARK}\n"), (2, 1, "b.py", VARIED["py"])]
    df = spark.createDataFrame(rows, "file_id long, repo_id long, rel string, text string")
    assert [(r["file_id"], r["generated"]) for r in handwritten.judge(df).collect()] == [(1, True)]
