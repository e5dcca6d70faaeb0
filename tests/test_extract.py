"""Extraction of the source languages, file by file."""

from graphloom.extract import extract
from graphloom.extract.common import cut_bytes, signature, type_basename


def kinds(lang, text):
    x = extract(lang, text)
    return [(s["name"], s["kind"]) for s in x["symbols"]], x


def test_typescript_shapes():
    got, x = kinds("typescript", (
        "\n\nfunction plain() {}\nexport const arrow = (a: number) => a + 1;\nclass Box { open(): void { helper(); } }\n"
        "interface Shape { area: number }\ntype Id = string;\nenum Color { Red }\nconst limit = 5;\n"
    ))
    assert got == [("plain", "function"), ("arrow", "function"), ("Box", "class"), ("open", "method"), ("Shape", "interface"), ("Id", "type"), ("Color", "enum")]
    assert x["symbols"][0]["start_line"] == 3
    call = x["calls"][0]
    assert call["callee"] == "helper" and x["symbols"][call["from"]]["name"] == "open" and x["containers"][3] == "Box"


def test_tsx_and_javascript():
    got, _ = kinds("tsx", "export const App = () => <div className='x'>{items.map((i) => <b key={i}>{i}</b>)}</div>;\n")
    assert got == [("App", "function")]
    got, x = kinds("javascript", "import { h } from './h.js';\nexport function view(a) { return h(a, '}'); }\n")
    assert got == [("view", "function")] and x["imports"] == ["./h.js"] and ("h", 0) in [(c["callee"], c["from"]) for c in x["calls"]]


def test_python_bindings_and_imports():
    src = (
        "import os\nfrom pkg.mod import a\nfrom ..up import b\n\nclass Keep:\n    def __init__(self, s: Store):\n        self.store = s\n"
        "        self.other = Thing()\n    def go(self):\n        self.store.get()\n\nk = Keep()\n"
    )
    got, x = kinds("python", src)
    assert got == [("Keep", "class"), ("__init__", "method"), ("go", "method")]
    assert x["imports"] == ["os", "pkg.mod", "..up"]
    assert {(b["name"], b["ty"], b["owner"]) for b in x["bindings"]} >= {("store", "Store", 0), ("other", "Thing", 0), ("k", "Keep", None)}
    assert {"from": 2, "callee": "get", "receiver": "self.store"} in x["calls"]


def test_python_with_syntax_errors_is_read_by_indentation():
    got, x = kinds("python", "import os\nclass A:\n    def f(self):\n        return g(1)\n\ndef broken(:\n    pass\n")
    assert got == [("A", "class"), ("f", "method"), ("broken", "function")]
    assert x["containers"][1] == "A" and x["imports"] == ["os"]


def test_go_receivers():
    got, x = kinds("go", (
        "package a\n\nimport \"fmt\"\n\ntype Worker struct{ n int }\n\nfunc (w *Worker) Run() { w.idle(); fmt.Println(\"{\") }\n"
        "func (Worker) Idle() {}\nfunc main() { w := Worker{}; w.Run() }\n"
    ))
    assert got == [("Worker", "type"), ("Run", "method"), ("Idle", "method"), ("main", "function")]
    assert x["containers"] == [None, "Worker", "Worker", None]
    assert (1, "w", "Worker") in [(b["owner"], b["name"], b["ty"]) for b in x["bindings"]]


def test_rust_impl():
    got, x = kinds("rust", (
        "use crate::db::helper;\npub struct Store;\nimpl Store {\n    pub fn open(&self, p: &Path) { helper(); }\n}\nfn main() { let s: Store = make(); s.open(); }\n"
    ))
    assert got == [("Store", "struct"), ("open", "method"), ("main", "function")]
    assert x["containers"][1] == "Store" and x["imports"] == ["crate::db::helper"]


def test_shell_and_yaml():
    got, x = kinds("shell", ". ./lib.sh\nhelper() {\n  echo 'a } b'\n}\nbuild() {\n  helper x\n}\n")
    assert got == [("helper", "function"), ("build", "function")] and x["imports"] == ["./lib.sh"]
    assert (1, "helper") in [(c["from"], c["callee"]) for c in x["calls"]]
    got, x = kinds("yaml", "jobs:\n  build: &linux\n    steps:\n      - uses: ./act\n  other: *linux\n")
    assert ("jobs.build.steps.uses", "key") in got and ("linux", "anchor") in got and x["imports"] == ["./act"]
    assert x["calls"][0]["callee"] == "linux"


def test_bytes_and_names():
    long = "é" * 150
    assert signature(long).endswith("…") and len(signature(long).encode()) <= 203
    assert cut_bytes("aé", 2) == "a" and signature("f() {\nx") == "f()"
    assert type_basename("&'a mut std::vec::Vec<T>") == "Vec"


def test_nothing_to_read():
    for lang, text in (("python", None), ("python", ""), (None, "x"), ("cobol", "x")):
        assert extract(lang, text)["symbols"] == []
    for lang in ("python", "typescript", "go", "rust", "shell", "yaml"):
        extract(lang, "}}} ((( \x00 '\"` <<EOF")
