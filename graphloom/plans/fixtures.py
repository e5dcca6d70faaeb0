"""Graphs of small repositories made from rows, whose edges SQL can name in closed form.

Every nation becomes a repository with files of seven languages that import and call each
other; the generator writes modules that each import and call the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.runtime import cut, read_table

#: Files of one repository: path, language, text; ``@`` is the repository's number.
FILES = [
    ("app/main.py", "python", "from app.store import Store\n\n\ndef run@():\n    helper@()\n    s = Store()\n    s.save@()\n\n\ndef helper@():\n    pass\n"),
    ("app/store.py", "python", "from . import util\n\n\nclass Store:\n    def __init__(self, log: Log):\n        self.log = log\n\n    def save@(self):\n        self.log.write@()\n        self.flush@()\n\n    def flush@(self):\n        pass\n"),
    ("app/util.py", "python", "class Log:\n    def write@(self):\n        pass\n"),
    ("app/__init__.py", "python", ""),
    ("cmd/main.go", "go", "package main\n\nimport (\n\t\"fmt\"\n\n\t\"example.com/m@/pkg\"\n)\n\nfunc start@() {\n\tprepare@()\n\tfmt.Println(pkg.Name)\n}\n\nfunc prepare@() {\n}\n"),
    ("pkg/a.go", "go", "package pkg\n\ntype Worker struct{}\n\nfunc (w Worker) Work@() {\n\tw.rest@()\n}\n\nfunc (w Worker) rest@() {\n}\n"),
    ("pkg/b.go", "go", "package pkg\n\nvar Name = 1\n"),
    ("src/lib.rs", "rust", "mod db;\nuse crate::db::query@;\n\npub fn load@() {\n    query@();\n}\n"),
    ("src/db.rs", "rust", "pub fn query@() {\n}\n"),
    ("web/a.ts", "typescript", "import { open@ } from './b.js';\nimport x from 'left-pad';\n\nexport function boot@() {\n  open@();\n}\n"),
    ("web/b.ts", "typescript", "export function open@() {\n}\n\nexport class Door {\n  key: Key;\n  turn@() {\n    this.key.fit@();\n    this.shut@();\n  }\n  shut@() {\n  }\n}\n\nexport class Key {\n  fit@() {\n  }\n}\n"),
    ("bin/go.sh", "shell", "source ./lib.sh\n\nmain@() {\n  say@ hello\n}\n"),
    ("bin/lib.sh", "shell", "say@() {\n  echo \"$1\"\n}\n"),
    ("ci.yaml", "yaml", "job@:\n  steps:\n    - uses: ./act\n"),
    ("act/action.yml", "yaml", "name: act\n"),
]
#: Their edges, contains left out: kind, path and name of both ends; a module has no path.
EDGES = [
    ("imports", "app/main.py", "app/main.py", "app/store.py", "app/store.py"),
    ("calls", "app/main.py", "run@", "app/main.py", "helper@"),
    ("calls", "app/main.py", "run@", "app/store.py", "Store"),
    ("calls", "app/main.py", "run@", "app/store.py", "save@"),
    ("imports", "app/store.py", "app/store.py", "app/__init__.py", "app/__init__.py"),
    ("calls", "app/store.py", "save@", "app/util.py", "write@"),
    ("calls", "app/store.py", "save@", "app/store.py", "flush@"),
    ("imports", "cmd/main.go", "cmd/main.go", "pkg/a.go", "pkg/a.go"),
    ("imports", "cmd/main.go", "cmd/main.go", "pkg/b.go", "pkg/b.go"),
    ("imports", "cmd/main.go", "cmd/main.go", None, "fmt"),
    ("calls", "cmd/main.go", "start@", "cmd/main.go", "prepare@"),
    ("calls", "pkg/a.go", "Work@", "pkg/a.go", "rest@"),
    ("imports", "src/lib.rs", "src/lib.rs", "src/db.rs", "src/db.rs"),
    ("calls", "src/lib.rs", "load@", "src/db.rs", "query@"),
    ("imports", "web/a.ts", "web/a.ts", "web/b.ts", "web/b.ts"),
    ("imports", "web/a.ts", "web/a.ts", None, "left-pad"),
    ("calls", "web/a.ts", "boot@", "web/b.ts", "open@"),
    ("calls", "web/b.ts", "turn@", "web/b.ts", "fit@"),
    ("calls", "web/b.ts", "turn@", "web/b.ts", "shut@"),
    ("imports", "bin/go.sh", "bin/go.sh", "bin/lib.sh", "bin/lib.sh"),
    ("calls", "bin/go.sh", "main@", "bin/lib.sh", "say@"),
    ("imports", "ci.yaml", "ci.yaml", "act/action.yml", "act/action.yml"),
]
MODULES = 400


def repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files with texts, modules of go.mod) of one repository a nation."""
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("repo_id"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("path"), F.lit(g).alias("lang"), F.lit(t).alias("text")) for i, (p, g, t) in enumerate(FILES)]))
    rows = nations.select("repo_id", each.alias("f")).select(
        "repo_id", (F.col("repo_id") * len(FILES) + F.col("f.i")).alias("file_id"), "f.path", "f.lang",
        F.replace("f.text", F.lit("@"), F.col("repo_id").cast("string")).alias("text"),
    )
    return rows, nations.select("repo_id", F.concat(F.lit("example.com/m"), F.col("repo_id").cast("string")).alias("module"))


def generated(spark: SparkSession, n: int = MODULES) -> DataFrame:
    """Modules of three definitions and a method; each but the first imports and calls the one before."""
    i = F.col("i").cast("string")
    before = (F.col("i") - 1).cast("string")
    first = F.when(F.col("i") > 0, F.concat(F.lit("import { process_payment_"), before, F.lit("_0 } from './module_"), before, F.lit("';\n\n"))).otherwise("")
    onward = F.when(F.col("i") > 0, F.concat(F.lit("  process_payment_"), before, F.lit("_0(x);\n"))).otherwise("")
    text = F.concat(
        first, F.lit("export function process_payment_"), i, F.lit("_0(x) {\n  validate_gateway_"), i, F.lit("(x);\n"), onward, F.lit("}\n\n"),
        F.lit("export function validate_gateway_"), i, F.lit("(x) {\n  return x;\n}\n\nexport class PaymentService"), i,
        F.lit(" {\n  process(x) {\n    return process_payment_"), i, F.lit("_0(x);\n  }\n}\n"),
    )
    return spark.range(n).withColumnRenamed("id", "i").select(
        F.lit(1).cast("long").alias("repo_id"), F.col("i").alias("file_id"), F.concat(F.lit("src/module_"), i, F.lit(".ts")).alias("path"),
        F.lit("typescript").alias("lang"), text.alias("text"),
    )


def built(files: DataFrame, modules: DataFrame | None = None) -> dict[str, DataFrame]:
    extracts = cut(graph.extract_files(files))
    return graph.build(files, extracts, modules)


def named_edges(files: DataFrame, g: dict[str, DataFrame]) -> DataFrame:
    """(repo_id, kind, src_path, src, dst_path, dst) by names instead of ids."""
    where = files.select("file_id", "path")
    nodes = g["symbols"].join(where, "file_id").select("repo_id", "id", "name", F.when(F.col("kind") != "module", F.col("path")).alias("path"))
    end = lambda side: nodes.select("repo_id", F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("path").alias(f"{side}_path"))
    e = g["edges"].filter(F.col("kind") != "contains").join(end("src"), ["repo_id", "src"]).join(end("dst"), ["repo_id", "dst"])
    return e.select("repo_id", "kind", "src_path", F.col("src_name").alias("src"), "dst_path", F.col("dst_name").alias("dst"))
