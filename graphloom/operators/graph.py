"""Extractions to a property graph of files, symbols and edges, by joins.

Names are resolved over the whole repository whenever the graph is built, since a new
definition anywhere can change any caller; only extraction is incremental. Every join is
an equi join on keys of the data (name; container and name; file and name; candidate
path), so it is distributed by hash and skew-handled by AQE. Names that occur very often
are ambiguous and leave the uniqueness join after a partial count.

Edge kinds: contains (file or symbol to member), imports (file to file or module), calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.functions import text as T
from graphloom.schema import EXTRACT, SYMBOLS_PER_FILE

NODE_KINDS = ("file", "module")


def extract_files(files: DataFrame, keep: tuple[str, ...] = ("file_id",), lang: str = "lang", body: str = "text") -> DataFrame:
    """The columns ``keep`` and the extraction of each file: a map over rows."""
    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep)
    schema = to_arrow_schema(StructType.fromDDL(EXTRACT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.extract import extract

        for batch in batches:
            langs, texts = batch.column("__lang"), batch.column("__text")
            rows = [extract(langs[i].as_py(), texts[i].as_py()) for i in range(batch.num_rows)]
            for r in rows:
                if len(r["symbols"]) >= SYMBOLS_PER_FILE:
                    raise ValueError(f"a file has {len(r['symbols'])} symbols; ids have room for {SYMBOLS_PER_FILE - 1}")
            made = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*keep, *schema.names])

    rows = files.select(*keep, F.col(lang).alias("__lang"), F.col(body).alias("__text"))
    return rows.mapInArrow(run, f"{kinds}, {EXTRACT}")


def symbol_id(file_id: Column, ordinal: Column) -> Column:
    """Ids that do not depend on partitions: file number and place in the file; 0 is the file itself."""
    return file_id * SYMBOLS_PER_FILE + ordinal + 1


def symbols_of(files: DataFrame, extracts: DataFrame) -> DataFrame:
    """Symbol rows, the file nodes among them (kind ``file``, ordinal -1)."""
    own = extracts.select(
        "file_id", F.posexplode(F.arrays_zip("symbols", "containers")).alias("ordinal", "z")
    ).select("file_id", "ordinal", "z.symbols.*", F.col("z.containers").alias("container"))
    rows = files.select("repo_id", "file_id").join(own, "file_id").select(
        "repo_id", "file_id", symbol_id(F.col("file_id"), F.col("ordinal")).alias("id"), "ordinal", "name", "kind",
        "start_line", "end_line", "signature", F.col("search_text").alias("summary"), "container",
    )
    n_lines = F.greatest(F.size(T.lines(F.coalesce("text", F.lit("")))), F.lit(1)) if "text" in files.columns else F.lit(1)
    nodes = files.select(
        "repo_id", "file_id", symbol_id(F.col("file_id"), F.lit(-1)).alias("id"), F.lit(-1).alias("ordinal"),
        F.col("path").alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("start_line"),
        n_lines.cast("long").alias("end_line"), F.lit(None).cast("string").alias("signature"),
        (T.first_bytes(F.col("text"), 32 * 1024) if "text" in files.columns else F.lit(None).cast("string")).alias("summary"),
        F.lit(None).cast("string").alias("container"),
    )
    return rows.unionByName(nodes)


def contains_edges(extracts: DataFrame, files: DataFrame) -> DataFrame:
    links = extracts.select("file_id", F.posexplode("parents").alias("ordinal", "parent"))
    return files.select("repo_id", "file_id").join(links, "file_id").select(
        "repo_id",
        symbol_id(F.col("file_id"), F.coalesce("parent", F.lit(-1))).alias("src"),
        symbol_id(F.col("file_id"), F.col("ordinal")).alias("dst"),
        F.lit("contains").alias("kind"),
    )


# -- calls

def unique_by(defs: DataFrame, *keys: str) -> DataFrame:
    """One row (keys, dst) for every key that has exactly one definition."""
    return (
        defs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).filter("n = 1").drop("n")
    )


def resolve_bare(calls: DataFrame, defs: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """dst of calls (.., callee, src): the only definition of the name, else the caller itself
    if it is one of several (recursion), else null."""
    by_name = unique_by(defs, *keys, "name").withColumnRenamed("name", "callee")
    out = calls.join(by_name, [*keys, "callee"], "left")
    self_defs = defs.select(*keys, F.col("name").alias("callee"), F.col("id").alias("src"), F.col("id").alias("self"))
    out = out.join(self_defs.distinct(), [*keys, "callee", "src"], "left")
    return out.withColumn("dst", F.coalesce("dst", "self")).drop("self")


def resolve_typed(calls: DataFrame, defs: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """dst of calls (.., type, callee): the only member of that type and name, no fallback."""
    by_member = unique_by(defs.filter(F.col("container").isNotNull()), *keys, "container", "name")
    by_member = by_member.withColumnRenamed("container", "type").withColumnRenamed("name", "callee")
    return calls.join(by_member, [*keys, "type", "callee"], "left")


def receiver_types(calls: DataFrame, extracts: DataFrame) -> DataFrame:
    """Adds ``type`` to calls (file_id, at, from, callee, receiver, container, ..) that have a receiver.

    this/self: the caller's container. this.f/self.f: the binding of ``this.f``, else f, in
    the class named like the container. Other receivers: the binding in the caller, else at
    the top of the file. Of repeated bindings the last counts.
    """
    binds = (
        extracts.select("file_id", F.posexplode("bindings").alias("at", "b"))
        .groupBy("file_id", F.coalesce("b.owner", F.lit(-1)).alias("owner"), F.col("b.name").alias("bound"))
        .agg(F.max_by("b.ty", "at").alias("ty"))
    )
    classes = (
        extracts.select("file_id", F.posexplode("symbols").alias("class_at", "s"))
        .filter(F.col("s.kind") == "class")
        .groupBy("file_id", F.col("s.name").alias("container"))
        .agg(F.min("class_at").alias("class_at"))
    )
    c = calls.join(classes, ["file_id", "container"], "left")
    own = F.col("receiver").isin("this", "self")
    field = F.when(F.col("receiver").rlike(r"^(this|self)\."), F.regexp_extract("receiver", r"^(?:this|self)\.(.*)$", 1))
    plain = F.when(~own & field.isNull(), F.col("receiver"))
    # All places a binding may be looked for, best first, in one join.
    place = lambda k, owner, bound: F.struct(F.lit(k).alias("k"), owner.cast("int").alias("owner"), bound.alias("bound"))
    places = F.array(
        place(0, F.col("class_at"), F.concat(F.lit("this."), field)), place(1, F.col("class_at"), field),
        place(2, F.coalesce("from", F.lit(-1)), plain), place(3, F.lit(-1), plain),
    )
    asked = c.select("file_id", "at", F.explode(F.filter(places, lambda x: x["owner"].isNotNull() & x["bound"].isNotNull())).alias("p"))
    found = (
        asked.select("file_id", "at", "p.*").join(binds, ["file_id", "owner", "bound"])
        .groupBy("file_id", "at").agg(F.min_by("ty", "k").alias("bound_type"))
    )
    out = c.join(found, ["file_id", "at"], "left")
    return out.withColumn("type", F.when(own, F.col("container")).otherwise(F.col("bound_type"))).drop("bound_type", "class_at", "container")


def call_sites(files: DataFrame, extracts: DataFrame) -> DataFrame:
    sites = extracts.select("file_id", "containers", F.posexplode("calls").alias("at", "c")).select(
        "file_id", "at", "c.*", F.get("containers", F.col("c.from")).alias("container")
    )
    return files.select("repo_id", "file_id").join(sites, "file_id").withColumn(
        "src", symbol_id(F.col("file_id"), F.coalesce("from", F.lit(-1)))
    )


def call_edges(files: DataFrame, extracts: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, call sites with their dst or null)."""
    defs = symbols.filter(~F.col("kind").isin(*NODE_KINDS)).select("repo_id", "id", "name", "container")
    sites = call_sites(files, extracts)
    bare = resolve_bare(sites.filter(F.col("receiver").isNull()).select("repo_id", "callee", "src"), defs)
    typed = receiver_types(sites.filter(F.col("receiver").isNotNull()), extracts)
    typed = resolve_typed(typed.select("repo_id", "type", "callee", "src"), defs)
    cols = ["repo_id", "src", "dst", "callee"]
    resolved = bare.select(*cols).unionByName(typed.select(*cols))
    edges = resolved.filter(F.col("dst").isNotNull()).select("repo_id", "src", "dst", F.lit("calls").alias("kind")).distinct()
    return edges, resolved


# -- imports

_JS = ("typescript", "tsx", "javascript")


def import_candidates(path: Column, lang: Column, spec: Column) -> Column:
    """Paths that an import may mean, best first; empty if it can mean no file of the repository.

    Go packages are matched by folder instead (:func:`go_package`).
    """
    folder = T.parent_dir(path)
    relative = lambda s: T.normalize_path(F.concat_ws("/", folder, s))
    none = F.array().cast("array<string>")

    stem = relative(spec)
    base = F.regexp_replace(stem, r"\.js$", "")
    js = F.array(
        *[F.concat(base, F.lit(e)) for e in (".ts", ".tsx", ".js", ".mjs", ".cjs")], stem,
        *[F.concat(base, F.lit(f"/index{e}")) for e in (".ts", ".tsx", ".js", ".mjs", ".cjs")],
    )
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("")
    py_stem = F.when(dots == 0, T.normalize_path(module)).otherwise(relative(F.concat(up, module)))
    py = F.array(F.concat(py_stem, F.lit(".py")), F.concat(py_stem, F.lit("/__init__.py")))
    shell = F.array(relative(spec), T.normalize_path(spec))
    root_path = T.normalize_path(spec)
    yaml = F.array(root_path, F.concat(root_path, F.lit("/action.yml")), F.concat(root_path, F.lit("/action.yaml")))
    return (
        F.when(lang.isin(*_JS), F.when(spec.startswith("."), js).otherwise(none))
        .when(lang == "python", py)
        .when(lang == "shell", F.when(spec.contains("$") | spec.contains("`"), none).otherwise(shell))
        .when(lang == "yaml", F.when(spec.startswith("."), yaml).otherwise(none))
        .when(lang == "rust", rust_candidates(path, spec))
        .otherwise(none)
    )


def rust_candidates(path: Column, spec: Column) -> Column:
    """Longest module prefix first, ``.rs`` before ``/mod.rs``; outside paths have none."""
    none = F.array().cast("array<string>")
    folder = T.parent_dir(path)
    crate = F.when(path.rlike(r"/src/"), F.regexp_extract(path, r"^(.*/src)/", 1)).when(path.startswith("src/"), "src").otherwise(folder)
    raw = F.substring_index(F.substring_index(spec, " as ", 1), "{", 1)
    raw = F.regexp_replace(F.regexp_replace(raw, r":+$", ""), r"(?:::\*)+$", "")
    head = F.regexp_extract(raw, r"^(crate|self|super)::", 1)
    base = F.when(head == "crate", crate).when(head == "super", T.parent_dir(folder)).otherwise(folder)
    rest = F.regexp_replace(raw, r"^(crate|self|super)::", "")
    parts = F.filter(F.split(rest, "::"), lambda p: (p != "") & (p != "self"))
    local = ((head != "") | ~raw.contains("::")) & (rest != "") & (F.size(parts) > 0)
    prefixes = F.transform(
        F.sequence(F.greatest(F.size(parts), F.lit(1)), F.lit(1), F.lit(-1)),
        lambda k: T.normalize_path(F.concat_ws("/", base, F.array_join(F.slice(parts, 1, k), "/"))),
    )
    both = F.flatten(F.transform(prefixes, lambda m: F.array(F.concat(m, F.lit(".rs")), F.concat(m, F.lit("/mod.rs")))))
    return F.when(local, both).otherwise(none)


def go_package(spec: Column, module: Column) -> Column:
    """The folder of a Go import within the module, or null."""
    inside = F.when(spec == module, F.lit("")).when(spec.startswith(F.concat(module, F.lit("/"))), F.expr("substring(spec, length(module) + 2)"))
    return F.when(module.isNotNull(), inside)


def import_sites(files: DataFrame, extracts: DataFrame) -> DataFrame:
    """(repo_id, file_id, path, lang, spec), each specifier of a file once."""
    specs = extracts.select("file_id", F.explode("imports").alias("spec")).distinct()
    return files.select("repo_id", "file_id", "path", "lang").join(specs, "file_id")


def first_match(sites: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, file_id, spec, target): the first candidate that is a file."""
    asked = sites.select(
        "repo_id", "file_id", "spec", F.posexplode(import_candidates(F.col("path"), F.col("lang"), F.col("spec"))).alias("at", "candidate")
    )
    known = files.select("repo_id", F.col("path").alias("candidate"), F.col("file_id").alias("target"))
    return (
        asked.join(known, ["repo_id", "candidate"])
        .groupBy("repo_id", "file_id", "spec")
        .agg(F.min_by("target", F.struct("at", "target")).alias("target"))
    )


def import_edges(files: DataFrame, extracts: DataFrame, modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, module symbols). ``modules``: (repo_id, module) of repositories with a go.mod.

    A specifier that means no file becomes one module node per repository, anchored at the
    first file (by path) that imports it; its id is below nought.
    """
    sites = import_sites(files, extracts)
    hits = first_match(sites.filter(F.col("lang") != "go"), files)
    go = sites.filter(F.col("lang") == "go")
    if modules is not None:
        folders = files.filter(F.col("path").endswith(".go")).select(
            "repo_id", T.parent_dir(F.col("path")).alias("package"), F.col("file_id").alias("target")
        )
        go_hits = (
            go.join(modules, "repo_id").withColumn("package", go_package(F.col("spec"), F.col("module")))
            .join(folders, ["repo_id", "package"]).select("repo_id", "file_id", "spec", "target")
        )
        hits = hits.unionByName(go_hits)
    inner = hits.select(
        "repo_id", symbol_id(F.col("file_id"), F.lit(-1)).alias("src"), symbol_id(F.col("target"), F.lit(-1)).alias("dst")
    )
    outside = sites.join(hits.select("repo_id", "file_id", "spec").distinct(), ["repo_id", "file_id", "spec"], "left_anti")
    anchors = outside.groupBy("repo_id", "spec").agg(F.min_by("file_id", F.struct("path", "file_id")).alias("anchor"))
    module_id = -F.abs(F.xxhash64("repo_id", "spec")) - 1
    nodes = anchors.select(
        "repo_id", F.col("anchor").alias("file_id"), module_id.alias("id"), F.lit(-1).alias("ordinal"), F.col("spec").alias("name"),
        F.lit("module").alias("kind"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("container"),
    )
    outer = outside.select("repo_id", symbol_id(F.col("file_id"), F.lit(-1)).alias("src"), module_id.alias("dst"))
    edges = inner.unionByName(outer).withColumn("kind", F.lit("imports")).distinct()
    return edges, nodes


def build(files: DataFrame, extracts: DataFrame, modules: DataFrame | None = None) -> dict[str, DataFrame]:
    """symbols, edges and resolved call sites of a repository set.

    ``files`` needs repo_id, file_id, path, lang (text, if file nodes should carry it).
    """
    own = symbols_of(files, extracts)
    imports, module_nodes = import_edges(files, extracts, modules)
    calls, sites = call_edges(files, extracts, own)
    edges = contains_edges(extracts, files).unionByName(imports).unionByName(calls).distinct()
    return {"symbols": own.unionByName(module_nodes), "edges": edges, "sites": sites}


def stats(files: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """files, symbols, edges and unresolved calls in one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        one(files, "files").join(F.broadcast(one(graph["symbols"], "symbols"))).join(F.broadcast(one(graph["edges"], "edges")))
        .join(F.broadcast(one(graph["sites"].filter(F.col("dst").isNull()), "unresolved")))
    )
