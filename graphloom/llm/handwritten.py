"""Generated, minified, vendored and data files among source files.

Three kinds of evidence, from one pass over the texts and one over the trees:

* the comments at the top or the end of a file say that a tool made it, or whose copy it is;
* its layout does: code without line structure, numbered members of one shape over and
  over, or nothing but literals;
* the tree does: third-party folders, and folders (or single files) whose Merkle hash
  occurs in repositories that are not related. Hashes are built bottom-up from file
  contents, a folder's from the names and hashes of its children; a folder shared across
  families of repositories is somebody else's code. Comments, blanks and line ends do not
  count, nor, in a file of some length, what its identifiers are called: a copy whose
  licence line was dropped or whose names were changed is still the same tree.

A holder of copyright is a stranger unless the repository's own: the one the text calls its
own project, or one that a fifth of the repository's files name. What a hash proves depends
on how much a file says (``MIN_WORDS`` different words); files that say less count only
within their folder. :func:`judge` reports for each file which evidence found it.

Repositories with one git_common_dir are worktrees of each other and count as one.

Nulls and edge cases
* null and empty texts are judged by their path alone; a null path by the text alone;
* rows without file_id are left out; repeated rows count once, and of several contents
  of one path in the tree the largest hash stands for the path;
* a null repository shares nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.comments import tail_comments
from graphloom.runtime import cut, small_side, spread

#: Different words that a shared file or folder must have to be evidence by itself.
MIN_WORDS = 12
#: Tokens from which a file is compared without the names of its identifiers.
MIN_RENAMED = 200
#: Share of a repository's files (and least number) whose copyright line makes a holder its own.
OWN_SHARE, OWN_FILES = 0.2, 5

GENERATED, MINIFIED, VENDORED, DATA = 1, 2, 4, 8
#: Which evidence: comments, layout, the path, the trees.
COMMENT, LAYOUT, PATH, TREE = 16, 32, 64, 128

# -- the comments at the top and the end

_EDIT = re.compile(
    r"\b(?:do not|don't|never|please do not|should not be|must not be) (?:manually |ever )?(?:edit|modify|change|touch)(?:ed|ied|d)?\b"
    r"|\b(?:nicht|keinesfalls) (?:von hand |manuell )?(?:ändern|aendern|bearbeiten|anfassen)|\bvon hand\b"
    r"|\bne pas (?:modifier|éditer|editer|toucher)\b|\bno (?:editar|modificar|edite|modifique|tocar)\b",
    re.I,
)
#: Says by itself that a tool wrote the file.
_TOOL = re.compile(
    r"@generated\b|<auto-?generated|\bauto[- ]?generated (?:file|code|by|from|with)\b"
    r"|\b(?:code|file|source|module) (?:was |is |has been )?(?:automatically |auto[- ]?|machine[- ])generated\b"
    r"|\bcode generated (?:by|from|with)\b|^\W*generated by (?:the )?\S+ (?:compiler|generator|tool)\b"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b"
    r"|\bg[ée]n[ée]r[ée]e? automatiquement\b|\bgenerado autom[áa]ticamente\b",
    re.I,
)
#: Says so if the line also forbids editing.
_MADE = re.compile(
    r"\bgenerated (?:automatically|by|from|with|using)\b|\b(?:produced|created|built|written|emitted) by \S"
    r"|\bvon \S+ (?:erzeugt|generiert|erstellt)\b|\bg[ée]n[ée]r[ée]e? par\b|\b(?:generado|creado) por\b",
    re.I,
)
#: Says so if it is all the line says: a tool, its version, a time.
_BY = re.compile(r"\W*(?:this file (?:was|is) )?(?:auto-?)?generated (?:by|with|using) (?!hand\b)(\S+(?: \S+){0,5})\W*", re.I)
_DONT = re.compile(r"^\W*do not (?:edit|modify|touch)\b(?!.*\bwithout\b)", re.I)
_FROM = re.compile(r"\b(?:copied|vendored|imported|taken|mirrored|adapted) (?:verbatim )?from \S", re.I)
_AS_IS = re.compile(r"\b(?:without changes|unchanged|unmodified|upstream|verbatim|as[- ]is)\b", re.I)
_RIGHTS = re.compile(r"(?:\(c\)|©|\bcopyright\b|\bcopr\.)(?:\W*(?:\(c\)|©|copyright))*", re.I)
_YEARS = re.compile(r"[\s,:;-]*(?:\d{4}(?:\s*[-–,]\s*(?:\d{4}|present|now))*[\s,]*)*(?:by\s+)?", re.I)
_HOLDER_END = re.compile(r"[|;]|(?<=\w\w)\.(?=\s|$)|,? (?:all rights|released under|licensed|under the|and is|see)\b|<|https?:|\*/|\(http", re.I)
_OURS = re.compile(r"\b(?:this|our|the) (?:project|repository|repo|package|team)\b|^(?:us|me|ourselves)?$", re.I)
_LICENCE = re.compile(
    r"@licen[sc]e\b|@preserve\b|\blicen[sc]ed under\b|\breleased under\b|\bunder the terms of\b|\b(?:MIT|BSD|ISC|Apache|MPL|LGPL|GPL|EPL|Zlib|Unlicense)\b(?:[- ][\w.]+)*"
    r"|\bfreely distributed\b|\ball rights reserved\b|https?://\S*licen[sc]e",
    re.I,
)
_BANNER = re.compile(r"[^\w@]*(?:@licen[sc]e\s+)?(@?[A-Za-z][\w.+/-]*(?: [A-Za-z][\w.+-]*){0,2}) v?(\d+\.\d+(?:\.\d+)*[\w.+-]*)(?P<rest>.*)", re.S)
_TAGGED = re.compile(r"@licen[sc]e\s+(?!MIT\b|BSD|Apache|ISC|GPL|LGPL|MPL)[A-Za-z]")
_HEAD = re.compile(r"(?:[ \t]*(?://|#|--|;;|%|/\*|\*|<!--)[^\n]*|[ \t]*)(?:\n|\Z)")


def head_comments(text: str) -> list[str]:
    """Lines of the comments before the first line of code, shebang and all."""
    out: list[str] = []
    inside = False
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        at = end + 1
        if inside:
            out.append(line.lstrip("* "))
            inside = "*/" not in line
        elif line.startswith("/*"):
            out.append(line)
            inside = "*/" not in line
        elif line.startswith(("//", "#", "--", ";;", "<!--")):
            if not line.startswith("#!"):
                out.append(line)
        elif line:
            break
    return out


def holder_of(line: str) -> str | None:
    """Whom a copyright line names, in lower case; "" for the project itself; None without such a line."""
    m = _RIGHTS.search(line)
    if m is None:
        return None
    rest = line[_YEARS.match(line, m.end()).end():]
    end = _HOLDER_END.search(rest)
    name = (rest[:end.start()] if end else rest).strip(" \t*/#.,;:-").lower()
    name = re.sub(r"^the ", "", name)
    if _OURS.search(name):
        return ""
    return name if name[:1].isalpha() and len(name.split()) <= 8 else None


def tool_made(line: str) -> bool:
    """Every search is a single forward pass: nothing is tried again from each place of a long line."""
    if _TOOL.search(line) or _DONT.search(line):
        return True
    made = _MADE.search(line)
    if made and _EDIT.search(line, made.end()):
        return True
    return len(line) < 160 and _BY.fullmatch(line) is not None


def comment_rules(rel: str | None, text: str) -> tuple[int, str | None]:
    """Kinds that the comments at the top and the end show, and the holder of copyright they name."""
    found, holder = 0, None
    head = head_comments(text)
    for line in head + tail_comments(rel, text):
        if tool_made(line):
            found |= GENERATED
        copy = _FROM.search(line)
        if copy and _AS_IS.search(line, copy.end()):
            found |= VENDORED
        if holder is None:
            holder = holder_of(line)
    # A banner: a name and a version first, and a licence, rights or an address in the same comment.
    first = next((k for k, x in enumerate(head) if x.strip("/*#!- \t")), None)
    if first is not None and (m := _BANNER.match(head[first])):
        rest = m["rest"].strip(" */-")
        plain = not rest or rest[0] in "|(-,;©" or rest.startswith(("http", "by "))
        if plain and any(_LICENCE.search(x) or _RIGHTS.search(x) or "http" in x for x in [rest, *head[first + 1:]]):
            found |= VENDORED
    if any(_TAGGED.search(x) for x in head) or head and head[0].startswith("/*!") and any(_LICENCE.search(x) or _RIGHTS.search(x) for x in head):
        found |= VENDORED
    if holder == "" and not found & VENDORED:
        holder = None
    return found, holder or None


# -- layout

_LITERAL = re.compile(r"""[-+\s,0-9a-fA-FxXobn_.eE'"\[\](){};:]*""")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{80,}")
_NUMBERS = re.compile(r"(?<![\w.])-?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])[,\s]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_OPENS = re.compile(r"//[^\n]*|#[^\n]*|/\*")
_WORD = re.compile(r"[^\W\d]\w*")
_DIGITS = re.compile(r"\d+")
_MEMBER = re.compile(r"(?<!\w)([^\W\d](?:\w*[^\W\d])?)(\d++)\b")


def without_comments(text: str) -> str:
    """In one pass; a block that is not closed runs to the end."""
    out, at = [], 0
    while m := _OPENS.search(text, at):
        out.append(text[at:m.start()])
        at = m.end()
        if m.group() == "/*":
            at = text.find("*/", at) + 2
            if at < 2:
                at = len(text)
    out.append(text[at:])
    return "".join(out)


def is_data(text: str, share: float = 0.75, code_lines: int = 8) -> bool:
    """Nearly all of the text is numbers or one encoded blob, and hardly any line is code."""
    size = len(text) - text.count(" ") - text.count("\n") - text.count("\t")
    if size < 200:
        return False
    blobs = sum(len(m) for m in _BLOB.findall(text) if len(set(m)) > 12)
    plain = text if not blobs else _BLOB.sub(" ", text)
    numbers = 0
    if sum(c in "0123456789" for c in plain[:2000]) or blobs < share * size:
        numbers = sum(len(m.replace(" ", "").replace("\n", "").replace("\t", "")) for m in _NUMBERS.findall(plain))
    marks = sum(text.count(c) for c in "-\"'")
    if blobs + numbers + min(marks, numbers) < share * size:
        return False
    code = 0
    for line in text.split("\n"):
        if len(line) < 400 and len(_WORD.findall(_NUMBERS.sub("", line))) >= 2 and not _BLOB.search(line):
            code += not line.lstrip().startswith(("//", "#", "*", "/*"))
    return code <= code_lines


def is_minified(text: str, line: int = 240, share: float = 0.5) -> bool:
    """Most of the text is in long lines of dense code (strings and comments do not count)."""
    if not any(len(x) > line for x in text.split("\n")):
        return False
    bare = without_comments(_STRING.sub('""', text)) if "://" not in text else _STRING.sub('""', text)
    lines = bare.split("\n")
    long_ = [x for x in lines if len(x) > line]
    chars = sum(map(len, long_))
    if chars < share * max(1, sum(len(x.strip()) for x in lines)):
        return False
    blanks = sum(x.count(" ") + x.count("\t") for x in long_)
    marks = sum(x.count(c) for x in long_ for c in ";{}()")
    return blanks < 0.12 * chars and marks > 0.05 * chars


#: Shapes of lines that a numbered family of members may have, with its frame, and more for every so many lines.
MOST_SHAPES, LINES_A_SHAPE = 12, 40


def is_repetitive(text: str, members: int = 4) -> bool:
    """Numbered members in one shape over and over: k, k + 1, ... in lines of few shapes."""
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x and not x.startswith(("//", "#", "*", "/*"))]
    if len(lines) < 8:
        return False
    shapes: dict[str, list[str]] = {}
    for x in lines:
        shapes.setdefault(_DIGITS.sub("0", _WORD.sub("w", x)), []).append(x)
    if len(shapes) > MOST_SHAPES + len(lines) // LINES_A_SHAPE:
        return False
    if sum(len(v) for v in shapes.values() if len(v) >= members) < 0.85 * len(lines):
        return False
    for same in shapes.values():
        if len(same) >= members:
            found = (_MEMBER.search(_STRING.sub('""', x)) for x in same)
            if _longest_run([int(m.group(2)[-15:]) for m in found if m]) >= members:
                return True
    return False


def _longest_run(values: list[int]) -> int:
    best = run = 1
    for a, b in zip(values, values[1:]):
        run = run + 1 if b == a + 1 else run if b == a else 1
        best = max(best, run)
    return best


# -- paths

#: Folders that hold other projects, one folder each (fixed values: usual names).
_ROOTS = (
    "node_modules bower_components bower jspm_packages third_party third-party thirdparty 3rdparty 3rd_party "
    "vendor _vendor external externals deps contrib extern site-packages dist-packages Godeps Pods"
).split()
_ROOT = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, _ROOTS))})/[^/]+/", re.I)
#: Names that tools give to their output (fixed values: usual suffixes).
_TOOL_NAME = re.compile(
    r"(?:^|/)zz_generated[._][^/]*$|\.(?:pb|gen|generated|g)\.[A-Za-z]+$|_(?:pb2_grpc|generated)\.[A-Za-z]+$|\.designer\.[A-Za-z]+$",
    re.I,
)
_MIN_NAME = re.compile(r"\.min\.(?:js|mjs|cjs|css|ts)$|[.-](?:bundle|chunk)\.(?:js|mjs)$", re.I)


def path_rules(rel: str) -> int:
    rel = rel.replace("\\", "/")
    found = 0
    if _ROOT.search(rel):
        found |= VENDORED
    if _TOOL_NAME.search(rel):
        found |= GENERATED
    return found


def text_rules(rel: str | None, text: str | None) -> tuple[int, str | None]:
    """Bits of the kinds and of the evidence that the file alone gives, and the holder of copyright."""
    found = path_rules(rel) if rel else 0
    if found:
        found |= PATH
    if not text:
        return found, None
    text = text.removeprefix("﻿")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    said, holder = comment_rules(rel, text)
    if said:
        found |= said | COMMENT
    if is_minified(text, share=0.3 if rel and _MIN_NAME.search(rel) else 0.5):
        found |= MINIFIED | LAYOUT
    elif is_data(text):
        found |= DATA | LAYOUT
    elif is_repetitive(text):
        found |= GENERATED | LAYOUT
    return found, holder


# -- one pass over the texts

FEATURES = "file_id long, repo_id long, rel string, rules int, holder string, h1 long, h2 long, size long"

_NAME = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
#: Words of the languages, which are no identifiers.
_KEPT = frozenset(
    "if else for while do return break continue switch case default try catch finally throw new class interface enum struct trait "
    "impl fn func function def let const var import export from package use mod pub static async await yield in of is not and or "
    "match type with as this self super null none true false void int string bool then fi done esac elif local echo".split()
)


def content_hash(text: str) -> tuple[int, int, int]:
    """128 bits over the code without comments and blanks, and how many different words it has.

    In texts of ``MIN_RENAMED`` tokens or more an identifier is only which one it is, by
    order of appearance.
    """
    text = text.removeprefix("﻿")
    tokens = _NAME.findall(without_comments(text))
    if not tokens:
        tokens = _NAME.findall(text)
    words = {t for t in tokens if t[0].isalpha() or t[0] == "_"}
    if len(tokens) >= MIN_RENAMED:
        names: dict[str, str] = {t: t for t in words & _KEPT}
        for t in dict.fromkeys(tokens):
            if t in words and t not in names:
                names[t] = f"\0{len(names)}"
        tokens = [names.get(t, t) for t in tokens]
    d = hashlib.blake2b("\n".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), len(words)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rels, texts = batch.column("rel").to_pylist(), batch.column("text")
        rules, holders, hashes = [], [], []
        for i, rel in enumerate(rels):
            text = texts[i].as_py()
            found, holder = text_rules(rel, text)
            rules.append(found)
            holders.append(holder)
            hashes.append(content_hash(text) if text else (None, None, 0))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file_id").cast(pa.int64()), batch.column("repo_id").cast(pa.int64()), pa.array(rels, pa.string()),
                pa.array(rules, pa.int32()), pa.array(holders, pa.string()), *(pa.array([h[k] for h in hashes], pa.int64()) for k in range(3)),
            ],
            names=["file_id", "repo_id", "rel", "rules", "holder", "h1", "h2", "size"],
        )


def features(source_files: DataFrame) -> DataFrame:
    rows = source_files.filter(F.col("file_id").isNotNull()).select("file_id", "repo_id", "rel", "text")
    return spread(rows).mapInArrow(_features, FEATURES)


# -- the trees

def _families(files: DataFrame, repos: DataFrame | None) -> DataFrame:
    if repos is None:
        return files.withColumn("family", F.col("repo_id").cast("string"))
    one = repos.filter(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.max("git_common_dir").alias("common"))
    joined = files.join(small_side(one), "repo_id", "left")
    return joined.withColumn("family", F.coalesce("common", F.concat(F.lit("#"), F.col("repo_id").cast("string")))).drop("common")


def merkle_nodes(files: DataFrame) -> DataFrame:
    """(repo_id, family, node, depth, h1, h2, size, files) of all folders and files of the trees.

    Built level by level from the deepest. The hash of a folder is the sum (exclusive or)
    of the hashes of its children's names and contents, in 128 bits: it does not depend
    on order, so a folder with very many children is aggregated in parts.
    """
    path = F.regexp_replace(F.regexp_replace("rel", r"[/\\]+", "/"), r"^(?:\./|/)+", "")
    leaf = (
        files.filter(F.col("rel").isNotNull() & F.col("repo_id").isNotNull() & F.col("h1").isNotNull())
        .select("repo_id", "family", path.alias("node"), "h1", "h2", "size")
        .groupBy("repo_id", "family", "node")
        .agg(F.max(F.struct("h1", "h2", "size")).alias("m"))
        .select("repo_id", "family", "node", "m.*", F.lit(1).cast("long").alias("files"))
        .withColumn("depth", F.size(F.split("node", "/")))
    )
    leaf = cut(leaf)
    deepest = leaf.agg(F.max("depth")).first()[0] or 0
    levels, above = [leaf], None
    for depth in range(deepest, 1, -1):
        here = leaf.filter(F.col("depth") == depth)
        if above is not None:
            here = here.unionByName(above)
        name = F.substring_index("node", "/", -1)
        parent = F.substring_index("node", "/", depth - 1)
        above = cut(
            here.groupBy("repo_id", "family", parent.alias("node"))
            .agg(
                F.bit_xor(F.xxhash64(name, F.col("h1"), F.col("h2"))).alias("h1"),
                F.bit_xor(F.xxhash64(F.col("h2"), F.lit(7), name, F.col("h1"))).alias("h2"),
                F.sum("size").alias("size"),
                F.sum("files").alias("files"),
            )
            .withColumn("depth", F.lit(depth - 1))
        )
        levels.append(above)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level.select(*out.columns))
    return out


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """(repo_id, node, files): files and folders whose content unrelated repositories share."""
    big = nodes.filter(F.col("size") >= MIN_WORDS)
    shared = (
        big.groupBy("h1", "h2")
        .agg(F.min("family").alias("a"), F.max("family").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("h1", "h2")
    )
    return big.join(shared, ["h1", "h2"], "left_semi").select("repo_id", "node", "files")


def strangers(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, rel, rules) of files that name a holder of copyright who is not the repository's own."""
    named = files.filter(F.col("holder").isNotNull())
    total = files.groupBy("repo_id").agg(F.countDistinct("file_id").alias("all"))
    each = named.groupBy("repo_id", "holder").agg(F.countDistinct("file_id").alias("n")).join(small_side(total), "repo_id")
    own = each.filter((F.col("n") >= OWN_FILES) & (F.col("n") >= OWN_SHARE * F.col("all"))).select("repo_id", "holder")
    return named.join(small_side(own), ["repo_id", "holder"], "left_anti").select("file_id", "repo_id", "rel", F.lit(VENDORED | COMMENT).alias("rules"))


def judge(source_files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Files nobody wrote by hand there: (file_id, repo_id, rel), their kinds and the evidence for them.

    Kinds: generated, minified, vendored, data. Evidence: by_comment, by_layout, by_path, by_tree.
    """
    files = cut(_families(features(source_files), repos))
    shared = cut(shared_nodes(merkle_nodes(files)))
    path = F.regexp_replace(F.regexp_replace("rel", r"[/\\]+", "/"), r"^(?:\./|/)+", "")
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    copied = (
        files.filter(F.col("rel").isNotNull() & F.col("repo_id").isNotNull())
        .select("file_id", "repo_id", F.explode(ancestors).alias("node"))
        .join(small_side(shared.select("repo_id", "node")), ["repo_id", "node"], "left_semi")
        .select("file_id")
        .distinct()
    )
    marked = (
        files.filter(F.col("rules") != 0).select("file_id", "repo_id", "rel", "rules")
        .unionByName(strangers(files))
        .unionByName(files.join(small_side(copied), "file_id", "left_semi").select("file_id", "repo_id", "rel", F.lit(VENDORED | TREE).alias("rules")))
    )
    one = marked.groupBy("file_id").agg(F.bit_or("rules").alias("rules"), F.min(F.struct("repo_id", "rel")).alias("m"))
    bit = lambda b: (F.col("rules").bitwiseAND(b) != 0)
    return one.select(
        "file_id", "m.repo_id", "m.rel", bit(GENERATED).alias("generated"), bit(MINIFIED).alias("minified"),
        bit(VENDORED).alias("vendored"), bit(DATA).alias("data"), bit(COMMENT).alias("by_comment"), bit(LAYOUT).alias("by_layout"),
        bit(PATH).alias("by_path"), bit(TREE).alias("by_tree"),
    )
