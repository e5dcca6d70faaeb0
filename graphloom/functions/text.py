"""Column functions of the query surface; all of them stay in the JVM."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words that never count as terms.
STOPWORDS = (
    "a an and are as at be by code does for from how in is it of on or that the this to what where which with"
).split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Case folding of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def terms(text: Column) -> Column:
    """Terms of a text in order: camel case and ``_`` split, lower case, two bytes at least, no stopwords.

    A null text has no terms (an empty array).
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Ll})(\p{Lu})", "$1 $2")
    # Cleaned before folding: a letter may fold to one with a mark, which is no break.
    t = F.lower(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]+", " "))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(t, " "), lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stop, w))


def query_terms(query: str, spark: SparkSession) -> list[str]:
    """Terms of a question, by the same function on one row."""
    return spark.range(1).select(terms(F.lit(query))).first()[0]


def path_in_scope(path: Column, scope: str | None) -> Column:
    """Whether a path is the scope or below it; no or an empty scope has everything.

    Two comparisons that a Parquet scan can take over.
    """
    scope = (scope or "").strip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def in_scope(path: Column, scope: str | None) -> Column:
    """The same for ranked retrieval, where an empty scope (not a missing one) has nothing."""
    if scope is None:
        return F.lit(True)
    scope = scope.strip("/")
    return (path == scope) | path.startswith(scope + "/")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(test|tests|__tests__)(/|$)") | path.rlike(
        r"(^|/)(test_[^/]*|conftest\.py|[^/]*(\.test\.|_test\.)[^/]*)$"
    )


def language(path: Column) -> Column:
    """Language by extension; declaration files, unknown extensions and names that are all extension have none."""
    ext = F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)
    return (
        F.when((ext == "ts") & ~path.endswith(".d.ts"), "typescript")
        .when(ext == "tsx", "tsx")
        .when(ext.isin("js", "mjs", "cjs", "jsx"), "javascript")
        .when(ext == "rs", "rust")
        .when(ext == "py", "python")
        .when(ext == "go", "go")
        .when(ext.isin("sh", "bash", "bats"), "shell")
        .when(ext.isin("yaml", "yml"), "yaml")
    )


def shebang_language(path: Column, head: Column) -> Column:
    """Shell for files without extension whose first line names one."""
    first = F.lower(F.substring_index(F.substring(head, 1, 256), "\n", 1))
    bare = F.substring_index(path, "/", -1).rlike(r"^\.?[^.]*$")
    return F.when(bare & first.startswith("#!") & first.rlike(r"[/ ](ba|da|k)?sh"), "shell")


def first_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, cut between characters."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(head, "\ufffd+$", ""))


def top_dir(path: Column) -> Column:
    """``head/`` of a path, or ``.`` for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise(".")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, an empty text has none."""
    none = F.array().cast("array<string>")
    return F.when(text == "", none).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def excerpt(text: Column, start: Column, end: Column, full: bool = False, most: int = 8) -> Column:
    """Lines start to end of a text, at most ``most`` unless ``full``."""
    first = F.greatest(start, F.lit(1)).cast("int")
    last = F.greatest(end, first).cast("int")
    if not full:
        last = F.least(last, first + (most - 1))
    return F.array_join(F.slice(lines(text), first, last - first + 1), "\n")


def normalize_path(path: Column) -> Column:
    """Lexical ``.`` and ``..``; ``..`` at the root is dropped."""
    empty = F.array().cast("array<string>")
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            empty,
            lambda acc, p: F.when((p == "") | (p == "."), acc)
            .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(p))),
        ),
        "/",
    )


def parent_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def estimated_tokens(size: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(size / 4)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0).cast("long")


def grouped(number: Column) -> Column:
    """With a comma between thousands."""
    return F.format_number(number, 0)


def pattern(text: str, fixed: bool = False, ignore_case: bool = False) -> str:
    """A Java pattern of a search; look-around and back-references are refused, as are invalid ones."""
    import re

    if fixed:
        body = "".join("\\" + c if not c.isalnum() and c.isascii() and c != " " else c for c in text)
    else:
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", text):
            raise ValueError(f"look-around and back-references are not supported: {text!r}")
        jvm = SparkContext._active_spark_context._jvm
        try:
            # The one that will run it decides.
            jvm.java.util.regex.Pattern.compile(text)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise ValueError(f"invalid pattern {text!r}: {e}") from None
        body = text
    return f"(?i){body}" if ignore_case else body
