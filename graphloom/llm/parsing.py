"""Source files that do not parse.

Every text runs through the memoised derivative parser of its language
(:mod:`graphloom.llm.derive`); the result names the line and token whose derivative is
empty, or says that the text ends where the grammar wants more. The parse is a map over
rows: no shuffle moves texts, only flags are grouped.

Nulls and edge cases
* null and empty texts, and languages without grammar (or null), are not failures;
* a byte-order mark and any line ending are accepted;
* repeated rows of a file count once; a file fails if any of its rows does;
* a row that a parser cannot get through, or whose text cannot be decoded, has no verdict:
  ``failed`` is null, ``reason`` is ``error`` and ``token`` names the exception. It never
  fails the task, and is neither a failing file nor one that parses: lists flag it, rates
  count it apart, and a bare list of failing files, which cannot flag it, is refused;
* a grammar that cannot be built says nothing about any text: it fails the job;
* rows without file_id are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import spread

#: The reason of a row without a verdict.
ERROR = "error"
RESULT = "file_id long, repo_id long, lang string, failed boolean, line int, token string, reason string"


def checked(lang: str | None, text: str | None) -> tuple[int, str, str] | None:
    """The first failure of a text, or the reason ``error`` if the parser does not get through it.

    An exception can leave the parser's tables half made, and other texts may have filled
    them, so the text is tried once more with a parser of its own before it is given up.
    """
    from graphloom.llm.syntax import failure, forget, parser

    if not text:
        return None
    for _ in range(2):
        parser(lang)
        try:
            return failure(lang, text)
        except Exception as e:  # noqa: BLE001  the row is flagged with it
            forget(lang)
            error = type(e).__name__
    return 1, error, ERROR


def _checked_value(lang: str | None, value: pa.StringScalar) -> tuple[int, str, str] | None:
    from graphloom.llm.syntax import parser

    try:
        text = value.as_py()
    except UnicodeDecodeError as e:
        return (1, type(e).__name__, ERROR) if parser(lang) else None
    return checked(lang, text)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("file_id", pa.int64()), ("repo_id", pa.int64()), ("lang", pa.string()), ("failed", pa.bool_()),
         ("line", pa.int32()), ("token", pa.string()), ("reason", pa.string())]
    )
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text")
        found = [_checked_value(lang, texts[i]) for i, lang in enumerate(langs)]
        line, token, reason = ([f and f[k] for f in found] for k in range(3))
        judged = [r != ERROR for r in reason]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file_id").cast(pa.int64()),
                batch.column("repo_id").cast(pa.int64()),
                pa.array(langs, pa.string()),
                pa.array([f is not None if j else None for f, j in zip(found, judged)], pa.bool_()),
                pa.array([n if j else None for n, j in zip(line, judged)], pa.int32()),
                pa.array(token, pa.string()),
                pa.array(reason, pa.string()),
            ],
            schema=schema,
        )


def parse_files(source_files: DataFrame) -> DataFrame:
    """(file_id, repo_id, lang, failed, line, token, reason), one row per row of the table.

    ``failed`` is null where there is no verdict.
    """
    rows = source_files.filter(F.col("file_id").isNotNull()).select("file_id", "repo_id", "lang", "text")
    return spread(rows).mapInArrow(_parse, RESULT)


def _not_fine(source_files: DataFrame) -> DataFrame:
    return parse_files(source_files).filter("failed is not false")


def failing_files(source_files: DataFrame) -> DataFrame:
    """One row per file that does not parse, with its first failure, and one with the reason
    ``error`` and no line per file of which that cannot be told."""
    first = F.min(F.struct(F.col("failed").isNull().alias("open"), "line", "token", "reason", "repo_id", "lang")).alias("f")
    return _not_fine(source_files).groupBy("file_id").agg(first).select(
        "file_id", "f.repo_id", "f.lang", "f.line", "f.token", "f.reason"
    )


def failing_ids(source_files: DataFrame) -> DataFrame:
    """file_id of every file that does not parse.

    A file without a verdict has no place in or out of this list: one is enough for the
    query to end with an error that names it.
    """
    per_file = _not_fine(source_files).groupBy("file_id").agg(F.max("failed").alias("failed"))
    stop = F.raise_error(F.concat(F.lit("no verdict on file "), F.col("file_id").cast("string"), F.lit("; p1_failures has such files under the reason error")))
    return per_file.filter(F.when(F.col("failed").isNull(), stop).otherwise(F.col("failed"))).select("file_id")


def failure_rates(source_files: DataFrame) -> DataFrame:
    """Files, failing files and files without a verdict per repository and language; a null
    text counts as a file. The rate is that among the files with a verdict, null if there is none."""
    verdict = F.max(F.expr("case when failed then 2 when failed is null then 1 else 0 end"))
    per_file = parse_files(source_files).groupBy("file_id", "repo_id", "lang").agg(verdict.alias("verdict"))
    files, failed, unjudged = F.count(F.lit(1)), F.count_if(F.col("verdict") == 2), F.count_if(F.col("verdict") == 1)
    return per_file.groupBy("repo_id", "lang").agg(
        files.alias("files"), failed.alias("failed"), unjudged.alias("unjudged"), F.try_divide(failed, files - unjudged).alias("rate")
    )
