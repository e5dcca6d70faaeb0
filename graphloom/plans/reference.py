"""Queries of the graph engine's operators over the test tables, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.hashing import fnv1a
from graphloom.operators import freshness, graph, rank, retrieval, search, traverse
from graphloom.plans import fixtures as X
from graphloom.plans import testbed as B
from graphloom.runtime import cut, read_table, spread

QUESTION = "How does the resolve scope of a partial registry walk parents?"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _terms(c: str) -> str:
    return (
        f"list_filter(string_split(lower(replace(regexp_replace(regexp_replace(coalesce({c}, ''), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), "
        f"'[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), chr(304), 'i' || chr(775))), ' '), lambda t: octet_length(encode(t)) > 1 and t not in ({_STOP}))"
    )


_DOCS = """
docs as (
  select doc_id as id, coalesce(author, '') as name,
         concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), cast(doc_id as varchar)) as path,
         split_part(coalesce(text, ''), chr(10), 1) as signature, coalesce(text, '') as body, 1 as start_line, 0 as in_edges
  from documents
)"""

_SOURCES = """
sources as (select distinct file_id, repo_id, rel as path, lang, text, size, hash from source_files)"""

_SYMBOLS = """
latest as (
  select file_id, max(struct_pack(extracted_at := extracted_at, symbols := symbols, containers := containers)) as m
  from extracted group by 1
), flat as (
  select file_id, m, unnest(range(len(m.symbols))) as ordinal from latest
), syms as (
  select file_id, file_id * 1048576 + ordinal + 1 as id, ordinal, m.symbols[ordinal + 1].name as name,
         m.symbols[ordinal + 1].kind as kind, m.symbols[ordinal + 1].start_line as start_line,
         m.symbols[ordinal + 1].end_line as end_line, m.symbols[ordinal + 1].signature as signature, m.containers[ordinal + 1] as container
  from flat
)"""

_FILES = """
cur as (
  select file_id, m.repo_id as repo_id, m.path as path, m.lang as lang, m.size as size, m.hash as hash from (
    select file_id, max(struct_pack(scanned_at := scanned_at, repo_id := repo_id, path := path, lang := lang, size := size,
                                    hash := lower(hash))) as m
    from files where hash is not null group by 1)
)"""

_MENTIONS = """
mentions as (select doc_id as src, unnest(regexp_extract_all(text, '`([A-Za-z_]+)`', 1)) as callee from documents where text is not null)"""

_EDGES = """
edges as (
  select n_regionkey::bigint as src, n_nationkey::bigint + 1000 as dst, 'contains' as kind from nation
  union select c_nationkey::bigint + 1000, c_custkey + 1000000, 'contains' from customer
  union select o_custkey + 1000000, o_orderkey + 1000000000, 'imports' from orders
  union select l_orderkey + 1000000000, l_partkey + 10000000000, 'calls' from lineitem
  union select l_partkey + 10000000000, l_suppkey + 20000000000, 'imports' from lineitem
)"""


# -- terms and ranking

@query(f"""with {_DOCS}, t as (select id, unnest({_terms('body')}) as term from docs)
    select id, term, count(*) as tf from t group by 1, 2""")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_frequencies(B.documents(spark, sf_dir), "id", {"body": "body"}).select("id", "term", "tf")


@query(f"""with {_DOCS}, t as (select id, unnest({_terms('body')}) as term from docs)
    select term, count(distinct id) as df from t group by 1""")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = retrieval.term_frequencies(B.documents(spark, sf_dir), "id", {"body": "body"})
    return retrieval.document_frequency(tf, "id")


def _ask(docs: str, query_text: str, scope: str = "true") -> str:
    asked = [w for w in re.findall(r"[a-z0-9]+", query_text.lower()) if len(w) > 1 and w not in T.STOPWORDS]
    values = ", ".join(f"('{t}', {asked.count(t)})" for t in sorted(set(asked)))
    penalty = "1.0" if retrieval.TEST_WORDS & set(asked) else (
        "case when regexp_matches(path, '(^|/)(test|tests|__tests__)(/|$)') or regexp_matches(path, "
        "'(^|/)(test_[^/]*|conftest\\.py|[^/]*(\\.test\\.|_test\\.)[^/]*)$') then 0.65 else 1.0 end"
    )
    return f"""with {docs}, d as (select * from docs where {scope}), q(term, times) as (values {values}),
    w as (select id, f, unnest(ts) as term from (
        select id, 'name' as f, {_terms('name')} as ts from d union all select id, 'path', {_terms('path')} from d
        union all select id, 'signature', {_terms('signature')} from d union all select id, 'body', {_terms('body')} from d)),
    c as (select id, term, count(*) filter (f = 'name') as n, count(*) filter (f = 'path') as p, count(*) filter (f = 'signature') as s,
                 count(*) filter (f = 'body') as b from w where term in (select term from q) group by 1, 2),
    idf as (select term, times, ln(((select greatest(count(*), 1) from d) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 as idf
            from q left join (select term, count(*) as df from c group by 1) using (term)),
    possible as (select sum(idf * times) as possible from idf),
    s as (select id, sum(idf * times * (5.0 * n + 2.5 * p + 2.0 * s + least(b, 3))) as score,
                 sum(case when n + p + s > 0 then idf * times else 0.0 end) as strong from c join idf using (term) group by 1)
    select id, round(score * {penalty} * (1 + 0.06 * ln(coalesce(in_edges, 0) + 1.0)), 6) as score
    from s join d using (id), possible where score > 0 and not (strong = 0 and score < 1.5 * possible)"""


def _scores(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@query(_ask(_DOCS, QUESTION))
def ask_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(retrieval.rank(B.documents(spark, sf_dir), QUESTION, limit=None))


@query(_ask(_DOCS, QUESTION, "path = 'issue_thread' or starts_with(path, 'issue_thread/')"))
def ask_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(retrieval.rank(B.documents(spark, sf_dir), QUESTION, limit=None, scope="issue_thread"))


_SOURCE_DOCS = """
docs as (select distinct file_id as id, regexp_extract(rel, '[^/]*$') as name, rel as path, split_part(coalesce(text, ''), chr(10), 1) as signature,
                coalesce(text, '') as body, 1 as start_line, 0 as in_edges from source_files)"""


@query(_ask(_SOURCE_DOCS, "parse the lazy registry"))
def ask_test_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = B.source_rows(spark, sf_dir).select(
        F.col("file_id").alias("id"), F.substring_index("path", "/", -1).alias("name"), "path",
        F.substring_index(text, "\n", 1).alias("signature"), text.alias("body"), F.lit(1).cast("long").alias("start_line"),
        F.lit(0).cast("long").alias("in_edges"),
    )
    return _scores(retrieval.rank(docs, "parse the lazy registry", limit=None))


_SEARCH_DOCS = """
docs as (select distinct id, name, concat_ws('/', cast(repo_id as varchar), kind) as path, '' as signature, '' as body, 1 as start_line, in_edges
         from search_docs)"""


def _search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "search_docs").select(
        "id", "name", F.concat_ws("/", F.col("repo_id").cast("string"), "kind").alias("path"), F.lit("").alias("signature"),
        F.lit("").alias("body"), F.lit(1).cast("long").alias("start_line"), "in_edges",
    ).distinct()


@query(_ask(_SEARCH_DOCS, "bind catalog shard"))
def ask_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(retrieval.rank(_search_docs(spark, sf_dir), "bind catalog shard", limit=None))


@query(f"""with base as ({_ask(_SEARCH_DOCS, 'bind catalog shard')}), d as (select distinct id, name, repo_id,
      concat_ws('/', cast(repo_id as varchar), kind) as path from search_docs),
    places as (select repo_id, row_number() over (order by coalesce(label, ''), repo_id) as place
               from (select repo_id, max(label) as label from repos where repo_id is not null group by 1)),
    k as (select id, repo_id, row_number() over (partition by repo_id order by score desc, path, id) as turn from base join d using (id))
    select id, repo_id, row_number() over (order by turn, place) as rank
    from k join places using (repo_id) qualify rank <= 12""")
def workspace_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repositories, by label."""
    ranked = retrieval.rank(_search_docs(spark, sf_dir), "bind catalog shard", limit=None)
    ranked = ranked.withColumn("score", F.round("score", 6)).withColumn("repo", F.substring_index("path", "/", 1))
    repos = read_table(spark, sf_dir, "repos").filter(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.max("label").alias("label"))
    order = [str(r[0]) for r in repos.orderBy(F.coalesce("label", F.lit("")), "repo_id").select("repo_id").collect()]
    ranked = ranked.filter(F.col("repo").isin(*order))
    return retrieval.interleave(ranked, "repo", order, 12).select(
        "id", F.col("repo").cast("long").alias("repo_id"), F.col("rank").cast("long").alias("rank")
    )


# -- search

_LINES = """
numbered as (
  select file_id, path, unnest(range(1, len(ls) + 1)) as line, ls from (
    select file_id, path, case when ls[len(ls)] = '' then ls[:len(ls) - 1] else ls end as ls from (
      select file_id, path, string_split_regex(text, '\\r?\\n') as ls from sources where text is not null))
), lines as (select file_id, path, line, ls[line] as raw from numbered)"""
_HIT = "select distinct file_id, path, cast(line as bigint) as line, trim(raw) as text from lines where "


def _once(hits: DataFrame) -> DataFrame:
    """Lines of repeated rows once; a line is known by its file and number."""
    return hits.dropDuplicates(["file_id", "path", "line"])


@query(f"with {_SOURCES}, {_LINES} {_HIT} regexp_matches(raw, 'resolve[A-Z]\\w*\\(')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(search.matching_lines(B.source_scan(spark, sf_dir), r"resolve[A-Z]\w*\("))


@query(f"with {_SOURCES}, {_LINES} {_HIT} contains(raw, '.clear();')")
def grep_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(search.matching_lines(B.source_scan(spark, sf_dir), ".clear();", fixed=True))


@query(f"with {_SOURCES}, {_LINES} {_HIT} regexp_matches(raw, '(?i)do not edit')")
def grep_icase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(search.matching_lines(B.source_scan(spark, sf_dir), "do not edit", fixed=True, ignore_case=True))


@query(f"with {_SOURCES}, {_LINES} {_HIT} regexp_matches(raw, 'return') and (path = 'src' or starts_with(path, 'src/'))")
def grep_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(search.matching_lines(B.source_scan(spark, sf_dir), "return", scope="src"))


@query(f"""with {_SOURCES}, {_LINES}, {_SYMBOLS}, hits as ({_HIT} contains(raw, 'return')),
    owned as (select h.file_id, h.line, arg_min(s.id, struct_pack(w := s.end_line - s.start_line, id := s.id)) as symbol
              from hits h left join syms s on s.file_id = h.file_id and h.line between s.start_line and s.end_line group by 1, 2)
    select file_id, symbol, count(*) as hits, min(line) as first_line from owned group by 1, 2""")
def grep_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _once(search.matching_lines(B.source_scan(spark, sf_dir), "return", fixed=True))
    owned = search.attribute(hits, B.symbols(spark, sf_dir).select("file_id", "id", "start_line", "end_line"))
    return owned.groupBy("file_id", "symbol").agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first_line"))


# -- degrees, maps, counts

@query(f"with {_EDGES} select dst as id, count(*) as in_edges from edges group by 1")
def in_degree_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.in_degree(B.key_edges(spark, sf_dir))


@query(f"with {_EDGES} select dst as id, count(*) as in_edges from edges where kind = 'calls' group by 1")
def hubs_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.in_degree(B.key_edges(spark, sf_dir), "calls")


_UNIQUE = f"""{_SYMBOLS}, {_MENTIONS},
uniq as (select name as callee, min(id) as dst from syms group by 1 having count(*) = 1),
called as (select distinct src, dst, 'calls' as kind from mentions join uniq using (callee))"""


def _mention_edges(spark: SparkSession, sf_dir: str, symbols: DataFrame) -> DataFrame:
    uniq = graph.unique_by(symbols, "name").withColumnRenamed("name", "callee")
    found = B.mentions(spark, sf_dir).join(uniq, "callee")
    return found.select("src", "dst", F.lit("calls").alias("kind")).distinct()


@query(f"""with {_UNIQUE}, deg as (select dst as id, count(*) as in_edges from called group by 1)
    select id, name, in_edges, row_number() over (order by in_edges desc, name, id) as rank from deg join syms using (id) qualify rank <= 20""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = cut(B.symbols(spark, sf_dir))
    top = rank.hotspots(symbols, _mention_edges(spark, sf_dir, symbols), 20)
    return top.select("id", "name", "in_edges", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_UNIQUE}, {_FILES}, f as (select file_id, path, case when contains(path, '/') then split_part(path, '/', 1) || '/' else '.' end as dir from cur),
    deg as (select dst as id, count(*) as in_edges from called group by 1),
    top as (select dir, id, name, row_number() over (partition by dir order by in_edges desc, name, id) as k
            from deg join syms using (id) join f using (file_id) qualify k <= 3)
    select dir, count(distinct path) as files, coalesce((select count(*) from syms s join f g using (file_id) where g.dir = f.dir), 0) as symbols,
           (select string_agg(name, ',' order by k) from top t where t.dir = f.dir) as hubs
    from f group by dir""")
def repo_map_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = cut(B.symbols(spark, sf_dir))
    out = rank.directories(B.current_files(spark, sf_dir), symbols, _mention_edges(spark, sf_dir, symbols))
    names = F.array_join(F.transform("hubs", lambda h: h["name"]), ",")
    return out.select("dir", "files", "symbols", names.alias("hubs"))


@query(f"""with {_SYMBOLS}, {_FILES} select repo_id, count(distinct file_id) as files, count(id) as symbols from cur left join syms using (file_id) group by 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = B.current_files(spark, sf_dir)
    symbols = B.symbols(spark, sf_dir).join(files.select("file_id", "repo_id"), "file_id")
    none = symbols.limit(0).select("repo_id")
    return rank.status(files, symbols, none).select("repo_id", "files", "symbols")


@query(f"""with {_SYMBOLS}, {_FILES} select file_id, path, name, kind, coalesce(signature, '') as signature,
    row_number() over (partition by file_id order by start_line, end_line desc, id) as rank from syms join cur using (file_id)""")
def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank.outline(B.symbols(spark, sf_dir), B.current_files(spark, sf_dir))
    return out.select("file_id", "path", "name", "kind", "signature", F.col("rank").cast("long").alias("rank"))


# -- traversal

def _walk(seed: str, near: str, far: str, depth: int, edges: str = _EDGES) -> str:
    return f"""with recursive {edges}, step as materialized (select distinct {near} as a, {far} as b from edges where kind <> 'contains'),
    walk(id, depth) as (select {seed}, 0 union select b, w.depth + 1 from walk w join step on a = w.id where w.depth < {depth})
    select id, min(depth) as depth from walk group by 1 having min(depth) > 0"""


def _reach(spark: SparkSession, sf_dir: str, seed: int, outgoing: bool, depth: int | None) -> DataFrame:
    start = spark.createDataFrame([(seed,)], "id long")
    edges = B.key_edges(spark, sf_dir)
    # Every level reads the edges: derive them once if there may be several.
    got = traverse.reach(edges if depth == 1 else cut(edges), start, outgoing, depth)
    return got.select("id", F.col("depth").cast("int").alias("depth"))


@query(_walk(f"cast({B.PART} + 1 as bigint)", "dst", "src", 1))
def callers_in_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reach(spark, sf_dir, B.PART + 1, False, 1)


@query(_walk(f"cast({B.ORDER} + 1 as bigint)", "src", "dst", 1))
def callers_out_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reach(spark, sf_dir, B.ORDER + 1, True, 1)


@query(_walk(f"cast({B.SUPPLIER} + 1 as bigint)", "dst", "src", 6))
def callers_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reach(spark, sf_dir, B.SUPPLIER + 1, False, None)


@query(f"""select * from ({_walk(f'cast({B.SUPPLIER} + 1 as bigint)', 'dst', 'src', 6)}) where id >= {B.ORDER} and id < {B.PART}""")
def callers_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk passes through parts; only orders are given out."""
    got = _reach(spark, sf_dir, B.SUPPLIER + 1, False, None)
    return got.filter((F.col("id") >= B.ORDER) & (F.col("id") < B.PART))


_TRANSITIONS = """
edges as (select distinct event_type as src, nxt as dst, 'calls' as kind from (
  select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null)"""


@query(_walk("'signup'", "src", "dst", 8, _TRANSITIONS) .replace("having min(depth) > 0", "having min(depth) > 0"))
def callers_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("signup",)], "id string")
    got = traverse.reach(B.transitions(spark, sf_dir), start, True, None)
    return got.select("id", F.col("depth").cast("int").alias("depth"))


# -- resolution

@query(f"""with {_UNIQUE} select callee, count(*) as calls, min(dst) as dst from mentions left join uniq using (callee) group by 1""")
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = B.symbols(spark, sf_dir).select("id", "name", "container")
    out = graph.resolve_bare(B.mentions(spark, sf_dir), defs, ())
    return out.groupBy("callee").agg(F.count(F.lit(1)).alias("calls"), F.min("dst").alias("dst"))


@query(f"""with {_SYMBOLS}, uniq as (select name, min(id) as dst from syms group by 1 having count(*) = 1),
    calls as (select id as src, name as callee from syms union all
              select id, lead(name) over (partition by file_id order by ordinal) from syms)
    select src, callee, coalesce(u.dst, case when s.name = callee then src end) as dst
    from calls c join syms s on s.id = c.src left join uniq u on u.name = c.callee where callee is not null""")
def resolve_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = B.symbols(spark, sf_dir)
    w = Window.partitionBy("file_id").orderBy("ordinal")
    paired = symbols.select(F.col("id").alias("src"), "name", F.lead("name").over(w).alias("following"))
    calls = paired.select("src", F.explode(F.array("name", "following")).alias("callee"))
    defs = symbols.select("id", "name", "container")
    return graph.resolve_bare(calls.filter(F.col("callee").isNotNull()), defs, ()).select("src", "callee", "dst")


@query("""with uniq as (select p_brand, p_type, p_size, min(p_partkey) as dst from part group by all having count(*) = 1)
    select p.p_partkey as src, u.dst from part p left join uniq u using (p_brand, p_type, p_size)""")
def resolve_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    kind, name = F.concat_ws("|", "p_brand", "p_type"), F.col("p_size").cast("string")
    defs = p.select(F.col("p_partkey").alias("id"), kind.alias("container"), name.alias("name"))
    calls = p.select(F.col("p_partkey").alias("src"), kind.alias("type"), name.alias("callee"))
    return graph.resolve_typed(calls, defs, ()).select("src", "dst")


def _import_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = cut(B.current_files(spark, sf_dir))
    x = read_table(spark, sf_dir, "extracted").groupBy("file_id").agg(F.max(F.struct("extracted_at", "imports")).alias("m"))
    specs = x.select("file_id", F.explode("m.imports").alias("spec")).filter(F.col("spec").isNotNull())
    return files.select("repo_id", "file_id", "path", "lang").join(specs.distinct(), "file_id"), files


def _plain(p: str) -> str:
    """SQL that takes ``.`` and ``..`` out of a path; nothing is above the root."""
    return (
        f"list_reduce(list_concat([''], string_split({p}, '/')), lambda a, x: case when x in ('', '.') then a when x = '..' then "
        "regexp_replace(a, '/?[^/]*$', '') when a = '' then x else a || '/' || x end)"
    )


_JS_ENDS = "['.ts', '.tsx', '.js', '.mjs', '.cjs', '#', '/index.ts', '/index.tsx', '/index.js', '/index.mjs', '/index.cjs']"
_IMPORTS = f"""{_FILES}, latest_i as (select file_id, max(struct_pack(a := extracted_at, i := imports)).i as imports from extracted group by 1),
specs as (select distinct file_id, unnest(imports) as spec from latest_i),
sites as (select repo_id, file_id, path, lang, spec, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder
          from cur join specs using (file_id) where spec is not null),
js as (select repo_id, file_id, spec, {_plain("folder || '/' || spec")} as stem from sites where lang in ('typescript', 'tsx', 'javascript') and starts_with(spec, '.')),
py as (select repo_id, file_id, spec, length(regexp_extract(spec, '^\\.*')) as dots, replace(regexp_replace(spec, '^\\.+', ''), '.', '/') as m, folder from sites where lang = 'python'),
py2 as (select repo_id, file_id, spec, case when dots = 0 then {_plain("m")} else {_plain("folder || '/' || repeat('../', dots - 1) || m")} end as stem from py),
rs as (select repo_id, file_id, spec, path, folder,
         regexp_replace(regexp_replace(split_part(split_part(spec, ' as ', 1), '{{', 1), ':+$', ''), '(::\\*)+$', '') as raw from sites where lang = 'rust'),
rs2 as (select *, regexp_extract(raw, '^(crate|self|super)::', 1) as head, regexp_replace(raw, '^(crate|self|super)::', '') as rest from rs),
rs3 as (select *, list_filter(string_split(rest, '::'), lambda p: p not in ('', 'self')) as parts,
          case head when 'crate' then case when contains(path, '/src/') then regexp_extract(path, '^(.*/src)/', 1) when starts_with(path, 'src/') then 'src' else folder end
               when 'super' then case when contains(folder, '/') then regexp_replace(folder, '/[^/]*$', '') else '' end else folder end as base from rs2),
rs4 as (select repo_id, file_id, spec, base, parts, unnest(range(1, len(parts) + 1)) as k from rs3
        where (head <> '' or not contains(raw, '::')) and rest <> '' and len(parts) > 0),
tried as (
  select repo_id, file_id, spec, unnest(range(1, 12)) as place,
         unnest(list_transform({_JS_ENDS}, lambda e: case when e = '#' then stem else regexp_replace(stem, '\\.js$', '') || e end)) as candidate from js
  union all select repo_id, file_id, spec, unnest([1, 2]), unnest([stem || '.py', stem || '/__init__.py']) from py2
  union all select repo_id, file_id, spec, unnest([1, 2]), unnest([{_plain("folder || '/' || spec")}, {_plain("spec")}]) from sites
            where lang = 'shell' and not contains(spec, '$') and not contains(spec, '`')
  union all select repo_id, file_id, spec, unnest([1, 2, 3]), unnest([{_plain("spec")}, {_plain("spec")} || '/action.yml', {_plain("spec")} || '/action.yaml']) from sites
            where lang = 'yaml' and starts_with(spec, '.')
  union all select repo_id, file_id, spec, unnest([2 * (len(parts) - k) + 1, 2 * (len(parts) - k) + 2]),
            unnest(list_transform(['.rs', '/mod.rs'], lambda e: {_plain("base || '/' || array_to_string(parts[:k], '/')")} || e)) from rs4),
hits as (select t.repo_id, t.file_id, t.spec, arg_min(c.file_id, struct_pack(place := place, id := c.file_id)) as target
         from tried t join cur c on c.repo_id = t.repo_id and c.path = t.candidate group by 1, 2, 3)"""


@query(f"with {_IMPORTS} select file_id, spec, target from hits")
def import_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, files = _import_sites(spark, sf_dir)
    return graph.first_match(sites, files).select("file_id", "spec", "target")


@query(f"""with {_IMPORTS}, outside as (select * from sites s
      where not exists (select 1 from hits h where h.file_id = s.file_id and h.spec = s.spec))
    select repo_id, spec, arg_min(file_id, struct_pack(p := path, i := file_id)) as anchor, count(*) as importers from outside group by 1, 2""")
def import_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, files = _import_sites(spark, sf_dir)
    sites = cut(sites)
    hits = graph.first_match(sites, files)
    outside = sites.join(hits, ["repo_id", "file_id", "spec"], "left_anti")
    return outside.groupBy("repo_id", "spec").agg(
        F.min_by("file_id", F.struct("path", "file_id")).alias("anchor"), F.count(F.lit(1)).alias("importers")
    )


@query(f"""with {_IMPORTS}, n as (select lang, place, candidate, count(*) as sites from tried join (select file_id, lang from cur) using (file_id) group by 1, 2, 3)
    select lang, place - 1 as place, candidate, sites from n""")
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that the sites of each language try, with the place and how often."""
    sites, _ = _import_sites(spark, sf_dir)
    tried = sites.select("lang", F.posexplode(graph.import_candidates(F.col("path"), F.col("lang"), F.col("spec"))).alias("place", "candidate"))
    return tried.groupBy("lang", F.col("place").cast("long").alias("place"), "candidate").agg(F.count(F.lit(1)).alias("sites"))


@query(f"with {_EDGES} select kind, count(*) as edges from edges group by 1")
def edges_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.key_edges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@query("""with latest as (select file_id, max(struct_pack(a := extracted_at, p := parents)).p as parents from extracted group by 1),
    e as (select file_id, unnest(range(len(parents))) as ordinal, parents from latest)
    select file_id * 1048576 + coalesce(parents[ordinal + 1], -1) + 1 as src, file_id * 1048576 + ordinal + 1 as dst from e""")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "extracted").groupBy("file_id").agg(F.max(F.struct("extracted_at", "parents")).alias("m"))
    extracts = x.select("file_id", "m.parents")
    files = extracts.select("file_id", F.lit(0).cast("long").alias("repo_id"))
    return graph.contains_edges(extracts, files).select("src", "dst")


# -- freshness and scalar functions

@query(f"""with {_FILES}, stored as (
      select file_id, max(struct_pack(a := extracted_at, h := lower(x.hash))).h as hash from file_extracts x join
        (select distinct run_id from index_runs where status = 'ok') r using (run_id)
      where error is null and x.hash is not null and extracted_at is not null and file_id is not null group by 1)
    select coalesce(s.file_id, l.file_id) as file_id, case when s.file_id is null then 'added' when l.file_id is null then 'deleted' else 'modified' end as change
    from stored s full join cur l on s.file_id = l.file_id where s.hash is distinct from l.hash""")
def freshness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as last scanned against their last successful extraction."""
    ok = read_table(spark, sf_dir, "index_runs").filter("status = 'ok'").select("run_id").distinct()
    x = read_table(spark, sf_dir, "file_extracts").filter("error is null and hash is not null and extracted_at is not null and file_id is not null")
    last = x.join(ok, "run_id", "left_semi").groupBy("file_id").agg(F.max(F.struct("extracted_at", F.lower("hash").alias("hash"))).alias("m"))
    return freshness.diff(last.select("file_id", "m.hash"), B.current_files(spark, sf_dir), ("file_id",))


@query(f"with {_FILES} select file_id, path from cur where path = 'src' or starts_with(path, 'src/')")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.current_files(spark, sf_dir).filter(T.path_in_scope(F.col("path"), "/src/")).select("file_id", "path")


@query(f"""with {_SOURCES}, l as (select file_id, string_split_regex(text, '\\r?\\n') as ls from sources where text is not null),
    m as (select file_id, case when ls[len(ls)] = '' then ls[:len(ls) - 1] else ls end as ls from l)
    select distinct file_id, array_to_string(ls[3:10], chr(10)) as excerpt from m""")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.source_scan(spark, sf_dir).filter(F.col("text").isNotNull())
    return rows.select("file_id", T.excerpt(F.col("text"), F.lit(3), F.lit(40)).alias("excerpt")).dropDuplicates(["file_id"])


@query(f"""with {_SOURCES} select distinct file_id, cast(ceil(size / 4.0) as bigint) as tokens,
    case when octet_length(encode(coalesce(text, ''))) > 0 then cast(floor(size * 100 / octet_length(encode(text))) as bigint) else 0 end as pct,
    regexp_replace(cast(size as varchar), '(\\d)(\\d{{3}})$', '\\1,\\2') as shown from sources where size is not null""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.source_scan(spark, sf_dir).filter(F.col("size").isNotNull())
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return rows.select(
        "file_id", T.estimated_tokens(F.col("size")).cast("long").alias("tokens"), T.percent(F.col("size"), n).alias("pct"),
        T.grouped(F.col("size")).alias("shown"),
    ).dropDuplicates(["file_id"])


@query("""select distinct path, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^(\\./)+', '') as plain,
    case when contains(path, '/') then regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^(\\./)+', ''), '/?[^/]*$', '') else '' end as up
    from file_snapshots where path is not null""")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "file_snapshots").filter(F.col("path").isNotNull()).select("path").distinct()
    return p.select("path", T.normalize_path(F.col("path")).alias("plain"), T.normalize_path(F.concat("path", F.lit("/.."))).alias("up"))


@query("""select distinct path, case when ext = 'ts' and not ends_with(path, '.d.ts') then 'typescript' when ext = 'tsx' then 'tsx'
    when ext in ('js', 'mjs', 'cjs', 'jsx') then 'javascript' when ext = 'rs' then 'rust' when ext = 'py' then 'python' when ext = 'go' then 'go'
    when ext in ('sh', 'bash', 'bats') then 'shell' when ext in ('yaml', 'yml') then 'yaml' end as found,
    regexp_matches(path, '(^|/)(test|tests|__tests__)(/|$)') or regexp_matches(path, '(^|/)(test_[^/]*|conftest\\.py|[^/]*(\\.test\\.|_test\\.)[^/]*)$') as test
    from (select path, regexp_extract(path, '[^/]\\.([A-Za-z0-9]+)$', 1) as ext from files where path is not null)""")
def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "files").filter(F.col("path").isNotNull()).select("path").distinct()
    return p.select("path", T.language(F.col("path")).alias("found"), T.is_test_path(F.col("path")).alias("test"))


# -- what SQL cannot express

@query()
def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", fnv1a("text").alias("hash"))


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file, spread where the scan has few splits: extraction is bound by CPU."""
    return spread(B.source_rows(spark, sf_dir).select("file_id", "lang", "text"))


@query()
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of every source file, read from its text."""
    rows = graph.extract_files(_source_files(spark, sf_dir))
    return rows.select("file_id", F.explode(F.arrays_zip("symbols", "containers")).alias("z")).select(
        "file_id", "z.symbols.name", "z.symbols.kind", "z.symbols.start_line", "z.symbols.end_line", F.col("z.containers").alias("container")
    )


@query()
def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per repository and kind of the graph built from the source texts."""
    extracts = cut(graph.extract_files(_source_files(spark, sf_dir)))
    one = F.max(F.struct("repo_id", F.col("rel").alias("path"), "lang")).alias("m")
    files = cut(read_table(spark, sf_dir, "source_files").groupBy("file_id").agg(one).select("file_id", "m.*"))
    built = graph.build(files, extracts)
    return built["edges"].groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("edges"))


@query()
def export_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.sinks.cards import cards

    return cards(B.current_files(spark, sf_dir), B.symbols(spark, sf_dir))


# -- whole graphs, and answers in their order

def _edge_values() -> str:
    name = lambda x: "null" if x is None else "'" + x + "'"
    return ", ".join(f"({', '.join(name(x) for x in e)})" for e in X.EDGES)


@query(f"""with made(kind, src_path, src, dst_path, dst) as (values {_edge_values()})
    select n_nationkey::bigint as repo_id, kind, src_path, replace(src, '@', n_nationkey::varchar) as src, dst_path,
           replace(dst, '@', n_nationkey::varchar) as dst from nation, made""")
def graph_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and calls across the files of seven languages, receivers and packages among them."""
    files, modules = X.repositories(spark, sf_dir)
    return X.named_edges(files, X.built(cut(files), modules))


@query("""select what, n::bigint as n from (values ('symbols', 5 * 400), ('contains', 4 * 400), ('imports', 400 - 1), ('calls', 3 * 400 - 1),
    ('unresolved', 0)) t(what, n)""")
def graph_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the graph of generated modules, which are known in closed form."""
    g = X.built(cut(X.generated(spark)))
    one = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    out = one(g["symbols"], "symbols").unionByName(one(g["sites"].filter(F.col("dst").isNull()), "unresolved"))
    for kind in ("contains", "imports", "calls"):
        out = out.unionByName(one(g["edges"].filter(F.col("kind") == kind), kind))
    return out


@query("""select unnest(['process_payment_0_0', 'process_payment_1_0', 'process', 'process', 'process_payment_2_0']) as name, unnest([0, 1, 1, 2, 2]) as depth
    except all select 'process_payment_0_0', 0""")
def graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls the first generated function, to depth 2."""
    files = cut(X.generated(spark))
    g = X.built(files)
    got = traverse.callers(g["symbols"], g["edges"], files, "process_payment_0_0", depth=2)
    return got.select("name", F.col("depth").cast("int").alias("depth"))


@query("""with made(name, depth) as (values ('src/module_1.ts', 1), ('process_payment_1_0', 1), ('process', 2), ('src/module_2.ts', 2), ('process_payment_2_0', 2))
    select name, depth from made""")
def graph_file_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file as the seed stands for its members from depth 2 on."""
    files = cut(X.generated(spark))
    g = X.built(files)
    got = traverse.callers(g["symbols"], g["edges"], files, "src/module_0.ts", depth=2)
    return got.select("name", F.col("depth").cast("int").alias("depth"))


@query(f"""with base as ({_ask(_DOCS, QUESTION)}), {_DOCS}
    select id, row_number() over (order by score desc, path, start_line, id) as rank from base join docs using (id) qualify rank <= 8""")
def ask_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best answers in their order."""
    best = retrieval.rank(B.documents(spark, sf_dir), QUESTION, limit=8)
    over = Window.orderBy(F.desc(F.round("score", 6)), "path", "start_line", "id")  # over eight rows
    return best.select("id", F.row_number().over(over).cast("long").alias("rank"))


@query(f"""with {_SOURCES}, {_LINES}, {_SYMBOLS}, hits as ({_HIT} contains(raw, 'return')),
    owned as (select h.file_id, h.path, h.line, h.text, arg_min(s.id, struct_pack(w := s.end_line - s.start_line, id := s.id)) as symbol
              from hits h left join syms s on s.file_id = h.file_id and h.line between s.start_line and s.end_line group by 1, 2, 3, 4),
    groups as (select file_id, path, symbol, string_agg(line || ':' || text, chr(10) order by line) as lines from owned group by 1, 2, 3)
    select g.file_id, g.symbol, g.lines, row_number() over (order by path, coalesce(s.start_line, 0), g.file_id, g.symbol nulls first) as rank
    from groups g left join syms s on s.id = g.symbol""")
def grep_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of answers, with their lines."""
    symbols = B.symbols(spark, sf_dir)
    hits = _once(search.matching_lines(B.source_scan(spark, sf_dir), "return", fixed=True))
    none = spark.createDataFrame([], "src long, dst long, kind string")
    groups = search.grouped(hits, symbols, none)
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["text"])), "\n")
    # An answer is one list, so its order is over all groups.
    over = Window.orderBy(F.desc("in_edges"), "path", F.coalesce("start_line", F.lit(0)), "file_id", F.col("symbol").asc_nulls_first())
    return groups.select("file_id", "symbol", lines.alias("lines"), F.row_number().over(over).cast("long").alias("rank"))


@query(f"""with {_SYMBOLS}, {_FILES}, f as (select file_id, path, case when contains(path, '/') then split_part(path, '/', 1) || '/' else '.' end as dir from cur),
    d as (select dir, count(distinct path) as files from f group by 1), n as (select dir, count(*) as symbols from syms join f using (file_id) group by 1),
    r as (select dir, coalesce(symbols, 0) as symbols, row_number() over (order by coalesce(symbols, 0) desc, dir) as rank from d left join n using (dir))
    select dir, symbols, rank, (select greatest(count(*) - 5, 0) from r) as dropped from r where rank <= 5""")
def map_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five folders with most symbols and how many were left out."""
    symbols = cut(B.symbols(spark, sf_dir))
    none = spark.createDataFrame([], "src long, dst long, kind string")
    m = rank.repo_map(B.current_files(spark, sf_dir), symbols, none, 5)
    rows = [(d["dir"], d["symbols"], i, m["dropped_dirs"]) for i, d in enumerate(m["dirs"], 1)]
    return spark.createDataFrame(rows, "dir string, symbols long, rank long, dropped long")
