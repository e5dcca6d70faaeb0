"""SQL of the llm queries that SQL can express."""

_SCORES = """
with one as (
  select id, max(list_filter(list_concat(coalesce(name_terms, []), list_concat(coalesce(signature_terms, []),
           coalesce(body_terms, []))), lambda t: t.term is not null and t.tf > 0)) as terms
  from search_docs where id is not null group by id
), flat as (select id, unnest(terms) as t from one),
cells as (select id, t.term as term, sum(t.tf) as o from flat group by 1, 2),
size as (select id, sum(o) as r from cells group by 1), col as (select term, sum(o) as c from cells group by 1),
total as (select cast(sum(o) as double) as n from cells),
scores as (
  select id, term, o as tf, (o - r * c / n) / sqrt(r * c / n * (1 - r / n) * (1 - c / n)) as score
  from cells join size using (id) join col using (term), total
)
"""

SQL = {
    "p2_found": _SCORES
    + """select id, term from (select id, term, row_number() over (partition by id order by score desc, term) as k
         from scores where id in (select id from term_probes)) where k = 1""",
    "p2_scores": _SCORES + "select id, term, cast(tf as bigint) as tf, round(score, 6) as score from scores",
}
