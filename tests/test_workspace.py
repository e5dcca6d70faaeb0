"""Round robin over all repositories of a workspace."""

from graphloom.plans import reference


def test_all_repositories_take_turns(spark, tmp_path):
    repos = [(n, label) for n, label in ((5, "b"), (2, "a"), (9, None), (7, "c"), (1, "a"))]
    spark.createDataFrame(repos, "repo_id long, label string").write.parquet(f"{tmp_path}/repos.parquet")
    docs = [(n * 10 + k, n, "bind catalog shard" if k else "bind catalog", "function", k) for n, _ in repos for k in range(4)]
    docs += [(990, 99, "bind catalog shard", "function", 1)]  # of no repository
    schema = "id long, repo_id long, name string, kind string, in_edges long"
    spark.createDataFrame(docs + docs[:3], schema).write.parquet(f"{tmp_path}/search_docs.parquet")
    got = reference.QUERIES["workspace_round_robin"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["repo_id"] for r in got] == [9, 1, 2, 5, 7] * 2 + [9, 1]
    assert [r["id"] % 10 for r in got] == [3] * 5 + [2] * 5 + [1] * 2
