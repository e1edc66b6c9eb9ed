"""Every registered query of the engine against DuckDB on the smallest tables."""

import pytest
from harness import DATA, check

from lumenstep.plans import catalog, datastep_queries, family_queries, function_queries, proc_queries, relational_queries  # noqa: F401

EMPTY = {"sql_group_having"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    n = check(spark, catalog.QUERIES[name], catalog.ORACLES.get(name), DATA)
    assert n or name in EMPTY


def test_whole_tables(spark):
    rows = {n: spark.read.parquet(f"{DATA}/{n}.parquet").count() for n in ("customer", "nation", "documents", "part")}
    got = {n: catalog.QUERIES[n](spark, DATA) for n in ("proc_rank_savage_all", "fmt_words_all", "fn_char_search_all", "proc_univariate_histogram_all", "ds_merge_in_all", "sql_sounds_like_all")}
    assert got["proc_rank_savage_all"].count() == rows["customer"] and got["fmt_words_all"].count() == rows["nation"] and got["fn_char_search_all"].count() == rows["documents"]
    assert sum(r["COUNT"] for r in got["proc_univariate_histogram_all"].collect()) == rows["part"]
    assert {tuple(r) for r in got["ds_merge_in_all"].select("in_a", "in_b").distinct().collect()} == {(0, 1), (1, 0), (1, 1)}
    # digits have no sound, so every NATION_k is like NADION; of the regions only AMERICA is like AMERIKA
    assert sorted(r[0] for r in got["sql_sounds_like_all"].collect()) == sorted([f"NATION_{k}" for k in range(rows["nation"])] + ["AMERICA"])
