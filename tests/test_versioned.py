"""Versions of tables: what a commit changes, refused and conflicting ones, deletes that cascade."""

import pytest
from pyspark.sql import functions as F

from weftgraph.sources.versioned import Change, Conflict, Refused, RepositoryStore, VersionedTables

REPOS = "id long, owner_id string, visibility string, updated_at long"


@pytest.fixture
def store(spark, tmp_path):
    made = RepositoryStore(VersionedTables(spark, str(tmp_path / "store")))
    made.register(spark.createDataFrame([(1, "ann", "private", 5), (2, "ann", "public", 9), (3, "bob", "private", 7)], REPOS))
    made.replace("ann", {"symbols": symbols(spark, (1, "a"), (1, "b"), (2, "c")), "edges": edges(spark, (1, "a", "b"))})
    made.replace("bob", {"symbols": symbols(spark, (3, "d"))})
    return made


def symbols(spark, *rows):
    return spark.createDataFrame(list(rows), "repo_id long, name string")


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "repo_id long, source string, target string")


def names(store, version=None):
    return sorted((r["repo_id"], r["name"]) for r in store.tables.read("symbols", version).collect())


def test_a_commit_replaces_its_parts_and_older_versions_stay(spark, store):
    before = store.tables.version()
    folders = store.tables.manifest()["tables"]["symbols"]["parts"]
    after = store.replace("ann", {"symbols": symbols(spark, (1, "z"))})
    assert names(store) == [(1, "z"), (2, "c"), (3, "d")]
    assert names(store, before) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    now = store.tables.manifest()["tables"]["symbols"]["parts"]
    assert after == before + 1 and {p for p in now if now[p] != folders[p]} == {"1"}
    assert store.tables.read("edges").count() == 1  # a table that isn't named stays


@pytest.mark.parametrize("rows", [[(1, "x"), (3, "stolen")], [(9, "of none")], [(None, "of none")]])
def test_a_refused_write_changes_nothing(spark, store, rows):
    version, before = store.tables.version(), names(store)
    with pytest.raises(Refused):
        store.replace("ann", {"symbols": symbols(spark, *rows)})
    with pytest.raises(Refused):
        store.delete("ann", spark.createDataFrame([(rows[-1][0],)], "repo_id long"))
    with pytest.raises(Refused):
        store.set_visibility("ann", spark.createDataFrame([(rows[-1][0],)], "repo_id long"), "public")
    assert store.tables.version() == version and names(store) == before


def test_of_two_writers_one_wins(spark, store):
    base = store.tables.version()
    store.replace("ann", {"symbols": symbols(spark, (1, "first"))}, base=base)
    with pytest.raises(Conflict):
        store.replace("bob", {"symbols": symbols(spark, (3, "second"))}, base=base)
    assert (1, "first") in names(store) and (3, "d") in names(store)
    store.replace("bob", {"symbols": symbols(spark, (3, "second"))})
    assert (3, "second") in names(store)


def test_deleting_cascades_and_listing_follows(spark, store):
    assert [r["id"] for r in store.listed("ann").collect()] == [2, 1]
    store.delete("ann", spark.createDataFrame([(1,)], "repo_id long"))
    assert [r["id"] for r in store.listed("ann").collect()] == [2] and names(store) == [(2, "c"), (3, "d")]
    assert store.tables.read("edges").count() == 0


def test_visibility_decides_who_reads(spark, store):
    assert {r["name"] for r in store.visible("symbols", "bob").collect()} == {"c", "d"}
    store.set_visibility("bob", spark.createDataFrame([(3,)], "repo_id long"), "public")
    assert {r["name"] for r in store.visible("symbols", "ann").collect()} == {"a", "b", "c", "d"}
    with pytest.raises(ValueError):
        store.set_visibility("bob", spark.createDataFrame([(3,)], "repo_id long"), "secret")


def test_tables_change_together_and_a_failing_plan_changes_none(spark, store):
    good = symbols(spark, (1, "x")).withColumn("_part", F.lit("1"))
    bad = edges(spark, (1, "x", "y")).withColumn("_part", F.lit("1")).withColumn("target", F.raise_error(F.lit("broken")))
    version = store.tables.version()
    with pytest.raises(Exception, match="broken"):
        store.tables.commit({"symbols": Change(good), "edges": Change(bad)})
    assert store.tables.version() == version and (1, "x") not in names(store)
    assert store.tables.commit({"symbols": Change(good)}, note="n") == version + 1 == store.tables.last_with("n")
