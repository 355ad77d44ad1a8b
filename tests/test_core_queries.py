"""Every core query beside its SQL on the smallest tables."""

import pytest

from kernelweave.plans import catalogue

SMALL = "/root/testdata/sf0.001"
FREE_OF_SQL = {"topo_levels", "agglomerative_complete", "k_medoids", "markov_clusters"}


def test_every_query_has_sql_or_is_listed():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == FREE_OF_SQL


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_what_its_sql_gives(against_sql, name):
    against_sql(name, SMALL)


@pytest.mark.parametrize("name", sorted(FREE_OF_SQL))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
