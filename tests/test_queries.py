"""Every grid query against its SQL."""

import pytest

from cellarium.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(same, name):
    same(q.QUERIES[name], q.SQL[name])


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.SQL)


def test_published_geometry_averages(spark):
    """Means over the first million ids of the benchmark's grid; the benchmark itself takes 1e8."""
    row = q.QUERIES["geometry_averages"](spark, "").first()
    assert abs(row["length_x"] - 1) < 1e-9 and abs(row["length_y"] - 1.1) < 1e-9 and abs(row["center_x"] - 50) < 1e-6
