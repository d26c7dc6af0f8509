"""Operators and registered queries that once did less than the whole job."""

import os
import random

import pytest

from graphloom.operators import community
from graphloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def unequal() -> list[tuple]:
    """A large random component and a ring, which its own weight alone would split finer."""
    rng = random.Random(4)
    large = [(i, rng.randrange(i)) for i in range(1, 150)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(150)]
    return [(a, b) for a, b in large if a != b] + [(1000 + i, 1000 + (i + 1) % 12) for i in range(12)]


def test_communities_do_not_depend_on_where_they_run(spark):
    edges = spark.createDataFrame(unequal(), "source_id long, target_id long")
    here, there = ({r.node: r.community for r in community.communities(edges, **x).collect()} for x in ({}, {"driver_edges": 0}))
    assert here == there


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_reachable_roles_are_of_all_edges(spark):
    fans = [sorted(map(tuple, QUERIES[x](spark, SF).select("id", "fan_in", "fan_out").collect())) for x in ("roles", "roles_reachable")]
    assert fans[0] == fans[1]
