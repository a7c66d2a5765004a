"""Connected components: rounds and one task agree with union-find."""

import random

import pytest

from terratess.model import Grid
from terratess.operators import vector
from terratess.operators.components import components


@pytest.mark.parametrize("in_task", [0, 10_000])
def test_components_equal_union_find(spark, in_task):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2060)] + [(5, 5), (6, 7), (6, 7)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    found = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long"), in_task).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), in_task).count() == 0


def test_cells_in_rounds_and_in_task_agree(spark):
    r = random.Random(2)
    cells = spark.createDataFrame([(x, y, float(r.randrange(2))) for x in range(12) for y in range(12) if r.random() < 0.9], "px int, py int, v double")
    a, b = ({(c.px, c.py): c.component for c in vector.cell_components(cells, in_task=n).collect()} for n in (0, 10_000))
    assert a == b
    areas = vector.component_areas(vector.cell_components(cells), Grid(0, 1, 0, -1, 12, 12))
    assert areas.agg({"n_cells": "sum"}).first()[0] == cells.count()
