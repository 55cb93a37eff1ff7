import random

import pytest

from lettermill.operators import components
from lettermill.operators.components import connected_components


def labels(spark, edges, **options):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r.node: r.component for r in connected_components(df, **options).collect()}


@pytest.mark.parametrize("local_edges", [0, 3, 200_000])
def test_random_graphs(spark, local_edges):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(None, 1), (5, 5)]
    group = {x: x for e in edges[:-2] for x in e} | {5: 5}
    for u, v in edges[:-2]:
        low, high = sorted((group[u], group[v]))
        group = {x: low if g == high else g for x, g in group.items()}
    assert labels(spark, edges, local_edges=local_edges) == group


def test_chain_takes_few_rounds(spark, monkeypatch):
    """A thousand links with ascending names, all of them on the cluster."""
    rounds = []
    kept = components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: (rounds.append(name), kept(df, name))[1])
    assert set(labels(spark, [(i, i + 1) for i in range(1000)], local_edges=0).values()) == {0}
    assert rounds.count("images") / 2 <= 15


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
