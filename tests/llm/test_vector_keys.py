"""Links and components of vectors whose keys are null or repeated, against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import lattice


def plain(rows, least=0.93):
    """(key, n_links, component, kept) of (key, label, vector): links by row, components over keys."""
    ok = [lab is not None and v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, lab, v in rows]
    alike = lambda a, b: a[1] == b[1] and len(a[2]) == len(b[2]) and np.dot(a[2], b[2]) / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= least
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and alike(rows[i], rows[j])] for i in range(len(rows))]
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    first = lambda k: (k is not None, k or 0)
    for i, js in enumerate(links):
        for j in js:
            a, b = sorted((find(rows[i][0]), find(rows[j][0])), key=first)
            root[b] = a
    return sorted(((r[0], len(links[i]), find(r[0]), find(r[0]) == r[0]) for i, r in enumerate(rows)), key=repr)


def classes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("vec", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("part", F.lit(None).cast("int"))
    return sorted(map(tuple, lattice.vector_classes(df).collect()), key=repr)


A, B, X = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 0, A), (1, 0, B), (2, 0, [1.0, 0.02, 0.1])],
        [(1, 0, A), (None, 0, X)],
        [(None, 0, A), (None, 0, B), (3, 0, A), (None, 1, X)],
        [(7, 0, A), (7, 1, X), (8, 1, X), (9, 0, A), (5, 2, X), (8, 2, X)],
        [(4, 0, A), (4, None, A), (2, 0, B), (4, 0, [0.0, 0.0, 0.0]), (4, 0, None), (9, 0, [])],
        [(1, 0, A)] * 4 + [(2, 0, A)] * 3 + [(None, 0, A)] * 2,
    ],
)
def test_links_are_counted_by_row_and_components_by_key(spark, rows):
    assert classes(spark, rows) == plain(rows)


def test_a_hot_group_with_few_keys(spark):
    """Thousands of different vectors, all alike, under null and a few keys: counted for each row."""
    r = np.random.default_rng(1)
    rows = [(None if i % 3 == 0 else i % 4, 1, (np.ones(8) + 0.001 * r.normal(size=8)).tolist()) for i in range(3000)]
    got = classes(spark, rows)
    assert {x[1] for x in got} == {2999} and {x[2] for x in got} == {None} and len(got) == 3000
