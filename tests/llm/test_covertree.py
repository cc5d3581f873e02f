"""Vector links against all pairs in double precision, at tree parameters that make every path run."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.llm import covertree, queries

SF = "/root/testdata/sf0.01"


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector)."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for dim in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dim]
        m = np.array([rows[k][1] for k in own], float)
        n = np.sqrt((m * m).sum(axis=1))
        for a, b in zip(*np.nonzero(m @ m.T / np.outer(n, n) >= least), strict=True):
            if a != b:
                links[own[a]] += 1
                root[max(find(own[a]), find(own[b]))] = min(find(own[a]), find(own[b]))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = min((x for x in groups[find(k)] if x is not None), default=None)
        out.append((i, links[k], component, i == component))
    return sorted(out, key=repr)


def around(rng, centre, n, cosine):
    """Unit vectors at about this cosine from a centre."""
    noise = rng.normal(size=(n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine * cosine) * noise


def planted(rng, dim):
    def unit():
        v = rng.normal(size=dim)
        return v / np.linalg.norm(v)

    parts = [rng.normal(size=(150, dim))]
    for cosine in (0.9999, 0.995, 0.98, 0.975, 0.96, 0.93, 0.8):
        parts.append(around(rng, unit(), 25, cosine) * rng.uniform(0.1, 50, (25, 1)))
    a, b = unit(), unit()
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    parts.append(np.array([math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 3.0, 0.1)]))  # a chain
    parts.append(np.repeat(unit()[None], 20, 0))  # equal rows
    return np.concatenate(parts)


@pytest.mark.parametrize(("leaf", "fanout", "element"), [(8192, 16, "float"), (40, 4, "float"), (12, 3, "double"), (5, 16, "float")])
def test_against_all_pairs(spark, leaf, fanout, element):
    rng = np.random.default_rng(leaf)
    vectors = planted(rng, 24)
    if element == "float":
        vectors = vectors.astype(np.float32)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(5000 + k, [float(x) for x in v]) for k, v in enumerate(around(rng, np.eye(7)[0], 30, 0.99).astype(np.float32))]  # another dimension
    rows += [(6000, None), (6001, []), (6002, [0.0] * 24), (6003, [None] + [1.0] * 23), (6004, [math.nan] + [1.0] * 23), (6005, [math.inf] + [1.0] * 23), (None, rows[0][1]), (None, rows[1][1]), rows[2]]
    rows += [(6100, [1.0, -0.0]), (6101, [1.0, 0.0]), (6102, [1e30, 1e-30]), (6103, [1e-30, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{element}>, node string, cell int").repartition(4)
    got = covertree.near_duplicate_vectors(df, leaf=leaf, fanout=fanout, sample=64)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_whole_cells_are_counted_not_compared(spark, monkeypatch):
    """A group that holds most rows, with strays at all distances from it."""
    rng = np.random.default_rng(3)
    centre = np.eye(16)[0]
    vectors = np.concatenate([around(rng, centre, 400, 0.9985), around(rng, centre, 60, 0.96), around(rng, centre, 60, 0.94), around(rng, centre, 60, 0.7), rng.normal(size=(100, 16))])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert sorted((tuple(r) for r in covertree.near_duplicate_vectors(df, leaf=32, fanout=8, sample=128).collect()), key=repr) == want


def test_last_nodes_and_bounds():
    rng = np.random.default_rng(4)
    u = planted(rng, 16)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    order, starts, radii = covertree.last_nodes(u, 0.158)
    assert sorted(order.tolist()) == list(range(len(u)))
    for s, e, r in zip(starts, [*starts[1:], len(u)], radii, strict=True):
        d = covertree.distances(u[order[s:e]], u[order[s : s + 1]])
        assert d[1:].max(initial=0) <= r + 1e-12 <= 0.158 + 1e-12
    chosen = covertree.farthest_first(u, 16, None)
    assert len(set(chosen)) == len(chosen) > 1


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.near_duplicate_vectors(empty).count() == 0
    none = spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, covertree.near_duplicate_vectors(none).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.oracle_sql()['op13_vectors']})").fetchall()
    assert sorted(map(tuple, queries.op13_vectors(spark, SF).collect())) == sorted(want)
    # The same SQL where there are links.
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(planted(rng, 12).astype(np.float32))]
    con.execute("CREATE OR REPLACE TABLE t (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    con.execute("DROP VIEW embeddings; CREATE VIEW embeddings AS SELECT * FROM t")
    found = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.oracle_sql()['op13_vectors']})").fetchall()
    assert sorted(found, key=repr) == brute(rows)


def test_disk_grows_with_vectors_not_with_pairs_of_leaves(spark):
    """Random vectors, so that all leaves meet: blocks meet without an exchange, and no shuffle outlives its query."""
    shuffles = lambda: {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(300, 16)))], "vec_id long, embedding array<double>").localCheckpoint()
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    covertree.near_duplicate_vectors(df, leaf=16, fanout=8, sample=64)
    assert shuffles() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    blocks = spark.createDataFrame([], "cell string, part long, dim int, nodes binary, weights binary, starts binary, radii binary, raw binary, key string")
    right = blocks.drop("dim", "key").toDF(*(f"{c}_" for c in blocks.drop("dim", "key").columns)).repartition(2)
    met = covertree._met(blocks.repartition(2), right, F.col("cell") == F.col("cell_"), F.lit(False), "<f8", 0.3, 0.95)
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
