"""Near-duplicate vectors against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from factloom.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, tile string"


def planted(dim, n, seed=5):
    """Rows of clusters around the threshold, equal vectors, scaled ones and unlike ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.standard_normal(dim)
        label = [0, 0, 0, 1, 2, None][k % 6]
        for _ in range(rng.integers(1, 6)):
            rows.append(((base / np.linalg.norm(base) + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.12, 0.2, 0.3]) / math.sqrt(dim)) * rng.choice([1, 1, 7.5]), label))
    return [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]


def by_hand(rows, threshold=E.THRESHOLD):
    usable = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    units = {k: np.array(rows[k][1], dtype=np.float64) for k in usable}
    units = {k: u / np.abs(u).max() for k, u in units.items()}
    units = {k: u / np.linalg.norm(u) for k, u in units.items()}
    near = {k: [j for j in usable if j != k and rows[j][2] == rows[k][2] and len(units[j]) == len(units[k]) and units[j] @ units[k] >= threshold] for k in usable}
    out = []
    for k, (name, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(near.get(k, [])), low, name == low))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    made = E.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **options)
    return sorted(map(tuple, made.collect()), key=repr)


@pytest.mark.parametrize("block", [E.BLOCK, 7])
@pytest.mark.parametrize("dim", [64, 5])
def test_against_all_pairs(spark, dim, block):
    rows = planted(dim, 90)
    want = by_hand(rows)
    assert sum(r[1] for r in want) > 100
    assert found(spark, rows, block=block) == want


def test_one_vector_holds_most_rows(spark):
    rows = planted(16, 20)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(400)]
    assert found(spark, rows, block=7) == by_hand(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, v, 0), (2, None, 0), (3, v, None), (4, [0.0, 0.0, 0.0], 0), (5, [], 0), (6, [1.0, None, 3.0], 0), (7, [nan, 1.0, 2.0], 0), (8, [inf, 1.0, 2.0], 0),
        (9, [2.0, 4.0, 6.0], 0), (9, [2.0, 4.0, 6.0], 0), (None, v, 0), (None, [5.0, -1.0, 0.0], 0), (10, [1.0, 2.0], 0), (11, [-0.0, 1.0, 0.0], 1), (12, [0.0, 1.0, 0.0], 1), (13, [3e38, 3e38, 0.0], 2), (14, [1e38, 1e38, 0.0], 2),
    ]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == []


def test_estimates_are_unbiased_and_bounds_hold(monkeypatch):
    rng = np.random.default_rng(1)
    pair = E.unit(rng.standard_normal((2, 32)))
    pair[1] = E.unit((pair[0] + 0.6 * pair[1])[None])[0]
    real, errors = float(pair[0] @ pair[1]), []
    for seed in range(400):
        monkeypatch.setattr(E, "SEED", seed)
        E.rotation.cache_clear()
        bits, c = E.encode(pair[:1])
        s = float(pair[1] @ E.rotation(32) @ E.decode(bits, 32)[0])
        errors.append(s / c[0] - real)
        assert s >= E.least_product(c, 32, real, None)[0]
    E.rotation.cache_clear()
    assert abs(np.mean(errors)) < 4 * np.std(errors) / 20


def test_deduplicated_keeps_one_of_each(spark):
    rows = planted(16, 30)
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert sorted(r.vec_id for r in E.deduplicated(docs).collect()) == sorted(r[0] for r in by_hand(rows) if r[3])


def test_sql_on_planted_rows(spark):
    rows = planted(16, 40)
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(c.execute(E.near_duplicates_sql()).fetchall(), key=repr) == by_hand(rows)
