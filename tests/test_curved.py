"""The curved map: gradients, a fixture that no linear map fits, the same map from any partitioning."""

import numpy as np
import pytest

from sparkloom.operators import curved
from sparkloom.operators.proximity import ridge


def test_gradients_are_differences():
    rng = np.random.default_rng(1)
    model = curved.CurvedMap(rng.normal(size=(4, 3)), rng.normal(size=(4, 5)), rng.normal(size=5), rng.normal(size=(5, 3)), rng.normal(size=3))
    x, y = rng.normal(size=(7, 4)), rng.normal(size=(7, 3))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    _, grads = model.gradients(x, y)
    for p, g in zip(model.parameters(), grads):
        at = tuple(rng.integers(k) for k in p.shape)
        p[at] += 1e-6
        up = -model.gradients(x, y)[0]
        p[at] -= 2e-6
        down = -model.gradients(x, y)[0]
        p[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-4, abs=1e-6)


def test_it_beats_a_linear_map_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(6, 10)), rng.normal(size=(10, 5))
    x = rng.normal(size=(900, 6))
    y = np.tanh(2 * x @ a) ** 2 @ b + 0.3 * x[:, :5]
    rows = [(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(x, y))] + [(5000, None, [1.0] * 5), (5001, [float("nan")] * 6, [1.0] * 5), (5002, [1.0] * 6, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "id long, src array<double>, dst array<double>")
    learned, asked = frame.where("id % 9 <> 0"), [i for i in range(900) if i % 9 == 0]
    maps = [curved.fit_curved(learned.repartition(n), hidden=24, rounds=25, rows=40) for n in (1, 5)]
    assert all(np.array_equal(p, q) for p, q in zip(maps[0].parameters(), maps[1].parameters())) and maps[0].held_out == maps[1].held_out
    cos = lambda p: float(np.mean((p * y[asked]).sum(1) / np.linalg.norm(p, axis=1) / np.linalg.norm(y[asked], axis=1)))
    straight = np.array(ridge(learned, 1e-3))
    assert cos(maps[0](x[asked])) > cos(x[asked] @ straight) + 0.05
    carried = curved.carry_curved(frame.where("id < 3 OR id >= 5000").selectExpr("id", "src AS v"), maps[0]).collect()
    for r in carried:
        if r.id < 3:
            p = maps[0](x[r.id : r.id + 1])[0]
            assert np.allclose(r.carried, p / np.linalg.norm(p))
    assert {r.id: len(r.carried) for r in carried} == {0: 5, 1: 5, 2: 5, 5000: 0, 5001: 0, 5002: 5}
    with pytest.raises(ValueError):
        curved.fit_curved(frame.limit(0))
