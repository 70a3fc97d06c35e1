"""The registered VMA descent against numpy run until its criterion holds."""

import numpy as np
import pytest

from lagoon.operators.models import fit_vma
from lagoon.plans import catalog
from lagoon.series import TICK


def test_vma_descent_ends_by_its_criterion(spark):
    sf_dir = "/root/testdata/sf0.1"
    ts = catalog._hourly(spark, sf_dir, bck=40, fwd=40)
    rows = np.array([r[:] for r in ts.df.select(TICK, *ts.values).orderBy(TICK).collect()], float)
    x = rows[:, 1:] - rows[:, 1:].mean(axis=0)
    first = fit_vma(ts, 1, depth=20)
    p = 1 / np.diag(first.noise)

    def both(b):
        past, loss, g = np.zeros(2), 0.0, np.zeros((2, 2))
        for row in x:
            e = row - b @ past
            loss, g, past = loss + e @ (p * e), g - 2 * np.outer(p * e, past), e
        return loss / len(x), g / len(x)

    b = first.ma[0]
    (loss, g), steps = both(b), 0
    while (size := np.sqrt((g * g).sum())) > 1e-4 * (1 + loss):
        t = 0.45 * 0.9**steps
        for _ in range(10):
            new = both(b - t * g)
            if new[0] <= loss - 0.4 * t * size**2:
                break
            t *= 0.9
        if not new[0] < loss:
            break
        b, (loss, g), steps = b - t * g, new, steps + 1
    assert steps > 2  # where the query once stopped
    got = catalog.queries()["vma_gradient_descent"](spark, sf_dir).collect()
    ma = {(r["i"], r["j"]): r["value"] for r in got if r["kind"] == "ma"}
    assert [ma[i, j] for i in (0, 1) for j in (0, 1)] == pytest.approx(b.ravel().tolist(), abs=2e-6)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_ar_descents_end_by_their_criteria(spark, sf):
    """The three registered descents of AR coefficients against plain numpy over the rows of the grid."""
    sf_dir = f"/root/testdata/sf{sf}"
    ts = catalog._hourly(spark, sf_dir)
    rows = np.array([r[:] for r in ts.df.select(TICK, *ts.values).orderBy(TICK).collect()], float)[:, 1:]
    m = rows.mean(axis=0)
    now, past = rows[2:], np.concatenate([rows[1:-1], rows[:-2]], axis=1)
    cov = [now.T @ now / len(now) - np.outer(m, m), now.T @ past[:, :2] / len(now) - np.outer(m, m), now.T @ past[:, 2:] / len(now) - np.outer(m, m)]
    gamma = np.block([[cov[0], cov[1]], [cov[1].T, cov[0]]])
    start = np.linalg.solve(gamma.T, np.concatenate(cov[1:], axis=1).T).T
    e, z = now - m, past - np.tile(m, 2)
    residual = e - z @ start.T
    zz, top = z.T @ z / len(z), lambda p: 1 / (2 * np.linalg.eigvalsh(zz)[-1] * p.max())

    def both(a, p):
        r = e - z @ a.T
        return (r * r * p).sum(axis=1).mean(), -2 * (p[:, None] * (r.T @ z / len(z)))

    got = {}
    for name in ("var_gradient_descent", "var_l1_descent", "var_l1_truncated"):
        found = np.zeros((2, 4))
        for r in catalog.queries()[name](spark, sf_dir).where("kind = 'ar'").collect():
            found[r["i"], 2 * (r["lag"] - 1) + r["j"]] = r["value"]
        got[name] = found
    p = 1 / np.diag(cov[0] - start @ np.concatenate(cov[1:], axis=1).T)
    a, loss, g = start, *both(start, p)
    while np.sqrt((g * g).sum()) > 1e-4 * (1 + loss):
        a = a - top(p) * g
        new, g = both(a, p)
        assert new < loss
        loss = new
    assert got["var_gradient_descent"] == pytest.approx(a, abs=2e-6)
    p = 1 / np.diag(residual.T @ residual / len(residual))
    for name, limit in (("var_l1_descent", np.inf), ("var_l1_truncated", 0.2)):
        a, whole = start, both(start, p)[0] + 0.05 * np.abs(start).sum()
        for _ in range(1000):
            a = a - top(p) * both(a, p)[1]
            a = np.where(np.abs(a) <= limit, np.sign(a) * np.maximum(np.abs(a) - 0.05 * top(p), 0), a)
            new = both(a, p)[0] + 0.05 * np.abs(a).sum()
            if abs(whole - new) <= 1e-6:
                break
            whole = new
        assert got[name] == pytest.approx(a, abs=2e-6)
