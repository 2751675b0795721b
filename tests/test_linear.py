"""One-pass linear models against plain solvers in numpy, dense and sparse, and passes that don't grow with labels."""

import numpy as np
import pytest

from loomtext.operators import classify, linear


def fixture(spark, n=300, d=12, labels=4, seed=1, sparse=False, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < (0.4 if sparse else 1.0))
    w = rng.normal(size=(labels, d))
    y = (x @ w.T + rng.normal(size=(n, labels)) > 0.5).astype(int)
    feature = lambda v: (d, [int(i) for i in np.flatnonzero(v)], [float(z) for z in v[v != 0]]) if sparse else (d, None, [float(z) for z in v])
    f = spark.createDataFrame([(i, feature(x[i])) for i in range(n)], f"handle long, features {linear.FEATURES}").repartition(parts)
    t = spark.createDataFrame([(i, f"l{k}", int(y[i, k])) for i in range(n) for k in range(labels)], "handle long, label string, y int")
    return x, y, f, t


def newton(x, y, c, loss):
    """0.5 |w|^2 + C sum(loss) by damped Newton steps, the bias a feature."""
    x = np.c_[x, np.ones(len(x))]
    sign, w = 2.0 * y - 1, np.zeros(x.shape[1])
    for _ in range(200):
        m = sign * (x @ w)
        if loss == "logreg":
            p = 1 / (1 + np.exp(m))
            slope, bend = -sign * p, p * (1 - p)
        else:
            gap = np.maximum(0, 1 - m)
            slope, bend = -2 * sign * gap, 2.0 * (gap > 0)
        g = w + c * x.T @ slope
        step = np.linalg.solve(np.eye(len(w)) + c * (x.T * bend) @ x, g)
        value = lambda v: 0.5 * v @ v + c * (np.logaddexp(0, -sign * (x @ v)) if loss == "logreg" else np.maximum(0, 1 - sign * (x @ v)) ** 2).sum()
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
        if np.linalg.norm(g) < 1e-10:
            break
    return w


@pytest.mark.parametrize("loss,sparse", [("logreg", False), ("linear_svc", True)])
def test_coefficients_as_a_plain_solver_finds_them(spark, loss, sparse):
    x, y, f, t = fixture(spark, sparse=sparse)
    model = classify.fit_one_vs_rest(f, t, loss, c=0.5, tol=1e-9)
    want = np.array([newton(x, y[:, k], 0.5, loss) for k in range(y.shape[1])])
    assert np.abs(model.fit.weights - want).max() < 1e-4 and model.fit.converged.all()
    z = np.c_[x, np.ones(len(x))] @ want.T
    z = 1 / (1 + np.exp(-z)) if loss == "logreg" else z
    got = {(r.handle, r.label): r.score for r in model.scores(f).collect()}
    assert len(got) == y.size and max(abs(got[i, f"l{k}"] - z[i, k]) for i in range(len(x)) for k in range(y.shape[1])) < 1e-3


def test_passes_do_not_grow_with_labels(spark):
    """Labels share passes: twelve labels take at most what the slowest takes and its steps back."""
    _, _, f, t = fixture(spark, n=120, d=6, labels=12)
    whole = linear.training_data(f, t)
    many = linear.minimise(whole, "logreg", tol=1e-6)
    one = [linear.minimise(linear.training_data(f, t.where(f"label = 'l{k}'")), "logreg", tol=1e-6).passes for k in (0, 7)]
    assert many.passes <= 2 * max(many.iterations) + 2 and many.passes < sum(one) * 3


def test_descent_is_the_sequential_method_on_one_task(spark):
    x, y, f, t = fixture(spark, n=150, d=5, labels=2, sparse=True, parts=1)
    data = linear.training_data(f, t)
    data.blocks = data.blocks.coalesce(1)
    rows = [linear._block(r.asDict(), 2) for r in data.blocks.collect()]
    order = [(b, i) for b in rows for i in range(len(b))]
    found = linear.descend(data, max_iter=4, tol=-1.0)
    alpha, w, t0 = 1e-4, np.zeros((2, 6)), None
    rate0 = np.sqrt(1 / np.sqrt(alpha))
    t0 = 1 / (rate0 / max(1.0, 1 / (1 + np.exp(-rate0))) * alpha)
    n = 0
    for _ in range(4):
        for b, i in order:
            v = np.zeros(5)
            v[b.columns[b.at[b.start[i] : b.start[i + 1]]]] = b.values[b.start[i] : b.start[i + 1]]
            sign, rate = 2.0 * b.y[i] - 1, 1 / (alpha * (t0 + n))
            slope = -sign / (1 + np.exp(sign * (w[:, :5] @ v + w[:, 5])))
            w[:, :5] = w[:, :5] * (1 - rate * alpha) - rate * np.outer(slope, v)
            w[:, 5] -= rate * slope
            n += 1
    assert np.abs(found.weights - w).max() < 1e-8 and found.passes == 4


def test_descent_over_many_tasks_learns(spark):
    x, y, f, t = fixture(spark, n=400, d=8, labels=3, parts=6)
    model = classify.fit_one_vs_rest(f, t, "sgd", max_iter=60)
    got = {(r.handle, r.label): r.score for r in model.scores(f).collect()}
    right = np.mean([(got[i, f"l{k}"] >= 0.5) == y[i, k] for i in range(400) for k in range(3)])
    assert right > 0.85


def test_tree_of_sums(spark):
    df = spark.range(0, 1000, 1, 40).selectExpr("id")
    f = lambda rows: np.full(5, sum(r["id"] for r in rows), dtype=float)
    assert linear.tree_sum(df, f, 5, fan=3).tolist() == [499500.0] * 5
    assert linear.tree_sum(df.where("id < 0"), lambda rows: None, 5).tolist() == [0.0] * 5


def test_one_class_and_weights_and_empty(spark):
    x, y, f, t = fixture(spark, n=60, d=3, labels=2)
    t = t.selectExpr("handle", "label", "case when label = 'l1' then 1 else y end as y")
    for name, want in (("logreg", 1.0), ("linear_svc", 1.0), ("sgd", 1.0)):
        model = classify.fit_one_vs_rest(f, t, name, max_iter=20)
        assert {round(r.score, 9) for r in model.scores(f).where("label = 'l1'").collect()} == {want}
        assert {r.label: r.iterations for r in model.convergence(spark).collect()}["l1"] == 0
    twice = f.selectExpr("handle", "features", "2.0 as w")
    a = classify.fit_one_vs_rest(twice, t, "logreg", weight="w", tol=1e-9).fit.weights
    b = classify.fit_one_vs_rest(f, t, "logreg", c=2.0, tol=1e-9).fit.weights
    assert np.abs(a - b)[0].max() < 1e-5
    none = classify.fit_one_vs_rest(f.limit(0), t.limit(0), "logreg")
    assert none.scores(f).count() == 0
