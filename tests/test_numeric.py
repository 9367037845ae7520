import numpy as np
import pytest

from loomspark.operators import kmeans, linalg, prefix


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, v array<double>")


def test_blobs(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.1, (20, 3)), r.normal(5, 0.1, (20, 3))])
    fitted = kmeans.kmeans(points(spark, x), 2, init=np.array([x[0], x[20]]))
    assert np.allclose(fitted.centres, [x[:20].mean(0), x[20:].mean(0)])
    assert [m.cid for m in fitted.membership(points(spark, x)).orderBy("id").collect()] == [0] * 20 + [1] * 20


def brute(x, k, threshold, most=500):
    c, was, loop = x[:k].copy(), np.full(len(x), -1), 0
    while True:
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
        changed, was, loop = (at != was).sum(), at, loop + 1
        if changed <= threshold * len(x) or loop > most:
            return c, at, loop


@pytest.mark.parametrize("local", [0, 10**6])
def test_same_as_sequential_passes(spark, monkeypatch, local):
    monkeypatch.setattr(kmeans, "LOCAL_NUMBERS", local)
    x = np.random.default_rng(1).random((200, 4))
    c, at, loop = brute(x, 7, 0.001)
    fitted = kmeans.kmeans(points(spark, x), 7)
    assert fitted.loops == loop and np.allclose(fitted.centres, c)
    assert [m.cid for m in fitted.membership(points(spark, x)).orderBy("id").collect()] == at.tolist()


def test_ties_empty_and_single_clusters(spark):
    p = points(spark, [[0.0], [2.0], [1.0]])
    assert [r.cid for r in kmeans.assign(p, [[0.0], [2.0]]).orderBy("id").collect()] == [0, 1, 0]
    centres = np.array([[0.0], [2.0], [100.0]])
    sums = kmeans.partial_sums(p, centres, None)
    assert kmeans.update(sums, centres)[0].tolist() == [[0.5], [2.0], [100.0]]
    assert kmeans.update(sums, centres + 0.0, min_size=2)[0].tolist() == [[0.5], [2.0], [100.0]]
    off = np.array([[0.0], [2.5], [100.0]])
    assert kmeans.update(kmeans.partial_sums(p, off, None), off, min_size=2)[0].tolist() == [[0.5], [2.5], [100.0]]
    with pytest.raises(ValueError):
        kmeans.kmeans(p, 1)


def test_seeding(spark):
    x = np.random.default_rng(2).random((50, 2))
    ids, draws = [3], [0.2, 0.7, 0.95]
    for draw in draws:
        d = ((x[:, None] - x[ids]) ** 2).sum(2).min(1)
        ids.append(int(np.flatnonzero(draw * d.sum() < d.cumsum())[0]))
    assert kmeans.plus_plus(points(spark, x), 3, draws) == ids


def test_running_sum(spark):
    df = spark.range(100).selectExpr("id", "cast(id * 7 % 13 as bigint) as x").repartition(7)
    got = [r.running for r in prefix.running_sum(df, "id", "x").orderBy("id").collect()]
    assert got == np.cumsum([i * 7 % 13 for i in range(100)]).tolist()


def coordinates(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i bigint, j bigint, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize("n", [1, 8, 33])
def test_products(spark, n):
    r = np.random.default_rng(n)
    a, b = r.random((n, n)), r.random((n, n))
    x, y = coordinates(spark, a), coordinates(spark, b)
    assert np.allclose(dense(linalg.multiply(x, y), a.shape), a @ b, atol=1e-9)
    assert np.allclose(dense(linalg.multiply_blocks(x, y, block=10), a.shape), a @ b, atol=1e-9)
    assert linalg.max_abs_diff(linalg.multiply(x, y), linalg.multiply_blocks(x, y, block=10)).first()[0] < 1e-9


def test_elementwise(spark):
    a = np.arange(12.0).reshape(3, 4)
    x = coordinates(spark, a)
    assert (dense(linalg.transpose(x), (4, 3)) == a.T).all()
    assert (dense(linalg.add(x, x), a.shape) == 2 * a).all()
    assert linalg.equals(x, x).first().equal is True
    assert linalg.equals(x, linalg.add(x, x)).first().equal is False
    assert linalg.max_abs_diff(x, coordinates(spark, a + 0.5)).first()[0] == 0.5  # not truncated
    assert linalg.gflops(10, 2.0) == pytest.approx(19 * 100 * 1e-9 / 2)


def test_random_matrix_is_repeatable(spark):
    a, b = (linalg.random_matrix(spark, 5, 6, seed=3).repartition(k) for k in (1, 4))
    assert linalg.equals(a, b).first().equal is True


def test_seedings(spark):
    x = np.concatenate([np.random.default_rng(4).normal(c, 0.05, (30, 2)) for c in (0, 10, 20)])
    p = points(spark, x)
    fitted = kmeans.kmeans(p, 3, init="k-means++", seed=1)
    assert sorted(fitted.centres[:, 0].round().tolist()) == [0, 10, 20]
    assert np.array_equal(kmeans.random_rows(p, 4, 7), kmeans.random_rows(p.repartition(5), 4, 7))
    with pytest.raises(ValueError):
        kmeans.kmeans(p, 3, init="kmeans++")


def test_equal_and_no_points(spark):
    assert kmeans.plus_plus(points(spark, [[1.0]] * 3), 1, [0.1, 0.5, 0.9]) == [1, 0, 2]
    none = points(spark, [[1.0]]).limit(0)
    for init in kmeans.SEEDINGS:
        fitted = kmeans.kmeans(none, 2, init=init)
        assert fitted.centres.size == 0 and fitted.membership(none).count() == 0 and fitted.loops == 0
