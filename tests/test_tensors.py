import itertools

import numpy as np
import pytest

from cellgrain import Tensor, TooManyIndicesError, build_einsum, build_spec, contract, convolve, suppressed
from cellgrain.operators.tensors import SIGNATURE, describe_signature


@pytest.fixture(scope="module")
def draw():
    return np.random.default_rng(7)


def sparse(draw, shape):
    return np.where(draw.random(shape) < 0.4, draw.integers(-4, 5, shape), 0).astype(float)


@pytest.mark.parametrize(("lam", "mu"), [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)])
def test_products_by_position(spark, draw, lam, mu):
    shared = (3, 4)[: lam + mu]
    a, b = sparse(draw, (2, *shared)), sparse(draw, (*shared, 5))
    spec = build_einsum(a.ndim, b.ndim, lam, mu)
    got = convolve(Tensor.from_dense(spark, a, "pqr"[: a.ndim]), Tensor.from_dense(spark, b, "uvw"[: b.ndim]), lam, mu)
    assert got.rank == a.ndim + b.ndim - lam - 2 * mu
    np.testing.assert_allclose(got.to_dense(), np.einsum(spec, a, b))


def test_named_products_and_laws(spark, draw):
    a, b, c = sparse(draw, (3, 4)), sparse(draw, (4, 5)), sparse(draw, (5, 2))
    ta, tb, tc = Tensor.from_dense(spark, a, "xk"), Tensor.from_dense(spark, b, "km"), Tensor.from_dense(spark, c, "my")
    np.testing.assert_allclose(ta.product(tb).product(tc).to_dense(), a @ b @ c)
    np.testing.assert_allclose(ta.product(tb.product(tc)).to_dense(), a @ b @ c)  # associative
    np.testing.assert_allclose((ta * 2.0 + ta).product(tb).to_dense(), 3 * a @ b)  # bilinear
    np.testing.assert_allclose(tb.product(ta).transpose(("x", "m")).to_dense(), a @ b)  # operands swapped
    unit = Tensor.unit(spark, {"k": ("k2", 4)})
    np.testing.assert_allclose(ta.product(unit).to_dense(), a)
    assert ta.roles(tb, keep=["k"]) == (["k"], []) and ta.roles(tb) == ([], ["k"])


def test_contraction_in_any_order(spark, draw):
    arrays = [sparse(draw, s) for s in ((3, 4), (4, 2), (2, 3), (3,))]
    names = ["ab", "bc", "ca", "a"]
    want = np.einsum("ab,bc,ca,a->c", *arrays)
    tensors = [Tensor.from_dense(spark, x, n) for x, n in zip(arrays, names)]
    for order in itertools.islice(itertools.permutations(range(4)), 0, 24, 7):
        np.testing.assert_allclose(contract([tensors[i] for i in order], ["c"]).to_dense(), want)


def test_more_axes_than_letters(spark):
    tensors = [Tensor.from_dense(spark, np.full((2,), 0.5), [f"x{i}"]) for i in range(4)]
    with pytest.raises(TooManyIndicesError):
        build_spec([[f"x{i}", "k"] for i in range(60)], ["k"])
    assert contract([t.rename(**{f"x{i}": f"a long name {i}"}) for i, t in enumerate(tensors)], []).item() == 1.0


def test_sixty_operands(spark):
    """More axes in one contraction than an index alphabet has letters."""
    tensors = [Tensor.from_dense(spark, [[0.5, 1.0, 0.0], [0.5, 0.25, 1.0]], [f"x{i}", "k"]) for i in range(60)]
    np.testing.assert_allclose(contract(tensors, ["k"]).to_dense(), [1.0, 1.25**60, 1.0])


def test_save_and_open(spark, draw, tmp_path):
    a = sparse(draw, (3, 4))
    Tensor.from_dense(spark, a, ("row", "col")).save(str(tmp_path / "t"), partition_by=["row"])
    again = Tensor.open(spark, str(tmp_path / "t"))
    assert again.axes == ("row", "col") and again.sizes == {"row": 3, "col": 4}
    np.testing.assert_allclose(again.to_dense(), a)
    np.testing.assert_allclose(Tensor.open(spark, str(tmp_path / "t"), "row = 1").to_dense()[1], a[1])


def test_projections(spark, draw):
    a = sparse(draw, (3, 4, 5))
    t = Tensor.from_dense(spark, a, "abc")
    for how, f in (("sum", np.sum), ("max", np.max), ("min", np.min), ("mean", np.mean), ("prod", np.prod)):
        np.testing.assert_allclose(t.project(["b"], how).to_dense() if how != "prod" else t.reduce(["b"], how).to_dense(), f(a, axis=1), atol=1e-12)
    np.testing.assert_allclose(t.keep_only(["c"]).to_dense(), a.sum(axis=(0, 1)))
    np.testing.assert_allclose(t.slice(b=2).to_dense(), a[:, 2])
    np.testing.assert_allclose(t.slice(b=slice(1, 4, 2), c=[4, 0]).to_dense(), a[:, 1:4:2][:, :, [4, 0]])
    np.testing.assert_allclose(t.transpose("cab").to_dense(), a.transpose(2, 0, 1))
    np.testing.assert_allclose(t.where(a=[0, 2]).to_dense(), a * np.array([1, 0, 1])[:, None, None])
    np.testing.assert_allclose(t.indicator().to_dense(), (a != 0).astype(float))
    np.testing.assert_allclose(t.count_distinct("b", ["a"]).to_dense(), ((a != 0).any(axis=2)).sum(axis=1))
    assert t.nnz() == np.count_nonzero(a) and t.fill_factor() == pytest.approx(np.count_nonzero(a) / a.size)
    with pytest.raises(KeyError):
        t.reduce(["z"])
    with pytest.raises(ValueError):
        t.reduce(["a"], "median")


def test_elementwise(spark, draw):
    a, b, v = sparse(draw, (3, 4)), sparse(draw, (3, 4)), sparse(draw, (4,))
    ta, tb, tv = Tensor.from_dense(spark, a, "ab"), Tensor.from_dense(spark, b, "ab"), Tensor.from_dense(spark, v, "b")
    np.testing.assert_allclose((ta + tb).to_dense(), a + b)
    np.testing.assert_allclose((ta - tv).to_dense(), a - v)
    np.testing.assert_allclose((ta * tv).to_dense(), a * v)
    np.testing.assert_allclose((ta / tb).to_dense(), np.divide(a, b, out=np.zeros_like(a), where=b != 0))
    np.testing.assert_allclose((ta + 1.5).to_dense(), a + 1.5)
    np.testing.assert_allclose((ta / 0.0).to_dense(), 0 * a)


def test_trace_windows_and_rollups(spark, draw):
    a = sparse(draw, (4, 4, 3))
    t = Tensor.from_dense(spark, a, "xyz")
    np.testing.assert_allclose(t.trace("x", "y").to_dense(), np.einsum("iik->k", a))
    np.testing.assert_allclose(t.running("x").to_dense(), a.cumsum(axis=0))
    np.testing.assert_allclose(t.running("x", 1).to_dense(), a + np.vstack([np.zeros((1, 4, 3)), a[:-1]]))
    w = draw.random((4, 4))
    np.testing.assert_allclose(t.weighted_window("x", w).to_dense(), np.einsum("fyz,ft->tyz", a, w))
    up = t.rollup("x", "p", {0: 0, 1: 0, 2: 1, 3: 1})
    np.testing.assert_allclose(up.to_dense(), np.stack([a[:2].sum(axis=0), a[2:].sum(axis=0)]))


RINGS = {
    "max-prod": (np.max, np.multiply), "min-prod": (np.min, np.multiply), "max-plus": (np.max, np.add), "min-plus": (np.min, np.add), "bool-or-and": (np.max, np.minimum), "sum-prod": (np.sum, np.multiply),
}


@pytest.mark.parametrize("ring", RINGS)
def test_semirings(spark, draw, ring):
    gather, pair = RINGS[ring]
    a, b = draw.integers(1, 6, (3, 4)).astype(float), draw.integers(1, 6, (4, 2)).astype(float)
    if ring == "bool-or-and":
        a, b = (a > 3).astype(float), (b > 3).astype(float)
    want = gather(pair(a[:, :, None], b[None]), axis=1)
    got = Tensor.from_dense(spark, a, "xk", keep_zeros=True).product(Tensor.from_dense(spark, b, "ky", keep_zeros=True), ring=ring, check=True)
    np.testing.assert_allclose(got.to_dense(), want)


def test_domains_are_checked(spark):
    t = Tensor.from_dense(spark, [2.0, 3.0, -1.0], "k")
    with pytest.raises(ValueError):
        t.product(t, ring="max-prod", check=True)
    with pytest.raises(KeyError):
        t.product(t, ring="none")


def test_shortest_paths_and_walks(spark):
    edges = [(0, 1, 3.0), (1, 2, 4.0), (0, 2, 9.0), (2, 3, 1.0), (3, 0, 2.0)]
    t = Tensor(spark.createDataFrame(edges, "a long, b long, value double"), "ab")
    got = {(r["a"], r["b"]): r["value"] for r in t.closure("min-plus", 2).df.collect()}
    assert got[0, 2] == 7.0 and got[0, 3] == 8.0 and got[3, 1] == 5.0 and got[1, 0] == 7.0
    g = (np.arange(100).reshape(10, 10) % 7 == 1).astype(float)
    walks = Tensor.from_dense(spark, g, "ab").walks(3)
    want = [w for w in itertools.product(range(10), repeat=4) if all(g[x, y] for x, y in zip(w, w[1:]))]
    assert sorted(tuple(r[f"v{i}"] for i in range(4)) for r in walks.collect()) == want


def test_duplicates_add_up(spark):
    t = Tensor(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 5.0), (1, 0, 0.0)], "a long, b long, value double"), "ab", {"a": 2, "b": 2})
    np.testing.assert_allclose(t.coalesce().to_dense(), [[3, 0], [0, 5]])
    assert t.coalesce().df.count() == 2
    empty = Tensor.from_dense(spark, np.zeros((3, 4)), "ab")
    np.testing.assert_allclose(empty.product(Tensor.from_dense(spark, np.ones((4, 2)), "bc")).to_dense(), np.zeros((3, 2)))


def test_suppression(spark):
    df = suppressed(spark.createDataFrame([(10.0, 1), (20.0, 5), (30.0, 100)], "v double, n long"), "v", "n")
    assert [r["v"] for r in df.orderBy("n").collect()] == [None, 20.0, 30.0]


def test_signature():
    assert len(SIGNATURE["operations"]) == 9 and len(SIGNATURE["laws"]) == 13 and "product" in describe_signature()


def test_loading_is_additive(spark):
    from cellgrain import Engine

    rows = [(i % 4, i % 3, float(i)) for i in range(35)]
    cubes = []
    for part in (rows[:20], rows[20:], rows):
        c = Engine(spark).load_frame(spark.createDataFrame(part, "a long, b long, v double"), ["a", "b"], "v", "cube")
        cubes.append(Tensor(c.cells, c.dims, {"a": 4, "b": 3}).to_dense())
    np.testing.assert_allclose(cubes[0] + cubes[1], cubes[2])
