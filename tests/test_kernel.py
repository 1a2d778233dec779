"""Kernel sums, votes and nearest vectors against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sulatan.operators import kernel as K

GAMMA = 0.3
SV, VEC = "sv_id long, class int, vec array<double>", "vec_id long, vec array<double>"


def _clusters(rng, n, centres, spread=0.2):
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, centres.shape[1])) * spread


@pytest.fixture(scope="module")
def data(spark):
    """Clustered points, repeated vectors (ties), and a cluster with a third of all vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 5
    s, x = _clusters(rng, 700, centres), _clusters(rng, 500, centres)
    s[50:60] = s[40]
    x[:170] = centres[0] + rng.normal(size=(170, 6)) * 0.1
    x[200] = s[40]
    sv = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(s)], SV).repartition(3).cache()
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], VEC).repartition(5).cache()
    k = np.exp(-GAMMA * ((x[:, None, :] - s[None, :, :]) ** 2).sum(-1))
    return sv, vecs, k


SIZES = [{"max_bytes": 1 << 30}, {"max_bytes": 0}, {"max_bytes": 0, "block": 7, "batch": 5}]


@pytest.mark.parametrize("sizes", SIZES)
def test_kernel_similarity_has_every_pair(data, sizes):
    sv, vecs, k = data
    out = K.kernel_similarity(vecs, sv, GAMMA, **sizes)
    assert dict(out.dtypes)["class"] == "int"
    got = {(r["vec_id"], r["sv_id"]): (r["class"], r["k"]) for r in out.collect()}
    assert len(got) == k.size
    assert all(c == s % 4 and np.isclose(value, k[v, s], atol=1e-9) for (v, s), (c, value) in got.items())


@pytest.mark.parametrize("sizes", SIZES)
def test_class_similarity(data, sizes):
    sv, vecs, k = data
    got = {(r["vec_id"], r["class"]): (r["n"], r["k_sum"], r["k_max"]) for r in K.class_similarity(vecs, sv, GAMMA, **sizes).collect()}
    assert len(got) == k.shape[0] * 4
    for (i, c), (n, total, most) in got.items():
        own = k[i, c::4]
        assert n == len(own) and np.isclose(total, own.sum(), atol=1e-9) and np.isclose(most, own.max(), atol=1e-9)


@pytest.mark.parametrize("sizes", SIZES)
def test_pair_decisions(spark, data, sizes):
    sv, vecs, k = data
    pairs = [(p, i, j, 0.1 * p, -1.0, 0.0) for p, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1, 4))]
    pair = spark.createDataFrame(pairs, "pair_id int, i int, j int, intercept double, prob_a double, prob_b double")
    coef = sv.join(pair, (F.col("class") == F.col("i")) | (F.col("class") == F.col("j")))
    coef = coef.select("sv_id", "pair_id", F.when(F.col("class") == F.col("i"), 0.5 + F.col("sv_id") / 1000).otherwise(-0.7).alias("coef"))
    got = {(r["vec_id"], r["pair_id"]): r["decision"] for r in K.pair_decisions(vecs, sv, coef, pair, GAMMA, **sizes).collect()}
    n = np.arange(k.shape[1])
    for p, i, j, intercept, _, _ in pairs:
        w = np.where(n % 4 == i, 0.5 + n / 1000, np.where(n % 4 == j, -0.7, 0.0))
        want = k @ w + intercept
        assert np.allclose([got[(v, p)] for v in range(k.shape[0])], want, atol=1e-9)
    assert len(got) == k.shape[0] * len(pairs)


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("k_best", [1, 5])
def test_nearest_takes_few_distances(spark, data, sizes, k_best):
    """Same neighbours as sorting all of them; on clusters far fewer distances than pairs."""
    sv, vecs, k = data
    counter = spark.sparkContext.accumulator(0)
    rows = K.nearest_vectors(vecs, sv, GAMMA, k_best, counter=counter, **sizes).collect()
    got = {(r["vec_id"], r["rank"]): (r["sv_id"], r["class"], r["k"]) for r in rows}
    assert len(got) == k.shape[0] * k_best
    for i in range(k.shape[0]):
        order = np.lexsort((np.arange(k.shape[1]), -np.round(k[i], 12)))[:k_best]
        mine = [got[(i, r + 1)] for r in range(k_best)]
        assert np.allclose([m[2] for m in mine], k[i][order], atol=1e-9)
        assert all(m[1] == m[0] % 4 and np.isclose(k[i][m[0]], m[2], atol=1e-9) for m in mine)
    print("distances", counter.value / k.size)
    assert counter.value < 0.35 * k.size


def test_no_structure_is_still_exact(spark):
    """Random directions rule nothing out; the result does not depend on it."""
    rng = np.random.default_rng(5)
    s, x = rng.normal(size=(90, 20)), rng.normal(size=(60, 20))
    sv = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(s)], SV)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    got = {(r["vec_id"], r["rank"]): r["sv_id"] for r in K.nearest_vectors(vecs, sv, 0.05).collect()}
    d = ((x[:, None] - s[None]) ** 2).sum(-1)
    assert got == {(i, r + 1): int(j) for i in range(60) for r, j in enumerate(np.argsort(d[i])[:5])}


def test_small_models_and_empty_tables(spark, data):
    sv, vecs, _ = data
    few = spark.createDataFrame([(1, 2, [0.0] * 6), (2, 3, [1.0] * 6)], SV)
    assert K.nearest_vectors(vecs, few, GAMMA).count() == 2 * 500
    assert K.nearest_vectors(vecs, few.limit(0), GAMMA).collect() == []
    assert K.nearest_vectors(vecs.limit(0), sv, GAMMA).collect() == []
    assert K.class_similarity(vecs, few.limit(0), GAMMA).collect() == []
    assert K.class_similarity(vecs.limit(0), sv, GAMMA).collect() == []


def test_familiarity_is_best_or_mean_of_five(data):
    sv, vecs, k = data
    top = -np.sort(-k, axis=1)
    for score, want in (("sim1", top[:, 0]), ("sim5", top[:, :5].mean(axis=1))):
        got = {r["vec_id"]: r["familiarity"] for r in K.familiarity(vecs, sv, GAMMA, score).collect()}
        assert np.allclose([got[i] for i in range(len(want))], want, atol=1e-9)


@pytest.mark.parametrize("mode,want", [
    ("drop", {1: ("abc", 0, "known"), 2: ("a", 2, "known"), 4: ("q", 0, "known")}),
    ("mark", {1: ("abc", 0, "known"), 2: ("a??", 2, "unknown_letters"), 3: ("??", 2, "unknown_letters"), 4: ("q", 0, "known"), 5: ("?", 1, "unknown_letters")}),
])
def test_letters_of_words(spark, mode, want):
    """A dictionary word keeps all letters; a word of one letter is no such word; null familiarity rejects nothing."""
    rows = [(1, 0, "a", .1), (1, 1, "b", .9), (1, 2, "c", .1), (2, 0, "a", .9), (2, 1, "b", .1), (2, 2, "x", .1), (3, 1, "y", .2), (3, 0, "x", .2), (4, 0, "q", None), (5, 0, "o", .1)]
    letters = spark.createDataFrame(rows, "w int, pos int, char string, familiarity double")
    known = spark.createDataFrame([("abc",), ("o",)], "word string")
    got = {r["w"]: (r["word_out"], r["n_rejected"], r["status"]) for r in K.reject_in_words(letters, ["w"], known, 0.5, mode).collect()}
    assert got == want
    free = K.reject_in_words(letters, ["w"], None, None, mode).collect()
    assert len(free) == 5 and not any(r["n_rejected"] for r in free)
