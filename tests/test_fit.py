"""Fits on mixed signals: invariants, recovery up to sign and order, storage."""

import numpy as np
import pytest

from brindle.operators.dictionaries import Dictionary, oriented, reconstruction_curve, split_sign_dictionary
from brindle.plans import fastica
from brindle.plans.lens import Lens


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(7)
    s = np.stack([rng.laplace(size=800), rng.uniform(-2, 2, 800), rng.standard_t(3, 800)], axis=1)
    a = np.array([[1, 0.4, -0.2], [0.2, 1.1, 0.5], [-0.4, 0.3, 0.9]])
    return s, s @ a.T


@pytest.fixture(scope="module")
def rows(spark, mixed):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(mixed[1])], "row_id bigint, vec array<double>").repartition(5).cache()


def test_recovers_sources(rows, mixed):
    f = fastica.fit_fastica(rows, 3, l2=False, max_iter=60)
    got = (mixed[1] - f.center) @ f.reading.T
    c = np.abs(np.corrcoef(got.T, mixed[0].T)[:3, 3:])
    assert (c.max(axis=1) > 0.98).all() and sorted(c.argmax(axis=1)) == [0, 1, 2]
    assert (np.diff(f.strengths) <= 1e-12).all()
    assert np.allclose(f.unmixing @ f.unmixing.T, np.eye(3), atol=1e-8)
    assert np.allclose(f.strengths, np.abs(f.objectives - fastica.GAUSSIAN["logcosh"]))


def test_partitioning_does_not_matter(rows):
    a, b = (fastica.fit_fastica(rows.repartition(k), 3, l2=False, max_iter=20) for k in (1, 7))
    assert np.allclose(a.reading, b.reading, atol=1e-6)


def test_deflation_and_history(rows):
    f = fastica.fit_fastica(rows, 2, l2=False, algorithm="deflation", max_iter=8)
    assert np.allclose(f.unmixing @ f.unmixing.T, np.eye(2), atol=1e-9)
    seen = []
    f = fastica.fit_fastica(rows, 2, l2=False, max_iter=8, objective_every=3, held_out=rows, held_out_every=4, checkpoint=lambda i, w, k, c: seen.append(i))
    assert [h["iteration"] for h in f.history] == [3, 6, 8] and all(len(h["percentiles"]) == 11 for h in f.history)
    assert [h["iteration"] for h in f.held_out] == [4, 8] and seen == list(range(1, 9))
    assert np.allclose(f.held_out[0]["train"], f.held_out[0]["held_out"])


def test_too_many_components_and_low_rank(spark, rows):
    with pytest.raises(ValueError, match="between 1 and"):
        fastica.fit_fastica(rows, 4)
    flat = spark.createDataFrame([([float(i), 2.0 * i],) for i in range(10)], "vec array<double>")
    with pytest.raises(ValueError, match="rank"):
        fastica.fit_fastica(flat, 2, l2=False)


def test_geometric_median(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([0.0, 1.0],), ([100.0, 100.0],)], "vec array<double>")
    m = fastica.geometric_median(df, steps=200)
    assert np.linalg.norm(m) < 1.0


def test_lens_round_trip(spark, rows, mixed, tmp_path):
    lens = Lens.fit(rows, 3, l2=True, max_iter=20, provenance={"model": "toy"})
    back = lens.inverse_transform(lens.transform(rows, 0), 0).orderBy("row_id").toPandas()
    want = mixed[1] / np.linalg.norm(mixed[1], axis=1, keepdims=True)
    assert np.allclose(np.stack(back["restored"]), want, atol=2e-5)
    lens.save(spark, str(tmp_path / "lens"))
    again = Lens.load(spark, str(tmp_path / "lens"))
    assert np.allclose(again.layers[0].reading, lens.layers[0].reading) and again.provenance == {"model": "toy"}
    with pytest.raises(ValueError, match="model"):
        Lens.fit(rows, 3, lens=again, provenance={"model": "other"})
    edited = again.clamp(rows, 0, {0: 0.5}).toPandas()
    assert np.allclose(np.linalg.norm(np.stack(edited["edited"]), axis=1), np.linalg.norm(np.stack(edited["vec"]), axis=1))
    steered = again.steer(rows, 0, {1: 2.0}, cap={1: 0.0}).toPandas()
    assert np.isfinite(np.stack(steered["edited"])).all()


def test_reconstruction(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([-3.0, 4.0],)], "vec array<double>")
    got = {r["k"]: r for r in reconstruction_curve(df, Dictionary(np.eye(2), np.eye(2)), [1, 2]).collect()}
    assert got[2]["nmse"] == pytest.approx(0) and got[2]["cosine"] == pytest.approx(1) and got[1]["nmse"] > 0


def test_dictionaries():
    rng = np.random.default_rng(1)
    r = rng.standard_normal((4, 4))
    w, x = np.linalg.inv(r), rng.standard_normal((6, 4))
    d = split_sign_dictionary(r, w, x.mean(axis=0))
    assert np.allclose(d.decode(d.encode(x)), x) and (d.encode(x) >= 0).all()
    o = oriented(r, w, np.array([1, -1, 1, 1]))
    assert np.allclose(np.linalg.norm(o.decoder, axis=1), 1)
