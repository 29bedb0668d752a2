"""Positive-unlabelled learning: the risk by its definition, the prior and the labels of made data, reproducible fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import classifier

DOC = "doc_id long, text string"


def mixture(prior, n=3000, seed=1, apart=4.0):
    rng = np.random.default_rng(seed)
    pos = rng.normal(0, 1, (n // 2, classifier.WIDTH)) * 0.3
    pos[:, :8] += apart / 8
    truth = rng.random(n) < prior
    unl = rng.normal(0, 1, (n, classifier.WIDTH)) * 0.3
    unl[:, :8] += np.where(truth, apart / 8, -apart / 8)[:, None]
    return pos, unl, truth


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_and_labels_of_made_data(prior):
    pos, unl, truth = mixture(prior)
    assert abs(classifier.estimated_prior(pos, unl) - prior) < 0.08
    m = classifier.fit(pos, unl, prior)
    assert np.mean((classifier.logits(m, unl) >= 0) == truth) > 0.95


def test_risk_equals_its_definition():
    """R = prior E_p[l(g)] + E_u[l(-g)] - prior E_p[l(-g)], with l(z) = 1 / (1 + e^z), summed text by text."""
    pos, unl, _ = mixture(0.4, 300)
    m = classifier.fit(pos, unl, 0.4)
    g = lambda x: float(np.tanh((x - m.mean) / m.scale @ m.w1 + m.b1) @ m.w2 + m.b2)
    loss = lambda z: 1 / (1 + np.exp(z))
    first = 0.4 * sum(loss(g(x)) for x in pos) / len(pos)
    second = sum(loss(-g(x)) for x in unl) / len(unl) - 0.4 * sum(loss(-g(x)) for x in pos) / len(pos)
    assert classifier.risk(m, pos, unl) == pytest.approx((first, second))


def test_fitting_lowers_the_risk_and_keeps_it_from_below_zero():
    pos, unl, _ = mixture(0.4, 600)
    m = classifier.fit(pos, unl, 0.4)
    before = sum(classifier.risk(m._replace(w2=np.zeros_like(m.w2), b2=0.0), pos, unl))
    first, second = classifier.risk(m, pos, unl)
    assert first + max(0, second) < 0.2 * before and second > -0.05


def test_repeated_ids_and_clashing_columns_give_the_same_fit(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(60)] + [(5, "another"), (5, "a third")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOC).withColumns({"score": F.lit(1), "x": F.lit(2), "_id": F.lit(3)})
    one, two = (classifier.score(d, classifier.train(d, labels)).collect() for d in (docs.repartition(1), docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert len(one) == 62 and sorted(one) == sorted(two)
