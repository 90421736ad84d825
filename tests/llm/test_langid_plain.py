"""Language labels against a sum over all labelings."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import langid
from waymark.llm.base import Words


def every_labeling(em, crf):
    """Label marginals [words, labels] and expected transitions, by the weight of each of the labels**words sequences."""
    n, k = em.shape
    total, marginal, pairs = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for labels in itertools.product(range(k), repeat=n):
        weight = math.exp(crf.start[labels[0]] + sum(em[i, y] for i, y in enumerate(labels)) + sum(crf.trans[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        for i, y in enumerate(labels):
            marginal[i, y] += weight
        for a, b in zip(labels, labels[1:]):
            pairs[a, b] += weight
    return marginal / total, pairs / total


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_messages_equal_the_sum_over_labelings(n):
    rng = np.random.default_rng(n)
    crf = langid.Crf(["a", "b", "c"], np.zeros((4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    em = rng.normal(scale=2, size=(n, 3))
    want, pairs = every_labeling(em, crf)
    got, both = langid.marginals(em[None], np.ones((1, n), bool), crf, with_pairs=True)
    assert np.abs(got[0] - want).max() < 1e-9 and np.abs(both - pairs).max() < 1e-9
    shares = langid.label_shares(em, np.array([n]), crf)
    assert np.abs(shares[0] - want.sum(0)).max() < 1e-4 * n


def test_predictions_equal_the_sum_over_labelings():
    texts = [("the house and the tree of it", "en"), ("das haus und der baum von ihm", "de"), ("la casa y el arbol de ella", "es")] * 8
    crf = langid.fit(texts, bits=12, epochs=4)
    seen = ["the house", "das haus and the tree", "la casa und el baum", "The TREE of", "y", "xyz quux", "arbol, (haus)"]
    col = pa.array(seen, pa.large_string())
    labels, scores = langid.predict(col, crf)
    for text, label, score in zip(seen, labels, scores):
        w = Words(pa.array([text], pa.large_string()), lower=True)
        em = langid.emissions(w, np.arange(len(w.hash)), crf.weights)
        marginal, _ = every_labeling(em, crf)
        assert label == crf.labels[int(marginal.sum(0).argmax())]
        assert abs(score - marginal.mean(0).max()) < 1e-3, (text, score, marginal.mean(0))
    assert labels[0] == "en" and labels[4] == "es"


def test_learning_follows_the_gradient_of_the_log_likelihood():
    # One sequence, one step: the transitions' first AdaGrad step has the sign of observed less expected counts.
    texts = [("uno dos tres", "x"), ("one two three", "y")]
    crf = langid.fit(texts, bits=8, epochs=1)
    assert crf.trans[0, 0] > crf.trans[0, 1] and crf.trans[1, 1] > crf.trans[1, 0]
