"""Operator 7: a text of two languages isn't given to a third."""

import numpy as np

from weftgraph.llm import language_id


def test_two_stretches_share_one_switch():
    labeller = language_id.Labeller(language_id.Model(("a", "b", "c"), {}, np.zeros((1, 3), np.float32), {}), 12.0)
    labeller.scores = np.array([(-2.9, 0, -6), (-2.9, -6, 0)], dtype=np.float32)
    assert labeller.path(np.array([0] * 4 + [1] * 4)).tolist() == [1] * 4 + [2] * 4
