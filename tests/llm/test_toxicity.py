"""The false-discovery bound: rare kinds of abuse are learnt, chance is not."""

import random

from leasegrain.llm import toxicity
from tests.llm.conftest import prose


def test_a_rare_kind_of_abuse_is_learnt():
    r = random.Random(2)
    rows = [(prose(k, 40), 0) for k in range(1500)]
    rows += [(prose(5000 + k, 40) + " gruntle" + r.choice(["", " extra"]), 1) for k in range(200)]
    rows += [(prose(8000 + k, 40) + " zwackelmann", 1) for k in range(20)]  # one toxic text in eleven
    model, told = toxicity.fit(rows, 0.1)
    assert model.score(prose(1, 30) + " zwackelmann") >= 0.5 and model.score(prose(2, 30) + " gruntle") >= 0.5
    assert max(model.score(prose(9000 + k, 40)) for k in range(200)) < 0.5


def test_chance_is_not_taken_for_evidence():
    import numpy as np

    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 3000, 40)) for _ in range(2000)]
    chosen, _ = toxicity.telling(rows, (r.random(2000) < 0.1).astype(float), toxicity.SUPPORT)
    assert len(chosen) <= 1
    marked = [np.union1d(x, [5000]) if k < 25 else x for k, x in enumerate(rows)]
    chosen, odds = toxicity.telling(marked, (np.arange(2000) < 200).astype(float), toxicity.SUPPORT)
    assert chosen.tolist() == [5000] and odds[0] > 3
