"""Terms of the toxicity model."""

import numpy as np

from corollary.llm import toxicity


def test_terms_that_tell_only_together_are_held():
    """Label 1 is both terms or neither; alone, each is as frequent in either class."""
    rng = np.random.default_rng(2)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    labels = (a == b).astype(np.int64)
    lists = [[*([10] if x else []), *([20] if y else []), *(100 + rng.choice(50, 5, replace=False)).tolist()] for x, y in zip(a, b)]
    doc, term = np.repeat(np.arange(3000), [len(t) for t in lists]), np.concatenate(lists)
    model = toxicity.fit(labels[:2000], doc[doc < 2000], term[doc < 2000])
    assert model.slot[10] >= 0 and model.slot[20] >= 0
    late = (doc >= 2000) & (model.slot[term] >= 0)
    p = model.logit(1000, doc[late] - 2000, model.slot[term[late]]) > 0
    assert (p == labels[2000:]).mean() > 0.9
