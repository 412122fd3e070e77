"""Training looks at every word of a text, once."""

import numpy as np
import pytest

from breakwater.llm import pseudo


@pytest.mark.parametrize("n", [0, 1, 2, 3, 2 * pseudo.BATCH, 2 * pseudo.BATCH + 1, 5 * pseudo.BATCH + 3])
def test_every_word_is_masked_once(n):
    seen = [np.arange(n)[s] for s in pseudo.steps(n)]
    assert all(len(s) for s in seen) and sorted(np.concatenate([np.zeros(0, int), *seen]).tolist()) == list(range(n))
