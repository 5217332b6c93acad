"""The language classifier is fitted on the driver: it unfolds its sample block by block."""

import tracemalloc

import numpy as np

from obslake.llm.language_id import Classifier


def test_the_fit_unfolds_a_block_at_a_time():
    n, dims = 1600, 1 << 15
    packed = np.random.default_rng(1).integers(0, 256, (n, dims // 8), np.uint8)
    tracemalloc.start()
    try:
        model = Classifier.fit(packed, ["de" if k % 2 else "en" for k in range(n)], 64, 0.1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (model.dims, model.landmarks.shape) == (dims, (64, dims))
    assert peak < n * dims * 4  # the features of the whole sample
