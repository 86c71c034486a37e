"""What the fit of the nearest search holds in the driver."""

import tracemalloc

import numpy as np

from gaugeline.llm import ann


def _peak(fn) -> float:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_the_driver_holds_parts_of_the_sample():
    """Before: distances of all the sample's vectors at once, 86 MB in the first."""
    x = np.random.default_rng(1).normal(size=(8000, 64))
    top = float(np.sqrt((x * x).sum(1)).max())
    lifted = ann.lift(x, top)
    assert _peak(lambda: ann.balanced_kmeans(lifted, 600)) < 60
    graph = ann.Graph.of(lifted[::40])
    assert _peak(lambda: ann.ratio_of(x, top, graph, 20)) < 150
