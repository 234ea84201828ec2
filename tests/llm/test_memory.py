"""What kernels and workers hold of memory."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from brindle.llm import common
from brindle.llm.suffix_arrays import suffix_array


def test_suffix_arrays_hold_few_bytes_for_each_of_the_text():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(3000)]
    t = b" ".join(words[i] for i in rng.integers(0, 3000, 60_000))
    suffix_array(t, 50)
    tracemalloc.start()
    order = suffix_array(t, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(t)
    assert all(t[a : a + 50] <= t[b : b + 50] for a, b in zip(order.tolist(), order[1:].tolist()))


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's own figures")
def test_freed_memory_goes_back_to_the_system():
    own = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
    held = [np.ones(60_000, np.uint8) for _ in range(1000)]
    pins = held[::100]
    full = own()
    del held
    common.give_back()
    assert own() < full - 40 and len(pins) == 10
