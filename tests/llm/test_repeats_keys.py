"""The keys of operator 7 spread evenly over the shards they are cut into."""

import random

import numpy as np
import pyarrow as pa

from vacantia.llm import repeats


def test_keys_are_even_over_shards():
    rng = random.Random(2)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(8)]
    keys = np.unique(repeats.window_keys(pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": text})))
    shares = np.bincount((keys >> np.uint64(61)).astype(int), minlength=8) / len(keys)
    assert len(keys) > 1000 and shares.max() < 0.25
