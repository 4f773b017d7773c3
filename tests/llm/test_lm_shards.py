import numpy as np

from lodeframe.llm import lm


def test_keys_are_dealt_to_the_shards_that_they_have():
    rng = np.random.default_rng(2)
    for n, shards in ((0, 5), (1, 1), (300, 7), (300, 10**9)):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        parts = list(lm._dealt(keys, np.arange(len(keys)), shards))
        assert [k for k, *_ in parts] == sorted({int(x) % shards for x in keys})
        assert sorted(int(x) for _, part, _ in parts for x in part) == keys.tolist()
        assert all((np.diff(part.astype(object)) > 0).all() and (part % np.uint64(shards) == k).all() and (keys[counts] == part).all() for k, part, counts in parts)
