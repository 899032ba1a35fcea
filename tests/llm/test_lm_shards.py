"""The Pitman-Yor model's shards: results do not depend on how the words are dealt."""

import numpy as np

from pairmatch.llm import lm
from pairmatch.llm.common import mix


def test_root_is_alike_in_every_shard():
    """A shard of some words seats them as the one shard of all words does, given the round before."""
    keys = mix(np.arange(1, 2001, dtype=np.uint64))
    customers = np.concatenate([np.full(1000, 3000), np.full(1000, 2)])
    totals = {"v": 2000, "rounds": 1, "tables": [2500, 2600]}
    whole = lm.root_tables(customers, keys, totals)
    for part in (slice(0, 1000), slice(1000, 2000)):
        assert (lm.root_tables(customers[part], keys[part], totals) == whole[part]).all()
