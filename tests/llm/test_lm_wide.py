"""The Pitman-Yor model's messages: totals beyond 32 bits and words known by 64 bits."""

import numpy as np

from pairmatch.llm import lm
from pairmatch.llm.common import mix


def test_totals_beyond_32_bits():
    keys = mix(np.arange(1, 6, dtype=np.uint64))
    for top in (7, 5 << 32):
        want = np.array([1, 2, 3, 4, top])
        replies = [{"shard": s, "values": lm._pack(lm._narrow(want[None, p]))} for s, p, _ in lm._routes(keys, 2)]
        assert (lm._read(replies, keys, 1, 2)[0] == want).all()


def test_words_keep_all_bits():
    keys = mix(np.arange(1, 50, dtype=np.uint64))
    own = np.concatenate([lm._unpack_keys(m[3], 8) for m in lm._messages("words", 0, keys, [np.ones(49)], 3)])
    assert sorted(own.tolist()) == sorted(mix(keys).tolist())
