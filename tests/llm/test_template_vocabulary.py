"""What is known of a token is worked out once, whatever number of texts follow."""

import numpy as np
import xxhash

from lotwise.llm import templates as T


def test_facts_grow_with_new_tokens_only():
    known = T.Vocabulary()
    T._tokens(["Anna paid 5 Km to 7 bolts."], known)
    before = known.facts()
    assert known.facts()[1] is before[1]
    T._tokens(["Anna paid again, twice"], known)
    kinds, hashes, units = known.facts()
    assert len(kinds) == len(hashes) == len(units) == len(known) > len(before[0])
    for token, at in known.items():
        assert hashes[at] == np.uint64(xxhash.xxh3_64_intdigest(token.lower().encode()))
        assert units[at] == (token.lower() in T.UNITS)
    assert [kinds[known[t]] for t in ("Anna", "5", "paid")] == [T.NAME, T.NUMBER, 0]
