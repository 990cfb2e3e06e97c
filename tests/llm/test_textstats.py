from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm.textstats import repeated_words


def plain(words: list[bytes], width: int = 5) -> int:
    seen = Counter(tuple(words[k:k + width]) for k in range(len(words) - width + 1))
    covered = {k + j for k in range(len(words) - width + 1) if seen[tuple(words[k:k + width])] > 1 for j in range(width)}
    return len(covered)


@pytest.mark.parametrize("distinct", [3, 6_000, 100_000])
def test_repeated_words_of_large_vocabularies(distinct):
    r = np.random.default_rng(7)
    words = [b"%d" % x for x in range(distinct)] + [b"%d" % x for x in r.integers(0, distinct, 20_000)]
    words += words[50:90] + words[-30:]
    assert repeated_words(words) == plain(words) > 60


def test_windows_that_differ_by_a_power_of_two_stay_apart():
    # With 2^17 distinct words four numbers take 68 bits: first words 2^13 apart would fall out of a 64-bit key.
    base = [b"%d" % x for x in range(1 << 17)]
    words = base + [base[0], *base[1000:1004], base[1 << 13], *base[1000:1004]]
    assert repeated_words(words) == plain(words) == 0
