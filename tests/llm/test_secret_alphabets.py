"""Random strings of one case, and behind the readable words of a path."""

import random
import string

import public_tokenizers
import pytest

from quarry.llm import secret_scan

ALPHABETS = [string.ascii_lowercase, string.ascii_uppercase, string.ascii_uppercase + "234567", string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("before", ["", "https://example.com/download/files/"])
def test_random_alphabets(alphabet, before):
    path, rng, hits = public_tokenizers.path(secret_scan.VOCABULARY), random.Random(5), 0
    for _ in range(100):
        key = "".join(rng.choices(alphabet, k=32))
        found = secret_scan.spans(f"see {before}{key} end".encode(), path)[1]
        hits += any(k == "random" and s <= 6 + len(before) and e >= 2 + len(before) + len(key) for s, e, k in found)
    assert hits >= 97
