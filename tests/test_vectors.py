"""The default embedder against a plain one."""

import hashlib
import re
import time

import numpy as np

from tallybook.functions.vectors import hashed_tokens


def plain(texts, dim=64):
    out, buckets = np.zeros((len(texts), dim), dtype=np.float32), {}
    for row, text in enumerate(texts):
        for token in re.findall(r"[a-z0-9]+", (text or "").lower()):
            if token not in buckets:
                buckets[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            out[row, buckets[token]] += 1.0
    return out


def test_texts_of_a_batch_stay_apart():
    texts = [None, "", "a b\x00c", "İstanbul Kelvin ß A-a", "\ud800x", "x" * 50, "—₹ 9.50", "\n\t", "ς Σ end"]
    found = hashed_tokens(64)()
    for low in range(len(texts)):
        batch = texts[low:]
        assert np.array_equal(found(batch), plain(batch))
    assert found([]).shape == (0, 64)


def test_tokens_are_counted_together():
    """A batch must cost well below a loop over its tokens."""
    texts = [f"Groceries transaction on Saturday, March {i % 28} 2000: Weekly {i} — ₹{i}.50. Type: debit." for i in range(5000)]
    found = hashed_tokens(64)()

    def seconds(embed):
        taken = []
        for _ in range(5):
            start = time.process_time()
            embed(texts)
            taken.append(time.process_time() - start)
        return min(taken)

    assert seconds(found) < 0.7 * seconds(plain)
