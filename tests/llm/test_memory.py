"""What a worker holds for a batch of texts."""

import tracemalloc

import numpy as np
import pandas as pd

from docgraph.llm import neardup, simhash


def test_words_of_one_text_at_a_time():
    """Shingle sets of a batch take little more than themselves: its words would be several times that."""
    texts = pd.Series([" ".join(f"w{(i * 7 + k) % 5000}" for k in range(300)) for i in range(1500)] + [None, ""])
    tracemalloc.start()
    got = neardup._sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, got["set"]))
    assert peak < 2 * size + (4 << 20)
    words = simhash.words_of(texts[3])
    assert got["whole"][3] == neardup._digest(words)
    assert got["set"][3] == np.unique(simhash.shingle_hashes(words, 5, 42)).tobytes()
    assert list(got["set"][-2:]) == [b"", b""]
