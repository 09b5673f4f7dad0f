"""What stays in a Python worker after its task."""

import tracemalloc

import numpy as np

from loomgraph.llm import packing, tokens, toxicity


def test_packing_keeps_little():
    import public_tokenizers

    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), packing.KEPT)
    assert e.most == packing.KEPT and sum(x.nbytes for x in (e.place.keys, e.place.values, e.start, e.size)) < 24 << 20


def test_odds_are_written_over_what_they_are_made_of():
    first = np.arange(0, 1_000_001, 100)
    step, u = np.array([[0.5, -1.0], [0.0, 1.0]]), np.linspace(-60, 60, 1_000_000)
    p, pairs = toxicity.pair_marginals(u.copy(), first, step)
    tracemalloc.start()
    got, total = toxicity._summed(u, first, step)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, p) and np.allclose(total, pairs.sum(axis=0))
    assert peak < 2.9 * u.nbytes + 12 * 8 * toxicity.PAIRS, peak / u.nbytes
