"""Windows of fragments whose taxa are on one way, without Spark."""

import random

import numpy as np

from cladeforge.functions.alphabet import Scheme
from cladeforge.operators import bracken, minimizers

WAY = [1, 11, 101, 1111, 10001]


def test_one_way_gives_what_the_sweep_gives():
    rng = random.Random(5)
    for scheme in (Scheme(9, 5, 0), Scheme(40, 35, 0)):
        for case in range(40):
            text = "".join(rng.choice("ACGT" if rng.random() < 0.97 else "N") for _ in range(rng.choice([30, 90, 300]))).encode()
            s = minimizers.supermers([text], scheme)
            ok = s["flag"] == 1
            kinds = np.unique(s["minimizer"][ok])
            taxa = np.array([rng.choice([0, *WAY[: 1 + case % 5]]) for _ in kinds], np.int32)
            known = taxa > 0
            ids = s["words"][kinds] if scheme.wide else kinds
            taxa_of = bracken.lookup(ids[known], taxa[known], scheme)
            ways = bracken.Ways({t: WAY[: WAY.index(t) + 1] for t in set(taxa[known].tolist())})
            assert ways.chain is not None
            for length in (scheme.k - 1, scheme.k, scheme.k + 6, 80):
                found = bracken.simulated(text, taxa_of, ways, scheme, length)
                chain, ways.chain = ways.chain, None
                assert found == bracken.simulated(text, taxa_of, ways, scheme, length)
                ways.chain = chain


def test_taxa_aside_are_swept():
    assert bracken.Ways({11: [1, 11], 12: [1, 12]}).chain is None
    assert bracken.Ways({}).chain == []
