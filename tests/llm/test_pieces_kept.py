"""Units that are met again and again aren't built again when others are forgotten."""

import numpy as np
import public_tokenizers
from claimtrace.llm import pieces


def test_frequent_units_stay_and_draws_are_the_same(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    groups = [[f"the lattice of onlyre{i} and hation{i}, the pieces {i}"] for i in range(40)]
    kept, fresh, built = pieces.Lattices(pieces.Vocabulary(path, 1.0)), pieces.lattices(path, 1.0), []
    monkeypatch.setattr(pieces, "KEPT", 40)
    build = kept.build
    monkeypatch.setattr(kept, "build", lambda units: built.extend(units) or build(units))
    for i, texts in enumerate(groups):
        kept.forget()
        fresh.clear()
        one, other = (pieces.segmented(a, texts, [i], 4) for a in (kept, fresh))
        assert all(np.array_equal(x, y) for x, y in zip(one, other, strict=True))
    assert built.count(" the") == built.count(" lattice") == 1 and len(kept.number) < 60
