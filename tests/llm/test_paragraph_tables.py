"""Shingle sets of many paragraphs at once equal those of each."""

import numpy as np
import pytest

from strandline.llm import jaccard, repeats
from tests.llm.test_operators import corpus


@pytest.mark.parametrize("width", [1, 5])
def test_tables_equal_single_sets(width):
    parts = [t for t in corpus(3, 80) if t and len(t.split()) >= width]
    parts += ["x " * 3000, "É é  \t a b c d e f", " lead and trail words here now ", "Ⅷ a\x00b c d e f g" * 5]
    rule = jaccard.Threshold(8, 10)
    for some in (parts, parts[:1], parts + ["too short"]):
        flat, sizes = repeats.shingle_table(some, width)
        own = np.split(flat, np.cumsum(sizes)[:-1])
        want = [jaccard.shingles(p, width) for p in some]
        assert all(np.array_equal(a, b) for a, b in zip(own, want))
        assert repeats.names_of(flat, sizes).tolist() == [jaccard.name(w) for w in want]
        assert repeats.sketches_of(flat, sizes, rule) == [jaccard.sketch(w, rule) for w in want]
