import numpy as np

from webwarden.functions import vectors as v


def test_signature_similarity():
    sig = lambda *xs: [((c, 0, 0, 0), (x, 0.0), 1) for c, x in xs]
    image = np.random.default_rng(0).integers(0, 256, (100, 100, 4))
    assert v.signature_similarity(v.colour_signature(image), v.colour_signature(image)) == (1.0, True)
    assert v.signature_similarity([], sig((1, 0.0))) == (0.0, False)
    # 0.5 * 2/10 + 0.5 * 10/100 = 0.15, halved; 0.5 * 10/10 = 0.5, doubled
    assert v.signature_similarity(sig((10, 0.0)), sig((8, 10.0))) == (0.925, False)
    assert v.signature_similarity(sig((10, 0.0)), sig((0, 0.0))) == (0.0, False)
    # the first row takes the nearest, the second what is left: (0 + 0.5 * 10/10) / 2 = 0.25, halved
    assert v.signature_similarity(sig((5, 0.0), (0, 0.0)), sig((5, 0.0), (10, 0.0))) == (0.875, False)


def test_signature_order():
    a = np.zeros((2, 2, 4), int)
    a[0, 1], a[1, 0] = 1, 2
    assert [(c[0], xy, n) for c, xy, n in v.colour_signature(a)] == [(0, (0.5, 0.5), 2), (2, (0.0, 1.0), 1), (1, (1.0, 0.0), 1)]
