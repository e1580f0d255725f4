import numpy as np
import pytest

from parley.llm import fingerprints


@pytest.mark.parametrize(("n", "shared"), [(50000, 0), (200000, 0), (200000, 0.5)])
def test_long_texts(n, shared):
    """The collision rate of long texts is their similarity, too: n word pairs each, a share of them in common."""
    words = [f"{n}w{i}" for i in range(2 * n + 2)]
    both = int(n * shared)
    a, b = " ".join(words[: n + 1]), " ".join(words[n - both : 2 * n + 1 - both])
    got = fingerprints.alike(*fingerprints.signatures([a, b]))
    want = both / (2 * n - both)
    assert abs(got - want) <= 0.05 + 3 * (want * (1 - want) / fingerprints.SAMPLES) ** 0.5


def test_draws():
    """Gamma(2, 1) and uniform, without ties between neighbouring terms or samples."""
    r, c, beta = fingerprints.draws(np.arange(20000))
    for x in (r, np.exp(c)):
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.05
    assert abs(beta.mean() - 0.5) < 0.005 and abs(beta.var() - 1 / 12) < 0.005
    assert np.abs(np.corrcoef(np.stack([r[:, 0], r[:, 1], c[:, 0], c[:, 1], beta[:, 0], beta[:, 1], r[:, 63]])) - np.eye(7)).max() < 0.04
