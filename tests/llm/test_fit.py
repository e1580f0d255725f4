import random

from parley.llm import mixing


def words(lengths, take):
    return sum(a * b for a, b in zip(lengths, take, strict=True))


def test_few_long_documents():
    assert words([6000, 7000, 10000], mixing.fit([6000, 7000, 10000], [1, 2, 2], 20000)) == 20000
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(2000, 20000), rng.randint(1, 7)))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, words(lengths, counts))
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert words(lengths, take) == max(r for r in reach if r <= budget)
