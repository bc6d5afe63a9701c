import random
import time

import pytest

from tapeloom.functions import alignment


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("strip", [1, 2, 7, 64, 1 << 14])
def test_distances_equal_the_plain_table(monkeypatch, strip):
    """With strips and bands far shorter than the sequences, too."""
    monkeypatch.setattr(alignment, "STRIP", strip)
    rnd = random.Random(strip)
    for _ in range(250):
        a = [rnd.randrange(rnd.choice([2, 5, 50])) for _ in range(rnd.randrange(40))]
        b = list(a) if rnd.random() < 0.6 else [rnd.randrange(6) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(3)] = [rnd.randrange(6) for _ in range(rnd.randrange(4))]
        assert alignment.distance(a, b) == plain(a, b), (a, b)


def test_long_texts_take_seconds():
    rnd = random.Random(1)
    a = [rnd.randrange(20_000) for _ in range(100_000)]
    b = list(a)
    for _ in range(500):
        b[rnd.randrange(len(b))] = -1
    began = time.perf_counter()
    near = alignment.distance(a, b)
    assert 480 < near <= 500
    far = alignment.distance(a, [rnd.randrange(20_000) for _ in range(100_000)])
    assert 90_000 < far <= 100_000
    assert time.perf_counter() - began < 60
