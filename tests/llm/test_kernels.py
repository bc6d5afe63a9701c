import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import kernels


def thue_morse(n=2048):
    """Two texts whose difference every polynomial hash modulo a power of two loses."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_span_hashes_follow_the_bytes_alone():
    rng = random.Random(1)
    spans = [bytes(rng.choice(b"ab") for _ in range(n)) for n in [*range(80), 300, 5000, 9 << 20] for _ in range(3 if n < 80 else 1)]
    order = list(range(len(spans))) * 2
    rng.shuffle(order)
    data, at = b"".join(spans[i] + b"x" * (k % 5) for k, i in enumerate(order)), 0
    starts = []
    for k, i in enumerate(order):
        starts.append(at)
        at += len(spans[i]) + k % 5
    starts = np.array(starts)
    ends = starts + np.array([len(spans[i]) for i in order])
    h = kernels.span_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends)
    by = {}
    for i, x in zip(order, h.tolist(), strict=True):
        assert by.setdefault(spans[i], x) == x
    assert len(set(by.values())) == len(by)
    a, b = kernels.eights(np.frombuffer(data, dtype=np.uint8)), kernels.eights(np.frombuffer(data[::-1], dtype=np.uint8))
    other = rng.sample(range(len(starts)), len(starts))
    want = [spans[order[i]] == spans[order[j]] for i, j in enumerate(other)]
    assert kernels.equal_spans(a, starts, ends, a, starts[other], ends[other]).tolist() == want
    assert not kernels.equal_spans(a, starts[:1], starts[:1] + 1, b, starts[:1], starts[:1] + 2)[0]


def test_words_and_windows_of_texts_that_cancel_out_differ():
    a, b = thue_morse()
    w = kernels.Words(pa.array([a, b, f"{a} {b} x", f"{b} {a} x"]), kernels.NON_SPACE, False)
    assert len(set(w.hashes.tolist())) == 3
    _, h = w.windows(3)
    assert len(h) == 2 and h[0] != h[1]


@pytest.mark.parametrize("length", range(1, 17))
def test_windows_are_equal_where_their_words_are(length):
    rng = random.Random(length)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    w = kernels.Words(pa.array(texts), kernels.NON_SPACE, False)
    at, h = w.windows(length)
    by = {}
    for i, x in zip(at.tolist(), h.tolist(), strict=True):
        assert by.setdefault(tuple(w.word(j) for j in range(i, i + length)), x) == x
    assert len(set(by.values())) == len(by)
    assert len(at) == sum(max(0, len(t.split()) - length + 1) for t in texts)
