from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from foliolink.functions import similarity as S

words = st.text(alphabet="abo01l is", max_size=12)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_bounds_and_symmetry(a, b):
    for f in (S.jaro_winkler_of, S.ocr_of, S.token_of, S.blend_of):
        assert 0.0 <= f(a, b) <= 1.0 + 1e-9
    assert S.token_of(a, b) == S.token_of(b, a)


@settings(max_examples=200, deadline=None)
@given(words)
def test_equal_strings(a):
    assert S.token_of(a, a) == 1.0 and S.ocr_of(a, a) == 1.0
    assert S.jaro_winkler_of(a, a) == (0.0 if len(a) == 1 else 1.0)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(2, 19), st.sampled_from([0.05, 0.1, 0.15, 0.2]))
def test_chunk_arithmetic_is_the_loop(n, p, share):
    overlap = max(1, int(p * share))
    step = max(1, p - overlap)
    loop, at = [], 0
    while True:
        stop = min(at + p, n)
        loop.append((at, stop))
        at = stop - overlap
        if at >= n - overlap or n <= p:
            break
    k = 1 if n <= p else -(-(n - p) // step) + 1
    assert [(i * step, min(i * step + p, n)) for i in range(k)] == loop
