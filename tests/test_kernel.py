import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotline.operators.kernel import analyse, clamp_pad, pair_numbers

from . import model


def fast(prev, cur, code):
    h, w = cur.shape
    b = analyse(prev[None], cur[None], code)
    keys, scores = pair_numbers(b, 1, w, h)
    return {(x, y): v for x, y, *v in zip(*(b[k].tolist() for k in ("x", "y", "vx", "vy", "sad", "dev")), strict=True)}, keys[0], scores[0]


def tiles(rng, h, w, size):
    small = rng.integers(40, 220, (-(-h // size), -(-w // size)), dtype=np.uint8)
    return np.kron(small, np.ones((size, size), np.uint8))[:h, :w]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(160, 160), (200, 130), (97, 241), (48, 48), (64, 321)]), st.sampled_from([2, 3, 4, 6]), st.sampled_from(["new", "shift", "noise", "same", "smooth"]))
def test_kernel_equals_scalar_model(seed, size, code, kind):
    rng = np.random.default_rng(seed)
    prev = tiles(rng, *size, 8)
    if kind == "smooth":
        prev = np.add.outer(np.arange(size[0]), np.arange(size[1]) * 2).astype(np.uint8)
    shift = tuple(rng.integers(-9, 10, 2))
    cur = {"new": lambda: tiles(rng, *size, 8), "same": prev.copy, "noise": lambda: np.clip(prev.astype(int) + rng.integers(-6, 7, size), 0, 255).astype(np.uint8)}.get(kind, lambda: np.roll(prev, shift, (0, 1)))()
    blocks, key, score = model.score(prev, cur, code)
    got, got_key, got_score = fast(prev, cur, code)
    assert {k: tuple(v) for k, v in got.items()} == blocks
    assert (got_key, got_score) == (key, score)


def test_batches_equal_single_pairs():
    rng = np.random.default_rng(3)
    a = np.stack([tiles(rng, 160, 176, 8) for _ in range(5)])
    b = np.stack([np.roll(x, (2, k), (0, 1)) for k, x in enumerate(a)])
    keys, scores = pair_numbers(analyse(a, b, 4), 5, 176, 160)
    assert [(k, s) for k, s in zip(keys, scores, strict=True)] == [fast(x, y, 4)[1:] for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize(("side", "groups"), [(48, 1), (64, 1), (160, 16), (320, 81)])
@pytest.mark.parametrize("step", [0, 1, 5, 8, 13, 180])
def test_flat_frames_follow_the_closed_form(side, groups, step):
    a, b = (np.full((side, side), v, np.uint8) for v in (20, 20 + step))
    n = 4 * groups
    expected = 256 * n * step // (300 * n // 128 + 4 * (10 + 10 * groups))
    simp = 128 * (3 if 1024 * step <= 0 else 0)
    _, key, score = fast(a, b, 4)
    assert key == max(256 * step - simp, 0) and score == expected


def test_narrow_pictures_have_no_groups():
    got, key, score = fast(np.zeros((200, 32), np.uint8), np.full((200, 32), 255, np.uint8), 4)
    assert (got, key, score) == ({}, None, 0)


def test_lower_right_border_is_not_seen():
    a = tiles(np.random.default_rng(1), 160, 160, 8)
    b = a.copy()
    b[-64:], b[:, -64:] = 255 - b[-64:], 255 - b[:, -64:]
    assert all(v[2] == 0 for v in fast(a, b, 4)[0].values())


def test_padding_repeats_the_border():
    a = np.arange(12, dtype=np.uint8).reshape(1, 3, 4)
    assert (clamp_pad(a)[0] == np.pad(a[0], ((64, 77), (64, 76)), mode="edge")).all()
