"""Operator 3: every tier packs windows of its own, in proportion to the tokens that were routed to it."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from lodegraph.llm import packing


@pytest.mark.parametrize("seed,mean", [(5, 5.5), (6, 6.5), (7, 4.5)])
def test_windows_follow_the_documents(seed, mean):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(5000, rng.lognormal(mean, 1.0, 10_000).astype(int) + 1)
    packer, routed = packing.Packer(0), Counter()
    for d, n in enumerate(lengths.tolist()):
        packer.add(d, np.zeros(n, "<u4"))
        assert all(len(q) <= max(packer.most, 128) for q in packer.waiting.values())
        routed[1024] += n // 1024 * 1024
        if n % 1024:
            routed[next(t for t in packing.TIERS if t >= n % 1024)] += n % 1024
    packer.end()
    windows = {r[5]: (r[7], r[8]) for r in packer.drain()}
    packed, groups = Counter(), defaultdict(Counter)
    for tier, group in windows.values():
        packed[tier] += tier
        groups[group][tier] += 1
    total = sum(lengths)
    for tier in packing.TIERS:
        assert abs(packed[tier] - routed[tier]) <= 0.02 * total
    assert sum(len(g) > 1 for g in groups.values()) >= 0.3 * len(groups)
    assert sum(sum(t * k for t, k in g.items()) != packing.STEP_TOKENS for g in groups.values()) <= 1
    assert total <= sum(packed.values()) < total + 1024


def test_long_windows_take_what_shorter_tiers_can_spare():
    packer = packing.Packer(0, most_open=8)
    for d in range(400):
        packer.add(d, np.zeros(600 if d % 2 else 90, "<u4"))
    packer.end()
    windows = defaultdict(list)
    for r in packer.drain():
        windows[r[5]].append(r)
    tiers = Counter(w[0][7] for w in windows.values())
    assert tiers[1024] > 80 and tiers[128] > 100
    first = [sorted(w, key=lambda r: r[6])[0] for w in windows.values() if w[0][7] == 1024]
    assert np.mean([r[2] == r[4] for r in first]) > 0.9  # each begins with a whole document of its own
