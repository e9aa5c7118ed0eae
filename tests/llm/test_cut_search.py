"""The search for shard cuts on plain lists: it ends, in few rounds, at the least capacity, for many shards and any number of bins."""

from __future__ import annotations

import bisect
import math
import random

import pytest

from tidemark.llm import sharding


def on_list(ends, rounds):
    def refine(bins, by):
        rounds.append(len(bins))
        found = {}
        for own in bins:
            level = max(own.level - by, 0)
            for e in ends[bisect.bisect_left(ends, own.first) : bisect.bisect_right(ends, own.last)]:
                found.setdefault((level, (e - 1) >> level), []).append(e)
        return [sharding.Bin(x[0], x[-1], len(x), level) for (level, _), x in found.items()]

    return refine


def feasible(ends, capacity, shards):
    at = 0
    for _ in range(shards):
        i = bisect.bisect_right(ends, at + capacity)
        at = ends[i - 1] if i else 0
    return at == ends[-1]


@pytest.mark.parametrize(("shards", "bins"), [(2, 4), (3, 5), (8, 5), (8, 32), (64, 4), (200, 32), (512, 8192), (2000, 512), (2000, 8192)])
@pytest.mark.parametrize("seed", range(3))
def test_search_ends_at_the_least_capacity(monkeypatch, shards, bins, seed):
    monkeypatch.setattr(sharding, "BINS", bins)
    rng = random.Random(seed)
    n = rng.choice([1, 7, 300, 4000, 60_000 if bins > 4000 else 900])
    ends, total = [], 0
    for _ in range(n):
        total += rng.choice([1, 2, 3, 50, 400, rng.randint(1, 20_000)])
        ends.append(total)
    rounds: list[int] = []
    cuts = sharding.searched(total, shards, on_list(ends, rounds))
    worst = max(b - a for a, b in zip([0, *cuts], cuts, strict=False))
    assert cuts[-1] == total and len(cuts) == shards and set(cuts) <= {0, *ends}
    assert feasible(ends, worst, shards) and not feasible(ends, worst - 1, shards)
    assert len(rounds) <= 2 + math.log(max(2, total), 4) * shards and max(rounds) <= max(bins // 4, shards)
