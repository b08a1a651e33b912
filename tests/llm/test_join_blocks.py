"""The n-gram join's blocks, dealt columns and bounds against brute force."""

import numpy as np
import pytest

from waymark.llm import ngram_join
from waymark.llm.common import shared_folder
from waymark.llm.components import components


def brute_force(sets):
    """The least place that links reach, by every pair."""
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(sets))]


def corpus(seed):
    """Near copies of a few texts, some at the edge of the similarity, texts that consist mostly of one passage, and loners."""
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    out = []
    for base in range(6):
        words = [f"b{base}x{k}" for k in range(60)]
        for _ in range(25):
            changed = list(words)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                changed[at] = f"c{rng.integers(1000)}"
            out.append(" ".join(changed))
    for _ in range(60):
        out.append(passage + " " + " ".join(f"t{rng.integers(40)}" for _ in range(rng.integers(1, 14))))
    out += [" ".join(f"l{rng.integers(10**6)}" for _ in range(30)) for _ in range(20)]
    return out


@pytest.mark.parametrize("spread", [2048, 4])
def test_blocks_and_dealt_columns_lose_no_link(spark, monkeypatch, spread):
    monkeypatch.setattr(ngram_join, "SPREAD", spread)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    monkeypatch.setattr(ngram_join, "ROWS", 200)
    texts = corpus(5)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    members, links, tied = ngram_join.links_of(docs, shared_folder(spark, "t"), pivots=1, small=4, block=8)
    node = {r.doc_id: r.node for r in members.collect()}
    component = {r.node: r.component for r in tied.collect()}
    groups = {}
    for d, n in node.items():
        groups.setdefault(component.get(n, n), []).append(d)
    got = {d: min(g) for g in groups.values() for d in g}
    assert [got[k] for k in range(len(texts))] == brute_force(sets)
    by_node = {node[k]: s for k, s in enumerate(sets)}
    for r in links.collect():
        x, y = by_node[r.a], by_node[r.b]
        assert r.overlap == len(x & y) and 100 * len(x & y) >= 80 * len(x | y)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(300):
        m, n, both = rng.integers(1, 900), rng.integers(1, 900), rng.integers(0, 400)
        values = rng.integers(0, 2**63, m + n + both).astype(np.uint64)
        a, b = np.unique(values[: m + both]), np.unique(values[m:])
        true = len(np.intersect1d(a, b))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b)) >= true
        least = int(rng.integers(0, 900))
        assert ngram_join.overlap(a, b, least) == (true if true >= least else -1)


def test_components_of_stars_and_chains(spark):
    edges = [(0, k) for k in range(1, 1500)] + [(k, k + 1) for k in range(2000, 2040)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    frame = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in edges], "a long, b long")
    got = {r.node: r.component for r in components(frame, shared_folder(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(1500)}, **{k: 2000 for k in range(2000, 2041)}, 6000: 6000, 6001: 6000}
