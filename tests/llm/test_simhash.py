import random
import re

import numpy as np
import pytest
import xxhash
from llm.odd import empty_docs, odd_docs, odd_rows, stored

from storeloom.llm.simhash import GrayTree, gray_rank, group_links, near_duplicates


def bits_of(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    found = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in found) > len(found))


def connected(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def plain(rows, distance=3):
    last = 2**63 - 1
    prints = [(last if i is None else i, bits_of(t)) for i, t in rows]
    distinct = sorted({b for _, b in prints})
    pairs = [
        (a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= distance
    ]
    root = connected(pairs, distinct)
    low = {}
    for i, b in prints:
        low[root[b]] = min(low.get(root[b], last), i)
    none = lambda i: None if i == last else i
    return sorted(((none(i), f"{b:016x}", none(low[root[b]])) for i, b in prints), key=str)


def run(df, **k):
    return sorted((tuple(r) for r in near_duplicates(df, **k).collect()), key=str)


def test_odd_documents(spark, tmp_path):
    assert run(odd_docs(spark, tmp_path / "d")) == plain(odd_rows())


def test_empty_table(spark, tmp_path):
    assert run(empty_docs(spark, tmp_path / "d")) == []


@pytest.mark.parametrize("group_rows", [20_000, 40, 3])
def test_groups_of_copies(spark, tmp_path, group_rows):
    """Small bounds send the same groups through finer and finer masks."""
    random.seed(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = random.choices(words, k=200)
        for _ in range(30 if group else 120):
            text = list(base)
            for _ in range(random.randint(0, 3)):
                text[random.randrange(200)] = random.choice(words)
            rows.append((len(rows), " ".join(text)))
    random.shuffle(rows)
    got = run(stored(spark, tmp_path / "d", rows), group_rows=group_rows)
    assert got == plain(rows)
    assert len({c for _, _, c in got}) < len(rows) / 2


def test_long_chain_is_one_component(spark, tmp_path):
    """Fingerprints a step apart, far from end to end; the smallest id is at one end."""
    from storeloom.llm.simhash import components

    links = [(i, i + 1) for i in range(-300, 300)]
    random.seed(1)
    random.shuffle(links)
    found = components(spark.createDataFrame(links, "_a long, _b long")).collect()
    assert {r._root for r in found} == {-300} and len(found) == 601


@pytest.mark.parametrize("near", [1, 2, 6, 30])
def test_group_links_connect_what_is_near(near):
    rng = np.random.default_rng(near)
    bits = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, 700)]
    for _ in range(near):
        bits ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    bits = np.unique(bits)
    a, b = group_links(bits, 3)
    nodes = bits.tolist()
    pairs = [(x, y) for i, x in enumerate(nodes) for y in nodes[:i] if (x ^ y).bit_count() <= 3]
    assert connected(zip(a.tolist(), b.tolist()), nodes) == connected(pairs, nodes)
    assert len(a) < len(nodes)


def test_gray_tree_nodes_hold_the_shared_bits():
    rng = np.random.default_rng(0)
    bits = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    tree = GrayTree(bits)
    rank = gray_rank(tree.bits)
    assert (rank[1:] > rank[:-1]).all()
    mask, pattern, width = tree.levels[0]
    for i in range(len(mask)):
        below = tree.bits[i * width : (i + 1) * width]
        assert ((below & mask[i]) == pattern[i]).all()
