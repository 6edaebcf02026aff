import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from pagewright.operators import hierarchy

C = "concept_id bigint, doc_id string, name string, prerequisites array<string>, deleted_at timestamp, id string"


def brute(cs):
    def canon(x):
        return "".join(ch for ch in (x or "").lower() if ch.isalnum())

    live = [(i, d, canon(n), ps or []) for i, d, n, ps, gone, _ in cs if gone is None and d is not None and canon(n)]
    node = {}
    for i, d, n, _ in live:
        node[d, n] = min(node.get((d, n), i), i)
    up = {i: set() for i in node.values()}
    for _, d, n, ps in live:
        up[node[d, n]] |= {node[d, canon(p)] for p in ps if (d, canon(p)) in node}

    def reach(v):
        seen, todo = set(), list(up[v])
        while todo:
            if (w := todo.pop()) not in seen:
                seen.add(w)
                todo += up[w]
        return seen

    r = {v: reach(v) for v in up}
    loop = {v: min([v, *(w for w in r[v] if v in r[w])]) for v in up if v in r[v]}
    found = sorted({(v, loop.get(w, w)) for v in up for w in r[v] | {v} if w in loop or not up[w]})
    return found, sorted((w, v) for v in up for w in r[v]), sorted((loop[v], v) for v in loop)


def sample(seed, n):
    rng = random.Random(seed)
    names = [f"Name {k}" for k in range(n)]
    written = lambda x: x and rng.choice([x, x.upper(), x.replace(" ", "-")])
    return [(i, rng.choice(["A", "A", "B", None]), rng.choice([None, "!", *map(written, names)]),
             rng.choice([None, [], [rng.choice([None, "", *map(written, names)]) for _ in range(2)]]), None, "x") for i in range(1, 3 * n)]


LINKED_LOOPS = [
    # Loop {1, 2} leads by way of 3 to loop {4, 5}; 6 names itself and leads to 1; 7 builds on 5.
    (1, "D", "a", ["b"], None, ""), (2, "D", "b", ["a", "c"], None, ""), (3, "D", "c", ["d"], None, ""), (4, "D", "d", ["e"], None, ""),
    (5, "D", "e", ["d"], None, ""), (6, "D", "f", ["f", "a"], None, ""), (7, "D", "g", ["e"], None, "")]


def checked(cs, get):
    """All five results of get against brute force; n of the loops' nodes."""
    found, below, loops = brute(cs)
    assert rows(get("roots")) == sorted(found, key=repr)
    assert rows(get("below")) == sorted(below, key=repr)
    assert rows(get("loops")) == sorted(loops, key=repr)
    n_roots, n_below = Counter(v for v, _ in found), Counter(w for w, _ in below)
    nodes = rows(get("nodes"))
    assert [(r[0], r[3], r[4], r[5]) for r in nodes] == [(v, n_roots[v], n_below[v], v in {x for _, x in loops}) for v in sorted({v for v, _ in found}, key=lambda v: repr((v,)))]
    return nodes, rows(get("paths"))


@pytest.fixture
def quick(spark):
    """Many rounds over a few rows: planning is what takes the time."""
    light = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in light}
    for k, v in light.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(quick, seed):
    cs = sample(seed, 24)
    packed, over = hierarchy.packs(*hierarchy.nodes_and_links(quick.createDataFrame(cs, C)))
    assert over is None
    checked(cs, lambda asked: hierarchy.solve(packed, asked))


def test_same_rows_at_any_bound(quick):
    # Everything over the bound, loops that lead to loops, forks and two ways to one node among it: the same rows as from packs.
    cs = LINKED_LOOPS + [(8, "D", "h", ["g", "k"], None, ""), (9, "D", "k", None, None, ""), (10, "D", "l", ["c", "h"], None, ""), (11, "D", "m", ["g"], None, "")]
    df = quick.createDataFrame(cs, C)
    nodes, links = hierarchy.nodes_and_links(df)
    packed, over = hierarchy.packs(nodes, links, 3)
    rounds = hierarchy.Rounds(over, links)
    far = checked(cs, lambda asked: hierarchy.solve(packed, asked).unionByName(rounds.answer(asked)))
    assert far == checked(cs, lambda asked: hierarchy.solve(hierarchy.packs(nodes, links)[0], asked))


def chain_of(n):
    return hierarchy.Pack(np.arange(1, n + 1) + (1 << 60), np.arange(2, n + 1) + (1 << 60), np.arange(1, n) + (1 << 60))


def test_spans_stay_small():
    # A spine of 5,000 nodes with a leaf each: every subtree is one span, though it has thousands of chains.
    n = 5000
    pack = hierarchy.Pack(np.arange(1, 2 * n + 1), np.arange(2, 2 * n + 1), np.concatenate([np.arange(1, n), np.arange(1, n + 1)]))
    assert all(len(s) == 1 for s in pack.spans()) and len(pack.chains) == n
    assert sorted(b - a for s in pack.spans() for a, b in s)[-1] == 2 * n


def test_rows_leave_in_batches():
    # A chain of 10,000 nodes has 50 million path entries; no batch holds more than its share of them.
    n, at = 10_000, 0
    link = np.arange(2 * n - 1) >= n
    ids = np.concatenate([np.arange(1, n + 1), np.arange(2, n + 1)])
    frame = pd.DataFrame({"pack": 7, "id": ids, "parent": np.where(link, ids - 1, ids), "link": link})
    for out in hierarchy.solved_packs(iter([frame[:n], frame[n:]]), "nodes"):
        assert out["path"].str.len().sum() < 8 * hierarchy.BATCH
        at += len(out)
    assert at == n
    assert list(hierarchy.root_rows(chain_of(3)))[-1] == ((3 + (1 << 60), 1 + (1 << 60)), 1)


def test_packs_are_bounded(quick):
    spark = quick
    cs = [(i, f"D{i % 7}", f"n{i}", [f"n{i - 7}"] if i % 3 else None, None, "") for i in range(1, 400)]
    nodes, links = hierarchy.nodes_and_links(spark.createDataFrame(cs, C))
    for bound in (5, 200):
        packed, over = hierarchy.packs(nodes, links, bound)
        n = [r["count"] for r in packed.groupBy("pack").count().collect()]
        assert over is None and sum(n) == nodes.count() + links.count() and max(n) <= 2 * bound


def test_chain_paths(quick):
    cs = [(1, "D", "a", None, None, ""), (2, "D", "b", ["A"], None, ""), (3, "D", "c", ["B"], None, ""), (4, "D", "d", ["c", "a"], None, ""), (5, "D", "e", ["a"], None, ""), (6, "D", "f", ["F"], None, "")]
    got = {r.concept_id: (r.depth, r.path, r.n_roots, r.n_below, r.in_loop) for r in hierarchy.node_table(quick.createDataFrame(cs, C)).collect()}
    assert got == {1: (0, "1", 1, 4, False), 2: (1, "1/2", 1, 2, False), 3: (2, "1/2/3", 1, 1, False), 4: (3, "1/2/3/4", 1, 0, False), 5: (1, "1/5", 1, 0, False), 6: (0, "6", 1, 1, True)}


def test_empty(quick):
    assert hierarchy.roots(quick.createDataFrame([], C)).count() == 0


def test_long_chain(quick):
    # Deeper than any recursion would go.
    cs = [(i, "D", f"n{i}", [f"n{i - 1}"], None, "") for i in range(1, 3001)]
    assert rows(hierarchy.roots(quick.createDataFrame(cs, C)).selectExpr("min(root_id)", "max(root_id)", "count(*)")) == [(1, 1, 3000)]


def test_paths_to_every_root(quick):
    # 4 leads to the roots 1 and 2, to 1 by two ways; {5, 6} is a loop that leads on to 1.
    cs = [(1, "D", "a", None, None, ""), (2, "D", "b", None, None, ""), (3, "D", "c", ["a"], None, ""), (4, "D", "d", ["c", "a", "b"], None, ""),
          (5, "D", "e", ["f", "a"], None, ""), (6, "D", "f", ["e"], None, "")]
    assert rows(hierarchy.root_paths(quick.createDataFrame(cs, C))) == sorted([
        (1, 1, 0, "1"), (2, 2, 0, "2"), (3, 1, 1, "1/3"), (4, 1, 2, "1/3/4"), (4, 2, 1, "2/4"),
        (5, 1, 1, "1/5"), (5, 5, 0, "5"), (6, 1, 1, "1/5"), (6, 5, 0, "5")], key=repr)
