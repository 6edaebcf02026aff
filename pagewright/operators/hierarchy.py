"""Parent-child links to full hierarchies (problem 5).

A node is a document's concept: rows of one doc_id whose names agree. Its parents are
the nodes that its prerequisites name. Every node comes out with its paths, depth and
roots and with all nodes that build on it; loops come out as one.

Method: loops are separated first (strongly connected nodes become one vertex), then
the primary forest of what is left is cut into heavy paths by subtree sizes. A vertex
is named by its chain and its place on it. A path is the concatenation of chain
pieces; the chains laid out one after the other, heavy child first, make what builds
on a vertex an interval, and further parents add the intervals of their children.
Roots go down the chains and change only where a second parent or a loop lies.

Scale: no link crosses documents, so documents (and connected components of documents
over the bound) are packed into groups of bounded size, each solved in one task that
hands out its rows batch by batch. A component that is itself over the bound is never
collected: loops, chains, paths, roots and descendants come from rounds of joins over
the whole cluster (Rounds below), with the same rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import canonical, not_blank
from pagewright.runtime import HEAVY_PARTS, heavy_keys, materialize, split_join

#: Links and nodes of one unit that a task may hold at once; a pack of units has at most twice as many.
PACK_ROWS = 20_000
#: Rows, or path entries, that a task hands out at once.
BATCH = 200_000


def nodes_and_links(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(doc_id, canon, id) and links(doc_id, id, parent), both written once.

    Only rows that are not deleted and have a non-blank name and a doc_id count. A
    node's id is its smallest concept_id. Prerequisites that no node answers are
    ignored. Names are put in canonical form once per row, entries once per distinct
    spelling under a name.
    """
    alive = concepts.filter(F.col("deleted_at").isNull() & F.col("doc_id").isNotNull())
    rows = alive.select("concept_id", "doc_id", canonical("name").alias("canon"), "prerequisites").filter(not_blank("canon"))
    nodes = materialize(rows.groupBy("doc_id", "canon").agg(F.min("concept_id").alias("id")))
    named = rows.select("doc_id", F.col("canon").alias("child"), F.explode("prerequisites").alias("entry")).distinct()
    named = materialize(
        named.select("doc_id", "child", canonical("entry").alias("canon")).filter(not_blank("canon")).distinct())
    up = split_join(named, nodes.withColumnRenamed("id", "parent"), ["doc_id", "canon"], heavy_keys(named, ["doc_id", "canon"]))
    up = up.select("doc_id", F.col("child").alias("canon"), "parent")
    links = split_join(up, nodes, ["doc_id", "canon"], heavy_keys(named.select("doc_id", F.col("child").alias("canon")), ["doc_id", "canon"]))
    return nodes, materialize(links.select("doc_id", "id", "parent").distinct())


# --- one bounded pack ------------------------------------------------------------------


def loops_of(n: int, up: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Strongly connected vertices: the component of each vertex, and the components, parents first."""
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    comps: list[list[int]] = []
    stack: list[int] = []
    clock = 0
    for start in range(n):
        if index[start] >= 0:
            continue
        index[start] = low[start] = clock
        clock += 1
        stack.append(start)
        todo = [(start, 0)]
        while todo:
            v, at = todo.pop()
            for at in range(at, len(up[v])):
                w = up[v][at]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    todo += [(v, at + 1), (w, 0)]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        comp[w := stack.pop()] = len(comps)
                        members.append(w)
                    comps.append(members)
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
    return comp, comps


Spans = tuple[tuple[int, int], ...]


def merged(spans: list[tuple[int, int]]) -> Spans:
    """The same places as disjoint half-open spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return tuple(out)


class Pack:
    """The vertices of one pack, parents before children, with their chains.

    names: smallest id of each vertex's loop, or its own; above: parents; primary: the
    deepest parent, of equal ones the smallest, so that the primary path is a longest
    one; chain and place: the vertex's heavy path, by its head, and how far down on it.
    """

    def __init__(self, ids: np.ndarray, child: np.ndarray, parent: np.ndarray):
        ids = np.sort(ids)
        up: list[list[int]] = [[] for _ in ids]
        for x, y in zip(np.searchsorted(ids, child).tolist(), np.searchsorted(ids, parent).tolist()):
            up[x].append(y)
        comp, comps = loops_of(len(ids), up)
        self.members = [[int(ids[v]) for v in c] for c in comps]
        self.names = [min(c) for c in self.members]
        self.looped = [len(c) > 1 or c[0] in up[c[0]] for c in comps]
        self.above = [sorted({comp[w] for v in c for w in up[v]} - {k}, key=self.names.__getitem__) for k, c in enumerate(comps)]
        m = len(comps)
        self.depth, self.primary = [0] * m, [-1] * m
        for k, above in enumerate(self.above):
            if above:
                self.primary[k] = max(above, key=lambda x: (self.depth[x], -self.names[x]))
                self.depth[k] = self.depth[self.primary[k]] + 1
        self.chain()

    def chain(self) -> None:
        m = len(self.names)
        self.size, heavy = [1] * m, [-1] * m
        for k in range(m - 1, -1, -1):
            if (p := self.primary[k]) >= 0:
                self.size[p] += self.size[k]
        rank = lambda k: (self.size[k], -self.names[k])
        for k, p in enumerate(self.primary):
            if p >= 0 and (heavy[p] < 0 or rank(k) > rank(heavy[p])):
                heavy[p] = k
        self.head, self.place = list(range(m)), [0] * m
        self.chains: dict[int, list[int]] = {}
        for k, p in enumerate(self.primary):
            if p >= 0 and heavy[p] == k:
                self.head[k], self.place[k] = self.head[p], self.place[p] + 1
            self.chains.setdefault(self.head[k], []).append(k)
        # Where each vertex stands when a chain is followed by the chains that hang from it, lowest first.
        self.at, hanging = [0] * m, {}
        for h in self.chains:
            hanging.setdefault(self.primary[h], []).append(h)
        todo, clock = hanging.get(-1, [])[::-1], 0
        while todo:
            h = todo.pop()
            for k in self.chains[h]:
                self.at[k] = clock
                clock += 1
                todo += hanging.get(k, ())

    def path(self, k: int) -> list[int]:
        """Vertices from the root down: the pieces of the chains on the way."""
        pieces = []
        while k >= 0:
            pieces.append(self.chains[self.head[k]][: self.place[k] + 1])
            k = self.primary[self.head[k]]
        return [self.names[x] for piece in reversed(pieces) for x in piece]

    def roots(self) -> list[frozenset[int]]:
        """The roots that each vertex leads to: vertices without parents, and loops, whether or not they lead on."""
        out: list[frozenset[int]] = []
        for k, above in enumerate(self.above):
            own = frozenset([self.names[k]]) if self.looped[k] or not above else frozenset()
            if len(above) == 1 and not own:
                out.append(out[above[0]])
            else:
                out.append(own.union(*(out[p] for p in above)))
        return out

    def spans(self) -> list[Spans]:
        """Places of what builds on each vertex, the vertex with it: its subtree's span and the spans that further links add."""
        own = [(a, a + s) for a, s in zip(self.at, self.size)]
        more: list[Spans] = [()] * len(own)
        gained: list[list[tuple[int, int]]] = [[] for _ in own]
        for k in range(len(own) - 1, -1, -1):
            lo, hi = own[k]
            if gained[k]:
                more[k] = tuple(x for x in merged(gained[k]) if x[0] < lo or x[1] > hi)
            for p in self.above[k]:
                gained[p] += more[k] if p == self.primary[k] else (own[k], *more[k])
            gained[k] = []
        return [merged([o, *x]) if x else (o,) for o, x in zip(own, more)]

    def order(self) -> list[int]:
        out = [0] * len(self.at)
        for k, a in enumerate(self.at):
            out[a] = k
        return out


# What a pack is asked for: the columns, and the rows with their weight in a batch.
Rows = Iterator[tuple[tuple, int]]


def root_rows(pack: Pack) -> Rows:
    for members, roots in zip(pack.members, pack.roots()):
        for v in members:
            for r in roots:
                yield (v, r), 1


def node_rows(pack: Pack) -> Rows:
    held = np.concatenate([[0], np.cumsum([len(pack.members[k]) for k in pack.order()])])
    roots, spans = pack.roots(), pack.spans()
    for h, chain in pack.chains.items():
        # What lies above the chain is written once; down the chain each path adds one vertex to the one before.
        text = "".join(f"{x}/" for x in pack.path(pack.primary[h]))
        for k in chain:
            text += str(pack.names[k])
            below = int(sum(held[b] - held[a] for a, b in spans[k])) - (not pack.looped[k])
            for v in pack.members[k]:
                yield (v, pack.depth[k], text, len(roots[k]), below, pack.looped[k], pack.names[h], pack.place[k]), pack.depth[k] + 1
            text += "/"


def below_rows(pack: Pack) -> Rows:
    order = pack.order()
    for k, spans in enumerate(pack.spans()):
        below = [x for a, b in spans for y in order[a:b] if y != k or pack.looped[k] for x in pack.members[y]]
        for v in pack.members[k]:
            for x in below:
                yield (v, x), 1


def loop_rows(pack: Pack) -> Rows:
    for name, members, looped in zip(pack.names, pack.members, pack.looped):
        if looped:
            for v in members:
                yield (name, v), 1


def path_rows(pack: Pack) -> Rows:
    """For each root the longest way down from it; of equal ones the parent with the smallest id."""
    ways: list[dict[int, tuple[int, int]]] = []
    for k, (members, above) in enumerate(zip(pack.members, pack.above)):
        mine: dict[int, tuple[int, int]] = {}
        for p in above:
            for root, (steps, _) in ways[p].items():
                if root not in mine or mine[root][0] <= steps:
                    mine[root] = steps + 1, p
        if not above or pack.looped[k]:
            mine[k] = 0, -1
        ways.append(mine)
        for root in mine:
            path, at = [], k
            while at >= 0:
                path.append(pack.names[at])
                at = ways[at][root][1]
            text = "/".join(map(str, path[::-1]))
            for v in members:
                yield (v, pack.names[root], len(path) - 1, text), len(path)


ASKED: dict[str, tuple[Callable[[Pack], Rows], str]] = {
    "roots": (root_rows, "concept_id bigint, root_id bigint"),
    "nodes": (node_rows, "concept_id bigint, depth int, path string, n_roots int, n_below bigint, in_loop boolean, chain bigint, place int"),
    "paths": (path_rows, "concept_id bigint, root_id bigint, depth int, path string"),
    "below": (below_rows, "concept_id bigint, below_id bigint"),
    "loops": (loop_rows, "loop_id bigint, concept_id bigint"),
}


def solved_packs(batches: Iterator[pd.DataFrame], asked: str) -> Iterator[pd.DataFrame]:
    """Packs arrive one after the other; each is solved when its last row is there, and its rows leave in bounded batches."""
    rows_of, schema = ASKED[asked]
    columns = [c.split()[0] for c in schema.split(", ")]

    def solved(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        links = rows[rows["link"]]
        pack = Pack(rows.loc[~rows["link"], "id"].to_numpy(), links["id"].to_numpy(), links["parent"].to_numpy())
        out, weight = [], 0
        for row, w in rows_of(pack):
            out.append(row)
            weight += w
            if weight >= BATCH:
                yield pd.DataFrame(out, columns=columns)
                out, weight = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    held: list[pd.DataFrame] = []
    for batch in batches:
        for key, part in batch.groupby("pack", sort=False):
            if held and held[0]["pack"].iloc[0] != key:
                yield from solved(held)
                held = []
            held.append(part)
    if held:
        yield from solved(held)


# --- grouping --------------------------------------------------------------------------


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): comp is the smallest id that links connect with id, in either direction.

    Rounds of taking the smallest label of the neighbours, handing it to all who carry
    the same label, and looking the label's own label up; they grow with the logarithm
    of the longest connection. Popular nodes and labels that most of a component
    carries are heavy keys: their rows stay where they are.
    """
    both = links.select("id", F.col("parent").alias("other")).union(links.select("parent", "id"))
    both = materialize(both.filter(F.col("id") != F.col("other")).distinct())
    hubs = heavy_keys(both, ["other"])
    labels = materialize(nodes.select("id", F.col("id").alias("comp")))
    total = labels.count()

    def large(counts: DataFrame, key: str) -> DataFrame:
        return materialize(counts.filter(F.col("n") * HEAVY_PARTS > total).select(key))

    while True:
        seen = labels.select(F.col("id").alias("other"), F.col("comp").alias("seen"))
        near = split_join(both, seen, ["other"], hubs).groupBy("id").agg(F.min("seen").alias("seen"))
        better = materialize(labels.join(near, "id", "left").select("id", "comp", F.least("comp", "seen").alias("best")))
        hooks = materialize(better.groupBy("comp").agg(F.min("best").alias("root"), F.count(F.lit(1)).alias("n")))
        hooked = materialize(split_join(better, hooks.drop("n"), ["comp"], large(hooks, "comp")).select("id", "comp", F.col("root").alias("best")))
        jump = hooked.select(F.col("id").alias("best"), F.col("best").alias("root"))
        tops = large(hooked.groupBy("best").agg(F.count(F.lit(1)).alias("n")), "best")
        after = materialize(split_join(hooked, jump, ["best"], tops).select("id", "comp", F.least("best", "root").alias("best")))
        labels = after.select("id", F.col("best").alias("comp"))
        if after.filter(F.col("best") != F.col("comp")).isEmpty():
            return labels


def pack_numbers(units: DataFrame, bound: int, total: int) -> DataFrame:
    """units (key, n) with n at most bound, as (key, pack): packs of at most twice the bound.

    Units are spread over slots by hash; within a slot they are filled up in order.
    """
    slots = total // (64 * bound) + 1
    slot = F.pmod(F.xxhash64("key"), F.lit(slots))
    before = Window.partitionBy("slot").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    filled = units.withColumn("slot", slot).withColumn("full", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return filled.select("key", F.struct("slot", F.floor(F.col("full") / bound).alias("part")).alias("pack"))


def packs(nodes: DataFrame, links: DataFrame, bound: int = PACK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows (pack, id, parent, link) in packs of bounded size, and the ids of what no pack may hold.

    A row is a link, or else a node (then parent says nothing). Whole documents are packed where they fit; of larger ones the connected
    components. None where every component fits.
    """
    row = ["id", "parent", "link"]

    def both(nodes: DataFrame, links: DataFrame, unit: str) -> DataFrame:
        return nodes.select(unit, "id", F.col("id").alias("parent"), F.lit(False).alias("link")).unionByName(links.select(unit, "id", "parent", F.lit(True).alias("link")))

    rows = both(nodes, links, "doc_id")
    per_doc = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    big = per_doc.filter(F.col("n") > bound).select("doc_id")
    total, n_big = per_doc.agg(F.sum("n"), F.count_if(F.col("n") > bound)).first()
    total = total or 0
    units = per_doc.filter(F.col("n") <= bound).select(F.col("doc_id").alias("key"), "n")
    over = None
    if n_big:
        # At most total / bound documents are that big.
        big = F.broadcast(big) if total // bound <= 100_000 else big
        small = rows.join(big, "doc_id", "left_anti").select(F.col("doc_id").alias("key"), *row)
        big_links = materialize(links.join(big, "doc_id", "left_semi").select("id", "parent"))
        comp = materialize(components(nodes.join(big, "doc_id", "left_semi"), big_links))
        # A link lies in its child's component: the child's rows are heavy if it has many parents.
        linked = split_join(big_links, comp, ["id"], heavy_keys(big_links, ["id"])).select("comp", "id", "parent")
        big_rows = both(comp, linked, "comp")
        per_comp = materialize(big_rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
        huge = materialize(per_comp.filter(F.col("n") > bound).select("comp"))
        if not huge.isEmpty():
            huge = F.broadcast(huge) if total // bound <= 100_000 else huge
            over = comp.join(huge, "comp", "left_semi").select("id")
            big_rows = big_rows.join(huge, "comp", "left_anti")
        key = F.concat(F.lit("\0"), F.col("comp").cast("string")).alias("key")
        rows = small.unionByName(big_rows.select(key, *row))
        units = units.union(per_comp.filter(F.col("n") <= bound).select(key, "n"))
    else:
        rows = rows.select(F.col("doc_id").alias("key"), *row)
    # A unit has at most `bound` rows, so no key of this join is hot.
    return rows.join(pack_numbers(units, bound, total), "key").select("pack", *row), over


def solve(packed: DataFrame, asked: str) -> DataFrame:
    return packed.repartition("pack").sortWithinPartitions("pack").select(
        F.xxhash64("pack").alias("pack"), "id", "parent", "link").mapInPandas(lambda it: solved_packs(it, asked), ASKED[asked][1])


# --- components over the bound -----------------------------------------------------------


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Rounds:
    """Components over the bound: vertices and the links between them, by joins alone.

    Each round is written once and never rewritten; what was found is the union of the
    rounds. Links to popular nodes are heavy keys.
    """

    def __init__(self, ids: DataFrame, links: DataFrame):
        ids = materialize(ids)
        links = materialize(links.join(ids, "id", "left_semi").select("id", "parent"))
        self.vertex = self.condensed(ids, links)
        v = self.vertex.select("id", "vertex")
        low = split_join(links, v, ["id"], heavy_keys(links, ["id"])).select(F.col("vertex").alias("low"), F.col("parent").alias("id"))
        both = split_join(low, v, ["id"], heavy_keys(links.select(F.col("parent").alias("id")), ["id"])).select("low", F.col("vertex").alias("high"))
        self.up = materialize(both.filter(F.col("low") != F.col("high")).distinct())
        self.wide = heavy_keys(self.up.select(F.col("high").alias("vertex")), ["vertex"])

    def condensed(self, ids: DataFrame, links: DataFrame) -> DataFrame:
        """(id, vertex, in_loop): what lies on no loop is peeled off from both ends; of the rest each node takes the
        smallest id that reaches it, and the nodes that reach that id back are its loop."""
        loops: list[DataFrame] = []
        rest, n = links, links.count()
        while n:
            while True:
                kept = materialize(
                    rest.join(rest.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
                    .join(rest.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select("id", "parent"))
                before, n = n, kept.count()
                rest = kept
                if n == before:
                    break
            if not n:
                break
            hubs = heavy_keys(rest, ["id"])
            color = materialize(rest.select("id").distinct().select("id", F.col("id").alias("color")))
            while True:
                got = split_join(rest, color, ["id"], hubs).groupBy("parent").agg(F.min("color").alias("seen")).withColumnRenamed("parent", "id")
                new = materialize(color.join(got, "id", "left").select("id", F.least("color", "seen").alias("color"), F.col("color").alias("old")))
                color = new.select("id", "color")
                if new.filter(F.col("color") != F.col("old")).isEmpty():
                    break
            mine = split_join(rest, color, ["id"], hubs)
            theirs = color.select(F.col("id").alias("parent"), F.col("color").alias("c2"))
            inside = materialize(split_join(mine, theirs, ["parent"], heavy_keys(mine, ["parent"])).filter(F.col("color") == F.col("c2")).select("id", "parent", "color"))
            # Each color's own node leads to all of the color; walk back from it, from parent to id, to those that lead to it.
            edge = materialize(color.filter(F.col("id") == F.col("color")))
            back = [edge]
            while True:
                step = inside.join(edge.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "color").distinct()
                edge = materialize(step.join(union_all(back).select("id"), "id", "left_anti"))
                if edge.isEmpty():
                    break
                back.append(edge)
            found = materialize(union_all(back))
            own = inside.filter(F.col("id") == F.col("parent")).select(F.col("color").alias("alone")).distinct()
            sized = found.groupBy("color").agg(F.count(F.lit(1)).alias("n")).join(own, F.col("color") == F.col("alone"), "left")
            real = sized.filter((F.col("n") > 1) | F.col("alone").isNotNull()).select("color")
            loops.append(materialize(found.join(real, "color").select("id", F.col("color").alias("vertex"))))
            gone = found.select("id")
            rest = materialize(rest.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti").select("id", "parent"))
            n = rest.count()
        if not loops:
            return materialize(ids.select("id", F.col("id").alias("vertex"), F.lit(False).alias("in_loop")))
        return materialize(ids.join(union_all(loops), "id", "left").select("id", F.coalesce("vertex", "id").alias("vertex"), F.col("vertex").isNotNull().alias("in_loop")))

    def down(self, edge: DataFrame) -> DataFrame:
        """The rows of edge (vertex and others) as rows of all vertices that lead to theirs."""
        up = self.up.withColumnRenamed("high", "vertex")
        # With roots a vertex has several rows: then both sides of a popular vertex are split by the adaptive skew join.
        met = split_join(up, edge, ["vertex"], self.wide) if edge.columns == ["vertex"] else up.join(edge, "vertex")
        return met.drop("vertex").withColumnRenamed("low", "vertex")

    def tops(self, loops: bool) -> DataFrame:
        """(vertex) of those that lead nowhere and, if asked for, of the loops."""
        top = self.vertex.select("vertex").distinct().join(self.up.select(F.col("low").alias("vertex")).distinct(), "vertex", "left_anti")
        return top.union(self.vertex.filter("in_loop").select("vertex")).distinct() if loops else top

    def starts(self) -> DataFrame:
        return self.tops(True).select("vertex", F.col("vertex").alias("root_id"))

    def members(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Rows of vertices as rows of their nodes (id); a loop of any size is spread by its own rows."""
        return self.vertex.select("id", "vertex").join(rows, "vertex").select("id", *keep)

    def roots(self) -> DataFrame:
        """(vertex, root_id): roots go down the links, round by round, each pair once."""
        edge = materialize(self.starts())
        found = [edge]
        while not edge.isEmpty():
            edge = materialize(self.down(edge).distinct().join(union_all(found), ["vertex", "root_id"], "left_anti"))
            found.append(edge)
        return union_all(found)

    def depths(self, start: DataFrame) -> DataFrame:
        """start's columns (vertex and what goes down with it) and depth: the most steps down from a start, by the last round that reaches it."""
        keys, found, edge = start.columns, [], materialize(start)
        while not edge.isEmpty():
            found.append(edge.withColumn("depth", F.lit(len(found))))
            edge = materialize(self.down(edge).select(*keys).distinct())
        return union_all(found).groupBy(*keys).agg(F.max("depth").alias("depth"))

    def paths(self, found: DataFrame) -> DataFrame:
        """found (see depths) with to (the deepest vertex above, of equal ones the smallest) and path.

        A path is doubled in each round by that of the vertex where it begins.
        """
        rest = [c for c in found.columns if c not in ("vertex", "depth")]
        found = materialize(found)
        above = self.up.join(found.select(F.col("vertex").alias("high"), "depth", *rest), "high").groupBy(F.col("low").alias("vertex"), *rest).agg(
            F.max_by("high", F.struct("depth", -F.col("high"))).alias("to"))
        first = materialize(found.join(above, ["vertex", *rest], "left"))
        if rest:  # A start has no part above it that leads to itself.
            first = first.withColumn("to", F.when(F.col("depth") > 0, F.col("to")))
        steps = first.select("vertex", *rest, F.col("to").alias("at"), F.array("vertex").alias("path"))
        while True:
            before = steps.select(F.col("vertex").alias("at"), *rest, F.col("at").alias("next"), F.col("path").alias("before"))
            steps = materialize(steps.join(before, ["at", *rest], "left").select(
                "vertex", *rest, F.col("next").alias("at"), F.concat(F.coalesce("before", F.array().cast("array<bigint>")), "path").alias("path")))
            if steps.filter(F.col("at").isNotNull()).isEmpty():
                return first.join(steps.drop("at"), ["vertex", *rest])

    def chained(self) -> tuple[DataFrame, DataFrame]:
        """The primary forest (vertex, depth, to, path) and its chains (vertex, chain, place)."""
        tree = materialize(self.paths(self.depths(self.tops(False))))
        size = tree.select(F.explode("path").alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("size"))
        heavy = tree.filter(F.col("to").isNotNull()).select("vertex", "to").join(size, "vertex").groupBy("to").agg(
            F.max_by("vertex", F.struct("size", -F.col("vertex"))).alias("vertex"))
        chains = materialize(tree.select("vertex").join(heavy, "vertex", "left").select(
            "vertex", F.coalesce("to", "vertex").alias("chain"), F.col("to").isNotNull().cast("int").alias("place")))
        while True:
            on = chains.select(F.col("vertex").alias("chain"), F.col("chain").alias("head"), F.col("place").alias("more"))
            far = materialize(chains.join(on, "chain").select("vertex", F.col("head").alias("chain"), (F.col("place") + F.col("more")).alias("place"), "more"))
            chains = far.drop("more")
            if far.filter("more > 0").isEmpty():
                return tree, chains

    def pieces(self, chains: DataFrame) -> DataFrame:
        """(vertex, chain, first): what builds on a vertex, as the part of each chain from a place on; merged up the links until nothing improves."""
        edge = chains.withColumnRenamed("place", "first")
        found = [edge]
        while not edge.isEmpty():
            step = self.up.withColumnRenamed("low", "vertex").join(edge, "vertex").groupBy(F.col("high").alias("vertex"), "chain").agg(F.min("first").alias("new"))
            known = union_all(found).groupBy("vertex", "chain").agg(F.min("first").alias("first"))
            edge = materialize(step.join(known, ["vertex", "chain"], "left").filter("first IS NULL OR new < first").select("vertex", "chain", F.col("new").alias("first")))
            found.append(edge)
        return materialize(union_all(found).groupBy("vertex", "chain").agg(F.min("first").alias("first")))

    def nodes(self) -> DataFrame:
        tree, chains = self.chained()
        held = self.vertex.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
        onward = Window.partitionBy("chain").orderBy(F.desc("place"))
        tails = chains.join(held, "vertex").select("chain", F.col("place").alias("first"), F.sum("n").over(onward).alias("n"))
        below = self.pieces(chains).join(tails, ["chain", "first"]).groupBy("vertex").agg(F.sum("n").alias("n"))
        counts = self.roots().groupBy("vertex").agg(F.count(F.lit(1)).cast("int").alias("n_roots"))
        every = self.vertex.join(tree.drop("to"), "vertex").join(chains, "vertex").join(below, "vertex").join(counts, "vertex")
        return every.select(
            F.col("id").alias("concept_id"), "depth", written("path").alias("path"), "n_roots",
            (F.col("n") - F.when(F.col("in_loop"), 0).otherwise(1)).alias("n_below"), "in_loop", "chain", "place")

    def below(self) -> DataFrame:
        """The parts of chains below each vertex, spread into their vertices and these into their nodes."""
        _, chains = self.chained()
        on = chains.select("chain", "place", F.col("vertex").alias("low"))
        pairs = self.pieces(chains).join(on, "chain").filter(F.col("place") >= F.col("first")).select("vertex", "low")
        looped = self.vertex.filter("in_loop").select(F.col("vertex").alias("low")).distinct()
        own = pairs.filter(F.col("vertex") == F.col("low")).join(looped, "low", "left_semi").select("vertex", "low")
        spread = self.members(pairs.filter(F.col("vertex") != F.col("low")).unionByName(own), ["low"]).withColumnRenamed("id", "concept_id")
        return spread.join(self.vertex.select(F.col("id").alias("below_id"), F.col("vertex").alias("low")), "low").select("concept_id", "below_id")

    def answer(self, asked: str) -> DataFrame:
        if asked == "roots":
            return self.members(self.roots(), ["root_id"]).withColumnRenamed("id", "concept_id")
        if asked == "nodes":
            return self.nodes()
        if asked == "below":
            return self.below()
        if asked == "loops":
            return self.vertex.filter("in_loop").select(F.col("vertex").alias("loop_id"), F.col("id").alias("concept_id"))
        far = self.paths(self.depths(self.starts()))
        return self.members(far.withColumn("path", written("path")), ["root_id", "depth", "path"]).withColumnRenamed("id", "concept_id")


# --- results ---------------------------------------------------------------------------


def written(path: str) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "/")


def hierarchy(concepts: DataFrame, asked: str, bound: int = PACK_ROWS) -> DataFrame:
    """The rows that are asked for (ASKED), from packs and, for components over the bound, from rounds of joins."""
    nodes, links = nodes_and_links(concepts)
    packed, over = packs(nodes, links, bound)
    found = solve(packed, asked)
    return found if over is None else found.unionByName(Rounds(over, links).answer(asked).select(*found.columns))


def roots(concepts: DataFrame, bound: int = PACK_ROWS) -> DataFrame:
    """(concept_id, root_id): one row per node and root that it reaches in zero or more steps."""
    return hierarchy(concepts, "roots", bound)


def node_table(concepts: DataFrame, bound: int = PACK_ROWS) -> DataFrame:
    """concept_id, depth, path (ids of the longest way down from a root, loops by their smallest), n_roots, n_below, in_loop, chain, place."""
    return hierarchy(concepts, "nodes", bound)


def root_paths(concepts: DataFrame, bound: int = PACK_ROWS) -> DataFrame:
    """concept_id, root_id, depth, path: for each row of roots the longest way down from that root (loops by their smallest id)."""
    return hierarchy(concepts, "paths", bound)


def descendants(concepts: DataFrame, bound: int = PACK_ROWS) -> DataFrame:
    """(concept_id, below_id): each node with every node that builds on it; nodes of a loop build on each other and themselves."""
    return hierarchy(concepts, "below", bound)


def loop_table(concepts: DataFrame, bound: int = PACK_ROWS) -> DataFrame:
    """(loop_id, concept_id): the nodes of every loop; loop_id is the smallest."""
    return hierarchy(concepts, "loops", bound)
