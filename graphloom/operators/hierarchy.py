"""Parent-child links to full hierarchies by peeling leaves.

Nodes are put into blocks along a given grouping (a repository, a vocabulary),
groups too large for one task being cut along a finer one and at last by hash.
Inside a block leaves are peeled from below; the reverse of that order then
hands roots, depths and ancestors down, and what could not be peeled contains
the loops.  A parent in another block is an exit.  Only nodes that some exit
leads to take part in what follows: chains of them are passed by pointer
jumping, a row a gate, and only where gates have several exits, by doubling
over those.  Where every group fits its block there are no exits and it all is
one shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

CYCLE = "<cycle>"
ROOT, EXIT, LOOP = 0, 1, 2
MAX_BLOCK = 40_000
MAX_LINEAGE = 2_000


def peel(parents: list[list[int]]) -> tuple[list[int], list[int]]:
    """(order, rest): nodes in the order in which their last child was peeled, and the nodes that never become leaves."""
    open_ = [0] * len(parents)
    for ps in parents:
        for p in ps:
            open_[p] += 1
    order = [v for v, n in enumerate(open_) if n == 0]
    for v in order:  # grows while it is read
        for p in parents[v]:
            open_[p] -= 1
            if open_[p] == 0:
                order.append(p)
    return order, [v for v, n in enumerate(open_) if n > 0]


def _split_rest(parents: list[list[int]], rest: list[int]) -> tuple[list[int], list[int]]:
    """Of the unpeeled: those above all loops, parents first, and those on or below a loop."""
    inside, waiting, below = set(rest), {}, {}
    for v in rest:
        up = [p for p in parents[v] if p in inside]
        waiting[v] = len(up)
        for p in up:
            below.setdefault(p, []).append(v)
    above = [v for v in rest if waiting[v] == 0]
    for v in above:
        for c in below.get(v, ()):
            waiting[c] -= 1
            if waiting[c] == 0:
                above.append(c)
    return above, [v for v in rest if waiting[v] > 0]


def reach(parents: list[list[int]], exits: list[list[str]], names: list[str], every: bool = False) -> tuple[list[dict], list[bool]]:
    """Per node the least steps to each root and exit above it, keys (kind, name), and whether a loop lies above it.

    With ``every`` the node itself and all nodes above it count as roots do.
    """
    order, rest = peel(parents)
    above, loops = _split_rest(parents, rest)
    looped = [False] * len(parents)
    for v in loops:
        looped[v] = True
    got: list[dict | None] = [None] * len(parents)

    def own(v: int) -> dict:
        mine = {(EXIT, x): 1 for x in exits[v]}
        return mine if (parents[v] or exits[v]) and not every else mine | {(ROOT, names[v]): 0}

    def hand_down(v: int) -> None:
        mine = own(v)
        for p in parents[v]:
            looped[v] |= looped[p]
            for key, steps in (got[p] or {}).items():
                if steps + 1 < mine.get(key, 1 << 60):
                    mine[key] = steps + 1
        got[v] = mine

    for v in above:
        hand_down(v)
    children: dict[int, list[int]] = {}
    on = set(loops)
    for v in loops:
        hand_down(v)
        for p in parents[v]:
            if p in on:
                children.setdefault(p, []).append(v)
    queue, queued = deque(loops), set(loops)
    while queue:
        p = queue.popleft()
        queued.discard(p)
        for c in children.get(p, ()):
            better = {k: s + 1 for k, s in got[p].items() if s + 1 < got[c].get(k, 1 << 60)}
            if better:
                got[c].update(better)
                if c not in queued:
                    queued.add(c)
                    queue.append(c)
    for v in reversed(order):
        hand_down(v)
    return got, looped


def _local(pdf: pd.DataFrame) -> tuple[list[str], list[list[int]], list[list[str]]]:
    names = pdf["node"].tolist()
    at = {n: i for i, n in enumerate(names)}
    parents = [[at[p] for p in ps if p in at] for ps in pdf["parents"]]
    exits = [[p for p in ps if p not in at] for ps in pdf["parents"]]
    return names, parents, exits


def _block_reach(pdf: pd.DataFrame, every: bool) -> pd.DataFrame:
    frames = []
    for tree, part in pdf.groupby("tree", sort=False):
        names, parents, exits = _local(part)
        got, looped = reach(parents, exits, names, every)
        rows = [(names[v], x, kind, steps) for v, g in enumerate(got) for (kind, x), steps in g.items()]
        rows += [(names[v], CYCLE, LOOP, -1) for v, on in enumerate(looped) if on]
        frames.append(pd.DataFrame(rows, columns=["node", "target", "kind", "steps"]).assign(tree=tree))
    return pd.concat(frames)[["tree", "node", "target", "kind", "steps"]]


def _block_roots(pdf: pd.DataFrame) -> pd.DataFrame:
    return _block_reach(pdf, every=False)


def _block_lineage(pdf: pd.DataFrame) -> pd.DataFrame:
    return _block_reach(pdf, every=True)


def blocked(links: DataFrame, coarse: Column, fine: Column, max_block: int) -> DataFrame:
    """One row (tree, node, parents, bucket) per node; a bucket holds about max_block nodes at most."""
    nodes = (
        links.where("node is not null")
        .groupBy("tree", "node")
        .agg(F.collect_set(F.when(F.col("parent") != "", F.col("parent"))).alias("parents"), F.min(F.coalesce(coarse, F.lit(""))).alias("coarse"), F.min(F.coalesce(fine, F.lit(""))).alias("fine"))
    )
    nodes = cut(nodes)
    large = nodes.groupBy("tree", "coarse").count().where(F.col("count") > max_block).select("tree", "coarse", F.lit(True).alias("large"))
    finer = nodes.join(large, ["tree", "coarse"], "left_semi").groupBy("tree", "coarse", "fine").count()
    finer = finer.select("tree", "coarse", "fine", F.ceil(F.col("count") / max_block).alias("parts"))
    total = nodes.count()
    buckets = max(1, -(-2 * total // max_block))
    group = F.when(F.col("parts").isNull(), F.xxhash64("tree", "coarse")).otherwise(F.xxhash64("tree", "coarse", "fine", F.pmod(F.xxhash64("node"), "parts")))
    return nodes.join(finer, ["tree", "coarse", "fine"], "left").select("tree", "node", "parents", F.pmod(group, F.lit(buckets)).alias("bucket"))


def hierarchy(links: DataFrame, coarse: Column, fine: Column | None = None, max_block: int = MAX_BLOCK) -> DataFrame:
    """(tree, node, root, depth): the least steps from each node up to each root it reaches, and (tree, node, '<cycle>', -1) where a loop lies above it.

    ``links`` has columns tree, node, parent, a row with null parent for a node
    without one; every parent must be a node itself.  ``coarse`` and ``fine``
    say which nodes lie close together; they change the speed, not the result.
    Repeated links count once, null nodes and empty parents not at all; a node
    that is its own parent is a loop; of an empty table nothing comes out.
    """
    found = _closed(blocked(links, coarse, fine if fine is not None else F.lit(""), max_block), _block_roots)
    return found.select("tree", "node", F.col("target").alias("root"), F.col("steps").alias("depth"))


def lineage(links: DataFrame, coarse: Column, fine: Column | None = None, max_block: int = MAX_LINEAGE) -> DataFrame:
    """(tree, node, ancestor, steps): each node with itself and all nodes above it, at their least distance.

    Read the other way it gives all descendants of a node.  ``links`` as for
    ``hierarchy``.  In a loop each node is above every other; the rows say
    nothing else of loops.  The rows are as many as the depths of all nodes
    together, so blocks are smaller here.
    """
    found = _closed(blocked(links, coarse, fine if fine is not None else F.lit(""), max_block), _block_lineage, every=True)
    found = found.where(F.col("kind") == ROOT).groupBy("tree", "node", "target").agg(F.min("steps").alias("steps"))
    return found.select("tree", "node", F.col("target").alias("ancestor"), "steps")


def descendants(lines: DataFrame) -> DataFrame:
    """(tree, node, descendants): how many nodes lie below each node, itself not counted; of what ``lineage`` gives."""
    return lines.groupBy("tree", F.col("ancestor").alias("node")).agg(F.count_if(F.col("steps") > 0).alias("descendants"))


def full_paths(links: DataFrame, coarse: Column, fine: Column | None = None, max_block: int = MAX_LINEAGE) -> DataFrame:
    """(tree, node, path): the nodes from a root down to each node that reaches one, as an array.

    Of several parents the one nearest to a root is gone over, of those the
    least name.  The path of a node is as long as it is deep; it is collected
    per node, after the links have been cut to one parent each.
    """
    depth = hierarchy(links, coarse, fine).where(F.col("depth") >= 0).groupBy("tree", "node").agg(F.min("depth").alias("depth"))
    given = links.withColumn("coarse_", coarse).withColumn("fine_", fine if fine is not None else F.lit(""))
    up = given.join(depth.select("tree", F.col("node").alias("parent"), "depth"), ["tree", "parent"])
    main = up.groupBy("tree", "node").agg(F.min(F.struct("depth", "parent"))["parent"].alias("parent"))
    hints = given.groupBy("tree", "node").agg(F.min("coarse_").alias("coarse_"), F.min("fine_").alias("fine_"))
    kept = depth.select("tree", "node").join(hints, ["tree", "node"]).join(main, ["tree", "node"], "left").select("tree", "node", "parent", "coarse_", "fine_")
    lines = lineage(kept, F.col("coarse_"), F.col("fine_"), max_block)
    order = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), "ancestor")))
    return lines.groupBy("tree", "node").agg(order["ancestor"].alias("path"))


def _jumped(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gates that lead on to one other gate: the gate beyond all such that each comes to, with the steps there; and those that come to none, for a loop lies above them.

    Pointer jumping: one row per gate whatever the length of the chains; every
    round doubles how far it points, so a chain of n gates takes log2 n rounds.
    """
    at = single
    for _ in range(single.count().bit_length() + 1):
        up = at.select("tree", F.col("node").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        ahead = cut(at.join(up, ["tree", "target"], "left"))
        at = ahead.select("tree", "node", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if ahead.where("next is not null").isEmpty():
            break
    held = at.join(single.select("tree", F.col("node").alias("target")), ["tree", "target"], "left_semi").select("tree", "node")
    return cut(at.join(held, ["tree", "node"], "left_anti")), cut(held)


def _closed(nodes: DataFrame, block: Callable[[pd.DataFrame], pd.DataFrame], every: bool = False) -> DataFrame:
    """What the blocks find, carried on over the exits between them.

    Gates (nodes that an exit leads to) that only lead on to one other gate are
    passed by pointer jumping.  Those with several exits, or with a root in
    their block as well, take part in a closure by doubling; of nodes with one
    parent there are none.  Where all gates on the way count (``every``)
    nothing can be passed.
    """
    schema = "tree string, node string, target string, kind int, steps bigint"
    got = cut(nodes.groupBy("bucket").applyInPandas(block, schema))
    exits = got.where(F.col("kind") == EXIT)
    done = got.where(F.col("kind") != EXIT)
    if exits.isEmpty():
        return done
    gates = cut(exits.select("tree", F.col("target").alias("node")).distinct())
    step = cut(exits.join(gates, ["tree", "node"], "left_semi").select("tree", "node", "target", "steps"))
    own = cut(done.join(gates, ["tree", "node"], "left_semi"))
    loop = lambda rows: rows.select("tree", "node", F.lit(CYCLE).alias("target"), F.lit(LOOP).alias("kind"), F.lit(-1).cast("bigint").alias("steps"))
    total = F.when(F.col("kind") == LOOP, -1).otherwise(F.col("a") + F.col("b")).cast("bigint").alias("steps")

    def carried(ways: DataFrame, ends: DataFrame) -> DataFrame:
        """What the targets of some ways come to, for their nodes."""
        via = ends.select("tree", F.col("node").alias("mid"), "target", "kind", F.col("steps").alias("b"))
        return ways.select("tree", "node", F.col("target").alias("mid"), F.col("steps").alias("a")).join(via, ["tree", "mid"]).select("tree", "node", "target", "kind", total)

    least = lambda rows: rows.groupBy("tree", "node", "target", "kind").agg(F.min("steps").alias("steps"))
    passed, far = step.where("false"), step
    if not every:
        degree = step.groupBy("tree", "node").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"), F.min("steps").alias("steps"))
        single = cut(degree.where("n = 1").join(own.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", "target", "steps"))
        passed, held = _jumped(single)
        own = cut(own.unionByName(loop(held)))
        forks = step.join(single, ["tree", "node"], "left_anti")
        to = passed.select("tree", F.col("node").alias("target"), F.col("target").alias("end"), F.col("steps").alias("more"))
        forks = forks.join(to, ["tree", "target"], "left").select("tree", "node", F.coalesce("end", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        far = forks.groupBy("tree", "node", "target").agg(F.min("steps").alias("steps"))
    far, seen = cut(far), None
    while not far.isEmpty():
        right = far.select("tree", F.col("node").alias("mid"), "target", F.col("steps").alias("b"))
        next_ = far.select("tree", "node", F.col("target").alias("mid"), F.col("steps").alias("a")).join(right, ["tree", "mid"]).select("tree", "node", "target", (F.col("a") + F.col("b")).alias("steps"))
        far = cut(far.unionByName(next_).groupBy("tree", "node", "target").agg(F.min("steps").alias("steps")))
        now = tuple(far.agg(F.count("*"), F.sum("steps")).first())
        if now == seen:  # steps only get fewer and pairs only more
            break
        seen = now
    ends = own.unionByName(loop(far.where("node = target").select("tree", "node").distinct()))
    ends = least(ends.unionByName(carried(far, ends)))
    ends = cut(least(ends.unionByName(carried(passed, ends))))
    return least(done.unionByName(ends).unionByName(carried(exits, ends)))


def path_links(paths: DataFrame) -> DataFrame:
    """(tree, node, parent, coarse, fine) of the supervision paths: each path and each of its prefixes with the prefix before it."""
    segments = F.coalesce("segments", F.split("path", "/"))
    kept = paths.select(F.filter(segments, lambda s: s.isNotNull() & (s != "")).alias("s")).where("size(s) > 0").distinct()
    up = lambda n: F.concat(F.lit("/"), F.concat_ws("/", F.slice("s", 1, n)))
    one = F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.struct(up(n).alias("node"), F.when(n > 1, up(n - 1)).alias("parent"), F.get("s", F.lit(0)).alias("coarse"), up(F.least(n, F.lit(5))).alias("fine"))))
    return kept.select(one.alias("x")).select(F.lit("paths").alias("tree"), "x.*").distinct()
