"""Parent-child links to full hierarchies (problem 1).

Method: leaves are peeled until only loops are left; each loop is cut at its smallest member, which leaves a forest;
its Euler tour is laid out as a linked list of arcs (down into a node, up out of it) and ranked in parallel. The entry
and exit numbers then give root, depth, number of descendants, ancestors and paths.

How it stays parallel: ids are unique after the first step, so a block of ids is bounded whatever the data. Peeling
and list ranking first work inside blocks (numpy, one pass over a partition) and only links that leave a block are
followed by joins, with pointer jumping, so rounds grow with the logarithm of what is left. Siblings are linked in
blocks of at most 4,096 ids, then block to block, so that a parent with a third of all rows is no single task. A path
sweep is cut into blocks of the tour; each block gets the intervals open at its start.

Defined results
* rows with a null id are dropped; repeated rows of an id count once, the latest `created_at`, then the largest
  parent and name, wins;
* no parent (null or a `none_values` entry) makes a root; a parent that does not exist makes a root with `broken`;
* a node on a loop, or below one, has `looped`; its root is the smallest id of that loop, where the loop is cut, and
  depth counts from there; a node that is its own parent is a loop of one;
* siblings are toured in the order of their ids; null names count as empty; `/` and `\\` in names are escaped by `\\`;
* an empty table gives an empty result; further columns are ignored. Ids must lie within +-2^61.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stage, unstage

#: Ids per block, nodes per local task, siblings per block, tour positions per path block (all as powers of two).
ID_BLOCK, TASK_NODES, SIBLING_BLOCK, TOUR_BLOCK = 15, 18, 12, 16


def _blocked(df: DataFrame, rows: int, col: str = "id") -> DataFrame:
    return df.repartition(max(1, math.ceil(rows / (1 << TASK_NODES))), F.shiftright(F.col(col), ID_BLOCK))


def links(components: DataFrame, none_values: tuple[int, ...] = (-1,)) -> DataFrame:
    """(id, parent, name, broken), one row per id; parent is null for roots and for parents that do not exist."""
    parent = F.col("parent_id").cast("long")
    if none_values:
        parent = F.when(~parent.isin(list(none_values)), parent)
    one = components.where("id is not null").select(F.col("id").cast("long").alias("id"), F.struct("created_at", parent.alias("parent"), F.col("name").alias("name")).alias("r"))
    one = one.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.parent", "r.name")
    ids = one.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    return one.join(ids, "parent", "left").select(
        "id", F.when(F.col("there"), F.col("parent")).alias("parent"), "name", (F.col("parent").isNotNull() & F.col("there").isNull()).alias("broken"))


def _peel(frames):
    """Remove leaves as far as they can be told inside this task; children outside are known by their number."""
    got = [f for f in frames if len(f)]
    if not got:
        return
    f = pd.concat(got)
    tally = f.parent.isna()
    kids = f[tally].groupby("id").n.sum()
    rows = f[~tally]
    ids = rows.id.to_numpy()
    order = np.argsort(ids)
    ids, parent = ids[order], rows.parent.to_numpy(dtype=np.int64)[order]
    if not len(ids):
        return
    n = kids.reindex(ids, fill_value=0).to_numpy(dtype=np.int64)
    at = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
    local = ids[at] == parent
    alive = np.ones(len(ids), bool)
    front = np.flatnonzero(n == 0)
    while len(front):
        alive[front] = False
        up = at[front[local[front]]]
        np.subtract.at(n, up, 1)
        up = np.unique(up)
        front = up[(n[up] == 0) & alive[up]]
    yield pd.DataFrame({"id": ids[alive], "parent": parent[alive]})


def loops(links_: DataFrame) -> DataFrame:
    """(id, cycle_id) of every node on a closed loop; cycle_id is its smallest member."""
    rest = stage(links_.where("parent is not null").select("id", "parent"))
    n = rest.count()
    pure = False
    while n and not pure:
        tally = rest.groupBy("parent").agg(F.count("*").alias("n")).select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), "n")
        both = rest.withColumn("n", F.lit(0).cast("long")).unionByName(tally)
        new = stage(_blocked(both, n).mapInPandas(_peel, "id long, parent long"))
        unstage(rest)
        rest, before, n = new, n, new.count()
        pure = n == before
        if not pure and n > 0.9 * before:
            break  # long chains across blocks: pointer jumping takes them from here
    # each node with the smallest id among its first 2^k parents and the pointer 2^k links up
    state = stage(rest.select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")))
    span = 1
    while n:
        t = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"), F.lit(True).alias("hit"))
        new = stage(state.join(t, "ptr", "left").select("id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        unstage(state)
        state, span = new, span * 2
        # on pure loops no change of any minimum means every window already spans its loop
        if span > n or (pure and not state.where("moved").limit(1).count()):
            break
    if pure or not n:
        return state.select("id", F.col("low").alias("cycle_id"))
    on = state.where("ptr is not null").select(F.col("ptr").alias("id")).distinct()  # more than n links up is always a loop
    return state.join(on, "id").select("id", F.col("low").alias("cycle_id"))


def _contract(frames):
    """Follow the list of arcs backwards as long as it stays in this task. Per arc: the arc where it entered the task,
    and hops and sum of +1 (down) and -1 (up) from there."""
    got = [f for f in frames if len(f)]
    if not got:
        return
    f = pd.concat(got).sort_values("id", kind="stable")
    ids = f.id.to_numpy()
    n = len(ids)
    prev = np.empty(2 * n, np.int64)
    root = f.down_prev.isna().to_numpy()
    prev[0::2] = f.down_prev.fillna(0).to_numpy(dtype=np.int64)
    prev[1::2] = f.up_prev.to_numpy(dtype=np.int64)
    is_root = np.zeros(2 * n, bool)
    is_root[0::2] = root
    at = np.minimum(np.searchsorted(ids, prev >> 1), n - 1)
    local = (ids[at] == prev >> 1) & ~is_root
    me = np.arange(2 * n)
    ptr = np.where(local, 2 * at + (prev & 1), me)
    hops = local.astype(np.int64)
    total = np.where(local, np.where(me & 1, -1, 1), 0)
    while True:
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            break
        hops, total, ptr = hops + hops[ptr], total + total[ptr], nxt
    entry = 2 * ids[ptr >> 1] + (ptr & 1)
    outside = ~local & ~is_root
    link = lambda s: pd.array(np.where(outside[s], prev[s], 0), dtype="Int64")
    out = pd.DataFrame({"id": ids, "d_in": entry[0::2], "d_hops": hops[0::2], "d_sum": total[0::2], "u_in": entry[1::2], "u_hops": hops[1::2], "u_sum": total[1::2],
                        "d_link": link(slice(0, None, 2)), "u_link": link(slice(1, None, 2)), "root": root})
    out.loc[~outside[0::2], "d_link"] = pd.NA
    out.loc[~outside[1::2], "u_link"] = pd.NA
    yield out


def tour(components: DataFrame, none_values: tuple[int, ...] = (-1,)) -> DataFrame:
    """(id, parent, name, broken, looped, root, depth, entry, exit, descendants) of every node. u is below v exactly if both
    have the same root and entry(v) < entry(u) < exit(v); `parent` is null at a root and where a loop is cut."""
    all_links = stage(links(components, none_values))
    ring = stage(loops(all_links))
    f = all_links.join(ring.where("id = cycle_id").select("id", F.lit(True).alias("cut")), "id", "left")
    nodes = stage(f.select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "name", "broken", F.coalesce("cut", F.lit(False)).alias("cut")))
    n = nodes.count()
    # siblings: inside a block of ids by window, then block to block
    sib = nodes.where("parent is not null").select("id", "parent", F.shiftright("id", SIBLING_BLOCK).alias("sb"))
    inside = sib.withColumn("before", F.lag("id").over(Window.partitionBy("parent", "sb").orderBy("id")))
    heads = inside.groupBy("parent", "sb").agg(F.max("id").alias("last")).withColumn("before_block", F.lag("last").over(Window.partitionBy("parent").orderBy("sb")))
    before = inside.join(heads, ["parent", "sb"]).select("id", F.coalesce("before", "before_block").alias("before"))
    last = sib.groupBy("parent").agg(F.max("id").alias("last")).select(F.col("parent").alias("id"), "last")
    arcs = nodes.select("id", "parent", "cut").join(before, "id", "left").join(last, "id", "left").select(
        "id", F.when(F.col("before").isNotNull(), 2 * F.col("before") + 1).otherwise(2 * F.col("parent")).alias("down_prev"),
        F.when(F.col("last").isNotNull(), 2 * F.col("last") + 1).otherwise(2 * F.col("id")).alias("up_prev"))
    near = stage(_blocked(arcs, n).mapInPandas(
        _contract, "id long, d_in long, d_hops long, d_sum long, u_in long, u_hops long, u_sum long, d_link long, u_link long, root boolean"))
    # what is left: one element per arc that enters a block, pointing to the arc in another block before it
    jumps = near.where("d_link is not null").select((2 * F.col("id")).alias("arc"), F.col("d_link").alias("link"), F.lit(1).alias("val")).unionByName(
        near.where("u_link is not null").select((2 * F.col("id") + 1).alias("arc"), F.col("u_link").alias("link"), F.lit(-1).alias("val")))
    target = near.select(F.col("id").alias("node"), "d_in", "d_hops", "d_sum", "u_in", "u_hops", "u_sum")
    up = F.col("link").bitwiseAND(F.lit(1)) == 1
    start = near.where("root").select((2 * F.col("id")).alias("arc"), F.lit(None).cast("long").alias("ptr"), F.lit(0).cast("long").alias("hops"), F.lit(1).cast("long").alias("sum"), F.col("id").alias("root"))
    lists = stage(start.unionByName(jumps.withColumn("node", F.shiftright("link", 1)).join(target, "node").select(
        "arc", F.when(up, F.col("u_in")).otherwise(F.col("d_in")).alias("ptr"), (F.when(up, F.col("u_hops")).otherwise(F.col("d_hops")) + 1).alias("hops"),
        (F.when(up, F.col("u_sum")).otherwise(F.col("d_sum")) + F.col("val")).alias("sum"), F.lit(None).cast("long").alias("root"))))
    while lists.where("ptr is not null").limit(1).count():
        t = lists.select(F.col("arc").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("hops").alias("hops2"), F.col("sum").alias("sum2"), F.col("root").alias("root2"))
        new = stage(lists.where("ptr is null").unionByName(lists.where("ptr is not null").join(t, "ptr").select(
            "arc", F.col("ptr2").alias("ptr"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("sum") + F.col("sum2")).alias("sum"), F.col("root2").alias("root"))))
        unstage(lists)
        lists = new
    d = lists.select(F.col("arc").alias("d_in"), F.col("hops").alias("d0"), F.col("sum").alias("s0"), "root")
    u = lists.select(F.col("arc").alias("u_in"), F.col("hops").alias("u0"))
    ranked = near.select("id", "d_in", "d_hops", "d_sum", "u_in", "u_hops").join(d, "d_in").join(u, "u_in").select(
        "id", "root", (F.col("s0") + F.col("d_sum") - 1).alias("depth"), (F.col("d0") + F.col("d_hops")).alias("entry"), (F.col("u0") + F.col("u_hops")).alias("exit"))
    ranked = ranked.join(nodes.select("id", "parent", "name", "broken"), "id").join(ring.where("id = cycle_id").select(F.col("id").alias("root"), F.lit(True).alias("looped")), "root", "left")
    return ranked.select("id", "parent", "name", "broken", F.coalesce("looped", F.lit(False)).alias("looped"), "root", "depth", "entry", "exit",
                         F.expr("(exit - entry - 1) div 2").alias("descendants"))


def _sweep(frames):
    """Rows come by (root, block, entry); the stack holds the intervals open at the current position."""
    here, stack = None, []
    for f in frames:
        out_id, out_path, out_ids = [], [], []
        for root, block, entry, exit_, id_, name, own in zip(f.root, f.block, f.entry, f.exit, f.id, f.name_, f.own):
            if (root, block) != here:
                here, stack = (root, block), []
            while stack and stack[-1][0] < entry:
                stack.pop()
            name = "" if name is None else name.replace("\\", "\\\\").replace("/", "\\/")
            path = f"{stack[-1][2]}/{name}" if stack else name
            if own:
                out_id.append(id_)
                out_path.append(path)
                out_ids.append([s[1] for s in stack])
            stack.append((exit_, id_, path))
        yield pd.DataFrame({"id": out_id, "path": out_path, "ancestors": out_ids})


def paths(tour_: DataFrame) -> DataFrame:
    """(id, path, ancestors): names and ids from the root down, by a stack swept over the entry-exit intervals."""
    block = lambda c: F.shiftright(c, TOUR_BLOCK)
    cols = ["root", "entry", "exit", "id", F.col("name").alias("name_")]
    own = tour_.select(*cols, block("entry").alias("block"), F.lit(True).alias("own"))
    over = tour_.where(block("exit") > block("entry")).select(*cols, F.explode(F.sequence(block("entry") + 1, block("exit"))).alias("block"), F.lit(False).alias("own"))
    rows = own.unionByName(over).repartition("root", "block").sortWithinPartitions("root", "block", "entry")
    return rows.select("root", "block", "entry", "exit", "id", "name_", "own").mapInPandas(_sweep, "id long, path string, ancestors array<long>")


def descendants(tour_: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, descendant, hops) of every node, or of those whose id is in `wanted` (column id), by interval containment: the nodes
    are read off the ancestors of the sweep, so nothing is compared pairwise."""
    t = stage(tour_)
    pairs = paths(t).select(F.col("id").alias("descendant"), F.posexplode(F.reverse("ancestors")).alias("up", "id"))
    if wanted is not None:
        pairs = pairs.join(wanted.select("id").distinct(), "id", "left_semi")
    return pairs.select("id", "descendant", (F.col("up") + 1).alias("hops"))


def looped(components: DataFrame, none_values: tuple[int, ...] = (-1,)) -> DataFrame:
    """(cycle_id, component_id) of every node on a loop or below one, from the tour's roots."""
    return tour(components, none_values).where("looped").select(F.col("root").alias("cycle_id"), F.col("id").alias("component_id"))
