"""Pattern growth over the neighbour graph.

Rows join patterns in ascending id order, so the decision of a row depends only on
its neighbours with smaller ids. That makes growth the evaluation of an acyclic graph:
id ranges resolve in parallel, each as far as its inputs are known, and a round hands
the new decisions to the rows that wait for them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.operators.neighbours import (
    Grid,
    Groups,
    forest_edges,
    group_copies,
    head_edges,
    keep_top,
    linkage_edges,
    preceding,
    search,
    spanning,
    with_vector_key,
)
from fieldpulse.operators.vector_index import VectorIndex
from fieldpulse.runtime import as_table, cut, dense_ids

BLOCK_ROWS = 10_000
# Smaller ranges grow with the rows up to that, so that their rounds stay about this many.
RANGES = 32
# Edges between components that one group may finish; more are contracted in rounds first.
TAIL_EDGES = 65_536


_DECIDED = "block int, i bigint, cluster bigint, join_sim double, j bigint, sim double, rk int"
_DECIDED_COLUMNS = [c.split()[0] for c in _DECIDED.split(", ")]


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Resolve the rows of one id range whose voters are all known; the votes of the others are handed back.

    Most votes win, then the strongest match, then the first voter in rank order. A decision has no voter: ``rk`` is -1.
    """
    pdf = pdf.sort_values(["i", "rk"], kind="stable")
    row, voter, sims, owners = (pdf[c].tolist() for c in ("i", "j", "sim", "cluster"))
    known: dict[int, int] = {}
    out = []
    start, n = 0, len(row)
    kept = np.zeros(n, bool)
    while start < n:
        i, end = row[start], start
        support: dict[int, tuple[int, float]] = {}
        waits = False
        while end < n and row[end] == i:
            owner = owners[end] if owners[end] >= 0 else known.get(voter[end], -1)
            waits = waits or owner < 0
            votes, best = support.get(owner, (0, sims[end]))
            support[owner] = (votes + 1, best)
            end += 1
        if waits:
            kept[start:end] = True
        else:
            winner = max(support, key=support.get)
            known[i] = winner
            out.append((i, winner, support[winner][1]))
        start = end
    decided = pd.DataFrame(out, columns=["i", "cluster", "join_sim"])
    decided = decided.assign(block=pdf["block"].iloc[0], j=-1, sim=0.0, rk=-1)
    return pd.concat([decided, pdf[kept].assign(join_sim=0.0)])[_DECIDED_COLUMNS]


def range_count(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // max(block_rows, min(BLOCK_ROWS, -(-rows // RANGES)))))


def resolve_in_order(
    nodes: DataFrame, votes: DataFrame, node_count: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(i, cluster, join_sim)`` for every node.

    ``votes`` is ``(i, j, sim, rk, cluster)``: row ``i`` listens to ``j``, whose cluster is given
    or, when NULL, is decided here because ``j`` is a node with a smaller id. A node
    without votes founds a cluster. Ids must not be negative.

    A range has ``block_rows`` rows; one smaller than ``BLOCK_ROWS`` grows with the rows, to one in ``RANGES`` of them at most.
    The lowest unresolved id range always completes, so the number of rounds is at most
    the number of ranges and at most the depth of the graph. A range runs again only when another
    range has decided a row that it waits for.
    """
    blocks = range_count(node_count, block_rows)
    # Written once: the ranges are sampled before rows go to them.
    votes = as_table(votes.select("i", "j", "sim", "rk", "cluster"), "votes")
    votes = votes.repartitionByRange(blocks, "i").withColumn("block", F.spark_partition_id())
    votes = as_table(votes.select("block", "i", "j", "sim", "rk", "cluster"), "ranges")
    listeners = votes.select("i").distinct()
    founders = nodes.select("i").join(listeners, "i", "left_anti").select(
        "i", F.col("i").alias("cluster"), F.lit(1.0).alias("join_sim")
    )
    # A voter that listens to nobody is a founder, so its cluster is its own id.
    pending = votes.join(
        listeners.select(F.col("i").alias("j"), F.lit(True).alias("_waits")), "j", "left"
    ).select(
        "block", "i", "j", "sim", F.col("rk").cast("int").alias("rk"),
        F.coalesce("cluster", F.when(F.col("_waits"), F.lit(-1)).otherwise(F.col("j")))
        .cast("bigint").alias("cluster"),
        F.lit(True).alias("_news"),
    )
    left = listeners.count()
    resolved = [founders]
    while left:
        # Numbers of ranges, at most as many as there are.
        called = F.col("block").isin([r["block"] for r in pending.filter("_news").select("block").distinct().collect()])
        looked = as_table(
            pending.filter(called).drop("_news").repartition(blocks, "block").groupBy("block").applyInPandas(_decide, _DECIDED), "decided"
        )
        done = looked.filter("rk < 0").select("block", "i", "cluster", "join_sim")
        newly = done.count()
        if newly == 0:
            raise RuntimeError(f"{left} rows cannot be resolved: the votes are not acyclic")
        resolved.append(done.drop("block"))
        left -= newly
        if len(resolved) > 50:
            # Many rounds: fold their results so that the plan stays short.
            resolved = [as_table(reduce(DataFrame.unionByName, resolved), "resolved")]
        if left:
            answers = done.select(F.col("i").alias("j"), F.col("cluster").alias("_known"), F.col("block").alias("_from"))
            told = (F.col("cluster") < 0) & F.col("_known").isNotNull() & (F.col("_from") != F.col("block"))
            votes = ["block", "i", "j", "sim", "rk", "cluster"]
            pending = as_table(
                pending.filter(~called).select(votes).unionByName(looked.filter("rk >= 0").select(votes))
                .join(answers, "j", "left")
                .select(
                    "block", "i", "j", "sim", "rk",
                    F.when(F.col("cluster") < 0, F.coalesce("_known", "cluster"))
                    .otherwise(F.col("cluster")).alias("cluster"),
                    F.coalesce(told, F.lit(False)).alias("_news"),
                ),
                "pending",
            )
    return reduce(DataFrame.unionByName, resolved)


def _followers(units: DataFrame, groups: Groups, heads: DataFrame) -> DataFrame:
    """Copies beyond the id list: all their neighbours are the listed copies, so they
    decide exactly as the last listed one does."""
    full = groups.table.select("vec", F.element_at("ids", -1).alias("_last"))
    rows = (
        with_vector_key(units)
        .join(with_vector_key(full), ["_vh", "vec"])
        .filter(F.col("id") > F.col("_last"))
        .select(F.col("id").alias("i"), "_last")
    )
    owners = heads.select(F.col("i").alias("_last"), "cluster")
    return rows.join(owners, "_last").select("i", "cluster", F.lit(1.0).alias("join_sim"))


def grow(
    units: DataFrame,
    floor: float = settings.SIMILARITY_FLOOR,
    cap: int = settings.NEIGHBOUR_CAP,
    grid: Grid = Grid(),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(i, cluster, join_sim)`` for every row; a cluster is named by its founding id."""
    groups = group_copies(units, cap + 1)
    nodes = groups.table.select(F.explode("ids").alias("i"))
    votes = head_edges(groups, floor, cap, grid).filter(F.col("j") < F.col("i"))
    heads = resolve_in_order(
        nodes, votes.withColumn("cluster", F.lit(None).cast("bigint")), groups.heads, block_rows
    )
    if not groups.has_followers:
        return heads
    heads = cut(heads)
    return heads.unionByName(_followers(units, groups, heads))


def assign_new(
    new_units: DataFrame,
    old_units: DataFrame,
    members: DataFrame,
    floor: float = settings.SIMILARITY_FLOOR,
    cap: int = settings.NEIGHBOUR_CAP,
    grid: Grid = Grid(),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Place newly arrived rows as if they came after all existing ones.

    ``members`` is ``(i, cluster)`` of the old rows that belong to a pattern; they keep it. A
    new row takes its ``cap`` nearest rows of both sets, listens to the old pattern members
    and smaller new rows among them, and decides as in :func:`grow`. The two id sets are disjoint.
    """
    near = search(new_units, old_units.unionByName(new_units), floor, cap, grid)
    owners = members.select(F.col("i").alias("j"), F.col("cluster").alias("_owner"))
    fresh = new_units.select(F.col("id").alias("j"), F.lit(True).alias("_new"))
    votes = (
        near.join(owners, "j", "left")
        .join(fresh, "j", "left")
        .filter(F.col("_owner").isNotNull() | (F.col("_new") & (F.col("j") < F.col("i"))))
        .select("i", "j", "sim", "rk", F.col("_owner").alias("cluster"))
    )
    nodes = new_units.select(F.col("id").alias("i"))
    return resolve_in_order(nodes, votes, nodes.count(), block_rows)


def place_arrivals(
    index: VectorIndex,
    members: DataFrame,
    arrivals: DataFrame,
    floor: float = settings.SIMILARITY_FLOOR,
    cap: int = settings.NEIGHBOUR_CAP,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(i, cluster, join_sim)`` of newly arrived rows, placed among the stored ones without reading them all.

    A row listens to its ``cap`` nearest rows among those before it: the stored ones and the arrivals of smaller
    ids. Stored rows vote if ``members (i, cluster)`` has them. As no row looks at later ones, arrivals in
    batches of ascending ids, each appended to the index after its placement and its decisions added to
    ``members``, end up as they would in one batch.
    """
    ahead = preceding(arrivals, floor, cap, index.grid).withColumn("_new", F.lit(True))
    stored = index.search(arrivals, floor, cap).withColumn("_new", F.lit(False))
    near = keep_top(ahead.unionByName(stored).drop("rk"), "i", "j", cap)
    owners = members.select(F.col("i").alias("j"), F.col("cluster").alias("cluster"))
    votes = near.join(owners, "j", "left").filter(F.col("cluster").isNotNull() | F.col("_new")).select("i", "j", "sim", "rk", "cluster")
    nodes = arrivals.select(F.col("id").alias("i"))
    return resolve_in_order(nodes, votes, nodes.count(), block_rows)


def keep_large(assigned: DataFrame, min_members: int = settings.MIN_PATTERN_MEMBERS) -> DataFrame:
    """Clusters of at least ``min_members`` rows: ``(cluster, member_count)``."""
    return (
        assigned.groupBy("cluster")
        .agg(F.count("*").alias("member_count"))
        .filter(F.col("member_count") >= min_members)
    )


def connected_components(
    units: DataFrame, floor: float, grid: Grid = Grid()
) -> DataFrame:
    """``(id, component)``: order-independent linkage, named by the smallest id."""
    groups = group_copies(units, 1)
    labels = component_labels(groups.table.select(F.col("rep").alias("u")), linkage_edges(groups, floor, grid))
    return _every_copy(units, groups, labels)


def _every_copy(units: DataFrame, groups: Groups, labels: DataFrame) -> DataFrame:
    """``(id, component)`` of all rows from the labels ``(u, label)`` of their vectors."""
    named = groups.table.join(labels.select(F.col("u").alias("rep"), F.col("label").alias("component")), "rep")
    if not groups.has_copies:
        return named.select(F.col("rep").alias("id"), "component")
    return with_vector_key(units).join(
        with_vector_key(named.select("vec", "component")), ["_vh", "vec"]
    ).select("id", "component")


def _strongest(outer: DataFrame, order: Column, *columns: str) -> DataFrame:
    """``(c, d, ...)``: for each component of the edges ``(cu, cv, ...)`` its first one by ``order`` and the other end of it."""
    ends = outer.select(
        F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("d")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("d")))).alias("_e"),
        order.alias("o"), *columns,
    )
    best = ends.groupBy("_e.c").agg(F.max_by(F.struct("_e.d", *columns), "o").alias("_b"))
    return as_table(best.select("c", "_b.*"), "strongest")


def _roots(best: DataFrame) -> DataFrame:
    """``(c, root)`` where every component ``c`` follows ``d``; only two that follow each other close a cycle.

    Pointers double in a round, so rounds follow the logarithm of the longest way.
    """
    other = best.select(F.col("c").alias("d"), F.col("d").alias("_back"))
    roots = as_table(best.select("c", "d").join(other, "d").select(
        "c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("root")
    ), "roots")
    while True:
        ahead = roots.select(F.col("c").alias("root"), F.col("root").alias("_next"))
        moved = as_table(roots.join(ahead, "root").select("c", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")), "roots")
        roots = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return roots


def _contracted(outer: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges ``(cu, cv, ...)`` between different components once all follow their roots."""
    for end in ("cu", "cv"):
        outer = outer.join(roots.toDF(end, "_root"), end).drop(end).withColumnRenamed("_root", end)
    return outer.filter("cu <> cv")


def _one_of_each(outer: DataFrame, order: Column, *columns: str) -> DataFrame:
    """Of the edges between the same two components the first by ``order``, both ways the same."""
    pair = (F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))
    if not columns:
        return outer.select(*pair).distinct()
    best = outer.select(*pair, order.alias("o"), F.struct(*columns).alias("_b")).groupBy("cu", "cv").agg(F.max_by("_b", "o").alias("_b"))
    return best.select("cu", "cv", "_b.*")


def _tail_labels(table: pa.Table) -> pa.Table:
    cu, cv = (table[c].to_numpy() for c in ("cu", "cv"))
    _, ids, lows = spanning(cu, cv, np.zeros(len(cu)))
    return pa.table({"c": ids, "root": lows})


def _tail_edges(table: pa.Table) -> pa.Table:
    kept, _, _ = spanning(*(table[c].to_numpy() for c in ("cu", "cv", "sim")))
    return table.take(pa.array(kept)).select(["u", "v", "sim"])


def component_labels(nodes: DataFrame, edges: DataFrame, tail_edges: int = TAIL_EDGES) -> DataFrame:
    """``(u, label)`` for nodes ``(u)`` under edges ``(u, v)``; a label is the smallest node reachable.

    In a round every component follows one of its edges, so those with edges at least halve. The last ``tail_edges``
    edges at most are one group.
    """
    outer = edges.select(F.col("u").alias("cu"), F.col("v").alias("cv")).filter("cu <> cv")
    order, steps = F.struct(-F.least("cu", "cv"), -F.greatest("cu", "cv")), []
    while True:
        outer = as_table(_one_of_each(outer, order), "outer")
        left = outer.count()
        if left <= tail_edges:
            break
        steps.append(_roots(_strongest(outer, order)))
        outer = _contracted(outer, steps[-1])
    if left:
        steps.append(as_table(outer.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_tail_labels, "c bigint, root bigint"), "roots"))
    named = nodes.select("u", F.col("u").alias("label"))
    for step in steps:
        named = named.join(step.select(F.col("c").alias("label"), F.col("root").alias("_root")), "label", "left").select(
            "u", F.coalesce("_root", "label").alias("label")
        )
    if not steps:
        return named
    named = as_table(named, "named")
    lowest = named.groupBy("label").agg(F.min("u").alias("_low"))
    return named.join(lowest, "label").select("u", F.col("_low").alias("label"))


@dataclass(frozen=True)
class Forest:
    """A spanning forest of the greatest similarities: ``edges (u, v, sim)`` over the vectors of ``units``, down to ``floor``."""

    units: DataFrame
    groups: Groups
    edges: DataFrame
    floor: float

    def components(self, floor: float) -> DataFrame:
        """``(id, component)`` at any floor from the forest's own on, as :func:`connected_components` gives."""
        if floor < self.floor:
            raise ValueError(f"the forest was grown down to {self.floor}")
        nodes = self.groups.table.select(F.col("rep").alias("u"))
        return _every_copy(self.units, self.groups, component_labels(nodes, self.edges.filter(F.col("sim") >= floor).select("u", "v")))


def linkage_forest(units: DataFrame, floor: float, grid: Grid = Grid(), tail_edges: int = TAIL_EDGES) -> Forest:
    """Single linkage at every floor from ``floor`` on, grown once.

    Every unit of the block join keeps a spanning forest of its own pairs; a pair that it leaves out closes a cycle of
    pairs at least as similar, so it joins nothing at any floor. Borůvka rounds over what is left
    take the best edge out of every component and keep the best between any two; components at least halve in a round,
    and the last ``tail_edges`` edges at most are one group.
    """
    groups = group_copies(units, 1)
    kept = as_table(forest_edges(groups, floor, grid), "forest")
    outer = kept.filter("u <> v").select("u", "v", "sim", F.col("u").alias("cu"), F.col("v").alias("cv"))
    # A total order of the edges, so that the best edges of a round close no cycle.
    order, edge = F.struct("sim", -F.least("u", "v"), -F.greatest("u", "v")), ("u", "v", "sim")
    chosen = []
    while (left := outer.count()) > tail_edges:
        best = _strongest(outer, order, *edge)
        chosen.append(best.select(*edge).distinct())
        outer = as_table(_one_of_each(_contracted(outer, _roots(best)), order, *edge), "outer")
    if left:
        chosen.append(as_table(outer.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_tail_edges, "u bigint, v bigint, sim double"), "tail"))
    edges = reduce(DataFrame.unionByName, chosen) if chosen else kept.limit(0)
    return Forest(units, groups, edges, floor)


def number_patterns(kept: DataFrame) -> DataFrame:
    """``(cluster, member_count, pattern_id)``: ids 1..n in order of the founding row."""
    return dense_ids(kept, "cluster", "pattern_id")


def formation_report(assigned: DataFrame, min_members: int = settings.MIN_PATTERN_MEMBERS) -> DataFrame:
    """One row: pool size, patterns formed and discarded, members assigned and not."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    big = F.col("n") >= min_members
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pool_size"),
        F.count_if(big).alias("patterns_formed"),
        F.count_if(~big).alias("patterns_discarded_below_min"),
        F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).alias("members_assigned"),
        F.coalesce(F.sum(F.when(~big, F.col("n"))), F.lit(0)).alias("members_unassigned"),
    )
