"""Neighbours, formation, sweeps, shortlist and assessment over ``embeddings``."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.catalog import bindings as b
from fieldpulse.catalog.registry import query, quoted as _quote
from fieldpulse.functions.vectors import centroids, parse_vector
from fieldpulse.operators.cells import Grid
from fieldpulse.operators.cluster import assign_new, connected_components, grow, keep_large, linkage_forest, place_arrivals
from fieldpulse.operators.merge import last_wins
from fieldpulse.operators.neighbours import neighbours, pool, scoped_search, search, threshold_counts
from fieldpulse.operators.vector_index import VectorIndex
from fieldpulse.plans import formation
from fieldpulse.plans.coherence import breaking_rank, coherence
from fieldpulse.plans.formation import form_members, formation_pool, member_facts, pattern_name
from fieldpulse.plans.inbox import ranking, sample_narratives
from fieldpulse.plans.novelty import (
    INSTRUCTIONS,
    Assessment,
    assess,
    assessment_report,
    pattern_vehicles,
    prompts,
    search_result,
    shortlist,
)
from fieldpulse.plans.profile import sharing_components, top_k_sweep
from fieldpulse.plans.scoring import score_patterns
from fieldpulse.runtime import as_table, cut, scratch_path
from fieldpulse.sources.tables import load_snapshot, save_snapshot

FLOOR, CAP, MIN = 0.30, 25, 5


# A sum weighted by position shows a change of any component.
_WEIGHTED_SQL = (
    "round(list_sum(list_transform(embedding::double[], lambda x, i: x * i))"
    " / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 3)"
)


def _weighted(name: str):
    products = F.transform(name, lambda x, i: x * (i + 1))
    return F.round(F.aggregate(products, F.lit(0.0), lambda total, x: total + x), 3).alias("weighted")


def units(spark: SparkSession, sf: str) -> DataFrame:
    return pool(b.table(spark, sf, "embeddings"), "vec_id", "embedding")


def _pairs_sql(name: str, left: str, right: str, on: str = "a.vec_id <> b.vec_id") -> str:
    """Ranked neighbour pairs above the floor from one set of vectors to another."""
    return f"""
{name} as (
  select i, j, sim, row_number() over (partition by i order by sim desc, j) as rk from (
    select a.vec_id as i, b.vec_id as j,
           list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim
    from {left} a join {right} b on {on})
  where sim >= {FLOOR})"""


def _grow_sql(p: str, source: str, votes: str) -> str:
    """Rows of ``source`` in id order, each joining the cluster most of its voters belong to.

    ``votes`` selects ``i, j, sim, rk, c`` with the voter's cluster, NULL when it is a row of ``source``.
    """
    return f"""
{p}votes as materialized (
  select i, list({{'j': j, 's': sim, 'rk': rk, 'c': c}} order by rk) as l from ({votes}) group by i),
{p}ordered as materialized (
  select vec_id as i, row_number() over (order by vec_id) as pos, l
  from {source} left join {p}votes on i = vec_id),
{p}walk(pos, owner, strength) as (
  select 0::bigint, map([]::bigint[], []::bigint[]), map([]::bigint[], []::double[])
  union all
  select pos, map_concat(owner, map([i], [coalesce(w.c, i)])),
         map_concat(strength, map([i], [coalesce(w.ms, 1.0)]))
  from (select o.pos, w0.owner, w0.strength, o.i,
               (select {{'c': c, 'ms': ms}} from
                  (select coalesce(x.c, w0.owner[x.j]) as c, count(*) as n, max(x.s) as ms, min(x.rk) as first_rk
                   from (select unnest(o.l) as x) group by 1) order by n desc, ms desc, first_rk limit 1) as w
        from {p}walk w0 join {p}ordered o on o.pos = w0.pos + 1)),
{p}final as (select owner, strength from {p}walk order by pos desc limit 1),
{p}assigned as (
  select unnest(map_keys(owner)) as i, unnest(map_values(owner)) as cluster,
         unnest(map_values(strength)) as join_sim from {p}final),
{p}counted as (select *, count(*) over (partition by cluster) as n from {p}assigned)"""


_LOWER = f"select i, j, sim, rk, null::bigint as c from {{}} where rk <= {CAP} and j < i"

_PAIRS = _pairs_sql("pairs", "embeddings", "embeddings")

_GROW = _PAIRS + "," + _grow_sql("", "embeddings", _LOWER.format("pairs")) + f""",
formed as (
  select dense_rank() over (order by cluster) as pattern_id, i as odi_number, join_sim as similarity, n
  from counted where n >= {MIN})"""

_PLACED = f"""with recursive
settled as (select e.* from embeddings e join orders on o_orderkey = vec_id where o_orderstatus = 'F'),
fresh as (select e.* from embeddings e join orders on o_orderkey = vec_id where o_orderstatus <> 'F'),
everyone as (select * from settled union all select * from fresh),
{_pairs_sql("old_pairs", "settled", "settled")}, {_grow_sql("old_", "settled", _LOWER.format("old_pairs"))},
{_pairs_sql("new_pairs", "fresh", "everyone")},
kept as (select i as k, cluster as kept_cluster from old_counted where n >= {MIN}),
{_grow_sql("new_", "fresh", f"""
    select i, j, sim, rk, kept_cluster as c from new_pairs left join kept on k = j
    where rk <= {CAP} and (kept_cluster is not null or (j < i and j in (select vec_id from fresh)))""")}
select i as odi_number, cluster as seed, round(join_sim, 4) as similarity from new_assigned"""


@query(
    "knn_floor_cap",
    f"with {_PAIRS} select i, j, round(sim, 4) as sim, rk::bigint as rk from pairs where rk <= {CAP}",
)
def knn_floor_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = neighbours(units(spark, sf), FLOOR, CAP)
    return rows.select("i", "j", F.round("sim", 4).alias("sim"), F.col("rk").cast("bigint").alias("rk"))


@query(
    "knn_cells",
    f"with {_PAIRS} select i, j, round(sim, 4) as sim, rk::bigint as rk from pairs where rk <= {CAP}",
)
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same lists with about two vectors to a cell, so that hundreds of cells are bounded, visited and cut."""
    rows = neighbours(units(spark, sf), FLOOR, CAP, Grid(rows_per_cell=2))
    return rows.select("i", "j", F.round("sim", 4).alias("sim"), F.col("rk").cast("bigint").alias("rk"))


@query(
    "form_patterns",
    f"with recursive {_GROW} select pattern_id::bigint as pattern_id, odi_number, "
    "round(similarity, 4) as similarity from formed",
)
def form_patterns(spark: SparkSession, sf: str) -> DataFrame:
    members, _, _ = form_members(units(spark, sf), FLOOR, CAP, MIN)
    return members.select("pattern_id", "odi_number", F.round("similarity", 4).alias("similarity"))


@query(
    "form_patterns_ranges",
    f"with recursive {_GROW} select pattern_id::bigint as pattern_id, odi_number, "
    "round(similarity, 4) as similarity from formed",
)
def form_patterns_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same formation with its ids in ranges of 50 rows, or more where that would be very many, which hand decisions on to each other."""
    members, _, _ = form_members(units(spark, sf), FLOOR, CAP, MIN, block_rows=50)
    return members.select("pattern_id", "odi_number", F.round("similarity", 4).alias("similarity"))


@query(
    "formation_report",
    f"""with recursive {_GROW},
sizes as (select cluster, count(*) as n from assigned group by 1)
select sum(n)::bigint as pool_size, count(*) filter (where n >= {MIN}) as patterns_formed,
       count(*) filter (where n < {MIN}) as patterns_discarded_below_min,
       coalesce(sum(n) filter (where n >= {MIN}), 0)::bigint as members_assigned,
       coalesce(sum(n) filter (where n < {MIN}), 0)::bigint as members_unassigned from sizes""",
)
def formation_counts(spark: SparkSession, sf: str) -> DataFrame:
    from fieldpulse.operators.cluster import formation_report

    return formation_report(grow(units(spark, sf), FLOOR, CAP), MIN)


_NAMES = """
fleet as (
  select pattern_id, make, model, count(*) as n from formed join reports using (odi_number) group by all),
top_fleet as (
  select pattern_id, arg_min({'make': make, 'model': model}, (-n, make, model)) as v, max(n) as top_n,
         sum(n) as total, count(*) as kinds from fleet group by 1),
parts as (
  select pattern_id, component, count(*) as n from (
    select pattern_id, unnest(components) as component from formed join reports using (odi_number))
  group by all),
top_part as (select pattern_id, arg_min(component, (-n, component)) as component from parts group by 1),
named as (
  select f.pattern_id, v.make || ' ' || v.model
         || case when top_n = total then '' else ' +' || (kinds - 1) || ' other' end
         || ' — ' || coalesce(component, 'uncategorised') as name,
         v.make || ' ' || v.model as vehicle, kinds as vehicles
  from top_fleet f left join top_part using (pattern_id))"""

_RANKED = f"""with recursive {b.SQL_REPORTS}, {_GROW}, {_NAMES},
hits as (
  select pattern_id, any_value(n) as member_count,
         count(*) filter (where date_of_incident >= date '1998-06-30' and date_of_incident <= date '1999-06-30') as recent_count,
         count(*) filter (where date_of_incident >= date '1995-07-01' and date_of_incident < date '1998-06-30') as baseline_count
  from formed join reports using (odi_number) group by 1),
rated as (
  select *, case when baseline_count > 0
                 then (recent_count / {b.RECENT}.0::double) / (baseline_count / {b.BASELINE}.0::double) end as ratio
  from hits),
kinds as (
  select pattern_id, category, count(*) as n from (
    select pattern_id, unnest(coalesce(components_coarse, ['UNCATEGORISED'])) as category
    from formed join reports using (odi_number)) group by all),
top_kind as (select pattern_id, arg_min(category, (-n, category)) as category from kinds group by 1)
select pattern_id::bigint as id, name, member_count::bigint as member_count,
       recent_count::bigint as recent_count, baseline_count::bigint as baseline_count,
       round(ratio, 6) as ratio,
       case when ratio is null then null when ratio >= 4 then 'high' when ratio >= 2 then 'medium'
            when ratio >= 1 then 'low' else 'none' end as severity,
       vehicle, vehicles::bigint as vehicles, category
from rated join named using (pattern_id) left join top_kind using (pattern_id)"""


@query("patterns_ranked", _RANKED)
def patterns_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to ranked, named, scored patterns, from end to end."""
    members, sizes, _ = form_members(units(spark, sf), FLOOR, CAP, MIN)
    members = cut(members)
    reports = b.reports(spark, sf)
    mine = as_table(reports.join(members.select("odi_number"), "odi_number", "left_semi"), "reports")
    patterns = sizes.withColumnRenamed("pattern_id", "id")
    scores = score_patterns(patterns, members, mine, b.TODAY, b.RECENT, b.BASELINE)
    facts = member_facts(members, mine, "vehicle", "category", "component").select(
        F.col("pattern_id").alias("id"), "vehicle", "vehicle_n", "vehicle_kinds", "category", "component"
    )
    return (
        patterns.withColumn("state", F.lit("new"))
        .join(scores, "id")
        .join(facts, "id")
        .withColumn("name", pattern_name(F.col("member_count")))
        .withColumn("vehicles", F.col("vehicle_kinds"))
        .orderBy(*ranking())
        .select(
            "id", "name", F.col("member_count").cast("bigint").alias("member_count"), "recent_count",
            "baseline_count", F.round("ratio", 6).alias("ratio"), "severity", "vehicle", "vehicles",
            "category",
        )
    )


@query(
    "rebuild_patterns",
    f"""with recursive {b.SQL_REPORTS}, {_GROW}, {_NAMES}
select pattern_id::bigint as id, name, count(*) as member_count, 'new' as state, count(*) as members,
       round(sum(similarity), 2) as similarity
from formed join named using (pattern_id) group by all""",
)
def rebuild_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A formation from scratch published as the second version, read back from there."""
    root = scratch_path(spark, "formation")
    reports = b.reports(spark, sf).withColumn("is_failure_report", F.lit(True))
    now = F.lit("2000-02-01 00:00:00").cast("timestamp")
    patterns, members, _ = formation.form_patterns(reports, _vectors(spark, sf), now, FLOOR, CAP, MIN)
    stale = patterns.withColumns({"id": F.col("id") + 1, "name": F.lit("stale")})
    for version, rows in ((1, stale), (2, patterns)):
        save_snapshot(rows, root, "patterns", version)
    save_snapshot(members, root, "pattern_members", 1)
    listed = load_snapshot(spark, root, "pattern_members").groupBy(F.col("pattern_id").alias("id")).agg(
        F.count("*").alias("members"), F.round(F.sum("similarity"), 2).alias("similarity")
    )
    return load_snapshot(spark, root, "patterns").join(listed, "id").select(
        "id", "name", F.col("member_count").cast("bigint").alias("member_count"), "state", "members", "similarity"
    )


_LINK = 0.35


@query(
    "connected_components",
    f"""with recursive edges as materialized (
  select a.vec_id as u, b.vec_id as v from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {_LINK}),
reach(id, r) as (
  select vec_id, vec_id from embeddings union select reach.id, v from reach join edges on u = reach.r)
select id, min(r)::bigint as component from reach group by 1""",
)
def linkage(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(units(spark, sf), _LINK)


@query(
    "formation_pool",
    f"""select vec_id as id,
       round(embedding[1] / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as first_component,
       {_WEIGHTED_SQL} as weighted
from embeddings join labels on doc_id = vec_id where toxic = 0""",
)
def pool_of_failure_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows carry a classified flag, all others are unclassified and stay out."""
    vectors = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("odi_number"), F.col("embedding").alias("embedding_stripped")
    )
    flags = b.table(spark, sf, "labels").select(
        F.col("doc_id").alias("odi_number"), (F.col("toxic") == 0).alias("is_failure_report")
    )
    return formation_pool(flags, vectors).select(
        "id", F.round(F.col("vec")[0], 6).alias("first_component"), _weighted("vec")
    )


# --- seeds and sweeps --------------------------------------------------------------------

_THRESHOLDS = (0.1, 0.2, 0.3, 0.4)


def _vector_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the orders that have a vector."""
    return b.order_components(spark, sf, b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("odi_number")))


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    parts = _vector_components(spark, sf).select(
        F.col("odi_number").alias("id"), F.col("components").alias("scope")
    )
    return units(spark, sf).join(parts, "id", "left").withColumn(
        "scope", F.coalesce("scope", F.array().cast("array<string>"))
    )


@query(
    "threshold_sweep",
    f"""with {b.SQL_COMPONENTS},
base as (
  select vec_id, embedding::double[] as e, coalesce(components, []::varchar[]) as scope
  from embeddings left join comp on odi_number = vec_id),
pairs as (
  select a.vec_id as id, list_cosine_similarity(a.e, b.e) as sim, list_has_any(a.scope, b.scope) as shared
  from base a join base b on a.vec_id <> b.vec_id)
select vec_id as id, threshold::double as threshold,
       count(sim) filter (where sim >= threshold)::bigint as n,
       count(sim) filter (where sim >= threshold and shared)::bigint as n_scoped
from embeddings, (select unnest([0.1, 0.2, 0.3, 0.4]::double[]) as threshold)
left join pairs on id = vec_id group by all""",
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every row as a seed: matches per threshold, with and without the component scope."""
    rows = _scoped(spark, sf)
    return threshold_counts(rows, rows, _THRESHOLDS)


@query(
    "topk_sweep",
    f"""with {b.SQL_COMPONENTS}, {_PAIRS},
tagged as (
  select p.i, p.sim, p.rk, coalesce(list_has_any(a.components, c.components), false) as shared
  from pairs p left join comp a on a.odi_number = p.i left join comp c on c.odi_number = p.j where rk <= 20)
select i as seed, k::bigint as k, count(*) as kept, count(*) filter (where shared) as scoped,
       round(min(sim), 6) as weakest,
       round(1 - (count(*) filter (where shared))::double / count(*), 6) as lost
from tagged, (select unnest([5, 10, 20]) as k) where rk <= k group by all""",
)
def topk_sweep(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbours(units(spark, sf), FLOOR, 20)
    tagged = sharing_components(pairs, _vector_components(spark, sf))
    return top_k_sweep(tagged, (5, 10, 20)).select(
        "seed", F.col("k").cast("bigint").alias("k"), "kept", "scoped",
        F.round("weakest", 6).alias("weakest"), F.round("lost", 6).alias("lost"),
    )


@query(
    "seed_search",
    """with centre as (
  select label, list(m order by pos) as c from (
    select label, pos, avg(x) as m from (
      select label, unnest(embedding::double[]) as x, unnest(range(64)) as pos from embeddings)
    group by all) group by 1),
found as (
  select centre.label as seed, vec_id as odi_number, list_cosine_similarity(c, embedding::double[]) as sim
  from centre, embeddings)
select seed::bigint as seed, odi_number, round(sim, 6) as sim, rk::bigint as rk from (
  select *, row_number() over (partition by seed order by sim desc, odi_number) as rk from found
  where sim >= 0.1) where rk <= 10""",
)
def seed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vector search: the ten nearest reports of every label's centre."""
    rows = b.table(spark, sf, "embeddings")
    # Seeds are told apart from reports by a negative id, so no report is taken for its seed.
    seeds = centroids(rows, "label", "embedding").select(
        (-F.col("label") - 1).cast("bigint").alias("id"), F.col("centroid").alias("vec")
    )
    found = search(cut(seeds), units(spark, sf), 0.1, 10)
    return found.select(
        (-F.col("i") - 1).alias("seed"), F.col("j").alias("odi_number"),
        F.round("sim", 6).alias("sim"), F.col("rk").cast("bigint").alias("rk"),
    )


@query(
    "scoped_search",
    f"""with {b.SQL_COMPONENTS},
base as (
  select vec_id, embedding::double[] as e, coalesce(components, []::varchar[]) as scope
  from embeddings left join comp on odi_number = vec_id),
pairs as (
  select a.vec_id as i, b.vec_id as j, list_cosine_similarity(a.e, b.e) as sim
  from base a join base b on a.vec_id <> b.vec_id where list_has_any(a.scope, b.scope))
select k::bigint as k, i, j, round(sim, 4) as sim, rk::bigint as rk
from (select *, row_number() over (partition by i order by sim desc, j) as rk from pairs where sim >= 0.05),
     (select unnest([5, 10, 20]) as k) where rk <= k""",
)
def scoped_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest rows among those that share a component, for three lengths of the list."""
    rows = _scoped(spark, sf)
    found = as_table(scoped_search(rows, rows, 0.05, 20), "scoped")
    lengths = F.explode(F.array(*[F.lit(k).cast("bigint") for k in (5, 10, 20)])).alias("k")
    return found.select(lengths, "i", "j", F.round("sim", 4).alias("sim"), F.col("rk").cast("bigint").alias("rk")).filter("rk <= k")


_FLOORS = (0.36, 0.42, 0.48)


@query(
    "linkage_forest",
    f"""with recursive levels as (select unnest({list(_FLOORS)}::double[]) as level),
edges as materialized (
  select level, a.vec_id as u, b.vec_id as v from levels, embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= level),
reach(level, id, r) as (
  select level, vec_id, vec_id from embeddings, levels union
  select reach.level, id, v from reach join edges on u = reach.r and edges.level = reach.level)
select level, id, min(r)::bigint as component from reach group by all""",
)
def forest_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage at three floors from one forest."""
    forest = linkage_forest(units(spark, sf), _FLOORS[0])
    levels = [forest.components(f).select(F.lit(f).alias("level"), "id", "component") for f in _FLOORS]
    return reduce(DataFrame.unionByName, levels)


_COHERENT = """with held as (
  select label as pattern_id, vec_id, embedding::double[] as e,
         row_number() over (partition by label order by embedding[1]::double desc, vec_id) as rank from embeddings),
couples as (
  select a.pattern_id, a.rank, list_cosine_similarity(a.e, b.e) as sim
  from held a join held b on a.pattern_id = b.pattern_id and b.rank < a.rank),
means as (select pattern_id, rank, avg(sim) as mean from couples where rank <= 25 group by all),
whole as (select pattern_id, avg(sim) as coherence from couples group by 1),
broken as (select pattern_id, min(rank) as breaks_at from means where mean < 0.0 group by 1)
select pattern_id::bigint as pattern_id, count(*) as vectors, round(any_value(coherence), 6) as coherence,
       least(count(*), 25)::bigint as looked_at, any_value(breaks_at)::bigint as breaks_at
from held left join whole using (pattern_id) left join broken using (pattern_id) group by 1"""


@query("pattern_coherence", _COHERENT)
def pattern_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine of all pairs of each label, and the rank from which members no longer fit those before."""
    members, rows = _label_members(spark, sf), as_table(units(spark, sf), "units")
    both = coherence(members, rows).join(breaking_rank(members, rows, 0.0), "pattern_id")
    return both.select(
        "pattern_id", "vectors", F.round("coherence", 6).alias("coherence"), "looked_at", F.col("breaks_at").cast("bigint").alias("breaks_at")
    )


_SHIFT = 1_000_000_000
_TWICE = f"""
twice as (
  select vec_id, embedding from embeddings union all select vec_id + {_SHIFT}, embedding from embeddings)"""
_EQUAL = f"""with {_TWICE}
select i, j, 1.0::double as sim, rk::bigint as rk from (
  select a.vec_id as i, b.vec_id as j, row_number() over (partition by a.vec_id order by b.vec_id) as rk
  from {{left}} a join twice b on a.embedding = b.embedding and a.vec_id <> b.vec_id) where rk <= {CAP}"""


def _twice(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector under two ids."""
    rows = units(spark, sf)
    return rows.unionByName(rows.withColumn("id", F.col("id") + _SHIFT))


@query("equal_vector_neighbours", _EQUAL.format(left="twice"))
def equal_vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """A floor of one keeps identical vectors and nothing else, whatever rounding does to products."""
    return neighbours(_twice(spark, sf), 1.0, CAP).withColumn("rk", F.col("rk").cast("bigint"))


@query("equal_vector_search", _EQUAL.format(left="embeddings"))
def equal_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(units(spark, sf), _twice(spark, sf), 1.0, CAP).withColumn("rk", F.col("rk").cast("bigint"))


@query("assign_new", _PLACED)
def place_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns formed from settled orders, then the vectors of open ones placed among them."""
    status = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("settled")
    )
    rows = as_table(units(spark, sf).join(status, "id"), "units")
    old = rows.filter("settled").select("id", "vec")
    new = rows.filter(~F.col("settled")).select("id", "vec")
    formed = as_table(grow(old, FLOOR, CAP), "formed")
    kept = keep_large(formed, MIN)
    owners = formed.join(kept.select("cluster"), "cluster", "left_semi").select("i", "cluster")
    placed = assign_new(new, old, owners, FLOOR, CAP)
    return placed.select(
        F.col("i").alias("odi_number"), F.col("cluster").alias("seed"),
        F.round("join_sim", 4).alias("similarity"),
    )


_ARRIVED = f"""with recursive
settled as (select e.* from embeddings e join orders on o_orderkey = vec_id where o_orderstatus = 'F'),
fresh as (select e.* from embeddings e join orders on o_orderkey = vec_id where o_orderstatus <> 'F'),
everyone as (select *, true as stored from settled union all select *, false from fresh),
{_pairs_sql("old_pairs", "settled", "settled")}, {_grow_sql("old_", "settled", _LOWER.format("old_pairs"))},
{_pairs_sql("new_pairs", "fresh", "everyone", "b.stored or b.vec_id < a.vec_id")},
kept as (select i as k, cluster as kept_cluster from old_counted where n >= {MIN}),
{_grow_sql("new_", "fresh", f"""
    select i, j, sim, rk, kept_cluster as c from new_pairs left join kept on k = j
    where rk <= {CAP} and (kept_cluster is not null or j in (select vec_id from fresh))""")}
select i as odi_number, cluster as seed, round(join_sim, 4) as similarity from new_assigned"""


@query("assign_batches", _ARRIVED)
def place_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders placed in two batches through a stored index; in SQL they come as one."""
    status = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("settled")
    )
    rows = as_table(units(spark, sf).join(status, "id"), "units")
    old, new = rows.filter("settled").select("id", "vec"), rows.filter(~F.col("settled")).select("id", "vec")
    index = VectorIndex(spark, scratch_path(spark, "index"), CAP + 1, Grid(rows_per_cell=64)).create(old)
    formed = as_table(grow(old, FLOOR, CAP), "formed")
    owners = formed.join(keep_large(formed, MIN).select("cluster"), "cluster", "left_semi").select("i", "cluster")
    middle = new.agg(F.percentile_approx("id", 0.5).alias("m")).first()["m"] or 0
    first = as_table(place_arrivals(index, owners, new.filter(F.col("id") <= middle), FLOOR, CAP), "placed")
    index.append(new.filter(F.col("id") <= middle))
    second = place_arrivals(index, owners.union(first.select("i", "cluster")), new.filter(F.col("id") > middle), FLOOR, CAP)
    return first.unionByName(second).select(
        F.col("i").alias("odi_number"), F.col("cluster").alias("seed"), F.round("join_sim", 4).alias("similarity"),
    )


# --- shortlist and assessment ----------------------------------------------------------------


def _label_members(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("pattern_id"),
        F.col("vec_id").alias("odi_number"),
        F.col("embedding")[0].cast("double").alias("similarity"),
    )


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("odi_number"), F.col("embedding").alias("embedding_stripped")
    )


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector once more as a recall of its order's vehicle; a customer is a campaign."""
    rows = (
        b.table(spark, sf, "embeddings")
        .join(b.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("vec_id"))
        .select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("campaign_number"),
            F.col("o_orderpriority").alias("make"),
            F.col("o_orderstatus").alias("model"),
            F.year("o_orderdate").alias("model_year"),
            F.concat(F.lit("PART "), "o_orderstatus").alias("component"),
            F.concat(F.lit("Notice "), F.col("vec_id").cast("string")).alias("summary"),
            F.when(F.col("o_orderstatus") != "P", F.lit("may stall")).alias("consequence"),
            "embedding",
            "vec_id",
        )
    )
    return last_wins(rows, ["campaign_number", "make", "model", "model_year"], ["vec_id"])


_SHORTLIST = """
notices as (
  select * from (
    select 'C' || o_custkey as campaign_number, o_orderpriority as make, o_orderstatus as model,
           year(o_orderdate) as model_year, 'PART ' || o_orderstatus as component,
           'Notice ' || vec_id as summary, case when o_orderstatus <> 'P' then 'may stall' end as consequence,
           embedding::double[] as e,
           row_number() over (partition by o_custkey, o_orderpriority, o_orderstatus, year(o_orderdate)
                              order by vec_id desc) as rn
    from embeddings join orders on o_orderkey = vec_id) where rn = 1),
centre as (
  select label, list(m order by pos) as c from (
    select label, pos, avg(x) as m from (
      select label, unnest(embedding::double[]) as x, unnest(range(64)) as pos from embeddings)
    group by all) group by 1),
vehicles as (
  select distinct label, o_orderpriority as make, o_orderstatus as model
  from embeddings join orders on o_orderkey = vec_id),
candidates as (
  select v.label, n.campaign_number, n.make, n.model, n.model_year, n.component, n.summary, n.consequence,
         list_cosine_similarity(c, e) as similarity
  from vehicles v join centre using (label) join notices n on n.make = v.make and n.model = v.model),
nearest as (
  select * from (
    select *, row_number() over (partition by label, campaign_number
                                 order by similarity desc, make, model, model_year) as rn
    from candidates) where rn = 1),
short as (
  select * from (
    select *, row_number() over (partition by label order by similarity desc, campaign_number) as rank
    from nearest) where rank <= 5)"""


def _shortlist(spark: SparkSession, sf: str) -> DataFrame:
    notices = _notices(spark, sf)
    return shortlist(
        _label_members(spark, sf), b.reports(spark, sf, components=False), _vectors(spark, sf),
        notices.drop("embedding"), notices,
    )


@query(
    "centroid_shortlist",
    f"""with {_SHORTLIST}
select label::bigint as pattern_id, rank::bigint as rank, campaign_number,
       make || ' ' || model || ' ' || model_year as vehicle, component, summary, consequence,
       round(similarity, 6) as similarity from short""",
)
def centroid_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return _shortlist(spark, sf).select(
        "pattern_id", F.col("rank").cast("bigint").alias("rank"), "campaign_number", "vehicle",
        "component", "summary", "consequence", F.round("similarity", 6).alias("similarity"),
    )


@query(
    "search_recalls",
    f"""with {_SHORTLIST},
fleet as (select label, string_agg(make || ' ' || model, ',' order by make || ' ' || model) as vehicles
          from vehicles group by 1),
lists as (select label, count(*) as n, string_agg(campaign_number, ',' order by rank) as campaigns
          from short group by 1)
select a.id as pattern_id, case when label is null then 'error' else 'ok' end as status,
       case when label is null then 'no pattern with id ' || a.id end as message,
       case when label is not null then 'group ' || label end as pattern_name, vehicles,
       case when label is not null then coalesce(n, 0) end::bigint as candidate_count, campaigns
from (select s_suppkey as id from supplier) a left join fleet f on f.label = a.id left join lists using (label)""",
)
def search_recalls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool-shaped retrieval for every supplier key asked; only labels are known ids."""
    asked = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    members = _label_members(spark, sf)
    result = search_result(
        asked, _label_patterns(spark, sf), members, b.reports(spark, sf, components=False),
        _shortlist(spark, sf),
    )
    return result.select(
        "pattern_id", "status", "message", "pattern_name",
        F.array_join("vehicles", ",").alias("vehicles"),
        F.col("candidate_count").cast("bigint").alias("candidate_count"),
        F.array_join(F.col("candidates.campaign_number"), ",").alias("campaigns"),
    )


def _label_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """One stored pattern per label; the lower labels were assessed before."""
    assessed = F.col("label") < 5
    return (
        b.table(spark, sf, "embeddings").select("label").distinct().select(
            F.col("label").cast("bigint").alias("id"),
            F.concat(F.lit("group "), F.col("label").cast("string")).alias("name"),
            F.when(assessed, "known").alias("novelty_verdict"),
            F.when(assessed, "C1").alias("novelty_recall_ref"),
            F.lit(None).cast("double").alias("ratio"),
            F.lit("2000-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        )
    )


def nearest_notice_judge(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a judge: trusts the first notice, unless it is about ``PART O``."""
    answers = []
    for text in prompts:
        first = text.split("RECALLS:\n- ", 1)[1].split("\n", 1)[0]
        doc = {
            "verdict": "partially_covered" if "PART O" in first else "known",
            "recall": first.split(" ", 1)[0],
            "reason": "nearest",
        }
        answers.append("Here is my answer. " + json.dumps(doc) + " Done.")
    return answers


_JUDGED = f"""with {_SHORTLIST},
counts as (select label, count(*) as n from short group by 1),
judged as (
  select v.label, case when s.component = 'PART O' then 'partially_covered' else 'known' end as verdict,
         s.campaign_number as recall_ref, n
  from (select distinct label from vehicles) v join short s on s.label = v.label and s.rank = 1
  join counts c on c.label = v.label),
results as (
  select label::bigint as id, 'group ' || label as name, 'ok' as status, verdict, recall_ref, n as candidates_considered,
         case when label < 5 then 'known' end as previous_verdict,
         label < 5 and (verdict <> 'known' or recall_ref <> 'C1') as changed from judged)"""


def _assess(spark: SparkSession, sf: str):
    notices = _notices(spark, sf)
    return assess(
        _label_patterns(spark, sf), _label_members(spark, sf), b.reports(spark, sf, components=False),
        _vectors(spark, sf), notices.drop("embedding"), notices, nearest_notice_judge,
        F.lit("2000-02-01 00:00:00").cast("timestamp"), only_missing=False,
    )


@query(
    "judge_prompts",
    f"""with {_SHORTLIST},
fleet as (select label, string_agg(make || ' ' || model, ', ' order by make, model) as vehicles from vehicles group by 1),
told as (
  select label, string_agg('- ' || text, chr(10) order by rank) as lines from (
    select label, coalesce(case when o_orderstatus = 'F' then 'Kept ' || vec_id end,
                           'Order ' || vec_id || ' ' || o_orderpriority) as text,
           row_number() over (partition by label order by embedding[1] desc, vec_id) as rank
    from embeddings join orders on o_orderkey = vec_id) where rank <= 4 group by 1),
offered as (
  select label, count(*) as n, string_agg('- ' || campaign_number || ' (' || make || ' ' || model || ' ' || model_year
           || ', ' || component || '): ' || summary || ' ' || coalesce(consequence, ''), chr(10) order by rank) as lines
  from short group by 1)
select label::bigint as id, n::bigint as candidates,
       printf({_quote(INSTRUCTIONS)}, 'group ' || label, vehicles, told.lines, offered.lines) as prompt
from fleet join told using (label) join offered using (label)""",
)
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    members, reports = _label_members(spark, sf), b.reports(spark, sf, components=False)
    rows = prompts(
        _label_patterns(spark, sf), pattern_vehicles(members, reports),
        sample_narratives(members, reports, chars=None), _shortlist(spark, sf), None, None,
    )
    return rows.select("id", F.col("candidates").cast("bigint").alias("candidates"), "prompt")


@query(
    "vector_text",
    """select vec_id as id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as first_component,
       """ + _WEIGHTED_SQL + """ as weighted
from embeddings""",
)
def vector_text(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors printed as text, parsed back and normalised."""
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))
    rows = b.table(spark, sf, "embeddings").select("vec_id", parse_vector(text).alias("v"))
    return pool(rows, "vec_id", "v").select(
        "id", F.round(F.col("vec")[0], 5).alias("first_component"), _weighted("vec")
    )


@query(
    "assess_patterns",
    _JUDGED + " select *, changed as rewritten from results",
)
def assess_patterns(spark: SparkSession, sf: str) -> DataFrame:
    outcome = _assess(spark, sf)
    rewritten = outcome.history.select(F.col("pattern_id").alias("id"), F.lit(True).alias("_h"))
    return outcome.results.join(rewritten, "id", "left").select(
        "id", "name", "status", "verdict", "recall_ref",
        F.col("candidates_considered").cast("bigint").alias("candidates_considered"),
        "previous_verdict", "changed", F.coalesce("_h", F.lit(False)).alias("rewritten"),
    )


_DOWN = "PATTERN: group 3\n"


def judge_down_for_one(prompts: list[str]) -> list[str]:
    """As :func:`nearest_notice_judge`, but out of order for one pattern."""
    if any(_DOWN in p for p in prompts):
        raise RuntimeError("judge is down for this one")
    return nearest_notice_judge(prompts)


@query(
    "check_novelty",
    _JUDGED + """
select a.id, case when r.id is null or r.id = 3 then 'error' else 'ok' end as status, r.name,
       case when r.id <> 3 then verdict end as verdict, case when r.id <> 3 then recall_ref end as recall_ref,
       case when r.id <> 3 then 'nearest' end as reason, candidates_considered::bigint as candidates_considered,
       case when r.id is null then 'no pattern with id ' || a.id when r.id = 3 then 'judge is down for this one' end as message,
       case when r.id <> 3 then true end as ref_in_candidates, previous_verdict,
       case when r.id < 5 then 'C1' end as previous_recall_ref, case when r.id <> 3 then changed end as changed
from (select s_suppkey as id from supplier) a left join results r on r.id = a.id""",
)
def check_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier key asked by name: assessed and unassessed patterns, one that fails, and unknown ids."""
    outcome = _by_name(spark, sf, _label_patterns(spark, sf))
    return outcome.results.withColumn("candidates_considered", F.col("candidates_considered").cast("bigint"))


def _by_name(spark: SparkSession, sf: str, patterns: DataFrame, more: DataFrame | None = None,
             members: DataFrame | None = None) -> Assessment:
    asked = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    asked = asked if more is None else asked.union(more)
    notices, held = _notices(spark, sf), _label_members(spark, sf)
    return assess(
        patterns, held if members is None else held.unionByName(members), b.reports(spark, sf, components=False),
        _vectors(spark, sf), notices.drop("embedding"), notices, judge_down_for_one,
        F.lit("2000-02-01 00:00:00").cast("timestamp"), pattern_ids=asked, source="tool",
        answers_path=scratch_path(spark, "answers"), slices=2,
    )


@query(
    "assessment_report",
    _JUDGED + """ select count(*) + 2 as patterns, count(*) filter (where r.id <> 3 and candidates_considered = 0) + 2 as no_candidates,
       count(*) filter (where r.id <> 3 and verdict = 'novel') + 2 as novel,
       count(*) filter (where r.id <> 3 and verdict = 'known') as known,
       count(*) filter (where r.id <> 3 and verdict = 'partially_covered') as partially_covered,
       count(*) filter (where r.id is null or r.id = 3) as failed
from (select s_suppkey as id from supplier) a left join results r on r.id = a.id""",
)
def assessment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The supplier keys asked by name, one of which fails and some unknown, and two patterns whose members have no vector."""
    bare = spark.range(900_001, 900_003).select("id", F.concat(F.lit("bare "), F.col("id").cast("string")).alias("name"))
    patterns = _label_patterns(spark, sf).unionByName(bare, allowMissingColumns=True)
    vectors = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("o_orderkey"))
    others = b.table(spark, sf, "orders").join(vectors, "o_orderkey", "left_anti")
    ends = others.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    members = ends.select(F.explode(F.array(
        F.struct(F.lit(900_001).alias("pattern_id"), F.col("a").alias("odi_number")),
        F.struct(F.lit(900_002).alias("pattern_id"), F.col("b").alias("odi_number")),
    )).alias("m")).select(F.col("m.pattern_id").cast("bigint").alias("pattern_id"), "m.odi_number", F.lit(0.5).alias("similarity"))
    return assessment_report(_by_name(spark, sf, patterns, bare.select("id"), members).results)
