"""Pressure-driven flow: conservation at every node whose pressure isn't given.

Components are solved apart. Where near ids are near in the graph most lie in one span of ids: nodes and segments are dealt to spans once, and
what lies in one is solved there, without labels or joins (`solved_in_spans`). Of the rest, those of up to `dense` unknown nodes are gathered, some hundreds of small
systems to a task, and solved directly. Larger ones are decomposed (perfusia.operators.dissect): the inside of each part is
eliminated in its own task, level by level. Where the interface between parts is too large for that, as in networks without small
separators, preconditioned conjugate gradients take over; their matrix is laid out once, in buckets by column, and a product moves vectors only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from perfusia.functions import scalars
from perfusia.operators import dissect
from perfusia.operators.components import stars
from perfusia.operators.network import component_labels, incidence, measured
from perfusia.sources.scratch import Scratch


def segment_resistances(segments: DataFrame, viscosity: float = scalars.BLOOD_VISCOSITY_PA_S) -> DataFrame:
    """(segment_id, start_node, end_node, resistance); a segment without length or radius fails the query, active or not."""
    return measured(segments).select("segment_id", "start_node", "end_node", scalars.segment_resistance(F.col("length_um"), F.col("mean_radius_um"), viscosity).alias("resistance"))


def pressure_connected(nodes: DataFrame, segments: DataFrame, fixed: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node_id, component) of the nodes that a fixed node reaches, whichever it is. `labels` are those of component_labels, if known."""
    labels = component_labels(nodes, segments) if labels is None else labels
    return labels.join(labels.join(fixed.select("node_id"), "node_id").select("component").distinct(), "component", "left_semi").select("node_id", "component")


def pressure_system(conductances: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matrix entries (row, col, value) and right side (row, value) over unknown nodes, from (segment_id, start_node, end_node, g)."""
    both = incidence(conductances).join(conductances.select("segment_id", "g"), "segment_id").where("node_id <> other")
    known = fixed.select(F.col("node_id").alias("other"), F.col("pressure").alias("p"))
    rows = both.join(fixed.select("node_id"), "node_id", "left_anti").join(known, "other", "left")
    diagonal = rows.groupBy("node_id").agg(F.sum("g").alias("value")).select(F.col("node_id").alias("row"), F.col("node_id").alias("col"), "value")
    off = rows.where("p is null").groupBy(F.col("node_id").alias("row"), F.col("other").alias("col")).agg((-F.sum("g")).alias("value"))
    right = rows.groupBy(F.col("node_id").alias("row")).agg(F.sum(F.coalesce(F.col("g") * F.col("p"), F.lit(0.0))).alias("value"))
    return diagonal.union(off), right


def network_of(live: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (component, a, b, g), a < b, between unknown nodes and their ground (component, node, g, right), from conductances
    (a, b, g) and all nodes (node_id, component, pressure), the pressure null where it isn't given. Whatever is fixed around a node is summed up, so a hub has one row."""
    side = lambda c: known.select(F.col("node_id").alias(c), F.col("pressure").alias(f"{c}_pressure"), "component")
    both = live.join(side("a"), "a").join(side("b").drop("component"), "b")
    links = both.where("a_pressure is null and b_pressure is null").groupBy("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("g").alias("g"))
    open_ = both.where("(a_pressure is null) <> (b_pressure is null)")
    node = F.when(F.col("a_pressure").isNull(), F.col("a")).otherwise(F.col("b"))
    ground = open_.groupBy("component", node.alias("node")).agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.coalesce("a_pressure", "b_pressure")).alias("right"))
    return links, ground


def _stacks(rows: pd.DataFrame) -> pd.DataFrame:
    """Direct solution of each component among rows (component, a, b, g, right): links and, with a null b, ground. Components of as
    many unknown nodes are solved as one stack of matrices."""
    linked = rows.b.notna().to_numpy()
    a, b, g = rows.a.to_numpy(np.int64), rows.b.fillna(0).to_numpy(np.int64)[linked], rows.g.to_numpy(float)
    unknown, seen = np.unique(np.concatenate([a, b]), return_index=True)
    component = rows.component.to_numpy()
    owner = np.concatenate([component, component[linked]])[seen]
    by = np.lexsort((unknown, owner))
    _, first, of, sizes = np.unique(owner[by], return_index=True, return_inverse=True, return_counts=True)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    i, j = place[np.searchsorted(unknown, a)], place[np.searchsorted(unknown, b)]
    right, diagonal = np.zeros(len(by)), np.zeros(len(by))
    np.add.at(right, i[~linked], rows.right.to_numpy(float)[~linked])
    np.add.at(diagonal, i, g)
    np.add.at(diagonal, j, g[linked])
    out = np.empty(len(by))
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        slot = np.full(len(sizes), -1)
        slot[own] = np.arange(len(own))
        where = first[own][:, None] + np.arange(n)
        matrix = np.zeros((len(own), n, n))
        matrix[:, np.arange(n), np.arange(n)] = diagonal[where]
        mine = slot[of[j]] >= 0
        k, p, q = of[j[mine]], i[linked][mine], j[mine]
        for x, y in ((p, q), (q, p)):
            np.subtract.at(matrix, (slot[k], x - first[k], y - first[k]), g[linked][mine])
        scale = np.sqrt(diagonal[where])
        out[where] = np.linalg.solve(matrix / scale[:, :, None] / scale[:, None, :], (right[where] / scale)[:, :, None])[:, :, 0] / scale
    return pd.DataFrame({"node_id": unknown[by], "pressure": out})


def system_of(links: DataFrame, ground: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matrix entries (row, col, value) and right side (row, value) of a network."""
    sides = links.select(F.col("a").alias("row"), F.col("b").alias("col"), "g").union(links.select("b", "a", "g"))
    diagonal = sides.select("row", "g").union(ground.select("node", "g")).groupBy("row").agg(F.sum("g").alias("value")).select("row", F.col("row").alias("col"), "value")
    matrix = diagonal.union(sides.groupBy("row", "col").agg(-F.sum("g")))
    return matrix, diagonal.select("row").join(ground.select(F.col("node").alias("row"), F.col("right").alias("value")), "row", "left").na.fill(0.0, ["value"])


def conjugate_gradient(matrix: DataFrame, right: DataFrame, tolerance: float = 1e-12, most: int = 10_000) -> DataFrame:
    """(node_id, pressure) of a symmetric positive definite system in coordinate form, scaled by its diagonal; an error if it doesn't converge.

    One job an iteration: the product with the matrix and both dot products, observed as the state is written.
    """
    scratch = Scratch(matrix.sparkSession, "gradient")
    matrix = scratch.bucketed(matrix, "col")

    def written(rows: DataFrame) -> tuple[DataFrame, float, float]:
        """The state with w = A u, and the products (r, u) and (w, u)."""
        product = matrix.join(rows.select(F.col("row").alias("col"), "u"), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("u")).alias("w"))
        seen = Observation()
        kept = scratch.keep(rows.join(product, "row").observe(seen, F.sum(F.col("r") * F.col("u")).alias("ru"), F.sum(F.col("w") * F.col("u")).alias("wu")))
        return kept, seen.get["ru"] or 0.0, seen.get["wu"] or 0.0

    diagonal = matrix.where("row = col").select("row", F.col("value").alias("d"))
    zero = F.lit(0.0)
    start = right.join(diagonal, "row").select("row", "d", zero.alias("x"), F.col("value").alias("r"), zero.alias("p"), zero.alias("s"))
    state, rho, product = written(scratch.keep(start.withColumn("u", F.col("r") / F.col("d"))))
    first, alpha, beta = rho, rho / product if product else 0.0, 0.0
    for _ in range(most):
        if rho <= tolerance * tolerance * first or rho == 0:
            return state.select(F.col("row").alias("node_id"), F.col("x").alias("pressure"))
        stepped = state.withColumns({"p": F.col("u") + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")})
        stepped = stepped.select("row", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("s")).alias("r"), "p", "s")
        after, new, product = written(stepped.withColumn("u", F.col("r") / F.col("d")))
        scratch.drop(state)
        state, beta = after, new / rho
        alpha, rho = new / (product - beta * new / alpha) if new else 0.0, new
    raise ArithmeticError(f"pressures haven't converged after {most} iterations")


def solve_network_flow(nodes: DataFrame, segments: DataFrame, fixed: DataFrame, viscosity: float = scalars.BLOOD_VISCOSITY_PA_S, dense: int = 2000, labels: DataFrame | None = None, front: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pressures (node_id, pressure) of the nodes that fixed ones (node_id, pressure) reach, and segment flows.

    Two fixed nodes are needed, wherever they are: one alone in a component gives it its own pressure and no flow. A task
    solves up to `dense` unknowns of one system, and holds up to `front` where parts of a large one are merged (three times `dense` at least).
    """
    if fixed.select("node_id").distinct().limit(2).count() < 2:
        raise ValueError("two nodes of fixed pressure are needed")
    scratch = Scratch(nodes.sparkSession, "flow")
    resistances = scratch.keep(segment_resistances(segments, viscosity))
    near = None
    if labels is None:  # whoever has labels knows of a component that is worth solving as one
        near, nodes, loose, fixed = solved_in_spans(nodes, resistances, fixed, dense, scratch)
        if loose is None:
            return near, segment_flows(resistances, near)
        segments = loose
    active = scratch.keep(pressure_connected(nodes, segments, fixed, labels).join(fixed.select("node_id", F.col("pressure").cast("double").alias("pressure")), "node_id", "left"))
    live = (resistances if near is None else segments).where("start_node <> end_node")
    largest = live.join(active.select(F.col("node_id").alias("start_node")), "start_node", "left_semi").agg(F.max(1 / F.col("resistance"))).first()[0] or 1.0
    # conductances are scaled to one at most: in SI units they are far below what sums keep well
    links, ground = map(scratch.keep, network_of(live.select(F.col("start_node").alias("a"), F.col("end_node").alias("b"), (1 / F.col("resistance") / largest).alias("g")), active))
    sizes = scratch.keep(active.where("pressure is null").groupBy("component").agg(F.count("*").alias("n")))
    total, over = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > dense)).first()
    solved = active.where("pressure is not null").select("node_id", "pressure")
    if over:
        large = sizes.where(F.col("n") > dense).select("component")
        own_links, own_ground = links.join(large, "component", "left_semi").select("a", "b", "g"), ground.join(large, "component", "left_semi").select("node", "g", "right")
        solved = solved.union(solve_large(scratch.keep(own_links), scratch.keep(own_ground), dissect.along_curve(nodes), dense, scratch, front))
        links, ground = (x.join(large, "component", "left_anti") for x in (links, ground))
    # components fill buckets by their own hash; a bucket holds some thousand unknowns, not a share of the input
    buckets = max(1, -(-total // (4 * max(dense, 1))))
    small = links.select("component", "a", "b", "g", F.lit(0.0).alias("right")).union(ground.select("component", "node", F.lit(None).cast("bigint"), "g", "right"))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    pressures = scratch.keep(solved.union(small.groupBy("bucket").applyInPandas(lambda pdf: _stacks(pdf), "node_id long, pressure double")))
    pressures = pressures if near is None else near.union(pressures)
    return pressures, segment_flows(resistances, pressures)


def solved_in_spans(
    nodes: DataFrame, resistances: DataFrame, fixed: DataFrame, dense: int, scratch: Scratch, per_span: int = 1 << 16, most: int = 1 << 19
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Pressures (node_id, pressure) of components all of whose nodes lie in one span of ids, and the nodes, segments and fixed nodes of the others;
    no segments (None) if there are no others.

    A span holds some `per_span` nodes; one of over `most` rows is left to the others, as are components of over `dense` unknown nodes. A segment
    between spans goes to both, so that what it touches is known to be open.
    """
    ends = nodes.agg(F.min("node_id"), F.max("node_id"), F.count("*")).first()
    if not ends[2]:
        return nodes.select("node_id", F.lit(0.0).alias("pressure")), nodes, resistances, fixed
    span = max(1, -(-(ends[1] - ends[0] + 1) * per_span // ends[2]))
    place = lambda c: F.floor((F.col(c) - ends[0]) / span)
    null = lambda t: F.lit(None).cast(t)
    own = nodes.select(place("node_id").alias("span"), F.col("node_id").alias("a"), F.col("node_id").alias("b"), null("double").alias("r"), null("double").alias("p"))
    given = fixed.select(place("node_id"), "node_id", "node_id", null("double"), F.col("pressure").cast("double"))
    both = F.explode(F.array_distinct(F.array(place("start_node"), place("end_node")))).alias("span")
    links = resistances.where("start_node <> end_node").select(both, "start_node", "end_node", "resistance", null("double"))
    rows = own.union(given).union(links).where("span is not null")
    large = scratch.keep(rows.groupBy("span").count().where(F.col("count") > most).select("span", F.lit(True).alias("large")))
    first = ends[0]

    def run(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        a, b, r, p = held.a.to_numpy(np.int64), held.b.to_numpy(np.int64), held.r.to_numpy(float), held.p.to_numpy(float)
        linked, given = ~np.isnan(r), ~np.isnan(p)
        node = np.unique(np.concatenate([a, b]))
        i, j = np.searchsorted(node, a), np.searchsorted(node, b)
        inside = (node - first) // span == key[0]
        real = ~inside
        real[i[~linked & ~given]] = True  # ends and fixed nodes that aren't nodes take no part
        linked &= real[i] & real[j]
        given &= real[i]
        low = labels_of(len(node), i[linked], j[linked])
        open_ = np.zeros(len(node), bool)
        open_[low[~inside]] = True
        pressure = np.full(len(node), np.nan)
        pressure[i[given]] = p[given]
        unknown = np.bincount(low[np.isnan(pressure)], minlength=len(node))
        open_ |= unknown > dense
        fed = np.zeros(len(node), bool)
        fed[low[i[given]]] = True
        solve = fed[low] & ~open_[low]
        mine = solve & real & ~np.isnan(pressure)
        out = [pd.DataFrame({"node_id": node[mine], "pressure": pressure[mine], "state": 0})]
        u, v, g = i[linked], j[linked], 1 / r[linked]
        keep = solve[u]
        u, v, g = u[keep], v[keep], g[keep]
        if len(g) and np.isnan(pressure[solve]).any():
            g = g / g.max()
            free = np.isnan(pressure)
            links = free[u] & free[v]
            touch = free[u] != free[v]
            at, known = np.where(free[u], u, v)[touch], np.where(free[u], v, u)[touch]
            parts = [
                pd.DataFrame({"component": low[u[links]], "a": u[links], "b": v[links].astype(float), "g": g[links], "right": 0.0}),
                pd.DataFrame({"component": low[at], "a": at, "b": np.nan, "g": g[touch], "right": g[touch] * pressure[known]}),
            ]
            got = _stacks(pd.concat([x for x in parts if len(x)]))
            out.append(pd.DataFrame({"node_id": node[got.node_id.to_numpy()], "pressure": got.pressure, "state": 0}))
        rest = open_[low] & inside & real
        out.append(pd.DataFrame({"node_id": node[rest], "pressure": np.nan, "state": 1}))
        return pd.concat([x for x in out if len(x)] or out)

    seen = Observation()
    fits = rows.join(F.broadcast(large), "span", "left").where("large is null").drop("large")
    found = scratch.keep(fits.groupBy("span").applyInPandas(run, "node_id long, pressure double, state int").observe(seen, F.count_if(F.col("state") == 1).alias("open")))
    wide = own.join(F.broadcast(large), "span").select(F.col("a").alias("node_id")) if large.limit(1).count() else None
    solved = found.where("state = 0").select("node_id", "pressure")
    if not seen.get["open"] and wide is None:
        return solved, nodes, None, fixed
    rest = found.where("state = 1").select("node_id")
    rest = scratch.keep(rest if wide is None else rest.union(wide))
    # a segment of another component has both ends among its nodes
    loose = scratch.keep(resistances.join(rest.withColumnRenamed("node_id", "start_node"), "start_node", "left_semi"))
    return solved, nodes.join(rest, "node_id", "left_semi"), loose, fixed.join(rest, "node_id", "left_semi")


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 the least that links (i, j) join each to."""
    low = np.arange(n)
    if len(i):
        moved, least = stars(i.astype(np.int64), j.astype(np.int64))
        low[moved] = least
    return low


def solve_large(links: DataFrame, ground: DataFrame, places: DataFrame, dense: int, scratch: Scratch, front: int = 0) -> DataFrame:
    """(node_id, pressure) of components of over `dense` unknown nodes: decomposed, and what is left solved directly or, if it is too large an interface, by conjugate gradients."""
    links, ground, levels = dissect.dissect(links, ground, places, dense, scratch, front)
    few = dissect.nodes_of(links, ground).count() <= dense
    core = dissect.solved(links, ground) if few else conjugate_gradient(*system_of(links, ground))
    return dissect.put_back(core, levels, scratch)


def solve_network_flow_mmhg(nodes: DataFrame, segments: DataFrame, fixed: DataFrame, viscosity: float = scalars.BLOOD_VISCOSITY_PA_S, dense: int = 2000, labels: DataFrame | None = None, front: int = 0) -> tuple[DataFrame, DataFrame]:
    """fixed: (node_id, pressure_mmhg)."""
    return solve_network_flow(nodes, segments, fixed.select("node_id", scalars.pascal(F.col("pressure_mmhg")).alias("pressure")), viscosity, dense, labels, front)


def segment_flows(resistances: DataFrame, pressures: DataFrame) -> DataFrame:
    """Signed flow from start to end of segments whose ends both have a pressure."""
    start, end = (pressures.select(F.col("node_id").alias(n), F.col("pressure").alias(p)) for n, p in (("start_node", "start_pressure_pa"), ("end_node", "end_pressure_pa")))
    flow = (F.col("start_pressure_pa") - F.col("end_pressure_pa")) / F.col("resistance")
    return resistances.join(start, "start_node").join(end, "end_node").select(
        "segment_id", "start_node", "end_node", "start_pressure_pa", "end_pressure_pa", F.col("resistance").alias("resistance_pa_s_per_m3"),
        flow.alias("flow_m3_per_s"), scalars.cubic_micrometres(flow).alias("flow_um3_per_s"),
    )


def segment_flow_um3_per_s(flows: DataFrame, segment_id: int) -> DataFrame:
    return flows.where(F.col("segment_id") == segment_id).select("segment_id", "flow_um3_per_s")


def node_pressure_mmhg(pressures: DataFrame, node_id: int) -> DataFrame:
    return pressures.where(F.col("node_id") == node_id).select("node_id", scalars.mmhg(F.col("pressure")).alias("pressure_mmhg"))


def flow_statistics(flows: DataFrame) -> DataFrame:
    size = F.abs("flow_um3_per_s")
    return flows.agg(F.count("*").alias("segments"), F.min(size).alias("min_flow"), F.avg(size).alias("mean_flow"), F.max(size).alias("max_flow"))
