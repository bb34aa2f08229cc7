"""Registered queries of the reference's own operators, each with its DuckDB text.

Grids come from embeddings, networks from lines of orders; see perfusia.sources.derived.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfusia.functions import scalars
from perfusia.functions.species import CARBON_DIOXIDE, OXYGEN
from perfusia.operators import extract, flow, iterate, network, raster, scaling, skeleton, stencil, tissue, transport
from perfusia.plans import simulate
from perfusia.sources import derived, storage
from perfusia.sources.scratch import Scratch
from perfusia.streaming.frames import stream_frames, ticks_from

STEP = stencil.StepParams(dt=0.05)
#: Rows and columns of the image of orders in SQL.
H, W = f"(SELECT {derived.APART} * max(l_orderkey) + {derived.APART} FROM lineitem)", derived.WIDTH
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its operator ids."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


# ---- SQL of the derived tables ----

GRID = """raw AS (
  SELECT vec_id::INT AS r, (i - 1)::INT AS c, abs(embedding[i]::DOUBLE) AS o2, label FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), g0 AS (
  SELECT r, c, label, label = 0 AND c % 8 < 3 AS vessel, CASE WHEN label = 0 AND c % 8 < 3 THEN 1.0 ELSE o2 END AS o2, 0.0::DOUBLE AS co2,
    0.2 + 0.05::DOUBLE * label AS epsilon, 1 + 0.1::DOUBLE * label AS tau,
    CASE WHEN label = 0 AND c % 8 < 3 THEN 0.0 ELSE 0.05::DOUBLE END AS vmax, 0.05::DOUBLE AS km,
    CASE WHEN label = 0 AND c % 8 < 3 THEN 1.0 ELSE 0.0::DOUBLE END AS vessel_o2, 0.0::DOUBLE AS vessel_co2,
    2.0::DOUBLE * (0.2 + 0.05::DOUBLE * label) / (1 + 0.1::DOUBLE * label) AS d_o2, 1.6::DOUBLE * (0.2 + 0.05::DOUBLE * label) / (1 + 0.1::DOUBLE * label) AS d_co2
  FROM raw
)"""


def spread(c: str, d: str) -> str:
    face = lambda f, w: f"coalesce(0.5::DOUBLE * ({f}({d}) OVER {w} + {d}) * ({f}({c}) OVER {w} - {c}), 0.0)"
    return " + ".join(face(f, w) for w in ("wr", "wc") for f in ("lag", "lead"))


USED = "CASE WHEN vessel THEN 0.0 WHEN km + greatest(o2, 0.0) > 0 THEN vmax * greatest(o2, 0.0) / (km + greatest(o2, 0.0)) ELSE 0.0 END"
WINDOWS = "WINDOW wr AS (PARTITION BY r ORDER BY c), wc AS (PARTITION BY c ORDER BY r)"


def steps_sql(steps: int, dt: float = 0.05, reset: bool = True) -> str:
    """CTEs g1 .. gN, the grid after each step."""
    out = [GRID]
    for i in range(1, steps + 1):
        o2 = f"o2 + {dt}::DOUBLE * (({spread('o2', 'd_o2')}) - ({USED}))"
        co2 = f"co2 + {dt}::DOUBLE * (({spread('co2', 'd_co2')}) + ({USED}))"
        if reset:
            o2, co2 = f"CASE WHEN vessel THEN vessel_o2 ELSE {o2} END", f"CASE WHEN vessel THEN vessel_co2 ELSE {co2} END"
        out.append(f"g{i} AS MATERIALIZED (SELECT r, c, {o2} AS o2, {co2} AS co2, vessel, vmax, km, vessel_o2, vessel_co2, d_o2, d_co2 FROM g{i - 1} {WINDOWS})")
    return "WITH " + ",\n".join(out)


STATE = f"r, c, {r('o2', 'o2')}, {r('co2', 'co2')}"

PATHS = f"""lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos FROM lineitem
), nodes AS (
  SELECT l_orderkey * 1000 + pos AS node_id, (l_orderkey * {derived.APART})::DOUBLE AS y, (pos * 4 + l_partkey % 3)::DOUBLE AS x, l_orderkey, pos FROM lines
), edges AS (
  SELECT * FROM (
    SELECT l_orderkey, pos, l_orderkey * 1000 + pos AS segment_id, l_orderkey * 1000 + pos AS start_node, lead(l_orderkey * 1000 + pos) OVER (PARTITION BY l_orderkey ORDER BY pos) AS end_node,
      l_quantity::DOUBLE AS length_px, 0.5 + 10 * l_discount::DOUBLE AS radius, l_tax::DOUBLE AS tax FROM lines
  ) WHERE end_node IS NOT NULL
)"""
NETWORK = PATHS + """, segments AS (
  SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, greatest(round_even(length_px, 0)::INT + 1, 2) AS n
  FROM edges e JOIN nodes a ON a.node_id = start_node JOIN nodes b ON b.node_id = end_node WHERE length_px >= 10 AND radius >= 0.5
)"""
PIXELS = NETWORK + f""", points AS (
  SELECT segment_id, i AS pos, round_even(y0 + (y1 - y0) * i / (n - 1), 0)::INT AS y, round_even(x0 + (x1 - x0) * i / (n - 1), 0)::INT AS x, radius
  FROM (SELECT *, unnest(range(n)) AS i FROM segments)
), inside AS (SELECT * FROM points WHERE y >= 0 AND y < {H} AND x >= 0 AND x < {W})"""


def disk_sql(outer: str, inner: str | None = None) -> str:
    ring = f" AND dy * dy + dx * dx > ({inner}) * ({inner})" if inner else ""
    return f"""SELECT DISTINCT segment_id, y + dy AS y, x + dx AS x FROM (SELECT *, unnest(range(-ceil({outer})::INT, ceil({outer})::INT + 1))::INT AS dy FROM inside) p,
  LATERAL (SELECT unnest(range(-ceil(p.radius + 1)::INT, ceil(p.radius + 1)::INT + 1))::INT AS dx)
  WHERE dy * dy + dx * dx <= ({outer}) * ({outer}){ring} AND y + dy BETWEEN 0 AND {H} - 1 AND x + dx BETWEEN 0 AND {W - 1}"""


MASK = PIXELS + f", vessel AS MATERIALIZED (SELECT DISTINCT y, x FROM ({disk_sql('radius')}))"
BOUNDARY = MASK + """, full_cells AS (
  SELECT y, x FROM (SELECT y + dy AS y, x + dx AS x FROM vessel, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) GROUP BY y, x HAVING count(*) = 9
), boundary AS MATERIALIZED (SELECT y, x FROM vessel ANTI JOIN full_cells USING (y, x))"""
#: A boundary pixel lies in a disk of radius 1.5 at most, so that a centerline pixel lies within two rows and columns.
OWNED = BOUNDARY + """, best AS (SELECT y AS py, x AS px, min((segment_id, pos)) AS ord FROM inside GROUP BY y, x), near AS (
  SELECT y, x, y + dy AS py, x + dx AS px FROM boundary, (SELECT unnest([-2, -1, 0, 1, 2]) AS dy), (SELECT unnest([-2, -1, 0, 1, 2]) AS dx)
), owned AS MATERIALIZED (SELECT y, x, arg_min(ord[1], ((y - py) * (y - py) + (x - px) * (x - px), ord)) AS segment_id FROM near JOIN best USING (py, px) GROUP BY y, x)"""

MU = scalars.BLOOD_VISCOSITY_PA_S
FLOW = PATHS + f""", res AS (
  SELECT *, 8.0 * {MU} * (length_px * 1e-6) / ({math.pi} * pow(radius * 1e-6, 4.0)) AS resistance FROM edges
), ends AS (SELECT l_orderkey, max(pos) AS last FROM lines GROUP BY l_orderkey), solved AS (
  SELECT n.node_id, n.l_orderkey, n.pos, CASE WHEN e.last = 0 THEN 35.0 ELSE 35.0 - 20.0 * coalesce(sum(res.resistance) OVER (PARTITION BY n.l_orderkey ORDER BY n.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
    / sum(res.resistance) OVER (PARTITION BY n.l_orderkey) END AS mmhg
  FROM nodes n JOIN ends e USING (l_orderkey) LEFT JOIN res ON res.segment_id = n.node_id
), flows AS (
  SELECT res.segment_id, res.l_orderkey, (a.mmhg - b.mmhg) * 133.322 / resistance AS q, a.mmhg AS p0, b.mmhg AS p1, resistance FROM res JOIN solved a ON a.node_id = start_node JOIN solved b ON b.node_id = end_node
)"""
WEIGHTED = """conc AS (SELECT segment_id, 1.0 * (0.15 + 0.85::DOUBLE * abs(q) / m) AS oxygen, 0.0 - (0.15 + 0.85::DOUBLE * abs(q) / m) AS carbon_dioxide FROM flows, (SELECT max(abs(q)) AS m FROM flows))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their places, written once for the nodes, edges and ends that are read from them."""
    found = derived.path_lines(spark, sf_dir)
    return Scratch(spark, "lines").keep(found.select("l_orderkey", "pos", "last", "node_id", "next_node", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"))


def own_network(spark: SparkSession, sf_dir: str, found: DataFrame | None = None, several: bool = False) -> tuple[DataFrame, DataFrame]:
    """The network of the lines, `found` if they are at hand; several: its edges are read more than once."""
    found = lines(spark, sf_dir) if found is None else found
    return network.network_from_tables(derived.path_nodes(found), derived.path_edges(found), scratch=Scratch(spark, "network") if several else None)


def fixed_ends(found: DataFrame) -> DataFrame:
    """35 mmHg at the first and 15 at the last node of each order; an order of one node has 35 only."""
    at = found.where("pos = 0 or pos = last")
    return at.select("node_id", F.when(F.col("pos") == 0, 35.0).otherwise(15.0).alias("pressure_mmhg"))


def solved_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = lines(spark, sf_dir)
    nodes, segments = network.network_from_tables(derived.path_nodes(found), derived.path_edges(found), min_length=0.0, min_radius=0.0)
    return flow.solve_network_flow_mmhg(nodes, segments, fixed_ends(found))


# ---- grids ----


@query("s01_dense_grid", f"""WITH {GRID}, cells AS (SELECT i // 64 AS r, i % 64 AS c FROM (SELECT unnest(range((SELECT (max(vec_id) + 1) * 64 FROM embeddings))) AS i))
SELECT k.r::INT AS r, k.c::INT AS c, round(coalesce(g.o2, 0.0), 6) + 0.0 AS o2, 310.15::DOUBLE AS temperature, coalesce(g.vessel, false) AS vessel FROM cells k LEFT JOIN g0 g ON g.r = k.r AND g.c = k.c AND g.label % 2 = 0""")
def _(spark, d):
    """Every other label's cells on the dense grid of all rows."""
    rows = derived.table(spark, d, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    own = derived.tissue_grid(spark, d).where("label % 2 = 0").select("r", "c", F.col("o2").alias("_o2"), F.col("vessel").alias("_vessel"))
    cells = tissue.dense_grid(spark, rows, 64).join(own, ["r", "c"], "left")
    return rounded(cells.select("r", "c", F.coalesce("_o2", "o2").alias("o2"), "temperature", F.coalesce("_vessel", "vessel").alias("vessel")))


@query("p01_p05_s12_s13_tissue_setup", f"WITH {GRID} SELECT r, c, vessel, {r('o2', 'o2')}, {r('epsilon', 'epsilon')}, {r('tau', 'tau')}, {r('vmax', 'vmax')}, {r('km', 'km')}, {r('vessel_o2', 'vessel_o2')}, {r('d_o2', 'd_o2')}, {r('d_co2', 'd_co2')} FROM g0")
def _(spark, d):
    return rounded(derived.tissue_grid(spark, d).select("r", "c", "vessel", "o2", "epsilon", "tau", "vmax", "km", "vessel_o2", "d_o2", "d_co2"))


def seeded(k: int, low: float, high: float) -> str:
    x = f"((r::BIGINT * 73856093 + c::BIGINT * 19349663 + {42 + k}::BIGINT * 83492791) % 1000003)"
    return f"{low} + ({high} - {low})::DOUBLE * (({x} * {x} + {x}) % 1000003) / 1000003"


CORNERS = "(r BETWEEN 20 AND 24 AND c BETWEEN 20 AND 24 OR r BETWEEN 50 AND 54 AND c BETWEEN 70 AND 74 OR r BETWEEN 80 AND 84 AND c BETWEEN 40 AND 44)"
CELLS = "cells AS (SELECT i // 64 AS r, i % 64 AS c FROM (SELECT unnest(range((SELECT (max(vec_id) + 1) * 64 FROM embeddings))) AS i))"


def _rows(spark: SparkSession, d: str) -> int:
    return derived.table(spark, d, "embeddings").agg(F.max("vec_id") + 1).first()[0]


@query("s12_seeded_fields", f"WITH {GRID}, {CELLS} SELECT k.r::INT AS r, k.c::INT AS c, {r('(' + seeded(0, 0.5, 10.0).replace('r::', 'k.r::').replace('c::', 'k.c::') + ') * (1 + g.o2)', 'o2')}, {r(seeded(1, 0.0, 2.0).replace('r::', 'k.r::').replace('c::', 'k.c::'), 'co2')}, {r(seeded(2, 0.8, 1.2).replace('r::', 'k.r::').replace('c::', 'k.c::'), 'd_o2')}, {CORNERS.replace('r B', 'k.r B').replace('c B', 'k.c B')} AS vessel FROM cells k JOIN raw g ON g.r = k.r AND g.c = k.c")
def _(spark, d):
    """The seeded start over the table's grid: what it gives a cell is raised by what the table holds there."""
    own = derived.raw_grid(spark, d).select("r", "c", F.col("o2").alias("_o2"))
    fields = derived.seeded_fields(spark, _rows(spark, d), 64).join(own, ["r", "c"])
    return rounded(fields.select("r", "c", (F.col("o2") * (1 + F.col("_o2"))).alias("o2"), "co2", "d_o2", "vessel"))


@query("s13_benchmark_fields", f"WITH {GRID} SELECT r, c, round(1.0 - CASE WHEN vessel THEN 0.0 ELSE 0.05::DOUBLE * 0.01::DOUBLE / 2 END, 9) + 0.0 AS o2, vessel FROM g0")
def _(spark, d):
    """A step of the benchmark's uniform start over the table's rows, the table's vessels in it: nothing spreads, what isn't vessel consumes."""
    own = derived.tissue_grid(spark, d).where("vessel").select("r", "c", F.lit(True).alias("_vessel"))
    fields = derived.benchmark_fields(spark, _rows(spark, d), 64).join(own, ["r", "c"], "left").withColumns({"vessel": F.col("_vessel").isNotNull(), "vessel_o2": F.when(F.col("_vessel"), 1.0).otherwise(0.0)})
    return rounded(stencil.gas_exchange_step(fields, STEP).select("r", "c", "o2", "vessel"), 9)


@query("s11_case_round_trip", f"WITH {GRID} SELECT r, c, {r('o2', 'o2')}, {r('vmax', 'vmax')}, vessel, 0.05::DOUBLE AS dt FROM g0")
def _(spark, d):
    cells = derived.tissue_grid(spark, d).withColumn("case_id", F.floor(F.col("r") / 16))
    path = Scratch(spark, "cases").path()
    storage.write_cases(cells.withColumn("r", F.col("r") % 16), path, dt=0.05)
    back = storage.read_case(spark, path)
    return rounded(back.select((F.col("case_id") * 16 + F.col("r")).cast("int").alias("r"), "c", "o2", "vmax", "vessel", "dt"))


@query("p02_initial_concentration_after_vessels", f"WITH {GRID} SELECT r, c, 0.25::DOUBLE AS o2, vessel_o2 FROM g0")
def _(spark, d):
    return tissue.set_initial_concentration(derived.tissue_grid(spark, d), 0.25).select("r", "c", "o2", "vessel_o2")


@query("p05_species_diffusivity", f"WITH {GRID} SELECT r, c, {r('2.0 * epsilon / tau', 'o2_nano')}, {r('1.6 * epsilon / tau', 'co2_nano')} FROM g0")
def _(spark, d):
    cells = tissue.with_diffusivities(derived.tissue_grid(spark, d), OXYGEN, CARBON_DIOXIDE)
    return rounded(cells.select("r", "c", (F.col("d_o2") * 1e9).alias("o2_nano"), (F.col("d_co2") * 1e9).alias("co2_nano")))


FLUX = "CASE WHEN lead(o2) OVER {w} IS NULL THEN NULL ELSE -0.5::DOUBLE * (d_o2 + lead(d_o2) OVER {w}) * (lead(o2) OVER {w} - o2) / {s} END"


@query("w01_flux", f"WITH {GRID} SELECT r, c, {r(FLUX.format(w='wr', s=2.0), 'jx')}, {r(FLUX.format(w='wc', s=0.5), 'jy')} FROM g0 {WINDOWS}")
def _(spark, d):
    return rounded(stencil.flux(derived.tissue_grid(spark, d), "o2", "d_o2", 2.0, 0.5).select("r", "c", "jx", "jy"))


@query("w02_w03_diffusion_tendency", f"""WITH {GRID}, f AS (SELECT r, c, {FLUX.format(w='wr', s=2.0)} AS jx, {FLUX.format(w='wc', s=0.5)} AS jy FROM g0 {WINDOWS})
SELECT r, c, {r('(coalesce(lag(jx) OVER wr, 0.0) - coalesce(jx, 0.0)) / 2.0 + (coalesce(lag(jy) OVER wc, 0.0) - coalesce(jy, 0.0)) / 0.5', 'dc_dt')} FROM f {WINDOWS}""")
def _(spark, d):
    return rounded(stencil.diffusion_tendency(derived.tissue_grid(spark, d), "o2", "d_o2", 2.0, 0.5).select("r", "c", "dc_dt"))


@query("w04_five_point_stencil", f"WITH {GRID} SELECT r, c, {r(spread('o2', 'd_o2'), 'spread')} FROM g0 {WINDOWS}")
def _(spark, d):
    return rounded(derived.tissue_grid(spark, d).select("r", "c", stencil.five_point("o2", "d_o2", 1.0, 1.0).alias("spread")))


@query("w05_consumption", f"WITH {GRID}, s AS (SELECT * REPLACE (o2 - 0.1 AS o2) FROM g0) SELECT r, c, {r(USED, 'clip')}, {r('CASE WHEN km + o2 > 0 THEN vmax * o2 / (km + o2) ELSE 0.0 END', 'guarded')} FROM s")
def _(spark, d):
    cells = derived.tissue_grid(spark, d).withColumn("o2", F.col("o2") - 0.1)
    args = [F.col(x) for x in ("o2", "vmax", "km", "vessel")]
    return rounded(cells.select("r", "c", scalars.michaelis_menten(*args).alias("clip"), scalars.michaelis_menten(*args, mode="guarded").alias("guarded")))


@query("w06_explicit_step", f"{steps_sql(1)} SELECT r, c, {r('o2', 'o2')} FROM g1")
def _(spark, d):
    return rounded(stencil.explicit_step(derived.tissue_grid(spark, d), STEP).select("r", "c", "o2"))


@query("w07_gas_exchange_step", f"{steps_sql(1)} SELECT {STATE} FROM g1")
def _(spark, d):
    return rounded(stencil.gas_exchange_step(derived.tissue_grid(spark, d), STEP).select("r", "c", "o2", "co2"))


@query("w08_p14_step_without_reset", f"{steps_sql(1, reset=False)} SELECT {STATE} FROM g1")
def _(spark, d):
    return rounded(stencil.gas_exchange_step(derived.tissue_grid(spark, d), stencil.StepParams(0.05, reset=False)).select("r", "c", "o2", "co2"))


@query("p15_vessel_override", f"{steps_sql(1)} SELECT r, c, CASE WHEN vessel THEN 7.0 ELSE round(o2, 6) + 0.0 END AS o2, CASE WHEN vessel THEN 0.5 ELSE round(co2, 6) + 0.0 END AS co2 FROM g1")
def _(spark, d):
    return rounded(stencil.gas_exchange_step(derived.tissue_grid(spark, d), STEP, vessel_o2=7.0, vessel_co2=0.5).select("r", "c", "o2", "co2"))


@query("g14_steps_by_windows", f"{steps_sql(5)} SELECT {STATE} FROM g5")
def _(spark, d):
    return rounded(iterate.run_steps(derived.tissue_grid(spark, d), STEP, 5, "windows").select("r", "c", "o2", "co2"))


@query("g14_steps_by_bands", f"{steps_sql(12)} SELECT {STATE} FROM g12")
def _(spark, d):
    return rounded(iterate.steps_by_bands(derived.tissue_grid(spark, d), STEP, 12, band=64, halo=8).select("r", "c", "o2", "co2"))


@query("g14_steps_by_tiles", f"{steps_sql(12)} SELECT {STATE} FROM g12")
def _(spark, d):
    return rounded(iterate.steps_by_tiles(derived.tissue_grid(spark, d), STEP, 12, tile=24, halo=5).select("r", "c", "o2", "co2"))


@query("g15_auto_engine", f"{steps_sql(13)} SELECT {STATE} FROM g13")
def _(spark, d):
    return rounded(iterate.run_steps(derived.tissue_grid(spark, d), STEP, 13).select("r", "c", "o2", "co2"))


@query("g17_preset_steps", f"{steps_sql(3)} SELECT {STATE} FROM g3")
def _(spark, d):
    return rounded(simulate.reaction_diffusion(derived.tissue_grid(spark, d), 3, 0.05).select("r", "c", "o2", "co2"))


@query("g16_chunk_totals", f"{steps_sql(4)} SELECT 0 AS frame_id, {r('sum(o2)', 'o2', 4)}, {r('sum(co2)', 'co2', 4)} FROM g2 UNION ALL SELECT 1, round(sum(o2), 4) + 0.0, round(sum(co2), 4) + 0.0 FROM g4")
def _(spark, d):
    parts = [rounded(f.cells.agg(F.sum("o2").alias("o2"), F.sum("co2").alias("co2")), 4).select(F.lit(f.frame_id).alias("frame_id"), "o2", "co2") for f in simulate.frames(derived.tissue_grid(spark, d), STEP, 2, 2)]
    return parts[0].union(parts[1])


UNIT = "least(greatest({}, 0.0), 1.0)"


def _mix(a: float, b: float) -> str:
    return UNIT.format(f"{UNIT.format('o2')} * {a}::DOUBLE + {UNIT.format('co2 / 0.5')} * {b}::DOUBLE")


LACK = UNIT.format("(0.2::DOUBLE - o2) / 0.2::DOUBLE")


OVERLAY = f"""CASE WHEN vessel THEN 0.45 ELSE round({_mix(1.0, 0.0)} * (1 - 0.7::DOUBLE * {LACK}), 6) END::DOUBLE AS red,
CASE WHEN vessel THEN 0.0 ELSE round({_mix(0.55, 0.8)} * (1 - 0.7::DOUBLE * {LACK}), 6) END::DOUBLE AS green, CASE WHEN vessel THEN 0.0 ELSE round({_mix(0.1, 1.0)} * (1 - 0.7::DOUBLE * {LACK}), 6) END::DOUBLE AS blue,
CASE WHEN vessel THEN 1.0 ELSE round({UNIT.format(_mix(0.65, 0.55) + f" + 0.75::DOUBLE * {LACK}")}, 6) END::DOUBLE AS alpha"""


@query("p08_s16_overlay", f"{steps_sql(1)} SELECT r, c, {OVERLAY} FROM g1")
def _(spark, d):
    return rounded(tissue.overlay_frame(stencil.gas_exchange_step(derived.tissue_grid(spark, d), STEP)))


@query("g16_streamed_frames", f"{steps_sql(6)} " + " UNION ALL ".join(f"SELECT {i}::INT AS frame_id, r, c, {r(f'{i + 1} * 2 * 0.05::DOUBLE', 'time')}, {OVERLAY} FROM g{2 * i + 2}" for i in range(3)))
def _(spark, d):
    """Three ticks as a stream that ends with them; its frames read back."""
    folder = Scratch(spark, "stream").path()
    for chunk in range(3):
        spark.range(chunk, chunk + 1).toDF("chunk").coalesce(1).write.parquet(f"{folder}/ticks/{chunk}")
    cells = derived.tissue_grid(spark, d).select("r", "c", *iterate.STATE, *iterate.STATIC)
    stream_frames(spark, ticks_from(spark, f"{folder}/ticks"), cells, STEP, 2, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out/frames").select("frame_id", "r", "c", "time", "red", "green", "blue", "alpha"))


@query("a16_largest_error", f"{steps_sql(2)} SELECT {r('max(abs(a.o2 - b.o2))', 'o2')}, {r('max(abs(a.co2 - b.co2))', 'co2')} FROM g1 a JOIN g2 b USING (r, c)")
def _(spark, d):
    one = stencil.gas_exchange_step(derived.tissue_grid(spark, d), STEP)
    return rounded(simulate.largest_error(one, stencil.gas_exchange_step(one, STEP), ["o2", "co2"]))


@query("f14_cell_index", f"WITH {GRID} SELECT r, c, r * 64 + c AS idx FROM g0")
def _(spark, d):
    return derived.raw_grid(spark, d).select("r", "c", scalars.cell_index(F.col("r"), F.col("c"), 64).alias("idx"))


@query("a14_timing_summary", f"WITH s AS (SELECT event_type AS label, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type) SELECT label, {r('mean', 'mean')}, {r('std', 'std')}, {r('min', 'min')}, {r('max', 'max')}, {r('max(mean) OVER () / mean', 'speedup')} FROM s")
def _(spark, d):
    return rounded(simulate.timing_summary(derived.table(spark, d, "events").select(F.col("event_type").alias("label"), F.col("value").alias("seconds"))))


@query("f17_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part")
def _(spark, d):
    return derived.table(spark, d, "part").select("p_partkey", scalars.slug(F.col("p_name")).alias("slug"))


# ---- networks ----


@query("s06_j01_network_from_tables", f"WITH {NETWORK} SELECT segment_id, start_node, end_node, n AS points, {r('x0', 'x_first')}, {r('y1', 'y_last')}, {r('radius', 'radius')} FROM segments")
def _(spark, d):
    _, s = own_network(spark, d)
    first, last = F.element_at("centerline", 1), F.element_at("centerline", -1)
    return rounded(s.select("segment_id", "start_node", "end_node", F.size("centerline").alias("points"), first["x"].alias("x_first"), last["y"].alias("y_last"), F.element_at("radii", 1).alias("radius")))


@query("w11_g03_interpolated_points", f"WITH {NETWORK} SELECT segment_id, i::INT AS pos, {r('x0 + (x1 - x0) * i / (n - 1)', 'x')}, {r('y0 + (y1 - y0) * i / (n - 1)', 'y')} FROM (SELECT *, unnest(range(n)) AS i FROM segments)")
def _(spark, d):
    _, s = own_network(spark, d)
    return rounded(s.select("segment_id", F.posexplode("centerline").alias("pos", "p")).select("segment_id", "pos", "p.x", "p.y"))


MEASURES = f"length_px * 2.0 AS length_um, radius * 2.0 AS r_um, {math.pi} AS pi"


@query("a01_f02_f06_segment_measures", f"WITH {NETWORK}, m AS (SELECT segment_id, radius, {MEASURES} FROM segments) SELECT segment_id, {r('radius', 'mean_radius_px')}, {r('r_um', 'mean_radius_um')}, {r('length_um', 'length_um')}, {r('pi * r_um * r_um', 'cross_section_um2')}, {r('2 * pi * r_um * length_um', 'surface_um2')}, {r('pi * r_um * r_um * length_um', 'volume_um3', 4)} FROM m")
def _(spark, d):
    _, s = own_network(spark, d)
    m = network.measured(s.withColumn("scale", F.lit(2.0)))
    return rounded(m.select("segment_id", "mean_radius_px", "mean_radius_um", "length_um", "cross_section_um2", "surface_um2")).join(rounded(m.select("segment_id", "volume_um3"), 4), "segment_id")


@query("w09_centerline_length", f"WITH {NETWORK} SELECT segment_id, {r('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))', 'length')} FROM segments")
def _(spark, d):
    _, s = own_network(spark, d)
    return rounded(s.select("segment_id", scalars.centerline_length(F.col("centerline")).alias("length")))


@query("a02_a11_network_totals", f"WITH {NETWORK} SELECT count(*) AS segments, {r('sum(length_px)', 'total_length_um', 3)}, {r(f'sum({math.pi} * radius * radius * length_px)', 'total_volume_um3', 3)} FROM segments")
def _(spark, d):
    return rounded(network.totals(own_network(spark, d)[1]), 3)


@query("f01_f07_f08_g10_resistances", f"WITH {FLOW} SELECT segment_id, {r('resistance * 1e-15', 'resistance_e15', 9)}, {r('(p0 - p1) * 133.322', 'drop_pa')} FROM flows")
def _(spark, d):
    pressures, flows = solved_paths(spark, d)
    return rounded(flows.select("segment_id", (F.col("start_pressure_pa") - F.col("end_pressure_pa")).alias("drop_pa"))).join(
        rounded(flows.select("segment_id", (F.col("resistance_pa_s_per_m3") * 1e-15).alias("resistance_e15")), 9), "segment_id"
    )


INCIDENT = "inc AS (SELECT start_node AS node_id, end_node AS other, segment_id FROM edges UNION ALL SELECT end_node, start_node, segment_id FROM edges)"


@query("a03_endpoints", f"WITH {PATHS}, {INCIDENT} SELECT node_id, count(*) AS degree FROM inc GROUP BY node_id HAVING count(*) = 1")
def _(spark, d):
    found = lines(spark, d)
    return network.endpoint_nodes(derived.path_nodes(found), derived.path_edges(found).withColumnRenamed("edge_id", "segment_id")).select("node_id", "degree")


@query("a04_j06_neighbor_map", f"WITH {PATHS}, {INCIDENT} SELECT n.node_id, coalesce(array_to_string(list_sort(list(DISTINCT other) FILTER (other IS NOT NULL)), ','), '') AS neighbors FROM nodes n LEFT JOIN inc USING (node_id) GROUP BY n.node_id")
def _(spark, d):
    found = lines(spark, d)
    near = network.neighbor_map(derived.path_nodes(found), derived.path_edges(found).withColumnRenamed("edge_id", "segment_id"))
    return near.select("node_id", F.array_join("neighbors", ",").alias("neighbors"))


@query("g01_violations", f"WITH {PATHS}, seg AS (SELECT l_orderkey * 1000 + pos AS id, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY pos) AS b FROM lines), known AS (SELECT p_partkey FROM part WHERE p_size > 25) SELECT 'end doesn''t exist' AS problem, id FROM seg WHERE b IS NOT NULL AND (a NOT IN (SELECT * FROM known) OR b NOT IN (SELECT * FROM known))")
def _(spark, d):
    nodes, segments = derived.part_graph(spark, d)
    return network.violations(nodes.where("x > 25"), segments)


@query("g02_f12_connected_segments", f"WITH {PATHS}, {INCIDENT} SELECT DISTINCT node_id, segment_id, other FROM inc")
def _(spark, d):
    found = lines(spark, d)
    segments = derived.path_edges(found).withColumnRenamed("edge_id", "segment_id")
    at = network.connected_segments(segments, derived.path_nodes(found)).join(segments.select("segment_id", "start_node", "end_node"), "segment_id")
    return at.select("node_id", "segment_id", scalars.other_node(F.col("start_node"), F.col("end_node"), F.col("node_id")).alias("other"))


@query("g04_components", f"WITH {PATHS} SELECT l_orderkey * 1000 + pos AS node_id, l_orderkey * 1000 AS component FROM nodes")
def _(spark, d):
    found = lines(spark, d)
    return network.component_labels(derived.path_nodes(found), derived.path_edges(found).withColumnRenamed("edge_id", "segment_id"))


@query("g04_t03_largest_component", f"WITH {PATHS} SELECT node_id FROM nodes WHERE l_orderkey = (SELECT l_orderkey FROM lines GROUP BY l_orderkey ORDER BY count(*) DESC, l_orderkey LIMIT 1)")
def _(spark, d):
    found = lines(spark, d)
    return network.largest_component(derived.path_nodes(found), derived.path_edges(found).withColumnRenamed("edge_id", "segment_id"))


@query("g05_t02_pressure_ends", f"WITH {PATHS}, big AS (SELECT * FROM nodes WHERE l_orderkey = (SELECT l_orderkey FROM lines GROUP BY l_orderkey ORDER BY count(*) DESC, l_orderkey LIMIT 1)) SELECT arg_min(node_id, (x, node_id)) AS inlet, arg_max(node_id, (x, -node_id)) AS outlet, count(*) AS size FROM big")
def _(spark, d):
    found = lines(spark, d)
    return network.pressure_boundary_nodes(derived.path_nodes(found), derived.path_edges(found).withColumnRenamed("edge_id", "segment_id"))


@query("p11_flagged_nodes", f"WITH {PATHS} SELECT node_id FROM nodes WHERE pos = 0")
def _(spark, d):
    return network.flagged_nodes(lines(spark, d).select("node_id", (F.col("pos") == 0).alias("is_inlet")), "is_inlet").select("node_id")


@query("s07_s09_j12_network_from_graph", f"WITH {PATHS}, {GRID} SELECT row_number() OVER (ORDER BY e.segment_id) - 1 AS segment_id, start_node, a.x AS x0, b.y AS y1, {r('ga.o2', 'first_radius')} FROM edges e JOIN nodes a ON a.node_id = start_node JOIN nodes b ON b.node_id = end_node JOIN raw ga ON ga.r = least(greatest(a.y::INT, 0), (SELECT max(r) FROM raw)) AND ga.c = least(greatest(a.x::INT, 0), 63)")
def _(spark, d):
    found = lines(spark, d)
    at, edges = derived.path_nodes(found), derived.path_edges(found)
    even = F.col("node_id") % 2 == 0  # half of the nodes have their place in x and y, the others in pos
    nodes = at.select(F.col("node_id").cast("string").alias("name"), F.when(even, F.col("x")).alias("x"), F.when(even, F.col("y")).alias("y"), F.when(~even, F.struct("x", "y")).alias("pos"))
    own = edges.select(F.col("edge_id").alias("ord"), F.col("start_node").cast("string").alias("start_name"), F.col("end_node").cast("string").alias("end_name"))
    _, segments = network.network_from_graph(nodes, own, derived.raw_grid(spark, d).select("r", "c", F.col("o2").alias("radius")))
    return rounded(segments.select("segment_id", "start_node", F.element_at("centerline", 1)["x"].alias("x0"), F.element_at("centerline", -1)["y"].alias("y1"), F.element_at("radii", 1).alias("first_radius")))


@query("s08_s09_w12_own_lines", f"""WITH {PATHS}, {GRID}, e AS (SELECT segment_id, start_node, end_node, CASE WHEN edges.pos % 3 = 2 THEN 2 ELSE 3 END AS n, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, row_number() OVER (ORDER BY segment_id) - 1 AS id
  FROM edges JOIN nodes a ON a.node_id = start_node JOIN nodes b ON b.node_id = end_node), p AS (
  SELECT id, start_node, n, i, CASE WHEN i = 0 THEN x0 WHEN i = n - 1 THEN x1 ELSE 60.0 END AS x, CASE WHEN i = 0 THEN y0 WHEN i = n - 1 THEN y1 ELSE y0 + 1 END AS y FROM (SELECT *, unnest(range(n)) AS i FROM e)
), look AS (SELECT id, start_node, n, i, x, round(coalesce(g.o2, 0.0), 4) AS radius FROM p LEFT JOIN raw g ON g.r = least(greatest(y::INT, 0), (SELECT max(r) FROM raw)) AND g.c = least(greatest(round_even(x, 0)::INT, 0), 63))
SELECT id AS segment_id, start_node, n::INT AS points, round(sum(x), 4) + 0.0 AS across, round(sum((i + 1) * radius), 4) + 0.0 AS radii FROM look GROUP BY id, start_node, n""")
def _(spark, d):
    """Nodes with their place in position or coord; edges with points under path or coords, a third of them with neither."""
    found = lines(spark, d)
    at, edges = derived.path_nodes(found), derived.path_edges(found)
    even = F.col("node_id") % 2 == 0
    nodes = at.select(F.col("node_id").cast("string").alias("name"), F.when(even, F.struct("x", "y")).alias("position"), F.when(~even, F.struct("x", "y")).alias("coord"))
    ends = edges.join(at.select(F.col("node_id").alias("start_node"), F.struct("x", "y").alias("p")), "start_node").join(at.select(F.col("node_id").alias("end_node"), F.struct("x", "y").alias("q")), "end_node")
    bent = F.array("p", F.struct(F.lit(60.0).alias("x"), (F.col("p.y") + 1).alias("y")), "q")
    kind = F.col("start_node") % 1000 % 3
    own = ends.select(F.col("edge_id").alias("ord"), F.col("start_node").cast("string").alias("start_name"), F.col("end_node").cast("string").alias("end_name"), F.when(kind == 0, bent).alias("path"), F.when(kind == 1, bent).alias("coords"))
    _, segments = network.network_from_graph(nodes, own, derived.raw_grid(spark, d).select("r", "c", F.round("o2", 4).alias("radius")))
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weighed = F.transform("radii", lambda v, i: v * (i + 1))
    return rounded(segments.select("segment_id", "start_node", F.size("centerline").alias("points"), sums(F.transform("centerline", lambda p: p["x"])).alias("across"), sums(weighed).alias("radii")), 4)


# ---- flow ----


@query("g11_g12_f13_pressures", f"WITH {FLOW} SELECT node_id, {r('mmhg', 'pressure_mmhg')} FROM solved")
def _(spark, d):
    return rounded(solved_paths(spark, d)[0].select("node_id", scalars.mmhg(F.col("pressure")).alias("pressure_mmhg")))


CHAIN = f"""chain AS (
  SELECT o_orderkey AS node_id, sum(CASE WHEN next IS NULL THEN 0.0 ELSE 8.0 * {MU} * ((10 + o_totalprice::DOUBLE / 1000) * 1e-6) / ({math.pi} * pow(2e-6, 4.0)) END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT *, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next FROM orders)
)"""


@query("g11_large_component", f"WITH {CHAIN} SELECT node_id, round(35.0 - 20.0 * coalesce(before, 0.0) / (SELECT max(before) FROM chain), 5) + 0.0 AS pressure_mmhg FROM chain")
def _(spark, d):
    nodes, edges = derived.order_chain(spark, d)
    own, segments = network.network_from_tables(nodes, edges)
    ends = nodes.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b")).select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.lit(35.0).alias("pressure_mmhg")), F.struct(F.col("b").alias("node_id"), F.lit(15.0).alias("pressure_mmhg")))).alias("e")).select("e.*")
    return rounded(flow.solve_network_flow_mmhg(own, segments, ends, dense=500)[0].select("node_id", scalars.mmhg(F.col("pressure")).alias("pressure_mmhg")), 5)


SHEET = """own AS (SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey), across AS (SELECT ceil(sqrt(max(id) + 1))::BIGINT AS k, min(id) AS first, max(id) AS last FROM own),
sheet AS (
  SELECT id AS a, id + 1 AS b FROM own, across WHERE id % k + 1 < k AND id + 1 IN (SELECT id FROM own) UNION ALL SELECT id, id + k FROM own, across WHERE id + k IN (SELECT id FROM own)
), reached AS (
  SELECT id FROM own WHERE id IN (SELECT a FROM sheet) OR id IN (SELECT b FROM sheet) OR id IN (SELECT first FROM across) OR id IN (SELECT last FROM across)
)"""


def _balance(pressures: DataFrame, flows: DataFrame, fixed: DataFrame, tolerance: float = 1e-11) -> DataFrame:
    """(node_id, segments, fixed, balanced, between): whether a node's flows add up to nothing beside what its conductances carry at its neighbours' pressures, and its pressure lies between those of its neighbours."""
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("node_id"), (sign * F.col("flow_m3_per_s")).alias("q"), F.when(F.col("start_node") != F.col("end_node"), F.col(p)).alias("far"), (F.col(p) / F.col("resistance_pa_s_per_m3")).alias("size")) for a, sign, p in (("start_node", 1, "end_pressure_pa"), ("end_node", -1, "start_pressure_pa"))]))
    sums = flows.select(sides.alias("s")).select("s.*").groupBy("node_id").agg(F.count("*").alias("segments"), F.sum("q").alias("net"), F.sum("size").alias("size"), F.min("far").alias("low"), F.max("far").alias("high"))
    found = pressures.join(sums, "node_id", "left").join(fixed.select("node_id", F.lit(True).alias("fixed")), "node_id", "left").na.fill(False, ["fixed"])
    slack = 1e-9 * F.col("pressure")
    return found.select(
        "node_id", F.coalesce("segments", F.lit(0)).cast("bigint").alias("segments"), "fixed", F.coalesce(F.abs("net") <= tolerance * F.col("size"), F.lit(True)).alias("balanced"),
        F.coalesce((F.col("pressure") >= F.col("low") - slack) & (F.col("pressure") <= F.col("high") + slack), F.lit(True)).alias("between"),
    )


@query("g11_decomposed_sheet", f"""WITH {SHEET} SELECT id AS node_id, (SELECT count(*) FROM sheet WHERE a = id OR b = id) AS segments, id = first OR id = last AS fixed,
NOT (id = first OR id = last) AS balanced, NOT (id = first OR id = last) AS between FROM reached, across""")
def _(spark, d):
    nodes, edges, fixed = derived.order_sheet(spark, d)
    own, segments = network.network_from_tables(nodes, edges)
    return _balance(*flow.solve_network_flow_mmhg(own, segments, fixed, front=12_000), fixed)


@query("g11_gradients_on_parts", f"""WITH RECURSIVE {PATHS}, seg AS (
  SELECT * FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY pos) AS b FROM lines) WHERE b IS NOT NULL
), side AS (SELECT a, b FROM seg UNION ALL SELECT b, a FROM seg), ends AS (SELECT min(p_partkey) AS first, max(p_partkey) AS last FROM part), reach(id) AS (
  SELECT unnest([first, last]) FROM ends UNION SELECT b FROM reach JOIN side ON a = id
) SELECT id AS node_id, (SELECT count(*) FROM side WHERE a = id) AS segments, id = first OR id = last AS fixed, NOT (id = first OR id = last) AS balanced, NOT (id = first OR id = last) AS between FROM reach, ends""")
def _(spark, d):
    """Parts that follow each other in an order: a graph without small separators, which goes to conjugate gradients."""
    nodes, steps = derived.part_graph(spark, d)
    line = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.lit(0.0).alias("y")) for k in (0, 1)])
    radius = F.array(1 + (F.col("segment_id") % 7) / 7)
    segments = steps.select("segment_id", "start_node", "end_node", line.alias("centerline"), radius.alias("radii"), F.lit(1.0).alias("scale"), (10.0 + F.col("segment_id") % 11).alias("meta_length_px"))
    ends = nodes.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    fixed = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.lit(35.0).alias("pressure_mmhg")), F.struct(F.col("b").alias("node_id"), F.lit(15.0).alias("pressure_mmhg")))).alias("e")).select("e.*")
    return _balance(*flow.solve_network_flow_mmhg(nodes, segments, fixed, dense=100), fixed, 1e-9)


@query("f13_point_lookups", f"WITH {FLOW} SELECT 'node' AS kind, node_id AS id, {r('mmhg', 'value', 4)} FROM solved WHERE node_id = (SELECT min(node_id) FROM nodes) UNION ALL SELECT 'segment', segment_id, {r('q * 1e18', 'value', 2)} FROM flows WHERE segment_id = (SELECT min(segment_id) FROM edges)")
def _(spark, d):
    pressures, flows = solved_paths(spark, d)
    node, segment = (df.agg(F.min(c)).first()[0] for df, c in ((pressures, "node_id"), (flows, "segment_id")))
    one = rounded(flow.node_pressure_mmhg(pressures, node).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("pressure_mmhg").alias("value")), 4)
    return one.union(rounded(flow.segment_flow_um3_per_s(flows, segment).select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"), F.col("flow_um3_per_s").alias("value")), 2))


@query("f15_invalid_segments", f"WITH {NETWORK} SELECT segment_id, 'radii are neither one nor one a point' AS problem FROM segments WHERE 1 + (l_orderkey + pos) % 2 NOT IN (1, n) UNION ALL SELECT segment_id, 'radius is negative' FROM segments WHERE radius < 0.6")
def _(spark, d):
    _, s = own_network(spark, d)
    radius = F.element_at("radii", 1) - F.when(F.element_at("radii", 1) < 0.6, 1.0).otherwise(0.0)
    at = F.floor(F.col("segment_id") / 1000) + F.col("segment_id") % 1000
    return network.invalid_segments(s.withColumn("radii", F.array_repeat(radius, (1 + at % 2).cast("int"))))


@query("g13_j05_segment_flows", f"WITH {FLOW} SELECT segment_id, {r('q * 1e18', 'flow_um3_per_s', 2)} FROM flows")
def _(spark, d):
    return rounded(solved_paths(spark, d)[1].select("segment_id", "flow_um3_per_s"), 2)


@query("g09_pressure_connected", f"WITH {PATHS} SELECT node_id, l_orderkey * 1000 AS component FROM nodes WHERE l_orderkey IN (SELECT l_orderkey FROM lines GROUP BY l_orderkey HAVING count(*) > 3)")
def _(spark, d):
    found = lines(spark, d)
    return flow.pressure_connected(derived.path_nodes(found), derived.path_edges(found).withColumnRenamed("edge_id", "segment_id"), found.where("pos = 3").select("node_id"))


@query("a13_pressure_system", f"""WITH {PATHS}, last AS (SELECT l_orderkey, max(pos) AS last FROM lines GROUP BY l_orderkey),
sides AS (SELECT start_node AS row, end_node AS other, 1 / length_px AS g FROM edges UNION ALL SELECT end_node, start_node, 1 / length_px FROM edges),
unknown AS (SELECT node_id FROM nodes JOIN last USING (l_orderkey) WHERE pos <> 0 AND pos <> last)
SELECT row, row AS col, {r('sum(g)', 'value')} FROM sides WHERE row IN (SELECT * FROM unknown) GROUP BY row
UNION ALL SELECT row, other, round(-sum(g), 6) + 0.0 FROM sides WHERE row IN (SELECT * FROM unknown) AND other IN (SELECT * FROM unknown) GROUP BY row, other""")
def _(spark, d):
    found = lines(spark, d)
    g = derived.path_edges(found).select(F.col("edge_id").alias("segment_id"), "start_node", "end_node", (1 / F.col("length_px")).alias("g"))
    return rounded(flow.pressure_system(g, fixed_ends(found).withColumnRenamed("pressure_mmhg", "pressure"))[0])


@query("a05_a09_flow_statistics", f"WITH {FLOW} SELECT count(*) AS segments, {r('min(abs(q * 1e18))', 'min_flow', 2)}, {r('avg(abs(q * 1e18))', 'mean_flow', 2)}, {r('max(abs(q * 1e18))', 'max_flow', 2)} FROM flows")
def _(spark, d):
    return rounded(flow.flow_statistics(solved_paths(spark, d)[1]), 2)


@query("r09_uniform_concentrations", f"WITH {PATHS} SELECT segment_id, 1.0::DOUBLE AS oxygen, 0.0::DOUBLE AS carbon_dioxide FROM edges")
def _(spark, d):
    return transport.uniform_concentrations(derived.path_edges(lines(spark, d)).withColumnRenamed("edge_id", "segment_id"))


@query("r10_f09_flow_weighted", f"WITH {FLOW}, {WEIGHTED} SELECT segment_id, {r('oxygen', 'oxygen')}, {r('carbon_dioxide', 'carbon_dioxide')} FROM conc")
def _(spark, d):
    return rounded(transport.flow_weighted_concentrations(solved_paths(spark, d)[1]))


# ---- rasters and coupling ----


@query("r01_p10_p12_f10_centerline_mask", f"WITH {PIXELS} SELECT DISTINCT y, x FROM inside")
def _(spark, d):
    return raster.centerline_mask(own_network(spark, d)[1], *derived.image_shape(spark, d))


@query("r02_r04_u02_vessel_mask", f"WITH {MASK} SELECT y, x FROM vessel")
def _(spark, d):
    return raster.source_mask(own_network(spark, d)[1], *derived.image_shape(spark, d))


@query("r05_a15_w12_segment_pixel_map", f"WITH {PIXELS} {disk_sql('radius')}")
def _(spark, d):
    return raster.segment_pixel_map(own_network(spark, d)[1], *derived.image_shape(spark, d))


@query("t01_sorted_pixel_lists", f"WITH {PIXELS}, m AS ({disk_sql('radius')}) SELECT segment_id, string_agg(y || ':' || x, ' ' ORDER BY y, x) AS pixels FROM m GROUP BY segment_id")
def _(spark, d):
    found = raster.as_sorted_lists(raster.segment_pixel_map(own_network(spark, d)[1], *derived.image_shape(spark, d)))
    return found.select("segment_id", F.array_join(F.transform("pixels", lambda p: F.concat_ws(":", p["y"], p["x"])), " ").alias("pixels"))


@query("r03_u01_exchange_mask", f"WITH {MASK}, wide AS (SELECT DISTINCT y, x FROM ({disk_sql('radius + 1')})) SELECT y, x FROM wide ANTI JOIN vessel USING (y, x)")
def _(spark, d):
    return raster.exchange_mask(own_network(spark, d, several=True)[1], *derived.image_shape(spark, d))


@query("r06_u04_exchange_pixel_map", f"WITH {PIXELS} {disk_sql('radius + 1', 'radius')}")
def _(spark, d):
    return raster.exchange_pixel_map(own_network(spark, d)[1], *derived.image_shape(spark, d))


@query("r07_w10_u03_boundary_mask", f"WITH {BOUNDARY} SELECT y, x FROM boundary")
def _(spark, d):
    return raster.vessel_boundary(own_network(spark, d)[1], *derived.image_shape(spark, d))


@query("p09_outline_with_skeleton", f"WITH {BOUNDARY}, bone AS (SELECT DISTINCT y, x, true AS b FROM inside) SELECT coalesce(o.y, s.y) AS y, coalesce(o.x, s.x) AS x, 1.0::DOUBLE AS red, CASE WHEN b THEN 0.0 ELSE 1.0 END::DOUBLE AS green, CASE WHEN b THEN 0.0 ELSE 1.0 END::DOUBLE AS blue FROM boundary o FULL JOIN bone s ON o.y = s.y AND o.x = s.x")
def _(spark, d):
    shape = derived.image_shape(spark, d)
    _, s = own_network(spark, d, several=True)
    return raster.outline_with_skeleton(raster.boundary_mask(raster.vessel_runs(s, *shape)), raster.centerline_mask(s, *shape))


@query("a10_r16_mask_counts", f"WITH {BOUNDARY} SELECT 'centerline' AS mask, count(*) AS pixels FROM (SELECT DISTINCT y, x FROM inside) UNION ALL SELECT 'vessel', count(*) FROM vessel UNION ALL SELECT 'outline', count(*) FROM boundary")
def _(spark, d):
    shape = derived.image_shape(spark, d)
    _, s = own_network(spark, d, several=True)
    masks = raster.debug_masks(s, raster.centerline_mask(s, *shape), raster.vessel_runs(s, *shape), *shape)
    return raster.mask_counts({k: masks[k] for k in ("centerline", "vessel", "outline")})


@query("r04_source_mask_of_exchange", f"WITH {MASK}, wide AS (SELECT DISTINCT y, x FROM ({disk_sql('radius + 1')})) SELECT y, x FROM wide ANTI JOIN vessel USING (y, x)")
def _(spark, d):
    return raster.source_mask(own_network(spark, d, several=True)[1], *derived.image_shape(spark, d), use_exchange_region=True)


@query("s03_despeckle", f"WITH {MASK}, n AS (SELECT y, x, count(*) AS n FROM (SELECT y + dy AS y, x + dx AS x FROM vessel, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dy, dx)) GROUP BY y, x) SELECT y, x FROM vessel JOIN n USING (y, x) WHERE n >= 3")
def _(spark, d):
    return raster.despeckle(raster.vessel_runs(own_network(spark, d)[1], *derived.image_shape(spark, d)), 3)


@query("s04_thinned_vessels", f"""WITH {MASK}, square AS (
  SELECT y - dy AS y, x - dx AS x, sum(1 << 2 * dy + dx)::INT AS code FROM vessel, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(dy, dx) GROUP BY 1, 2
) SELECT (sum(CASE WHEN code IN (1, 2, 4, 8) THEN 1 WHEN code IN (7, 11, 13, 14) THEN -1 WHEN code IN (6, 9) THEN -2 ELSE 0 END) // 4)::BIGINT AS euler, 0::BIGINT AS deletable, 0::BIGINT AS outside FROM square""")
def _(spark, d):
    mask = Scratch(spark, "mask").keep(raster.vessel_runs(own_network(spark, d)[1], *derived.image_shape(spark, d)))
    return extract.summary(mask, extract.thinned_runs(mask))


@query("p06_fit_mask", f"WITH {MASK} SELECT y, x FROM vessel WHERE y < {H} // 2 AND x < 50")
def _(spark, d):
    """The upper half of a stored mask, from the bands that it meets."""
    height, width = derived.image_shape(spark, d)
    folder = Scratch(spark, "bands").path()
    storage.save_mask(raster.vessel_mask(own_network(spark, d)[1], height, width), folder, max(height // 64, 1))
    return raster.fit_mask(storage.read_mask(spark, folder, max(height // 64, 1), 0, height // 2), height // 2, 50)


@query("j08_r08_boundary_pixel_map", f"WITH {OWNED} SELECT segment_id, y, x FROM owned")
def _(spark, d):
    shape = derived.image_shape(spark, d)
    _, s = own_network(spark, d, several=True)
    return raster.reconstructed_boundary_pixel_map(s, raster.vessel_runs(s, *shape), *shape)


KNOWN = "SELECT segment_id, 0.5 + 10 * l_discount::DOUBLE AS oxygen, -l_tax::DOUBLE AS carbon_dioxide FROM (SELECT l_orderkey * 1000 + pos AS segment_id, l_discount, l_tax, l_returnflag FROM lines) WHERE l_returnflag <> 'R'"
#: The nearest centroid lies in the own band of 64 rows or a neighbouring one: a band holds some twenty orders.
LOOKUP = f"""known AS ({KNOWN}), centre AS (SELECT segment_id, avg(y) AS cy, avg(x) AS cx FROM map_ GROUP BY segment_id), solved AS (
  SELECT s.*, oxygen, carbon_dioxide, (cy // 64)::BIGINT + d AS band FROM centre s JOIN known USING (segment_id), (SELECT unnest([-1, 0, 1]) AS d)
), fill AS (
  SELECT l.segment_id, arg_min((s.oxygen, s.carbon_dioxide), (pow(l.cy - s.cy, 2) + pow(l.cx - s.cx, 2), s.segment_id)) AS v
  FROM centre l ANTI JOIN known USING (segment_id) JOIN solved s ON s.band = (l.cy // 64)::BIGINT GROUP BY l.segment_id
), lookup AS (SELECT * FROM known UNION ALL SELECT segment_id, v[1], v[2] FROM fill)"""
BORDERS = OWNED + f", map_ AS (SELECT segment_id, y, x FROM owned), {LOOKUP}"
DISKS = PIXELS + f", map_ AS MATERIALIZED ({disk_sql('radius')}), {LOOKUP}"


def _known(found: DataFrame) -> DataFrame:
    """Concentrations of the lines that weren't returned; segments of the others have none."""
    kept = found.where("l_returnflag <> 'R'")
    return kept.select(F.col("node_id").alias("segment_id"), (0.5 + 10 * F.col("l_discount")).alias("oxygen"), (-F.col("l_tax")).alias("carbon_dioxide"))


def _borders(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Boundary pixels with their one owner, as runs."""
    shape = derived.image_shape(spark, d)
    _, s = own_network(spark, d, found, several=True)
    return raster.reconstructed_boundary_runs(s, raster.vessel_runs(s, *shape), *shape)


def _disks(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Pixels of segments, where neighbours share some, as runs."""
    return Scratch(spark, "disks").keep(raster.stroke_runs(own_network(spark, d, found)[1], *derived.image_shape(spark, d)))


@query("a06_centroids", f"WITH {BORDERS} SELECT segment_id, {r('cy', 'cy')}, {r('cx', 'cx')} FROM centre")
def _(spark, d):
    return rounded(transport.centroids(_borders(spark, d, lines(spark, d))))


@query("r11_j09_completed_concentrations", f"WITH {BORDERS} SELECT segment_id, {r('oxygen', 'oxygen')}, {r('carbon_dioxide', 'carbon_dioxide')} FROM lookup")
def _(spark, d):
    found = lines(spark, d)
    return rounded(transport.complete_concentrations(_borders(spark, d, found), _known(found)))


@query("r12_a07_j10_source_maps", f"WITH {DISKS}, size AS (SELECT segment_id, count(*) AS n FROM map_ GROUP BY segment_id) SELECT y, x, {r('sum(2.0 * oxygen / n)', 'oxygen')}, {r('sum(carbon_dioxide / n)', 'carbon_dioxide')} FROM map_ JOIN lookup USING (segment_id) JOIN size USING (segment_id) GROUP BY y, x")
def _(spark, d):
    shape, found = derived.image_shape(spark, d), lines(spark, d)
    return rounded(transport.boundary_source_maps(*shape, _disks(spark, d, found), _known(found), oxygen_scale=2.0, normalize=True))


@query("r13_concentration_maps", f"WITH {DISKS} SELECT y, x, {r('arg_max(oxygen, segment_id)', 'oxygen')}, {r('arg_max(carbon_dioxide, segment_id)', 'carbon_dioxide')} FROM map_ JOIN lookup USING (segment_id) GROUP BY y, x")
def _(spark, d):
    found = lines(spark, d)
    return rounded(transport.boundary_concentration_maps(*derived.image_shape(spark, d), _disks(spark, d, found), _known(found)))


@query("a08_source_summary", f"WITH {DISKS}, m AS (SELECT y, x, sum(oxygen) AS o, sum(carbon_dioxide) AS k FROM map_ JOIN lookup USING (segment_id) GROUP BY y, x) SELECT {r('sum(o)', 'oxygen_total', 3)}, {r('greatest(max(o), 0)', 'oxygen_max')}, {r('sum(k)', 'carbon_dioxide_total', 3)}, {r('greatest(max(k), 0)', 'carbon_dioxide_max')}, {r('least(min(k), 0)', 'carbon_dioxide_min')} FROM m")
def _(spark, d):
    shape, found = derived.image_shape(spark, d), lines(spark, d)
    s = transport.summarize_sources(transport.boundary_source_maps(*shape, _disks(spark, d, found), _known(found)), *shape)
    return s.select(*[(F.round(c, 3 if c.endswith("total") else 6) + 0.0).alias(c) for c in s.columns])


@query("r15_coupled_run", f"WITH {BOUNDARY} SELECT y, x, 1.0::DOUBLE AS oxygen, -1.0::DOUBLE AS carbon_dioxide FROM boundary")
def _(spark, d):
    """From skeleton to source map: traced centerlines, network, flow between the ends of the largest component, concentrations, completion, sources. That
    component is a chain, so each of its segments carries all of its flow, and the others take their values from it: a boundary pixel has 1 and -1."""
    found = lines(spark, d)
    nodes, shape = derived.path_nodes(found), derived.image_shape(spark, d)
    vessel = Scratch(spark, "vessel").keep(raster.vessel_runs(own_network(spark, d, found)[1], *shape))
    return rounded(simulate.vessel_coupling(derived.skeleton_of(nodes), nodes, derived.path_edges(found), vessel, *shape)["sources"])


# ---- scaling and skeletons ----


@query("p07_scaled_geometry", f"WITH {PATHS} SELECT segment_id AS edge_id, {r('length_px * 1.25', 'length_px')}, {r('radius * 1.25', 'mean_radius')}, {r('radius / 2 * 1.25', 'min_radius')}, {r('tax', 'normalized_radius')} FROM edges")
def _(spark, d):
    return rounded(scaling.scale_edges(derived.path_edges(lines(spark, d)), (100, 200), (200, 100)).select("edge_id", "length_px", "mean_radius", "min_radius", "normalized_radius"))


@query("p07_scaled_nodes", f"WITH {PATHS} SELECT node_id, {r('y * 2.0', 'row')}, {r('x * 0.5', 'col')} FROM nodes")
def _(spark, d):
    return rounded(scaling.scale_nodes(derived.path_nodes(lines(spark, d)).select("node_id", "row", "col"), (100, 200), (200, 100)))


SHRUNK = "shape AS (SELECT max(r) + 1 AS rows, greatest((max(r) + 1) * 3 // 10, 1) AS t FROM raw)"


@query("r14_a12_scaled_skeleton", f"WITH {GRID}, {SHRUNK} SELECT least(round_even(r * (t::DOUBLE / rows), 0)::INT, t - 1)::INT AS r, least(round_even(c * 0.5::DOUBLE, 0)::INT, 31) AS c, {r('max(o2 * ((t::DOUBLE / rows + 0.5::DOUBLE) / 2))', 'radius')} FROM raw, shape GROUP BY 1, 2")
def _(spark, d):
    cells = derived.raw_grid(spark, d).select("r", "c", F.col("o2").alias("radius"))
    rows = cells.agg(F.max("r")).first()[0] + 1
    return rounded(scaling.scale_skeleton(cells.select("r", "c"), cells, (rows, 64), (max(rows * 3 // 10, 1), 32)))


BONES = PATHS + ", bones AS (SELECT y::INT AS r, unnest(range(min(x)::INT, max(x)::INT + 1))::INT AS c FROM nodes GROUP BY y)"


STEPS = ", ".join(f"({i}, {dr}, {dc})" for i, (dr, dc) in enumerate(skeleton.STEPS))


@query("g06_j07_skeleton_graph", f"WITH {BONES} SELECT a.r, a.c, b.r AS nr, b.c AS nc, ord FROM bones a, (VALUES {STEPS}) s(ord, dr, dc) JOIN bones b ON b.r = a.r + dr AND b.c = a.c + dc")
def _(spark, d):
    return skeleton.skeleton_graph(derived.skeleton_of(derived.path_nodes(lines(spark, d))))


@query("j11_nearest_skeleton_pixel", f"""WITH {BONES}, asked AS (SELECT node_id, y::INT + 1 + dy AS r, x::INT + dx AS c, dy * dy + dx * dx AS d2 FROM nodes, (SELECT unnest(range(-3, 4))::INT AS dy), (SELECT unnest(range(-3, 4))::INT AS dx))
SELECT node_id AS id, arg_min(r, (d2, r, c)) AS sr, arg_min(c, (d2, r, c)) AS sc FROM asked JOIN bones USING (r, c) GROUP BY node_id""")
def _(spark, d):
    nodes = derived.path_nodes(lines(spark, d))
    moved = nodes.select(F.col("node_id").alias("id"), (F.col("row") + 1).alias("row"), "col")
    return skeleton.nearest_skeleton_pixel(moved, derived.skeleton_of(nodes), *derived.image_shape(spark, d)).select("id", "sr", "sc")


@query("g07_g08_p13_j03_traced_centerlines", f"WITH {PATHS} SELECT e.segment_id AS edge_id, (abs(b.x - a.x) + 1)::INT AS points, a.x AS x_first, b.x AS x_last, a.y AS y FROM edges e JOIN nodes a ON a.node_id = start_node JOIN nodes b ON b.node_id = end_node")
def _(spark, d):
    found = lines(spark, d)
    nodes = derived.path_nodes(found)
    traced = skeleton.edge_centerlines(derived.skeleton_of(nodes), nodes, derived.path_edges(found), *derived.image_shape(spark, d))
    return traced.select("edge_id", F.size("points").alias("points"), F.element_at("points", 1)["x"].alias("x_first"), F.element_at("points", -1)["x"].alias("x_last"), F.element_at("points", 1)["y"].alias("y"))


#: From column c1 over the rung at x to c2 of the next bone: a step for each column, three down, one less for each corner that a diagonal cuts.
LADDERS = PATHS + f""", bone AS (
  SELECT l_orderkey AS k, min(x)::INT AS low, max(x)::INT AS high, arg_min(x, node_id)::INT AS c_first, arg_max(x, node_id)::INT AS c_last FROM nodes GROUP BY l_orderkey
), pair AS (
  SELECT p.k, p.c_first AS c1, q.c_last AS c2, greatest(p.low, q.low) AS a, least(p.high, q.high) AS b FROM bone p JOIN bone q ON q.k = p.k + 1 AND p.k % 8 <> 7 WHERE greatest(p.low, q.low) <= least(p.high, q.high)
), over AS (SELECT k, c1, c2, unnest(CASE WHEN b - a >= 3 THEN [a, b] ELSE [a] END) AS x FROM pair)"""


@query("g07_g08_branching_centerlines", f"""WITH {LADDERS} SELECT k AS edge_id, min(abs(c1 - x) + abs(c2 - x) + {derived.APART} - (c1 <> x)::INT - (c2 <> x)::INT + 1)::INT AS points,
any_value(c1)::DOUBLE AS x_first, any_value(c2)::DOUBLE AS x_last, true AS connected FROM over GROUP BY k""")
def _(spark, d):
    found = lines(spark, d)
    bones, edges = derived.ladders(found)
    traced = skeleton.edge_centerlines(bones, derived.path_nodes(found), edges, *derived.image_shape(spark, d))
    close = F.forall(F.sequence(F.lit(2), F.size("points")), lambda i: F.greatest(F.abs(F.get("points", i - 1)["x"] - F.get("points", i - 2)["x"]), F.abs(F.get("points", i - 1)["y"] - F.get("points", i - 2)["y"])) == 1)
    return traced.withColumn("connected", close).select("edge_id", F.element_at("points", 1)["x"].alias("x_first"), F.element_at("points", -1)["x"].alias("x_last"), "connected", F.size("points").alias("points"))


@query("j02_traced_or_straight", f"WITH {NETWORK} SELECT segment_id, CASE WHEN tax > 0.04 THEN 2 ELSE n END AS points FROM segments")
def _(spark, d):
    found = lines(spark, d)
    nodes, edges = derived.path_nodes(found), derived.path_edges(found)
    two = edges.where("normalized_radius > 0.04").select("edge_id", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))).alias("points"))
    _, s = network.network_from_tables(nodes, edges, two)
    return s.select("segment_id", F.size("centerline").alias("points"))


@query("j04_drawable_edges", f"WITH {PATHS} SELECT segment_id AS edge_id, radius AS mean_radius FROM edges e WHERE EXISTS (SELECT 1 FROM nodes WHERE node_id = start_node AND x < 30) AND EXISTS (SELECT 1 FROM nodes WHERE node_id = end_node AND x < 30)")
def _(spark, d):
    found = lines(spark, d)
    return network.drawable_edges(derived.path_nodes(found).where("x < 30"), derived.path_edges(found)).select("edge_id", "mean_radius")


@query("j13_masked_fields", f"WITH {GRID} SELECT r, c, {r('o2', 'o2')} FROM g0 WHERE vessel")
def _(spark, d):
    cells = derived.tissue_grid(spark, d)
    return rounded(tissue.masked(cells, cells.where("vessel").select("r", "c"), ["o2"]))


@query("t04_first_pixels", f"WITH {MASK} SELECT y, x FROM vessel ORDER BY y, x LIMIT 5")
def _(spark, d):
    return raster.vessel_mask(own_network(spark, d)[1], *derived.image_shape(spark, d)).orderBy("y", "x").limit(5)


@query("s05_reconstructed_mask", f"WITH {GRID} SELECT DISTINCT y, x FROM (SELECT r + dy AS y, c + dx AS x, 2 * o2 AS rad, dy, dx FROM raw, LATERAL (SELECT unnest(range(-ceil(2 * o2)::INT, ceil(2 * o2)::INT + 1))::INT AS dy), LATERAL (SELECT unnest(range(-ceil(2 * o2)::INT, ceil(2 * o2)::INT + 1))::INT AS dx)) WHERE dy * dy + dx * dx <= rad * rad AND y BETWEEN 0 AND (SELECT max(r) FROM raw) AND x BETWEEN 0 AND 63")
def _(spark, d):
    bones = derived.raw_grid(spark, d).select("r", "c", (2 * F.col("o2")).alias("radius"))
    return simulate.reconstruct_mask(bones, _rows(spark, d), 64)


@query("s10_saved_geometry", f"WITH {PATHS} SELECT node_id, {r('y', 'row')}, {r('x', 'col')}, segment_id, {r('length_px', 'length_px')}, {r('radius', 'mean_radius')} FROM nodes JOIN edges ON start_node = node_id")
def _(spark, d):
    found = lines(spark, d)
    folder = Scratch(spark, "geometry").path()
    storage.save_geometry({"nodes": derived.path_nodes(found), "edges": derived.path_edges(found)}, folder)
    back = storage.load_geometry(spark, folder, ["nodes", "edges"])
    edges = back["edges"].select(F.col("start_node").alias("node_id"), F.col("edge_id").alias("segment_id"), "length_px", "mean_radius")
    return rounded(back["nodes"].select("node_id", "row", "col").join(edges, "node_id"))


@query("r15_domain_from_structure", f"""WITH {BONES}, shape AS (SELECT {H} AS rows, {H} // 6 + 1 AS t), scaled AS (
  SELECT DISTINCT least(round_even(r * (t::DOUBLE / rows), 0)::INT, t - 1) AS r, least(round_even(c * 0.25::DOUBLE, 0)::INT, 63) AS c, 6.0::DOUBLE * ((t::DOUBLE / rows + 0.25::DOUBLE) / 2) AS rad FROM bones, shape
), mask AS (
  SELECT DISTINCT r + dy AS r, c + dx AS c FROM scaled, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= rad * rad
), cells AS (SELECT i // 64 AS r, i % 64 AS c FROM (SELECT unnest(range((SELECT t * 64 FROM shape))) AS i))
SELECT c.r::INT AS r, c.c::INT AS c, m.r IS NOT NULL AS vessel, CASE WHEN m.r IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS vessel_o2, CASE WHEN m.r IS NOT NULL THEN 0.0 ELSE 0.05 END::DOUBLE AS vmax FROM cells c LEFT JOIN mask m ON m.r = c.r AND m.c = c.c""")
def _(spark, d):
    found = lines(spark, d)
    nodes, edges, source = derived.path_nodes(found), derived.path_edges(found), derived.image_shape(spark, d)
    bones = derived.skeleton_of(nodes)
    mask = bones.select(F.col("r").alias("y"), F.col("c").alias("x"))
    built = simulate.domain_from_structure("orders", Scratch(spark, "domain").path(), mask, bones, bones.withColumn("radius", F.lit(6.0)), nodes, edges, source, (source[0] // 6 + 1, source[1] // 4))
    return built["cells"].select("r", "c", "vessel", "vessel_o2", "vmax")
