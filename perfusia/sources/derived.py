"""Grids, networks and skeletons derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfusia.operators.tissue import dense_grid, set_uniform_consumption, set_vessel_mask, with_defaults, with_diffusivities
from perfusia.functions.species import Species

LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
#: Rows of the image between two orders, so that their skeletons don't touch; columns of the image.
APART, WIDTH = 3, 256
#: Free diffusivities in cells^2 a unit of time, for grids whose cells are units.
UNIT_OXYGEN, UNIT_CARBON_DIOXIDE = Species("Oxygen", 32.0, 2.0), Species("Carbon Dioxide", 44.01, 1.6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (r, c, o2, label): r a vector, c a component, o2 its size."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("r"), "label", F.posexplode("embedding").alias("c", "v"))
    return e.select("r", "c", F.abs(F.col("v").cast("double")).alias("o2"), "label")


def seeded_fields(spark: SparkSession, height: int, width: int, seed: int = 42) -> DataFrame:
    """The random test case: fields spread evenly by arithmetic on seed and cell, three square vessels, one diffusivity for both species."""
    cells = with_defaults(dense_grid(spark, height, width).select("r", "c"))
    x = lambda k: (F.col("r").cast("long") * 73856093 + F.col("c") * 19349663 + F.lit((seed + k) * 83492791)) % 1000003
    unit = lambda k: (x(k) * x(k) + x(k)) % 1000003 / 1000003
    # Ranges, corners and side of the vessels, what they hold, kinetics.
    low_high = {"o2": (0.5, 10.0), "co2": (0.0, 2.0), "d_o2": (0.8, 1.2)}
    corners, side, held = ((20, 20), (50, 70), (80, 40)), 5, 10.0
    cells = cells.withColumns({c: a + (b - a) * unit(i) for i, (c, (a, b)) in enumerate(low_high.items())})
    vessel = reduce(lambda a, b: a | b, (F.col("r").between(r, r + side - 1) & F.col("c").between(c, c + side - 1) for r, c in corners))
    return cells.withColumns({
        "d_co2": F.col("d_o2"), "vmax": F.lit(0.5), "km": F.lit(1.0), "vessel": vessel,
        "vessel_o2": F.when(vessel, held).otherwise(0.0), "vessel_co2": F.lit(0.0),
    })


def benchmark_fields(spark: SparkSession, height: int = 1000, width: int = 1000) -> DataFrame:
    """The benchmark's uniform start: ones, no vessels."""
    # Concentration, diffusivity, vmax and km.
    values = {"o2": 1.0, "co2": 0.0, "d_o2": 1.0, "d_co2": 1.0, "vmax": 0.01, "km": 1.0, "vessel_o2": 0.0, "vessel_co2": 0.0}
    return dense_grid(spark, height, width).withColumns({k: F.lit(v) for k, v in values.items()} | {"vessel": F.lit(False)})


def tissue_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with properties by label, vessels in label 0, consumption and diffusivities."""
    raw = raw_grid(spark, sf_dir)
    cells = with_defaults(raw.withColumns({"epsilon": 0.2 + 0.05 * F.col("label"), "tau": 1 + 0.1 * F.col("label")}))
    mask = raw.where("label = 0 and c % 8 < 3").select("r", "c")
    return with_diffusivities(set_uniform_consumption(set_vessel_mask(cells, mask, 1.0), 0.05), UNIT_OXYGEN, UNIT_CARBON_DIOXIDE)


def path_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with their place in it, the last place, and the node that follows; orders are short, so a window over one is small."""
    own = Window.partitionBy("l_orderkey")
    placed = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(own.orderBy(*LINE[1:])) - 1).withColumn("last", (F.count(F.lit(1)).over(own) - 1).cast("int"))
    node = F.col("l_orderkey") * 1000 + F.col("pos")
    return placed.withColumns({"node_id": node, "next_node": F.when(F.col("pos") < F.col("last"), node + 1)})


def path_nodes(lines: DataFrame) -> DataFrame:
    """Nodes (node_id, row, col, x, y): each order is a path in a row of its own."""
    at = lines.select("node_id", (F.col("l_orderkey") * APART).cast("double").alias("row"), (F.col("pos") * 4 + F.col("l_partkey") % 3).cast("double").alias("col"))
    return at.select("node_id", "row", "col", F.col("col").alias("x"), F.col("row").alias("y"))


def image_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Rows and columns of an image that holds all orders."""
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return APART * (last or 0) + APART, WIDTH


def path_edges(lines: DataFrame) -> DataFrame:
    """Edges between lines that follow each other in an order."""
    ends = lines.withColumnRenamed("next_node", "end_node").where("end_node is not null")
    radius = 0.5 + 10 * F.col("l_discount")
    return ends.select(
        F.col("node_id").alias("edge_id"), F.col("node_id").alias("start_node"), "end_node", F.col("l_quantity").cast("double").alias("length_px"), radius.alias("mean_radius"),
        (radius / 2).alias("min_radius"), (radius * 2).alias("max_radius"), F.col("l_tax").cast("double").alias("normalized_radius"),
    )


def order_chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders as one path: nodes are orders, a segment joins an order with that of the next key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("node_id"), F.col("o_totalprice").cast("double").alias("price"))
    after = orders.select((F.col("node_id") - 1).alias("node_id"), F.col("node_id").alias("end_node"))
    edges = orders.join(after, "node_id").select(
        F.col("node_id").alias("edge_id"), F.col("node_id").alias("start_node"), "end_node", (10 + F.col("price") / 1000).alias("length_px"), F.lit(2.0).alias("mean_radius")
    )
    nodes = orders.select("node_id", F.lit(0.0).alias("row"), F.col("node_id").cast("double").alias("col"))
    return nodes, edges


def order_sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as a sheet of about as many rows as columns, each linked with the next in its row and in its column: one large component full of
    cycles, nodes (node_id, row, col), edges, and the ends of given pressure. Lengths and radii come from the order's lines and their parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    orders = lines.groupBy(F.col("l_orderkey").cast("bigint").alias("node_id")).agg((10 + F.sum("l_quantity")).cast("double").alias("length_px"), (1 + F.max("p_size") / 25).alias("mean_radius"))
    ends = orders.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    at = orders.join(F.broadcast(ends)).withColumn("across", F.ceil(F.sqrt(F.col("b") + 1)))
    at = at.withColumns({"row": F.floor(F.col("node_id") / F.col("across")).cast("double"), "col": (F.col("node_id") % F.col("across")).cast("double")})
    step = F.explode(F.array(F.when(F.col("col") + 1 < F.col("across"), F.col("node_id") + 1), F.col("node_id") + F.col("across"))).alias("end_node")
    links = at.select(F.col("node_id").alias("start_node"), step, "length_px", "mean_radius").join(orders.select(F.col("node_id").alias("end_node")), "end_node")
    edges = links.select((2 * F.col("start_node") + F.when(F.col("end_node") == F.col("start_node") + 1, 0).otherwise(1)).alias("edge_id"), "start_node", "end_node", "length_px", "mean_radius")
    fixed = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.lit(35.0).alias("pressure_mmhg")), F.struct(F.col("b").alias("node_id"), F.lit(15.0).alias("pressure_mmhg")))).alias("e")).select("e.*")
    return at.select("node_id", "row", "col"), edges, fixed


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes are parts, segments join parts that follow each other in an order of few lines, so that there are many components."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("node_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    lines = path_lines(spark, sf_dir)
    order = Window.partitionBy("l_orderkey").orderBy("pos")
    steps = lines.withColumn("next", F.lead("l_partkey").over(order)).where("next is not null")
    return nodes, steps.select(F.col("node_id").alias("segment_id"), F.col("l_partkey").alias("start_node"), F.col("next").alias("end_node"))


def skeleton_of(nodes: DataFrame) -> DataFrame:
    """A pixel (r, c) for each column between the first and last node of a row: straight skeletons in rows."""
    return nodes.groupBy(F.col("row").cast("int").alias("r")).agg(F.min("col").cast("int").alias("a"), F.max("col").cast("int").alias("b")).select("r", F.explode(F.sequence("a", "b")).alias("c"))


def ladders(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skeletons with branches and cycles: the straight ones of eight orders after each other are joined by a rung or two where their columns overlap.

    Pixels (r, c), and edges (edge_id, start_node, end_node) from an order's first node to the last of the next, where a rung joins them.
    """
    rows = path_nodes(lines).select("node_id", F.floor(F.col("node_id") / 1000).cast("bigint").alias("k"), F.col("row").cast("int").alias("r"), F.col("col").cast("int").alias("c"))
    bones = rows.groupBy("k", "r").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("node_id").alias("start_node"), F.max("node_id").alias("end_node"))
    after = bones.select((F.col("k") - 1).alias("k"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("end_node").alias("far"))
    pairs = bones.where("k % 8 <> 7").join(after, "k").withColumns({"a": F.greatest("low", "low2"), "b": F.least("high", "high2")}).where("a <= b")
    rungs = pairs.select("r", F.explode(F.when(F.col("b") - F.col("a") >= 3, F.array("a", "b")).otherwise(F.array("a"))).alias("c"))
    upright = rungs.select(F.explode(F.sequence(F.col("r") + 1, F.col("r") + APART - 1)).alias("r"), "c")
    return skeleton_of(path_nodes(lines)).union(upright), pairs.select(F.col("k").alias("edge_id"), "start_node", F.col("far").alias("end_node"))
