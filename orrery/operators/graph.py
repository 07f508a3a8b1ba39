"""Graph operators: level by level joins, each level written out to end its lineage.

Edges are tables with src and dst; no operator that starts from given nodes copies
them. A small frontier becomes a filter on both ends, which reaches the scan and
prunes it where edges are sorted (see by_node); a large one is joined. Frontiers and
seen sets stay distributed; only the number of rounds is the driver's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.relational import both_ways
from orrery.sources.shared import materialise, release


#: Frontiers of so many nodes at most are pushed down as a filter.
PUSHED = 1000


def undirected(edges: DataFrame) -> DataFrame:
    a, b = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return a.unionByName(b).distinct()


def by_node(edges: DataFrame, node: str = "src") -> DataFrame:
    """edges as a table sorted by one end, to be written once and searched often: a filter on it reads few row groups."""
    return materialise(edges.repartitionByRange(F.col(node)).sortWithinPartitions(node))


def touching(edges: DataFrame, frontier: DataFrame, directed: bool = False) -> tuple[DataFrame, Column | None]:
    """The edges with an end in the frontier (column node), and the test whether a column is in it, if that is short."""
    few = [r["node"] for r in frontier.select("node").limit(PUSHED + 1).collect()]
    if len(few) > PUSHED:
        return edges, None
    start = F.col("src").isin(few)
    return edges.where(start if directed else start | F.col("dst").isin(few)), F.col("node").isin(few)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """node, hops: nodes within so many hops of the seeds (column node), with the least number."""
    seen = materialise(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier, flat = seen, edges.select("src", "dst")
    for hop in range(1, depth + 1):
        near, inside = touching(flat, frontier, directed)
        ways = near if directed else near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ways = ways.select(F.col("src").alias("node"), "dst")
        step = ways.join(frontier.select("node"), "node", "left_semi") if inside is None else ways.where(inside)
        step = step.select(F.col("dst").alias("node")).distinct()
        frontier = materialise(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = materialise(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, a: str, b: str, most: int = 4) -> DataFrame:
    """step, node of a shortest path of at most so many hops; among those, the one of least node names backwards from b.

    Both ends grow by turns, as far as half of the length each.
    """
    spark = edges.sparkSession
    start, end = (spark.createDataFrame([(x,)], "node string") for x in (a, b))
    near, far = reach(edges, start, (most + 1) // 2), reach(edges, end, most // 2)
    met = near.join(far.select("node", F.col("hops").alias("rest")), "node").withColumn("length", F.col("hops") + F.col("rest"))
    best = met.orderBy("length", "node").limit(1).collect()
    if not best:
        return spark.createDataFrame([], "step int, node string")
    middle, links = best[0], undirected(edges)

    def walk(levels: DataFrame, node: str, hops: int) -> list[str]:
        out = [node]
        for h in range(hops - 1, -1, -1):  # at most two or three steps
            back = links.where(F.col("src") == out[-1]).join(levels.where(F.col("hops") == h).select(F.col("node").alias("dst")), "dst")
            out.append(back.agg(F.min("dst")).first()[0])
        return out

    path = walk(near, middle["node"], middle["hops"])[::-1] + walk(far, middle["node"], middle["rest"])[1:]
    return spark.createDataFrame(list(enumerate(path)), "step int, node string")


def cheapest(edges: DataFrame, source: str, rounds: int, avoid: list[str] | None = None) -> DataFrame:
    """node, cost: least sum of weights (column w, not negative) from a node, by relaxation.

    A round extends every node whose cost fell in the round before; it ends when none falls.
    Each round reads the edges: those that cost much to make should be written first.
    """
    links = edges.select("src", "dst", "w")
    if avoid:
        links = links.where(~F.col("dst").isin(*avoid) & ~F.col("src").isin(*avoid))
    table = materialise(edges.sparkSession.createDataFrame([(source, 0.0, True)], "node string, cost double, fell boolean"))
    for _ in range(rounds):
        changed = table.where("fell").select("node", "cost")
        near, _ = touching(links, changed)
        ways = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        offer = changed.join(ways, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
        rows = table.join(offer, F.col("node") == F.col("dst"), "full_outer")
        less = F.col("cost").isNull() | (F.col("offer") < F.col("cost"))
        before, table = table, materialise(rows.select(F.coalesce("node", "dst").alias("node"), F.least("cost", "offer").alias("cost"), F.coalesce(less, F.lit(False)).alias("fell")))
        release(before)
        if not table.where("fell").limit(1).count():
            break
    return table.select("node", "cost")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node is connected with.

    Nodes go by a 64-bit hash of themselves. Each round merges every node into its
    least neighbour, if that is less than itself, and goes on with the edges between
    different merged nodes: as hashes have no order, stars vanish in one round and
    some of any chain in each.
    """
    links = materialise(edges.select("src", "dst", F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")).distinct())
    names = links.select(F.col("src").alias("node"), F.col("a").alias("h")).unionByName(links.select(F.col("dst").alias("node"), F.col("b").alias("h"))).distinct()
    rest, roots = links.select("a", "b").where("a <> b"), None
    while True:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("_m")).select("h", F.least("h", "_m").alias("up")))
        if roots is None:
            roots = up.withColumnRenamed("up", "root")
        else:
            roots = roots.join(up.withColumnRenamed("h", "root"), "root", "left").select("h", F.coalesce("up", "root").alias("root"))
        rows = rest.join(up.select(F.col("h").alias("a"), F.col("up").alias("_x")), "a").join(up.select(F.col("h").alias("b"), F.col("up").alias("_y")), "b")
        rest = materialise(rows.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).where("a <> b").distinct())
        if not rest.limit(1).count():
            break
    named = materialise(names.join(roots, "h", "left").select("node", F.coalesce("root", "h").alias("root")))
    least = materialise(named.groupBy("root").agg(F.min("node").alias("label")))
    return named.join(least, "root").select("node", "label")


def closure(evidence: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """root, support, depth: everything that a root rests on, each at its least depth. Cycles end by themselves."""
    links = materialise(evidence.select("supports", "support").distinct())
    level = roots.select(F.col("node").alias("root"), F.col("node").alias("support")).distinct().withColumn("depth", F.lit(0))
    seen = level = materialise(level)
    for d in range(1, depth + 1):
        step = level.select("root", F.col("support").alias("supports")).join(links, "supports").select("root", "support").distinct()
        level = materialise(step.join(seen.select("root", "support"), ["root", "support"], "left_anti").withColumn("depth", F.lit(d)))
        if not level.limit(1).count():
            break
        seen = materialise(seen.unionByName(level))
    return seen


def neighbourhood(edges: DataFrame, focus: str, depth: int, per_group: int, types: DataFrame | None = None, max_nodes: int | None = None) -> DataFrame:
    """depth, node, dir, kind, type, other, rank, remaining: edges level by level, the first of each group and how many more.

    types (column node) holds the nodes that may be shown beside the focus, such as those
    of a scope's types; max_nodes ends the walk's growth: of a level that exceeds it the
    first nodes by their edge's place go on, and edges to the others are left out.
    """
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(focus,)], "node string")
    out, known = None, 1
    w = Window.partitionBy("node", "kind", "type", "dir")
    for d in range(1, depth + 1):
        near, inside = touching(edges, frontier)
        ways = both_ways(near)
        ways = ways.join(frontier, "node", "left_semi") if inside is None else ways.where(inside)
        rows = ways.withColumns({"rank": F.row_number().over(w.orderBy("other", "ref")), "_n": F.count("*").over(w)})
        rows = rows.where(F.col("rank") <= per_group).withColumn("remaining", F.greatest(F.col("_n") - per_group, F.lit(0)).cast("long"))
        rows = rows.select(F.lit(d).alias("depth"), "node", "dir", "kind", "type", "other", "rank", "remaining")
        if types is not None:
            rows = rows.join(types.select(F.col("node").alias("other")).unionByName(spark.createDataFrame([(focus,)], "other string")).distinct(), "other", "left_semi")
        rows = materialise(rows.select("depth", "node", "dir", "kind", "type", "other", "rank", "remaining"))
        fresh = rows.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        if max_nodes is not None:
            place = rows.groupBy(F.col("other").alias("node")).agg(F.min(F.struct("node", "kind", "type", "dir", "rank")).alias("p"))
            fresh = place.join(fresh, "node", "left_semi").orderBy("p", "node").limit(max(0, max_nodes - known)).select("node")
        frontier = materialise(fresh)
        if max_nodes is not None:
            known += frontier.count()
            rows = rows.join(seen.unionByName(frontier).select(F.col("node").alias("other")), "other", "left_semi").select(*rows.columns)
        out = rows if out is None else out.unionByName(rows)
        if d == depth or not frontier.limit(1).count():
            break
        seen = materialise(seen.unionByName(frontier))
    return out


def numbered(names: DataFrame, column: str) -> DataFrame:
    """names with no: 0, 1, ... in the order of a column without repeats.

    Rows are dealt out by ranges and numbered within them; only the ranges' sizes meet in one place.
    """
    ranged = materialise(names.repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_p").alias("_q"), before.alias("_start"))
    rows = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    rows = rows.join(F.broadcast(starts), F.col("_p") == F.col("_q"))  # a row for each range
    return rows.withColumn("no", (F.col("_start") + F.col("_r") - 1).cast("long")).drop("_p", "_q", "_r", "_start")


def adjacency(edges: DataFrame) -> DataFrame:
    """src_no, dst_no, n: edges with dense numbers instead of names, in the order of the names."""
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    numbers = materialise(numbered(names, "name"))
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    rows = pairs.join(numbers.select(F.col("name").alias("src"), F.col("no").alias("src_no")), "src").join(numbers.select(F.col("name").alias("dst"), F.col("no").alias("dst_no")), "dst")
    return rows.select("src_no", "dst_no", "n")


def line_graph(lines: DataFrame, digits: int = 4) -> DataFrame:
    """src, dst, w of lines with points (lon, lat): a node for each rounded end, 180 and -180 the same."""
    from orrery.functions import geo

    def name(p):
        lon = F.round(p["lon"], digits)
        return F.format_string(f"%.{digits}f,%.{digits}f", F.when(lon == -180, F.lit(180.0)).otherwise(lon) + 0.0, F.round(p["lat"], digits) + 0.0)

    return lines.select(name(F.element_at("points", 1)).alias("src"), name(F.element_at("points", -1)).alias("dst"), geo.path_km(F.col("points")).alias("w"))
