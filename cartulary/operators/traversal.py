"""Questions to the lineage graph.

Questions about one table start from a handful of rows. These are written aside and, if they
are as few as expected, sent to the tasks that read the buckets of their names, so that the edges are
read where they lie and never shuffled, however many of them a hub has. Of a graph that is not
stored, the rows of the catalog are read for them, or else what a question needs is written aside first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.vocabulary import HUB_LIMIT
from cartulary.operators.lineage import (
    COLUMN,
    DATABASE,
    EDGE_TYPES,
    HAS_COLUMN,
    REFERENCES,
    RELATED_TO,
    TABLE,
    Graph,
)
from cartulary.session import (
    SMALL_ROWS,
    materialize,
    partitions_for,
    sorted_by,
    spread,
    written_small,
)


PATH = "path array<string>, hops int"
# Levels of a path search, of both sides together, that are read from the rows of the catalog.
ROWS_LEVELS = 8


def _edges(graph: Graph, kind: str, src: str = "src", dst: str = "dst", *extra: str) -> DataFrame:
    return graph.edges.where(F.col("type") == kind).select(
        F.col("src").alias(src), F.col("dst").alias(dst), *extra
    )


def _nodes(graph: Graph, label: str, *columns) -> DataFrame:
    return graph.nodes.where(F.col("label") == label).select(*columns)


def _named(name: str, alias: str) -> Column:
    return F.col(name).alias(alias)


def _table_called(graph: Graph, name: str, alias: str) -> DataFrame:
    """The node of a table, as a side that is small enough to broadcast unless names repeat."""
    found = graph.tables_named(name)
    return written_small(found.select(_named("full_name", alias)), "table")


def related_tables(graph: Graph, table: str) -> DataFrame:
    """Tables connected to one table, in either direction, a row per connection."""
    graph = graph.kept([RELATED_TO], [TABLE])
    home = _table_called(graph, table, "src")
    out = graph.edges_at(RELATED_TO, "src", home).select("src", "dst", "via")
    into = graph.edges_at(RELATED_TO, "dst", home).where("src <> dst")
    into = into.select(_named("dst", "src"), _named("src", "dst"), "via")
    near = out.join(home, "src").unionByName(into.join(home, "src"))
    near = written_small(near.select("dst", "via"), "around")
    others = graph.nodes_called(TABLE, near, ["name", "row_count", "quality_score"]).select(
        _named("full_name", "dst"), "name", "row_count", "quality_score"
    )
    return (
        others.join(near, "dst")
        .select(
            _named("name", "table"),
            "via",
            _named("row_count", "rows"),
            _named("quality_score", "quality"),
        )
        .orderBy("table", "via")
    )


def _referred(graph: Graph, table: str, near: str, far: str) -> DataFrame:
    """Columns of ``table`` at the ``near`` end of references, with the tables at the far end."""
    graph = graph.kept([HAS_COLUMN, REFERENCES], [TABLE, COLUMN])
    home = _table_called(graph, table, "home")
    own = graph.edges_at(HAS_COLUMN, "src", home).select(_named("src", "home"), _named("dst", near))
    own = written_small(own.join(home, "home").select(near), "own")
    # A column that refers to itself would use the same edge on both sides of the pattern.
    pairs = graph.edges_at(REFERENCES, near, own).where("src <> dst").select("src", "dst")
    found = written_small(pairs.join(own, near).select(far, near), "pairs")
    owners = graph.edges_at(HAS_COLUMN, "dst", found).select(_named("src", "other"), _named("dst", far))
    owned = written_small(owners.join(found, far).select("other", "src", "dst"), "owners")

    def column_name(end: str, alias: str) -> DataFrame:
        known = graph.nodes_called(COLUMN, owned.select(end), ["name"])
        return known.select(_named("full_name", end), _named("name", alias))

    named = written_small(column_name("src", "from_column").join(owned, "src"), "named")
    named = written_small(column_name("dst", "to_column").join(named, "dst"), "named")
    tables = graph.nodes_called(TABLE, owned, ["name", "description"])
    tables = tables.select(_named("full_name", "other"), "name", "description")
    return (
        tables.join(named, "other").select("name", "from_column", "to_column", "description").distinct()
    )


def upstream(graph: Graph, table: str) -> DataFrame:
    """Tables that the foreign keys of one table point to."""
    found = _referred(graph, table, "src", "dst").withColumnRenamed("name", "upstream_table")
    return found.orderBy("upstream_table", "from_column", "to_column")


def downstream(graph: Graph, table: str) -> DataFrame:
    """Tables whose foreign keys point to one table."""
    found = _referred(graph, table, "dst", "src").withColumnRenamed("name", "downstream_table")
    return found.orderBy("downstream_table", "from_column", "to_column")


def hubs(graph: Graph, limit: int = HUB_LIMIT) -> DataFrame:
    """The tables with most connections; tables without any are left out.

    Connections are counted per task before they are shuffled, so a hub costs no more than
    other tables. Both ends of an edge are taken in one pass; a loop counts once.
    """
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    degrees = (
        _edges(graph, RELATED_TO)
        .select(F.explode(ends).alias("full_name"))
        .groupBy("full_name")
        .agg(F.count(F.lit(1)).alias("connections"))
    )
    tables = _nodes(graph, TABLE, "full_name", "name", "row_count", "quality_score")
    return (
        tables.join(degrees, "full_name")
        .groupBy("name", "row_count", "quality_score")
        .agg(F.sum("connections").alias("connections"))
        .select(
            _named("name", "table"),
            "connections",
            _named("row_count", "rows"),
            _named("quality_score", "quality"),
        )
        .orderBy(F.desc("connections"), "table")
        .limit(limit)
    )


def foreign_keys(graph: Graph) -> DataFrame:
    """Every reference from column to column.

    The names at both ends are looked up in the columns, which drops what has no column there, so
    of a graph that has its rows the keys are taken as they come.
    """
    named = ["full_name", "table_name", "name"]
    if graph.rows:
        number = graph.rows.partitions
        known = graph.rows.labelled(COLUMN, named[1:]).select(named)
        pairs = spread(graph.rows.claimed(REFERENCES).select("src", "dst"), "src", number=number).distinct()
    else:
        number = partitions_for(graph.nodes, graph.edges)
        known = _nodes(graph, COLUMN, *named)
        pairs = spread(_edges(graph, REFERENCES), "src", number=number)

    def end(key: str, table: str, column: str) -> DataFrame:
        return known.select(_named("full_name", key), _named("table_name", table), _named("name", column))

    begun = pairs.join(end("src", "from_table", "from_column"), "src").drop("src")
    found = spread(begun, "dst", number=number).join(end("dst", "to_table", "to_column"), "dst")
    order = ["from_table", "from_column", "to_table", "to_column"]
    return sorted_by(found.select(order), *order, number=number)


def matches_keyword(keyword: str, *texts: Column) -> Column:
    """True where the keyword occurs in one of the texts, whatever the case."""
    wanted = keyword.lower()
    test = F.lit(False)
    for text in texts:
        test = test | F.coalesce(F.lower(text).contains(wanted), F.lit(False))
    return test


def search_tables(graph: Graph, keyword: str) -> DataFrame:
    """Tables whose name, description or tags hold the keyword, best quality first."""
    hit = matches_keyword(keyword, F.col("name"), F.col("description"), F.col("tags"))
    return (
        graph.nodes.where((F.col("label") == TABLE) & hit)
        .select(
            _named("name", "table"),
            "description",
            _named("quality_score", "quality"),
            _named("row_count", "rows"),
        )
        .orderBy(F.desc("quality"), "table")
    )


@dataclass(frozen=True)
class _Side:
    """One of the two searches: its levels so far, the size of the latest, and its direction.

    A level has a row per node: its name, its parent on the smallest path, the parent's rank, and
    the rank of that path among those of the level. Equal lists of names have equal ranks.
    """

    levels: tuple[DataFrame, ...]
    size: int
    forward: bool


def lineage_path(
    graph: Graph, start: str, end: str, edge_types=EDGE_TYPES, small_level: int = SMALL_ROWS
) -> DataFrame:
    """A shortest path between two tables over the given edges, followed in either direction.

    One row (path, hops), none if the tables are not connected; of equally short paths the one
    with the smallest list of names.

    The graph is searched level by level from both ends, always on the side with fewer nodes,
    until the two latest levels share a node. Levels are complete, so that happens first when
    their distances add up to that of the tables, and every shortest path crosses a shared node.
    A node keeps its parent and the rank of its smallest list of names, not the list, so its row
    has the same size at any depth. That is enough because a list one longer is smaller if the
    list before it has a smaller rank, or else by its own name (from the end: by its own name, or
    else by the rank). The path is put together in the end, a row per level.
    """
    if start == end:
        raise ValueError("a path needs two different tables")
    kinds = list(edge_types)
    labels = [TABLE] if set(kinds) <= {RELATED_TO} else [DATABASE, TABLE, COLUMN]
    if not graph.rows:
        graph = graph.written(kinds, labels)
    ends = graph.tables_named(start, end)
    ends = materialize(ends.select(_named("full_name", "node"), "name"), "ends")
    sides = []
    for name, forward in ((start, True), (end, False)):
        none, zero = F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint")
        level = ends.where(F.col("name") == name)
        level = level.select("node", "name", none, zero.alias("before"), zero.alias("rank"))
        sides.append(_Side((level,), level.count(), forward))
    while all(side.size for side in sides):
        sides.sort(key=lambda side: side.size)
        # Rows of the catalog are read for few names and a few times; else the graph is written aside.
        grown = sum(len(side.levels) - 1 for side in sides)
        if graph.rows and (sides[0].size > small_level or grown >= ROWS_LEVELS):
            graph = graph.written(kinds, labels, ["name"])
        sides[0] = _grow(graph, kinds, labels, sides[0], small_level)
        found = _meet(*sides)
        if found is not None:
            return graph.nodes.sparkSession.createDataFrame([(found, len(found) - 1)], PATH)
    return graph.nodes.sparkSession.createDataFrame([], PATH)


def _grow(graph: Graph, kinds: list[str], labels: list[str], side: _Side, small_level: int) -> _Side:
    """The next level of a search.

    A level of few nodes is sent to every task, which leaves the edges where they are, those of
    a hub included; a large one is shuffled together with the edges, and AQE splits hubs. Parents
    of one node are reduced to the best before the shuffle. In an undirected graph the
    neighbours of a level lie in it, in the one before or in the next, so two levels are enough
    to tell which nodes are new. Levels are written to the shared folder, which keeps the plan
    short and survives lost executors.
    """
    latest = side.levels[-1]
    near = latest.select(_named("node", "src"), "rank")
    near = F.broadcast(near) if side.size <= small_level else near
    seen = latest.select("node")
    if len(side.levels) > 1:
        seen = seen.unionByName(side.levels[-2].select("node"))
    reached = (
        _steps(graph, kinds, near)
        .join(near, "src")
        .groupBy(_named("dst", "node"))
        .agg(F.min(F.struct(_named("rank", "before"), _named("src", "parent"))).alias("best"))
        .join(seen, "node", "left_anti")
    )
    reached = written_small(reached, "reached", small_level)
    names = graph.opened_nodes(reached, labels).select(_named("full_name", "node"), "name")
    found = names.join(reached, "node").select("node", "name", "best.parent", "best.before")
    found = materialize(found, "found")
    level = materialize(_ranked(found, side.forward, small_level), "level")
    return _Side((*side.levels, level), level.count(), side.forward)


def _ranked(found: DataFrame, forward: bool, small_level: int) -> DataFrame:
    """The nodes of a level with the rank of their paths.

    Distinct pairs of rank and name are sorted by all tasks together, and their numbers grow along
    the ranges of the sort; they have gaps, but the same order.
    """
    pair = ["before", "name"]
    places = found.select(pair).distinct().orderBy(pair if forward else pair[::-1])
    places = places.withColumn("rank", F.monotonically_increasing_id())
    ranked = found.join(written_small(places, "places", small_level), pair)
    return ranked.select("node", "name", "parent", "before", "rank")


def _meet(one: _Side, other: _Side) -> list[str] | None:
    """The names of the smallest path through a node that both latest levels hold."""
    head, tail = (one, other) if one.forward else (other, one)
    ahead = head.levels[-1].select("node", _named("rank", "first"))
    shared = ahead.join(tail.levels[-1].select("node", _named("rank", "second")), "node")
    best = shared.agg(F.min(F.struct("first", "second", "node")).alias("best")).first()["best"]
    if best is None:
        return None
    before = _names_from(head, best["node"], best["first"])
    return before[::-1] + _names_from(tail, best["node"], best["second"])[1:]


def _names_from(side: _Side, node: str, rank: int) -> list[str]:
    """The names from a node of the latest level back to where the search began."""
    names = []
    for level in reversed(side.levels):
        row = level.where((F.col("node") == node) & (F.col("rank") == rank)).first()
        names.append(row["name"])
        node, rank = row["parent"], row["before"]
    return names


def _steps(graph: Graph, kinds: list[str], level: DataFrame) -> DataFrame:
    """Edges from the nodes of a level, in either direction, a loop only once."""
    if graph.rows:
        out = into = graph.rows.edges_near(kinds, ("src", "dst"), level).select("src", "dst")
        into = into.where("src <> dst")
        return out.unionByName(into.select(_named("dst", "src"), _named("src", "dst")))
    out = graph.opened_edges("src", level).where(F.col("type").isin(kinds)).select("src", "dst")
    into = graph.opened_edges("dst", level).where(F.col("type").isin(kinds) & (F.col("src") != F.col("dst")))
    return out.unionByName(into.select(_named("dst", "src"), _named("src", "dst")))
