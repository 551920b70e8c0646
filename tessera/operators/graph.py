"""G: the schema as a graph (nodes, edges, centrality, components, search).

Graphs are two DataFrames: ``nodes(node)`` and ``edges(id, src, dst, ...)``.
Iterative algorithms keep their state as DataFrames, stop on a count that
is computed on the executors, and cut lineage every few rounds with a
reliable checkpoint in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

# Fixed value: type names that count as numeric when they hold one of these.
NUMERIC_TYPE = "int|decimal|numeric|float|double"
# parts into which the edges of one node are dealt
SALTS = 64
# a node of more edges is a hub, whose edges are dealt
HUB = 50_000
# folding of leaves goes on while a round takes this share of what is left
FOLD_SHARE = 0.01
# levels after which the union of all levels seen so far is written out again
CHECKPOINT_EVERY = 3


def column_badges() -> Column:
    """PK, FK, Required (not nullable) badges as an array."""
    return F.array_compact(F.array(
        F.when(F.col("is_primary_key"), F.lit("PK")),
        F.when(F.col("is_foreign_key"), F.lit("FK")),
        F.when(~F.col("nullable"), F.lit("Required"))))


# -------------------------------------------------------------- G1, G2 ----

def schema_nodes(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """G1: one node per table with its columns (name, type, key flags) in position order."""
    cols = (columns.groupBy("table")
            .agg(F.array_sort(F.collect_list(F.struct(
                "position", "name", "data_type", "nullable", "is_primary_key", "is_foreign_key"))).alias("c"))
            .select(F.col("table").alias("node"),
                    F.transform("c", lambda x: x.dropFields("position")).alias("columns")))
    return tables.select(F.col("name").alias("node")).join(cols, "node", "left")


def schema_edges(fk_records: DataFrame) -> DataFrame:
    """One edge per FK, id ``edge-<src>-<dst>-<index>`` (index = FK position in its table)."""
    per_table = (fk_records.groupBy("table")
                 .agg(F.array_sort(F.collect_list(F.struct("constraint_name", "referred_table",
                                                           "constrained_columns", "referred_columns"))).alias("l")))
    e = per_table.select("table", F.posexplode("l").alias("i", "f"))
    return e.select(F.concat_ws("-", F.lit("edge"), "table", "f.referred_table", F.col("i").cast("string")).alias("id"),
                    F.col("table").alias("src"), F.col("f.referred_table").alias("dst"),
                    F.col("f.constrained_columns").alias("from_columns"),
                    F.col("f.referred_columns").alias("to_columns"))


def relations_of(edges: DataFrame) -> DataFrame:
    """Per node its relations, outgoing first then incoming, labelled N-1."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("outgoing").alias("direction"),
                       F.lit(0).alias("dir_order"), "id", F.lit("N-1").alias("cardinality"))
    inc = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("incoming").alias("direction"),
                       F.lit(1).alias("dir_order"), "id", F.lit("N-1").alias("cardinality"))
    return out.unionByName(inc)


# ------------------------------------------------------------ G4, G5, G8 --

def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree (a loop counts 2) and connected-edge count (a loop counts 1).

    Ids that several edges share are found first, by a digest; only their edges are made distinct per node and id.
    """
    mark = F.xxhash64("id").alias("_id")
    shared = edges.select(mark).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    loop = F.col("src") == F.col("dst")
    end = lambda node, n: F.struct(F.col(node).alias("node"), F.lit(n).alias("degree"))
    each = F.explode(F.when(loop, F.array(end("src", 2))).otherwise(F.array(end("src", 1), end("dst", 1)))).alias("e")
    if not shared.isEmpty():
        shared = cut_lineage(shared)
        edges = edges.select("*", mark).join(shared.withColumn("_shared", F.lit(True)), "_id", "left")
        ends = edges.select("id", "_shared", each).select("id", "_shared", "e.*")
        again = ends.where("_shared").select("node", "id").distinct().groupBy("node").agg(F.count("id").alias("again"))
        d = ends.groupBy("node").agg(F.sum("degree").alias("degree"), F.count(F.when(F.col("_shared").isNull(), F.col("id"))).alias("own"))
        d = d.join(again, "node", "left").select("node", "degree", (F.col("own") + F.coalesce("again", F.lit(0))).alias("connections"))
    else:
        d = edges.select("id", each).select("id", "e.*").groupBy("node").agg(F.sum("degree").alias("degree"), F.count("id").alias("connections"))
    return (nodes.select("node").join(d, "node", "left")
            .select("node", F.coalesce("degree", F.lit(0)).alias("degree"),
                    F.coalesce("connections", F.lit(0)).alias("connections")))


def intensity(deg: DataFrame) -> DataFrame:
    """Connections / max connections; > 0.3 central, > 0.6 most central."""
    mx = deg.select(F.max("connections")).scalar()  # uncorrelated scalar subquery
    r = F.col("connections") / F.nullif(mx, F.lit(0))
    return (deg.select("node", "connections", F.coalesce(r, F.lit(0.0)).alias("intensity"))
            .withColumn("band", F.when(F.col("intensity") > 0.6, "most_central")
                        .when(F.col("intensity") > 0.3, "central").otherwise("normal")))


# ------------------------------------------------------------------ G7 ----

def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, loops dropped, parallel edges merged: (u, v)."""
    e = edges.where(F.col("src") != F.col("dst"))
    return (e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
            .unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct())


def _nearest(edges: DataFrame, key: str, value: str, salts: int, hub: int = HUB) -> DataFrame:
    """``edges`` with ``least``: the smallest ``value`` of their ``key``, though no join key holds all edges of a hub.

    The smallest per key is combined before it is moved. A key of more than ``hub`` edges has it copied to ``salts`` places, over which
    its edges are dealt to look it up; such keys are at most one in ``hub`` edges.
    """
    found = edges.groupBy(key).agg(F.min(value).alias("least"), (F.count(F.lit(1)) > hub).alias("_hub"))
    hubs = F.broadcast(found.where("_hub").select(F.col(key).alias("_key"), "_hub"))
    salted = edges.join(hubs, F.col(key) == F.col("_key"), "left").drop("_key")
    salted = salted.withColumn("_salt", F.when(F.col("_hub"), F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")).otherwise(0)).drop("_hub")
    places = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(found.select(key, "least", F.explode(places).alias("_salt")), [key, "_salt"]).drop("_salt")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number, node) of every node at an edge, written, and the edges as pairs of numbers (big, small): loops dropped.

    A number is a hash of the node under the first seed that gives no two nodes the same.
    """
    e = edges.where(F.col("src") != F.col("dst"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    kind = ends.schema["node"].dataType
    for seed in itertools.count():
        number = lambda c: F.xxhash64(F.lit(seed), F.col(c).cast(kind))  # noqa: B023, E731
        named = cut_lineage(ends.select(number("node").alias("number"), "node"))
        if named.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    pairs = e.select(number("src").alias("a"), number("dst").alias("b"))
    return named, pairs.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))


def connected_components(nodes: DataFrame, edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """Component label = smallest node name, by large-star and small-star rounds.

    The rounds run over numbers in the nodes' place, whose order is that of hashes: numbers are compared and moved at a fraction
    of the cost of names, and in a random order the first rounds already merge most edges. An edge points from its larger to its
    smaller end. Large-star joins every larger neighbour of a node to the node's
    smallest neighbour, small-star a node and its smaller neighbours to the smallest of them; both keep components, and
    the edges end as stars round the smallest numbers. Stops when a round leaves the set of edges as it was (its count and
    two sums of hashes). The state is the edges, never more than there were at first plus one per node.
    """
    named, now = _numbered(edges)
    now, before = cut_lineage(now), None
    while True:
        h = F.xxhash64("big", "small")
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(F.lit(1), h))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        # large-star: the smallest among all neighbours of the smaller end, and itself
        both = now.select(F.col("small").alias("at"), F.col("big").alias("other"), F.lit(True).alias("up")).unionByName(
            now.select(F.col("big").alias("at"), F.col("small").alias("other"), F.lit(False).alias("up")))
        large = _nearest(both, "at", "other", salts).where("up").select(F.col("other").alias("big"), F.least("at", "least").alias("small"))
        large = large.distinct()
        # small-star: a node and its smaller neighbours to the smallest of these
        near = _nearest(large, "big", "small", salts)
        # where the smallest is the edge's own smaller end, the edge stays as it is
        small = near.select(F.when(F.col("small") == F.col("least"), F.col("big")).otherwise(F.col("small")).alias("big"), F.col("least").alias("small"))
        now = cut_lineage(small.distinct())
    roots = now.groupBy(F.col("big").alias("number")).agg(F.min("small").alias("root"))  # one row each
    placed = named.join(roots, "number", "left").select("node", F.coalesce("root", "number").alias("root"))
    labels = placed.join(placed.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def structure(components: DataFrame) -> DataFrame:
    """Hierarchical (1 component, > 10 nodes), clustered (> 1 component) or small."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    s = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"),
                  F.sum("size").alias("n_nodes"))
    return s.withColumn("structure", F.when((F.col("n_components") == 1) & (F.col("n_nodes") > 10), "hierarchical")
                        .when(F.col("n_components") > 1, "clustered").otherwise("small"))


# ------------------------------------------------------------------ G6 ----

def fold_leaves(nodes: DataFrame, adj: DataFrame, share: float = FOLD_SHARE) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Fold pendant trees into the nodes they hang from, round by round.

    Returns the nodes that stay (node, w, inner), the edges among them and the folded ones per round (node, parent, w, inner).
    ``w`` counts a node and all that was folded into it, ``inner`` the pairs of these whose path runs through the node, between two of
    its branches. Stops when a round folds less than ``share`` of what is left: what stays is counted as it is.
    """
    left, folded = cut_lineage(nodes.select("node", F.lit(1.0).alias("w"), F.lit(0.0).alias("inner"))), []
    while True:
        ends = adj.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("parent")).where("n = 1")
        other = ends.select(F.col("u").alias("parent"), F.lit(True).alias("leaf_too"))
        # of an edge between two leaves the larger one is folded
        ends = ends.join(other, "parent", "left").where(F.col("leaf_too").isNull() | (F.col("u") > F.col("parent")))
        gone = cut_lineage(ends.select(F.col("u").alias("node"), "parent").join(left, "node"))
        n = gone.count()
        if n == 0:
            return left, adj, folded
        folded.append(gone)
        took = gone.groupBy(F.col("parent").alias("node")).agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"))
        stay = left.join(gone.select("node"), "node", "left_anti").join(took, "node", "left").fillna(0.0, ["s", "s2"])
        left = cut_lineage(stay.select("node", (F.col("w") + F.col("s")).alias("w"),
                                       (F.col("inner") + (F.col("s") * F.col("s") - F.col("s2")) / 2 + (F.col("w") - 1) * F.col("s")).alias("inner")))
        out = gone.select(F.col("node").alias("u"))
        adj = cut_lineage(adj.join(out, "u", "left_anti").join(out.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v"))
        if n < share * left.count():
            return left, adj, folded


def betweenness(nodes: DataFrame, edges: DataFrame, counter: dict | None = None) -> DataFrame:
    """Exact betweenness (undirected, unweighted, each pair once): pendant trees folded, Brandes over BFS levels on the rest.

    A node of a pendant tree lies on paths whose number follows from the sizes of what it separates, so trees need no
    search: they are folded into the node they hang from, which then stands for ``w`` nodes. State rows of the search are
    (source, node, sigma) among the nodes that stay: one BFS level per round for all sources at once, then
    dependencies flow back level by level: delta(s, v) = sum over successors x of sigma(s,v) / sigma(s,x) * (w(x) + delta(s,x)).
    ``counter`` takes the number of ``state`` rows and of ``folded`` nodes.
    """
    left, adj, folded = fold_leaves(nodes, cut_lineage(undirected(edges)), FOLD_SHARE)
    frontier = left.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("sigma"))
    levels = [cut_lineage(frontier)]
    seen = levels[0].select("s", "v")
    for depth in itertools.count(1):  # until no source reaches a new node
        nxt = (levels[-1].join(adj.withColumnRenamed("v", "w").withColumnRenamed("u", "v"), "v")
               .groupBy("s", F.col("w").alias("v")).agg(F.sum("sigma").alias("sigma"))
               .join(seen, ["s", "v"], "left_anti"))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "v"))
        seen = cut_lineage(seen) if depth % CHECKPOINT_EVERY == 0 else seen
    # back-propagate dependencies from the deepest level
    weight = left.select(F.col("node").alias("v"), "w")
    delta = levels[-1].select("s", "v", F.lit(0.0).alias("delta"))
    total = delta
    for lv in range(len(levels) - 1, 0, -1):
        x = levels[lv].join(delta, ["s", "v"], "left").join(weight, "v").select(
            "s", F.col("v").alias("x"), F.col("sigma").alias("sx"), (F.col("w") + F.coalesce("delta", F.lit(0.0))).alias("dx"))
        prev = levels[lv - 1].select("s", "v", F.col("sigma").alias("sv"))
        delta = cut_lineage(x.join(adj.withColumnRenamed("u", "x"), "x").join(prev, ["s", "v"])
                            .groupBy("s", "v").agg(F.sum(F.col("sv") / F.col("sx") * F.col("dx")).alias("delta")))
        total = total.unionByName(delta)
    source = left.select(F.col("node").alias("s"), F.col("w").alias("sw"))
    among = (total.where(F.col("s") != F.col("v")).join(source, "s").groupBy(F.col("v").alias("node"))
             .agg((F.sum(F.col("sw") * F.col("delta")) / 2).alias("among")))
    # every node that is reached from a source counts with all it stands for: together the source's component
    size = seen.join(weight, "v").groupBy(F.col("s").alias("node")).agg(F.sum("w").alias("size"))
    state = cut_lineage(left.join(size, "node").select("node", "w", "inner", "size"))
    outside = F.col("inner") + (F.col("w") - 1) * (F.col("size") - F.col("w"))
    result = state.join(among, "node", "left").select("node", (outside + F.coalesce("among", F.lit(0.0))).alias("betweenness"))
    sizes = state.select("node", "size")
    for part in reversed(folded):  # a folded node is in its parent's component
        part = cut_lineage(part.join(sizes.withColumnRenamed("node", "parent"), "parent"))
        result = result.unionByName(part.select("node", outside.alias("betweenness")))
        sizes = sizes.unionByName(part.select("node", "size"))
    if counter is not None:
        counter["state"], counter["folded"] = seen.count(), sum(p.count() for p in folded)
    return nodes.select("node").join(result, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


# ----------------------------------------------------------- G10-G12 ------

def _substrings(text: Column, lengths: list[int]) -> Column:
    """All substrings of the given lengths (lower case)."""
    t = F.lower(text)
    n = F.length(t)
    each = F.transform(F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= n), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(t, i, k)))
    return F.flatten(each)


def search(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """Case-insensitive substring match of terms against table name, column names and types.

    Identifiers of any length are exploded into their substrings of the lengths that the terms have (their
    distinct lengths are all that the driver sees) and matched to the terms by an equi-join.
    """
    lengths = sorted(r[0] for r in terms.select(F.length(F.lower("term")).alias("n")).where("n > 0").distinct().collect())
    if not lengths:
        return terms.select("term").join(nodes.select("node"), F.lit(False))
    texts = (nodes.select("node", F.col("node").alias("t"))
             .unionByName(nodes.select("node", F.explode("columns").alias("c"))
                          .select("node", F.explode(F.array(F.col("c.name"), F.col("c.data_type"))).alias("t"))))
    subs = texts.select("node", F.explode(F.array_distinct(_substrings(F.col("t"), lengths))).alias("sub")).distinct()
    tm = terms.select("term", F.lower("term").alias("sub")).where(F.length("sub") > 0)
    return tm.join(subs, "sub").select("term", "node").distinct()


def induced_edges(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """Per term, edges with both ends among the matched nodes."""
    a = matches.select("term", F.col("node").alias("src"))
    b = matches.select("term", F.col("node").alias("dst"))
    return edges.join(a, "src").join(b, ["term", "dst"]).select("term", "id", "src", "dst")


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node, itself and the endpoints of its edges."""
    n = (edges.select(F.col("src").alias("node"), F.col("dst").alias("member"))
         .unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("member")))
         .unionByName(nodes.select("node", F.col("node").alias("member"))))
    return n.distinct()


# ----------------------------------------------------------- G13-G17 ------

def is_numeric_type(t: Column) -> Column:
    """Substring rule over type names (so bigint and interval pass, real does not)."""
    return F.lower(t).rlike(NUMERIC_TYPE)


def quick_stats(nodes: DataFrame) -> DataFrame:
    """G13."""
    c = F.col("columns")
    return nodes.select("node", F.size(c).alias("n_columns"),
                        F.size(F.filter(c, lambda x: x["is_primary_key"])).alias("n_pk"),
                        F.size(F.filter(c, lambda x: x["is_foreign_key"])).alias("n_fk"))


def significant_columns(nodes: DataFrame) -> DataFrame:
    """Key columns, then the first two non-key columns."""
    c = F.col("columns")
    keys = F.filter(c, lambda x: x["is_primary_key"] | x["is_foreign_key"])
    rest = F.slice(F.filter(c, lambda x: ~(x["is_primary_key"] | x["is_foreign_key"])), 1, 2)
    return nodes.select("node", F.concat(keys, rest).alias("significant"))


def sample_sql(nodes: DataFrame) -> DataFrame:
    """SELECT significant columns WHERE (first PK or first significant) (> 0 | IS NOT NULL) LIMIT 5;"""
    sig = significant_columns(nodes)
    pk = F.filter(F.col("columns"), lambda x: x["is_primary_key"])
    key = F.coalesce(F.try_element_at(pk, F.lit(1)), F.try_element_at(F.col("significant"), F.lit(1)))
    cond = F.when(is_numeric_type(key["data_type"]), F.concat(key["name"], F.lit(" > 0"))) \
        .otherwise(F.concat(key["name"], F.lit(" IS NOT NULL")))
    return sig.join(nodes, "node").select(
        "node", F.concat(F.lit("SELECT "), F.array_join(F.transform("significant", lambda x: x["name"]), ", "),
                         F.lit(" FROM "), F.col("node"), F.lit(" WHERE "), cond, F.lit(" LIMIT 5;")).alias("sql"))


def schema_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per table a JSON document of columns and its outgoing relationships."""
    rel = (edges.groupBy(F.col("src").alias("node"))
           .agg(F.array_sort(F.collect_list(F.struct(
               F.col("id"), F.col("dst").alias("to_table"), F.col("from_columns"), F.col("to_columns")))).alias("r")))
    cols = F.transform("columns", lambda x: F.struct(x["name"].alias("name"), x["data_type"].alias("type"),
                                                     x["nullable"].alias("nullable"),
                                                     x["is_primary_key"].alias("isPrimaryKey")))
    return (nodes.join(rel, "node", "left")
            .select("node", F.to_json(cols).alias("columns_json"),
                    F.to_json(F.coalesce("r", F.array().cast(
                        "array<struct<id:string,to_table:string,from_columns:array<string>,"
                        "to_columns:array<string>>>"))).alias("relationships_json")))
