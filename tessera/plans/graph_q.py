"""G-queries: the verified schema graph, plus the supplier-part graph of lineitem for scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import graph as G
from tessera.plans.catalog_q import SCHEMA_SQL, VERIFIED_SQL, catalog_parts
from tessera.plans.registry import query
from tessera.sources.tables import read_table


def schema_graph(spark, sf):
    frames, schema_df, cons = catalog_parts(spark, sf)
    tables = C.list_tables(schema_df)
    cols = C.key_flags(schema_df, cons)
    nodes = G.schema_nodes(tables, cols)
    edges = G.schema_edges(C.fk_records(cons, tables))
    return nodes, edges


EDGES_SQL = f"""
c AS ({VERIFIED_SQL}),
s AS ({SCHEMA_SQL}),
nodes AS (SELECT DISTINCT tbl AS node FROM s),
fk AS (SELECT tbl, constraint_name, min(ref_table) AS ref_table,
         string_agg(col, ',' ORDER BY ordinal) AS from_columns,
         string_agg(ref_column, ',' ORDER BY ordinal) AS to_columns
       FROM c WHERE kind = 'fk' AND ref_table IN (SELECT node FROM nodes) GROUP BY tbl, constraint_name),
edges AS (SELECT 'edge-' || tbl || '-' || ref_table || '-' ||
            (row_number() OVER (PARTITION BY tbl ORDER BY constraint_name) - 1) AS id,
            tbl AS src, ref_table AS dst, from_columns, to_columns FROM fk),
adj AS (SELECT src AS u, dst AS v FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"""


@query("graph_nodes_edges", ids="G1 G2", oracle=f"""WITH {EDGES_SQL}
SELECT id, src, dst, from_columns, to_columns FROM edges""")
def graph_nodes_edges(spark, sf):
    _, edges = schema_graph(spark, sf)
    return edges.select("id", "src", "dst", F.array_join("from_columns", ",").alias("from_columns"),
                        F.array_join("to_columns", ",").alias("to_columns"))


@query("graph_relations", ids="G3", oracle=f"""WITH {EDGES_SQL}
SELECT src AS node, 'outgoing' AS direction, dst AS other, id, 'N-1' AS cardinality, from_columns, to_columns FROM edges
UNION ALL SELECT dst, 'incoming', src, id, 'N-1', from_columns, to_columns FROM edges""")
def graph_relations(spark, sf):
    """Relations of every table: outgoing and incoming, each with the columns in the reference's own direction."""
    _, edges = schema_graph(spark, sf)
    cols = edges.select("id", F.array_join("from_columns", ",").alias("from_columns"), F.array_join("to_columns", ",").alias("to_columns"))
    return G.relations_of(edges).drop("dir_order").join(cols, "id")


DEGREE_SQL = """
ends AS (SELECT id, src AS node FROM edges UNION ALL SELECT id, dst FROM edges),
deg AS (SELECT n.node, count(e.id) AS degree, count(DISTINCT e.id) AS connections
        FROM nodes n LEFT JOIN ends e ON e.node = n.node GROUP BY n.node)"""


@query("graph_degree", ids="G4 G5", oracle=f"""WITH {EDGES_SQL}, {DEGREE_SQL}
SELECT node, degree, connections FROM deg""")
def graph_degree(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    return G.degree(nodes, edges)


@query("graph_intensity", ids="G8", oracle=f"""WITH {EDGES_SQL}, {DEGREE_SQL},
r AS (SELECT node, connections, coalesce(connections / nullif((SELECT max(connections) FROM deg), 0), 0.0) AS intensity
      FROM deg)
SELECT node, connections, round(intensity, 6) AS intensity,
  CASE WHEN intensity > 0.6 THEN 'most_central' WHEN intensity > 0.3 THEN 'central' ELSE 'normal' END AS band
FROM r""")
def graph_intensity(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    i = G.intensity(G.degree(nodes, edges))
    return i.select("node", "connections", F.round("intensity", 6).alias("intensity"), "band")


COMPONENTS_SQL = """
reach(root, node) AS (SELECT node, node FROM nodes UNION SELECT r.root, a.v FROM reach r JOIN adj a ON a.u = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


@query("graph_components", ids="G7", oracle=f"""WITH RECURSIVE {EDGES_SQL}, {COMPONENTS_SQL}
SELECT node, component FROM comp""")
def graph_components(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    return G.connected_components(nodes.select("node"), edges)


@query("graph_structure", ids="G9", oracle=f"""WITH RECURSIVE {EDGES_SQL}, {COMPONENTS_SQL},
sz AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
agg AS (SELECT count(*) AS n_components, max(size) AS largest, CAST(sum(size) AS BIGINT) AS n_nodes FROM sz)
SELECT n_components, largest, n_nodes,
  CASE WHEN n_components = 1 AND n_nodes > 10 THEN 'hierarchical' WHEN n_components > 1 THEN 'clustered'
       ELSE 'small' END AS structure FROM agg""")
def graph_structure(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    return G.structure(G.connected_components(nodes.select("node"), edges))


def supply_graph(spark, sf):
    """Supplier-part graph: one edge per distinct (supplier, part) pair shipped in lineitem."""
    li = read_table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    supplier, part = (F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("s", "l_suppkey"), ("p", "l_partkey")))
    edges = li.distinct().select(supplier.alias("src"), part.alias("dst"))
    edges = edges.withColumn("id", F.concat_ws("-", "src", "dst"))
    # keys are made distinct as numbers; the distinct over the names merges their nulls
    nodes = (li.select("l_suppkey").distinct().select(supplier.alias("node"))
             .unionByName(li.select("l_partkey").distinct().select(part.alias("node"))).distinct())
    return nodes, edges


@query("graph_components_supply", ids="G7", oracle="""WITH RECURSIVE
e AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem),
adj AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
nodes AS (SELECT DISTINCT u AS node FROM adj),
reach(root, node) AS (SELECT node, node FROM nodes UNION SELECT r.root, a.v FROM reach r JOIN adj a ON a.u = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT component, count(*) AS size FROM comp GROUP BY component""")
def graph_components_supply(spark, sf):
    nodes, edges = supply_graph(spark, sf)
    comp = G.connected_components(nodes, edges)
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("graph_degree_supply", ids="G4 G5", oracle="""
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
ends AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)
SELECT node, count(*) AS degree, count(*) AS connections FROM ends GROUP BY node""")
def graph_degree_supply(spark, sf):
    nodes, edges = supply_graph(spark, sf)
    return G.degree(nodes, edges)


@query("graph_betweenness", ids="G6", oracle=f"""WITH RECURSIVE {EDGES_SQL},
bfs(s, v, d) AS (SELECT node, node, 0 FROM nodes
                 UNION SELECT b.s, a.v, b.d + 1 FROM bfs b JOIN adj a ON a.u = b.v WHERE b.d < (SELECT count(*) FROM nodes)),
dist AS (SELECT s, v, min(d) AS d FROM bfs GROUP BY s, v),
sp(s, v, d) AS (SELECT node, node, 0 FROM nodes
                UNION ALL SELECT sp.s, a.v, sp.d + 1 FROM sp JOIN adj a ON a.u = sp.v
                JOIN dist ON dist.s = sp.s AND dist.v = a.v AND dist.d = sp.d + 1),
sigma AS (SELECT s, v, count(*) AS sg, min(d) AS d FROM sp GROUP BY s, v),
contrib AS (SELECT a.v AS node, a.sg * b.sg / st.sg AS c
            FROM sigma a JOIN sigma b ON b.s = a.v JOIN sigma st ON st.s = a.s AND st.v = b.v
            WHERE a.s < b.v AND a.v <> a.s AND a.v <> b.v AND a.d + b.d = st.d)
SELECT n.node, round(coalesce(sum(c), 0.0), 6) AS betweenness FROM nodes n LEFT JOIN contrib ON contrib.node = n.node
GROUP BY n.node""")
def graph_betweenness(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    bc = G.betweenness(nodes.select("node"), edges)
    return bc.select("node", F.round("betweenness", 6).alias("betweenness"))


def search_terms(spark, sf):
    """Words of the users' chat messages are the search terms (whole table)."""
    conv = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    w = conv.select(F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("term"))
    return w.where(F.length("term") >= 2).distinct()


@query("graph_search", ids="G10 G11", oracle=f"""WITH {EDGES_SQL},
terms AS (SELECT DISTINCT t AS term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS t
          FROM conversations WHERE role = 'user') WHERE length(t) >= 2),
texts AS (SELECT tbl AS node, tbl AS t FROM s UNION SELECT tbl, name FROM s UNION SELECT tbl, data_type FROM s),
m AS (SELECT DISTINCT term, node FROM terms JOIN texts ON contains(lower(t), term))
SELECT term, node AS item, 'node' AS kind FROM m
UNION ALL
SELECT a.term, e.id, 'edge' FROM edges e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst AND b.term = a.term""")
def graph_search(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    m = G.search(nodes, search_terms(spark, sf))
    ind = G.induced_edges(m, edges)
    return (m.select("term", F.col("node").alias("item"), F.lit("node").alias("kind"))
            .unionByName(ind.select("term", F.col("id").alias("item"), F.lit("edge").alias("kind"))))


@query("graph_neighbourhood", ids="G12", oracle=f"""WITH {EDGES_SQL}
SELECT src AS node, dst AS member FROM edges UNION SELECT dst, src FROM edges UNION SELECT node, node FROM nodes""")
def graph_neighbourhood(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    return G.neighbourhood(edges, nodes)


FLAGS_SQL = """
f AS (SELECT s.tbl AS node, s.name, s.position, s.data_type, s.nullable,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'pk') AS pk,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'fk') AS fk FROM s)"""


@query("quick_stats", ids="G13", oracle=f"""WITH {EDGES_SQL}, {FLAGS_SQL}
SELECT node, count(*) AS n_columns, count(*) FILTER (WHERE pk) AS n_pk, count(*) FILTER (WHERE fk) AS n_fk
FROM f GROUP BY node""")
def quick_stats(spark, sf):
    nodes, _ = schema_graph(spark, sf)
    st = G.quick_stats(nodes)
    return st.select("node", *[F.col(c).cast("bigint").alias(c) for c in ("n_columns", "n_pk", "n_fk")])


@query("sample_sql", ids="G14 G15 G16", oracle=f"""WITH {EDGES_SQL}, {FLAGS_SQL},
k AS (SELECT node, name, data_type, pk, position, row_number() OVER (PARTITION BY node ORDER BY position) AS kr
      FROM f WHERE pk OR fk),
nk AS (SELECT node, name, data_type, position, row_number() OVER (PARTITION BY node ORDER BY position) AS nr
       FROM f WHERE NOT (pk OR fk)),
sig AS (SELECT node, name, data_type, 0 AS grp, position FROM k UNION ALL
        SELECT node, name, data_type, 1, position FROM nk WHERE nr <= 2),
sigl AS (SELECT node, string_agg(name, ', ' ORDER BY grp, position) AS cols,
           arg_min(name, grp * 1000 + position) AS first_name, arg_min(data_type, grp * 1000 + position) AS first_type
         FROM sig GROUP BY node),
pk1 AS (SELECT node, arg_min(name, position) AS pk_name, arg_min(data_type, position) AS pk_type FROM f WHERE pk GROUP BY node)
SELECT sigl.node, 'SELECT ' || cols || ' FROM ' || sigl.node || ' WHERE ' || coalesce(pk_name, first_name) ||
  CASE WHEN regexp_matches(lower(coalesce(pk_type, first_type)), 'int|decimal|numeric|float|double') THEN ' > 0'
       ELSE ' IS NOT NULL' END || ' LIMIT 5;' AS sql
FROM sigl LEFT JOIN pk1 ON pk1.node = sigl.node""")
def sample_sql(spark, sf):
    nodes, _ = schema_graph(spark, sf)
    return G.sample_sql(nodes)


@query("schema_document", ids="G17 G19", oracle=f"""WITH {EDGES_SQL}, {FLAGS_SQL}
SELECT node, CAST(to_json(list({{'name': name, 'type': data_type, 'nullable': nullable, 'isPrimaryKey': pk}}
                          ORDER BY position)) AS VARCHAR) AS columns_json,
  coalesce((SELECT CAST(to_json(list({{'id': id, 'to_table': dst, 'from_columns': string_split(from_columns, ','),
                                  'to_columns': string_split(to_columns, ',')}} ORDER BY id)) AS VARCHAR)
            FROM edges WHERE edges.src = f.node), '[]') AS relationships_json
FROM f GROUP BY node""")
def schema_document(spark, sf):
    nodes, edges = schema_graph(spark, sf)
    return G.schema_document(nodes, edges)
