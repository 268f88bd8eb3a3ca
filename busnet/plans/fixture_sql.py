"""The derived bus network of FIXTURES.md as SQL views (used by the DuckDB oracles only)."""

FIXTURE_VIEWS = {
    "fx_nodes_bus_stop": """
SELECT p_partkey + 1 AS id, p_partkey AS osm_id,
  CASE WHEN p_size % 17 = 0 THEN NULL WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS name,
  p_size % 2 = 0 AS has_shelter, p_size % 3 = 0 AS has_bench, p_size % 5 = 0 AS has_tactile_paving,
  p_size % 7 = 0 AS has_departures_board, p_size % 4 = 0 AS is_wheelchair_ok,
  p_brand AS local_ref, 'bus_stop' AS highway, 'platform' AS public_transport,
  CAST(20000000 + ((p_partkey * 104729) % 997) * 500 + CAST(floor(p_partkey / 30000) AS BIGINT) % 300 * 5000000 AS DOUBLE) / 1e7 AS lon,
  CAST(450000000 + ((p_partkey * 7919) % 1000) * 400 + CAST(floor(p_partkey / 1000) AS BIGINT) % 30 * 1000000 AS DOUBLE) / 1e7 AS lat
FROM part
""",
    "fx_ways_bus_stop": """
SELECT s_suppkey + 1 AS id, s_suppkey AS osm_id,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE p_name END AS name,
  s_suppkey % 2 = 0 AS has_shelter, s_suppkey % 3 = 0 AS has_bench, false AS has_tactile_paving,
  s_suppkey % 5 = 0 AS has_departures_board, true AS is_wheelchair_ok,
  s_name AS local_ref, 'bus_stop' AS highway, '' AS public_transport
FROM supplier JOIN part ON p_partkey = s_suppkey
""",
    "fx_nodes_bus_station": """
SELECT c_custkey + 1 AS id, c_custkey AS osm_id, c_name AS name,
  CAST(20000000 + ((c_custkey * 104729) % 997) * 500 AS DOUBLE) / 1e7 AS lon,
  CAST(450000000 + ((c_custkey * 7919) % 1000) * 400 AS DOUBLE) / 1e7 AS lat
FROM customer WHERE c_custkey % 2 = 1
""",
    "fx_ways_bus_station": """
SELECT c_custkey + 1 AS id,
  CASE WHEN c_custkey % 10 = 4 THEN -(2000000000000000 + c_custkey) ELSE 2000000000000000 + c_custkey END AS osm_id,
  c_name AS name,
  CASE WHEN c_custkey % 10 = 4 THEN 'ST_MultiPolygon' ELSE 'ST_Polygon' END AS geom_type
FROM customer WHERE c_custkey % 2 = 0
""",
    "fx_relations_route": """
SELECT -(o_orderkey + 1) AS osm_id,
  'Route ' || CAST(o_orderkey AS STRING) AS name,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey % 60 AS STRING) END AS ref,
  o_orderpriority AS network,
  'Origin ' || CAST(o_custkey % 10 AS STRING) AS origin,
  CASE WHEN o_custkey % 6 = 0 THEN '' ELSE 'Terminus ' || CAST(o_custkey % 12 AS STRING) END AS destination,
  CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'red' ELSE '#00AA55' END AS colour,
  o_orderstatus AS operator, '2' AS public_transport_version, 'bus' AS transport_mode
FROM orders
""",
    "fx_relation_members_route": """
SELECT -(l_orderkey + 1) AS rel_osm_id,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 40 = 0 THEN 3000000000000000 + 2 * CAST(floor(l_orderkey / 40) AS BIGINT) + j
       WHEN l_returnflag = 'R' AND l_orderkey % 40 = 8 THEN 4000000000000000 + 4 * CAST(floor(l_orderkey / 40) AS BIGINT) + (l_linenumber + j) % 4
       WHEN l_returnflag = 'R' THEN 1000000000000000 + 2 * l_suppkey + j
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_suppkey
       ELSE l_partkey END AS member_osm_id,
  CAST(rn * 10 + j AS INT) AS member_index,
  CASE WHEN l_returnflag = 'R' THEN ''
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'stop'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'stop_entry_only'
       ELSE 'platform' END AS member_role,
  CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O') THEN 1
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_partkey % 50 = 7 THEN 2 ELSE 0 END AS member_type
FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
      l_extendedprice, l_quantity, l_discount, l_tax) AS rn
  FROM lineitem
) t CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 AS j) jj
WHERE j = 0 OR l_returnflag = 'R'
""",
    "fx_way_vertex": """
SELECT way_id, CAST(pos AS INT) AS pos, CAST(lon_e7 AS DOUBLE) / 1e7 AS lon, CAST(lat_e7 AS DOUBLE) / 1e7 AS lat
FROM (
  -- street network: way w joins vertices 2w, 2w+1, 2w+2 of one snake-shaped chain
  SELECT 1000000000000000 + w AS way_id, k AS pos,
    20000000 + CAST(floor((2 * w + k) / 40) AS BIGINT) % 100000 * 12000 AS lon_e7,
    450000000 + CAST(floor((2 * w + k) / 4000000) AS BIGINT) % 300 * 1000000 + 10000 * CASE WHEN CAST(floor((2 * w + k) / 40) AS BIGINT) % 2 = 0
      THEN (2 * w + k) % 40 ELSE 39 - (2 * w + k) % 40 END AS lat_e7
  FROM (SELECT 2 * s_suppkey + j AS w FROM supplier CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 AS j) a) s
    CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) b
  UNION ALL
  -- private streets: used only by the routes with o_orderkey % 40 = 0, further north
  SELECT 3000000000000000 + w AS way_id, k AS pos,
    20000000 + CAST(floor((2 * w + k) / 40) AS BIGINT) % 100000 * 12000 AS lon_e7,
    450450000 + CAST(floor((2 * w + k) / 4000000) AS BIGINT) % 300 * 1000000 + 10000 * CASE WHEN CAST(floor((2 * w + k) / 40) AS BIGINT) % 2 = 0
      THEN (2 * w + k) % 40 ELSE 39 - (2 * w + k) % 40 END AS lat_e7
  FROM (SELECT 2 * CAST(floor(o_orderkey / 40) AS BIGINT) + j AS w FROM orders
      CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 AS j) a2 WHERE o_orderkey % 40 = 0) s2
    CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) b2
  UNION ALL
  -- crossings of the routes with o_orderkey % 40 = 8: an X, a T and an overlap
  SELECT 4000000000000000 + 4 * CAST(floor(o_orderkey / 40) AS BIGINT) + k AS way_id, pos,
    20000000 + CAST(floor(o_orderkey / 40) AS BIGINT) % 100000 * 12000 + x AS lon_e7,
    450900000 + CAST(floor(o_orderkey / 4000000) AS BIGINT) % 300 * 1000000 + y AS lat_e7
  FROM orders CROSS JOIN (VALUES (0, 0, 0, 0), (0, 1, 8000, 0), (1, 0, 1000, -3000), (1, 1, 3000, 4000),
    (2, 0, 6000, 0), (2, 1, 6000, 3500), (3, 0, 5000, 0), (3, 1, 10000, 0)) x(k, pos, x, y)
  WHERE o_orderkey % 40 = 8
  UNION ALL
  -- stop ways: short two-vertex lines beside the node stop of the same number
  SELECT s_suppkey AS way_id, k AS pos,
    20000000 + ((s_suppkey * 104729) % 997) * 500 + 100 AS lon_e7,
    450000000 + ((s_suppkey * 7919) % 1000) * 400 + 100 + 900 * k AS lat_e7
  FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) c
  UNION ALL
  -- station rings: closed squares of five vertices
  SELECT 2000000000000000 + c_custkey AS way_id, k AS pos,
    20000000 + ((c_custkey * 104729) % 997) * 500 + CASE WHEN k IN (1, 2) THEN 4000 ELSE 0 END AS lon_e7,
    450000000 + ((c_custkey * 7919) % 1000) * 400 + CASE WHEN k IN (2, 3) THEN 3000 ELSE 0 END AS lat_e7
  FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 4 AS k) d
  WHERE c_custkey % 2 = 0
  UNION ALL
  -- holes of the stations with the last digit 6, second parts of those with 4
  SELECT CASE WHEN c_custkey % 10 = 6 THEN 5000000000000000 ELSE 6000000000000000 END + c_custkey AS way_id, k AS pos,
    20000000 + ((c_custkey * 104729) % 997) * 500 + CASE WHEN c_custkey % 10 = 6 THEN 500 + CASE WHEN k IN (1, 2) THEN 1000 ELSE 0 END
      ELSE 6000 + CASE WHEN k IN (1, 2) THEN 2000 ELSE 0 END END AS lon_e7,
    450000000 + ((c_custkey * 7919) % 1000) * 400 + CASE WHEN c_custkey % 10 = 6 THEN 700 + CASE WHEN k IN (2, 3) THEN 800 ELSE 0 END
      ELSE 1000 + CASE WHEN k IN (2, 3) THEN 1500 ELSE 0 END END AS lat_e7
  FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 4 AS k) d2
  WHERE c_custkey % 10 IN (4, 6)
) v
""",
}
