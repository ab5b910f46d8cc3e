"""The same queries in DuckDB's SQL, built from shared table expressions."""

from __future__ import annotations


def _lat(k: str) -> str:
    return f"(16.96e0 + (({k}) * 7919 % 1009) * 0.05e0 / 1009e0)"


def _lng(k: str) -> str:
    return f"(81.76e0 + (({k}) * 104729 % 1013) * 0.06e0 / 1013e0)"


def _metres(a: str, b: str, c: str, d: str) -> str:
    x = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(6371000e0 * 2 * atan2(sqrt({x}), sqrt(1 - {x})))"


_PARTS = {
    "known": "SELECT p_partkey AS k FROM part WHERE p_partkey % 97 <> 0 UNION ALL SELECT 1000000 + s_suppkey FROM supplier UNION ALL SELECT 2000000 + n_nationkey::BIGINT FROM nation",
    "nodeel": f"SELECT k + 10000000 AS pos, k AS id, {_lat('k')} AS lat, {_lng('k')} AS lon FROM known UNION ALL SELECT k, k, {_lat('k + 1')}, {_lng('k + 1')} FROM known WHERE k % 10 = 0 AND k < 1000000",
    "wayel": """SELECT o_orderkey AS id, l.nodes, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN '-1' END AS oneway,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'residential' WHEN '4-NOT SPECIFIED' THEN 'footway' WHEN '5-LOW' THEN 'service' END AS highway
        FROM orders LEFT JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nodes FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
        UNION ALL SELECT 5000000000 + n_regionkey, list(2000000 + n_nationkey::BIGINT ORDER BY n_nationkey), NULL, NULL FROM nation GROUP BY n_regionkey""",
    "way": "SELECT * FROM wayel WHERE len(nodes) >= 2",
    "node": "SELECT id AS osm_id, arg_max(lat, pos) AS lat, arg_max(lon, pos) AS lng FROM nodeel GROUP BY id",
    "ref": "SELECT DISTINCT unnest(nodes) AS osm_id FROM way",
    "gnode": "SELECT * FROM node WHERE osm_id IN (SELECT osm_id FROM ref)",
    "step": "SELECT id AS osm_way_id, unnest(nodes) AS f, generate_subscripts(nodes, 1) - 1 AS pos, coalesce(oneway IN ('yes', '1', 'true'), false) OR coalesce(highway IN ('motorway', 'motorway_link'), false) AS oneway FROM way",
    "pair": "SELECT * FROM (SELECT *, lead(f) OVER (PARTITION BY osm_way_id ORDER BY pos) AS t FROM step) WHERE t IS NOT NULL",
    "kpair": f"SELECT pair.*, {_metres('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS weight FROM pair JOIN gnode a ON a.osm_id = f JOIN gnode b ON b.osm_id = t",
    "edge": "SELECT f, t, weight, osm_way_id FROM kpair UNION ALL SELECT t, f, weight, osm_way_id FROM kpair WHERE NOT oneway",
    "ed": "SELECT f, t, min(weight) AS w FROM edge GROUP BY f, t",
    "req": """SELECT event_id AS request_id, 16.955e0 + ((event_id % 8 * 211 + 57) * 7919 % 1009) * 0.06e0 / 1009e0 AS start_lat, 81.755e0 + ((event_id % 8 * 173 + 31) * 104729 % 1013) * 0.07e0 / 1013e0 AS start_lng,
        16.955e0 + (event_id * 6007 % 1009) * 0.06e0 / 1009e0 AS end_lat, 81.755e0 + (event_id * 7001 % 1013) * 0.07e0 / 1013e0 AS end_lng FROM events""",
    "rin": "SELECT *, start_lat BETWEEN 16.96e0 AND 17.01e0 AND start_lng BETWEEN 81.76e0 AND 81.82e0 AS start_in, end_lat BETWEEN 16.96e0 AND 17.01e0 AND end_lng BETWEEN 81.76e0 AND 81.82e0 AS end_in FROM req",
    "click": "SELECT DISTINCT lat, lng FROM (SELECT start_lat AS lat, start_lng AS lng FROM req UNION ALL SELECT end_lat, end_lng FROM req)",
    "hit": "SELECT c.lat, c.lng, arg_min(osm_id, (c.lat - n.lat) * (c.lat - n.lat) + (c.lng - n.lng) * (c.lng - n.lng)) AS node FROM click c CROSS JOIN gnode n GROUP BY c.lat, c.lng",
    "lat1": "SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey % 45 <> 0 UNION ALL SELECT p_partkey, p_partkey + 45 FROM part",
    "lat2": "SELECT a, b, (1 + (a * 31 + b * 17) % 7)::DOUBLE AS w FROM lat1 WHERE b IN (SELECT p_partkey FROM part)",
    "grid": "SELECT a AS f, b AS t, w FROM lat2 UNION ALL SELECT b, a, w FROM lat2",
    "isle": f"SELECT r_name AS name, {_lat('2000000 + n_nationkey::BIGINT')} AS lat, {_lng('2000000 + n_nationkey::BIGINT')} AS lng FROM nation JOIN region ON r_regionkey = n_regionkey",
    "box": "SELECT name, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM isle GROUP BY name",
    "rev": "SELECT t AS f, f AS t, w FROM ed",
    "street": """SELECT o_orderkey AS o, o_custkey AS cust, o_orderstatus = 'F' AS oneway, 1000000 + min(l_suppkey) AS shop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "bend": "SELECT l_orderkey AS o, l_linenumber AS pos, 20000000 + l_orderkey * 8 + l_linenumber AS node, 1 + (l_partkey * 31 + l_linenumber * 17) % 7 AS step FROM lineitem UNION ALL SELECT o, 0, cust, 0 FROM street UNION ALL SELECT o, 9, shop, 1 + o % 7 FROM street",
    "bpair": "SELECT o, lag(node) OVER (PARTITION BY o ORDER BY pos, step) AS a, node AS b, step::DOUBLE AS w FROM bend",
    "bmap": "SELECT f, t, min(w) AS w FROM (SELECT a AS f, b AS t, w FROM bpair WHERE a IS NOT NULL UNION ALL SELECT b, a, w FROM bpair JOIN street USING (o) WHERE a IS NOT NULL AND NOT oneway) GROUP BY f, t",
    "blink": "SELECT DISTINCT f AS node, t AS other FROM (SELECT f, t FROM bmap UNION ALL SELECT t, f FROM bmap) WHERE f <> t",
    "binner": "SELECT node FROM blink GROUP BY node HAVING count(*) = 2",
    "ends": "SELECT request_id, start_in, end_in, start_lat, start_lng, end_lat, end_lng, s.node AS src, e.node AS tgt FROM rin JOIN hit s ON s.lat = start_lat AND s.lng = start_lng JOIN hit e ON e.lat = end_lat AND e.lng = end_lng",
}
_NEEDS = {
    "nodeel": ["known"], "way": ["wayel"], "node": ["nodeel"], "ref": ["way"], "gnode": ["node", "ref"], "step": ["way"], "pair": ["step"], "kpair": ["pair", "gnode"], "edge": ["kpair"], "ed": ["edge"],
    "box": ["isle"], "rev": ["ed"], "bend": ["street"], "bpair": ["bend"], "bmap": ["bpair"], "blink": ["bmap"], "binner": ["blink"],
    "rin": ["req"], "click": ["req"], "hit": ["click", "gnode"], "lat2": ["lat1"], "grid": ["lat2"], "ends": ["rin", "hit"],
}


def _with(select: str, *names: str, search: str = "") -> str:
    """The table expressions that the names need, in order, and the select."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({_PARTS[n]})" for n in order]
    return "WITH " + ("RECURSIVE " if search else "") + ",\n".join([*parts, *([search] if search else [])]) + "\n" + select


def _search(graph: str, sources: str) -> str:
    """Least distances with predecessor and hops from each source."""
    return f"""sp(src, id, d, prev, hops) USING KEY (src, id) AS (
        SELECT src, src, 0e0, NULL::BIGINT, 0 FROM ({sources})
        UNION ALL
        (SELECT sp.src, g.t, min(sp.d + g.w), arg_min(sp.id, sp.d + g.w), arg_min(sp.hops + 1, sp.d + g.w) FROM sp JOIN {graph} g ON g.f = sp.id
         LEFT JOIN recurring.sp k ON k.src = sp.src AND k.id = g.t GROUP BY sp.src, g.t HAVING min(sp.d + g.w) < coalesce(min(k.d), 1e308)))"""


_ONE = "SELECT 1::BIGINT AS src"
_DEPOTS = "SELECT DISTINCT src FROM ends WHERE start_in AND end_in"
_WALK = """, walk(src, tgt, node, prev, back) AS (
        SELECT q.src, q.tgt, sp.id, sp.prev, 0 FROM ({ends}) q JOIN sp ON sp.src = q.src AND sp.id = q.tgt
        UNION ALL
        SELECT walk.src, walk.tgt, sp.id, sp.prev, back + 1 FROM walk JOIN sp ON sp.src = walk.src AND sp.id = walk.prev)"""


def _routes(requests: str, known: str) -> str:
    """Paths from node 1 (or a node to itself) for requests(request_id, src, tgt); both ends must be graph nodes."""
    search = _search("ed", _ONE) + _WALK.format(ends="SELECT DISTINCT src, tgt FROM rq WHERE src = 1 AND src <> tgt")
    select = f"""SELECT request_id, CASE WHEN {known} THEN CASE WHEN rq.src = rq.tgt THEN rq.src::VARCHAR ELSE coalesce(path, '') END ELSE '' END AS path, CASE WHEN {known} THEN CASE WHEN rq.src = rq.tgt THEN 0e0 ELSE coalesce(round(d, 3), -1e0) END ELSE -1e0 END AS distance
        FROM rq LEFT JOIN sp ON sp.src = rq.src AND sp.id = rq.tgt LEFT JOIN (SELECT src, tgt, string_agg(node::VARCHAR, '>' ORDER BY back DESC) AS path FROM walk GROUP BY src, tgt) p ON p.src = rq.src AND p.tgt = rq.tgt"""
    text = _with(select, "ed", search=search)
    return text.replace("WITH RECURSIVE ", f"WITH RECURSIVE rq AS (SELECT * FROM ({requests})), ", 1)


_KNOWN = "rq.src IN (SELECT osm_id FROM gnode) AND rq.tgt IN (SELECT osm_id FROM gnode)"
_NO_ROUTE = "format('No route from node {} to node {}', ends.src, tgt)"
_STATUS = "CASE WHEN NOT start_in OR NOT end_in THEN 400 WHEN d IS NULL THEN 404 ELSE 200 END"
_BATCH = "ends LEFT JOIN sp ON sp.src = ends.src AND sp.id = ends.tgt AND start_in AND end_in"
_ERROR = f"CASE WHEN NOT start_in THEN printf('Point (%.5f, %.5f) lies outside Rajahmundry', start_lat, start_lng) WHEN NOT end_in THEN printf('Point (%.5f, %.5f) lies outside Rajahmundry', end_lat, end_lng) WHEN d IS NULL THEN {_NO_ROUTE} END"
_POINT = "round(lat, 6) AS lat, round(lng, 6) AS lng"
_OFF = _metres("start_lat", "start_lng", "end_lat", "end_lng")

ORACLE = {
    "osm_element_counts": _with("SELECT 'node' AS type, count(*) AS n, 0::BIGINT AS n_refs FROM nodeel UNION ALL SELECT 'way', count(*), sum(coalesce(len(nodes), 0))::BIGINT FROM wayel", "nodeel", "wayel"),
    "osm_json_roundtrip": _with("SELECT 'node' AS type, count(*) AS n, sum(id)::BIGINT AS sum_id, 0::BIGINT AS n_refs, round(sum(round(lat, 6)), 3) AS sum_lat, 0::BIGINT AS n_oneway FROM nodeel UNION ALL SELECT 'way', count(*), sum(id)::BIGINT, sum(coalesce(len(nodes), 0))::BIGINT, 0e0, count(oneway) FROM wayel", "nodeel", "wayel"),
    "osm_json_files": _with("SELECT 'node' AS type, count(*) AS n, sum(id)::BIGINT AS sum_id, 0::BIGINT AS n_refs, round(sum(round(lat, 6)), 3) AS sum_lat, 0::BIGINT AS n_oneway FROM nodeel UNION ALL SELECT 'way', count(*), sum(id)::BIGINT, sum(coalesce(len(nodes), 0))::BIGINT, 0e0, count(oneway) FROM wayel", "nodeel", "wayel"),
    "way_filter": _with("SELECT id AS osm_way_id, len(nodes) AS n_refs FROM way", "way"),
    "way_highway_filter": _with("SELECT id AS osm_way_id, highway FROM way WHERE highway IN ('motorway', 'primary', 'residential', 'service')", "way"),
    "bbox_way_select": _with("SELECT DISTINCT id AS osm_way_id FROM (SELECT id, unnest(nodes) AS r FROM way) JOIN node ON osm_id = r WHERE lat BETWEEN 16.96e0 AND 16.985e0 AND lng BETWEEN 81.76e0 AND 81.79e0", "way", "node"),
    "recurse_nodes": _with("SELECT osm_id FROM node WHERE osm_id IN (SELECT unnest(nodes) FROM way WHERE highway IN ('motorway', 'primary', 'residential', 'service'))", "way", "node"),
    "node_dedupe_last_wins": _with(f"SELECT osm_id, {_POINT} FROM node", "node"),
    "referenced_nodes": _with("SELECT osm_id FROM ref", "ref"),
    "graph_nodes": _with(f"SELECT osm_id, {_POINT} FROM gnode", "gnode"),
    "way_pairs": _with("SELECT osm_way_id, pos, f AS from_osm_id, t AS to_osm_id FROM pair", "pair"),
    "oneway_flag": _with("SELECT DISTINCT osm_way_id, oneway FROM step", "step"),
    "directed_edges": _with("SELECT f AS from_osm_id, t AS to_osm_id, osm_way_id, count(*) AS n FROM edge GROUP BY ALL", "edge"),
    "edge_weights": _with("SELECT f AS from_osm_id, t AS to_osm_id, osm_way_id, round(weight, 3) AS weight FROM edge", "edge"),
    "surrogate_keys": _with("SELECT row_number() OVER (ORDER BY osm_id) AS id, osm_id FROM gnode", "gnode"),
    "edge_fk_translate": _with("SELECT a.id AS from_node_id, b.id AS to_node_id, count(*) AS n, min(osm_way_id) AS first_way, round(min(weight), 3) AS weight FROM edge JOIN (SELECT row_number() OVER (ORDER BY osm_id) AS id, osm_id FROM gnode) a ON a.osm_id = f JOIN (SELECT row_number() OVER (ORDER BY osm_id) AS id, osm_id FROM gnode) b ON b.osm_id = t GROUP BY a.id, b.id", "edge"),
    "import_metrics": _with("SELECT (SELECT count(*) FROM way) AS n_ways, (SELECT count(*) FROM gnode) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges", "edge"),
    "dq_unique": _with("SELECT id AS osm_id, count(*) AS n FROM nodeel GROUP BY id HAVING count(*) > 1", "nodeel"),
    "dq_not_null": _with("SELECT 0::BIGINT AS id, (SELECT count(*) FROM wayel) AS lat, (SELECT count(*) FROM wayel) AS lon, (SELECT count(*) FROM nodeel) + (SELECT count(*) FROM wayel WHERE nodes IS NULL) AS nodes, (SELECT count(*) FROM nodeel) + (SELECT count(*) FROM wayel WHERE id >= 5000000000) AS tags", "nodeel", "wayel"),
    "dq_fk_orphans": _with('SELECT e AS "end", count(*) AS n FROM (SELECT f AS e FROM pair UNION ALL SELECT t FROM pair) WHERE e NOT IN (SELECT osm_id FROM gnode) GROUP BY e', "pair", "gnode"),
    "dq_edge_node_ratio": _with("SELECT *, n_edges >= n_nodes AND n_negative = 0 AS ok FROM (SELECT (SELECT count(*) FROM gnode) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges, (SELECT count(*) FROM edge WHERE weight < 0) AS n_negative)", "edge"),
    "adjacency_degree": _with("SELECT osm_id AS node_id, count(f) AS degree, round(coalesce(sum(weight), 0e0), 2) AS total_weight FROM gnode LEFT JOIN edge ON f = osm_id GROUP BY osm_id", "edge"),
    "adjacency_list": _with("SELECT osm_id AS node_id, count(f) AS degree, coalesce(string_agg(t::VARCHAR || ':' || round(weight)::BIGINT::VARCHAR, ',' ORDER BY t, weight) FILTER (f IS NOT NULL), '') AS neighbors FROM gnode LEFT JOIN edge ON f = osm_id GROUP BY osm_id", "edge"),
    "reduced_edges": _with("SELECT f AS from_node_id, t AS to_node_id, round(w, 3) AS weight FROM ed", "ed"),
    "node_by_osm_id": _with(f"SELECT osm_id, {_POINT} FROM gnode WHERE osm_id = 42", "gnode"),
    "edges_from_node": _with("SELECT f AS from_osm_id, t AS to_osm_id, round(weight, 3) AS weight, osm_way_id FROM edge WHERE f = 42", "edge"),
    "stored_graph": _with("SELECT 'nodes' AS name, count(*) AS n, sum(osm_id)::BIGINT AS ids, round(sum(round(lat, 6)), 3) AS total FROM gnode UNION ALL SELECT 'edges', count(*), sum(f + t)::BIGINT, round(sum(round(weight, 2)), 1) FROM edge", "edge"),
    "node_pages": _with("SELECT osm_id AS id, round(lat, 6) AS lat FROM gnode ORDER BY osm_id LIMIT 10 OFFSET 20", "gnode"),
    "import_gate": _with("SELECT step, step IN (1, 3) AS written, (SELECT count(*) FROM gnode WHERE step < 3 OR osm_id <> 1) AS n_nodes, (SELECT count(*) FROM gnode WHERE step < 3 AND osm_id = 1) AS n_first FROM (SELECT unnest([1, 2, 3, 4])::INT AS step)", "gnode"),
    "region_info": _with("SELECT name, round((south + north) / 2, 6) AS center_lat, round((west + east) / 2, 6) AS center_lng, round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east FROM box", "box"),
    "bbox_format": _with("SELECT name, printf('%.6f,%.6f,%.6f,%.6f', south, west, north, east) AS box FROM box", "box"),
    "form_body": _with("SELECT name, 'data=' || replace(printf('%.6f,%.6f,%.6f,%.6f', south, west, north, east), ',', '%2C') AS body FROM box", "box"),
    "point_geometry": _with(f"SELECT osm_id, 25::BIGINT AS n_bytes, {_POINT} FROM gnode", "gnode"),
    "bbox_contains": _with("SELECT request_id, start_in, end_in FROM rin", "rin"),
    "haversine_metres": _with(f"SELECT request_id, round({_OFF}, 3) AS metres FROM req", "req"),
    "eta": _with(f"SELECT request_id, round(round({_OFF}) / (30000e0 / 3600e0))::BIGINT AS secs FROM req", "req"),
    "shown_values": _with(f"SELECT request_id, round(h / 1000e0, 1) AS km, round(round(h / (30000e0 / 3600e0))::BIGINT / 60e0)::BIGINT AS minutes FROM (SELECT request_id, round({_OFF} / 100e0) * 100e0 AS h FROM req)", "req"),
    "nearest_single": _with(f"SELECT osm_id AS id, {_POINT} FROM gnode ORDER BY (lat - 16.975e0) * (lat - 16.975e0) + (lng - 81.778e0) * (lng - 81.778e0), osm_id LIMIT 1", "gnode"),
    "snap_batch": _with("SELECT request_id AS click_id, node AS node_id FROM req JOIN hit ON lat = end_lat AND lng = end_lng", "hit"),
    "snap_region": _with("SELECT request_id AS click_id, end_in AS inside, CASE WHEN end_in THEN node ELSE -1 END AS node_id FROM rin JOIN hit ON lat = end_lat AND lng = end_lng", "hit", "rin"),
    "sssp_distances": _with("SELECT id AS node, round(d, 3) AS dist FROM sp", "ed", search=_search("ed", _ONE)),
    "sssp_lattice": _with("SELECT id AS node, d AS dist FROM sp", "grid", search=_search("grid", _ONE)),
    "route_path": _routes("SELECT p_partkey AS request_id, 1::BIGINT AS src, p_partkey AS tgt FROM part", _KNOWN),
    "route_same_node": _routes("SELECT p_partkey AS request_id, p_partkey AS src, p_partkey AS tgt FROM part", _KNOWN),
    "route_unknown_node": _routes("SELECT s_suppkey AS request_id, 1::BIGINT AS src, 1000000 + s_suppkey AS tgt FROM supplier UNION ALL SELECT -s_suppkey, 1000000 + s_suppkey, 1000000 + s_suppkey FROM supplier", _KNOWN),
    "route_unreachable": _routes("SELECT 2000000 + n_nationkey::BIGINT AS request_id, 1::BIGINT AS src, 2000000 + n_nationkey::BIGINT AS tgt FROM nation", _KNOWN),
"route_many_sources": _with("SELECT src AS request_id, coalesce((hops + 1)::BIGINT, 0) AS n_points, coalesce(round(d, 3), -1e0) AS distance FROM (SELECT s_suppkey * 20 - 19 AS src FROM supplier) LEFT JOIN (SELECT * FROM sp WHERE id = src + 7) s USING (src)", "ed", search=_search("ed", "SELECT s_suppkey * 20 - 19 AS src FROM supplier WHERE s_suppkey * 20 - 19 IN (SELECT osm_id FROM gnode) AND s_suppkey * 20 - 12 IN (SELECT osm_id FROM gnode)")),
    "landmark_table": _with("SELECT id AS node, " + ", ".join(f"coalesce(round(max(d) FILTER (way = '{w}' AND src = {i}), 3), -1e0) AS {w}_{i}" for w in ("out", "into") for i in (1, 2, 3)) + " FROM (SELECT 'into' AS way, src, id, d FROM sp UNION ALL SELECT 'out', src, id, d FROM sr) GROUP BY id", "rev", search=_search("ed", "SELECT unnest([1, 2, 3])::BIGINT AS src") + ", " + _search("rev", "SELECT unnest([1, 2, 3])::BIGINT AS src").replace("sp", "sr")),
    "route_by_landmarks": _with("SELECT request_id, coalesce((hops + 1)::BIGINT, 0) AS n_points, coalesce(round(d, 3), -1e0) AS distance FROM (SELECT n_nationkey::BIGINT * 3 + k AS request_id, CASE WHEN k > 0 THEN n_nationkey::BIGINT * 7 + 1 ELSE 2000000 + n_nationkey::BIGINT END AS src, CASE k WHEN 0 THEN n_nationkey::BIGINT * 7 + 1 WHEN 1 THEN 2000000 + n_nationkey::BIGINT ELSE n_nationkey::BIGINT * 7 + 4 END AS id FROM nation, (SELECT unnest([0, 1, 2]) AS k)) q LEFT JOIN (SELECT * FROM sp WHERE id IN (SELECT osm_id FROM gnode)) s USING (src, id)", "ed", search=_search("ed", "SELECT osm_id AS src FROM gnode WHERE osm_id IN (SELECT n_nationkey::BIGINT * 7 + 1 FROM nation UNION SELECT 2000000 + n_nationkey::BIGINT FROM nation)")),
    "collapsed_chains": _with("""SELECT (SELECT count(*) FROM bpair JOIN street USING (o) WHERE a IS NOT NULL) + (SELECT count(*) FROM bpair JOIN street USING (o) WHERE a IS NOT NULL AND NOT oneway) AS n_edges,
        (SELECT count(DISTINCT node) FROM bend) AS n_nodes, (SELECT count(*) FROM binner) AS n_inner, (SELECT count(DISTINCT node) FROM bend) - (SELECT count(*) FROM binner) AS n_stay,
        (SELECT count(*) FROM blink WHERE node IN (SELECT node FROM binner) AND other NOT IN (SELECT node FROM binner)) // 2 AS n_chains""", "binner"),
    "collapsed_distances": _with("SELECT tgt AS request_id, coalesce(d, -1e0) AS distance, coalesce(d, -1e0) AS length FROM (SELECT c_custkey AS tgt FROM customer UNION ALL SELECT 20000000 + (n_nationkey::BIGINT + 1) * 8 + 1 FROM nation) LEFT JOIN sp ON id = tgt", "bmap", search=_search("bmap", _ONE)),
    "route_overlay": _with("SELECT n_nationkey::BIGINT AS request_id, coalesce(d, -1e0) AS distance FROM nation LEFT JOIN sp ON src = n_nationkey::BIGINT * 7 + 1 AND id = 200 - n_nationkey::BIGINT * 3", "grid", search=_search("grid", "SELECT n_nationkey::BIGINT * 7 + 1 AS src FROM nation")),
    "respond_broken_graph": "SELECT p_partkey AS request_id, CASE p_partkey % 10 WHEN 4 THEN 200 WHEN 3 THEN 400 ELSE 500 END AS status, CASE p_partkey % 10 WHEN 4 THEN 4e0 ELSE -1e0 END AS distance, (CASE p_partkey % 10 WHEN 4 THEN 5 ELSE 0 END)::BIGINT AS n_points FROM part WHERE p_partkey > 9 AND p_partkey % 10 IN (2, 3, 4, 8)",
    "respond_nothing_near": "SELECT p_partkey AS request_id, CASE p_partkey % 10 WHEN 2 THEN 500 WHEN 3 THEN 400 ELSE 503 END AS status, -1e0 AS distance, 0::BIGINT AS n_points FROM part WHERE p_partkey > 9 AND p_partkey % 10 IN (2, 3, 4, 8)",
    "respond_empty_graph": "SELECT p_partkey AS request_id, 503 AS status, -1e0 AS distance, 0::BIGINT AS n_points FROM part WHERE p_partkey > 9 AND p_partkey % 10 IN (2, 3, 4, 8)",
    "route_batch": _with(f"SELECT request_id, {_STATUS} AS status, coalesce(round(d, 3), -1e0) AS distance_meters, coalesce(round(d / (30000e0 / 3600e0))::BIGINT, -1) AS estimated_time_secs, coalesce((hops + 1)::BIGINT, -1) AS n_points FROM {_BATCH}", "ed", "ends", search=_search("ed", _DEPOTS)),
    "polyline": _with("SELECT request_id, line FROM ends JOIN (SELECT src, tgt, string_agg(printf('%.5f %.5f', lat, lng), ',' ORDER BY back DESC) AS line FROM walk JOIN gnode ON osm_id = node GROUP BY src, tgt) p ON p.src = ends.src AND p.tgt = ends.tgt WHERE start_in AND end_in", "ed", "ends", search=_search("ed", _DEPOTS) + _WALK.format(ends="SELECT DISTINCT src, tgt FROM ends WHERE start_in AND end_in")),
    "route_errors": _with(f"SELECT request_id, {_STATUS} AS status, {_ERROR} AS error FROM {_BATCH} WHERE {_STATUS} <> 200", "ed", "ends", search=_search("ed", _DEPOTS)),
    "route_response_json": _with(f"SELECT request_id, {_STATUS} AS status, coalesce(round(d / (30000e0 / 3600e0))::BIGINT, -1) AS secs, coalesce({_ERROR}, '') AS error FROM {_BATCH}", "ed", "ends", search=_search("ed", _DEPOTS)),
}
