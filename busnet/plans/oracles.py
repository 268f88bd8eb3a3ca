"""DuckDB statements that give the registered queries' results by other means.

Each statement is assembled from named views (CTEs); only the views it needs are included.
Plain math stands in for geometry functions, enumeration for the smallest circle, a recursive
closure for connected components and the direct self-join for the connection lists.
"""

from __future__ import annotations

import re

from busnet.plans.fixture_sql import FIXTURE_VIEWS

_A = "6378137.0"
_F = "(1.0/298.257223563)"
_E2 = f"({_F}*(2.0-{_F}))"
_HALF = f"(pi()*{_A})"


def _mx(lon: str) -> str:
    return f"({_A}*radians({lon}))"


def _my(lat: str) -> str:
    return f"({_A}*ln(tan(pi()/4+radians({lat})/2)))"


def _lon(x: str) -> str:
    return f"degrees({x}/{_A})"


def _lat(y: str) -> str:
    return f"degrees(2*atan(exp({y}/{_A}))-pi()/2)"


def _andoyer(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    b1, b2 = (f"atan((1-{_F})*tan(radians({v})))" for v in (lat1, lat2))
    p, q = f"(({b1}+{b2})/2)", f"(({b2}-{b1})/2)"
    hav = f"(sin({q})**2+cos({b1})*cos({b2})*sin(radians({lon2}-{lon1})/2)**2)"
    s = f"(2*asin(least(1.0,sqrt({hav}))))"
    along = f"(({s}-sin({s}))*(sin({p})*cos({q}))**2/cos({s}/2)**2)"
    across = f"(({s}+sin({s}))*(cos({p})*sin({q}))**2/sin({s}/2)**2)"
    return (
        f"CASE WHEN {lon1}={lon2} AND {lat1}={lat2} THEN 0.0 "
        f"ELSE {_A}*({s}-{_F}/2*({along}+{across})) END"
    )


def _q(lat: str) -> str:
    s, e = f"sin(radians({lat}))", f"sqrt({_E2})"
    return (
        f"((1-{_E2})*({s}/(1-{_E2}*{s}*{s})+ln((1+{e}*{s})/(1-{e}*{s}))/(2*{e})))"
    )


def _area(cx: str, cy: str, r: str) -> str:
    def lon(k):
        return f"({cx}+{r}*cos({k}*pi()/96))"

    def lat(k):
        return f"({cy}+{r}*sin({k}*pi()/96))"

    strip = f"radians({lon('(k+1)')}-{lon('k')})*({_q(lat('k'))}+{_q(lat('(k+1)'))})"
    return f"(abs(list_sum(list_transform(range(192), lambda k: {strip})))*{_A}*{_A}/4)"


def _near(a: str, b: str) -> str:
    """Metres between two segments in the tangent plane at their mean latitude."""
    lat0 = f"(({a}.lat1+{a}.lat2+{b}.lat1+{b}.lat2)/4)"
    w2 = f"(1-{_E2}*sin(radians({lat0}))**2)"
    m, n = f"({_A}*(1-{_E2})/({w2}*sqrt({w2})))", f"({_A}/sqrt({w2})*cos(radians({lat0})))"

    def pt(t, i):
        return f"(radians({t}.lon{i}-{a}.lon1)*{n})", f"(radians({t}.lat{i}-{a}.lat1)*{m})"

    def point_segment(p, s, e):
        dx, dy = f"({e[0]}-{s[0]})", f"({e[1]}-{s[1]})"
        l2 = f"({dx}*{dx}+{dy}*{dy})"
        t = (
            f"(CASE WHEN {l2}>0 THEN greatest(0.0,least(1.0,(({p[0]}-{s[0]})*{dx}+({p[1]}-{s[1]})*{dy})/{l2}))"
            f" ELSE 0.0 END)"
        )
        return f"sqrt(({s[0]}+{dx}*{t}-{p[0]})**2+({s[1]}+{dy}*{t}-{p[1]})**2)"

    a1, a2, b1, b2 = pt(a, 1), pt(a, 2), pt(b, 1), pt(b, 2)
    return (
        f"least({point_segment(a1, b1, b2)},{point_segment(a2, b1, b2)},"
        f"{point_segment(b1, a1, a2)},{point_segment(b2, a1, a2)})"
    )


def _e7(v: str) -> str:
    return f"CAST(round({v}*1e7) AS BIGINT)"


def _spot(lon: str, lat: str) -> str:
    return f"({_e7(lon)}||' '||{_e7(lat)})"


def _txt(v: str) -> str:
    return f"coalesce({v},'\\N')"


_FLAGS = "has_shelter, has_bench, has_tactile_paving, has_departures_board, is_wheelchair_ok"
_ROUTE = "osm_id, ref, name, network, operator, origin, destination, colour"
_IS_POS = "member_type IN (0,1) AND (member_role LIKE '%stop%' OR member_role LIKE '%platform%')"
_IS_WAY = "member_type=1 AND member_role NOT LIKE '%stop%' AND member_role NOT LIKE '%platform%'"

VIEWS: dict[str, str] = {
    **FIXTURE_VIEWS,
    "rel": "SELECT * REPLACE (abs(osm_id) AS osm_id) FROM fx_relations_route",
    "mem": "SELECT * REPLACE (abs(rel_osm_id) AS rel_osm_id) FROM fx_relation_members_route",
    "vtx": f"SELECT way_id, pos, lon, lat, {_mx('lon')} AS x, {_my('lat')} AS y FROM fx_way_vertex",
    "wseg": """SELECT a.way_id, a.pos, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2,
        a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x-a.x)**2+(b.y-a.y)**2) AS len
      FROM vtx a JOIN vtx b ON a.way_id=b.way_id AND b.pos=a.pos+1""",
    "wline": f"SELECT way_id, string_agg({_spot('lon', 'lat')}, ',' ORDER BY pos) AS geom FROM vtx GROUP BY way_id",
    "wcen": """SELECT way_id, sum(len*(ax+bx)/2)/sum(len) AS x, sum(len*(ay+by_)/2)/sum(len) AS y
      FROM wseg GROUP BY way_id""",
    "elem": f"""SELECT 0 AS t, osm_id AS id, {_mx('lon')} AS x, {_my('lat')} AS y, lon, lat FROM fx_nodes_bus_stop
      UNION ALL SELECT 1, way_id, x, y, {_lon('x')}, {_lat('y')} FROM wcen""",
    "stop": f"""SELECT 0 AS osm_type, n.osm_id, n.id, name, {_FLAGS}, local_ref, e.x, e.y, e.lon, e.lat
      FROM fx_nodes_bus_stop n JOIN elem e ON e.t=0 AND e.id=n.osm_id
      UNION SELECT 1, w.osm_id, w.id, name, {_FLAGS}, local_ref, e.x, e.y, e.lon, e.lat
      FROM fx_ways_bus_stop w JOIN elem e ON e.t=1 AND e.id=w.osm_id""",
    "posn": f"""SELECT m.rel_osm_id, m.member_type, m.member_osm_id, m.member_index, e.x, e.y, e.lon, e.lat
      FROM mem m LEFT JOIN elem e ON e.t=m.member_type AND e.id=m.member_osm_id WHERE {_IS_POS}""",
    "path": f"SELECT rel_osm_id, member_index, member_osm_id AS way_id FROM mem WHERE {_IS_WAY}",
    # --- spacing and diameter
    "spc": f"""SELECT rel_osm_id, member_index, lon, lat,
        {_andoyer('lon', 'lat', 'plon', 'plat')} AS distance
      FROM (SELECT m.rel_osm_id, m.member_index, e.lon, e.lat,
          lag(e.lon,1,e.lon) OVER w AS plon, lag(e.lat,1,e.lat) OVER w AS plat
        FROM mem m LEFT JOIN elem e ON e.t=m.member_type AND e.id=m.member_osm_id
        WHERE m.member_role LIKE '%stop%'
        WINDOW w AS (PARTITION BY m.rel_osm_id ORDER BY m.member_index)) t""",
    "kept": "SELECT rel_osm_id, distance, lon, lat FROM spc WHERE distance > 10",
    "avgd": "SELECT rel_osm_id, CAST(round_even(avg(distance),0) AS INT) AS avg_distance FROM kept GROUP BY rel_osm_id",
    "pt": "SELECT DISTINCT rel_osm_id, lon, lat FROM kept",
    "cand": """SELECT rel_osm_id, lon AS cx, lat AS cy, 0.0 AS r FROM pt
      UNION ALL
      SELECT a.rel_osm_id, (a.lon+b.lon)/2, (a.lat+b.lat)/2, sqrt((a.lon-b.lon)**2+(a.lat-b.lat)**2)/2
      FROM pt a JOIN pt b ON a.rel_osm_id=b.rel_osm_id AND (a.lon,a.lat)<(b.lon,b.lat)
      UNION ALL
      SELECT rel_osm_id, ax+ux, ay+uy, sqrt(ux*ux+uy*uy) FROM (
        SELECT rel_osm_id, ax, ay, (cy*(bx*bx+by_*by_)-by_*(cx*cx+cy*cy))/d AS ux,
          (bx*(cx*cx+cy*cy)-cx*(bx*bx+by_*by_))/d AS uy
        FROM (SELECT a.rel_osm_id, a.lon AS ax, a.lat AS ay, b.lon-a.lon AS bx, b.lat-a.lat AS by_,
            c.lon-a.lon AS cx, c.lat-a.lat AS cy,
            2*((b.lon-a.lon)*(c.lat-a.lat)-(b.lat-a.lat)*(c.lon-a.lon)) AS d
          FROM pt a JOIN pt b ON a.rel_osm_id=b.rel_osm_id AND (a.lon,a.lat)<(b.lon,b.lat)
          JOIN pt c ON b.rel_osm_id=c.rel_osm_id AND (b.lon,b.lat)<(c.lon,c.lat)) t WHERE d <> 0) t""",
    "circ": """SELECT rel_osm_id, arg_min(cx,r) AS cx, arg_min(cy,r) AS cy, min(r) AS r FROM cand c
      WHERE NOT EXISTS (SELECT 1 FROM pt p WHERE p.rel_osm_id=c.rel_osm_id
        AND sqrt((p.lon-c.cx)**2+(p.lat-c.cy)**2) > c.r*(1+1e-9)+1e-12)
      GROUP BY rel_osm_id""",
    "diam": f"""SELECT rel_osm_id,
        CASE WHEN r=0 THEN 0 ELSE CAST(round_even(2*sqrt({_area('cx', 'cy', 'r')}/pi()),0) AS INT) END AS diameter
      FROM circ""",
    "iroute": """SELECT rel.*, diameter, avg_distance FROM rel
      LEFT JOIN diam ON diam.rel_osm_id=rel.osm_id LEFT JOIN avgd ON avgd.rel_osm_id=rel.osm_id""",
    # --- stops
    "pair": """SELECT DISTINCT p.member_type AS osm_type, p.member_osm_id AS osm_id, r.ref, r.colour
      FROM posn p JOIN rel r ON r.osm_id=p.rel_osm_id""",
    "pairs": f"""SELECT osm_type, osm_id, string_agg({_txt('ref')}||'|'||{_txt('colour')}, ';'
        ORDER BY ref NULLS LAST, colour NULLS LAST) AS routes_ref_colour FROM pair GROUP BY osm_type, osm_id""",
    "stat": """SELECT t.*, pairs.routes_ref_colour FROM (
        SELECT p.member_type AS osm_type, p.member_osm_id AS osm_id, max(r.diameter) AS max_diameter,
          max(r.avg_distance) AS max_avg_distance, CAST(count(*) AS INT) AS number_of_routes
        FROM posn p JOIN iroute r ON r.osm_id=p.rel_osm_id
        SEMI JOIN stop s ON s.osm_type=p.member_type AND s.osm_id=p.member_osm_id GROUP BY p.member_type, p.member_osm_id) t
      JOIN pairs USING (osm_type, osm_id)""",
    "dstop": """SELECT s.*, max_diameter, max_avg_distance, number_of_routes, routes_ref_colour
      FROM stop s LEFT JOIN stat USING (osm_type, osm_id)""",
    "shield": """SELECT osm_type, osm_id, CAST(row_number() OVER (PARTITION BY osm_type, osm_id
        ORDER BY ref NULLS LAST, colour NULLS LAST) AS INT) AS i, ref,
        CASE WHEN colour IS NULL OR colour='' THEN 'gray' ELSE colour END AS colour
      FROM pair SEMI JOIN stop USING (osm_type, osm_id)""",
    "piece": """SELECT osm_id*2 AS sid, name AS key, lon AS lon1, lat AS lat1, lon AS lon2, lat AS lat2
      FROM fx_nodes_bus_stop WHERE name <> ''
      UNION ALL SELECT w.osm_id*2+1, w.name, s.lon1, s.lat1, s.lon2, s.lat2
      FROM fx_ways_bus_stop w JOIN wseg s ON s.way_id=w.osm_id WHERE w.name <> ''""",
    "slink": f"""SELECT a.sid AS a, b.sid AS b FROM piece a JOIN piece b
      ON a.key=b.key AND a.sid<>b.sid AND abs(a.lat1-b.lat1)<0.02 WHERE {_near('a', 'b')} <= 400""",
    "sreach": """SELECT osm_id*2+osm_type AS sid, osm_id*2+osm_type AS root FROM stop
      UNION SELECT l.b, r.root FROM sreach r JOIN slink l ON l.a=r.sid""",
    "cmem": """SELECT s.osm_type, s.osm_id, s.name, s.x, s.y, c.cluster FROM stop s
      JOIN (SELECT sid, min(root) AS cluster FROM sreach GROUP BY sid) c ON c.sid=s.osm_id*2+s.osm_type""",
    "clus": """SELECT cluster, name, string_agg(osm_type||'_'||osm_id, ',' ORDER BY osm_type, osm_id) AS osm_type_id,
        arg_min(osm_type||'_'||osm_id, osm_type*10000000000+osm_id) AS cluster_key,
        CAST(count(*) AS INT) AS n_stops, avg(x) AS x, avg(y) AS y FROM cmem GROUP BY cluster, name""",
    "cpair": """SELECT DISTINCT c.cluster, r.ref, r.colour FROM cmem c
      JOIN posn p ON p.member_type=c.osm_type AND p.member_osm_id=c.osm_id JOIN rel r ON r.osm_id=p.rel_osm_id""",
    "cstat": f"""SELECT t.*, u.routes_ref_colour FROM (
        SELECT c.cluster, max(r.diameter) AS max_diameter, max(r.avg_distance) AS max_avg_distance,
          CAST(count(*) AS INT) AS number_of_routes
        FROM cmem c JOIN posn p ON p.member_type=c.osm_type AND p.member_osm_id=c.osm_id
        JOIN iroute r ON r.osm_id=p.rel_osm_id GROUP BY c.cluster) t
      JOIN (SELECT cluster, string_agg({_txt('ref')}||'|'||{_txt('colour')}, ';'
          ORDER BY ref NULLS LAST, colour NULLS LAST) AS routes_ref_colour FROM cpair GROUP BY cluster) u USING (cluster)""",
    "dclus": """SELECT c.*, max_diameter, max_avg_distance, number_of_routes, routes_ref_colour
      FROM clus c LEFT JOIN cstat USING (cluster)""",
    # --- connections
    "conn": """SELECT DISTINCT p.rel_osm_id AS route_osm_id, p.member_osm_id AS stop_osm_id,
        p.member_type AS stop_osm_type, p.member_index AS stop_index, s.name AS stop_name, p.lon, p.lat,
        r.osm_id AS id, r.ref, r.colour
      FROM posn p JOIN rel o ON o.osm_id=p.rel_osm_id JOIN stop s ON s.osm_id=p.member_osm_id
      LEFT JOIN posn q ON q.member_type=p.member_type AND q.member_osm_id=p.member_osm_id
        AND q.rel_osm_id<>p.rel_osm_id
      LEFT JOIN rel r ON r.osm_id=q.rel_osm_id""",
    # --- segments
    "wused": """SELECT DISTINCT l.geom, p.rel_osm_id FROM path p JOIN wline l USING (way_id)
      JOIN rel r ON r.osm_id=p.rel_osm_id""",
    "wset": """SELECT geom, max(diameter) AS max_diameter, CAST(count(*) AS INT) AS number_of_routes,
        string_agg(rel_osm_id, ',' ORDER BY rel_osm_id) AS rels
      FROM wused JOIN iroute r ON r.osm_id=rel_osm_id GROUP BY geom""",
    "drawn": """SELECT *, CAST(round(a[1]*1e7) AS BIGINT) AS ax, CAST(round(a[2]*1e7) AS BIGINT) AS ay,
        CAST(round(b[1]*1e7) AS BIGINT) AS bx, CAST(round(b[2]*1e7) AS BIGINT) AS by_ FROM (
      SELECT DISTINCT rels, max_diameter, number_of_routes,
        least((s.lon1,s.lat1),(s.lon2,s.lat2)) AS a, greatest((s.lon1,s.lat1),(s.lon2,s.lat2)) AS b
      FROM (SELECT rels, max_diameter, number_of_routes, min(way_id) AS way_id
        FROM wset JOIN wline USING (geom) GROUP BY rels, max_diameter, number_of_routes, geom) w
      JOIN wseg s USING (way_id)) t""",
    # every pair of edges of a route set: which ends lie on the other edge, and where they cross
    "contact": """SELECT *, sign(sa)*sign(sb)<0 AND sign(sc)*sign(sd)<0 AS crossed,
        (round(c[1]+(d[1]-c[1])*(sc::DOUBLE/(sc::DOUBLE-sd)),9), round(c[2]+(d[2]-c[2])*(sc::DOUBLE/(sc::DOUBLE-sd)),9)) AS spot
      FROM (SELECT e.rels, e.a, e.b, f.a AS c, f.b AS d,
        (e.bx-e.ax)*(f.ay-e.ay)-(e.by_-e.ay)*(f.ax-e.ax) AS sc,
        (e.bx-e.ax)*(f.by_-e.ay)-(e.by_-e.ay)*(f.bx-e.ax) AS sd,
        (f.bx-f.ax)*(e.ay-f.ay)-(f.by_-f.ay)*(e.ax-f.ax) AS sa, (f.bx-f.ax)*(e.by_-f.ay)-(f.by_-f.ay)*(e.bx-f.ax) AS sb,
        e.ax, e.ay, e.bx, e.by_, f.ax AS cx, f.ay AS cy, f.bx AS dx, f.by_ AS dy
      FROM drawn e JOIN drawn f ON e.rels=f.rels AND (e.a,e.b)<(f.a,f.b) AND least(e.ax,e.bx)<=greatest(f.ax,f.bx)
        AND least(f.ax,f.bx)<=greatest(e.ax,e.bx) AND least(e.ay,e.by_)<=greatest(f.ay,f.by_)
        AND least(f.ay,f.by_)<=greatest(e.ay,e.by_)) t""",
    "cut": """SELECT rels, a, b, c AS p FROM contact WHERE sc=0 AND cx BETWEEN least(ax,bx) AND greatest(ax,bx)
        AND cy BETWEEN least(ay,by_) AND greatest(ay,by_)
      UNION SELECT rels, a, b, d FROM contact WHERE sd=0 AND dx BETWEEN least(ax,bx) AND greatest(ax,bx)
        AND dy BETWEEN least(ay,by_) AND greatest(ay,by_)
      UNION SELECT rels, c, d, a FROM contact WHERE sa=0 AND ax BETWEEN least(cx,dx) AND greatest(cx,dx)
        AND ay BETWEEN least(cy,dy) AND greatest(cy,dy)
      UNION SELECT rels, c, d, b FROM contact WHERE sb=0 AND bx BETWEEN least(cx,dx) AND greatest(cx,dx)
        AND by_ BETWEEN least(cy,dy) AND greatest(cy,dy)
      UNION SELECT rels, a, b, spot FROM contact WHERE crossed UNION SELECT rels, c, d, spot FROM contact WHERE crossed
      UNION SELECT rels, a, b, a FROM drawn UNION SELECT rels, a, b, b FROM drawn""",
    "edge": f"""SELECT *, row_number() OVER () AS eid, sqrt(({_mx('b[1]')}-{_mx('a[1]')})**2+({_my('b[2]')}-{_my('a[2]')})**2) AS len FROM (
      SELECT DISTINCT rels, max_diameter, number_of_routes, least(p,q) AS a, greatest(p,q) AS b FROM (
        SELECT rels, p, lead(p) OVER (PARTITION BY rels, a, b ORDER BY (p[1]-a[1])*(b[1]-a[1])+(p[2]-a[2])*(b[2]-a[2])) AS q FROM cut) c
      JOIN (SELECT DISTINCT rels, max_diameter, number_of_routes FROM wset) w USING (rels) WHERE q IS NOT NULL AND p<>q) t""",
    "elink": """SELECT min(eid) AS a, max(eid) AS b FROM (
        SELECT rels, a AS v, eid FROM edge UNION ALL SELECT rels, b, eid FROM edge) t
      GROUP BY rels, v HAVING count(*)=2""",
    "ereach": """SELECT eid, eid AS root FROM edge
      UNION SELECT l.other, r.root FROM ereach r
      JOIN (SELECT a AS eid, b AS other FROM elink UNION ALL SELECT b, a FROM elink) l ON l.eid=r.eid""",
    "sgm": f"""SELECT root, any_value(rels) AS rels, any_value(max_diameter) AS max_diameter,
        any_value(number_of_routes) AS number_of_routes, CAST(count(*) AS INT) AS n_edges, sum(len) AS length,
        min(least(a,b)) AS low, min({_mx('a[1]')}) AS xmin, max({_mx('b[1]')}) AS xmax,
        min(least({_my('a[2]')},{_my('b[2]')})) AS ymin, max(greatest({_my('a[2]')},{_my('b[2]')})) AS ymax
      FROM edge JOIN (SELECT eid, min(root) AS root FROM ereach GROUP BY eid) USING (eid) GROUP BY root""",
    # each line walked from its smaller end (a loop's junction, a ring's least vertex), to the smaller neighbour first
    "half": """SELECT e.rels, r.root, e.u, e.v, count(*) OVER (PARTITION BY e.rels, e.u) AS degree, count(*) OVER (PARTITION BY r.root) AS n2
      FROM (SELECT rels, eid, a AS u, b AS v FROM edge UNION ALL SELECT rels, eid, b, a FROM edge) e
      JOIN (SELECT eid, min(root) AS root FROM ereach GROUP BY eid) r USING (eid)""",
    "walk": """SELECT root, CAST(n2//2 AS INT) AS n, CAST(1 AS INT) AS i, u AS before, v AS here, [u, v] AS path FROM half
      QUALIFY row_number() OVER (PARTITION BY root ORDER BY degree=2, u, v)=1
      UNION ALL SELECT w.root, w.n, CAST(w.i+1 AS INT), w.here, h.v, list_append(w.path, h.v) FROM walk w
      JOIN half h ON h.root=w.root AND h.u=w.here AND h.v<>w.before WHERE w.i<w.n""",
    # --- projection
    "foot": f"""SELECT p.rel_osm_id, p.member_type, p.member_osm_id, p.member_index, w.member_index AS way_index,
        p.lon, p.lat, p.x, p.y, s.ax, s.ay, s.bx, s.by_,
        greatest(0.0,least(1.0,((p.x-s.ax)*(s.bx-s.ax)+(p.y-s.ay)*(s.by_-s.ay))/(s.len*s.len))) AS t
      FROM posn p JOIN path w ON w.rel_osm_id=p.rel_osm_id JOIN wseg s ON s.way_id=w.way_id""",
    "proj": f"""SELECT *, round(sqrt(({_lon('fx')}-lon)**2+({_lat('fy')}-lat)**2),9) AS dist FROM (
        SELECT *, ax+(bx-ax)*t AS fx, ay+(by_-ay)*t AS fy FROM foot
        QUALIFY row_number() OVER (PARTITION BY rel_osm_id, member_type, member_osm_id, member_index, way_index
          ORDER BY (ax+(bx-ax)*t-x)**2+(ay+(by_-ay)*t-y)**2, ax+(bx-ax)*t, ay+(by_-ay)*t)=1) u""",
    "best": """SELECT rel_osm_id, stop_key, dist, round(fx,3)+0.0 AS x, round(fy,3)+0.0 AS y FROM (
        SELECT p.*, coalesce(s.name, p.member_type||'_'||p.member_osm_id) AS stop_key FROM proj p
        JOIN rel r ON r.osm_id=p.rel_osm_id
        LEFT JOIN stop s ON s.osm_type=p.member_type AND s.osm_id=p.member_osm_id WHERE dist < 20) t
      QUALIFY row_number() OVER (PARTITION BY rel_osm_id, stop_key ORDER BY dist, member_index, way_index)=1""",
    "rpos": "SELECT DISTINCT rel_osm_id AS route_osm_id, x, y FROM best",
    # --- stations
    "station": """SELECT 0 AS osm_type, osm_id, name, 'ST_Point' AS geom_type, CAST(NULL AS BIGINT) AS way_id, lon, lat FROM fx_nodes_bus_station
      UNION ALL SELECT 1, osm_id, name, geom_type, CASE WHEN osm_id<0 THEN -osm_id ELSE osm_id END, NULL, NULL
      FROM fx_ways_bus_station""",
    # rings of a station under its own way id; holes count as less, whichever way round they run
    "rsize": """SELECT s.way_id AS own, abs(sum((s.ax-o.x)*(s.by_-o.y)-(s.bx-o.x)*(s.ay-o.y))/2)*CASE WHEN s.way_id//1000000000000000=5 THEN -1 ELSE 1 END AS size
      FROM wseg s JOIN vtx o ON o.way_id=s.way_id AND o.pos=0 WHERE s.way_id//1000000000000000 IN (2, 5, 6) GROUP BY s.way_id""",
    "ring": """SELECT s.way_id, s.pos, s.ax-o.x AS ax, s.ay-o.y AS ay, s.bx-o.x AS bx, s.by_-o.y AS by_, o.x AS ox, o.y AS oy
      FROM wseg s JOIN vtx o ON o.way_id=s.way_id AND o.pos=0 WHERE s.way_id//1000000000000000 IN (2, 5, 6)""",
    "rone": """SELECT way_id AS own, any_value(ox)+sum((ax+bx)*(ax*by_-bx*ay))/(3*sum(ax*by_-bx*ay)) AS x,
        any_value(oy)+sum((ay+by_)*(ax*by_-bx*ay))/(3*sum(ax*by_-bx*ay)) AS y FROM ring GROUP BY way_id""",
    "rcen": """SELECT 2000000000000000+own%1000000000000000 AS way_id, sum(x*size)/sum(size) AS x, sum(y*size)/sum(size) AS y
      FROM rone JOIN rsize USING (own) GROUP BY 1""",
    "dstation": f"""SELECT s.osm_type, s.osm_id, s.name, s.geom_type='ST_Polygon' AS has_polygon,
        coalesce(c.x, {_mx('s.lon')}) AS x, coalesce(c.y, {_my('s.lat')}) AS y
      FROM station s LEFT JOIN rcen c ON c.way_id=s.way_id""",
    "area": "SELECT s.osm_type, s.osm_id, s.name, s.way_id FROM station s WHERE geom_type='ST_Polygon'",
    "atstop": """SELECT s.osm_id, s.osm_type, r.osm_id AS rel_osm_id, r.transport_mode, r.network AS rel_network,
        r.operator AS rel_operator, r.ref AS rel_ref, r.origin AS rel_origin, r.destination AS rel_destination,
        r.colour AS rel_colour, r.name AS rel_name
      FROM stop s JOIN posn p ON p.member_type=s.osm_type AND p.member_osm_id=s.osm_id
      JOIN rel r ON r.osm_id=p.rel_osm_id""",
    # --- document parts
    "shl": f"""SELECT route_osm_id, stop_osm_id, stop_osm_type, stop_index, stop_name, lon, lat,
        coalesce(string_agg(ref||'/'||{_txt('colour')}, '+' ORDER BY ref, colour NULLS LAST, id)
          FILTER (WHERE ref <> ''), '') AS shields
      FROM conn GROUP BY ALL""",
    "slist": f"""SELECT route_osm_id AS osm_id, string_agg(
        {_txt('stop_name')}||'@'||{_spot('lon', 'lat')}||'@'||
        CASE stop_osm_type WHEN 0 THEN 'node/' WHEN 1 THEN 'way/' ELSE 'relation/' END||stop_osm_id||'@'||shields,
        ';' ORDER BY stop_index, stop_osm_type, stop_osm_id, stop_name NULLS FIRST) AS stop_list
      FROM shl GROUP BY route_osm_id""",
    "plist": f"""SELECT route_osm_id AS osm_id, string_agg(CAST(round({_lon('x')}*1e6) AS BIGINT)||' '||
        CAST(round({_lat('y')}*1e6) AS BIGINT), ',' ORDER BY x, y) AS stop_positions FROM rpos GROUP BY route_osm_id""",
    "rgeo": """SELECT p.rel_osm_id AS osm_id, string_agg(l.geom, ';' ORDER BY p.member_index) AS geometry
      FROM path p JOIN wline l USING (way_id) GROUP BY p.rel_osm_id""",
    "rlist": f"""SELECT osm_type, osm_id, string_agg(rel_osm_id||'|'||{_txt('rel_ref')}||'|'||{_txt('rel_name')}||'|'||
        {_txt('rel_network')}||'|'||{_txt('rel_operator')}||'|'||{_txt('transport_mode')}||'|'||{_txt('rel_origin')}||'|'||
        {_txt('rel_destination')}||'|'||{_txt('rel_colour')}, ';' ORDER BY rel_ref NULLS LAST, rel_osm_id) AS routes_at_stop
      FROM atstop GROUP BY osm_type, osm_id""",
}

_RECURSIVE = {"sreach", "ereach", "walk"}


def _statement(select: str) -> str:
    """Prefix a SELECT with the views it names, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b\w+\b", text)):
            if word in VIEWS and word not in needed:
                needed.add(word)
                visit(VIEWS[word])

    visit(select)
    parts = [
        f"{name} AS {'' if name in _RECURSIVE else 'MATERIALIZED '}({sql})"
        for name, sql in VIEWS.items()
        if name in needed
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def _tiles(
    source: str, columns: str, zooms: range, order: str, limit: int, buffer: int = 0,
    box: tuple[str, str, str, str] = ("x", "y", "x", "y"), where: str = "true",
) -> str:
    size = f"(2*{_HALF}/(1<<z))"
    grow = f"({size}*{buffer}/256.0)"

    def cell(v: str) -> str:
        return f"CAST(floor(({v})/{size}) AS INT)"

    xmin, ymin, xmax, ymax = box
    lo_hi = [
        f"greatest(0,{cell(f'{xmin}-{grow}+{_HALF}')}) AS x0",
        f"least((1<<z)-1,{cell(f'{xmax}+{grow}+{_HALF}')}) AS x1",
        f"greatest(0,{cell(f'{_HALF}-{ymax}-{grow}')}) AS y0",
        f"least((1<<z)-1,{cell(f'{_HALF}-{ymin}+{grow}')}) AS y1",
    ]
    return f"""SELECT z, x_tile, y_tile, rank, {columns} FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY z, x_tile, y_tile ORDER BY {order}) AS INT) AS rank FROM (
        SELECT *, unnest(range(y0, y1+1))::INT AS y_tile FROM (
          SELECT *, unnest(range(x0, x1+1))::INT AS x_tile FROM (
            SELECT s.*, z, {', '.join(lo_hi)} FROM (SELECT * FROM {source} WHERE {where}) s
            CROSS JOIN (SELECT CAST(range AS INT) AS z FROM range({zooms.start},{zooms.stop})) zz) a) b) c) d
      WHERE rank <= {limit}"""


def _nano(p: str) -> str:
    return f"CAST(round({p}[1]*1e9) AS BIGINT)||' '||CAST(round({p}[2]*1e9) AS BIGINT)"


_SEGMENT = "low[1] AS low_lon, low[2] AS low_lat"
_LONGEST = f"round(length,3) DESC, round({_mx('low[1]')},3), round({_my('low[2]')},3)"
_SEGMENT_BOX = ("xmin", "ymin", "xmax", "ymax")

_SELECTS: dict[str, str] = {
    "feat_bus_stops": f"""SELECT 0 AS osm_type, osm_id, name, {_FLAGS}, local_ref, highway, public_transport,
        {_spot('lon', 'lat')} AS geom FROM fx_nodes_bus_stop
      UNION ALL SELECT 1, osm_id, name, {_FLAGS}, local_ref, highway, public_transport, geom
      FROM fx_ways_bus_stop JOIN wline ON way_id=osm_id""",
    "feat_bus_stations": f"""SELECT 0 AS osm_type, osm_id, name, 'ST_Point' AS geom_type, {_spot('lon', 'lat')} AS geom
      FROM fx_nodes_bus_station
      UNION ALL SELECT 1, osm_id, name, geom_type, geom FROM fx_ways_bus_station JOIN wline ON way_id=abs(osm_id)""",
    "feat_routes": "SELECT * FROM fx_relations_route",
    "feat_route_members": f"""SELECT m.rel_osm_id, m.member_osm_id, m.member_index, m.member_role, m.member_type,
        CASE WHEN m.member_type=0 THEN {_spot('n.lon', 'n.lat')} ELSE l.geom END AS geom
      FROM fx_relation_members_route m
      LEFT JOIN fx_nodes_bus_stop n ON m.member_type=0 AND n.osm_id=m.member_osm_id
      LEFT JOIN wline l ON m.member_type=1 AND l.way_id=m.member_osm_id""",
    "way_lines": "SELECT way_id, geom FROM wline",
    "route_ids_abs": "SELECT osm_id, name FROM rel",
    "stop_role_members": "SELECT rel_osm_id, member_index, member_role FROM mem WHERE member_role LIKE '%stop%'",
    "stop_spacing": "SELECT rel_osm_id, member_index, round(distance,3) AS distance FROM spc",
    "route_avg_distance": "SELECT rel_osm_id, avg_distance FROM avgd",
    "route_diameter": "SELECT rel_osm_id, diameter FROM diam",
    "routes_internal": "SELECT * FROM iroute",
    "stops_union": f"""SELECT osm_type, osm_id, id, name, {_FLAGS}, local_ref, round(x,3) AS x, round(y,3) AS y FROM stop""",
    "stop_cluster_members": """SELECT m.osm_type, m.osm_id, m.name, c.cluster_key FROM cmem m
      JOIN clus c ON c.cluster=m.cluster""",
    "stop_clusters": "SELECT osm_type_id, name, n_stops, round(x,3) AS x, round(y,3) AS y FROM clus",
    "stations_union": """SELECT s.osm_type, s.osm_id, s.name, s.geom_type,
        coalesce(l.geom, CAST(round(s.lon*1e7) AS BIGINT)||' '||CAST(round(s.lat*1e7) AS BIGINT)) AS geom
      FROM station s LEFT JOIN wline l ON l.way_id=s.way_id""",
    "route_ways": """SELECT p.rel_osm_id, p.member_index AS index, l.geom FROM path p LEFT JOIN wline l USING (way_id)""",
    "route_positions": """SELECT rel_osm_id, member_type, member_osm_id, member_index, round(x,3) AS x, round(y,3) AS y FROM posn""",
    "route_paths": f"SELECT {_ROUTE}, geometry AS geom FROM rel LEFT JOIN rgeo USING (osm_id)",
    "segment_route_sets": "SELECT geom, max_diameter, number_of_routes, u.rel_osm_id FROM wset JOIN wused u USING (geom)",
    "segments_merged": f"""SELECT max_diameter, number_of_routes, n_edges, round(length,3) AS length, {_SEGMENT},
        n_edges+1 AS n_vertices, array_to_string(list_transform(path, lambda p: {_nano('p')}), ',') AS vertices
      FROM sgm JOIN walk USING (root) WHERE i=n""",
    "segment_vertices": f"""SELECT CAST(unnest(range(len(path))) AS INT) AS pos,
        unnest(list_transform(path, lambda p: {_nano('p')})) AS spot FROM walk WHERE i=n""",
    "segments_by_route": f"""SELECT CAST(r AS BIGINT) AS rel_osm_id, CAST(count(*) AS INT) AS n_segments,
        string_agg(CAST(round(low[1]*1e7) AS BIGINT)||' '||CAST(round(low[2]*1e7) AS BIGINT), ',' ORDER BY low) AS segments
      FROM (SELECT low, unnest(string_split(rels, ',')) AS r FROM sgm) t GROUP BY r""",
    "stop_projection": """SELECT rel_osm_id, member_type, member_osm_id, member_index, way_index,
        dist, round(fx,3) AS x, round(fy,3) AS y FROM proj WHERE dist < 20""",
    "stop_projection_metres": f"""SELECT rel_osm_id, member_type, member_osm_id, member_index, way_index,
        dist, round(fx,3) AS x, round(fy,3) AS y FROM proj
      WHERE {_andoyer('lon', 'lat', _lon('fx'), _lat('fy'))} < 20
      QUALIFY row_number() OVER (PARTITION BY rel_osm_id, member_type, member_osm_id, member_index ORDER BY dist, way_index)=1""",
    "best_projection": "SELECT rel_osm_id, stop_key, dist, x, y FROM best",
    "route_position_points": "SELECT x, y, CAST(count(*) AS INT) AS number_of_routes FROM rpos GROUP BY x, y",
    "positions_by_route": """SELECT route_osm_id AS rel_osm_id, CAST(count(*) AS INT) AS n_positions,
        string_agg(CAST(round(x*1000) AS BIGINT)||' '||CAST(round(y*1000) AS BIGINT), ',' ORDER BY x, y) AS positions
      FROM rpos GROUP BY route_osm_id""",
    "route_stop_positions": "SELECT route_osm_id, x, y FROM rpos",
    "route_stop_connections": f"""SELECT route_osm_id, stop_osm_id, stop_osm_type, stop_index, stop_name,
        string_agg({_txt('CAST(id AS VARCHAR)')}||'|'||{_txt('ref')}||'|'||{_txt('colour')}, ';' ORDER BY ref NULLS LAST, colour NULLS LAST, id) AS other_routes_at_stop
      FROM conn GROUP BY route_osm_id, stop_osm_id, stop_osm_type, stop_index, stop_name, lon, lat""",
    "stop_routes": """SELECT DISTINCT p.member_type, p.member_osm_id, p.rel_osm_id, r.osm_id AS id, r.ref, r.colour
      FROM posn p LEFT JOIN rel r ON r.osm_id=p.rel_osm_id""",
    "stop_stats": "SELECT osm_type, osm_id, max_diameter, max_avg_distance, number_of_routes, routes_ref_colour FROM stat",
    "stop_colours": "SELECT osm_type, osm_id, ref, colour FROM pair SEMI JOIN stop USING (osm_type, osm_id)",
    "stops_enriched": f"""SELECT osm_type, osm_id, id, name, {_FLAGS}, local_ref, max_diameter, max_avg_distance,
        number_of_routes FROM dstop""",
    "cluster_stats": """SELECT osm_type_id, name, max_diameter, max_avg_distance, number_of_routes, routes_ref_colour FROM dclus""",
    "stop_shields": "SELECT osm_type, osm_id, i, ref, colour FROM shield",
    "stations": "SELECT osm_type, osm_id, name, has_polygon, round(x,3) AS x, round(y,3) AS y FROM dstation",
    "stations_area": """SELECT a.osm_type, a.osm_id, a.name, l.geom, coalesce(h.geom, '') AS holes
      FROM area a JOIN wline l USING (way_id) LEFT JOIN wline h ON h.way_id=a.way_id+3000000000000000""",
    "routes_at_stop": "SELECT * FROM atstop",
    "route_properties": f"SELECT {_ROUTE} FROM rel",
    "route_geometry": "SELECT osm_id, geometry FROM rel LEFT JOIN rgeo USING (osm_id)",
    "route_position_list": "SELECT osm_id, stop_positions FROM plist",
    "route_stop_list": "SELECT osm_id, stop_list FROM slist",
    "route_document": f"""SELECT r.osm_id, {', '.join(f'r.{c}' for c in _ROUTE.split(', ')[1:])},
    coalesce(p.stop_positions, '') AS stop_positions, coalesce(s.stop_list, '') AS stop_list, g.geometry
  FROM rel r LEFT JOIN plist p ON p.osm_id=r.osm_id LEFT JOIN slist s ON s.osm_id=r.osm_id
  LEFT JOIN rgeo g ON g.osm_id=r.osm_id""",
    "stop_attributes": f"""SELECT osm_type, osm_id, name, local_ref, {_FLAGS}, round(lon,7) AS lon, round(lat,7) AS lat FROM stop""",
    "stop_routes_list": "SELECT osm_type, osm_id, routes_at_stop FROM rlist",
    "stop_document": f"""SELECT s.osm_type, s.osm_id, CASE s.osm_type WHEN 0 THEN 'node' WHEN 1 THEN 'way' END AS word,
        s.name, s.local_ref, {_FLAGS}, {_spot('s.lon', 's.lat')} AS spot, coalesce(l.routes_at_stop, '') AS routes_at_stop
      FROM stop s LEFT JOIN rlist l ON l.osm_type=s.osm_type AND l.osm_id=s.osm_id""",
    "display_defaults": "SELECT osm_id, " + ", ".join(
        f"coalesce(nullif({c},''),'{d}') AS {c}" for c, d in
        [(c, "??") for c in ("name", "ref", "network", "origin", "destination", "operator")] + [("colour", "grey")]
    ) + " FROM rel",
    "stop_badges": """SELECT osm_type, osm_id, coalesce(nullif(name,''),'pas de nom :(') AS name,
        concat_ws(',', CASE WHEN has_shelter AND has_bench THEN 'shelter_bench' WHEN has_shelter THEN 'shelter'
          WHEN has_bench THEN 'bench' END, CASE WHEN has_departures_board THEN 'departures' END,
          CASE WHEN is_wheelchair_ok THEN 'wheelchair' END, CASE WHEN has_tactile_paving THEN 'tactile' END) AS badges
      FROM stop""",
    "id_lists": """SELECT 'stop' AS kind, CAST(osm_id AS VARCHAR) AS id FROM stop
      UNION ALL SELECT 'route', CAST(osm_id AS VARCHAR) FROM rel""",
    "document_keys": """SELECT 'stop' AS kind, CASE osm_type WHEN 0 THEN 'node' ELSE 'way' END||'/'||osm_id AS key FROM stop
      UNION ALL SELECT 'route', CAST(osm_id AS VARCHAR) FROM rel""",
    "tile_stops_z11_13": _tiles("dclus", "osm_type_id, max_avg_distance", range(11, 14),
                                "max_avg_distance NULLS LAST, cluster_key", 999),
    "tile_stops_z14": _tiles("dstop", "osm_type, osm_id, number_of_routes", range(14, 17),
                             "number_of_routes NULLS LAST, osm_type, osm_id", 999),
    "tile_shields": _tiles("(SELECT h.*, s.x, s.y FROM shield h JOIN stop s USING (osm_type, osm_id))",
                           "osm_type, osm_id, i, ref, colour", range(14, 17), "osm_type, osm_id, i", 1000),
    "tile_stations": _tiles("dstation", "name, has_polygon", range(6, 17), "osm_type, osm_id", 1000),
    "tile_payload": f"""SELECT 'stations' AS layer, z, x_tile, y_tile, CAST(count(*) AS INT) AS n, string_agg(rank||'|'||
        CAST(floor(((x+{_HALF})/(2*{_HALF}/(1<<z))-x_tile)*256) AS INT)||' '||CAST(floor((({_HALF}-y)/(2*{_HALF}/(1<<z))-y_tile)*256) AS INT)||'|'||
        to_json(struct_pack(name:=name, has_polygon:=has_polygon)), ';' ORDER BY rank) AS features
      FROM ({_tiles("dstation", "x, y, name, has_polygon", range(6, 17), "osm_type, osm_id", 1000)}) t
      WHERE z IN (6, 12, 14, 16) GROUP BY z, x_tile, y_tile""",
    "tile_station_areas": _tiles(
        "(SELECT a.*, b.* EXCLUDE (way_id) FROM area a JOIN (SELECT way_id, min(x) AS xmin, min(y) AS ymin,"
        " max(x) AS xmax, max(y) AS ymax FROM vtx GROUP BY way_id) b USING (way_id))",
        "name", range(13, 17), "osm_type, osm_id", 1000, 1, _SEGMENT_BOX),
    "tile_ways_z11": _tiles("sgm", f"number_of_routes, round(length,3) AS length, {_SEGMENT}", range(11, 12),
                            _LONGEST, 999, 2, _SEGMENT_BOX, "max_diameter > 6000 OR number_of_routes > 1"),
    "tile_ways_z12": _tiles("sgm", f"number_of_routes, round(length,3) AS length, {_SEGMENT}", range(12, 17),
                            _LONGEST, 999, 2, _SEGMENT_BOX),
    "tile_positions": _tiles("(SELECT DISTINCT x, y FROM rpos)", "x, y", range(14, 17), "x, y", 1000),
}


# integers that may be NULL are compared as doubles
_NULLABLE = {
    "route_avg_distance": ["avg_distance"],
    "route_diameter": ["diameter"],
    "routes_internal": ["diameter", "avg_distance"],
    "segment_route_sets": ["max_diameter", "number_of_routes"],
    "segments_merged": ["max_diameter", "number_of_routes"],
    "route_position_points": ["number_of_routes"],
    "stop_stats": ["max_diameter", "max_avg_distance", "number_of_routes"],
    "stops_enriched": ["max_diameter", "max_avg_distance", "number_of_routes"],
    "cluster_stats": ["max_diameter", "max_avg_distance", "number_of_routes"],
    "tile_stops_z11_13": ["max_avg_distance"],
    "tile_stops_z14": ["number_of_routes"],
    "tile_ways_z11": ["number_of_routes"],
    "tile_ways_z12": ["number_of_routes"],
}


def _select(name: str) -> str:
    if name not in _NULLABLE:
        return _SELECTS[name]
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NULLABLE[name])
    return f"SELECT * REPLACE ({casts}) FROM ({_SELECTS[name]}) result"


def oracle_sql() -> dict[str, str]:
    return {name: _statement(_select(name)) for name in _SELECTS}
