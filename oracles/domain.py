"""The stand-in domain tables as SQL, and helpers to compose oracle texts."""

from __future__ import annotations

RAD = "0.017453292519943295e0"
A, E2 = "6378137.0e0", "0.0066943799901413165e0"
AS_OF = "DATE '2001-06-30'"


def lon(k: str) -> str:
    return f"(126.6e0 + 0.6e0 * CAST((({k}) * 7919) % 10007 AS DOUBLE) / 10007.0e0)"


def lat(k: str) -> str:
    return f"(37.3e0 + 0.4e0 * CAST((({k}) * 104729) % 10009 AS DOUBLE) / 10009.0e0)"


def kx(phi: str) -> str:
    """Metres per degree of longitude."""
    s = f"sin(({phi}) * {RAD})"
    return f"({A} / sqrt(1.0e0 - {E2} * {s} * {s}) * cos(({phi}) * {RAD}) * {RAD})"


def ky(phi: str) -> str:
    """Metres per degree of latitude."""
    s = f"sin(({phi}) * {RAD})"
    return f"({A} / sqrt(1.0e0 - {E2} * {s} * {s}) * (1.0e0 - {E2}) / (1.0e0 - {E2} * {s} * {s}) * {RAD})"


def dist(x1: str, y1: str, x2: str, y2: str) -> str:
    m = f"(({y1} + {y2}) / 2.0e0)"
    dx, dy = f"(({x2} - {x1}) * {kx(m)})", f"(({y2} - {y1}) * {ky(m)})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def even(x: str, digits: int) -> str:
    """Half-even rounding on doubles."""
    p = f"{10**digits}.0e0"
    return f"(round_even(CAST(({x}) AS DOUBLE) * {p}, 0) / {p})" if digits else f"round_even(CAST(({x}) AS DOUBLE), 0)"


def price3(x: str) -> str:
    """Display rounding of mean prices, border just below the half."""
    return f"(floor(({x}) * 1000e0 + 0.500001e0) / 1000e0)"


def up(x: str) -> str:
    """Half-up to BIGINT for non-negative values."""
    return f"CAST(floor(CAST(({x}) AS DOUBLE) + 0.5e0) AS BIGINT)"


def clip(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def months(start: str, n: str) -> str:
    return f"CAST({start} + to_months(CAST({n} AS INTEGER)) AS DATE)"


SIGUNGU = "concat('1', n_regionkey, lpad(CAST(n_nationkey AS VARCHAR), 3, '0'))"

VIEWS: dict[str, str] = {
    "nations": f"SELECT CAST(n_nationkey AS BIGINT) AS n, n_name, n_regionkey, {SIGUNGU} AS sigungu FROM nation",
    "admin_areas": f"""
        SELECT concat('1', r_regionkey) AS code, r_name AS name, 'sido' AS level, CAST(NULL AS VARCHAR) AS parent_code,
               {lon('CAST(r_regionkey AS BIGINT) + 100')} AS lon, {lat('CAST(r_regionkey AS BIGINT) + 100')} AS lat FROM region
        UNION ALL
        SELECT sigungu, n_name, 'sigungu', concat('1', n_regionkey), {lon('n + 500')}, {lat('n + 500')} FROM nations
        UNION ALL
        SELECT concat(sigungu, lpad(CAST(slot AS VARCHAR), 5, '0')), concat(n_name, '-', slot), 'eupmyeondong', sigungu,
               {lon('n * 8 + slot + 3000')}, {lat('n * 8 + slot + 3000')}
        FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS n, c_custkey % 8 AS slot FROM customer) JOIN nations USING (n)""",
    "projects": f"""
        SELECT n AS id, concat('Project ', n_name) AS name,
               ['public_housing','urban_development','industrial_complex','logistics','new_town','other'][n % 6 + 1] AS project_type,
               sigungu AS region_code, {lon('n + 500')} AS lon, {lat('n + 500')} AS lat,
               0.008e0 + 0.001e0 * CAST(n % 5 AS DOUBLE) AS half,
               CAST((n % 5 + 8) * 40 AS DOUBLE) AS area_ha, CAST((n + 1) * 10 AS DOUBLE) AS expected_compensation_billion_krw,
               {months("DATE '1995-06-01'", 'n')} AS planned_announcement_date,
               {months("DATE '1995-06-01'", 'n + 72')} AS planned_completion_date
        FROM nations""",
    "project_edges": """
        SELECT id AS project_id, lon + half * a AS x1, lat + half * b AS y1, lon + half * c AS x2, lat + half * d AS y2
        FROM projects, (VALUES (-1.0e0,-1.0e0,1.0e0,-1.0e0),(1.0e0,-1.0e0,1.0e0,1.0e0),
                               (1.0e0,1.0e0,-1.0e0,1.0e0),(-1.0e0,1.0e0,-1.0e0,-1.0e0)) v(a,b,c,d)""",
    "split_edges": """
        SELECT id AS project_id, lon + half * east + half * (a * size) AS x1, lat + half * (b * size) AS y1,
               lon + half * east + half * (c * size) AS x2, lat + half * (d * size) AS y2
        FROM projects, (VALUES (0e0, 1e0), (0e0, 0.5e0), (4e0, 0.25e0)) r(east, size),
             (VALUES (-1.0e0,-1.0e0,1.0e0,-1.0e0),(1.0e0,-1.0e0,1.0e0,1.0e0),
                     (1.0e0,1.0e0,-1.0e0,1.0e0),(-1.0e0,1.0e0,-1.0e0,-1.0e0)) v(a,b,c,d)""",
    "project_stages": f"""
        SELECT n AS project_id, stage, {months("DATE '1995-06-01'", 'n + m')} AS occurred_at, q AS sequence_no
        FROM nations, (VALUES ('announced',0,1),('designated',6,2),('compensation_started',18,3)) v(stage,m,q)
        WHERE NOT (stage = 'compensation_started' AND n % 6 = 5)""",
    "anchors": """
        SELECT p.id AS project_id, p.name, p.project_type, coalesce(min(s.occurred_at), any_value(p.planned_announcement_date)) AS anchor_date
        FROM projects p LEFT JOIN project_stages s ON s.project_id = p.id AND s.stage = 'compensation_started'
        GROUP BY ALL""",
    "suppliers": "SELECT s_suppkey AS s, s_name, sigungu FROM supplier JOIN nations ON n = s_nationkey",
    "land_transactions": f"""
        SELECT sha1(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))) AS source_id,
               sigungu AS region_code,
               {lon('l_orderkey * 7 + l_linenumber + l_partkey * 13')} AS lon,
               {lat('l_orderkey * 7 + l_linenumber + l_partkey * 13')} AS lat,
               'land' AS transaction_type, CAST(l_shipdate AS DATE) AS contract_date,
               CAST(floor(l_extendedprice * 1000 + 0.5e0) AS BIGINT) AS deal_amount_krw,
               l_quantity * 10 AS area_m2
        FROM lineitem JOIN suppliers ON s = l_suppkey""",
    "road_segments": f"""
        SELECT s AS id, s_name AS name,
               CASE WHEN s % 5 < 4 THEN concat(['고속도로','국도','지방도','시도'][s % 5 + 1], s) END AS route_no,
               sigungu AS region_code, {lon('s + 1')} AS lon, {lat('s + 1')} AS lat,
               CAST(1500 + 100 * ((s * 37) % 50) AS DOUBLE) AS length_m
        FROM suppliers""",
    "road_edges": """
        SELECT id AS road_id, lon + a AS x1, lat + b AS y1, lon + c AS x2, lat + d AS y2
        FROM road_segments, (VALUES (0.0e0,0.0e0,0.010e0,0.004e0),(0.010e0,0.004e0,0.018e0,-0.003e0)) v(a,b,c,d)""",
    "road_expansion_stages": f"""
        SELECT s_suppkey AS road_id, stage, {months("DATE '1994-06-01'", 's_suppkey % 12 + m')} AS occurred_at
        FROM supplier, (VALUES ('planned',0),('design',14),('under_construction',32),('completed',56)) v(stage,m)
        WHERE NOT (stage = 'completed' AND s_suppkey % 5 = 0)""",
    "traffic_volumes": """
        SELECT l_suppkey AS road_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS observed_at,
               CAST(5000 + 40 * sum(l_quantity) AS BIGINT) AS aadt,
               CAST(5000 + 40 * sum(l_quantity) AS BIGINT) // 10 AS peak_hour_volume
        FROM lineitem GROUP BY 1, 2""",
    "population_stats": """
        SELECT concat(sigungu, lpad(CAST(slot AS VARCHAR), 5, '0')) AS region_code, observed_at, total AS total_population,
               total * 2 // 5 AS household_count, total // 2 AS male_population, total - total // 2 AS female_population
        FROM (SELECT CAST(c_nationkey AS BIGINT) AS n, c_custkey % 8 AS slot, last_day(CAST(o_orderdate AS DATE)) AS observed_at,
                     8000 + 40 * count(*) AS total
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) JOIN nations USING (n)""",
    "parcels": """
        SELECT p.*, sigungu, concat(sigungu, lpad(CAST(p_partkey % 8 AS VARCHAR), 5, '0'), '1',
               lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'), lpad(CAST(p_partkey // 10000 AS VARCHAR), 4, '0')) AS pnu
        FROM part p JOIN nations ON n = p_partkey % 25""",
    "buildings": f"""
        SELECT pnu, sigungu AS region_code, CAST(p_size AS DOUBLE) * 50 AS parcel_area_m2,
               CAST(CAST(p_size AS BIGINT) * 50 * (2 + p_partkey % 7) AS DOUBLE) / 10.0e0 AS building_area_m2,
               CAST(CAST(p_size AS BIGINT) * 50 * (2 + p_partkey % 7) AS DOUBLE) / 5.0e0 AS total_floor_area_m2,
               CASE p_type WHEN 'ECONOMY' THEN '일반상업시설' WHEN 'STANDARD' THEN '제1종근린생활시설' ELSE '단독주택' END AS use_type,
               DATE '1985-01-01' + CAST(p_partkey % 3000 AS INTEGER) AS approval_date,
               {lon('p_partkey + 20000')} AS lon, {lat('p_partkey + 20000')} AS lat
        FROM parcels""",
    "official_land_prices": """
        SELECT pnu, yr AS year, CAST(floor(CAST(cents * (100 + (l_partkey % 9) * (yr - 1995)) AS DOUBLE) / CAST(units * 10000 AS DOUBLE) + 0.5e0) AS BIGINT) AS price_per_m2
        FROM (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT)) AS BIGINT) AS cents,
                     CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
              FROM lineitem GROUP BY 1, 2) JOIN parcels ON p_partkey = l_partkey""",
    "store_brands": """
        SELECT DISTINCT c_mktsegment AS name, ['cafe','fastfood','bakery','convenience','other'][length(c_mktsegment) % 5 + 1] AS category FROM customer""",
    "stores": f"""
        SELECT c_custkey AS id, c_mktsegment AS brand, c_name AS name,
               concat_ws(' ', 'KR', k.sigungu, concat('Dong', c_custkey % 8)) AS address, k.sigungu AS region_code,
               {lon('c_custkey + 20000')} AS lon, {lat('c_custkey + 20000')} AS lat, pnu,
               ['DT','DI','standard'][(c_custkey // 10) % 3 + 1] AS store_type,
               DATE '1997-01-01' + CAST((c_custkey * 13) % 1000 AS INTEGER) AS opened_at,
               CASE WHEN c_custkey % 70 = 0 THEN DATE '1997-01-01' + CAST((c_custkey * 13) % 1000 + 900 AS INTEGER) END AS closed_at,
               CAST(p_size AS DOUBLE) * 50 AS land_area_m2,
               CAST(CAST(p_size AS BIGINT) * 50 * (2 + c_custkey % 7) AS DOUBLE) / 10.0e0 AS building_area_m2
        FROM customer JOIN nations k ON k.n = c_nationkey JOIN parcels ON p_partkey = c_custkey""",
}

NEEDS: dict[str, list[str]] = {
    "admin_areas": ["nations"], "projects": ["nations"], "project_edges": ["projects"], "split_edges": ["projects"], "project_stages": ["nations"],
    "anchors": ["projects", "project_stages"], "suppliers": ["nations"], "land_transactions": ["suppliers"],
    "road_segments": ["suppliers"], "road_edges": ["road_segments"], "population_stats": ["nations"],
    "parcels": ["nations"], "buildings": ["parcels"], "official_land_prices": ["parcels"], "stores": ["nations", "parcels"],
}


def using(names: str, body: str, extra: dict[str, str] | None = None, extra_needs: str = "") -> str:
    """``WITH`` the named domain views (and what they need), then ``extra`` steps, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in (names + " " + extra_needs).split():
        add(name)
    steps = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order]
    steps += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(steps) + "\n" if steps else "") + body
