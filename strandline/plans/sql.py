"""DuckDB text of the same derivations, as named common table expressions."""

from __future__ import annotations


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(power(sin(radians({lat2}-{lat1})/2),2)+power(sin(radians({lon2}-{lon1})/2),2)"
        f"*cos(radians({lat1}))*cos(radians({lat2})))"
    )
    return f"(2*6371.0e0*atan2(sqrt({h}),sqrt(1.0e0-{h})))"


CTES: dict[str, tuple[list[str], str]] = {}


def define(name: str, text: str, *deps: str) -> None:
    CTES[name] = (list(deps), text)


def query(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    recursive = "RECURSIVE " if any("UNION ALL" in CTES[n][1] and n.startswith("rec_") for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


define(
    "vertices",
    """SELECT user_id AS line_id, CAST(row_number() OVER w AS INTEGER) AS seq,
  43.0e0 + CAST(sum((event_id*7919)%21-10) OVER w AS DOUBLE)/100.0e0 AS lat,
  34.0e0 + CAST(sum((event_id*104729)%31-15) OVER w AS DOUBLE)/100.0e0 AS lon,
  event_id AS src_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
define(
    "rings",
    """SELECT * FROM vertices UNION ALL
SELECT line_id, CAST(max(seq)+1 AS INTEGER), arg_min(lat,seq), arg_min(lon,seq), arg_min(src_id,seq)
FROM vertices GROUP BY line_id""",
    "vertices",
)
define(
    "shores",
    """SELECT * FROM vertices UNION ALL
SELECT line_id, CAST(max(seq)+1 AS INTEGER), arg_min(lat,seq), arg_min(lon,seq), arg_min(src_id,seq)
FROM vertices WHERE line_id%2=0 GROUP BY line_id""",
    "vertices",
)
define(
    "snapshots",
    """SELECT line_id, CAST(step AS INTEGER) AS step, seq,
  lat + CAST(step*(src_id%7-3) AS DOUBLE)/10000.0e0 AS lat, lon
FROM vertices, range(5) r(step)""",
    "vertices",
)
define(
    "bathy",
    """SELECT ord, (i+0.5e0)*0.1e0 AS lat, (j+0.5e0)*0.1e0 AS lon,
  CAST(-((i*7919+j*104729+ord)%2200) AS DOUBLE) AS depth
FROM (SELECT o_orderkey AS ord, (o_orderkey//155)%70+400 AS i, o_orderkey%155+270 AS j FROM orders)""",
)
define(
    "litho_points",
    """SELECT s_suppkey AS ord, 40+(s_suppkey*37%70)/10.0e0 AS lat, 27+(s_suppkey*53%150)/10.0e0 AS lon,
  'r'||CAST(s_nationkey%6 AS VARCHAR) AS region,
  CASE WHEN s_suppkey%17=0 THEN 'unknown'
       ELSE ['limestone','clay','volcanic','sedimentary'][s_nationkey%4+1] END AS lithology_class,
  0.8e0+(s_suppkey*13%92)/10.0e0 AS resistance, '#'||CAST(s_suppkey%10 AS VARCHAR) AS color,
  s_name AS description, ['high','medium','low'][s_suppkey%3+1] AS confidence
FROM supplier""",
)
define(
    "litho_classes",
    """SELECT * FROM (VALUES ('limestone',4.0e0,'#6b6b6b'),('volcanic',6.5e0,'#4a4a4a'),
('clay',1.2e0,'#c4a484'),('sedimentary',2.5e0,'#8b8b8b')) t(class,resistance,color)""",
)
define(
    "landmarks",
    """SELECT * FROM (VALUES
(1::BIGINT,46.48e0,30.73e0,'Одесса, Украина'),(2,45.33e0,32.49e0,'Евпатория, Крым'),
(3,44.94e0,34.10e0,'Алушта, Крым'),(4,44.62e0,33.53e0,'Севастополь, Крым'),
(5,44.55e0,38.10e0,'Геленджик, Россия'),(6,43.70e0,39.75e0,'Сочи, Россия'),
(7,43.58e0,39.72e0,'Адлер, Россия'),(8,42.00e0,41.58e0,'Сухум, Абхазия'),
(9,42.15e0,41.65e0,'Поти, Грузия'),(10,41.65e0,41.63e0,'Батуми, Грузия'),
(11,41.55e0,41.57e0,'Чорох (граница)'),(12,41.02e0,40.27e0,'Трабзон, Турция'),
(13,41.00e0,39.65e0,'Орду, Турция'),(14,41.28e0,31.42e0,'Синоп, Турция'),
(15,43.00e0,28.00e0,'Варна, Болгария')) t(ord,lat,lon,name)
UNION ALL SELECT s_suppkey+100, 40+(s_suppkey*37%70)/10.0e0, 27+(s_suppkey*53%150)/10.0e0, s_name FROM supplier""",
)
define(
    "step_metrics",
    """SELECT scenario, year, step, length_km, area_km2, eroded_m3, deposited_m3,
  eroded_m3-deposited_m3 AS net_change_m3, storm_event, year*0.01e0 AS sea_level_m,
  1.0e0+0.5e0*sin(year*6.283185307179586e0+0.3e0) AS seasonal_factor
FROM (SELECT scenario, step, step*0.25e0 AS year, length_km, area_km2, CAST(p AS DOUBLE) AS deposited_m3, p>o AS storm_event,
        coalesce((lag(length_km) OVER (PARTITION BY scenario ORDER BY step)-length_km)*1000.0e0,0.0e0) AS eroded_m3
  FROM (SELECT scenario, step, o, p,
      6400.0e0-CAST(sum(f) OVER w AS DOUBLE)/10.0e0 AS length_km, 419695.0e0-CAST(sum(o) OVER w AS DOUBLE)/5.0e0 AS area_km2
    FROM (SELECT o_orderpriority AS scenario,
        CAST((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS INTEGER) AS step,
        count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o,
        count(*) FILTER (o_orderstatus='P') AS p
      FROM orders GROUP BY 1,2)
    WINDOW w AS (PARTITION BY scenario ORDER BY step ROWS UNBOUNDED PRECEDING)))""",
)
define(
    "scenario_params",
    """SELECT c_name AS scenario, CAST(c_custkey%60 AS INTEGER) AS target_years, (c_custkey%130-5)/10.0e0 AS years_per_step,
  (c_custkey%13-1)/10.0e0 AS storm_probability, c_custkey%12*1.0e0 AS storm_intensity,
  (c_custkey%30-5)/1000.0e0 AS sea_level_rise, c_custkey%9-1.0e0 AS seasonal_phase, c_custkey%2=0 AS seasonality
FROM customer""",
)
define(
    "sediment_input",
    """SELECT line_id, seq, lat, lon, 1.0e0+seq%3 AS erosion_rate,
  CASE WHEN src_id%13<>0 THEN (2+seq%5)/10.0e0 END AS energy,
  CASE WHEN src_id%11<>0 THEN 0.8e0+(src_id*13%92)/10.0e0 END AS resistance
FROM vertices""",
    "vertices",
)
define(
    "docs",
    """SELECT line_id, (seq-1)//512 AS doc, CAST(line_id AS VARCHAR)||'-'||CAST((seq-1)//512 AS VARCHAR) AS doc_id,
  seq, CAST((seq-1)%512 AS INTEGER) AS pos, round(lat,2) AS lat, round(lon,2) AS lon,
  count(*) OVER (PARTITION BY line_id, (seq-1)//512) AS n
FROM vertices""",
    "vertices",
)
# neighbouring vertices of a line: open, and with wrap-around
define(
    "open_nb",
    """SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon
FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)""",
    "vertices",
)
