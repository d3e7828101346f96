"""What each query must return, as SQL over the same tables."""

from __future__ import annotations

R, C = 16, 64  # tile size of the queries

SALES = """sales AS (
  SELECT l_suppkey AS i, l_partkey AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"""
FLAG = """{name} AS (
  SELECT l_suppkey AS i, l_partkey AS j, SUM(l_quantity) AS v FROM lineitem
  WHERE l_returnflag {flag} GROUP BY 1, 2)"""
FLAG_A, REST = FLAG.format(name="a", flag="= 'A'"), FLAG.format(name="b", flag="<> 'A'")
PARTS = """parts AS (
  SELECT l_partkey AS i, CAST(l_linenumber AS BIGINT) - 1 AS j, SUM(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2)"""
SIZE = """size AS (SELECT MAX(l_suppkey) + 1 AS m, MAX(l_partkey) + 1 AS n FROM lineitem)"""
VECTORS = """vectors AS (
  SELECT vec_id AS i, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, UNNEST(RANGE(1, LEN(embedding) + 1)) AS k FROM embeddings)),
size AS (SELECT MAX(i) + 1 AS m, MAX(j) + 1 AS n FROM vectors)"""


def place(rows: str, cols: str) -> str:
    """All positions of a grid."""
    return f"""place AS (
  SELECT i, UNNEST(RANGE({cols})) AS j FROM (SELECT UNNEST(RANGE({rows})) AS i))"""


PLACE = place("(SELECT m FROM size)", "(SELECT n FROM size)")


def monthly(year: str, month: str, source: str = "lineitem") -> str:
    return f"""WITH days AS (
  SELECT DATE_DIFF('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS d, l_quantity FROM {source}),
fields AS (SELECT *, {year} AS year, {month} AS month FROM days)
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, COUNT(*) AS count,
  SUM(l_quantity) / COUNT(*) AS mean, MIN(l_quantity) AS min, MAX(l_quantity) AS max
FROM fields GROUP BY 1, 2"""


def month_of_day(day: str, february: int) -> str:
    """Month of a zero-based day of the year, by comparing with the first days of the months."""
    lengths = [31, february, 31, 30, 31, 30, 31, 31, 30, 31, 30]
    starts = [sum(lengths[: k + 1]) for k in range(11)]
    return "1 + " + " + ".join(f"CAST({day} >= {s} AS INTEGER)" for s in starts)


# A Julian date, written as the Gregorian year and month of the day with the same name: every
# four-year cycle of the Julian calendar looks like the Gregorian one from 1901 to 2099.
def julian(day: str, field: str) -> str:
    """``day`` counts from 1904-01-01 of the Julian calendar."""
    same_name = f"(DATE '1904-01-01' + CAST(({day}) % 1461 AS INTEGER))"
    if field == "month":
        return f"MONTH({same_name})"
    return f"(YEAR({same_name}) + 4 * (({day}) // 1461))"


# 1995-01-01 in the Julian calendar, 91 years after 1904-01-01.
JULIAN_DAY = "d + 365 * 91 + 23"
# Days from Julian 1520-01-01; four-year cycles go on unchanged, so move to 1904 by 384 years.
OLD_DAY = "d + 365 * 60 + 15"
REFORM = 365 * 2 + 1 + 277  # Julian 1580-01-01 to 1582-10-05, the first day of the new calendar


def tiled(cells: str) -> str:
    """Cells of the tiles that have any cell, zeros included; needs ``place``."""
    return f"""{cells}_tiles AS (SELECT DISTINCT i // {R} AS bi, j // {C} AS bj FROM {cells}),
{cells}_full AS (
  SELECT p.i, p.j, COALESCE(c.v, 0) AS v FROM place p
  JOIN {cells}_tiles t ON t.bi = p.i // {R} AND t.bj = p.j // {C}
  LEFT JOIN {cells} c ON c.i = p.i AND c.j = p.j)"""


def paired(value: str, a: str = "a", b: str = "b", cte: str | None = None) -> str:
    cte = cte or f"{FLAG_A}, {REST}"
    value = value.format(x="COALESCE(x.v, 0)", y="COALESCE(y.v, 0)")
    return f"""WITH {cte}
SELECT COALESCE(x.i, y.i) AS i, COALESCE(x.j, y.j) AS j, {value} AS v
FROM {a} x FULL JOIN {b} y ON x.i = y.i AND x.j = y.j"""


TWO_TILED = f"{FLAG_A}, {REST}, {SIZE}, {PLACE}, {tiled('a')}, {tiled('b')}"
TILE_ROWS = f"LEAST({R}, (SELECT m FROM size) - bi * {R})"
TILE_COLS = f"LEAST({C}, (SELECT n FROM size) - bj * {C})"
STACKED = f"""stacked AS (
  SELECT DISTINCT i // {R} AS bi, j // {C} AS bj, 'A' AS flag FROM a
  UNION ALL SELECT DISTINCT i // {R}, j // {C}, 'R' FROM b),
summary AS (
  SELECT bi, bj, COUNT(*) AS copies, {TILE_ROWS} AS nr, {TILE_COLS} AS nc
  FROM stacked GROUP BY bi, bj)"""
INT_BLOCK = "CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj"

# Parts of the layout for 12 partitions: sides rounded to the nearest whole number of tiles.
PARTITION = f"""WITH {SALES}, {SIZE},
counts AS (SELECT CEIL(m / {R}) AS rows, CEIL(n / {C}) AS cols FROM size),
sides AS (
  SELECT *, FLOOR(GREATEST(rows / SQRT(12), 1) + 0.5) AS pr,
    FLOOR(GREATEST(cols / SQRT(12), 1) + 0.5) AS pc FROM counts)
SELECT CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj,
  CAST(FLOOR(bi / pr) + FLOOR(bj / pc) * CEIL(rows / pr) AS INTEGER) AS part
FROM (SELECT DISTINCT i // {R} AS bi, j // {C} AS bj FROM sales), sides"""


def resampled(cells: str, rows: str, cols: str, sr: str, sc: str, key: str | None = None) -> str:
    """Bilinear values at source position (``sr``, ``sc``) of each output position (oi, oj).

    Source positions are fractions, written ``numerator/denominator``.
    """
    (rn, rd), (cn, cd) = (s.split("/") for s in (sr, sc))
    picked = f"e.{key}, " if key else ""
    batches = f"(SELECT DISTINCT {key} FROM {cells}) e, " if key else ""
    same_batch = f" AND q.{key} = e.{key}" if key else ""
    return f"""outs AS (
  SELECT {picked}oi, oj, ({rn}) // {rd} AS r, (({rn}) % {rd}) / {rd} AS x,
    ({cn}) // {cd} AS c, (({cn}) % {cd}) / {cd} AS y
  FROM {batches}(SELECT oi, UNNEST(RANGE({cols})) AS oj FROM (SELECT UNNEST(RANGE({rows})) AS oi))),
corners AS (
  SELECT e.*, r + dr AS i, c + dc AS j,
    CASE dr WHEN 0 THEN 1 - x ELSE x END * CASE dc WHEN 0 THEN 1 - y ELSE y END AS w
  FROM outs e, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS s(dr, dc)),
resampled AS (
  SELECT {picked}oi AS i, oj AS j, SUM(w * q.v) AS v
  FROM corners e JOIN {cells} q ON q.i = e.i AND q.j = e.j{same_batch}
  WHERE w > 0 GROUP BY ALL)"""


LINES = """lines AS (
  SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) - 1 AS j, SUM(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2)"""
YEARLY = """yearly AS (
  SELECT CAST(YEAR(l_shipdate) AS INTEGER) AS year, l_suppkey AS i,
    CAST(l_linenumber AS BIGINT) - 1 AS j, SUM(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2, 3),
size AS (SELECT MAX(i) + 1 AS m, MAX(j) + 1 AS n FROM yearly)"""

ORACLE: dict[str, str] = {
    "year_month_noleap": monthly(
        "1995 + d // 365", month_of_day("(d % 365)", 28)
    ),
    "year_month_all_leap": monthly("1995 + d // 366", month_of_day("(d % 366)", 29)),
    "year_month_360_day": monthly("1995 + d // 360", "1 + (d % 360) // 30"),
    "year_month_proleptic_gregorian": monthly(
        "YEAR(DATE '1995-01-01' + CAST(d AS INTEGER))", "MONTH(DATE '1995-01-01' + CAST(d AS INTEGER))"
    ),
    "year_month_julian": monthly(julian(JULIAN_DAY, "year"), julian(JULIAN_DAY, "month")),
    "year_month_standard": monthly(
        f"CASE WHEN d < {REFORM} THEN {julian(OLD_DAY, 'year')} - 384 "
        f"ELSE YEAR(DATE '1582-10-15' + CAST(d - {REFORM} AS INTEGER)) END",
        f"CASE WHEN d < {REFORM} THEN {julian(OLD_DAY, 'month')} "
        f"ELSE MONTH(DATE '1582-10-15' + CAST(d - {REFORM} AS INTEGER)) END",
    ),
    "year_stats_by_flag": """
SELECT l_returnflag,
  CAST(1995 + DATE_DIFF('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 365 AS INTEGER) AS year,
  COUNT(*) AS count, SUM(l_quantity) / COUNT(*) AS mean,
  MIN(l_quantity) AS min, MAX(l_quantity) AS max
FROM lineitem GROUP BY 1, 2""",
    # 2023-12-30 is day 359 of 2023 in this calendar; the axis starts there at 18:30.
    "event_hours_360_day": """
WITH days AS (
  SELECT 2023 * 360 + 359 + CAST(FLOOR(
    (ROUND((EPOCH_US(ts) - EPOCH_US(TIMESTAMP '2024-01-01')) / 1000.0) / 60000.0 + 18 * 60 + 30) / 1440) AS BIGINT) AS d
  FROM events)
SELECT CAST(d // 360 AS INTEGER) AS year, CAST(1 + (d % 360) // 30 AS INTEGER) AS month,
  COUNT(*) AS events FROM days GROUP BY 1, 2""",
    "year_range": """
WITH days AS (
  SELECT l_returnflag, DATE_DIFF('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem)
SELECT l_returnflag, COUNT(*) AS items, CAST(MIN(d) AS DOUBLE) AS first, CAST(MAX(d) AS DOUBLE) AS last
FROM days WHERE d // 365 BETWEEN 1 AND 2 GROUP BY 1""",
    "sql_calendar_functions": """
WITH days AS (
  SELECT DATE_DIFF('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS d, l_quantity FROM lineitem)
SELECT CAST(1995 + d // 360 AS INTEGER) AS year, CAST(1 + (d % 360) // 30 AS INTEGER) AS month,
  COUNT(*) AS items, SUM(l_quantity) AS quantity FROM days GROUP BY 1, 2""",
    "map_cells_linear": f"WITH {SALES} SELECT i, j, v * 10 + i - j AS v FROM sales",
    "map_values_square": f"WITH {SALES} SELECT i, j, v * v AS v FROM sales",
    "scalar_product": f"WITH {SALES} SELECT i, j, v * CAST(2.5 AS DOUBLE) AS v FROM sales",
    "scalar_sum": f"""WITH {SALES}, {SIZE}, {PLACE}
SELECT i, j, COALESCE(v, 0) + CAST(0.5 AS DOUBLE) AS v FROM place LEFT JOIN sales USING (i, j)""",
    "transpose_cells": f"WITH {SALES} SELECT j AS i, i AS j, v FROM sales",
    "densify_cells": f"""WITH {SALES}, {SIZE}, {PLACE}
SELECT i, j, COALESCE(v, 0) AS v FROM place LEFT JOIN sales USING (i, j)""",
    "densify_yearly": f"""WITH {YEARLY}, {PLACE},
years AS (SELECT DISTINCT year FROM yearly)
SELECT year, i, j, COALESCE(v, 0) AS v
FROM (SELECT year, i, j FROM years, place) LEFT JOIN yearly USING (year, i, j)""",
    "grid_dims": "SELECT MAX(l_suppkey) + 1 AS nrows, MAX(l_partkey) + 1 AS ncols FROM lineitem",
    "size_estimate": f"WITH {SIZE} SELECT m AS nrows, n AS ncols, m * n // 125000 AS mb FROM size",
    "add_cells": paired("{x} + {y}"),
    "subtract_cells": paired("{x} - {y}"),
    "combine_max": paired("GREATEST({x}, {y})"),
    "combine_checked": paired("{x} * 2 - {y}"),
    "grids_diff": f"""WITH {FLAG_A}, {REST}
SELECT COALESCE(x.i, y.i) AS i, COALESCE(x.j, y.j) AS j, COALESCE(x.v, 0) AS a, COALESCE(y.v, 0) AS b
FROM a x FULL JOIN b y ON x.i = y.i AND x.j = y.j
WHERE COALESCE(x.v, 0) <> COALESCE(y.v, 0)""",
    "multiply_cells": f"""WITH {SALES}, {PARTS}
SELECT s.i, p.j, SUM(s.v * p.v) AS v FROM sales s JOIN parts p ON s.j = p.i GROUP BY 1, 2""",
    "multiply_transposed": f"""WITH {SALES}
SELECT s.i, p.i AS j, SUM(s.v * p.v) AS v FROM sales s JOIN sales p ON s.j = p.j GROUP BY 1, 2""",
    "to_blocks_summary": f"""WITH {SALES}, {SIZE},
cells AS (SELECT *, i // {R} AS bi, j // {C} AS bj FROM sales),
placed AS (SELECT *, {TILE_ROWS} AS nr, {TILE_COLS} AS nc FROM cells)
SELECT {INT_BLOCK}, CAST(nr AS INTEGER) AS nr, CAST(nc AS INTEGER) AS nc,
  CAST(nr * nc AS INTEGER) AS size, SUM(v) AS total, SUM(v * ((j % {C}) * nr + i % {R})) AS weighted
FROM placed GROUP BY bi, bj, nr, nc""",
    "to_blocks_to_cells": f"""WITH {SALES}, {SIZE}, {PLACE}, {tiled('sales')}
SELECT i, j, v FROM sales_full""",
    "to_cells_dense": f"""WITH {SALES}, {SIZE},
moved AS (SELECT i + i // {R} * {R} AS i, j, v FROM sales),
{place("(SELECT MAX(i) + 1 FROM moved)", "(SELECT n FROM size)")}
SELECT i, j, COALESCE(v, 0) AS v FROM place LEFT JOIN moved USING (i, j)""",
    "map_blocks": f"""WITH {SALES}, {SIZE}, {PLACE}, {tiled('sales')}
SELECT i, j, v * 10 + i - j AS v FROM sales_full""",
    "transpose_blocks": f"""WITH {SALES}, {SIZE}, {PLACE}, {tiled('sales')}
SELECT j AS i, i AS j, v FROM sales_full""",
    "add_blocks": paired("{x} + {y}", "a_full", "b_full", TWO_TILED),
    "subtract_blocks": paired("{x} - {y}", "a_full", "b_full", TWO_TILED),
    "combine_blocks": paired("GREATEST({x}, {y})", "a_full", "b_full", TWO_TILED),
    "sum_duplicate_blocks": paired("{x} + {y}", "a_full", "b_full", TWO_TILED),
    "block_extents": f"""WITH {SALES}, {SIZE},
tiles AS (SELECT DISTINCT i // {R} AS bi, j // {C} AS bj FROM sales)
SELECT {INT_BLOCK}, CAST({TILE_ROWS} AS INTEGER) AS nr, CAST({TILE_COLS} AS INTEGER) AS nc FROM tiles""",
    "block_dims": "SELECT MAX(l_suppkey) + 1 AS nrows, MAX(l_partkey) + 1 AS ncols FROM lineitem",
    "repeated_blocks": f"""WITH {FLAG_A}, {REST}, {SIZE}, {STACKED}
SELECT {INT_BLOCK}, copies FROM summary WHERE copies > 1""",
    "validate_violations": f"""WITH {FLAG_A}, {REST}, {SIZE}, {STACKED},
claimed AS (SELECT m - 1 AS m, n - 1 AS n, {R} - 1 AS h, {C} AS w FROM size),
judged AS (
  SELECT s.*, bi * h + nr AS bottom, bj * w + nc AS edge, m, n,
    CASE WHEN bi < CEIL(m / h) - 1 THEN nr = h ELSE nr BETWEEN 1 AND h END
    AND CASE WHEN bj < CEIL(n / w) - 1 THEN nc = w ELSE nc BETWEEN 1 AND w END AS fits
  FROM summary s, claimed),
found AS (
  SELECT bi, bj, 'size' AS rule, 'reaches ' || bottom || ' ' || edge AS detail FROM judged
  WHERE bottom > m OR edge > n
  UNION ALL SELECT bi, bj, 'duplicate', copies || ' copies' FROM judged WHERE copies > 1
  UNION ALL SELECT bi, bj, 'shape', 'is ' || nr || ' ' || nc FROM judged WHERE NOT fits)
SELECT {INT_BLOCK}, rule, detail FROM found""",
    "grid_partition": PARTITION,
    "grid_placement": PARTITION,
    "stencil_identity": f"WITH {VECTORS} SELECT i, j, v FROM vectors",
    "stencil_square_sum": f"""WITH {VECTORS}
SELECT h.i, h.j, h.v + 2 * COALESCE(r.v, -h.v) + 4 * COALESCE(c.v, -h.v) + 8 * COALESCE(d.v, -h.v) AS v
FROM vectors h
LEFT JOIN vectors r ON r.i = h.i + 1 AND r.j = h.j
LEFT JOIN vectors c ON c.i = h.i AND c.j = h.j + 1
LEFT JOIN vectors d ON d.i = h.i + 1 AND d.j = h.j + 1""",
    "stencil_pooling": f"""WITH {SALES}, {SIZE}, {PLACE}
SELECT i // 2 AS i, j // 2 AS j, MAX(COALESCE(v, 0)) AS v
FROM place LEFT JOIN sales USING (i, j) GROUP BY 1, 2""",
    "regrid_finer": f"""WITH {VECTORS},
{resampled('vectors', '(SELECT 2 * m - 1 FROM size)', '(SELECT 2 * n - 1 FROM size)', 'oi/2', 'oj/2')}
SELECT i, j, v FROM resampled""",
    "regrid_coarser": f"""WITH {VECTORS},
{resampled('vectors', '(SELECT m FROM size)', '(SELECT (n - 1) * 2 // 3 + 1 FROM size)', 'oi/1', 'oj * 3/2')}
SELECT i, j, v FROM resampled""",
    "regrid_yearly": f"""WITH {YEARLY},
{resampled('yearly', '(SELECT 2 * m - 1 FROM size)', '(SELECT 2 * n - 1 FROM size)', 'oi/2', 'oj/2', 'year')}
SELECT year, i, j, v FROM resampled""",
    "interpolate_square": f"""WITH {LINES},
turned AS (SELECT j AS i, i AS j, v FROM lines),
size AS (SELECT GREATEST(MAX(i), MAX(j)) + 1 AS n FROM turned),
{resampled('turned', '(SELECT 2 * n - 1 FROM size)', '(SELECT 2 * n - 1 FROM size)', 'oi/2', 'oj/2')}
SELECT i, j, v FROM resampled""",
    "zeros_by_flag": """
SELECT l_returnflag, COUNT(*) FILTER (l_discount = 0) AS zeros FROM lineitem GROUP BY 1""",
    "checksum_by_supplier": """
SELECT l_suppkey, COUNT(l_quantity) AS count, SUM(l_quantity) AS sum FROM lineitem GROUP BY 1""",
    "checksum_of_valid": """
WITH sums AS (
  SELECT l_suppkey, COUNT(*) AS count, SUM(l_quantity) - 25.5 * COUNT(*) AS sum FROM lineitem GROUP BY 1)
SELECT COUNT(*) AS sources, CAST(COALESCE(SUM(count), 0) AS BIGINT) AS count,
  CAST(SUM(sum) AS DOUBLE) AS sum FROM sums WHERE sum >= 0""",
    "netcdf_scan": """
SELECT CAST(l_linenumber AS SMALLINT) AS line, COUNT(*) AS cells,
  CAST(SUM(l_quantity) AS BIGINT) AS quantity,
  MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price
FROM lineitem GROUP BY 1""",
    "netcdf_zeros": "SELECT COUNT(*) AS zeros FROM lineitem WHERE l_discount = 0",
    "netcdf_checksum": "SELECT COUNT(*) AS count, CAST(SUM(l_quantity) AS BIGINT) AS sum FROM lineitem",
    "netcdf_period_stats": monthly("1995 + d // 365", month_of_day("(d % 365)", 28)),
    "dataset_roundtrip": monthly(
        "1995 + d // 365",
        month_of_day("(d % 365)", 28),
        "(SELECT CAST(l_shipdate AS DATE) AS l_shipdate, SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)",
    ),
    "metadata_variable": """
SELECT 'A' AS name, 'days since ' || STRFTIME(MIN(l_shipdate), '%Y-%m-%d') AS units, 'noleap' AS calendar
FROM lineitem WHERE l_returnflag = 'A'""",
    "metadata_attributes": """
WITH flags AS (SELECT l_returnflag, COUNT(*) AS items FROM lineitem GROUP BY 1)
SELECT l_returnflag AS variable, 'calendar' AS attribute, 'noleap' AS value FROM flags
UNION ALL SELECT l_returnflag, 'items', CAST(items AS VARCHAR) FROM flags""",
}


def product(right: str, rows: int, inner: int, cols: int) -> str:
    """Every cell of the tiles that a product of sales makes, tiles being ``rows x inner`` and ``inner x cols``."""
    return f"""WITH {SALES}, {PARTS}, {SIZE}, other AS ({right}),
made AS (
  SELECT DISTINCT bi, bj FROM (SELECT DISTINCT i // {rows} AS bi, j // {inner} AS k FROM sales)
  JOIN (SELECT DISTINCT i // {inner} AS k, j // {cols} AS bj FROM other) USING (k)),
sums AS (SELECT s.i, p.j, SUM(s.v * p.v) AS v FROM sales s JOIN other p ON s.j = p.i GROUP BY 1, 2),
{place("(SELECT m FROM size)", "(SELECT MAX(j) + 1 FROM other)")}
SELECT i, j, COALESCE(v, 0) AS v FROM place JOIN made ON bi = i // {rows} AND bj = j // {cols}
LEFT JOIN sums USING (i, j)"""


ORACLE["multiply_blocks"] = product("SELECT i, j, v FROM parts", 64, 256, 8)
ORACLE["multiply_blocks_transposed"] = product("SELECT j AS i, i AS j, v FROM sales", 64, 256, 64)
ORACLE["add_stored_cells"] = ORACLE["add_cells"]
ORACLE["add_stored_blocks"] = ORACLE["add_blocks"]
ORACLE["stencil_blocks"] = ORACLE["stencil_square_sum"]


def windows(cells: str, cte: str, rows: int, cols: int, combine: str) -> str:
    """``combine`` over windows that begin at each position: along one axis, and then along the other."""
    down = f"OVER (PARTITION BY j ORDER BY i ROWS BETWEEN CURRENT ROW AND {rows - 1} FOLLOWING)"
    along = f"OVER (PARTITION BY i ORDER BY j ROWS BETWEEN CURRENT ROW AND {cols - 1} FOLLOWING)"
    return f"""WITH {cte},
full_grid AS (SELECT i, j, COALESCE(v, 0) AS v FROM place LEFT JOIN {cells} USING (i, j)),
down AS (SELECT i, j, {combine}(v) {down} AS v, COUNT(*) {down} AS n FROM full_grid),
both_ways AS (SELECT i, j, {combine}(v) {along} AS v, SUM(n) {along} AS n FROM down)
SELECT i, j"""


LINE_PLACE = place("(SELECT MAX(i) + 1 FROM parts)", "(SELECT MAX(j) + 1 FROM parts)")
ORACLE["stencil_blocks_sparse"] = windows("sales", f"{SALES}, {SIZE}, {PLACE}", 2, 2, "MAX") + ", v FROM both_ways"
ORACLE["window_mean"] = windows("parts", f"{PARTS}, {LINE_PLACE}", 40, 3, "SUM") + ", v / n AS v FROM both_ways"
ORACLE["window_max"] = windows("parts", f"{PARTS}, {LINE_PLACE}", 25, 2, "MAX") + ", v FROM both_ways"
ORACLE["window_sum_blocks"] = windows("sales", f"{SALES}, {SIZE}, {PLACE}", 9, 33, "SUM") + ", v FROM both_ways"
TURNED = "turned AS (SELECT j AS i, i AS j, v FROM parts)"
ORACLE["window_max_blocks"] = (
    windows("turned", f"{PARTS}, {TURNED}, {place('(SELECT MAX(i) + 1 FROM turned)', '(SELECT MAX(j) + 1 FROM turned)')}", 3, 40, "MAX")
    + ", v FROM both_ways"
)
ORACLE["netcdf_year_zones"] = f"SELECT * FROM ({ORACLE['netcdf_period_stats']}) WHERE year BETWEEN 1996 AND 1997"
ORACLE["stencil_pooling_sparse"] = f"WITH {SALES} SELECT i // 2 AS i, j // 2 AS j, MAX(v) AS v FROM sales GROUP BY 1, 2"
ORACLE["stencil_repeated_yearly"] = f"""WITH {YEARLY}, years AS (SELECT DISTINCT year FROM yearly),
{place('(SELECT 3 * m FROM size)', '(SELECT 3 * n // 2 FROM size)')}
SELECT years.year, p.i, p.j, 2 * COALESCE(y.v, 0) + p.i AS v
FROM place p CROSS JOIN years LEFT JOIN yearly y ON y.year = years.year AND y.i = p.i // 3 AND y.j = 2 * p.j // 3"""
ORACLE["stencil_mirrored"] = f"""WITH {PARTS}, {LINE_PLACE}, last AS (SELECT MAX(i) AS m FROM parts)
SELECT p.i, p.j, COALESCE(a.v, 0) - COALESCE(b.v, 0) AS v FROM place p CROSS JOIN last
LEFT JOIN parts a ON a.i = m - p.i AND a.j = p.j LEFT JOIN parts b ON b.i = m - p.i + 1 AND b.j = p.j"""
ORACLE["lookup_cells"] = f"""WITH {SALES}, {SIZE}, asked AS (
  SELECT l_orderkey, l_linenumber, l_suppkey AS i, (l_partkey + l_linenumber % 2) % n AS j FROM lineitem, size)
SELECT l_orderkey, l_linenumber, i, j, COALESCE(v, 0) AS v FROM asked LEFT JOIN sales USING (i, j)"""
ORACLE["lookup_blocks"] = ORACLE["lookup_cells"]
ORACLE["regrid_blocks_finer"] = ORACLE["regrid_finer"]
ORACLE["regrid_blocks_coarser"] = ORACLE["regrid_coarser"]
ORACLE["grids_diff_narrowed"] = f"WITH {SALES} SELECT i, j, v AS a, v + 1 AS b FROM sales WHERE i % 50 = 7"
ORACLE["ranges_that_differ"] = f"""WITH {SALES}
SELECT DISTINCT CAST(i // {R} AS INTEGER) AS bi, CAST(j // {C} AS INTEGER) AS bj FROM sales WHERE i % 50 = 7"""
