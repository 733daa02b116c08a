"""DuckDB oracle text: the routes view and route metrics stated in plain SQL.

Written from the view definition (FIXTURES F9 and plans/routes_view.py's
docstring), not generated from the Spark expressions.  ``with_routes(body)``
prefixes a query with the CTEs ``routes`` and ``route_metrics``.
"""

ROUTES_CTE = r"""
routes_base AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, c.c_name, c.c_nationkey,
         p.p_brand, p.p_type, p.p_size, s.s_name, s.s_nationkey,
         lpad(cast(o.o_custkey % 10000000 AS VARCHAR), 7, '0') AS d7,
         lpad(cast(o.o_custkey % 100000 AS VARCHAR), 5, '0') AS z5,
         cast(round(l.l_extendedprice * 100) AS BIGINT) AS cents,
         l.l_shipdate + INTERVAL 8 HOUR AS s_start
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
routes AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS route_key,
    l_orderkey AS order_key,
    l_linenumber AS line_no,
    cast(l_shipdate AS DATE) AS route_date,
    l_suppkey AS driver_id,
    s_name AS driver_name,
    cast(l_suppkey % 10 + 20 AS DOUBLE) AS driver_rate,
    CASE WHEN l_linenumber <> 7 THEN o_custkey END AS customer_id,
    CASE WHEN l_linenumber <> 7 THEN c_name END AS customer_name,
    l_partkey % 100 AS vehicle_id,
    concat_ws(' ', p_brand, p_type) AS vehicle_info,
    cast(p_size % 6 + 5 AS DOUBLE) AS vehicle_mpg,
    CASE WHEN l_partkey % 5 <> 0 THEN cast(l_partkey % 20 * 1000 + 30000 AS DOUBLE) END AS vehicle_capacity,
    cast(l_suppkey % 40 + 60 AS DOUBLE) AS driver_safety,
    CASE WHEN l_linenumber <> 7 THEN cast(o_custkey % 5 + 1 AS DOUBLE) END AS customer_rating,
    CASE WHEN l_linestatus = 'F' AND o_orderstatus = 'F' THEN 'completed'
         WHEN l_linestatus = 'F' THEN 'in_progress'
         WHEN l_returnflag = 'R' THEN 'cancelled'
         WHEN l_returnflag = 'A' THEN 'delayed'
         ELSE 'scheduled' END AS status,
    CASE p_type WHEN 'ECONOMY' THEN 'General' WHEN 'LARGE' THEN 'OVERSIZED'
                WHEN 'PROMO' THEN 'fragile' WHEN 'SMALL' THEN 'Refrigerated'
                WHEN 'STANDARD' THEN 'Hazardous' ELSE 'medium' END AS load_type_raw,
    cast(p_size AS DOUBLE) * 800 AS load_weight,
    l_quantity * cast(20 AS DOUBLE) AS total_miles,
    l_quantity * cast(20 AS DOUBLE) * l_discount AS empty_miles,
    CASE WHEN l_quantity <> 13 THEN l_quantity * cast(20 AS DOUBLE) / (p_size % 6 + 5) END AS fuel_consumed,
    l_extendedprice * (1 - l_discount) AS revenue,
    CASE WHEN l_quantity <> 13 THEN l_quantity * cast(20 AS DOUBLE) / (p_size % 6 + 5) * cast(3.5 AS DOUBLE) END AS fuel_cost,
    l_quantity * cast(20 AS DOUBLE) * l_tax AS toll_cost,
    l_quantity * cast(20 AS DOUBLE) * cast(0.55 AS DOUBLE) AS driver_pay,
    cast(l_linenumber AS DOUBLE) * 10 AS other_costs,
    s_start AS scheduled_start,
    s_start + to_minutes(cast(l_quantity * 30 AS BIGINT)) AS scheduled_end,
    s_start + to_minutes(cast(l_linenumber * 5 AS BIGINT)) AS actual_start,
    s_start + to_minutes(cast(l_quantity * 30 AS BIGINT))
            + to_minutes(cast((l_partkey % 7 - 2) * 15 AS BIGINT)) AS actual_end,
    cast(s_nationkey + 25 AS DOUBLE) AS start_lat,
    cast(s_nationkey * 2 - 120 AS DOUBLE) AS start_lon,
    s_nationkey AS start_nation,
    c_nationkey AS end_nation,
    cast(c_nationkey + 25 AS DOUBLE) AS end_lat,
    cast(c_nationkey * 2 - 120 AS DOUBLE) AS end_lon,
    CASE o_custkey % 4
      WHEN 0 THEN '555-' || substr(d7, 1, 3) || '-' || substr(d7, 4, 4)
      WHEN 1 THEN '(555) ' || substr(d7, 1, 3) || '-' || substr(d7, 4, 4)
      WHEN 2 THEN '1555' || d7
      WHEN 3 THEN '555' || substr(d7, 1, 4) END AS raw_phone,
    CASE o_custkey % 4
      WHEN 0 THEN ' Customer' || cast(o_custkey AS VARCHAR) || '@Example.COM '
      WHEN 1 THEN 'c.' || cast(o_custkey AS VARCHAR) || '@mail.example.org'
      WHEN 2 THEN 'user' || cast(o_custkey AS VARCHAR) || '@domain'
      WHEN 3 THEN 'invalid-email-' || cast(o_custkey AS VARCHAR) END AS raw_email,
    CASE o_custkey % 4
      WHEN 0 THEN z5
      WHEN 1 THEN z5 || '-' || lpad(cast(o_custkey % 10000 AS VARCHAR), 4, '0')
      WHEN 2 THEN substr(z5, 1, 3) || ' ' || substr(z5, 4, 2)
      WHEN 3 THEN substr(z5, 1, 4) END AS raw_zip,
    CASE o_custkey % 4 WHEN 0 THEN 'il' WHEN 1 THEN 'new york' WHEN 2 THEN ' Texas '
                       WHEN 3 THEN 'DC' END AS raw_state,
    CASE o_custkey % 4 WHEN 0 THEN 'chicago' WHEN 1 THEN 'NEW YORK'
                       WHEN 2 THEN 'san antonio' END AS raw_city,
    CASE o_custkey % 4
      WHEN 0 THEN '  ' || cast(o_custkey AS VARCHAR) || '  north MAIN street '
      WHEN 1 THEN cast(o_custkey AS VARCHAR) || ' 5th avenue'
      WHEN 2 THEN cast(o_custkey AS VARCHAR) || ' west lake boulevard'
      WHEN 3 THEN '' END AS raw_address,
    CASE l_linenumber % 4
      WHEN 0 THEN '$' || cast(cents // 100 AS VARCHAR) || '.' || lpad(cast(cents % 100 AS VARCHAR), 2, '0')
      WHEN 1 THEN cast((cents // 100) // 1000 AS VARCHAR) || ','
                  || lpad(cast((cents // 100) % 1000 AS VARCHAR), 3, '0') || '.'
                  || lpad(cast(cents % 100 AS VARCHAR), 2, '0')
      WHEN 2 THEN cast(cast(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%'
      WHEN 3 THEN 'n/a' END AS raw_amount,
    CASE l_linenumber % 4
      WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d')
      WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y %H:%M')
      WHEN 2 THEN strftime(l_shipdate, '%Y/%-m/%-d')
      WHEN 3 THEN strftime(l_shipdate, '%d/%m/%Y') END AS raw_date
  FROM routes_base
)"""

# round2(x) in DuckDB: half-even on the binary value scaled by 100.
METRICS_CTE = r"""
rm1 AS (
  SELECT r.*,
    coalesce(r.total_miles, 0) AS m_,
    coalesce(r.revenue, 0) AS rev_,
    (epoch_us(coalesce(actual_end, scheduled_end)) - epoch_us(coalesce(actual_start, scheduled_start)))
       / cast(3600000000 AS DOUBLE) AS h_,
    (epoch_us(coalesce(actual_end, scheduled_end)) - epoch_us(coalesce(actual_start, scheduled_start)))
       / cast(60000000 AS DOUBLE) AS min_,
    (epoch_us(scheduled_end) - epoch_us(scheduled_start)) / cast(3600000000 AS DOUBLE) AS sched_h_,
    coalesce(vehicle_mpg, 8) AS mpg_,
    coalesce(driver_rate, 25) AS rate_,
    CASE WHEN start_lat <> 0 AND start_lon <> 0 AND end_lat <> 0 AND end_lon <> 0 THEN
      round_even(2 * asin(sqrt(least(greatest(
          sin((end_lat * pi() / 180 - start_lat * pi() / 180) / 2) * sin((end_lat * pi() / 180 - start_lat * pi() / 180) / 2)
        + cos(start_lat * pi() / 180) * cos(end_lat * pi() / 180)
          * sin((end_lon * pi() / 180 - start_lon * pi() / 180) / 2) * sin((end_lon * pi() / 180 - start_lon * pi() / 180) / 2),
        0), 1))) * 3956 * 100, 0) / 100 END AS calculated_distance
  FROM routes r
),
rm2 AS (
  SELECT *,
    CASE WHEN h_ IS NOT NULL THEN round_even(h_ * 100, 0) / 100 END AS total_hours,
    CASE WHEN h_ IS NOT NULL THEN round_even(min_ * 100, 0) / 100 END AS total_minutes,
    CASE WHEN h_ IS NOT NULL THEN round_even(h_ * 0.8 * 100, 0) / 100 END AS driving_hours,
    CASE WHEN h_ IS NOT NULL THEN round_even(h_ * 0.2 * 100, 0) / 100 END AS wait_hours,
    CASE WHEN m_ <> 0 AND mpg_ <> 0 AND mpg_ > 0 THEN round_even(m_ / mpg_ * 3.5 * 100, 0) / 100 ELSE 0.0 END AS est_fuel_cost,
    CASE WHEN m_ <> 0 THEN round_even(m_ * 0.15 * 100, 0) / 100 ELSE 0.0 END AS est_toll_cost
  FROM rm1
),
rm3 AS (
  SELECT *,
    CASE WHEN m_ <> 0 AND total_hours <> 0 THEN
      CASE WHEN total_hours > 0 THEN round_even(m_ / total_hours * 100, 0) / 100 ELSE 0.0 END END AS average_speed,
    CASE WHEN calculated_distance IS NOT NULL AND m_ <> 0 THEN round_even(calculated_distance / m_ * 100 * 100, 0) / 100 END AS distance_efficiency,
    CASE WHEN total_hours IS NOT NULL THEN
      round_even(greatest(CASE WHEN total_hours <> 0 AND rate_ <> 0 THEN total_hours * rate_ ELSE 0.0 END, 0.0) * 100, 0) / 100
      ELSE 0.0 END AS est_driver_pay
  FROM rm2
),
rm4 AS (
  SELECT *,
    round_even(m_ * 0.08 * 100, 0) / 100 AS maintenance_cost,
    round_even(m_ * 0.05 * 100, 0) / 100 AS insurance_cost,
    round_even((est_fuel_cost + est_toll_cost + m_ * 0.08 + m_ * 0.05) * 100, 0) / 100 AS total_variable_costs,
    round_even((est_fuel_cost + est_toll_cost + m_ * 0.08 + m_ * 0.05 + est_driver_pay
                + coalesce(other_costs, 0)) * 100, 0) / 100 AS total_costs
  FROM rm3
),
route_metrics AS (
  SELECT * EXCLUDE (m_, rev_, h_, min_, sched_h_, mpg_, rate_),
    CASE WHEN rev_ <> 0 THEN round_even((rev_ - total_costs) * 100, 0) / 100 END AS profit,
    CASE WHEN rev_ <> 0 THEN CASE WHEN rev_ > 0 THEN round_even((rev_ - total_costs) / rev_ * 100 * 100, 0) / 100 ELSE 0.0 END END AS profit_margin,
    CASE WHEN rev_ <> 0 AND m_ <> 0 THEN CASE WHEN m_ > 0 THEN round_even(rev_ / m_ * 100, 0) / 100 ELSE 0.0 END END AS revenue_per_mile,
    CASE WHEN rev_ <> 0 AND m_ <> 0 THEN CASE WHEN m_ > 0 THEN round_even(total_costs / m_ * 100, 0) / 100 ELSE 0.0 END END AS cost_per_mile,
    CASE WHEN m_ <> 0 THEN CASE WHEN m_ > 0 THEN round_even(coalesce(empty_miles, 0) / m_ * 100 * 100, 0) / 100 ELSE 0.0 END END AS deadhead_percentage,
    CASE WHEN m_ <> 0 AND fuel_consumed <> 0 THEN CASE WHEN fuel_consumed > 0 THEN round_even(m_ / fuel_consumed * 100, 0) / 100 ELSE 0.0 END END AS fuel_efficiency,
    CASE WHEN calculated_distance <> 0 AND m_ <> 0 AND sched_h_ <> 0 AND total_hours <> 0 THEN
      round_even((least(CASE WHEN m_ > 0 THEN calculated_distance / m_ ELSE 0.0 END * 100, 100) * 0.6
                + least(CASE WHEN total_hours > 0 THEN sched_h_ / total_hours ELSE 0.0 END * 100, 100) * 0.4) * 100, 0) / 100
    END AS efficiency_score
  FROM rm4
)"""


def with_routes(body: str) -> str:
    return "WITH " + ROUTES_CTE.strip() + ",\n" + METRICS_CTE.strip() + "\n" + body


def r2(x: str) -> str:
    """round2 in DuckDB text."""
    return f"round_even(({x}) * 100, 0) / 100"


def fsum(x: str) -> str:
    """Exact order-free sum (mirror of numeric.fixed_sum)."""
    return f"(sum(cast(round_even(({x}) * 10000, 0) AS BIGINT)) / cast(10000 AS DOUBLE))"
