"""The domain tables of `shelfindex.sources.star`, stated as DuckDB common table expressions."""

AS_OF = "DATE '2001-11-04'"
INCIDENT = "inc000000000017"
NOW = "TIMESTAMP '2001-11-04 00:00:00'"

# Parts with even keys are sold as one of twenty staples, the others as lines of their own.
LINE_OF = "CASE WHEN {key} % 2 = 0 THEN ({key} // 2) % 20 ELSE 20 + {key} // 10 END"

BASE = f"""
stores AS (
  SELECT 'st' || n_nationkey AS store_id, n_name AS name, r_name AS country,
         upper(substr(r_name, 1, 3)) AS currency,
         CASE WHEN n_nationkey % 6 = 5 THEN 'none' ELSE 'api' END AS method,
         ['grocery','pharmacy','electronics','home'][n_nationkey % 4 + 1] AS category,
         n_nationkey % 4 <> 3 AS index_contributor, n_nationkey % 7 <> 6 AS active
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
default_currency AS (
  SELECT r_name AS country, upper(substr(r_name, 1, 3)) AS code FROM region
),
readings AS (
  SELECT ((((l_shipdate::DATE - DATE '1970-01-01')::HUGEINT * 1000000000000 + l_orderkey) * 100
           + l_linenumber) * 10000000000 + l_partkey) * 100000000 + l_suppkey AS id,
         'st' || s_nationkey AS store_id, s_nationkey AS n, {LINE_OF.format(key='l_partkey')} AS sku,
         l_shipdate AS observed_at,
         (((2 * round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT)
            + 100 * l_quantity::BIGINT) // (200 * l_quantity::BIGINT))::DECIMAL(12,0) * 0.01)
           ::DECIMAL(12,4) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
product_lines AS (
  SELECT {LINE_OF.format(key='p_partkey')} AS sku, arg_min(p_name, p_partkey) AS p_name,
         arg_min(p_type, p_partkey) AS p_type, arg_min(p_size, p_partkey) AS p_size
  FROM part GROUP BY ALL
),
sizes AS (
  SELECT store_id, sku, p_size, uom AS size_base_uom,
         CASE WHEN (7 * sku + 3 * n) % 41 = 0 THEN NULL WHEN uom = 'count' THEN p_size
              ELSE p_size * 100 END::DOUBLE AS size_quantity,
         p_name || ' ' || p_type || ' ' || p_size AS name,
         CASE WHEN (7 * sku + 3 * n) % 41 <> 0 THEN p_size || ' ' || uom END AS unit
  FROM (SELECT *, ['g','ml','count'][((sku % 20) % 3
          + CASE WHEN (5 * sku + 2 * n) % 37 = 1 THEN 1 ELSE 0 END) % 3 + 1] AS uom
        FROM (SELECT DISTINCT store_id, n, sku FROM readings) JOIN product_lines USING (sku))
),
seen AS (
  SELECT *, lag(price) OVER (PARTITION BY store_id, sku ORDER BY id) AS previous_price
  FROM readings
),
obs AS (
  SELECT id, store_id, printf('k%03d', sku) AS product_key, observed_at, price,
         currency,
         p_size, size_base_uom, size_quantity, previous_price
  FROM seen JOIN sizes USING (store_id, sku) JOIN stores USING (store_id)
  WHERE previous_price IS NULL OR price <> previous_price
),
price_observations AS (
  SELECT id, store_id, product_key, observed_at, price, currency,
         CASE WHEN size_quantity IS NULL THEN NULL
              ELSE (CASE WHEN size_base_uom = 'count'
                THEN ((2 * (price * 10000)::BIGINT * 100 + p_size) // (2 * p_size))
                ELSE ((2 * (price * 10000)::BIGINT * 1000 + p_size) // (2 * p_size)) END)
               ::DECIMAL(16,0) * 0.000001 END::DECIMAL(16,6) AS unit_price,
         CASE WHEN size_quantity IS NULL THEN NULL WHEN size_base_uom = 'g' THEN 'per_kg'
              WHEN size_base_uom = 'ml' THEN 'per_litre' ELSE 'per_item' END AS unit_price_basis,
         CASE WHEN previous_price IS NULL THEN 'new' ELSE 'price' END AS change,
         previous_price, (price - previous_price)::DECIMAL(12,4) AS delta
  FROM obs
),
products AS (
  SELECT store_id, printf('k%03d', sku) AS product_key, name,
         'https://shop.example/' || store_id || printf('/k%03d', sku) AS url, unit,
         size_quantity, size_base_uom,
         CASE WHEN sku % 5 = 0 THEN 'multipack' WHEN sku % 7 = 0 THEN 'range' ELSE 'plain' END
           AS size_form,
         sku % 11 = 0 AS size_approximate, first_seen, last_seen
  FROM (SELECT store_id, sku, min(observed_at) AS first_seen, max(observed_at) AS last_seen
        FROM readings GROUP BY ALL) JOIN sizes USING (store_id, sku)
),
items AS (
  SELECT printf('item%02d', sku) AS key, p_name AS label,
         CASE WHEN sku < 15 THEN 'core' WHEN sku < 18 THEN 'stretch' ELSE 'registered' END AS tier,
         ['g','ml','count'][sku % 3 + 1] AS normal_unit,
         CASE WHEN sku % 4 <> 3 THEN
           '{{"AFRICA": "1 pack", "ASIA": "3 pack", "MIDDLE EAST": "5 pack"}}' END AS target_size,
         CASE WHEN sku < 15 OR sku % 53 = 20 THEN 1 + sku % 5 END::DOUBLE AS index_quantity,
         CASE WHEN sku < 15 THEN ['kg','l','count'][sku % 3 + 1]
              WHEN sku % 53 = 20 THEN ['kg','l','count'][(sku + sku % 2) % 3 + 1] END AS index_uom
  FROM product_lines
),
shown_lines AS (SELECT DISTINCT sku AS i, n FROM readings),
basket_map AS (
  SELECT printf('item%02d', i) AS item_key, 'st' || n AS store_id,
         CASE WHEN (i + n) % 11 <> 0 THEN printf('k%03d', i) END AS product_key,
         CASE WHEN (i + n) % 11 = 0 THEN 'not_stocked'
              WHEN (i + n) % 3 = 0 THEN 'curated' ELSE 'verified' END AS status,
         CASE WHEN (i + n) % 4 = 0 THEN i || ' units' END AS target_size,
         CASE WHEN (i * n) % 13 = 1 THEN 2 ELSE 0 END AS missed_runs
  FROM shown_lines
),
pin_gaps AS (
  SELECT 'st' || n AS store_id, printf('k%03d', i) AS product_key,
         DATE '1997-01-01' + ((31 * i + 17 * n) % 900)::INTEGER AS from_day,
         CASE WHEN (i + n) % 9 <> 0 THEN
           DATE '1997-01-01' + ((31 * i + 17 * n) % 900)::INTEGER
             + (20 + (i + n) % 60)::INTEGER END AS to_day
  FROM shown_lines
),
ev AS (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events),
runs AS (
  SELECT event_id AS id, 'st' || (user_id % 25) AS store_id, ts AS "at",
         CASE event_type WHEN 'signup' THEN 'anomalous' WHEN 'error' THEN 'error'
              WHEN 'purchase' THEN 'blocked' WHEN 'click' THEN 'ok' WHEN 'view' THEN 'ok' END
           AS status,
         (k * 10)::INTEGER AS rows, (k * 0.25)::DECIMAL(5,2) AS null_rate_pct
  FROM ev
),
incidents AS (
  SELECT 'inc' || lpad(event_id::VARCHAR, 12, '0') AS id, 'st' || (user_id % 25) AS store_id, kind,
         event_id % 3 AS shape, k, event_id % 2 = 0 AS even,
         CASE WHEN event_id % 4 <> 0 THEN 'resolved' WHEN event_id % 8 = 0 THEN 'manual'
              ELSE 'open' END AS state,
         opened::TIMESTAMP AS opened_at,
         CASE WHEN event_id % 4 <> 0 THEN opened + (k % 30)::INTEGER END::TIMESTAMP AS resolved_at
  FROM (SELECT *, DATE '1995-01-01' + ((7 * event_id) % 2500)::INTEGER AS opened,
               ['schema','nulls','rowcount','drift','pull_failed','mystery'][k % 6 + 1] AS kind
        FROM ev WHERE event_type = 'error')
),
alerts AS (
  SELECT 'al' || lpad(event_id::VARCHAR, 12, '0') AS id,
         ['price_drop','escalation','unknown'][k % 3 + 1] AS kind,
         CASE WHEN k % 2 = 0 THEN 'email' ELSE 'chat' END AS channel, ts AS sent_at
  FROM ev WHERE event_type = 'purchase'
),
orders_keyed AS (
  SELECT src, com, srp,
         CASE WHEN src IN (1, 4) THEN c_mktsegment ELSE '' END AS segment,
         CASE WHEN src IN (1, 4) THEN n_nationkey + 1 ELSE 0 END AS nat,
         CASE WHEN src IN (1, 4) THEN n_name ELSE '' END AS place,
         CASE WHEN src IN (1, 4) THEN r_name ELSE '' END AS region,
         CASE WHEN src <= 2 THEN date_trunc('week', o_orderdate)
              WHEN src = 4 THEN o_orderdate ELSE date_trunc('month', o_orderdate) END::DATE
           AS period_start,
         round(o_totalprice * 100)::BIGINT AS cents
  FROM (SELECT *, substr(o_orderpriority, 1, 1)::INTEGER AS src,
               CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 1
                    WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2
                    ELSE 3 END AS com,
               CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN o_custkey % 4800 ELSE 0 END
                 AS srp
        FROM orders)
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
bulletins AS (
  SELECT ['doe_pump','doe_oil_monitor','doe_lpg','bantay_presyo','dti_srp'][src] AS source,
         src, com, srp, nat, segment,
         CASE src WHEN 1 THEN ['RON 95','DIESEL','KEROSENE'][com] WHEN 2 THEN 'adjustment'
              WHEN 3 THEN 'lpg' WHEN 4 THEN ['Rice','Fish','Vegetables'][com]
              ELSE ['Canned goods','Noodles','Milk'][com] END AS commodity,
         CASE src WHEN 2 THEN ['gasoline','diesel','kerosene'][com] WHEN 4 THEN lower(segment)
              WHEN 5 THEN ['blue','cold','hot','large','new','old','red','small'][srp % 8 + 1]
                || ' ' || ['anvil','bolt','gear','gizmo','plate','ring','rod','widget']
                          [(srp // 8) % 8 + 1]
              ELSE '' END AS variant,
         CASE WHEN src = 1 THEN segment ELSE '' END AS brand, region, place,
         CASE WHEN src <= 2 THEN 'litre' WHEN src = 3 THEN '11-kg cylinder'
              WHEN src = 4 THEN 'kg'
              ELSE (1 + srp % 50)::VARCHAR END AS unit,
         period_start,
         CASE WHEN src <= 2 THEN period_start + 6 WHEN src = 4 THEN period_start
              ELSE last_day(period_start) END AS period_end,
         (((2 * min(cents) + CASE WHEN src = 5 THEN 100 ELSE 1000 END)
            // (2 * CASE WHEN src = 5 THEN 100 ELSE 1000 END))::DECIMAL(12,0) * 0.01)
            ::DECIMAL(12,2) AS price_min,
         (((2 * max(cents) + CASE WHEN src = 5 THEN 100 ELSE 1000 END)
            // (2 * CASE WHEN src = 5 THEN 100 ELSE 1000 END))::DECIMAL(12,0) * 0.01)
            ::DECIMAL(12,2) AS price_max
  FROM orders_keyed
  GROUP BY src, com, srp, nat, segment, place, region, period_start
),
latest_price AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, product_key ORDER BY id DESC) AS rn
    FROM price_observations) WHERE rn = 1
)
"""

# The money arithmetic above keeps unit prices in integer micro-units: price x 10^4 is exact,
# so price / count and price x 1000 / (size x 100) are ratios of integers, rounded half up.


def sql(ctes: str, select: str) -> str:
    """A query over the domain tables: extra CTEs (may be empty) and the final select."""
    extra = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"WITH {BASE.strip()}{extra}\n{select.strip()}"
