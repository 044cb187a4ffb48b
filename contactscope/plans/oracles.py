"""DuckDB SQL for every query that SQL can express, written independently of the operators.

Run on views of the star-schema tables. Column names and types match the Spark results.
"""

from __future__ import annotations

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

INPUTS = f"""
bookings AS (
  SELECT o.o_orderkey + 4600000000 AS order_id,
         o.o_orderdate + to_hours(CAST(o.o_custkey % 24 AS INTEGER)) AS order_created_at,
         CASE WHEN o.o_orderkey % 97 <> 0 THEN o.o_totalprice - 5000.0::DOUBLE END AS order_amount,
         c.c_acctbal AS revenue,
         c.c_mktsegment AS brand,
         o.o_orderpriority AS device,
         CASE o.o_orderstatus WHEN 'F' THEN 'One-way' WHEN 'O' THEN 'Round-trip'
                              WHEN 'P' THEN 'Multi-city' END AS journey_type_id,
         CASE c.c_nationkey % 3 WHEN 0 THEN 'FAMILY' WHEN 1 THEN 'SINGLE' ELSE 'GROUP' END
           AS customer_group_type,
         CASE WHEN n.n_regionkey <> 4 THEN r.r_name END AS client_entry_type,
         CAST(o.o_custkey % 10 = 0 AS INTEGER) AS is_canceled,
         CAST(o.o_custkey % 7 = 0 AS INTEGER) AS is_changed,
         CASE WHEN o.o_custkey % 3 <> 0 THEN 'P' || (o.o_custkey % 5) END AS partner,
         'S' || (c.c_nationkey % 4) AS booking_system,
         'T' || (c.c_nationkey % 2) AS booking_system_source_type,
         n.n_name AS site_country,
         'C' || (o.o_custkey % 50) AS currency
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
raw AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS errand_id,
         CASE WHEN l.l_quantity = 50 THEN '#' || l.l_orderkey
              WHEN l.l_quantity <> 49 THEN upper(to_base(l.l_orderkey + 4600000000, 36)) END
           AS order_number,
         l.l_shipdate + to_hours(CAST(l.l_partkey % 24 AS INTEGER)) AS created,
         CAST(l.l_tax >= 0.075 AS INTEGER) AS is_test_errand,
         CASE WHEN l.l_quantity <> 1 THEN 'cat' || (l.l_suppkey % 12) END AS errand_category,
         CASE l.l_partkey % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'phone' WHEN 2 THEN 'email'
                              ELSE 'form' END AS errand_channel
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_discount >= CASE WHEN o.o_custkey % 10 = 0 THEN 0.025
                             WHEN o.o_custkey % 7 = 0 THEN 0.045 ELSE 0.085 END
),
contacts AS (
  SELECT *, CASE WHEN regexp_full_match(order_number, '[0-9A-Za-z]{{1,12}}') THEN
      CAST(list_sum(list_transform(range(1, length(order_number) + 1), lambda i:
        (strpos('{DIGITS}', upper(order_number[i:i])) - 1)
        * pow(36, length(order_number) - i))) AS BIGINT) END AS order_id
  FROM raw WHERE is_test_errand = 0
),
counts AS (
  SELECT order_id, count(*) AS n_contacts FROM contacts WHERE order_id IS NOT NULL GROUP BY order_id
),
linked AS (
  SELECT b.*, coalesce(k.n_contacts, 0) AS n_contacts,
         CAST(k.n_contacts IS NOT NULL AS INTEGER) AS contacted
  FROM bookings b LEFT JOIN counts k USING (order_id)
),
firsts AS (
  SELECT c.order_id, count(*) AS n_contacts, min(c.created) AS first_at,
         arg_min(errand_category, (created IS NULL, created, errand_id, errand_category))
           FILTER (WHERE errand_category IS NOT NULL) AS first_category
  FROM contacts c WHERE c.order_id IS NOT NULL GROUP BY c.order_id
),
first_linked AS (
  SELECT f.*, b.order_created_at,
         (epoch_us(first_at) - epoch_us(b.order_created_at)) / 1000000.0::DOUBLE / 3600.0::DOUBLE
           AS hours_ttfc
  FROM firsts f LEFT JOIN bookings b USING (order_id)
),
ttfc AS (SELECT order_id, hours_ttfc FROM first_linked WHERE hours_ttfc >= 0)
"""

DIMENSIONS = ["brand", "device", "journey_type_id", "customer_group_type", "client_entry_type"]
FACTORS = ["is_canceled", "is_changed", "customer_group_type", "journey_type_id"]
CATEGORICAL = [
    "brand", "booking_system", "customer_group_type", "device", "client_entry_type",
    "booking_system_source_type", "journey_type_id", "site_country", "currency",
]


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([INPUTS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _upper_tail(z: str) -> str:
    """P(Z >= z): continued fraction of the Mills ratio, evaluated from its far end."""
    positive = (
        f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) / "
        f"list_reduce(range(3000, 0, -1), lambda acc, k: abs({z}) + k / acc, abs({z}) + 55.0::DOUBLE)"
    )
    return f"CASE WHEN {z} >= 0 THEN {positive} ELSE 1 - {positive} END"


def _chi2_tail(x: str, dof: str) -> str:
    """P(X >= x) by the finite sums for even and odd degrees of freedom."""
    even = (
        f"exp(-{x} / 2) * list_sum(list_transform(range(0, ({dof}) // 2), "
        f"lambda i: pow({x} / 2, i) / gamma(i + 1.0::DOUBLE)))"
    )
    odd = (
        f"2 * ({_upper_tail(f'sqrt({x})')}) + coalesce(sqrt(2 * {x} / pi()) * exp(-{x} / 2) * "
        f"list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda i: pow({x}, i) * pow(2, i) "
        f"* gamma(i + 1.0::DOUBLE) / gamma(2.0::DOUBLE * i + 2))), 0)"
    )
    return f"CASE WHEN {dof} = 0 THEN 1.0::DOUBLE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END"


def _long(source: str, dims: list[str], cols: str) -> str:
    return _union(
        [
            f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, {cols} FROM {source}"
            for d in dims
        ]
    )


def _rates(source: str, dims: list[str]) -> str:
    return f"""
rates AS (
  SELECT dimension, level, CAST(sum(contacted) AS BIGINT) AS contacts, count(contacted) AS orders,
         avg(contacted) AS contact_rate
  FROM ({_long(source, dims, 'contacted')}) WHERE level IS NOT NULL GROUP BY dimension, level
)"""


def _chi2_ctes(source: str, factors: list[str], outcome: str) -> list[str]:
    long = _union(
        [
            f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, {outcome} AS y FROM {source}"
            for f in factors
        ]
    )
    return [
        f"obs AS (SELECT factor, level, y, count(*) AS o FROM ({long}) "
        "WHERE level IS NOT NULL AND y IS NOT NULL GROUP BY ALL)",
        "lev AS (SELECT factor, level, sum(o) AS r FROM obs GROUP BY ALL)",
        "out AS (SELECT factor, y, sum(o) AS c FROM obs GROUP BY ALL)",
        "tot AS (SELECT factor, sum(o) AS n, (count(DISTINCT level) - 1) * (count(DISTINCT y) - 1) "
        "AS dof FROM obs GROUP BY factor)",
        "cell AS (SELECT factor, dof, n, coalesce(o, 0)::DOUBLE AS o, "
        "r::DOUBLE * c::DOUBLE / n::DOUBLE AS e "
        "FROM lev JOIN out USING (factor) JOIN tot USING (factor) "
        "LEFT JOIN obs USING (factor, level, y))",
        "gap AS (SELECT factor, dof, n, e, CASE WHEN dof = 1 THEN "
        "greatest(abs(o - e) - least(0.5::DOUBLE, abs(o - e)), 0) ELSE abs(o - e) END AS d FROM cell)",
        "chi AS (SELECT factor, dof, CAST(n AS BIGINT) AS n, sum(d * d / e) AS x "
        "FROM gap GROUP BY ALL)",
    ]


def _chi2(source: str, factor: str, outcome: str, *before: str) -> str:
    return _sql(
        f"""SELECT factor, round(x, 4) AS statistic, CAST(dof AS BIGINT) AS dof, n,
        round({_chi2_tail('x', 'dof')}, 6) AS p_value FROM chi""",
        *before,
        *_chi2_ctes(source, [factor], outcome),
    )


def _mwu_ctes(source: str, value: str, x: str, y: str, side: str) -> list[str]:
    """Average ranks, then U from the rank sum of the first group."""
    return [
        f"""pooled AS (SELECT {value} AS v, {side} AS g FROM {source}
            WHERE {side} IN ({x}, {y}) AND {value} IS NOT NULL)""",
        f"""vals AS (SELECT v, count(*) AS t, count(*) FILTER (g = {x}) AS n1,
            count(*) FILTER (g = {y}) AS n2 FROM pooled GROUP BY v)""",
        f"""ranked AS (SELECT *, sum(t) OVER (ORDER BY v) - (t - 1) / 2.0::DOUBLE AS r
            FROM vals)""",
        f"""sums AS (SELECT CAST(sum(n1) AS BIGINT) AS n_x, CAST(sum(n2) AS BIGINT) AS n_y,
            sum(n1 * r) - sum(n1)::DOUBLE * (sum(n1)::DOUBLE + 1) / 2 AS u,
            sum(t::DOUBLE * t * t - t) AS ties FROM ranked)""",
        f"""test AS (SELECT *, n_x::DOUBLE * n_y AS pairs, sqrt(n_x::DOUBLE * n_y / 12 *
            ((n_x + n_y + 1) - ties / ((n_x + n_y)::DOUBLE * (n_x + n_y - 1)))) AS sd
            FROM sums)""",
    ]


def _mwu_select(two_sided: bool, extra: str = "") -> str:
    u = "greatest(u, pairs - u)" if two_sided else "u"
    tail = _upper_tail("z")
    p = f"least(1.0::DOUBLE, 2 * ({tail}))" if two_sided else tail
    return f"""SELECT u AS statistic, n_x, n_y, round(z, 6) AS z, round(p, 6) AS p_value,
        'asymptotic' AS method, CAST(p < 0.05 AS INTEGER) AS reject {extra}
        FROM (SELECT *, {p} AS p FROM
          (SELECT *, ({u} - pairs / 2 - 0.5) / sd AS z FROM test))"""


def _hash(key: str = "order_id") -> str:
    return f"substr(md5('42|' || {key}), 1, 15)"


def _kth(source: str, value: str, rank: str) -> str:
    """The value at a 0-based position of the sorted column."""
    return (
        f"(SELECT {value} FROM (SELECT {value}, row_number() OVER (ORDER BY {value}) - 1 AS p, "
        f"count(*) OVER () AS n FROM {source} WHERE {value} IS NOT NULL) WHERE p = {rank})"
    )


NAMED = ["cat0", "cat1", "cat2", "cat3", "cat4"]
SERIES = [*NAMED, "Other"]

VALUE_SPLIT = """
split AS (
  SELECT *, CASE WHEN order_amount > m THEN 'high' WHEN order_amount <= m THEN 'low' END
    AS value_group
  FROM linked, (SELECT median(CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END) AS m
                FROM linked))
"""

RULED = """
ruled AS (SELECT *, is_canceled * 2 + is_changed AS cluster,
            ln(1 + CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END) AS order_amt_log
          FROM linked)
"""


def _winsor(source: str, group: str, alias: str) -> str:
    return f"""
{alias} AS (
  SELECT {group}, avg(least(x, cap)) AS w FROM
    (SELECT {group}, CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END AS x FROM {source})
    JOIN (SELECT {group}, quantile_cont(CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END, 0.95)
            AS cap FROM {source} GROUP BY {group}) USING ({group})
  WHERE x IS NOT NULL
  GROUP BY {group})"""


PROFILE = [
    RULED,
    _winsor("ruled", "cluster", "amounts"),
    """
profile AS (
  SELECT cluster, count(*) AS n, avg(contacted) AS contact_rate, avg(n_contacts) AS avg_contacts,
         avg(is_canceled) AS cancel_rate, avg(is_changed) AS change_rate,
         avg(CASE WHEN customer_group_type = 'FAMILY' THEN 1 ELSE 0 END) AS pct_family,
         avg(CASE WHEN journey_type_id = 'Round-trip' THEN 1 ELSE 0 END) AS pct_roundtrip,
         any_value(w) AS avg_order_amt
  FROM ruled JOIN amounts USING (cluster) GROUP BY cluster)
""",
]

PROFILE_RATES = ["contact_rate", "cancel_rate", "change_rate", "pct_family", "pct_roundtrip"]

SCORED = """
scored AS (
  SELECT order_id, contacted AS label,
         (('0x' || substr(md5('42|' || order_id), 1, 15))::BIGINT % 997)::DOUBLE / 997.0::DOUBLE
           + is_canceled::DOUBLE * 0.25::DOUBLE AS score
  FROM linked),
points AS (
  SELECT score AS threshold,
         sum(count(*) FILTER (label = 1)) OVER (ORDER BY score DESC) AS tp,
         sum(count(*) FILTER (label = 0)) OVER (ORDER BY score DESC) AS fp,
         count(*) FILTER (label = 1) AS pos
  FROM scored GROUP BY score),
sizes AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored)
"""

CELLS = """
cells AS (SELECT errand_channel, errand_category, count(*) AS n FROM contacts
          WHERE errand_channel IS NOT NULL AND errand_category IS NOT NULL GROUP BY ALL)
"""

MONTH_CELLS = """
cells AS (SELECT CAST(date_trunc('month', created) AS DATE) AS month, errand_category, count(*) AS n
          FROM contacts WHERE created IS NOT NULL AND errand_category IS NOT NULL GROUP BY ALL)
"""


def _top(k: int) -> str:
    return f"""
top AS (SELECT errand_category FROM cells GROUP BY errand_category
        ORDER BY sum(n) DESC, errand_category LIMIT {k})"""


WINDOW = "(SELECT max(order_created_at) FROM bookings) + INTERVAL {days} DAY"

REPEATS = """
per_order AS (SELECT order_id, n_contacts, first_category, CAST(n_contacts > 1 AS INTEGER) AS is_repeat
              FROM firsts),
ranking AS (SELECT first_category, avg(is_repeat) AS repeat_rate, count(*) AS volume FROM per_order
            WHERE first_category IS NOT NULL GROUP BY first_category HAVING count(*) > 50)
"""

FIRST_RANK = """
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY {rate} DESC, {key}) AS a,
              row_number() OVER (ORDER BY {rate}, {key} DESC) AS z FROM {source})
  WHERE a <= 8 OR z <= 4
"""

ORACLES: dict[str, str] = {
    # Scans and sinks
    "table_shape": "SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE orders)) AS n_columns "
    "FROM orders",
    "csv_round_trip": _sql(
        """SELECT count(*) AS n_rows, CAST(sum(order_id) AS BIGINT) AS sum_id,
        count(order_amount) AS amounts, max(order_amount) AS max_amount,
        min(order_created_at) AS first_time, max(order_created_at) AS last_time,
        CAST(sum(is_canceled) AS BIGINT) AS canceled, count(partner) AS partners FROM bookings"""
    ),
    "key_stats": _sql(
        _union(
            [
                "SELECT 'contact_rate' AS metric, avg(contacted) AS value FROM linked",
                "SELECT 'cancelled_contact_rate', avg(contacted) FROM linked WHERE is_canceled = 1",
                "SELECT 'changed_contact_rate', avg(contacted) FROM linked WHERE is_changed = 1",
                "SELECT 'normal_contact_rate', avg(contacted) FROM linked "
                "WHERE is_canceled = 0 AND is_changed = 0",
                "SELECT 'orders', CAST(count(*) AS DOUBLE) FROM linked",
                "SELECT 'real_contacts', CAST(count(*) AS DOUBLE) FROM contacts",
                "SELECT 'repeat_share', avg(CAST(n_contacts >= 2 AS INTEGER)) FROM counts",
            ]
        )
    ),
    # Projection, parsing, cleaning
    "parse_times": _sql(
        "SELECT order_id, CASE WHEN order_id % 11 <> 0 THEN order_created_at END AS parsed FROM bookings"
    ),
    "parse_times_strict": _sql("SELECT order_id, order_created_at AS parsed FROM bookings"),
    "decode_keys": _sql("SELECT errand_id, order_number, order_id FROM contacts"),
    "decode_keys_strict": _sql(
        "SELECT order_id, upper(to_base(order_id, 36)) AS text, order_id AS decoded FROM bookings"
    ),
    "decode_audit": _sql(
        """SELECT count(*) AS real_contacts, count(*) FILTER (c.order_id IS NULL) AS failed_decodes,
        count(b.order_id) AS matched, count(q.order_id) AS raw_matched,
        count(b.order_id)::DOUBLE / count(*) AS match_rate,
        count(q.order_id)::DOUBLE / count(*) AS raw_match_rate
        FROM contacts c LEFT JOIN bookings b ON c.order_id = b.order_id
        LEFT JOIN bookings q ON TRY_CAST(c.order_number AS BIGINT) = q.order_id"""
    ),
    "audit_by_period": _sql(
        """SELECT m.metric, CAST(m.n AS BIGINT) AS n, m.n::DOUBLE / s.n_rows * 100 AS pct FROM s, LATERAL (VALUES
          ('n_rows', s.n_rows), ('nulls_order_number', s.a), ('nulls_errand_category', s.b),
          ('nulls_errand_channel', s.c), ('rule_test', s.d), ('rule_undecodable', s.e),
          ('repeated_keys', s.f)) AS m(metric, n)""",
        """s AS (SELECT count(*) AS n_rows, count(*) FILTER (order_number IS NULL) AS a,
          count(*) FILTER (errand_category IS NULL) AS b, count(*) FILTER (errand_channel IS NULL) AS c,
          count(*) FILTER (is_test_errand = 1) AS d, count(*) FILTER (order_number LIKE '#%') AS e,
          count(*) - count(DISTINCT errand_id) AS f FROM raw)""",
    ),
    "sketch_ranks": _sql(
        """SELECT customer_group_type, prob, n, TRUE AS rank_is_near
        FROM (SELECT customer_group_type, count(order_amount) AS n FROM bookings GROUP BY 1),
          (SELECT unnest([0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS prob)"""
    ),
    "test_burst": _sql(
        """SELECT first_period, last_period, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS flagged,
        round((CASE WHEN c > 0 THEN c * ln(c / n) ELSE 0 END + CASE WHEN c < n THEN (n - c) * ln((n - c) / n) ELSE 0 END)
          + (CASE WHEN oc > 0 THEN oc * ln(oc / o) ELSE 0 END + CASE WHEN oc < o THEN (o - oc) * ln((o - oc) / o) ELSE 0 END)
          - (CASE WHEN ac > 0 THEN ac * ln(ac / a) ELSE 0 END + CASE WHEN ac < a THEN (a - ac) * ln((a - ac) / a) ELSE 0 END), 6) AS ratio, TRUE AS p_is_share
        FROM w WHERE o > 0 AND c * o > oc * n
        ORDER BY round((CASE WHEN c > 0 THEN c * ln(c / n) ELSE 0 END + CASE WHEN c < n THEN (n - c) * ln((n - c) / n) ELSE 0 END) + (CASE WHEN oc > 0 THEN oc * ln(oc / o) ELSE 0 END + CASE WHEN oc < o THEN (o - oc) * ln((o - oc) / o) ELSE 0 END), 9) DESC, first_period, last_period LIMIT 1""",
        """e AS (SELECT CAST(date_trunc('week', created) AS DATE) AS period, count(*) AS n,
          count(*) FILTER (is_test_errand = 1) AS c FROM raw WHERE created IS NOT NULL GROUP BY 1),
        s AS (SELECT period, n, c, sum(n) OVER (ORDER BY period) AS nt, sum(c) OVER (ORDER BY period) AS ct FROM e),
        t AS (SELECT sum(n)::DOUBLE AS a, sum(c)::DOUBLE AS ac FROM e),
        w AS (SELECT x.period AS first_period, y.period AS last_period, (y.nt - x.nt + x.n)::DOUBLE AS n,
          (y.ct - x.ct + x.c)::DOUBLE AS c, a, ac, a - (y.nt - x.nt + x.n) AS o, ac - (y.ct - x.ct + x.c) AS oc
          FROM s x JOIN s y ON x.period <= y.period, t)""",
    ),
    "test_flag_audit": _sql(
        """SELECT count(*) AS contacts, count(*) FILTER (is_test_errand = 1) AS test_contacts,
        count(*) FILTER (is_test_errand = 0) AS real_contacts,
        count(*) FILTER (is_test_errand = 1)::DOUBLE / count(*) * 100 AS test_pct FROM raw"""
    ),
    "in_window": _sql(
        f"SELECT errand_id, created, order_id FROM contacts WHERE created <= {WINDOW.format(days=30)}"
    ),
    "clipped_values": _sql(
        """SELECT order_id, CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END AS amount_floor,
        least(n_contacts, 3) AS contacts_capped FROM linked"""
    ),
    "fill_missing": _sql(
        """SELECT order_id, coalesce(client_entry_type, 'Unknown') AS client_entry_type,
        coalesce(partner, 'Unknown') AS partner, coalesce(order_amount, 0) AS order_amount
        FROM bookings"""
    ),
    "scalar_functions": _sql(
        """SELECT order_id,
        round(ln(1 + CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END), 9) AS order_amt_log,
        CAST(partner IS NULL AS INTEGER) AS is_direct,
        CASE is_canceled WHEN 0 THEN 'Not Cancelled' ELSE 'Cancelled' END AS cancel_label,
        order_created_at + INTERVAL 90 DAY AS plus_90,
        CAST(order_created_at AS DATE) AS created_date,
        round_even(order_amount / 1000, 3) AS amount_k FROM bookings"""
    ),
    # Data quality
    "null_counts": _sql(
        'SELECT * FROM ('
        + _union(
            [
                f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM bookings"
                for c in ["order_amount", "client_entry_type", "partner", "brand", "revenue"]
            ]
        )
        + ") WHERE nulls > 0"
    ),
    "null_counts_contacts": _sql(
        'SELECT * FROM ('
        + _union(
            [
                f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM contacts"
                for c in ["order_number", "order_id", "errand_category", "errand_channel", "created"]
            ]
        )
        + ") WHERE nulls > 0"
    ),
    "duplicate_keys": _sql(
        _union(
            [
                "SELECT 'order_id' AS key, count(*) - count(DISTINCT order_id) AS duplicates FROM bookings",
                "SELECT 'errand_id', count(*) - count(DISTINCT errand_id) FROM raw",
            ]
        )
    ),
    "threshold_audit": _sql(
        _union(
            [
                f"SELECT '{name}' AS rule, count(*) FILTER ({cond}) AS n, "
                f"count(*) FILTER ({cond})::DOUBLE / count(*) * 100 AS pct FROM bookings"
                for name, cond in [
                    ("negative_amount", "order_amount < 0"),
                    ("negative_revenue", "revenue < 0"),
                    ("extreme_amount", "order_amount > 1000000"),
                    ("amount_above_400k", "order_amount > 400000"),
                ]
            ]
        )
    ),
    "date_coverage": _sql(
        """SELECT *, CAST(first_date - (SELECT CAST(min(order_created_at) AS DATE) FROM bookings) AS INTEGER)
          AS first_gap_days,
        CAST(last_date - (SELECT CAST(max(order_created_at) AS DATE) FROM bookings) AS INTEGER)
          AS last_gap_days FROM ("""
        + _union(
            [
                """SELECT 'orders' AS "table", CAST(min(order_created_at) AS DATE) AS first_date,
                CAST(max(order_created_at) AS DATE) AS last_date FROM bookings""",
                "SELECT 'contacts', CAST(min(created) AS DATE), CAST(max(created) AS DATE) FROM raw",
            ]
        )
        + ")"
    ),
    "test_share_by_month": _sql(
        """SELECT CAST(date_trunc('month', created) AS DATE) AS period, count(*) AS n,
        count(*) FILTER (is_test_errand = 1) AS flagged,
        count(*) FILTER (is_test_errand = 1)::DOUBLE / count(*) AS flag_share FROM raw GROUP BY 1"""
    ),
    # Links
    "contact_flag": _sql(
        """SELECT order_id, CAST(order_id IN (SELECT order_id FROM contacts WHERE order_id IS NOT NULL)
        AS INTEGER) AS contacted FROM bookings"""
    ),
    "contact_counts": _sql("SELECT order_id, n_contacts, contacted FROM linked"),
    "contacts_per_order": _sql("SELECT order_id, n_contacts FROM counts"),
    "link_contacts": _sql(
        """SELECT errand_id, c.order_id, order_created_at,
        (epoch_us(created) - epoch_us(order_created_at)) / 1000000.0::DOUBLE / 3600.0::DOUBLE
          AS hours_to_contact
        FROM contacts c LEFT JOIN bookings b ON c.order_id = b.order_id"""
    ),
    "uncontacted_orders": _sql("SELECT order_id, device FROM linked WHERE n_contacts = 0"),
    "uncontacted_share": _sql(
        """SELECT count(*) AS orders, count(*) FILTER (contacted = 0) AS uncontacted,
        count(*) FILTER (contacted = 0)::DOUBLE / count(*) * 100 AS uncontacted_pct FROM linked"""
    ),
    "orphan_contacts": _sql(
        """SELECT errand_id, order_number, c.order_id FROM contacts c
        WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.order_id = c.order_id)"""
    ),
    # Rates
    "contact_baseline": _sql(
        """SELECT count(*) AS orders, CAST(sum(contacted) AS BIGINT) AS contacted_orders,
        avg(contacted) AS contact_rate, (SELECT count(*) FROM counts) AS contacted_keys,
        (SELECT avg(n_contacts) FROM counts) AS mean_contacts,
        (SELECT avg(CAST(n_contacts >= 2 AS INTEGER)) FROM counts) AS repeat_share FROM linked"""
    ),
    "top_share": _sql(
        """SELECT threshold, CAST(sum(n_contacts) AS BIGINT) AS top_contacts,
        (SELECT count(*) FROM contacts) AS contacts,
        sum(n_contacts)::DOUBLE / (SELECT count(*) FROM contacts) AS top_share
        FROM counts, (SELECT quantile_cont(n_contacts::DOUBLE, 0.9) AS threshold FROM counts)
        WHERE n_contacts >= threshold GROUP BY threshold"""
    ),
    "rate_by_dimension": _sql("SELECT * FROM rates", _rates("linked", DIMENSIONS)),
    "rate_by_factor_baseline": _sql(
        """SELECT rates.*, o AS overall_rate, CAST(contact_rate > o AS INTEGER) AS above_overall
        FROM rates, (SELECT avg(contacted) AS o FROM linked)""",
        _rates("linked", FACTORS),
    ),
    "extreme_levels": _sql(
        """SELECT dimension,
        first(level ORDER BY contact_rate DESC, level) AS highest_level, max(contact_rate) AS highest_rate,
        first(level ORDER BY contact_rate, level) AS lowest_level, min(contact_rate) AS lowest_rate
        FROM rates GROUP BY dimension""",
        _rates("linked", DIMENSIONS),
    ),
    "rate_grid": _sql(
        """SELECT is_canceled, is_changed, count(*) AS orders, avg(contacted) AS contact_rate
        FROM linked GROUP BY 1, 2"""
    ),
    "rate_grid_wide": _sql(
        """SELECT is_canceled, avg(contacted) FILTER (is_changed = 0) AS is_changed_0,
        avg(contacted) FILTER (is_changed = 1) AS is_changed_1 FROM linked GROUP BY 1"""
    ),
    "disruption_rates": _sql(
        """SELECT CASE WHEN is_canceled = 1 THEN 'cancelled' WHEN is_changed = 1 THEN 'changed only'
        ELSE 'neither' END AS disruption, count(*) AS orders, avg(contacted) AS contact_rate
        FROM linked GROUP BY 1"""
    ),
    "count_histogram": _sql(
        "SELECT least(n_contacts, 5) AS n_contacts, count(*) AS orders FROM counts GROUP BY 1"
    ),
    "winsor_mean": _sql(
        """SELECT brand, count(*) AS n, round(any_value(w), 4) AS winsor_mean
        FROM bookings JOIN amounts USING (brand) GROUP BY brand""",
        _winsor("bookings", "brand", "amounts"),
    ),
    "median_amount": _sql("SELECT median(order_amount) AS median FROM bookings"),
    "quantiles_by_group": _sql(
        """SELECT customer_group_type, count(order_amount) AS n,
        round(quantile_cont(order_amount, 0.05), 6) AS p05,
        round(quantile_cont(order_amount, 0.5), 6) AS p50,
        round(quantile_cont(order_amount, 0.95), 6) AS p95
        FROM bookings GROUP BY customer_group_type"""
    ),
    "kpis": _sql(
        _union(
            [
                "SELECT 'contact_rate' AS metric, CAST(NULL AS VARCHAR) AS label, "
                "avg(contacted) AS value FROM linked",
                "SELECT 'repeat_share', NULL, avg(CAST(n_contacts >= 2 AS INTEGER)) FROM counts",
                "SELECT 'channel_share', 'phone', "
                "count(*) FILTER (errand_channel = 'phone')::DOUBLE / count(*) FROM contacts",
                *[
                    f"(SELECT '{metric}', {col}, count(*)::DOUBLE / (SELECT count(*) FROM {source}) "
                    f"FROM {source} WHERE {col} IS NOT NULL GROUP BY {col} "
                    f"ORDER BY count(*) DESC, {col} LIMIT 1)"
                    for metric, source, col in [
                        ("top_channel", "contacts", "errand_channel"),
                        ("top_category", "contacts", "errand_category"),
                        ("largest_brand", "linked", "brand"),
                    ]
                ],
            ]
        )
    ),
    "lorenz": _sql(
        """SELECT n_contacts, count(*) AS orders,
        sum(count(*)) OVER (ORDER BY n_contacts)::DOUBLE / (SELECT count(*) FROM counts) AS cum_orders,
        sum(sum(n_contacts)) OVER (ORDER BY n_contacts)::DOUBLE
          / (SELECT sum(n_contacts) FROM counts) AS cum_contacts
        FROM counts GROUP BY n_contacts"""
    ),
    # Volumes and mixes
    "weekly_volume": _sql(
        """SELECT CAST(date_trunc('week', created) AS DATE) AS period, count(*) AS contacts
        FROM contacts WHERE created IS NOT NULL GROUP BY 1"""
    ),
    "weekly_rate": _sql(
        """SELECT CAST(date_trunc('week', order_created_at) AS DATE) AS period,
        count(order_id) AS orders, CAST(sum(contacted) AS BIGINT) AS contacted_orders,
        sum(contacted)::DOUBLE / count(order_id) AS contact_rate FROM linked GROUP BY 1"""
    ),
    "top_categories": _sql(
        """SELECT errand_category, count(*) AS n FROM contacts WHERE errand_category IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6"""
    ),
    "keep_top_categories": _sql(
        """SELECT errand_id, errand_category FROM contacts WHERE errand_category IN
        (SELECT errand_category FROM contacts WHERE errand_category IS NOT NULL GROUP BY 1
         ORDER BY count(*) DESC, 1 LIMIT 4)"""
    ),
    "monthly_mix_all_denom": _sql(
        """SELECT m.month, t.errand_category, coalesce(c.n, 0) AS n,
        coalesce(c.n, 0)::DOUBLE / m.total * 100 AS pct
        FROM (SELECT month, sum(n) AS total FROM cells GROUP BY month) m CROSS JOIN top t
        LEFT JOIN cells c ON c.month = m.month AND c.errand_category = t.errand_category""",
        MONTH_CELLS,
        _top(6),
    ),
    "channel_mix_top_denom": _sql(
        """SELECT m.errand_channel, t.errand_category, coalesce(c.n, 0) AS n,
        coalesce(c.n, 0)::DOUBLE / m.total * 100 AS pct
        FROM (SELECT errand_channel, sum(n) AS total FROM cells
              WHERE errand_category IN (SELECT errand_category FROM top) GROUP BY 1) m
        CROSS JOIN top t
        LEFT JOIN cells c ON c.errand_channel = m.errand_channel
                         AND c.errand_category = t.errand_category""",
        CELLS,
        _top(8),
    ),
    "channel_share_quarter": _sql(
        """SELECT m.period, t.errand_channel, coalesce(c.n, 0) AS n,
        coalesce(c.n, 0)::DOUBLE / m.total * 100 AS pct
        FROM (SELECT period, sum(n) AS total FROM q GROUP BY 1) m
        CROSS JOIN (SELECT DISTINCT errand_channel FROM q) t
        LEFT JOIN q c ON c.period = m.period AND c.errand_channel = t.errand_channel""",
        """q AS (SELECT CAST(date_trunc('quarter', created) AS DATE) AS period, errand_channel,
        count(*) AS n FROM contacts WHERE created IS NOT NULL AND errand_channel IS NOT NULL
        GROUP BY 1, 2)""",
    ),
    "share_within_channel": _sql(
        """SELECT errand_channel, errand_category, n,
        n::DOUBLE / sum(n) OVER (PARTITION BY errand_channel)::DOUBLE AS share FROM cells""",
        CELLS,
    ),
    "cross_counts_wide": _sql(
        "PIVOT crossed ON errand_category USING count(*) GROUP BY errand_channel",
        """crossed AS (SELECT errand_channel, errand_category FROM contacts
        WHERE errand_category IS NOT NULL AND errand_channel IS NOT NULL)""",
    ),
    "contingency": _sql(
        """SELECT l.level, o.outcome, count(k.contacted) AS n
        FROM (SELECT DISTINCT customer_group_type AS level FROM linked) l
        CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS outcome) o
        LEFT JOIN linked k ON k.customer_group_type = l.level AND k.contacted = o.outcome
        GROUP BY 1, 2"""
    ),
    "monthly_named_other": _sql(
        f"""SELECT period, total, CAST(position AS INTEGER) AS position, series, contacts,
        CAST(coalesce(sum(contacts) OVER (PARTITION BY period ORDER BY position
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
        FROM (SELECT m.period, m.total, s.position, s.series, count(c.series) AS contacts
              FROM (SELECT period, count(*) AS total FROM named GROUP BY 1) m
              CROSS JOIN (SELECT unnest(range(0, {len(SERIES)})) AS position,
                                 unnest({SERIES}) AS series) s
              LEFT JOIN named c ON c.period = m.period AND c.series = s.series
              GROUP BY 1, 2, 3, 4)""",
        f"""named AS (SELECT CAST(date_trunc('month', created) AS DATE) AS period,
        CASE WHEN errand_category IN ({', '.join(repr(c) for c in NAMED)}) THEN errand_category
             ELSE 'Other' END AS series
        FROM contacts WHERE created IS NOT NULL AND errand_category IS NOT NULL)""",
    ),
    "linkage_report": _sql(
        f"""SELECT 'real_contacts' AS metric, n, n::DOUBLE / n * 100 AS pct FROM w
        UNION ALL SELECT 'in_window', inside, inside::DOUBLE / n * 100 FROM w
        UNION ALL SELECT 'out_of_window', n - inside, (n - inside)::DOUBLE / n * 100 FROM w
        UNION ALL SELECT 'orders_without_contact', count(*) FILTER (contacted = 0),
          count(*) FILTER (contacted = 0)::DOUBLE / count(*) * 100 FROM linked""",
        f"""w AS (SELECT count(*) AS n, count(*) FILTER (created <= {WINDOW.format(days=90)}) AS inside
        FROM contacts)""",
    ),
    "out_of_window_span": _sql(
        f"""SELECT CAST(min(created) AS DATE) AS first_date, CAST(max(created) AS DATE) AS last_date
        FROM contacts WHERE NOT coalesce(created <= {WINDOW.format(days=30)}, FALSE)"""
    ),
    "out_of_window_categories": _sql(
        f"""SELECT errand_category, count(*) AS n FROM contacts
        WHERE NOT coalesce(created <= {WINDOW.format(days=30)}, FALSE) AND errand_category IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6"""
    ),
    "head_tail": _sql(
        "SELECT level, orders, contact_rate FROM ("
        + FIRST_RANK.format(rate="contact_rate", key="level", source="rates")
        + ")",
        _rates("linked", ["currency"]),
    ),
    "union_results": _sql(
        """SELECT 'disruption' AS report, CASE WHEN is_canceled = 1 THEN 'cancelled'
          WHEN is_changed = 1 THEN 'changed only' ELSE 'neither' END AS disruption,
          count(*) AS orders, avg(contacted) AS contact_rate,
          CAST(NULL AS INTEGER) AS is_canceled, CAST(NULL AS INTEGER) AS is_changed,
          CAST(NULL AS BIGINT) AS contacted_orders, CAST(NULL AS BIGINT) AS contacted_keys,
          CAST(NULL AS DOUBLE) AS mean_contacts, CAST(NULL AS DOUBLE) AS repeat_share
          FROM linked GROUP BY 2
        UNION ALL SELECT 'grid', NULL, count(*), avg(contacted), l.is_canceled, l.is_changed,
          NULL, NULL, NULL, NULL FROM linked l GROUP BY l.is_canceled, l.is_changed
        UNION ALL SELECT 'baseline', NULL, count(*), avg(contacted), NULL, NULL,
          CAST(sum(contacted) AS BIGINT), (SELECT count(*) FROM counts),
          (SELECT avg(n_contacts) FROM counts),
          (SELECT avg(CAST(n_contacts >= 2 AS INTEGER)) FROM counts) FROM linked"""
    ),
    # Time to first contact and repeats
    "first_contact": _sql(
        """SELECT order_id, n_contacts, first_at, first_category, order_created_at, hours_ttfc
        FROM first_linked"""
    ),
    "ttfc_hours": _sql("SELECT order_id, hours_ttfc FROM ttfc"),
    "ttfc_summary": _sql(
        """SELECT count(*) AS n, avg(CAST(hours_ttfc <= 24 AS INTEGER)) AS within_24h,
        avg(CAST(hours_ttfc <= 48 AS INTEGER)) AS within_48h, median(hours_ttfc) AS median_hours,
        median(hours_ttfc) / 24 AS median_days FROM ttfc"""
    ),
    "order_statistic": _sql(
        f"""SELECT count(*) AS n,
        {_kth('ttfc', 'hours_ttfc', 'CAST(floor(n::DOUBLE * 0.99::DOUBLE) AS BIGINT)')} AS value
        FROM ttfc"""
    ),
    "survival_curve": _sql(
        f"""SELECT point, round(t, 6) AS hours, count(hours_ttfc) AS at_risk,
        count(hours_ttfc)::DOUBLE / (SELECT count(*) FROM ttfc) AS survival
        FROM (SELECT range AS point, CASE WHEN range = 499 THEN top
                ELSE range::DOUBLE * (top / 499.0::DOUBLE) END AS t
              FROM range(0, 500),
                (SELECT {_kth('ttfc', 'hours_ttfc', 'CAST(floor(n::DOUBLE * 0.99::DOUBLE) AS BIGINT)')}
                   AS top))
        LEFT JOIN ttfc ON hours_ttfc >= t GROUP BY point, t"""
    ),
    "survival_steps": _sql(
        """SELECT hours_ttfc AS hours, count(*) AS n,
        CAST(sum(count(*)) OVER (ORDER BY hours_ttfc DESC) AS BIGINT) AS at_risk,
        sum(count(*)) OVER (ORDER BY hours_ttfc DESC)::DOUBLE / (SELECT count(*) FROM ttfc) AS survival
        FROM ttfc GROUP BY hours_ttfc"""
    ),
    "ttfc_histogram": _sql(
        """SELECT b AS bin, round(lo + (b - 1) * (hi - lo) / 50, 6) AS left_edge, count(days) AS n,
        round((SELECT median(days) FROM d), 6) AS median_days
        FROM (SELECT range AS b FROM range(1, 51)), (SELECT min(days) AS lo, max(days) AS hi FROM d)
        LEFT JOIN d ON least(floor((days - lo) * 50.0::DOUBLE / (hi - lo)) + 1, 50) = b
        GROUP BY b, lo, hi""",
        "d AS (SELECT hours_ttfc / 24 AS days FROM ttfc WHERE hours_ttfc <= 720)",
    ),
    "amount_histogram": _sql(
        """SELECT b AS bin, round(lo + (b - 1) * (hi - lo) / 50, 4) AS left_edge,
        round(lo + b * (hi - lo) / 50, 4) AS right_edge, count(order_amount) AS n
        FROM (SELECT range AS b FROM range(1, 51)),
          (SELECT min(order_amount) AS lo, max(order_amount) AS hi FROM bookings)
        LEFT JOIN bookings
          ON least(floor((order_amount - lo) * 50.0::DOUBLE / (hi - lo)) + 1, 50) = b
        GROUP BY b, lo, hi"""
    ),
    "repeat_by_first": _sql("SELECT first_category, repeat_rate, volume FROM ranking", REPEATS),
    "overall_repeat": _sql(
        "SELECT count(*) AS contacted_keys, avg(is_repeat) AS repeat_share FROM per_order", REPEATS
    ),
    # Samples and tests
    "sample_n": _sql(
        f"SELECT order_id, order_amount FROM bookings ORDER BY {_hash()}, order_id LIMIT 5000"
    ),
    "sample_per_group": _sql(
        f"""SELECT order_id, device FROM (SELECT order_id, device, row_number() OVER
        (PARTITION BY device ORDER BY {_hash()}, order_id) AS rn FROM bookings) WHERE rn <= 200"""
    ),
    "stratified_split": _sql(
        f"""SELECT order_id, contacted, CAST(rn <= round(n * 0.2::DOUBLE) AS INTEGER) AS is_test FROM
        (SELECT order_id, contacted, count(*) OVER (PARTITION BY contacted) AS n, row_number() OVER
        (PARTITION BY contacted ORDER BY {_hash()}, order_id) AS rn FROM linked)"""
    ),
    **{f"chi2_{f}": _chi2("linked", f, "contacted") for f in [*FACTORS, "currency"]},
    "chi2_three_outcomes": _chi2(
        "wide", "journey_type_id", "times", "wide AS (SELECT *, least(n_contacts, 2) AS times FROM linked)"
    ),
    "effect_sizes": _sql(
        """SELECT factor, 'cramers_v' AS measure, round(sqrt(x / n), 6) AS value FROM chi
        UNION ALL SELECT 'value_group', 'rank_biserial', round(2 * u / pairs - 1, 6) FROM test""",
        VALUE_SPLIT,
        *_chi2_ctes("linked", FACTORS, "contacted"),
        *_mwu_ctes("split", "contacted", "'high'", "'low'", "value_group"),
    ),
    "contact_flag_in_window": _sql(
        """SELECT order_id, count(c.errand_id) AS n_contacts, CAST(count(c.errand_id) > 0 AS INTEGER)
        AS contacted FROM bookings b LEFT JOIN (SELECT errand_id, order_id FROM contacts WHERE created <=
        (SELECT max(order_created_at) FROM bookings) + INTERVAL 90 DAY) c USING (order_id) GROUP BY 1"""
    ),
    "csv_quoted_text": _sql(
        """SELECT order_id, 'A "' || device || '", b|' || coalesce(partner, '-') AS device,
        CAST(0 AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS empty_cells FROM bookings"""
    ),
    "assemble": _sql(
        """SELECT order_id, CAST(5 AS INTEGER) AS size, round(
        coalesce(ln(1 + CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END), 0)
        + hour(order_created_at) + isodow(order_created_at) - 1 + month(order_created_at)
        + CAST(partner IS NULL AS INTEGER), 6) AS total FROM linked"""
    ),
    "kmeans_check": _sql(
        """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS nearer_elsewhere, CAST(1 AS INTEGER) AS cost_agrees,
        count(*) AS profile_rows FROM bookings"""
    ),
    "silhouette": _sql(
        """SELECT count(*) AS n, round(avg(CASE WHEN s.n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 3) AS silhouette,
        TRUE AS is_known
        FROM (SELECT id, own, max(d) FILTER (own = k) / (max(z.n) FILTER (own = k) - 1) AS a,
                min(d / z.n) FILTER (own <> k) AS b
              FROM sums JOIN sizes z ON z.cluster = k GROUP BY 1, 2) t
        JOIN sizes s ON s.cluster = own""",
        """p AS (SELECT order_id AS id, is_canceled * 2 + is_changed AS cluster, n_contacts AS y,
          ln(1 + greatest(coalesce(order_amount, 0), 0)) AS x FROM linked),
        sizes AS (SELECT cluster, count(*) AS n FROM p GROUP BY 1),
        cells AS (SELECT cluster, x, y, count(*) AS w FROM p GROUP BY 1, 2, 3),
        sums AS (SELECT p.id, p.cluster AS own, c.cluster AS k,
          sum(w * sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))) AS d
          FROM p, cells c GROUP BY 1, 2, 3)""",
    ),
    "logistic_check": _sql(
        """SELECT contacted AS label, CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS n,
        CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS in_range, CAST(1 AS INTEGER) AS at_optimum
        FROM linked GROUP BY 1"""
    ),
    "forest_check": _sql(
        """SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS in_range, CAST(10 AS BIGINT) AS top,
        1.0::DOUBLE AS total_importance
        FROM (SELECT round(count(*) * 0.2::DOUBLE) AS n FROM linked GROUP BY contacted)"""
    ),
    "repeat_chi2": _chi2(
        "chosen",
        "first_category",
        "is_repeat",
        REPEATS,
        "extremes AS (" + FIRST_RANK.format(rate="repeat_rate", key="first_category", source="ranking") + ")",
        "chosen AS (SELECT * FROM per_order WHERE first_category IN (SELECT first_category FROM extremes))",
    ),
    "mwu_value_split": _sql(
        _mwu_select(True),
        VALUE_SPLIT,
        *_mwu_ctes("split", "contacted", "'high'", "'low'", "value_group"),
    ),
    "mwu_family_single": _sql(
        _mwu_select(
            False,
            ", (SELECT median(n_contacts) FROM linked WHERE customer_group_type = 'FAMILY') "
            "AS median_family, (SELECT median(n_contacts) FROM linked "
            "WHERE customer_group_type = 'SINGLE') AS median_single",
        ),
        *_mwu_ctes("linked", "n_contacts", "'FAMILY'", "'SINGLE'", "customer_group_type"),
    ),
    "mwu_amount_contacted": _sql(
        _mwu_select(True), *_mwu_ctes("linked", "order_amount", "1", "0", "contacted")
    ),
    "propensity": _sql(
        f"""SELECT factor, test, round(statistic, 4) AS statistic, dof, round(p, 6) AS p_value,
        CASE factor WHEN 'is_canceled' THEN '1' WHEN 'is_changed' THEN '1'
          WHEN 'customer_group_type' THEN 'FAMILY' WHEN 'value_group' THEN 'high' ELSE hi END AS first_level,
        CASE factor WHEN 'is_canceled' THEN '0' WHEN 'is_changed' THEN '0'
          WHEN 'customer_group_type' THEN 'SINGLE' WHEN 'value_group' THEN 'low' ELSE lo END AS second_level,
        (SELECT contact_rate FROM rates WHERE dimension = factor AND level = first_level) AS first_rate,
        (SELECT contact_rate FROM rates WHERE dimension = factor AND level = second_level) AS second_rate,
        CASE factor WHEN 'is_canceled' THEN 'Order Cancellation'
          WHEN 'is_changed' THEN 'Booking Modification'
          WHEN 'customer_group_type' THEN 'Customer Group Type'
          WHEN 'journey_type_id' THEN 'Journey Type' ELSE 'Order Value (High vs Low)' END AS label
        FROM (
          SELECT factor, 'Chi-square' AS test, x AS statistic, CAST(dof AS BIGINT) AS dof,
                 {_chi2_tail('x', 'dof')} AS p FROM chi
          UNION ALL
          SELECT 'value_group', 'Mann-Whitney U', u, NULL, least(1.0::DOUBLE, 2 * ({_upper_tail('z')}))
          FROM (SELECT *, (greatest(u, pairs - u) - pairs / 2 - 0.5) / sd AS z FROM test))
        JOIN (SELECT dimension AS factor, first(level ORDER BY contact_rate DESC, level) AS hi,
                first(level ORDER BY contact_rate, level) AS lo FROM rates GROUP BY 1) USING (factor)""",
        VALUE_SPLIT,
        _rates("split", [*FACTORS, "value_group"]),
        *_chi2_ctes("linked", FACTORS, "contacted"),
        *_mwu_ctes("split", "contacted", "'high'", "'low'", "value_group"),
    ),
    # Features and metrics
    "booking_features": _sql(
        "SELECT order_id, contacted, "
        + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CATEGORICAL)
        + """, round(coalesce(ln(1 + CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END), 0), 9)
          AS order_amt_log,
        CAST(hour(order_created_at) AS INTEGER) AS book_hour,
        CAST(isodow(order_created_at) - 1 AS INTEGER) AS book_dow,
        CAST(month(order_created_at) AS INTEGER) AS book_month,
        CAST(partner IS NULL AS INTEGER) AS is_direct FROM linked"""
    ),
    "label_encode": _sql(
        "SELECT order_id, "
        + ", ".join(
            f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Unknown')) - 1 AS INTEGER) AS {c}_enc"
            for c in CATEGORICAL
        )
        + " FROM bookings"
    ),
    "class_weights": _sql(
        """SELECT order_id, contacted, round(count(*) OVER ()::DOUBLE
        / (2 * count(*) OVER (PARTITION BY contacted)), 9) AS weight FROM linked"""
    ),
    "standardise": _sql(
        "SELECT order_id, "
        + ", ".join(
            f"round((coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM linked)) / "
            f"(SELECT stddev_pop(coalesce({c}, 0)) FROM linked), 6) AS {c}_std"
            for c in ["order_amount", "n_contacts", "is_changed"]
        )
        + " FROM linked"
    ),
    "roc_auc": _sql(
        """SELECT round((sum(r) FILTER (label = 1) - p::DOUBLE * (p + 1) / 2) / (p::DOUBLE * n), 9)
          AS roc_auc
        FROM (SELECT label, rank() OVER (ORDER BY score)
                + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored), sizes
        GROUP BY p, n""",
        SCORED,
    ),
    "average_precision": _sql(
        "SELECT round(sum(pos::DOUBLE / p * tp::DOUBLE / (tp + fp)), 9) AS average_precision "
        "FROM points, sizes",
        SCORED,
    ),
    "compare_check": _sql(
        """SELECT 'rule' AS model, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
        (SELECT round((sum(r) FILTER (label = 1) - p::DOUBLE * (p + 1) / 2) / (p::DOUBLE * n), 9)
         FROM (SELECT label, rank() OVER (ORDER BY score)
                 + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)) AS roc_auc,
        (SELECT round(sum(pos::DOUBLE / p * tp::DOUBLE / (tp + fp)), 9) FROM points) AS average_precision,
        CAST(1 AS INTEGER) AS same_auc FROM sizes""",
        SCORED,
    ),
    "roc_curve": _sql(
        """SELECT threshold, fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr FROM points, sizes
        UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
        SCORED,
    ),
    "roc_corners": _sql(
        """SELECT threshold, fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr
        FROM (SELECT *, lag(tp) OVER w AS tp0, lag(fp) OVER w AS fp0, lead(tp) OVER w AS tp2, lead(fp) OVER w AS fp2
              FROM points WINDOW w AS (ORDER BY threshold DESC)), sizes
        WHERE tp0 IS NULL OR tp2 IS NULL OR tp2 - tp <> tp - tp0 OR fp2 - fp <> fp - fp0
        UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
        SCORED,
    ),
    "pr_curve": _sql(
        """SELECT threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall,
          p::DOUBLE / (p + n) AS base_rate FROM points, sizes
        UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE, p::DOUBLE / (p + n) FROM sizes""",
        SCORED,
    ),
    # Segments
    "cluster_profile": _sql(
        "SELECT cluster, n, "
        + ", ".join(f"round({m}, 9) AS {m}" for m in [*PROFILE_RATES, "avg_contacts"])
        + ", round(avg_order_amt, 4) AS avg_order_amt FROM profile",
        *PROFILE,
    ),
    "segment_names": _sql(
        """SELECT cluster, CASE WHEN cluster = a THEN 'cancelled' WHEN cluster = b THEN 'changed'
          WHEN cluster = c THEN 'round trip' ELSE 'one way' END AS segment, n
        FROM profile, s3""",
        *PROFILE,
        "s1 AS (SELECT first(cluster ORDER BY cancel_rate DESC, cluster) AS a FROM profile)",
        """s2 AS (SELECT a, first(cluster ORDER BY change_rate DESC, cluster) AS b FROM profile, s1
        WHERE cluster <> a GROUP BY a)""",
        """s3 AS (SELECT a, b, first(cluster ORDER BY pct_roundtrip DESC, cluster) AS c
        FROM profile, s2 WHERE cluster NOT IN (a, b) GROUP BY a, b)""",
    ),
    "profile_long": _sql(
        _union(
            [
                f"SELECT cluster, '{m}' AS metric, round({m}, 9) AS value FROM profile"
                for m in PROFILE_RATES
            ]
        ),
        *PROFILE,
    ),
    "segment_points": _sql(
        f"""SELECT order_id, cluster, round(order_amt_log, 9) AS order_amt_log,
        least(n_contacts, 10) AS contacts FROM
        (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {_hash()}, order_id) AS rn
         FROM ruled) WHERE rn <= 200""",
        RULED,
    ),
}
ORACLES |= {"layout_counts": ORACLES["contact_counts"], "layout_links": ORACLES["link_contacts"]}
