"""Query inputs: the given tables with faults planted by plain SQL expressions.

The same text runs in Spark (as a view over the given tables) and in any ANSI SQL
engine, so a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Gaps, sentinels, padding, extremes and exact copies in orders.
DIRTY_ORDERS = """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 17 = 0 THEN 'N/A'
       WHEN o_orderkey % 19 = 0 THEN concat('  ', o_orderstatus, ' ') ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS total,
  CASE WHEN o_orderkey % 13 = 0 THEN '-'
       WHEN o_orderkey % 7 = 0 THEN concat('$', CAST(o_custkey AS string))
       WHEN o_orderkey % 101 = 0 THEN 'none given' ELSE CAST(o_custkey AS string) END AS paid,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE
    concat(lpad(CAST(day(o_orderdate) AS string), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS string), 2, '0'), '-',
           CAST(year(o_orderdate) AS string)) END AS placed,
  concat('0', CAST(o_custkey AS string)) AS zip,
  CAST(NULL AS string) AS notes,
  'web' AS channel,
  o_orderpriority AS priority
FROM orders
"""
DIRTY_ORDERS = DIRTY_ORDERS + "UNION ALL\n" + DIRTY_ORDERS + "WHERE o_orderkey % 50 = 0\n"

# Business fields spelt in many ways, from customer.
CONTACTS = """
SELECT c_custkey AS contact_id,
  concat(lower(c_name), ' o''neil-', lower(c_mktsegment)) AS full_name,
  CASE WHEN c_custkey % 9 = 0 THEN concat('user', CAST(c_custkey AS string), '@host')
       ELSE concat(' User', CAST(c_custkey AS string), '@Mail.Example.COM ') END AS email,
  CASE c_custkey % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'u.k.' WHEN 2 THEN 'United States' WHEN 3 THEN ' uk '
       WHEN 4 THEN 'new zealand' ELSE 'france' END AS country,
  CASE WHEN c_custkey % 31 = 0 THEN '150' WHEN c_custkey % 29 = 0 THEN 'twenty'
       ELSE CAST(18 + c_custkey % 60 AS string) END AS age,
  lower(c_mktsegment) AS product_category,
  CASE WHEN c_custkey % 37 = 0 THEN -c_acctbal ELSE c_acctbal + 0.0 END AS unit_price,
  CASE c_custkey % 3
    WHEN 0 THEN concat(lpad(CAST(1 + c_custkey % 28 AS string), 2, '0'), '/', lpad(CAST(1 + c_custkey % 12 AS string), 2, '0'), '/2024')
    WHEN 1 THEN concat('2024-', lpad(CAST(1 + c_custkey % 12 AS string), 2, '0'), '-', lpad(CAST(1 + c_custkey % 28 AS string), 2, '0'))
    ELSE concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(1 + 3 * (c_custkey % 12) AS int), 3), '-',
                CAST(1 + c_custkey % 28 AS string), '-2024') END AS signup_date
FROM customer
"""

# Numeric features with gaps and extremes, labelled by return flag.
LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS label,
  CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_discount END AS discount,
  l_tax AS tax
FROM lineitem
"""

# A small labelled table: accounts by market segment, uneven classes, with gaps.
ACCOUNTS = """
SELECT c_custkey,
  CASE WHEN c_custkey % 10 < 6 THEN 'retail' WHEN c_custkey % 10 < 9 THEN 'trade' ELSE 'public' END AS label,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_nationkey AS double) + c_acctbal / 7919 END AS region_index,
  CAST((c_custkey * 7919) % 1009 AS double) AS visits,
  1.0 * (c_custkey % 10) + c_acctbal / 5000 AS score
FROM customer
"""

PARTS = """
SELECT p_partkey,
  CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS label,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS double) END AS size,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
  CAST((p_partkey * 7919) % 1009 AS double) / 10 AS weight
FROM part
"""

# Wide numeric table: each embedding component a column.
VECTORS = (
    "SELECT vec_id, label, "
    + ", ".join(f"CAST(embedding[{{{i}}}] AS double) AS e{i:02d}" for i in range(64))
    + " FROM embeddings\n"
)

# Amounts in many spellings.
CURRENCY_TEXT = '''SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN concat('$', CAST(o_custkey AS string)) WHEN 1 THEN concat('(', CAST(o_custkey AS string), ')')
  WHEN 2 THEN concat('$(', CAST(o_custkey AS string), ')') WHEN 3 THEN concat(' ', CAST(o_custkey AS string), '. ')
  WHEN 4 THEN concat(CAST(o_custkey AS string), 'e1') WHEN 5 THEN concat(o_orderpriority, 'd')
  WHEN 6 THEN concat('1,', lpad(CAST(o_custkey % 1000 AS string), 3, '0')) ELSE concat('+', CAST(o_custkey AS string), '.5')
  END AS amount FROM orders'''

# Ragged lines: blank, split date, short, overlong, quoted, trailing commas.
CSV_LINES = '''SELECT o_orderkey,
  CASE WHEN o_orderkey % 40 = 0 THEN ''
       WHEN o_orderkey % 41 = 0 THEN concat(CAST(o_orderkey AS string), ',Mar-1,2024,', o_orderstatus, ',', o_orderpriority, ',', CAST(o_custkey AS string))
       WHEN o_orderkey % 43 = 0 THEN concat(CAST(o_orderkey AS string), ',2024-01-02,', o_orderstatus)
       WHEN o_orderkey % 47 = 0 THEN concat(CAST(o_orderkey AS string), ',2024-01-02,a,b,c,d,e')
       WHEN o_orderkey % 53 = 0 THEN concat(CAST(o_orderkey AS string), ',2024-01-02,"', o_orderstatus, ', ""x""",', o_orderpriority, ',', CAST(o_custkey AS string))
       ELSE concat(CAST(o_orderkey AS string), ',2024-01-02,', o_orderstatus, ',', o_orderpriority, ',', CAST(o_custkey AS string), ',, ')
  END AS line FROM orders'''

# Records of CSV files: a quoted line break and quotes in each note, split dates, blank cells, lines beyond repair.
CSV_FILE_HEADS = ["order_id,note,order_date,priority"] * 2 + ["note,order_date,priority,order_id"]
CSV_FILE_LINES = '''SELECT o_orderkey, o_orderkey % 3 AS pid,
  CASE WHEN o_orderkey % 3 = 2 THEN concat(note, ',', day, ',', prio, ',', key, extra) ELSE concat(key, ',', note, ',', day, ',', prio, extra) END AS line
FROM (SELECT o_orderkey, CAST(o_orderkey AS string) AS key,
  concat('"', o_orderstatus, chr(10), '""', CAST(o_custkey AS string), '"", so"') AS note,
  CASE WHEN o_orderkey % 41 = 0 THEN 'Mar-7,2024' ELSE '2024-01-02' END AS day,
  CASE WHEN o_orderkey % 43 = 0 AND o_orderkey % 41 <> 0 THEN ' ' ELSE o_orderpriority END AS prio,
  CASE WHEN o_orderkey % 47 = 0 THEN ',x,y,z' ELSE '' END AS extra FROM orders)'''

TEXTS = {
    "dirty_orders": (DIRTY_ORDERS, ["orders"]),
    "contacts": (CONTACTS, ["customer"]),
    "lines": (LINES, ["lineitem"]),
    "accounts": (ACCOUNTS, ["customer"]),
    "parts": (PARTS, ["part"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the planted tables over the files in ``sf_dir``."""
    if name == "vectors":
        table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
        return spark.sql(VECTORS.format(*range(64)))
    text, sources = TEXTS[name]
    for s in sources:
        table(spark, sf_dir, s).createOrReplaceTempView(s)
    return spark.sql(text)


def planted_sql(name: str) -> str:
    """The same table for the oracle (arrays count from 1 there)."""
    return VECTORS.format(*range(1, 65)) if name == "vectors" else TEXTS[name][0]
