"""SQL text of the fixture views, shared by the DuckDB oracle queries.

Each oracle query starts with these CTEs so that it reads the raw tables.
"""

T_CTE = """t AS (
  SELECT o_orderkey AS tx_id, o_custkey AS driver_id,
         CAST(o_orderdate AS TIMESTAMP) AS transaction_date, o_totalprice AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'FIRST_PAYMENT' WHEN 'O' THEN 'RECURRENCY'
                            WHEN 'P' THEN 'FIRST_PAYMENT_EXCHANGE' END AS kind
  FROM orders)"""

ACT_CTE = """t AS (
  SELECT event_id AS tx_id, user_id AS driver_id, CAST(ts AS TIMESTAMP) AS transaction_date,
         value AS amount, event_type AS kind
  FROM events)"""

MIXED_CTE = """t AS (
  SELECT o_orderkey AS tx_id, o_custkey AS driver_id, CAST(o_orderdate AS TIMESTAMP) AS transaction_date, o_totalprice AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'FIRST_PAYMENT' WHEN 'O' THEN 'RECURRENCY'
                            WHEN 'P' THEN 'FIRST_PAYMENT_EXCHANGE' END AS kind
  FROM orders
  UNION ALL
  SELECT -event_id - 1, user_id, CAST(ts AS TIMESTAMP), value, event_type FROM events)"""

PRICING_CTE = """pr AS (
  SELECT p_retailprice AS price, l_quantity AS demand,
         l_extendedprice * (1 - l_discount) AS revenue, p_brand AS segment
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

def floor_days(a: str, b: str) -> str:
    """DuckDB text of floor of whole days from ``a`` to ``b``."""
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def sql(*parts: str) -> str:
    """``WITH part1, part2, ... <body>``: all but the last part are CTEs."""
    *ctes, body = parts
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def msum(e: str) -> str:
    """DuckDB sum of amounts, 0 for none."""
    return f"coalesce(sum({e}), 0.0)"


def mavg(e: str) -> str:
    """DuckDB mean of amounts."""
    return f"avg({e})"


#: Added before a mean of amounts is rounded to 6 digits, on both engines: means of
#: cents often lie exactly between two roundings, where the last bit would decide.
NUDGE = 3.7e-8


def r6(e: str) -> str:
    """DuckDB text of a mean of amounts as compared (see ``catalog.rnd``)."""
    return f"round({e} + {NUDGE}, 6)"


PROFILE_CTE = f"""prof AS (
  SELECT c_custkey AS driver_id, c_acctbal AS acctbal, o.data_cadastro, o.ultima_data_ativo,
         o.valor_medio_corrida, o.numero_corridas
  FROM customer LEFT JOIN (
     SELECT o_custkey, CAST(min(o_orderdate) AS TIMESTAMP) AS data_cadastro,
            CAST(max(o_orderdate) AS TIMESTAMP) AS ultima_data_ativo,
            count(o_orderkey) AS numero_corridas, {mavg('o_totalprice')} AS valor_medio_corrida
     FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey)"""
