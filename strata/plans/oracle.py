"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark plans, straight from the semantics: the
same sales lines, rules and aggregates expressed over the driver views.
"""

from __future__ import annotations

from ..sources import driver as D


def _case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


def _price(neg_returns: bool = True) -> str:
    p = "CAST(l.l_extendedprice AS DECIMAL(18,2))"
    return f"CASE WHEN l.l_returnflag = 'R' THEN -{p} ELSE {p} END" if neg_returns else p


def sales_lines(where: str = "", neg_returns: bool = True) -> str:
    """Typed, trimmed sales lines (silver grain before enrichment)."""
    return f"""
    SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id,
           CAST(l.l_linenumber AS VARCHAR) AS line_no,
           CAST(p.p_partkey AS VARCHAR) AS ce_brand_flvr,
           CAST(l.l_suppkey AS VARCHAR) AS supplier_id,
           p.p_brand AS brand_nm,
           r.r_name AS region,
           o.o_orderpriority AS chnl_group,
           c.c_mktsegment AS trade_chnl_desc,
           p.p_type AS pkg_cat, p.p_name AS pkg_cat_desc,
           CAST(p.p_size AS VARCHAR) AS tsr_pckg_nm,
           {_price(neg_returns)} AS dollar_volume,
           CAST(o.o_orderdate AS DATE) AS transaction_date,
           CAST(year(o.o_orderdate) AS INTEGER) AS year,
           CAST(month(o.o_orderdate) AS INTEGER) AS month,
           CAST(month(o.o_orderdate) AS INTEGER) AS period
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    JOIN part p ON l.l_partkey = p.p_partkey
    {where}"""


CHANNELS = f"""
    SELECT DISTINCT c_mktsegment AS trade_chnl_desc,
           {_case_map('c_mktsegment', D.CHANNEL_GROUPS)} AS trade_group_desc,
           {_case_map('c_mktsegment', D.CHANNEL_TYPES)} AS trade_type_desc
    FROM customer WHERE {_case_map('c_mktsegment', D.CHANNEL_GROUPS)} IS NOT NULL"""


def gold(where: str = "", neg_returns: bool = True) -> str:
    return f"""
    SELECT s.*, ch.trade_group_desc, ch.trade_type_desc,
           CASE WHEN s.dollar_volume > {D.VOLUME_HIGH} THEN 'HIGH'
                WHEN s.dollar_volume > {D.VOLUME_MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END AS volume_category,
           coalesce(s.dollar_volume < 0, false) AS is_negative_sale,
           {_case_map('upper(s.region)', D.REGION_GROUPS, "'OTHER'")} AS region_group,
           CASE WHEN s.month IN (1,2,3) THEN 'Q1' WHEN s.month IN (4,5,6) THEN 'Q2'
                WHEN s.month IN (7,8,9) THEN 'Q3' ELSE 'Q4' END AS sales_quarter,
           coalesce(dayofweek(s.transaction_date) IN (0, 6), false) AS is_weekend_sale,
           CASE WHEN upper(s.region) = 'CANADA' THEN 'CANADA' ELSE 'USA' END AS country
    FROM ({sales_lines(where, neg_returns)}) s
    LEFT JOIN ({CHANNELS}) ch ON s.trade_chnl_desc = ch.trade_chnl_desc"""


def with_gold(body: str) -> str:
    return f"WITH gold AS ({gold()})\n{body}"


def hkey(cols: list[str]) -> str:
    """SQL twin of ``functions.hashing.hash_key``."""
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in cols)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15)) AS BIGINT)"


# Landing columns after name standardisation, as strings (bronze grain).
def landing(where: str = "", neg_returns: bool = True) -> str:
    return f"""
    SELECT strftime(o.o_orderdate, '%-m/%-d/%Y') AS date,
           CAST(p.p_partkey AS VARCHAR) AS ce_brand_flvr,
           ' ' || p.p_brand AS brand_nm,
           r.r_name AS region,
           o.o_orderpriority AS chnl_group,
           c.c_mktsegment AS trade_chnl_desc,
           p.p_type AS pkg_cat, p.p_name AS pkg_cat_desc,
           CAST(p.p_size AS VARCHAR) AS tsr_pckg_nm,
           CAST({_price(neg_returns)} AS VARCHAR) AS dollar_volume,
           CAST(year(o.o_orderdate) AS VARCHAR) AS year,
           CAST(month(o.o_orderdate) AS VARCHAR) AS month,
           CAST(month(o.o_orderdate) AS VARCHAR) AS period,
           CAST(l.l_orderkey AS VARCHAR) AS order_id,
           CAST(l.l_linenumber AS VARCHAR) AS line_no,
           CAST(l.l_suppkey AS VARCHAR) AS supplier_id
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    JOIN part p ON l.l_partkey = p.p_partkey
    {where}"""


def defective() -> str:
    """Landing rows in which some orders break a rule each."""
    landed = {"BRAND_NM": "brand_nm", "TRADE_CHNL_DESC": "trade_chnl_desc", "$ Volume": "dollar_volume",
              "DATE": "date", "YEAR": "year", "MONTH": "month"}
    out = []
    for name, col in landed.items():
        arms = " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, c, v in D.DEFECTS if c == name)
        out.append(f"CASE CAST(order_id AS BIGINT) % {D.DEFECT_EVERY} {arms} ELSE {col} END AS {col}")
    return f"SELECT * REPLACE ({', '.join(out)}) FROM ({landing()}) l"


BRONZE_COLUMNS = ["date", "ce_brand_flvr", "brand_nm", "region", "chnl_group", "trade_chnl_desc",
                  "pkg_cat", "pkg_cat_desc", "tsr_pckg_nm", "dollar_volume", "year", "month",
                  "period", "order_id", "line_no", "supplier_id"]


def _tok(cols: list[str]) -> str:
    return ", ".join(f"coalesce(trim(CAST({c} AS VARCHAR)), 'NULL')" for c in cols)


def bronze(where: str = "", neg_returns: bool = True, batch: str = "20240101000000",
           ts: str = "2024-01-01 00:00:00") -> str:
    """Landing rows with ``_pk``, ``_row_hash``, ``_batch_id`` and load time."""
    return f"""
    SELECT b.*,
           md5(concat_ws('|', {_tok(D.SALES_KEY)})) AS _pk,
           sha256(concat_ws('|', {_tok(sorted(BRONZE_COLUMNS))})) AS _row_hash,
           '{batch}' AS _batch_id, TIMESTAMP '{ts}' AS _ingestion_timestamp
    FROM ({landing(where, neg_returns)}) b"""


FIRST = f"WHERE o.o_orderdate < TIMESTAMP '{D.FIRST_EXTRACT_END}'"
SECOND = f"WHERE o.o_orderdate >= TIMESTAMP '{D.SECOND_EXTRACT_START}'"


def extracts() -> str:
    """CTEs b1, b2 (the two change-capture extracts)."""
    return (f"b1 AS ({bronze(FIRST, False)}),\n"
            f"b2 AS ({bronze(SECOND, True, '20240102000000', '2024-01-02 00:00:00')})")
