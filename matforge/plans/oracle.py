"""DuckDB SQL oracles: the same fixture mapping and semantics written independently.

Each oracle starts from the driver's tables (registered as views) and recomputes the
fixture inputs with CTEs, then the operator's result. Column names equal the Spark
query's column names.
"""

from __future__ import annotations

CTE = {}

CTE["li_end"] = """li_end AS (
  SELECT *, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS end_ts FROM lineitem)"""

CTE["line_items"] = """line_items AS (
  SELECT
    CASE WHEN o.o_custkey % 10 <> 0 THEN CAST(o.o_custkey AS VARCHAR) END AS PROJECTNUMBER,
    n.n_name AS PROJECT_CITY, c.c_mktsegment AS PROJECT_TYPE, r.r_name AS CORE_MARKET, p.p_type AS UOM,
    CASE WHEN l.l_linenumber % 3 = 0 THEN CAST(l.l_partkey AS VARCHAR) || '.0' ELSE CAST(l.l_partkey AS VARCHAR) END AS MasterItemNo,
    CASE WHEN l.l_linenumber = 7 THEN NULL
         WHEN l.l_linenumber % 4 = 0 THEN upper(p.p_name) || ' - ' || p.p_type
         ELSE p.p_name || ' - ' || p.p_type END AS ItemDescription,
    CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) || ' EA' AS QtyShipped,
    CASE WHEN l.l_linenumber = 1 THEN '0' ELSE CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) END AS ExtendedQuantity,
    '$ ' || CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS ExtendedPrice,
    '$ ' || CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS UnitPrice,
    '$' || CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS invoiceTotal,
    CASE WHEN l.l_returnflag = 'R' THEN '-' ELSE CAST(CAST(l.l_tax AS DECIMAL(18,2)) AS VARCHAR) || ' %' END AS REVISED_ESTIMATE,
    CAST(l.l_linenumber - 1 AS VARCHAR) AS NUMFLOORS,
    CAST(p.p_size AS VARCHAR) AS SIZE_BUILDINGSIZE,
    CASE WHEN l.l_partkey % 50 = 0 THEN 'not a date' ELSE strftime(l.l_shipdate, '%m/%d/%Y') END AS invoiceDate,
    strftime(o.o_orderdate, '%m/%d/%Y') AS CONSTRUCTION_START_DATE,
    strftime(l.end_ts, '%m/%d/%Y') AS SUBSTANTIAL_COMPLETION_DATE
  FROM li_end l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

CTE["predictions"] = """predictions AS (SELECT l_partkey AS MasterItemNo, l_quantity AS QtyShipped FROM lineitem)"""

CTE["vpairs"] = """vpairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 5 <> 0)"""

CTE["vendor_rows"] = """vendor_rows AS (
  SELECT CAST(v.l_partkey AS VARCHAR) AS item_key,
    CAST(row_number() OVER (PARTITION BY v.l_partkey ORDER BY v.l_suppkey) - 1 AS INTEGER) AS pos,
    s.s_name AS company,
    CASE WHEN v.l_suppkey % 6 <> 0 THEN 'https://supplier' || CAST(v.l_suppkey AS VARCHAR) || '.example.com' END AS url,
    'supply' AS services, n.n_name AS location,
    CASE WHEN v.l_suppkey % 3 <> 0 THEN '+91 ' || CAST(v.l_suppkey + 9000000000 AS VARCHAR) END AS contact,
    CAST(CASE WHEN v.l_suppkey % 40 <> 0 THEN v.l_suppkey % 40 END AS INTEGER) AS lead_time_days,
    CAST(v.l_suppkey % 7 + 1 AS INTEGER) AS min_order_qty,
    CASE WHEN v.l_suppkey % 4 = 0 THEN 'Import desk' ELSE 'local' END AS source
  FROM vpairs v JOIN supplier s ON v.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

CTE["requests"] = """requests AS (
  SELECT o_orderkey AS id,
    CASE o_orderkey % 4 WHEN 0 THEN 'Item ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR)
         WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '.0' ELSE format('{:,}', o_custkey) END AS item,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS qty,
    strftime(o_orderdate, '%Y-%m-%d') AS needed_by,
    'order ' || CAST(o_orderkey AS VARCHAR) AS notes,
    CASE o_orderstatus WHEN 'F' THEN ' Approved ' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'rejected' END AS status,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
    (o_orderkey % 3 = 0) AS linked_to_procurement
  FROM orders)"""

CTE["request_feed"] = """request_feed AS (
  SELECT user_id AS id, ts, event_id AS seq,
    CASE WHEN event_type = 'purchase' THEN 'Approved' WHEN event_type = 'error' THEN 'Rejected' ELSE 'Pending' END AS status
  FROM events)"""

CTE["truth"] = """truth AS (SELECT o_orderkey AS id, o_orderpriority AS MasterItemNo, o_totalprice AS QtyShipped FROM orders)"""
CTE["cust_med"] = """cust_med AS (SELECT o_custkey, median(o_totalprice) AS med FROM orders GROUP BY o_custkey)"""
CTE["pred"] = """pred AS (
  SELECT o.o_orderkey AS id,
    CASE WHEN o.o_custkey % 3 = 0 THEN '1-URGENT' WHEN o.o_custkey % 3 = 1 THEN o.o_orderpriority ELSE '5-LOW' END AS MasterItemNo,
    m.med AS QtyShipped
  FROM orders o JOIN cust_med m ON o.o_custkey = m.o_custkey WHERE o.o_orderkey % 10 <> 9)"""

CTE["schedule"] = """schedule AS (
  SELECT * FROM (VALUES
    ('Design & Planning', DATE '1998-01-01', DATE '1998-01-21', 0),
    ('Foundation & Civil Works', DATE '1998-01-22', DATE '1998-02-20', 1),
    ('Electrical & HVAC', DATE '1998-02-21', DATE '1998-03-22', 2),
    ('IT Infrastructure', DATE '1998-03-23', DATE '1998-04-06', 3),
    ('Commissioning & Handover', DATE '1998-04-07', DATE '1998-04-21', 4)) AS t(Task, "Start", Finish, ord))"""

# canonical item key of a text column (C6, key form)
def KEY(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    bare = f"CASE WHEN regexp_matches({t}, '^[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.0*)?$') THEN replace({t}, ',', '') ELSE {t} END"
    return f"(CASE WHEN {t} <> '' THEN CASE WHEN regexp_matches({bare}, '^[+-]?\\d+\\.0*$') THEN regexp_replace({bare}, '\\.0*$', '') ELSE {bare} END END)"


_ORDER = ["li_end", "line_items", "predictions", "vpairs", "vendor_rows", "requests", "request_feed", "truth",
          "cust_med", "pred", "schedule"]
_DEPS = {"line_items": ["li_end"], "vendor_rows": ["vpairs"], "pred": ["cust_med"]}


def with_ctes(needs: list[str], body: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs it needs (in dependency order) and extra CTEs."""
    want = set()

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        want.add(n)

    for n in needs:
        add(n)
    parts = [CTE[n] for n in _ORDER if n in want] + list(extra or [])
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


NUMBER_RE = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"


def STRIP_NUM(x: str) -> str:
    """Keep digits, '.', '-' and parse a plain decimal."""
    s = f"regexp_replace(CAST({x} AS VARCHAR), '[^0-9.\\-]', '', 'g')"
    return f"(CASE WHEN regexp_matches({s}, '^-?(\\d+\\.?\\d*|\\.\\d+)$') THEN TRY_CAST({s} AS DOUBLE) END)"


def NUMTXT(x: str) -> str:
    """Strict float() parse of text."""
    t = f"trim(CAST({x} AS VARCHAR))"
    return f"(CASE WHEN regexp_matches({t}, '{NUMBER_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def MASTER_INT(x: str) -> str:
    """C6 integer form."""
    s = f"regexp_replace(CAST({x} AS VARCHAR), '[,\\s]', '', 'g')"
    num = f"TRY_CAST(CASE WHEN regexp_matches({s}, '{NUMBER_RE}') THEN {s} END AS DOUBLE)"
    return (f"coalesce(CASE WHEN regexp_matches({s}, '^\\d+$') THEN TRY_CAST({s} AS BIGINT) END, "
            f"CASE WHEN {num} = floor({num}) THEN CAST({num} AS BIGINT) END)")


DATE_FMTS = ("%m/%d/%Y", "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%m-%d-%Y")


def PDATE(x: str) -> str:
    """Month-first date text -> DATE."""
    t = f"trim(CAST({x} AS VARCHAR))"
    return "CAST(coalesce(" + ", ".join(f"try_strptime({t}, '{f}')" for f in DATE_FMTS) + ") AS DATE)"


def TRUTHY(x: str) -> str:
    """First-truthy test of one value: not null, not '', not numeric zero."""
    return (f"(CASE WHEN {x} IS NOT NULL AND CAST({x} AS VARCHAR) <> '' AND "
            f"coalesce(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE), 1.0) <> 0 THEN {x} END)")


def LINKQTY(x: str) -> str:
    n = NUMTXT(f"replace(CAST({TRUTHY(x)} AS VARCHAR), ',', '')")
    return f"coalesce(CASE WHEN abs({n}) < 9.2e18 THEN CAST(trunc({n}) AS BIGINT) END, CAST(1 AS BIGINT))"


def PLANQTY(x: str) -> str:
    q = f"coalesce({NUMTXT(x)}, {NUMTXT(f'replace(CAST({x} AS VARCHAR), {CHR_COMMA}, {EMPTY})')}, 1.0)"
    return f"CAST(greatest(1.0, round_even({q}, 0)) AS BIGINT)"


CHR_COMMA = "','"
EMPTY = "''"

TEST_PHASES = (("Electrical & HVAC", ("bolt", "rod")), ("IT Infrastructure", ("gear", "gizmo")),
               ("Foundation & Civil Works", ("plate", "anvil")), ("Design & Planning", ("ring",)))


def PHASE(text: str, default: str = "Electrical & HVAC") -> str:
    s = f"lower(coalesce({text}, ''))"
    parts = []
    for ph, kws in TEST_PHASES:
        cond = " OR ".join(f"contains({s}, '{k}')" for k in kws)
        parts.append(f"WHEN {cond} THEN '{ph}'")
    return "(CASE " + " ".join(parts) + f" ELSE '{default}' END)"
