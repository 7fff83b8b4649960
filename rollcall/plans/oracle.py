"""Independent DuckDB SQL for every registered query, over the driver's
tables (``supplier``, ``customer``, ``events`` are views in DuckDB).

The fleet, probe and check-in views are re-stated here in SQL, and every job
is written the obvious, non-scalable way (windows over whole clusters, a
recursive CTE for the ordered latch), so that it checks the Spark jobs rather
than repeating them.
"""

from __future__ import annotations

# The three patterns, stated here as well, so that a change of
# the jobs' patterns shows as a difference.
PROBE_UP_PATTERN = r".*? \d+\.\d+\.\d+\.\d+.*=\d+.*?\d+ms TTL=\d+"
CONNECT_LINE_PATTERN = r"connect to \[.*?\] from \(\w+\) \[(.*?)\] \d+$"
REQUEST_LINE_PATTERN = r"GET /\?MAC=(.*?) HTTP/1\.1"


def _fleet_sql(table: str, cluster: str, node: str, acctbal: str) -> str:
    return f"""
  SELECT {cluster} AS cluster, {node} AS node,
         CAST(row_number() OVER (PARTITION BY {cluster} ORDER BY {node}) - 1 AS BIGINT) AS idx,
         'MAC' || lpad(CAST({node} AS VARCHAR), 9, '0') AS mac,
         '10.0.' || CAST({cluster} AS VARCHAR) || '.' || CAST({node} AS VARCHAR) AS ip,
         {acctbal} >= 5000 AS is_master,
         CASE {node} % 4 WHEN 0 THEN TRUE WHEN 3 THEN NULL ELSE FALSE END AS is_physical,
         CASE WHEN {node} % 4 = 1 THEN '10.250.' || CAST({cluster} AS VARCHAR) || '.1' ELSE '' END AS nc,
         CASE WHEN {node} % 4 = 1 THEN '/opt/vmware/bin/vmrun' END AS vmware,
         CASE WHEN {node} % 4 IN (1, 2) THEN '/vm/node' || CAST({node} AS VARCHAR) || '.vmx' ELSE '' END AS path
  FROM {table} WHERE {cluster} IS NOT NULL"""


_PROBES = """
  SELECT event_id AS seq, ts, user_id AS node,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Request timed out.'
         WHEN event_type = 'error'
           THEN 'Reply from 10.0.0.' || CAST(user_id AS VARCHAR) || ': Destination host unreachable.'
         WHEN event_id % 3 = 0
           THEN 'Reply from 10.0.0.' || CAST(user_id AS VARCHAR) || ': bytes=32 time='
                || CAST(event_id % 9 + 1 AS VARCHAR) || 'ms TTL=64'
         WHEN event_id % 3 = 1
           THEN 'Reply from 10.0.0.' || CAST(user_id AS VARCHAR) || ': bytes=32 time<1ms TTL=128'
         ELSE '来自 10.0.0.' || CAST(user_id AS VARCHAR) || ' 的回复: 字节=32 时间='
              || CAST(event_id % 9 + 1 AS VARCHAR) || 'ms TTL=64'
    END AS output
  FROM events"""

_CHECKINS = """
  SELECT event_id AS seq, ts,
    'connect to [10.0.0.1] from '
      || CASE WHEN event_id % 50 = 0 THEN '(host.lan)' ELSE '(UNKNOWN)' END
      || ' [172.16.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR)
      || '] ' || CAST(event_id % 1000 + 49152 AS VARCHAR) AS connect_line,
    CASE WHEN event_id % 53 = 0 THEN 'POST / HTTP/1.1'
         ELSE 'GET /?MAC='
              || CASE WHEN event_id % 2 = 1 THEN lower('MAC' || lpad(CAST(user_id AS VARCHAR), 9, '0'))
                      ELSE 'MAC' || lpad(CAST(user_id AS VARCHAR), 9, '0') END
              || ' HTTP/1.1'
    END AS request_line
  FROM events WHERE event_type = 'signup'"""


def _base(fleet_table: str = "supplier", mac: str | None = None, node: str | None = None,
          seq: str = "seq") -> list[tuple[str, str]]:
    if fleet_table == "supplier":
        fleet = _fleet_sql("supplier", "s_nationkey", "s_suppkey", "s_acctbal")
    else:
        fleet = _fleet_sql("customer", "c_nationkey", "c_custkey", "c_acctbal")
    changed = ", ".join(f"{expr} AS {c}" for c, expr in (("mac", mac), ("node", node)) if expr)
    if changed:
        fleet = f"SELECT * REPLACE ({changed}) FROM ({fleet})"
    return [
        ("fleet", fleet),
        ("probes", _PROBES),
        ("checkins", _CHECKINS),
        ("pp", f"""
  SELECT {seq} AS seq, ts, node,
         coalesce(regexp_matches(output, '(?i){PROBE_UP_PATTERN}'), false) AS up
  FROM probes"""),
        ("pc", f"""
  SELECT seq, ts,
         nullif(regexp_extract(connect_line, '(?i){CONNECT_LINE_PATTERN}', 1), '') AS ip,
         nullif(regexp_extract(request_line, '{REQUEST_LINE_PATTERN}', 1), '') AS mac
  FROM checkins"""),
        ("canon", """
  SELECT cluster, idx, mac_key FROM (
    SELECT cluster, idx, upper(mac) AS mac_key,
           row_number() OVER (PARTITION BY upper(mac) ORDER BY cluster, idx) AS rn
    FROM fleet WHERE mac IS NOT NULL) WHERE rn = 1"""),
        ("firsts", """
  SELECT upper(mac) AS mac_key, min(seq) AS first_seq FROM pc
  WHERE mac IS NOT NULL GROUP BY 1"""),
        ("nodes", """
  SELECT f.*, x.first_seq FROM fleet f LEFT JOIN (
    SELECT c.cluster, c.idx, fs.first_seq FROM canon c JOIN firsts fs USING (mac_key)
  ) x USING (cluster, idx)"""),
        ("cov", """
  SELECT cluster, count(*) AS n, count(first_seq) AS reported,
         count(*) - count(first_seq) AS pending,
         CASE WHEN count(*) = count(first_seq) THEN max(first_seq) END AS cutoff_seq
  FROM nodes GROUP BY cluster"""),
        ("sizes", "SELECT cluster, count(*) AS n FROM fleet GROUP BY cluster"),
        ("latest", """
  SELECT node, bool_or(up) AS up
  FROM (SELECT node, up, seq = max(seq) OVER (PARTITION BY node) AS last FROM pp)
  WHERE last GROUP BY node"""),
        ("st", """
  SELECT f.cluster, f.idx, f.node, f.mac, f.ip, coalesce(f.is_master, false) AS is_master,
         s.n, coalesce(l.up, false) AS up
  FROM fleet f LEFT JOIN latest l USING (node) JOIN sizes s USING (cluster)"""),
        ("heads", """
  SELECT cluster,
         min(idx) FILTER (WHERE coalesce(is_master, false)) AS head_idx,
         arg_min(ip, idx) FILTER (WHERE coalesce(is_master, false)) AS head_ip
  FROM fleet GROUP BY cluster"""),
    ]


def _with(body: str, fleet_table: str = "supplier", extra: list[tuple[str, str]] | None = None,
          recursive: bool = False, **base) -> str:
    ctes = _base(fleet_table, **base) + (extra or [])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes) + "\n" + body


_FLEET_SCAN = """
SELECT cluster, node, idx, mac, ip, is_master, is_physical, nc, vmware, path,
       mac IS NOT NULL AND row_number() OVER (PARTITION BY upper(mac) ORDER BY cluster, idx) > 1
         AS mac_duplicate
FROM fleet"""

_APPLY = """
SELECT f.cluster, f.node, f.idx, f.mac, {ip} AS ip, f.is_master, f.is_physical, f.nc,
       f.vmware, f.path,
       coalesce(pn.n_checkins, 0) > 0 AS reported,
       CAST(coalesce(pn.n_checkins, 0) AS BIGINT) AS n_checkins
FROM fleet f LEFT JOIN (
  SELECT c.cluster, c.idx,
         arg_max(p.ip, p.seq) FILTER (WHERE p.ip IS NOT NULL) AS new_ip,
         count(*) AS n_checkins
  FROM pc p JOIN canon c ON upper(p.mac) = c.mac_key JOIN cov v ON v.cluster = c.cluster
  WHERE p.mac IS NOT NULL AND (v.cutoff_seq IS NULL OR p.seq <= v.cutoff_seq)
  GROUP BY c.cluster, c.idx
) pn USING (cluster, idx)"""

_UNKNOWN = """
SELECT * FROM (
  SELECT p.seq, p.ts, p.ip, p.mac,
         CASE WHEN p.mac IS NULL THEN 'no_mac'
              WHEN c.mac_key IS NULL THEN 'unknown_mac'
              WHEN p.ip IS NULL THEN 'no_ip' END AS reason
  FROM pc p LEFT JOIN canon c ON upper(p.mac) = c.mac_key
) WHERE reason IS NOT NULL"""

_FLEET_STATE = """
SELECT cluster, idx, node, mac, ip, is_master, n, up,
       concat_ws(' ', CASE WHEN up THEN 'on ' ELSE 'off' END,
                 CASE WHEN is_master THEN 'master' ELSE 'slave ' END,
                 CAST(idx AS VARCHAR), CAST(n AS VARCHAR), coalesce(mac, ''), coalesce(ip, ''))
         AS line
FROM st"""

_CLUSTER_STATE = """
SELECT cluster, count(*) AS n, CAST(count_if(up) AS BIGINT) AS n_up, bool_and(up) AS all_up
FROM st GROUP BY cluster"""

_SOURCE = """CASE WHEN coalesce(is_physical, false) THEN 'wol'
            WHEN coalesce(length(nc) > 0, false) THEN 'remote'
            WHEN coalesce(length(path) > 0, false) THEN 'local' END"""

_POWER = f"""
SELECT cluster, {_SOURCE} AS source, count(*) AS n
FROM fleet GROUP BY 1, 2"""

_NODE_POWER = f"""
SELECT cluster, idx, node, mac, {_SOURCE} AS source, nc, vmware, path FROM fleet"""

_SELECT_ALL = "SELECT cluster, idx, node, ip FROM st"
_SELECT_RUNNING = "SELECT cluster, idx, node, ip FROM st WHERE up"
_SELECT_HEAD = """
SELECT s.cluster, s.idx, s.node, s.ip FROM st s JOIN heads h
  ON s.cluster = h.cluster AND s.idx = h.head_idx"""

_NODE_CONTEXT = """
SELECT f.cluster, f.idx, f.node, f.ip,
       CASE WHEN coalesce(f.is_master, false) THEN 'master' ELSE 'slave' END AS role,
       h.head_idx, h.head_ip,
       coalesce(f.ip, '') || '-node' || CAST(f.idx AS VARCHAR) AS dns_entry,
       coalesce(f.ip, '') || ' node' || CAST(f.idx AS VARCHAR) AS hosts_entry
FROM fleet f LEFT JOIN heads h USING (cluster)"""

_COVERAGE = "SELECT cluster, n, reported, pending, cutoff_seq FROM cov"

_RUNS = [
    ("runs", """
  SELECT event_id AS run_id, CAST(event_id // 250 % 25 AS INTEGER) AS cluster, event_id AS start_seq
  FROM events WHERE event_id % 250 = 0"""),
    ("runs_seen", """
  SELECT cluster, run_id, count(*) AS reported, max(first_seq) AS last_seq FROM (
    SELECT m.cluster, r.run_id, m.idx, min(m.seq) AS first_seq
    FROM (SELECT c.cluster, c.idx, p.seq FROM pc p JOIN canon c ON upper(p.mac) = c.mac_key) m
    ASOF JOIN runs r ON m.cluster = r.cluster AND m.seq >= r.start_seq
    GROUP BY m.cluster, r.run_id, m.idx) GROUP BY cluster, run_id"""),
]
_RUN_COVERAGE = """
SELECT r.cluster, r.run_id, r.start_seq, s.n, coalesce(x.reported, 0) AS reported,
       s.n - coalesce(x.reported, 0) AS pending,
       CASE WHEN s.n = coalesce(x.reported, 0) THEN x.last_seq END AS cutoff_seq
FROM runs r JOIN sizes s USING (cluster) LEFT JOIN runs_seen x USING (cluster, run_id)"""

_NOT_REPORTED = "SELECT cluster, idx, node, mac FROM nodes WHERE first_seq IS NULL"

_ALL_UP = [
    ("pf", """
  SELECT f.cluster, f.idx, p.ts, p.seq, CAST(p.up AS INTEGER) AS u
  FROM pp p JOIN fleet f USING (node)"""),
    ("chg", """
  SELECT * FROM (
    SELECT cluster, idx, ts, seq,
           u - coalesce(lag(u) OVER (PARTITION BY cluster, idx ORDER BY ts, seq, u), 0) AS delta
    FROM pf) WHERE delta <> 0"""),
    ("run", """
  SELECT cluster, ts, seq,
         sum(delta) OVER (PARTITION BY cluster ORDER BY ts, seq, idx, delta
                          ROWS UNBOUNDED PRECEDING) AS n_up
  FROM chg"""),
    ("hit", """
  SELECT cluster, ts, seq FROM (
    SELECT r.cluster, r.ts, r.seq,
           row_number() OVER (PARTITION BY r.cluster ORDER BY r.ts, r.seq) AS rn
    FROM run r JOIN sizes s USING (cluster) WHERE r.n_up = s.n) WHERE rn = 1"""),
]
_ALL_UP_BODY = """
SELECT s.cluster, s.n, h.ts AS all_up_at, h.seq AS all_up_seq
FROM sizes s LEFT JOIN hit h USING (cluster)"""


def _latch(target: bool, fleet_table: str = "supplier", **base) -> str:
    extra = [
        ("ev", f"""
  SELECT f.cluster, f.idx, p.seq FROM pp p JOIN fleet f USING (node)
  WHERE p.up = {'TRUE' if target else 'FALSE'}"""),
        ("latch", """
  SELECT cluster, idx, min(seq) AS seq FROM ev WHERE idx = 0 GROUP BY cluster, idx
  UNION ALL
  SELECT l.cluster, l.idx + 1 AS idx, min(e.seq) AS seq
  FROM latch l JOIN ev e
    ON e.cluster = l.cluster AND e.idx = l.idx + 1 AND e.seq > l.seq
  GROUP BY l.cluster, l.idx"""),
    ]
    body = """
SELECT l.cluster, CAST(l.idx AS BIGINT) AS idx, f.node, l.seq
FROM latch l JOIN fleet f ON f.cluster = l.cluster AND f.idx = l.idx"""
    return _with(body, fleet_table, extra=extra, recursive=True, **base)


# variants of the inventory and of the probes' order (rollcall.sources.views)
_SHARED_MAC = "'MAC' || lpad(CAST(node // 2 AS VARCHAR), 9, '0')"
_SHARED_NODE = "node // 3"
_COARSE = "seq // 7"


def oracle_sql() -> dict[str, str]:
    return {
        "fleet_scan": _with(_FLEET_SCAN),
        "fleet_scan_shared": _with(_FLEET_SCAN, mac=_SHARED_MAC),
        "fleet_scan_json": _with(_FLEET_SCAN),
        "fleet_scan_json_split": _with(_FLEET_SCAN),
        "parse_checkins": _with(
            "SELECT seq, ts, ip, mac, (ip IS NULL OR mac IS NULL) AS malformed FROM pc"),
        "parse_probes": _with("SELECT seq, ts, node, up FROM pp"),
        "apply_checkins": _with(_APPLY.format(ip="coalesce(pn.new_ip, f.ip)")),
        "apply_checkins_shared": _with(_APPLY.format(ip="coalesce(pn.new_ip, f.ip)"), mac=_SHARED_MAC),
        "apply_checkins_stream": _with(_APPLY.format(ip="coalesce(pn.new_ip, f.ip)")),
        "apply_checkins_keep_ip": _with(_APPLY.format(ip="f.ip")),
        "unknown_checkins": _with(_UNKNOWN),
        "fleet_state": _with(_FLEET_STATE),
        "cluster_state": _with(_CLUSTER_STATE),
        "power_source": _with(_POWER),
        "node_power": _with(_NODE_POWER),
        "select_all": _with(_SELECT_ALL),
        "select_running": _with(_SELECT_RUNNING),
        "select_head": _with(_SELECT_HEAD),
        "node_context": _with(_NODE_CONTEXT),
        "running_context": _with(_NODE_CONTEXT + " JOIN st s ON s.cluster = f.cluster AND s.idx = f.idx "
                                 "WHERE s.up"),
        "report_coverage": _with(_COVERAGE),
        "report_coverage_wide": _with(_COVERAGE, fleet_table="customer"),
        "report_coverage_runs": _with(_RUN_COVERAGE, extra=_RUNS),
        "report_coverage_runs_split": _with(_RUN_COVERAGE, extra=_RUNS),
        "not_reported": _with(_NOT_REPORTED),
        "not_reported_wide": _with(_NOT_REPORTED, fleet_table="customer"),
        "all_up_at": _with(_ALL_UP_BODY, extra=_ALL_UP),
        "all_up_at_wide": _with(_ALL_UP_BODY, fleet_table="customer", extra=_ALL_UP),
        "all_up_at_shared": _with(_ALL_UP_BODY, extra=_ALL_UP, node=_SHARED_NODE, seq=_COARSE),
        "latch_on": _latch(True),
        "latch_on_wide": _latch(True, "customer"),
        "latch_on_ties": _latch(True, seq=_COARSE),
        "latch_off_ties": _latch(False, seq=_COARSE),
        "latch_off": _latch(False),
        "export_state": _with(f"SELECT *, idx AS position FROM ({_FLEET_STATE})"),
        "export_hosts": _with(
            "SELECT cluster, coalesce(ip, '') || ' node' || CAST(idx AS VARCHAR) AS line, "
            "idx AS position FROM fleet"),
        "export_dns": _with(
            "SELECT cluster, coalesce(ip, '') || '-node' || CAST(idx AS VARCHAR) AS entry, "
            "idx AS position FROM fleet"),
        # the streams must end where the batch jobs do
        "report_coverage_stream": _with(_COVERAGE),
        "unknown_checkins_stream": _with(_UNKNOWN),
        "all_up_at_stream": _with(_ALL_UP_BODY, extra=_ALL_UP),
        "all_up_at_wide_stream": _with(_ALL_UP_BODY, fleet_table="customer", extra=_ALL_UP),
        "latch_on_stream": _latch(True),
        "latch_off_stream": _latch(False),
    }
