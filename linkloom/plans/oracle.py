"""DuckDB statements giving the same results as the registered queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_KEY = "[file, rec, pos]"


def _calls(fmt: str = "%Y%m%d%H") -> str:
    return f"""
ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
              CAST(strftime(ts, '{fmt}') AS BIGINT) AS c FROM events),
r AS (SELECT c AS case_id,
        c * 10 + list_position(['click','error','purchase','signup','view'], event_type) AS file,
        event_id AS rec, ts,
        '+919' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS caller,
        '+919' || lpad(CAST((user_id * 7 + event_id) % 400 AS VARCHAR), 9, '0') AS callee,
        '86' || lpad(CAST(k AS VARCHAR), 13, '0') AS imei,
        '10.0.' || (k % 8) || '.' || (k + 1) AS ip FROM ev),
m AS (SELECT case_id, file, rec, 0 AS pos, 'phone' AS t, caller AS v, ts FROM r
      UNION ALL SELECT case_id, file, rec, 1, 'device_imei', imei, ts FROM r
      UNION ALL SELECT case_id, file, rec, 2, 'phone', callee, ts FROM r
      UNION ALL SELECT case_id, file, rec, 3, 'ip_address', ip, ts FROM r),
l AS (SELECT case_id, file, rec, 0 AS pos, 'phone' AS aty, caller AS av, 'device_imei' AS bty,
             imei AS bv, 'shared_imei' AS lt, 0.95::DOUBLE AS conf FROM r
      UNION ALL SELECT case_id, file, rec, 1, 'phone', caller, 'phone', callee,
                       'direct_communication', 0.90 FROM r
      UNION ALL SELECT case_id, file, rec, 2, 'phone', caller, 'ip_address', ip,
                       'shared_ip_subnet', 0.85 FROM r)"""


_LEDGER = """
r AS (SELECT c_nationkey::BIGINT * 1000000 + CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS case_id,
        l_orderkey AS file, l_linenumber::BIGINT * 1000000000 + l_suppkey AS rec, l_shipdate AS ts,
        'CUSTACC' || o_custkey AS sender, 'SUPPACC' || l_suppkey AS receiver,
        '9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@okbank' AS upi,
        '+919' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS phone
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
m AS (SELECT case_id, file, rec, 0 AS pos, 'account' AS t, sender AS v, ts FROM r
      UNION ALL SELECT case_id, file, rec, 1, 'account', receiver, ts FROM r
      UNION ALL SELECT case_id, file, rec, 2, 'account', upi, ts FROM r
      UNION ALL SELECT case_id, file, rec, 3, 'phone', phone, ts FROM r),
l AS (SELECT case_id, file, rec, 0 AS pos, 'account' AS aty, sender AS av, 'account' AS bty,
             receiver AS bv, 'transaction' AS lt, 0.95::DOUBLE AS conf FROM r
      UNION ALL SELECT case_id, file, rec, 1, 'account', sender, 'account', upi,
                       'shared_upi_handle', 0.90 FROM r
      UNION ALL SELECT case_id, file, rec, 2, 'account', sender, 'phone', phone,
                       'shared_upi_handle', 0.88 FROM r
      UNION ALL SELECT case_id, file, rec, 4, 'account', receiver, 'account', upi,
                       'shared_upi_handle', 0.95 FROM r
      UNION ALL SELECT case_id, file, rec, 5, 'account', receiver, 'phone', phone,
                       'shared_upi_handle', 0.92 FROM r
      UNION ALL SELECT case_id, file, rec, 8, 'account', upi, 'phone', phone,
                       'shared_upi_handle', 0.98 FROM r)"""

_ENT = f"""
em AS (SELECT case_id, t, v, min(ts) AS fs, min({_KEY}) AS arr FROM m GROUP BY ALL),
ent AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY arr, t, v) AS eid FROM em)"""


def _link(scope: str = "case") -> str:
    extra = ", file" if scope == "evidence" else ""
    return f"""
lk AS (SELECT l.case_id, least(x.eid, y.eid) AS a, greatest(x.eid, y.eid) AS b, lt,
              min({_KEY}) AS arr, arg_min(conf, {_KEY}) AS conf, min({_KEY})[1] AS src_file
       FROM l JOIN ent x ON x.case_id = l.case_id AND x.t = aty AND x.v = av
              JOIN ent y ON y.case_id = l.case_id AND y.t = bty AND y.v = bv
       WHERE x.eid <> y.eid GROUP BY l.case_id, a, b, lt{extra}),
link AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY arr, a, b, lt) AS lid FROM lk)"""


_WEIGHT = """CASE lt WHEN 'shared_imei' THEN 0.85 WHEN 'shared_upi_handle' THEN 0.80
  WHEN 'transaction' THEN 0.75 WHEN 'direct_communication' THEN 0.70 WHEN 'shared_mac' THEN 0.60
  WHEN 'co_occurrence' THEN 0.40 WHEN 'shared_ip_subnet' THEN 0.30 ELSE 0.50 END::DOUBLE"""


def _edge(weight: str = _WEIGHT) -> str:
    return f"""
wl AS (SELECT *, {weight} AS w FROM link),
edge AS (SELECT case_id, a, b, count(*) AS n, CASE WHEN count(*) = 1 THEN max(w) ELSE greatest(
           coalesce(max(w) FILTER (w >= 0.5), 0),
           CASE count(*) FILTER (w < 0.5) WHEN 0 THEN 0 WHEN 1 THEN max(w) FILTER (w < 0.5)
           ELSE round(1 - product(1 - w) FILTER (w < 0.5), 4) END) END AS conf,
         arg_max(lt, [w, -lid]) AS lt,
         array_to_string(list_sort(list(DISTINCT lt)), ',') AS lts
       FROM wl GROUP BY case_id, a, b),
sym AS (SELECT case_id, a AS x, b AS y, conf, lt FROM edge
        UNION ALL SELECT case_id, b, a, conf, lt FROM edge)"""


_CC = """
cc(case_id, n, root) USING KEY (case_id, n) AS (
  SELECT case_id, eid, eid FROM ent
  UNION
  SELECT s.case_id, s.x, min(c.root) FROM cc c
    JOIN sym s ON s.case_id = c.case_id AND s.y = c.n
    JOIN recurring.cc p ON p.case_id = s.case_id AND p.n = s.x
  WHERE c.root < p.root GROUP BY s.case_id, s.x),
sz AS (SELECT case_id, root, count(*) AS size FROM cc GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY size DESC, root) - 1 AS cid FROM sz),
clu AS (SELECT case_id, n AS eid, cid, size FROM cc JOIN rk USING (case_id, root)),
med AS (SELECT case_id, median(size) AS med FROM sz GROUP BY case_id)"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


CALLS = (_calls(), _ENT, _link(), _edge())
DAILY = (_calls("%Y%m%d"), _ENT, _link(), _edge())
LEDGER = (_LEDGER, _ENT, _link(), _edge())

_LABEL = "CASE WHEN {c} >= 0.8 THEN 'Strong' WHEN {c} >= 0.5 THEN 'Medium' ELSE 'Weak' END"


def _star(e: str) -> str:
    """All but the last four characters starred."""
    return f"CASE WHEN length({e}) <= 4 THEN {e} ELSE repeat('*', length({e}) - 4) || right({e}, 4) END"


# --- scalar functions ---------------------------------------------------------

_PHONE_RAW = """raw AS (SELECT c_custkey, CASE c_custkey % 8
  WHEN 0 THEN '9' || n WHEN 1 THEN '+91 9' || left(n, 4) || '-' || right(n, 5)
  WHEN 2 THEN '0044 (20) ' || n WHEN 3 THEN '919' || n WHEN 4 THEN '2.' || n
  WHEN 5 THEN right(n, 5) WHEN 6 THEN '  1' || n || '.0 ' ELSE 'mule' || n END AS raw
  FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS n FROM customer))"""


def _phone_steps(src: str, col: str, out: str) -> str:
    """CTEs that normalize ``src.col`` into table ``out`` (c_custkey, p)."""
    return f"""
{out}1 AS (SELECT c_custkey, regexp_replace(regexp_replace(trim({col}), '^([0-9]+)\\.0$', '\\1'),
            '[\\s().-]', '', 'g') AS s FROM {src}),
{out}2 AS (SELECT c_custkey, CASE WHEN s[1:2] = '00' THEN '+' || s[3:] WHEN s[1] = '+' THEN s
   WHEN length(s) = 12 AND s[1:2] = '91' THEN '+' || s
   WHEN length(s) = 10 AND s[1] BETWEEN '6' AND '9' THEN '+91' || s
   WHEN length(s) = 10 AND s[1] BETWEEN '2' AND '5' THEN '+1' || s ELSE s END AS s FROM {out}1),
{out} AS (SELECT c_custkey, CASE WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 7 AND 15
   THEN CASE WHEN s[1] = '+' THEN s ELSE '+' || s END END AS p FROM {out}2)"""


ORACLE["normalize_phone"] = _with(
    _PHONE_RAW, _phone_steps("raw", "raw", "p"), _phone_steps("raw", "raw", "h")) + """
SELECT raw.c_custkey, raw, p.p AS phone,
  CASE WHEN regexp_full_match(p.p, '\\+?[0-9]+') AND raw NOT LIKE 'mule%' THEN p.p END AS strict_phone,
  h.p AS handle_phone FROM raw JOIN p USING (c_custkey) JOIN h USING (c_custkey)"""

ORACLE["normalize_imei"] = """
SELECT event_id, CASE WHEN length(d) BETWEEN 14 AND 16 THEN d END AS imei FROM (
  SELECT event_id, '86' || lpad(CAST(event_id AS VARCHAR), 10, '0')
    || repeat('7', CAST(event_id % 6 AS INT)) AS d FROM events)"""

ORACLE["normalize_account"] = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'cust-' || o_custkey || '@okbank'
  WHEN 1 THEN 'ACC' || o_custkey
  ELSE CASE WHEN length('A' || (o_custkey % 100)) >= 4 THEN 'A' || (o_custkey % 100) END END AS account
FROM orders"""

ORACLE["normalize_email"] = """
SELECT doc_id, nullif(lower(regexp_extract(text,
  '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+')), '') AS email FROM documents"""

ORACLE["normalize_mac"] = """
SELECT p_partkey, '00:1A:' || h[1:2] || ':' || h[3:4] || ':' || h[5:6] || ':5E' AS mac
FROM (SELECT p_partkey, upper(lpad(printf('%x', p_partkey), 6, '0')) AS h FROM part)"""

ORACLE["normalize_ip"] = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2001:db8::' || printf('%x', k + 1)
  WHEN 1 THEN '10.1.' || k || '.7' WHEN 2 THEN '10.2.0.' || k END AS ip
FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""

ORACLE["parse_amount"] = """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
  CASE WHEN l_orderkey % 4 < 3 THEN round(l_extendedprice, 2) END AS amount FROM lineitem"""

ORACLE["parse_event_time"] = """
SELECT event_id, epoch_us(CASE WHEN event_id % 5 = 1 AND day(ts) <= 12
  THEN strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%m/%d/%Y %H:%M:%S')
  ELSE date_trunc('second', ts) END) AS event_us FROM events"""

_MASK_ROWS = """v AS (SELECT c_custkey, unnest([
   {'t': 'phone', 'v': '+919' || d}, {'t': 'phone', 'v': '+1' || d || '5'},
   {'t': 'account', 'v': 'CUST' || k}, {'t': 'account', 'v': k || '@okbank'},
   {'t': 'device_imei', 'v': '86' || lpad(k, 13, '0')},
   {'t': 'email_address', 'v': 'u' || k || '@mail.example'},
   {'t': 'ip_address', 'v': '10.0.0.' || k}]) AS s
  FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k,
               lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d FROM customer)),
u AS (SELECT c_custkey, s.t AS t, s.v AS v, split_part(s.v, '@', 1) AS name,
             '@' || split_part(s.v, '@', 2) AS dom,
             CASE WHEN s.v LIKE '+1%' THEN '+1' ELSE '+91' END AS cc FROM v)"""
_MAIL = ("CASE WHEN length(name) <= 2 THEN repeat('*', length(name)) ELSE name[1] || "
         "repeat('*', length(name) - 2) || right(name, 1) END || dom")
ORACLE["mask_identifiers"] = "WITH " + _MASK_ROWS + f"""
SELECT c_custkey, t AS entity_type, v AS value,
 CASE t WHEN 'phone' THEN cc || {_star('substr(v, length(cc) + 1)')}
   WHEN 'account' THEN CASE WHEN v LIKE '%@%' THEN CASE WHEN length(name) = 1 THEN '*'
        WHEN length(name) <= 4 THEN repeat('*', length(name) - 1) || right(name, 1)
        ELSE repeat('*', length(name) - 4) || right(name, 4) END || dom ELSE {_star('v')} END
   WHEN 'device_imei' THEN {_star('v')} WHEN 'email_address' THEN {_MAIL} ELSE v END AS masked,
 CASE WHEN t = 'phone' THEN cc || {_star('substr(v, length(cc) + 1)')}
   WHEN v LIKE '%@%' THEN {_MAIL} WHEN t = 'device_imei' THEN {_star('v')} ELSE v END AS masked_by_look,
 CASE WHEN length(v) <= 4 THEN v ELSE left(v, least(3, length(v) - 4))
   || repeat('•', length(v) - least(3, length(v) - 4) - 4) || right(v, 4) END AS console FROM u"""

ORACLE["guess_source"] = """
SELECT page_id, CASE WHEN u LIKE '%.eml' OR contains(u, 'mail') THEN 'email'
  WHEN contains(u, 'bank') OR contains(u, 'upi') OR contains(u, 'transaction') OR contains(u, 'ledger')
    THEN 'bank_upi'
  WHEN contains(u, 'ipdr') THEN 'ipdr'
  WHEN contains(u, 'android') OR contains(u, 'log') OR u LIKE '%.txt' THEN 'android_log'
  ELSE 'cdr' END AS source_type FROM (SELECT page_id, lower(url) AS u FROM pages)"""

ORACLE["label_bands"] = f"""
SELECT s AS score, CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 40 THEN 'MEDIUM'
  ELSE 'LOW' END AS tier,
  CASE WHEN s >= 70 THEN 'critical' WHEN s >= 40 THEN 'elevated' ELSE 'baseline' END AS severity,
  c AS confidence, {_LABEL.format(c='c')} AS confidence_label,
  CASE WHEN s > 50 THEN 'Recommended for investigator review — do not act without independent corroboration of the evidence.'
  ELSE 'No significant fraud indicators detected at this time. Continue routine monitoring.' END AS advice
FROM (SELECT DISTINCT CAST(l_quantity AS INT) * 2 AS s, round(l_quantity / 50, 2) AS c FROM lineitem)"""

ORACLE["reason_labels"] = """
SELECT code, count(*) AS n, CASE code
  WHEN 'HIGH_VELOCITY_ROUTING' THEN 'Rapid fund layering connecting to 3+ distinct entities within a 10-minute window'
  WHEN 'SIM_SWITCHING_PATTERN' THEN 'Physical handset cycling through 3+ distinct phone numbers within 24 hours'
  ELSE lower(replace(code, '_', ' ')) END AS plain,
  CASE code WHEN 'HIGH_VELOCITY_ROUTING' THEN 45 WHEN 'SIM_SWITCHING_PATTERN' THEN 40 ELSE 0 END AS weight
FROM (SELECT CASE event_type WHEN 'click' THEN 'HIGH_VELOCITY_ROUTING' WHEN 'view' THEN 'SIM_SWITCHING_PATTERN'
      ELSE upper(event_type) || '_SEEN' END AS code FROM events) GROUP BY code"""

ORACLE["artifact_hashes"] = "SELECT doc_id, sha256(text) AS file_hash FROM documents"

# --- records, entities, links ---------------------------------------------------

_REF = ("SELECT case_id, file, rec, {rn} AS rn, {fn} AS fn, '{rt}' AS rt, {r} AS rv, '{tt}' AS tt, "
        "{t} AS tv, '{lt}' AS lt, {c}::DOUBLE AS c FROM r")


def _refs(rules: list[tuple]) -> str:
    return " UNION ALL ".join(
        _REF.format(rn=rn, fn=fn, rt=rt, r=r, tt=tt, t=t, lt=lt, c=c)
        for rn, fn, rt, r, tt, t, lt, c in rules)


_CALL_REFS = _refs([
    (0, 0, "phone", "caller", "device_imei", "imei", "shared_imei", 0.95),
    (0, 1, "phone", "caller", "phone", "callee", "direct_communication", 0.90),
    (0, 2, "phone", "caller", "ip_address", "ip", "shared_ip_subnet", 0.85),
    (1, 0, "phone", "callee", "phone", "caller", "direct_communication", 0.90),
    (2, 0, "device_imei", "imei", "phone", "caller", "shared_imei", 0.95),
    (3, 0, "ip_address", "ip", "phone", "caller", "shared_ip_subnet", 0.85)])
ORACLE["call_refs"] = _with(_calls(), f"f AS ({_CALL_REFS})") + """
SELECT case_id, file AS evidence_file_id, rec AS rec_no, rn AS root_no, fn AS ref_no, rt AS root_type,
  rv AS root_value, tt AS target_type, tv AS target_value, lt AS link_type, c AS confidence FROM f"""

_LEDGER_REFS = _refs([
    (0, 0, "account", "sender", "account", "receiver", "transaction", 0.95),
    (0, 1, "account", "sender", "account", "upi", "shared_upi_handle", 0.90),
    (0, 2, "account", "sender", "phone", "phone", "shared_upi_handle", 0.88),
    (1, 0, "account", "receiver", "account", "sender", "transaction", 0.95),
    (1, 1, "account", "receiver", "account", "upi", "shared_upi_handle", 0.95),
    (1, 2, "account", "receiver", "phone", "phone", "shared_upi_handle", 0.92),
    (2, 0, "account", "upi", "account", "receiver", "shared_upi_handle", 0.95),
    (2, 1, "account", "upi", "account", "sender", "shared_upi_handle", 0.90),
    (2, 2, "account", "upi", "phone", "phone", "shared_upi_handle", 0.98),
    (3, 0, "phone", "phone", "account", "upi", "shared_upi_handle", 0.98),
    (3, 1, "phone", "phone", "account", "receiver", "shared_upi_handle", 0.92)])
ORACLE["ledger_refs"] = _with(_LEDGER, f"f AS ({_LEDGER_REFS})") + """
SELECT case_id, rn AS root_no, fn AS ref_no, rt AS root_type, tt AS target_type, lt AS link_type,
  count(*) AS n, count(DISTINCT rv) AS roots, count(DISTINCT tv) AS targets, min(c) AS lo, max(c) AS hi
FROM f GROUP BY ALL"""

_ENTITY_ROWS = """
SELECT case_id, eid AS entity_id, t AS entity_type, v AS value, epoch_us(fs) AS first_seen_us,
  arr[1] AS first_file_id FROM ent"""
ORACLE["entities_calls"] = _with(_calls(), _ENT) + _ENTITY_ROWS
ORACLE["entities_ledger"] = _with(_LEDGER, _ENT) + _ENTITY_ROWS

ORACLE["entity_counts_per_file"] = _with(*CALLS) + """
SELECT case_id, evidence_file_id, CAST(sum(e) AS BIGINT) AS entities_created,
  CAST(sum(k) AS BIGINT) AS links_created FROM (
  SELECT case_id, arr[1] AS evidence_file_id, 1 AS e, 0 AS k FROM ent
  UNION ALL SELECT case_id, src_file, 0, 1 FROM link) GROUP BY ALL"""

_LINK_ROWS = """
SELECT case_id, lid AS link_id, a AS entity_a_id, b AS entity_b_id, lt AS link_type,
  conf AS confidence_score, src_file AS source_evidence_file_id FROM link"""
ORACLE["entity_links_calls"] = _with(_calls(), _ENT, _link()) + _LINK_ROWS
ORACLE["entity_links_ledger"] = _with(_LEDGER, _ENT, _link()) + _LINK_ROWS

ORACLE["entity_lookup"] = _with(_LEDGER, _ENT) + """
SELECT s_suppkey, count(DISTINCT case_id) AS cases, count(*) AS entities
FROM ent JOIN supplier ON t = 'account' AND v = 'SUPPACC' || s_suppkey GROUP BY s_suppkey"""

ORACLE["incremental_resolve"] = _with(_LEDGER) + f""",
em AS (SELECT case_id, t, v, CASE WHEN min(ts) < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END AS batch,
   FROM m GROUP BY case_id, t, v),
ea AS (SELECT em.case_id, em.t, em.v, any_value(batch) AS batch, min({_KEY}) AS arr FROM em JOIN m
   ON em.case_id = m.case_id AND em.t = m.t AND em.v = m.v
   AND (CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END) = batch GROUP BY em.case_id, em.t, em.v),
ent AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY batch, arr, t, v) AS eid FROM ea),
lt AS (SELECT l.*, CASE WHEN r.ts < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END AS batch
   FROM l JOIN (SELECT file, rec, sender, receiver, min(ts) AS ts FROM r GROUP BY ALL) r
   ON l.file = r.file AND l.rec = r.rec),
lk AS (SELECT case_id, least(aty || av, bty || bv) AS a, greatest(aty || av, bty || bv) AS b, lt,
   min(batch) AS batch FROM lt WHERE aty || av <> bty || bv GROUP BY ALL),
ln AS (SELECT case_id, batch, count(*) AS links, any_value(prior) + count(*) AS highest_link FROM (
   SELECT *, (SELECT count(*) FROM lk o WHERE o.case_id = lk.case_id AND o.batch < lk.batch) AS prior
   FROM lk) GROUP BY case_id, batch)
SELECT e.case_id, e.batch, count(*) AS entities, min(eid) AS lowest_id, max(eid) AS highest_id,
  any_value(links) AS links, any_value(highest_link) AS highest_link
FROM ent e LEFT JOIN ln ON ln.case_id = e.case_id AND ln.batch = e.batch GROUP BY e.case_id, e.batch"""

# --- graph -----------------------------------------------------------------------

_EDGE_ROWS = f"""
SELECT case_id, a AS src, b AS dst, round(conf, 4) AS confidence, lt AS link_type, lts AS link_types,
  n AS link_count, round(1 / greatest(conf, 0.0001), 6) AS inverse_confidence,
  {_LABEL.format(c='round(conf, 4)')} AS confidence_label FROM edge"""
ORACLE["graph_edges"] = _with(*CALLS) + _EDGE_ROWS
ORACLE["graph_edges_ledger"] = _with(*LEDGER) + _EDGE_ROWS
ORACLE["graph_edges_stored_scores"] = _with(_LEDGER, _ENT, _link(), _edge("conf")) + _EDGE_ROWS
ORACLE["graph_edges_corroborated"] = _with(
    _calls("%Y%m%d"), _ENT, _link("evidence"), _edge()) + _EDGE_ROWS

ORACLE["graph_clusters"] = _with(*LEDGER, _CC) + """
SELECT case_id, eid AS entity_id, cid AS cluster_id, size AS cluster_size FROM clu"""
ORACLE["cluster_medians"] = _with(*CALLS, _CC) + """
SELECT case_id, count(*) AS n_clusters, max(size) AS largest, median(size) AS median_size
FROM sz GROUP BY case_id"""

ORACLE["strongest_paths"] = _with(*LEDGER) + """,
ends AS (SELECT case_id, min(eid) AS source, max(eid) AS target FROM ent GROUP BY case_id),
sp(case_id, n, cost) USING KEY (case_id, n) AS (
  SELECT case_id, source, 0::DOUBLE FROM ends
  UNION
  SELECT s.case_id, s.x, min(q.cost + 1 / s.conf) FROM sp q
    JOIN sym s ON s.case_id = q.case_id AND s.y = q.n
    LEFT JOIN recurring.sp p ON p.case_id = s.case_id AND p.n = s.x
  WHERE p.cost IS NULL OR q.cost + 1 / s.conf < p.cost - 1e-9 GROUP BY s.case_id, s.x)
SELECT e.case_id, source, target, round(cost, 6) AS cost,
  CASE WHEN source <> target THEN round(cost, 6) END AS path_cost, cost IS NOT NULL AS connected,
  CASE WHEN cost IS NOT NULL THEN source END AS path_start,
  CASE WHEN cost IS NOT NULL THEN target END AS path_end
FROM ends e LEFT JOIN sp ON sp.case_id = e.case_id AND sp.n = target"""

ORACLE["neighbourhood"] = _with(*CALLS) + f"""
SELECT s.case_id, x AS node, y AS peer, t AS peer_type, v AS peer_value, lt AS link_type,
  round(conf, 4) AS confidence, {_LABEL.format(c='round(conf, 4)')} AS confidence_label
FROM sym s JOIN ent ON ent.case_id = s.case_id AND eid = y"""

ORACLE["serialized_graph"] = _with(*CALLS, _CC) + f"""
SELECT ent.case_id, 'node' AS kind, ent.eid AS first_id, cid AS second, t AS entity_type, v AS value,
  NULL::DOUBLE AS confidence, NULL::VARCHAR AS label FROM ent JOIN clu USING (case_id, eid)
UNION ALL SELECT case_id, 'edge', a, b, lt, NULL, round(conf, 4), {_LABEL.format(c='round(conf, 4)')}
FROM edge"""

# --- risk ------------------------------------------------------------------------

_DEG = """
deg AS (SELECT case_id, x AS eid, count(*) AS hops FROM sym GROUP BY ALL)"""
_SIM = """
tl AS (SELECT k.case_id, k.lid, k.a, k.b, x.t AS aty, y.t AS bty, x.v AS av, y.v AS bv,
   epoch_us(x.fs) AS aus, epoch_us(y.fs) AS bus FROM link k
   JOIN ent x ON x.case_id = k.case_id AND x.eid = a JOIN ent y ON y.case_id = k.case_id AND y.eid = b
   WHERE lt = 'shared_imei'),
dp AS (SELECT case_id, lid, a AS dev, b AS ph, av AS imei, bus AS us, 1 AS side FROM tl
       WHERE aty = 'device_imei' AND bty = 'phone'
       UNION ALL SELECT case_id, lid, b, a, bv, aus, 0 FROM tl WHERE bty = 'device_imei' AND aty = 'phone'),
cnt AS (SELECT case_id, dev, us, imei, count(*) OVER (PARTITION BY case_id, dev ORDER BY us
   RANGE BETWEEN {start} AND {width} FOLLOWING) AS n FROM dp),
dv AS (SELECT case_id, dev, any_value(imei) AS imei, arg_min(n, us) AS n FROM cnt WHERE n >= 3
       GROUP BY ALL HAVING true),
sim AS (SELECT case_id, dev AS eid, imei, n FROM dv UNION ALL
  SELECT dp.case_id, ph, arg_min(dp.imei, [side, lid]), 3 FROM dp JOIN dv USING (case_id, dev)
  GROUP BY dp.case_id, ph)"""
_SIM = _SIM.replace("GROUP BY ALL HAVING true", "GROUP BY case_id, dev")
_SIM_REF_24 = _SIM.format(start="UNBOUNDED PRECEDING", width=86_400_000_000)

ORACLE["risk_velocity"] = _with(*CALLS, _DEG) + """
SELECT case_id, eid AS entity_id, hops AS n_hops FROM deg WHERE hops >= 3"""
ORACLE["risk_velocity_windowed"] = _with(*CALLS) + """,
st AS (SELECT s.case_id, s.x AS eid, epoch_us(fs) AS us FROM sym s JOIN ent ON ent.case_id = s.case_id
       AND ent.eid = s.y UNION ALL SELECT case_id, eid, epoch_us(fs) FROM ent),
w AS (SELECT case_id, eid, count(*) OVER (PARTITION BY case_id, eid ORDER BY us
      RANGE BETWEEN CURRENT ROW AND 600000000 FOLLOWING) AS n FROM st)
SELECT case_id, eid AS entity_id, max(n) - 1 AS n_hops FROM w GROUP BY ALL HAVING max(n) - 1 >= 3"""

_SIM_ROWS = " SELECT case_id, eid AS entity_id, imei, n AS n_phones FROM sim"
ORACLE["risk_sim_switch"] = _with(
    *DAILY, _SIM.format(start="UNBOUNDED PRECEDING", width=21_600_000_000)) + _SIM_ROWS
ORACLE["risk_sim_switch_windowed"] = _with(
    *DAILY, _SIM.format(start="CURRENT ROW", width=21_600_000_000)) + _SIM_ROWS

_PEERS = """
pl AS (SELECT case_id, lid, a AS eid, b AS peer, 0 AS side FROM link
         WHERE lt IN ('shared_imei', 'shared_mac')
       UNION ALL SELECT case_id, lid, b, a, 1 FROM link WHERE lt IN ('shared_imei', 'shared_mac'))"""
ORACLE["risk_flagged_peer"] = _with(*CALLS, _DEG, _SIM_REF_24, _PEERS) + """,
hist AS (SELECT ent.case_id, ent.eid, CASE WHEN hops >= 3 THEN 45 ELSE 0 END
   + CASE WHEN sim.n IS NOT NULL THEN 40 ELSE 0 END AS score
   FROM ent LEFT JOIN deg USING (case_id, eid) LEFT JOIN sim USING (case_id, eid))
SELECT pl.case_id, pl.eid AS entity_id, arg_min(peer, [side, lid]) AS peer_id,
  arg_min(score, [side, lid]) AS peer_score FROM pl JOIN hist ON hist.case_id = pl.case_id
  AND hist.eid = peer WHERE score >= 40 GROUP BY pl.case_id, pl.eid"""

ORACLE["risk_flagged_peer_sequential"] = _with(*CALLS, _DEG, _PEERS) + """,
base AS (SELECT ent.case_id, ent.eid, CASE WHEN hops >= 3 THEN 45 ELSE 0 END AS s
         FROM ent LEFT JOIN deg USING (case_id, eid)),
fl(case_id, eid) AS (
  SELECT pl.case_id, pl.eid FROM pl JOIN base b ON b.case_id = pl.case_id AND b.eid = peer
    WHERE peer < pl.eid AND b.s >= 40
  UNION
  SELECT pl.case_id, pl.eid FROM fl JOIN base b ON b.case_id = fl.case_id AND b.eid = fl.eid
    JOIN pl ON pl.case_id = fl.case_id AND peer = fl.eid WHERE peer < pl.eid AND b.s > 0),
now AS (SELECT b.case_id, b.eid, least(100, s + CASE WHEN fl.eid IS NULL THEN 0 ELSE 35 END) AS s
        FROM base b LEFT JOIN fl ON fl.case_id = b.case_id AND fl.eid = b.eid)
SELECT pl.case_id, pl.eid AS entity_id, arg_min(peer, [side, lid]) AS peer_id,
  arg_min(s, [side, lid]) AS peer_score FROM pl JOIN now ON now.case_id = pl.case_id
  AND now.eid = peer WHERE peer < pl.eid AND s >= 40 GROUP BY pl.case_id, pl.eid"""

ORACLE["risk_oversized_cluster"] = _with(*LEDGER, _CC) + """
SELECT case_id, eid AS entity_id, size AS cluster_size, med AS median_size,
  round(size / med, 6) AS ratio FROM clu JOIN med USING (case_id) WHERE size / med >= 1.5"""

_HUB = """
hub AS (SELECT case_id, eid, count(DISTINCT peer) AS n FROM (
  SELECT case_id, a AS eid, b AS peer FROM link WHERE lt = 'transaction'
  UNION ALL SELECT case_id, b, a FROM link WHERE lt = 'transaction')
  GROUP BY case_id, eid HAVING count(DISTINCT peer) >= 3)"""
ORACLE["risk_transaction_hub"] = _with(_LEDGER, _ENT, _link(), _HUB) + """
SELECT case_id, eid AS entity_id, n AS n_senders FROM hub"""
ORACLE["risk_hub_directed"] = _with(_LEDGER) + """
SELECT case_id, 'account' AS entity_type, receiver AS value, count(DISTINCT sender) AS n_senders
FROM r GROUP BY case_id, receiver HAVING count(DISTINCT sender) >= 3"""

_SCORE = """
fired AS (SELECT case_id, eid, 1 AS no, 45 AS w, 'HIGH_VELOCITY_ROUTING' AS code,
    'High-velocity multi-hop routing detected: ' || hops || ' linked entity hops observed within 10 minutes, indicating rapid fund layering.' AS msg
    FROM deg WHERE hops >= 3
  UNION ALL SELECT case_id, eid, 2, 40, 'SIM_SWITCHING_PATTERN',
    'SIM-switching / burner-rotation pattern: same device (IMEI ' || imei || ') linked to ' || n || ' distinct phone numbers within 24h, consistent with deliberate CDR identity obfuscation.'
    FROM sim
  UNION ALL SELECT case_id, eid, 4, 20, 'OVERSIZED_CLUSTER',
    'Embedded in oversized syndicate cluster: cluster contains ' || size || ' entities vs. case median of ' || printf('%.1f', round_even(med, 1))
    || ', indicating broad network membership (' || printf('%.1f', round_even(size / med, 1)) || 'x above median).'
    FROM clu JOIN med USING (case_id) WHERE size / med >= 1.5
  UNION ALL SELECT case_id, eid, 5, 30, 'MULTI_ACCOUNT_TRANSACTION_HUB',
    'Multi-account transaction hub: this entity receives transactions from ' || n || ' distinct sender accounts, consistent with mule aggregation or cash-pooling prior to layering.'
    FROM hub),
sc AS (SELECT ent.case_id, ent.eid, t, v, CAST(least(100, coalesce(sum(w), 0)) AS INT) AS score,
   coalesce(string_agg(code, ',' ORDER BY no), '') AS codes, coalesce(string_agg(msg, ' | ' ORDER BY no), '') AS msgs, count(code) AS reasons
   FROM ent LEFT JOIN fired USING (case_id, eid) GROUP BY ent.case_id, ent.eid, t, v),
rank AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, eid) AS rank FROM sc)"""
_CALL_SCORE = (*CALLS, _CC, _DEG, _SIM_REF_24, _HUB, _SCORE)
_LEDGER_SCORE = (*LEDGER, _CC, _DEG, _SIM_REF_24, _HUB, _SCORE)
_RANK_ROWS = """
SELECT case_id, eid AS entity_id, t AS entity_type, v AS value, score, codes AS reason_codes, rank, msgs AS reason_messages,
  CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM'
  ELSE 'LOW' END AS tier FROM rank"""
ORACLE["risk_ranked"] = _with(*_CALL_SCORE) + _RANK_ROWS
ORACLE["risk_ranked_ledger"] = _with(*_LEDGER_SCORE) + _RANK_ROWS
ORACLE["risk_requested"] = _with(*_LEDGER_SCORE) + """
SELECT e.case_id, e.eid + 1 AS entity_id, coalesce(score, 0) AS score, coalesce(reasons, 0) AS n_reasons
FROM ent e LEFT JOIN sc ON sc.case_id = e.case_id AND sc.eid = e.eid + 1"""
ORACLE["risk_types"] = _with(_calls(), _ENT) + "SELECT DISTINCT case_id, t AS entity_type FROM ent"

# --- custody -----------------------------------------------------------------------

_FILES = """
f AS (SELECT o_custkey AS case_id, o_orderkey AS evidence_file_id, o_orderkey AS entry_id,
  sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS file_hash
  FROM orders),
h AS (SELECT case_id, list(entry_id ORDER BY entry_id) AS ids, list(file_hash ORDER BY entry_id) AS hs
  FROM f GROUP BY case_id),
c0 AS (SELECT case_id, unnest(ids) AS entry_id, unnest(hs) AS file_hash,
  unnest(list_transform(range(1, len(hs) + 1), lambda i: list_reduce(
    list_prepend('GENESIS', hs[1:i]), lambda a, x: sha256(x || ':' || a)))) AS chained_hash FROM h),
ch AS (SELECT *, lag(chained_hash) OVER (PARTITION BY case_id ORDER BY entry_id) AS previous_hash FROM c0)"""
_CHAIN_ROWS = """
SELECT case_id, entry_id AS evidence_file_id, entry_id, file_hash, previous_hash, chained_hash FROM ch"""
ORACLE["custody_build"] = _with(_FILES) + _CHAIN_ROWS
ORACLE["custody_extend"] = _with(_FILES) + _CHAIN_ROWS
ORACLE["custody_heads"] = _with(_FILES) + """
SELECT case_id, arg_max(chained_hash, entry_id) AS head_hash, max(entry_id) AS head_entry_id
FROM ch GROUP BY case_id"""

_TAMPERED = """
tp AS (SELECT case_id, entry_id, CASE WHEN entry_id % 97 = 0 THEN sha256('altered') ELSE file_hash END
    AS file_hash, chained_hash,
    CASE WHEN entry_id % 101 = 1 THEN 'cut' ELSE previous_hash END AS previous_hash
  FROM ch WHERE entry_id % 89 <> 2 AND case_id % 50 <> 7),
ord AS (SELECT *, row_number() OVER w - 1 AS idx, lag(chained_hash) OVER w AS prior FROM tp
  WINDOW w AS (PARTITION BY case_id ORDER BY entry_id)),
br AS (SELECT *, CASE WHEN idx = 0 AND previous_hash IS NOT NULL
    THEN 'Genesis entry contains unexpected previous_hash'
  WHEN idx > 0 AND previous_hash IS DISTINCT FROM prior
    THEN 'missing entry or broken link: previous_hash does not match preceding chained_hash'
  WHEN chained_hash <> sha256(file_hash || ':' || coalesce(prior, 'GENESIS'))
    THEN 'hash mismatch: recomputed chained_hash does not match stored value' END AS reason FROM ord),
fb AS (SELECT case_id, min(idx) AS idx, arg_min(entry_id, idx) AS entry_id, arg_min(reason, idx) AS reason
  FROM br WHERE reason IS NOT NULL GROUP BY case_id),
tot AS (SELECT case_id, count(*) AS n, arg_max(chained_hash, entry_id) AS head FROM tp GROUP BY case_id),
gap AS (SELECT f.case_id, count(*) AS g FROM f LEFT JOIN tp ON tp.entry_id = f.evidence_file_id
  WHERE tp.entry_id IS NULL GROUP BY f.case_id),
rep AS (SELECT c_custkey AS case_id, fb.reason IS NULL AND coalesce(g, 0) = 0 AS is_valid,
  coalesce(n, 0) AS total_entries, fb.entry_id AS broken_entry_id, fb.idx AS broken_index,
  CASE WHEN fb.reason IS NOT NULL THEN fb.reason
    WHEN g > 0 AND n IS NULL THEN 'missing entry: Evidence files exist for case but custody log is empty'
    WHEN g > 0 THEN 'missing entry: one or more evidence files lack corresponding custody log entries'
    WHEN n IS NULL THEN 'No custody log entries found for case (empty chain)' END AS reason,
  coalesce(g, 0) AS unlogged_files,
  CASE WHEN fb.reason IS NULL AND coalesce(g, 0) = 0 THEN head END AS head_hash,
  CASE WHEN fb.reason IS NULL AND coalesce(g, 0) = 0 THEN coalesce('head_hash=' || head, '')
    WHEN fb.reason IS NULL THEN 'unlogged_files=' || g
    WHEN fb.reason LIKE 'hash%' THEN concat_ws(',', 'entry_id=' || fb.entry_id, 'file_hash=' || file_hash,
      'recomputed_chained_hash=' || sha256(file_hash || ':' || coalesce(prior, 'GENESIS')),
      'stored_chained_hash=' || chained_hash)
    ELSE concat_ws(',', 'entry_id=' || fb.entry_id, 'expected_previous_hash=' || prior,
      'stored_previous_hash=' || previous_hash) END AS details
  FROM customer LEFT JOIN fb ON fb.case_id = c_custkey LEFT JOIN tot ON tot.case_id = c_custkey
  LEFT JOIN br ON br.case_id = c_custkey AND br.entry_id = fb.entry_id
  LEFT JOIN gap ON gap.case_id = c_custkey)"""
ORACLE["custody_verify"] = _with(_FILES, _TAMPERED) + "SELECT * FROM rep"
ORACLE["custody_unlogged"] = _with(_FILES, _TAMPERED) + """
SELECT f.case_id, evidence_file_id FROM f LEFT JOIN tp ON tp.entry_id = evidence_file_id
WHERE tp.entry_id IS NULL"""
ORACLE["custody_drift"] = _with(_FILES) + "SELECT case_id, evidence_file_id FROM f WHERE entry_id % 97 = 0"
_STATEMENT = """CASE WHEN is_valid THEN 'Tamper-evident chain of custody mathematically verified intact from genesis to head across '
 || total_entries || ' evidentiary artifact(s). Complies with Section 65B of the Indian Evidence Act, 1872 and Section 63 of the Bharatiya Sakshya Adhiniyam, 2023.'
 ELSE 'WARNING: Cryptographic custody chain verification FAILED. Discrepancy detected: ' || reason || '.' END"""
ORACLE["custody_statements"] = _with(_FILES, _TAMPERED) + f"""
SELECT case_id, is_valid, {_STATEMENT} AS statutory_statement FROM rep"""

# --- reports --------------------------------------------------------------------------

_CASES = """
fl AS (SELECT c_nationkey::BIGINT * 1000000 + CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS case_id,
  o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
met AS (SELECT case_id, count(*) AS total_evidence_files,
  coalesce((SELECT count(*) FROM ent WHERE ent.case_id = fl.case_id), 0) AS total_entities,
  coalesce((SELECT count(*) FROM link WHERE link.case_id = fl.case_id), 0) AS total_links,
  coalesce((SELECT count(*) FROM sz WHERE sz.case_id = fl.case_id), 0) AS total_clusters
  FROM fl GROUP BY case_id)"""
ORACLE["case_metrics"] = _with(*LEDGER, _CC, _CASES) + "SELECT * FROM met"

_MASKED = f"""CASE t WHEN 'phone' THEN '+91' || {_star('substr(v, 4)')}
  WHEN 'device_imei' THEN {_star('v')}
  WHEN 'account' THEN CASE WHEN v LIKE '%@%' THEN repeat('*', length(split_part(v, '@', 1)) - 4)
     || right(split_part(v, '@', 1), 4) || '@' || split_part(v, '@', 2) ELSE {_star('v')} END
  ELSE v END"""
ORACLE["top_entities"] = _with(*_CALL_SCORE) + f"""
SELECT case_id, rank, eid AS entity_id, t AS entity_type, {_MASKED} AS identifier, score
FROM rank WHERE rank <= 10"""

_SUMMARY = """
sm AS (SELECT case_id, cid, count(*) AS node_count, array_to_string(list_sort(list(DISTINCT t)), ',') AS types,
  count(*) FILTER (score >= 40) AS high FROM clu JOIN sc USING (case_id, eid) GROUP BY case_id, cid)"""
ORACLE["cluster_summary"] = _with(*_LEDGER_SCORE, _SUMMARY) + """
SELECT case_id, cid AS cluster_id, node_count, types AS entity_types, high AS high_risk_entity_count
FROM sm"""

_BRIEF_CHAIN = """
bh AS (SELECT case_id, list(sha256(CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey) AS hs
  FROM fl GROUP BY case_id),
bc AS (SELECT case_id, len(hs) AS entries, list_reduce(list_prepend('GENESIS', hs),
  lambda a, x: sha256(x || ':' || a)) AS head FROM bh)"""
ORACLE["brief_digest"] = _with(*_LEDGER_SCORE, _CASES, _BRIEF_CHAIN) + f""",
first AS (SELECT case_id, {_MASKED} AS ident, score FROM rank WHERE rank = 1)
SELECT met.case_id, least(total_entities, 5) AS shown_entities,
  least(total_clusters, 3) AS shown_clusters,
  greatest(total_entities - 5, 0) AS more_entities, greatest(total_clusters - 3, 0) AS more_clusters,
  'VERIFIED INTACT' AS custody_status, left(head, 32) || '...' AS head_hash_shown,
  ident AS first_identifier, score AS first_score,
  CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'elevated' WHEN score IS NOT NULL THEN 'baseline'
  END AS first_severity,
  (SELECT max(size) FROM sz WHERE sz.case_id = met.case_id) AS largest_cluster
FROM met JOIN bc USING (case_id) LEFT JOIN first USING (case_id)"""

ORACLE["brief_sections"] = _with(*_LEDGER_SCORE, _SUMMARY, _CASES, _BRIEF_CHAIN) + """
SELECT case_id, 'case_summary' AS section, 1::BIGINT AS item_no, total_links AS figure FROM met
UNION ALL SELECT case_id, 'custody_chain', 1, entries FROM bc
UNION ALL SELECT case_id, 'top_entities', rank, score FROM rank WHERE rank <= 10
UNION ALL SELECT case_id, 'clusters', cid + 1, node_count FROM sm"""

_ADVICE = """CASE WHEN score > 0 THEN 'Recommended for investigator review — do not act without independent corroboration of the evidence.'
  ELSE 'No significant fraud indicators detected at this time. Continue routine monitoring.' END"""
ORACLE["brief_documents"] = _with(*_LEDGER_SCORE, _SUMMARY, _CASES, _BRIEF_CHAIN) + f"""
SELECT case_id, 'case_summary' AS section, 1::BIGINT AS item_no, CAST(json_object(
    'classification', 'LAW ENFORCEMENT SENSITIVE // OFFICIAL INVESTIGATIVE BRIEF', 'generated_at', '2024-01-01T00:00:00.000',
    'name', 'Ledger ' || case_id, 'status', CASE WHEN case_id % 2 = 0 THEN 'active' ELSE 'archived' END,
    'total_evidence_files', total_evidence_files, 'total_entities', total_entities, 'total_links', total_links,
    'total_clusters', total_clusters) AS VARCHAR) AS body FROM met
UNION ALL SELECT case_id, 'custody_chain', 1, CAST(json_object('is_valid', true, 'total_entries', entries, 'head_hash', head,
    'statutory_statement', {_STATEMENT}, 'broken_reason', NULL, 'details', json_object('head_hash', head)) AS VARCHAR)
  FROM (SELECT *, true AS is_valid, entries AS total_entries, NULL AS reason FROM bc) rep
UNION ALL SELECT case_id, 'top_entities', rank, CAST(json_object('rank', rank, 'entity_id', eid, 'entity_type', t, 'identifier', {_MASKED},
    'score', score, 'reason_codes', CASE codes WHEN '' THEN [] ELSE string_split(codes, ',') END,
    'reason_messages', CASE msgs WHEN '' THEN [] ELSE string_split(msgs, ' | ') END, 'recommendation', {_ADVICE}) AS VARCHAR)
  FROM rank WHERE rank <= 10
UNION ALL SELECT case_id, 'clusters', cid + 1, CAST(json_object('cluster_id', cid, 'node_count', node_count,
    'entity_types', string_split(types, ','), 'high_risk_entity_count', high) AS VARCHAR) FROM sm"""

ORACLE["case_list"] = """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'archived' END AS status, count(*) AS n,
  CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) + 1 END
    AS lowest,
  CASE WHEN s_suppkey % 2 = 0 THEN count(*) ELSE (SELECT count(*) FROM supplier) END AS highest,
  count(*) AS ids, count(*) AS names FROM supplier GROUP BY s_suppkey % 2"""

ORACLE["integrity_violations"] = _with(_calls(), _ENT, _link()) + """
SELECT case_id, 'link_endpoint_b_missing' AS violation, count(*) AS n FROM link WHERE lid % 7 = 3
GROUP BY case_id
UNION ALL SELECT case_id, 'confidence_out_of_range', count(*) FROM link WHERE lid % 5 = 1 GROUP BY case_id"""


ORACLE["integrity_all_rules"] = _with(_calls(), _ENT, _link()) + """,
sf AS (SELECT DISTINCT case_id, src_file FROM link)
SELECT case_id, 'link_endpoint_a_missing' AS violation, count(*) AS n FROM link WHERE lid % 11 = 2 GROUP BY case_id
UNION ALL SELECT case_id, 'link_endpoint_b_missing', count(*) FROM link WHERE lid % 7 = 3 GROUP BY case_id
UNION ALL SELECT case_id, 'confidence_out_of_range', count(*) FROM link WHERE lid % 5 = 1 GROUP BY case_id
UNION ALL SELECT case_id, 'link_file_missing', count(*) FROM link WHERE src_file % 3 = 1 GROUP BY case_id
UNION ALL SELECT case_id, 'score_entity_missing', count(*) FROM ent WHERE eid % 9 = 4 GROUP BY case_id
UNION ALL SELECT case_id, 'score_out_of_range', count(*) FROM ent WHERE eid % 13 IN (5, 6) GROUP BY case_id
UNION ALL SELECT case_id, 'file_case_missing', count(*) FROM sf WHERE src_file % 3 <> 1 AND case_id % 4 = 1 GROUP BY case_id"""


# --- evidence files built from the tables -------------------------------------------------

ORACLE["csv_call_rows"] = _with(_calls()) + """
SELECT case_id, file AS evidence_file_id, 'row_' || (rec + 1) AS row_ref,
  CASE WHEN ok THEN caller END AS caller, CASE WHEN ok THEN callee END AS callee,
  CASE WHEN ok THEN imei END AS imei, CASE WHEN ok THEN ip END AS ip,
  epoch_us(date_trunc('second', ts)) AS event_us, 6 AS n_cells,
  CASE WHEN NOT ok THEN 'Row ' || (rec + 1) || ' skipped: no valid phone, IMEI, or IP found.' END
    AS skipped_reason
FROM (SELECT *, file % 10 <> 2 AS ok FROM r)"""

ORACLE["csv_ledger_rows"] = """
SELECT o_custkey AS evidence_file_id, o_orderkey + 1 AS row_no,
  CASE WHEN ok THEN 'ACC' || o_custkey END AS sender,
  CASE WHEN ok AND length('BR' || (o_orderkey % 1000)) >= 4 THEN 'BR' || (o_orderkey % 1000) END AS receiver,
  CASE WHEN ok THEN 'u' || o_custkey || '@bank' END AS upi, round(o_totalprice, 2) AS amount,
  epoch_us(CASE WHEN day(o_orderdate) <= 12
    THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)
    ELSE o_orderdate END) AS event_us,
  CASE WHEN NOT ok THEN 'Row ' || (o_orderkey + 1) || ' skipped: missing valid sender, receiver, or UPI.' END
    AS skipped_reason
FROM (SELECT *, o_custkey % 5 <> 0 AS ok FROM orders)"""

ORACLE["csv_rejections"] = """
SELECT 1::BIGINT AS case_id, c_custkey AS evidence_file_id,
  CASE WHEN c_custkey % 7 = 0 OR o_custkey IS NULL THEN 'EmptyFileError' ELSE 'MissingColumnError' END
    AS error_class
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey
WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR o_custkey IS NULL"""

_NAMED = _calls().replace("FROM r)", "FROM r WHERE file % 10 <> 2)").replace(
    "FROM r\n", "FROM r WHERE file % 10 <> 2\n")
ORACLE["csv_ingestion_summary"] = _with(_NAMED, _ENT, _link()) + """
SELECT f.case_id, f.file AS evidence_file_id,
  CASE WHEN f.file % 10 <> 2 THEN n ELSE 0 END AS rows_processed,
  CASE WHEN f.file % 10 = 2 THEN n ELSE 0 END AS rows_skipped,
  (SELECT count(*) FROM ent WHERE arr[1] = f.file AND ent.case_id = f.case_id) AS entities_created,
  (SELECT count(*) FROM link WHERE src_file = f.file AND link.case_id = f.case_id) AS links_created
FROM (SELECT case_id, file, count(*) AS n FROM r GROUP BY ALL) f"""

_MAILS = """
ml AS (SELECT conv_id AS case_id, conv_id * 1000 + turn AS file, turn,
  CASE WHEN role = 'user' THEN 'caller.' || conv_id ELSE 'desk' END || '@mail.example' AS sender,
  ['a' || conv_id || '@x.example', 'b@y.example', 'copy@z.example'] AS rc,
  ['10.9.' || (conv_id % 250) || '.' || turn, '192.0.2.7'] AS hops FROM conversations)"""
ORACLE["mail_messages"] = _with(_MAILS) + """
SELECT case_id, file AS evidence_file_id, sender, array_to_string(rc, ',') AS recipients,
  array_to_string(hops, ',') AS hops, '<' || case_id || '.' || turn || '>' AS row_ref,
  epoch_us(TIMESTAMP '2024-03-15 10:15:00') AS event_us, NULL::VARCHAR AS error_class FROM ml"""
ORACLE["mail_links"] = _with(_MAILS, """
x AS (SELECT case_id, file, 1 AS rec, unnest(range(6)) AS pos, NULL::TIMESTAMP AS ts, sender,
   unnest([sender] || rc || hops) AS v FROM ml),
m AS (SELECT case_id, file, rec, pos, CASE WHEN pos < 4 THEN 'email_address' ELSE 'ip_address' END AS t,
   v, ts FROM x),
l AS (SELECT case_id, file, rec, pos, 'email_address' AS aty, sender AS av,
   CASE WHEN pos < 4 THEN 'email_address' ELSE 'ip_address' END AS bty, v AS bv,
   CASE WHEN pos < 4 THEN 'direct_communication' ELSE 'shared_ip_subnet' END AS lt,
   CASE WHEN pos < 4 THEN 0.95 ELSE 0.85 END::DOUBLE AS conf FROM x WHERE pos > 0)""", _ENT, _link()) + """
SELECT k.case_id, k.a AS entity_a_id, k.b AS entity_b_id, x.v AS a, y.v AS b, lt AS link_type,
  conf AS confidence_score FROM link k JOIN ent x ON x.case_id = k.case_id AND x.eid = k.a
  JOIN ent y ON y.case_id = k.case_id AND y.eid = k.b"""

_JSON_FOUND = """
jf AS (SELECT case_id, rec AS file, unnest([
   {'t': 'device_imei', 'v': imei}, {'t': 'ip_address', 'v': ip},
   {'t': 'phone', 'v': caller},
   {'t': 'mac_address', 'v': '02:00:00:00:00:' || lpad(CAST(rec % 100 AS VARCHAR), 2, '0')}]) AS s FROM r),
fd AS (SELECT DISTINCT case_id, file, s.t AS t, s.v AS v FROM jf)"""
ORACLE["json_identifiers"] = _with(_calls(), _JSON_FOUND) + """
SELECT case_id, file AS evidence_file_id, t AS entity_type, v AS value FROM fd"""
ORACLE["json_packages"] = _with(_calls()) + """
SELECT case_id, rec AS evidence_file_id, 3::BIGINT AS rows_processed, 0::BIGINT AS rows_skipped,
  'com.sample.app' AS package FROM r"""

_OCT = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TEXT_FOUND = rf"""
tx AS (SELECT CAST(list_position(['de','en','es','fr'], lang) AS BIGINT) AS case_id, doc_id * 2 AS file, text
       FROM documents UNION ALL SELECT 9, page_id * 2 + 1, html FROM pages),
ln AS (SELECT case_id, file, unnest(regexp_split_to_array(text,
   '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM tx),
lx AS (SELECT case_id, file, line, regexp_extract_all(line, '\b[0-9]{{14,16}}\b') AS imeis,
   regexp_extract_all(line, '\b(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}\b') AS macs,
   regexp_extract_all(line, '\b{_OCT}(?:\.{_OCT}){{3}}\b') AS ips,
   regexp_extract(line, '(?i)(?:phone|msisdn|tel)[:=]\s*(\+?[0-9]{{10,15}})', 1) AS ph
   FROM ln WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
fd0 AS (SELECT case_id, file, 'device_imei' AS t, unnest(imeis) AS v FROM lx
   UNION ALL SELECT case_id, file, 'mac_address', upper(replace(unnest(macs), '-', ':')) FROM lx
   UNION ALL SELECT case_id, file, 'ip_address', unnest(ips) FROM lx
   UNION ALL SELECT case_id, file, 'phone', CASE WHEN ph[1:2] = '00' THEN '+' || ph[3:]
      WHEN ph[1] = '+' THEN ph WHEN length(ph) = 10 AND ph[1] BETWEEN '6' AND '9' THEN '+91' || ph
      WHEN length(ph) = 10 AND ph[1] BETWEEN '2' AND '5' THEN '+1' || ph ELSE '+' || ph END
   FROM lx WHERE ph <> ''),
fd AS (SELECT DISTINCT * FROM fd0)"""
ORACLE["extract_identifiers"] = _with(_TEXT_FOUND) + """
SELECT case_id, file AS evidence_file_id, t AS entity_type, v AS value FROM fd"""
ORACLE["log_line_outcomes"] = _with(_TEXT_FOUND) + """
SELECT case_id, file AS evidence_file_id, count(*) FILTER (hit) AS rows_processed,
  count(*) FILTER (NOT hit) AS rows_skipped
FROM (SELECT *, len(imeis) + len(macs) + len(ips) > 0 OR ph <> '' AS hit FROM lx) GROUP BY ALL"""

_DAILY_ROWS = _calls("%Y%m%d") + """,
no AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rec) AS n FROM r),
mm AS (SELECT DISTINCT m.case_id, m.file, n, t, v, date_trunc('second', m.ts) AS ts
  FROM m JOIN no ON no.rec = m.rec AND no.file = m.file WHERE m.file % 10 <> 2)"""
ORACLE["csv_folder_calls"] = _with(_DAILY_ROWS) + """
SELECT case_id, t AS entity_type, v AS value, count(*) AS n_mentions, count(DISTINCT file) AS n_files,
  CAST(sum(n) AS BIGINT) AS row_sum, epoch_us(min(ts)) AS first_seen_us FROM mm GROUP BY case_id, t, v"""

ORACLE["csv_folder_ledger"] = """
SELECT CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS case_id, ascii(o_orderstatus)::BIGINT AS part,
  CASE WHEN o_orderstatus <> 'P' THEN count(*) END AS rows_processed,
  CASE WHEN o_orderstatus <> 'P' THEN 0 END AS rows_skipped,
  CASE WHEN o_orderstatus = 'P' THEN 'MissingColumnError' END AS error_class,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(sum(2 + two) AS BIGINT) END AS mentions,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(sum(1 + 2 * two) AS BIGINT) END AS links
FROM (SELECT *, CASE WHEN o_orderkey % 1000 >= 10 THEN 1 ELSE 0 END AS two FROM orders)
GROUP BY 1, 2, o_orderstatus"""

ORACLE["mail_folder"] = _with(_MAILS, """
x AS (SELECT DISTINCT case_id, file, t, v FROM (
  SELECT case_id, file, 'email_address' AS t, unnest([sender] || rc) AS v FROM ml
  UNION ALL SELECT case_id, file, 'ip_address', unnest(hops) FROM ml))""") + """
SELECT case_id, t AS entity_type, v AS value, count(*) AS n_mentions, count(*) AS n_files,
  epoch_us(TIMESTAMP '2024-03-15 10:15:00') AS first_seen_us FROM x GROUP BY case_id, t, v"""

ORACLE["dump_folder"] = """
WITH s AS (SELECT s_suppkey AS part, s_nationkey::BIGINT AS case_id, s_suppkey % 5 AS form,
  '86' || lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AS imei,
  '10.7.' || (s_suppkey // 250) || '.' || (s_suppkey % 250) AS ip,
  lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS k FROM supplier)
SELECT part, case_id, 'device_imei' AS entity_type, imei AS value FROM s WHERE form < 4
UNION ALL SELECT part, case_id, 'ip_address', ip FROM s WHERE form IN (0, 2)
UNION ALL SELECT part, case_id, 'phone', '+919' || k FROM s WHERE form IN (0, 1, 3)
UNION ALL SELECT part, case_id, 'phone', '+917' || k FROM s WHERE form = 1
UNION ALL SELECT part, case_id, 'CorruptedFileError', NULL FROM s WHERE form = 4
UNION ALL SELECT part, case_id, 'outcome', CASE form WHEN 2 THEN '1/0' WHEN 3 THEN '2/1' ELSE '2/0' END
  FROM s WHERE form < 4"""

ORACLE["entities_dumps"] = _with(_TEXT_FOUND, """
m AS (SELECT case_id, file, list_position(['device_imei','mac_address','ip_address','phone'], t) AS rec,
   0 AS pos, t, v, TIMESTAMP '2024-01-01' + to_minutes(file) AS ts FROM fd)""", _ENT) + _ENTITY_ROWS

ORACLE["stream_folder_entities"] = _with(_DAILY_ROWS) + """,
em AS (SELECT case_id, t, v, min(ts) AS ts FROM mm GROUP BY ALL),
lk AS (SELECT DISTINCT case_id, lt, least(aty || av, bty || bv) AS a, greatest(aty || av, bty || bv) AS b
  FROM l WHERE file % 10 <> 2 AND aty || av <> bty || bv),
dg AS (SELECT case_id, k, count(*) AS n FROM (
  SELECT case_id, a AS k FROM lk UNION ALL SELECT case_id, b FROM lk) GROUP BY ALL)
SELECT em.case_id, t AS entity_type, v AS value, epoch_us(ts) AS first_seen_us, coalesce(dg.n, 0) AS n_links
FROM em LEFT JOIN dg ON dg.case_id = em.case_id AND dg.k = t || v"""

ORACLE["stream_folder_custody"] = _with(_calls("%Y%m%d")) + """
SELECT case_id, true AS is_valid, count(DISTINCT file) AS total_entries, 0 AS unlogged_files FROM r GROUP BY case_id"""

_DAILY_ACCEPTED = _calls("%Y%m%d").replace("FROM r)", "FROM r WHERE file % 10 <> 2)").replace(
    "FROM r\n", "FROM r WHERE file % 10 <> 2\n").replace(
    "event_id AS rec, ts,", "event_id AS rec, date_trunc('second', ts) AS ts,")
ORACLE["stream_folder_scores"] = _with(
    _DAILY_ACCEPTED, _ENT, _link(), _edge(), _CC, _DEG, _SIM_REF_24, _HUB, _SCORE) + """
SELECT sc.case_id, t AS entity_type, v AS value, score, codes AS reasons, size AS cluster_size
FROM sc JOIN clu USING (case_id, eid)"""

_CROSS = """
ru AS (SELECT * FROM (VALUES (0, 'device_imei', 'mac_address', 'shared_mac', 0.98::DOUBLE),
   (0, 'device_imei', 'ip_address', 'shared_ip_subnet', 0.90), (0, 'device_imei', 'phone', 'shared_imei', 0.95),
   (1, 'mac_address', 'device_imei', 'shared_imei', 0.98), (1, 'mac_address', 'ip_address', 'shared_ip_subnet', 0.90),
   (2, 'ip_address', 'device_imei', 'shared_imei', 0.90), (2, 'ip_address', 'mac_address', 'shared_mac', 0.90),
   (3, 'phone', 'device_imei', 'shared_imei', 0.95)) AS v(rec, aty, bty, lt, conf)),
m AS (SELECT case_id, file, list_position(['device_imei','mac_address','ip_address','phone'], t) AS rec,
   0 AS pos, t, v, NULL::TIMESTAMP AS ts FROM fd),
l AS (SELECT a.case_id, a.file, ru.rec, 0 AS pos, aty, a.v AS av, bty, b.v AS bv, lt, conf
   FROM fd a JOIN ru ON ru.aty = a.t JOIN fd b ON b.case_id = a.case_id AND b.file = a.file AND b.t = ru.bty)"""
ORACLE["device_cross_links"] = _with(_calls().split(",\nm AS")[0], _JSON_FOUND, _CROSS, _ENT, _link()) + _LINK_ROWS
ORACLE["device_cross_links_text"] = _with(_TEXT_FOUND, _CROSS, _ENT, _link()) + _LINK_ROWS

ORACLE["stream_calls"] = ORACLE["entities_calls"]

ORACLE["risk_list_phones"] = _with(*CALLS, _DEG, _SIM_REF_24) + """
SELECT case_id, eid AS entity_id, v AS value, score,
  CASE WHEN score > 0 THEN 'Recommended for investigator review — do not act without independent corroboration of the evidence.'
  ELSE 'No significant fraud indicators detected at this time. Continue routine monitoring.' END AS recommendation
FROM (SELECT ent.case_id, ent.eid, v, CASE WHEN hops >= 3 THEN 45 ELSE 0 END
   + CASE WHEN sim.n IS NOT NULL THEN 40 ELSE 0 END AS score
   FROM ent LEFT JOIN deg USING (case_id, eid) LEFT JOIN sim USING (case_id, eid) WHERE t = 'phone')"""

ORACLE["hash_sync"] = _with(_FILES) + """
SELECT case_id, evidence_file_id, entry_id,
  CASE WHEN o_orderstatus <> 'F' AND entry_id % 3 = 0 THEN 'stale' ELSE file_hash END AS file_hash
FROM f JOIN orders ON o_orderkey = evidence_file_id"""
