"""SQL (DuckDB dialect) that states independently what the queries return."""

from __future__ import annotations

import ipaddress
import re

from hostlake.functions import constants as C
from hostlake.sources import adapter


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


def has_any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")" if parts else "true"


def starts(column: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{p}')" for p in parts) + ")"


def external(column: str) -> str:
    last = f"string_split({column}, '→')[-1]"
    host, port = f"string_split({last}, ':')[1]", f"string_split({last}, ':')[-1]"
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    number = " + ".join(f"CAST(string_split({host}, '.')[{i + 1}] AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    spans = [ipaddress.ip_network(f"{a}/{k}") for a, k in C.RESERVED_RANGES]
    reserved = " OR ".join(f"({number}) BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in spans)
    return f"(CASE WHEN regexp_full_match({host}, '{octet}(\\.{octet}){{3}}') THEN NOT (contains({last}, ':') AND {port} = '53') AND NOT ({reserved}) ELSE false END)"


def semantic(field: int, default: str) -> str:
    """A field of the first rule that fits: 2 label, 3 techniques (joined by commas), 4 risk, 5 benign."""
    show = lambda v: ("'" + ",".join(v) + "'") if isinstance(v, tuple) else (str(v).lower() if isinstance(v, bool) else f"'{v}'")
    rules = " ".join(f"WHEN sc_type IN ({', '.join(map(str, r[1]))}) AND {has_any('lower(resource)', r[0])} THEN {show(r[field])}" for r in C.SEMANTIC_RULES)
    return f"CASE {rules} ELSE {default} END"


LABEL = case("sc_type", C.LABELS, "syscall")
RTYPE = case("sc_type", C.RTYPES, "UNK")
SEM_LABEL = semantic(2, f"concat({LABEL}, ' on ', CASE WHEN resource = '' THEN 'unknown resource' ELSE substr(resource, 1, 40) END)")
SEM_TTPS, SEM_RISK, SEM_BENIGN = semantic(3, "''"), semantic(4, "'LOW'"), semantic(5, "false")
COMPACT = f"concat({SEM_LABEL}, ' [', CASE WHEN {SEM_TTPS} = '' THEN 'BENIGN' ELSE {SEM_TTPS} END, '/', {SEM_RISK}, ']')"
HINT = f"CASE WHEN {SEM_TTPS} <> '' OR {SEM_RISK} IN ('HIGH', 'CRITICAL') THEN {COMPACT} ELSE '' END"
SUSPICIOUS = f"(sc_type = 1 AND starts_with(resource, '/etc/shadow') AND comm NOT IN ({quoted(C.PAM_COMMS)}))"
STAGED = "(sc_type = 0 AND (starts_with(resource, '/tmp/') OR starts_with(resource, '/dev/shm/')))"
PARTS = "-(n / total) * log2(n / total)"

#: Common table expressions, in an order in which each may use the ones before.
CTES = {
    "ke": adapter.KERNEL_EVENTS.replace("{TS_US}", "epoch_us(ts)").replace("{EVENTS}", "events"),
    "ev": """SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts_us, event_id) AS i, row_number() OVER (PARTITION BY trace_id ORDER BY ts_us, event_id) AS g,
      count(*) OVER (PARTITION BY trace_id) AS trace_len, lag(sc_type) OVER (PARTITION BY pid ORDER BY ts_us, event_id) AS prev FROM ke""",
    "win": "SELECT *, (i - 1) // 20 AS wid, CAST((i - 1) % 20 AS INT) AS idx FROM ev QUALIFY count(*) OVER (PARTITION BY pid, (i - 1) // 20) = 20",
    "node": f"SELECT pid, wid, comm, {RTYPE} AS rtype, min(idx) AS first_idx FROM win GROUP BY ALL",
    "nodes": "SELECT *, concat('n', row_number() OVER (PARTITION BY pid, wid ORDER BY first_idx) - 1) AS node FROM node",
    "step": f"""SELECT w.*, {RTYPE} AS rtype, {LABEL} AS label, {HINT} AS hint FROM win w""",
    "pairs": """SELECT a.pid, a.wid, b.idx, a.comm AS src_comm, a.rtype AS src_rtype, b.comm AS dst_comm, b.rtype AS dst_rtype, b.label, b.resource, b.hint, b.sc_type,
      floor((b.ts_us - a.ts_us + 5) / 10) / 100 AS dt FROM step a JOIN step b ON a.pid = b.pid AND a.wid = b.wid AND b.idx = a.idx + 1""",
    "merged": f"""SELECT pid, wid, src_comm, src_rtype, dst_comm, dst_rtype, label, count(*) AS count, min(dt) AS min_dt, max(dt) AS max_dt, min(idx) AS first_idx,
      substr(arg_min(resource, idx), 1, 64) AS resource, {starts("arg_min(resource, idx)", C.SENSITIVE_PREFIXES)} AS sensitive, arg_min(hint, idx) AS semantic FROM pairs GROUP BY ALL""",
    "edge": f"""SELECT m.*, s.first_idx AS src_idx, label = 'connect' AND {external("resource")} AS external,
      min(m.first_idx) OVER (PARTITION BY m.pid, m.wid, src_comm, src_rtype, dst_comm, dst_rtype) AS pair_idx
      FROM merged m JOIN node s ON m.pid = s.pid AND m.wid = s.wid AND m.src_comm = s.comm AND m.src_rtype = s.rtype""",
    "edges": "SELECT *, row_number() OVER (PARTITION BY pid, wid ORDER BY src_idx, pair_idx, first_idx) AS ord FROM edge",
    "meta": f"""SELECT e.*, n.n_nodes, n.unusual_comm FROM (SELECT pid, wid, count(*) AS n_edges, count(*) FILTER (external) AS outbound_ext,
        count(*) FILTER (label = 'openat(R)' AND sensitive) AS sensitive_reads, bool_or(label = 'execve' AND {starts("resource", C.STAGED_EXEC_PREFIXES)}) AS tmp_exec,
        coalesce(min(ord) FILTER (label = 'connect') < max(ord) FILTER (label = 'execve'), false) AS exec_after_net, count(*) FILTER (external) > 0 AS external_connect
        FROM edges GROUP BY ALL) e JOIN (SELECT pid, wid, count(*) AS n_nodes, bool_or(lower(comm) NOT IN ({quoted(C.DAEMONS)})) AS unusual_comm FROM node GROUP BY ALL) n USING (pid, wid)""",
    "score": f"""SELECT m.*, round(least(CASE WHEN tmp_exec THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN odd THEN 0.8::DOUBLE ELSE 0 END + least(0.2::DOUBLE * sensitive_reads, 0.45::DOUBLE)
        + CASE WHEN exec_after_net THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN unusual_comm THEN 0.15::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS score
      FROM meta m JOIN (SELECT pid, wid, bool_or(external AND (lower(src_comm) IN ({quoted(C.SERVERS)}) OR lower(src_comm) NOT IN ({quoted(C.DAEMONS)}))) AS odd FROM edges GROUP BY ALL) o USING (pid, wid)""",
    "atk": "SELECT column0 AS ord, epoch_us(CAST(column1 AS TIMESTAMP)) - 43200000000 AS start_us, epoch_us(CAST(column1 AS TIMESTAMP)) + 43200000000 AS end_us, column2 AS name FROM (VALUES "
    + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in adapter.ATTACKS)
    + ") v(column0, column1, column2)",
    "hit": "SELECT w.*, (SELECT arg_min(name, ord) FROM atk WHERE w.ts_us BETWEEN start_us AND end_us) AS attack FROM win w",
    "truth": "SELECT pid, wid, count(attack) AS hits, count(attack) >= 3 AND lower(arg_min(comm, idx)) IN ('nginx', 'vugefal') AS timed FROM hit GROUP BY ALL",
    "decided": "SELECT s.*, t.hits >= 3 AS malicious, score >= 0.55 AS flagged, CASE WHEN score >= 0.55 THEN score ELSE round(1 - score, 6) END AS confidence FROM score s JOIN truth t USING (pid, wid)",
}


def sql(select: str) -> str:
    """``select`` with the expressions that it needs in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, body in CTES.items():
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                add(body)
                if name not in need:
                    need.append(name)

    add(select)
    return (f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in need)} " if need else "") + select


def entropy_sql(source: str, keys: str, value: str) -> str:
    return f"SELECT {keys}, round(sum({PARTS}), 6) + 0.0 AS h FROM (SELECT {keys}, {value}, count(*) AS n, sum(count(*)) OVER (PARTITION BY {keys}) AS total FROM {source} GROUP BY {keys}, {value}) q GROUP BY {keys}"


ORACLE: dict[str, str] = {}


def put(name: str, select: str) -> None:
    ORACLE[name] = sql(select)


EV = "event_id"
put("s014_tumbling_windows", "SELECT event_id, pid, CAST(wid AS BIGINT) AS wid, idx FROM win")
put("s015_windows_with_tail", "SELECT event_id, trace_id, CAST((g - 1) // 20 AS BIGINT) AS wid, CAST((g - 1) % 20 AS INT) AS idx FROM ev QUALIFY count(*) OVER (PARTITION BY trace_id, (g - 1) // 20) >= 2")
put("s016_sliding_last", "SELECT a.event_id, least(a.i, 20) AS filled, string_agg(b.sc_type, ',' ORDER BY b.i) AS recent FROM ev a JOIN ev b ON a.pid = b.pid AND b.i BETWEEN a.i - 19 AND a.i GROUP BY ALL")
put("s017_last_per_trace", "SELECT event_id, trace_id FROM ev WHERE g > trace_len - 20")
put(
    "s018_stitched_parents",
    """SELECT pid, CAST(wid AS BIGINT) AS wid, idx, event_id, false AS from_parent FROM win UNION ALL
    SELECT pid, CAST(wid AS BIGINT), CAST(-r AS INT), event_id, true FROM (SELECT e.pid, e.wid, p.event_id, row_number() OVER (PARTITION BY e.pid, e.wid ORDER BY p.ts_us DESC, p.event_id DESC) AS r
      FROM (SELECT pid, wid, arg_min(ppid, idx) AS parent, max(ts_us) AS end_us FROM win GROUP BY ALL) e JOIN ev p ON p.pid = e.parent AND p.ts_us <= e.end_us WHERE e.parent <> e.pid) q WHERE r <= 5""",
)
put("s019_drop_unresolved", "SELECT event_id FROM ke WHERE pid <> 0")
CTES["sliding"] = f"""SELECT trace_id, round(max(h), 6) + 0.0 AS max_entropy FROM (SELECT trace_id, g, sum({PARTS}) AS h FROM (SELECT a.trace_id, a.g, b.sc_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.trace_id, a.g) AS total
    FROM ev a JOIN ev b ON a.trace_id = b.trace_id AND b.g BETWEEN a.g - 19 AND a.g WHERE a.g >= least(a.trace_len, 20) GROUP BY a.trace_id, a.g, b.sc_type) q GROUP BY ALL) z GROUP BY trace_id"""
put("s020_sliding_max_entropy", "SELECT * FROM sliding")
put("s021_rtype", f"SELECT {RTYPE} AS rtype, sc_type, count(*) AS n FROM ke GROUP BY ALL")
put("s022_syscall_label", f"SELECT {LABEL} AS label, sc_type, count(*) AS n FROM ke GROUP BY ALL")
put("s023_external_routable", f"SELECT resource, {external('resource')} AS external, count(*) AS n FROM ke GROUP BY ALL")
put("s024_sensitive", f"SELECT event_id FROM ke WHERE {starts('resource', C.SENSITIVE_PREFIXES)}")
put("s025_hard_trigger", f"SELECT event_id, sc_type = 10 AS renamed FROM ke WHERE {has_any('resource', C.HARD_TRIGGERS)} OR sc_type = 10")
put("s026_semantic", f"SELECT event_id, {SEM_LABEL} AS label, {SEM_TTPS} AS ttps, {SEM_RISK} AS risk, {SEM_BENIGN} AS benign FROM ke")
put("s027_semantic_compact", f"SELECT {COMPACT} AS line, count(*) AS n FROM ke GROUP BY ALL")
CATEGORY = """CASE WHEN sc_type IN (3, 4) THEN 2 WHEN sc_type = 0 THEN 3 WHEN sc_type IN (8, 9) THEN 4 WHEN regexp_matches(resource, '/etc/shadow|/etc/passwd|/\\.ssh/|/proc/self') THEN 5
    WHEN regexp_matches(resource, '/tmp/|/dev/shm/') THEN 6 WHEN sc_type = 1 THEN 0 WHEN sc_type = 2 THEN 1 ELSE 7 END"""
put("s028_resource_category", f"SELECT event_id, {CATEGORY} AS category FROM ke")
put("s029_ip_region", "SELECT CASE WHEN ip = 0 THEN 'UNKNOWN' WHEN ip >= 4194304 AND ip < 4195304 THEN 'TEXT' WHEN ip BETWEEN 27021597764222976 AND 36028797018963967 THEN 'HEAP_MMAP' ELSE 'UNKNOWN' END AS region, ip, count(*) AS n FROM ke GROUP BY ALL")
put(
    "s030_predicates",
    f"""SELECT event_id, comm = 'nginx' AS is_nginx, regexp_matches(comm, '^(py|ba)') AS script, sc_type = 0 AND starts_with(resource, '/bin/') AS exec_bin, sc_type = 1 AND starts_with(resource, '/etc/') AS reads_etc,
    sc_type = 2 AND starts_with(resource, '/tmp/') AS writes_tmp, sc_type = 3 AS connects, sc_type = 7 AND (contains(resource, 'uid=0') OR contains(resource, '->0')) AS to_root,
    sc_type = 10 OR (sc_type = 15 AND contains(resource, 'PR_SET_NAME')) AS renames, {SUSPICIOUS} AS shadow FROM ke""",
)
SCENARIO = "CASE WHEN pid % 4 = 0 THEN concat('attack_T10', 10 + pid % 7, '_x') WHEN pid % 4 = 1 THEN concat('benign_ext_', comm) WHEN pid % 4 = 2 THEN concat('benign_', comm, '_', pid) ELSE comm END"
put(
    "s031_workload",
    f"""SELECT scenario, CASE WHEN starts_with(scenario, 'attack_') THEN 'attack' WHEN starts_with(scenario, 'benign_ext_') THEN 'extended_server' WHEN starts_with(scenario, 'benign_') THEN split_part(scenario, '_', 2) ELSE 'unknown' END AS workload,
    CASE WHEN regexp_matches(scenario, '^attack_T[0-9]+') THEN regexp_extract(scenario, 'attack_(T[0-9]+)', 1) ELSE scenario END AS family FROM (SELECT DISTINCT {SCENARIO} AS scenario FROM ke) q""",
)
MARGINAL = f"""SELECT pid, i, sum({PARTS}) AS h FROM (SELECT a.pid, a.i, b.sc_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.pid, a.i) AS total FROM ev a JOIN ev b ON a.pid = b.pid AND b.i BETWEEN a.i - 63 AND a.i GROUP BY a.pid, a.i, b.sc_type) q GROUP BY ALL"""
MARKOV = """SELECT pid, i, sum(-(n / total) * log2(n / from_total)) AS h FROM (SELECT a.pid, a.i, b.prev, b.sc_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.pid, a.i) AS total, sum(count(*)) OVER (PARTITION BY a.pid, a.i, b.prev) AS from_total
  FROM ev a JOIN ev b ON a.pid = b.pid AND b.i BETWEEN a.i - 63 AND a.i WHERE b.prev IS NOT NULL GROUP BY a.pid, a.i, b.prev, b.sc_type) q GROUP BY ALL"""
CTES["marginal"], CTES["markov"] = MARGINAL, MARKOV
CTES["gate"] = """SELECT e.*, round(coalesce(m.h, 0), 6) + 0.0 AS entropy, round(coalesce(t.h, 0), 6) + 0.0 AS markov_entropy FROM ev e LEFT JOIN marginal m USING (pid, i) LEFT JOIN markov t USING (pid, i)"""
CTES["early"] = f"SELECT *, CASE WHEN {has_any('resource', C.HARD_TRIGGERS)} THEN 'hard_trigger' WHEN i < 20 THEN 'skip' END AS first_say FROM gate"
CTES["late"] = """SELECT *, row_number() OVER (PARTITION BY comm, sc_type ORDER BY ts_us, event_id) = 1 AS novel_edge, row_number() OVER (PARTITION BY comm, prev, sc_type ORDER BY ts_us, event_id) = 1 AS novel_transition FROM early WHERE first_say IS NULL"""
CTES["triaged"] = """SELECT event_id, pid, ts_us, entropy, markov_entropy, false AS novel_edge, false AS novel_transition, first_say AS "trigger" FROM early WHERE first_say IS NOT NULL UNION ALL
  SELECT event_id, pid, ts_us, entropy, markov_entropy, novel_edge, novel_transition, CASE WHEN entropy < 1.2 AND markov_entropy < 1.2 AND NOT novel_edge AND NOT novel_transition THEN 'skip' WHEN novel_transition THEN 'novel_transition'
  WHEN novel_edge THEN 'novel_edge' WHEN entropy < 1.2 THEN 'markov' ELSE 'entropy' END FROM late"""
put("s032_marginal_entropy", "SELECT event_id, entropy FROM gate")
put("s033_markov_entropy", "SELECT event_id, markov_entropy FROM gate")
put("s034_bigrams", "SELECT comm, prev, sc_type AS cur, count(*) AS n FROM ev WHERE prev IS NOT NULL GROUP BY ALL")
put("s035_first_seen", "SELECT event_id, row_number() OVER (PARTITION BY comm, sc_type ORDER BY ts_us, event_id) = 1 AS novel_edge FROM ke")
put("s036_triage", 'SELECT event_id, entropy, markov_entropy, novel_edge, novel_transition, "trigger" FROM triaged')
put(
    "s037_gate_stats",
    """SELECT "trigger", count(*) AS n, CAST(NULL AS DOUBLE) AS signal_rate FROM triaged GROUP BY ALL UNION ALL SELECT 'total', count(*), round(count(*) FILTER ("trigger" <> 'skip') / count(*), 6) FROM triaged""",
)
VERDICTS = "SELECT pid, ts_us FROM ke WHERE sc_type = 9"
put("s038_flagged_lineage", f"SELECT event_id FROM ke e WHERE EXISTS (SELECT 1 FROM ({VERDICTS}) v WHERE (v.pid = e.pid OR v.pid = e.ppid) AND e.ts_us > v.ts_us AND e.ts_us <= v.ts_us + 7200000000)")
put(
    "s039_lineage",
    """SELECT pid, arg_min(comm, i) AS original_comm, arg_max(comm, i) AS current_comm, arg_min(resource, i) FILTER (sc_type = 0) AS exec_path, min(ts_us) AS first_seen_us, count(*) FILTER (sc_type = 10) AS renames,
    max(ts_us) FILTER (sc_type = 10) AS last_rename_us, arg_max(ppid, i) AS ppid FROM ev GROUP BY pid""",
)
put("s040_parent_map", "SELECT pid, arg_max(ppid, i) AS ppid FROM ev WHERE ppid > 1 AND pid <> 0 GROUP BY pid")
put("s041_structural_entropy", f"SELECT pid, CAST(wid AS BIGINT) AS wid, h AS structural_entropy FROM ({entropy_sql('edges', 'pid, wid', 'label')}) z")
put("s042_nodes", "SELECT pid, CAST(wid AS BIGINT) AS wid, node, comm, rtype, first_idx FROM nodes")
put("s043_edges", "SELECT pid, CAST(wid AS BIGINT) AS wid, src_comm, src_rtype, dst_comm, dst_rtype, label, count, min_dt, max_dt, first_idx, resource, sensitive, ord FROM edges")
put("s044_edge_hints", "SELECT semantic, count(*) AS n FROM edges GROUP BY ALL")
put("s045_meta", "SELECT pid, CAST(wid AS BIGINT) AS wid, n_nodes, n_edges, outbound_ext, external_connect, exec_after_net, unusual_comm, sensitive_reads, tmp_exec FROM meta")
CTES["text"] = """SELECT m.pid, m.wid, concat('# provenance graph\nmeta: {nodes: ', n_nodes, ', edges: ', n_edges, CASE WHEN outbound_ext > 0 THEN concat(', outbound_ext: ', outbound_ext) ELSE '' END,
  CASE WHEN exec_after_net THEN ', exec_after_net: true' ELSE '' END, CASE WHEN unusual_comm THEN ', unusual_comm: true' ELSE '' END, CASE WHEN sensitive_reads > 0 THEN concat(', sensitive_reads: ', sensitive_reads) ELSE '' END,
  CASE WHEN tmp_exec THEN ', tmp_exec: true' ELSE '' END, CASE WHEN external_connect THEN ', external_connect: true' ELSE '' END, '}\nnodes:\n', n.body, '\nedges:\n', e.body, '\nprocs: [', n.procs, ']') AS text
  FROM meta m JOIN (SELECT pid, wid, string_agg(concat('  - {id: ', node, ', comm: ', comm, ', rtype: ', rtype, '}'), '\n' ORDER BY first_idx) AS body, array_to_string(list_sort(list_distinct(list(comm))), ', ') AS procs FROM nodes GROUP BY ALL) n USING (pid, wid)
  JOIN (SELECT x.pid, x.wid, string_agg(concat('  - {src: ', s.node, ', dst: ', d.node, ', syscall: ', label, ', dt_ms: ', printf('%.1f', floor(min_dt * 10 + 0.5) / 10), CASE WHEN count > 1 THEN concat(', n: ', count, ', dt_max_ms: ', printf('%.1f', floor(max_dt * 10 + 0.5) / 10)) ELSE '' END,
    CASE WHEN resource <> '' THEN concat(', res: ', resource) ELSE '' END, CASE WHEN sensitive THEN ', sensitive: true' ELSE '' END, CASE WHEN external THEN ', anomaly: ext_outbound' ELSE '' END,
    CASE WHEN semantic <> '' THEN concat(', semantic: "', semantic, '"') ELSE '' END, '}'), '\n' ORDER BY ord) AS body
    FROM edges x JOIN nodes s ON s.pid = x.pid AND s.wid = x.wid AND s.comm = src_comm AND s.rtype = src_rtype JOIN nodes d ON d.pid = x.pid AND d.wid = x.wid AND d.comm = dst_comm AND d.rtype = dst_rtype GROUP BY ALL) e USING (pid, wid)"""
put("s046_serialized", "SELECT pid, CAST(wid AS BIGINT) AS wid, text FROM text")
put(
    "s046b_serialized_arrows",
    """SELECT pid, CAST(wid AS BIGINT) AS wid, string_agg(concat('PROC[', src_comm, '/', src_rtype, '] --[', label, ', dt=', printf('%.1f', floor(min_dt * 10 + 0.5) / 10), 'ms]--> PROC[', dst_comm, '/', dst_rtype, ']', CASE WHEN sensitive THEN ' [SENSITIVE]' ELSE '' END,
    CASE WHEN resource <> '' THEN concat(' path=', resource) ELSE '' END), '\n' ORDER BY ord) AS text FROM edges GROUP BY ALL""",
)
CTES["tls"] = "SELECT DISTINCT pid, wid, comm, concat('intent ', resource) AS payload FROM win WHERE sc_type = 3"
put(
    "s047_tls_edges",
    """SELECT t.pid, CAST(t.wid AS BIGINT) AS wid, t.comm AS src_comm, n.src_rtype, substr(payload, 1, 128) AS resource FROM tls t JOIN (SELECT pid, wid, comm, arg_min(rtype, CASE WHEN rtype = 'NET' THEN -1 ELSE first_idx END) AS src_rtype FROM node GROUP BY ALL) n USING (pid, wid, comm)""",
)
put(
    "s048_fingerprints",
    "SELECT fingerprint, count(*) AS windows FROM (SELECT pid, wid, sha256(string_agg(line, '\n' ORDER BY line)) AS fingerprint FROM (SELECT pid, wid, concat(src_comm, '/', src_rtype, '|', dst_comm, '/', dst_rtype, '|', label) AS line FROM edges) q GROUP BY ALL) z GROUP BY ALL",
)
put(
    "s049_features",
    f"""SELECT m.pid, CAST(m.wid AS BIGINT) AS wid, n_nodes::DOUBLE AS n_nodes, n_edges::DOUBLE AS n_edges, outbound_ext::DOUBLE AS outbound_ext, sensitive_reads::DOUBLE AS sensitive_reads, exec_after_net::INT::DOUBLE AS exec_after_net, unusual_comm::INT::DOUBLE AS unusual_comm,
    tmp_exec::INT::DOUBLE AS tmp_exec, external_connect::INT::DOUBLE AS external_connect, s.h AS structural_entropy, c.h AS comm_entropy, f.* EXCLUDE (pid, wid), p.max_parallel_edges
    FROM meta m JOIN ({entropy_sql("edges", "pid, wid", "label")}) s USING (pid, wid) JOIN ({entropy_sql("node", "pid, wid", "comm")}) c USING (pid, wid)
    JOIN (SELECT pid, wid, (count(*) FILTER (label = 'openat(R)' AND starts_with(resource, '/tmp/')))::DOUBLE AS openat_r_tmp, (count(*) FILTER (label = 'openat(W)' AND starts_with(resource, '/tmp/')))::DOUBLE AS openat_w_tmp,
      (count(*) FILTER (label = 'openat(R)' AND starts_with(resource, '/var/log/')))::DOUBLE AS openat_r_var_log, (count(*) FILTER (label = 'openat(W)' AND starts_with(resource, '/var/log/')))::DOUBLE AS openat_w_var_log,
      (count(*) FILTER (label = 'openat(R)' AND resource = '/etc/shadow'))::DOUBLE AS openat_r_etc_shadow, (count(*) FILTER (label = 'execve' AND starts_with(resource, '/tmp/')))::DOUBLE AS execve_tmp,
      (count(*) FILTER (label = 'execve' AND starts_with(resource, '/var/log/')))::DOUBLE AS execve_var_log, (count(*) FILTER (label = 'execve' AND starts_with(resource, '/home/admin/cache')))::DOUBLE AS execve_cache,
      (count(*) FILTER (external))::DOUBLE AS ext_outbound_edges FROM edges GROUP BY ALL) f USING (pid, wid)
    JOIN (SELECT pid, wid, max(n)::DOUBLE AS max_parallel_edges FROM (SELECT pid, wid, count(*) AS n FROM edges GROUP BY pid, wid, src_comm, src_rtype, dst_comm, dst_rtype) q GROUP BY ALL) p USING (pid, wid)""",
)
put(
    "s050_compression",
    f"""SELECT pid, CAST(wid AS BIGINT) AS wid, raw_words, graph_words, round(1 - graph_words / raw_words, 6) AS saved FROM (SELECT pid, wid, CAST(sum(len(string_split_regex(trim(concat(ts_us, ' ', comm, ' ', {LABEL}, ' ', resource)), '\\s+'))) AS BIGINT) AS raw_words FROM win GROUP BY ALL) r
    JOIN (SELECT pid, wid, len(string_split_regex(trim(text), '\\s+')) AS graph_words FROM text) t USING (pid, wid)""",
)
put(
    "s051_label_matrix",
    """UNPIVOT (SELECT malicious, count(*) FILTER (tmp_exec) AS tmp_exec, count(*) FILTER (external_connect) AS external_connect, count(*) FILTER (exec_after_net) AS exec_after_net, count(*) FILTER (unusual_comm) AS unusual_comm, count(*) FILTER (sensitive_reads > 0) AS sensitive,
    count(*) FILTER (tmp_exec AND external_connect) AS tmp_and_external, count(*) AS windows FROM decided GROUP BY ALL) ON COLUMNS(* EXCLUDE malicious) INTO NAME rule VALUE n""",
)
put(
    "s052_insights",
    """SELECT pid, CAST(wid AS BIGINT) AS wid, array_to_string(list_filter([CASE WHEN regexp_matches(text, '/etc/shadow|/etc/passwd|id_rsa') THEN 'credential access' END, CASE WHEN contains(text, '/tmp/') AND contains(text, 'execve') THEN 'execution from a temporary path' END,
    CASE WHEN contains(text, 'connect') AND contains(text, 'execve') THEN 'network and execution' END, CASE WHEN contains(text, 'setuid') THEN 'privilege change' END, CASE WHEN contains(text, 'ptrace') THEN 'process inspection' END], lambda x: x IS NOT NULL), ';') AS insights FROM text""",
)
put(
    "s053_window_semantics",
    f"""SELECT w.pid, CAST(w.wid AS BIGINT) AS wid, w.max_risk, coalesce(t.ttps, '') AS ttps FROM (SELECT pid, wid, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], {SEM_RISK}))] AS max_risk FROM win GROUP BY ALL) w
    LEFT JOIN (SELECT pid, wid, string_agg(t, ',' ORDER BY t_at) AS ttps FROM (SELECT pid, wid, t, min(idx * 10 + p) AS t_at FROM (SELECT pid, wid, idx, unnest(string_split(s, ',')) AS t, generate_subscripts(string_split(s, ','), 1) AS p FROM (SELECT pid, wid, idx, {SEM_TTPS} AS s FROM win) q WHERE s <> '') z GROUP BY ALL) y GROUP BY ALL) t USING (pid, wid)""",
)
NEXT = "SELECT a.*, (SELECT min(b.g) FROM ev b WHERE b.trace_id = a.trace_id AND b.pid = a.pid AND b.g > a.g AND {goal}) AS at_g FROM ev a WHERE {start}"
SHADOW = "starts_with({t}resource, '/etc/shadow') AND {t}sc_type = 1"
RULES = {
    "AX-1": ("CRITICAL", "a.comm = 'nginx'", "b.sc_type = 0 AND starts_with(b.resource, '/bin/bash')", "at_g - g <= 50"),
    "AX-3": ("CRITICAL", "(a.sc_type = 10 OR (a.sc_type = 15 AND contains(a.resource, 'PR_SET_NAME')))", SHADOW.format(t="b."), "true"),
    "AX-5": ("CRITICAL", "a.sc_type = 7 AND (contains(a.resource, 'uid=0') OR contains(a.resource, '->0'))", "b.sc_type = 3", "at_g - g <= 5"),
}
PICK = "SELECT trace_id, pid, g, at_g, '{name}' AS axiom, '{severity}' AS severity FROM ({inner}) q WHERE {keep}"
HITS = {n: PICK.format(name=n, severity=s, inner=NEXT.format(goal=goal, start=start), keep=f"at_g IS NOT NULL AND {keep}") for n, (s, start, goal, keep) in RULES.items()}
CTES["staged"] = f"SELECT *, {STAGED} AS hit, lag(g) OVER (PARTITION BY trace_id, pid ORDER BY g) AS g0, lag({STAGED}) OVER (PARTITION BY trace_id, pid ORDER BY g) AS hit0 FROM ev"
HITS["AX-4"] = "SELECT trace_id, pid, g, g AS at_g, 'AX-4' AS axiom, 'HIGH' AS severity FROM staged WHERE hit UNION ALL SELECT trace_id, pid, g0, g, 'AX-4', 'HIGH' FROM staged WHERE hit AND g0 = g - 1 AND NOT hit0"
SUS_A = SUSPICIOUS.replace("sc_type", "a.sc_type").replace("resource", "a.resource").replace("comm", "a.comm")
HITS["AX-2"] = PICK.format(name="AX-2", severity="CRITICAL", inner=NEXT.format(goal="b.sc_type = 3", start=SUS_A), keep="at_g IS NOT NULL")
HITS["AX-2b"] = PICK.format(name="AX-2b", severity="MEDIUM", inner=NEXT.format(goal="b.sc_type = 3", start=SUS_A), keep="at_g IS NULL AND trace_len - g + 1 > 50")
CTES["broken"] = " UNION ALL ".join(HITS.values())
put("s069_runtime_monitor", " UNION ALL ".join(HITS[n] for n in ("AX-1", "AX-3", "AX-5")))
put("s070_default_axioms", "SELECT axiom, count(*) AS n FROM (" + " UNION ALL ".join(HITS[n] for n in ("AX-1", "AX-3", "AX-5")) + ") z GROUP BY ALL")
put("s071_staged_execution", HITS["AX-4"])
put("s072_sequels", HITS["AX-2"] + " UNION ALL " + HITS["AX-2b"])
put("s073_unfollowed_reads", f"SELECT trace_id, pid, g FROM ({NEXT.format(goal='b.sc_type = 3', start=SUS_A)}) q WHERE at_g IS NULL AND trace_len - g + 1 > 0")
CTES["summary"] = """SELECT trace_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(axiom))), ',') AS axioms, max(CASE severity WHEN 'CRITICAL' THEN 0.95::DOUBLE WHEN 'HIGH' THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END) AS severity, count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM broken GROUP BY trace_id"""
put("s074_violation_summary", "SELECT * FROM summary")
put("s074b_violations_by_rule", "SELECT axiom, count(*) AS n, count(DISTINCT trace_id) AS traces, round(count(DISTINCT trace_id) / (SELECT count(DISTINCT trace_id) FROM ke), 6) AS rate FROM broken GROUP BY axiom")
put("s075_provenance_score", "SELECT pid, CAST(wid AS BIGINT) AS wid, score FROM score")

# annotations, joins over intervals, ancestors, call sites
C2_MARK = "CASE WHEN regexp_matches(split_part(resource, ':', 1), '^185\\.220\\.101\\.(1?[0-9])$') THEN concat(resource, ' [C2]') ELSE resource END"
MARKED = f"CASE WHEN {has_any('resource', C.MALWARE_PATHS)} THEN concat({C2_MARK}, ' [MALWARE]') ELSE {C2_MARK} END"
put("s004_annotate_ti", f"SELECT {MARKED} AS resource, count(*) AS n FROM ke GROUP BY 1")
put("s005_strip_annotations", "SELECT resource, count(*) AS n FROM ke GROUP BY ALL")
put("s055_attack_intervals", "SELECT pid, CAST(wid AS BIGINT) AS wid, hits, hits >= 3 AS malicious FROM truth")
CTES["flag"] = "SELECT pid, arg_min(CAST(event_id AS VARCHAR), i) AS resource, min(ts_us) AS flag_us, arg_min(event_id, i) AS flag_id FROM ev WHERE sc_type = 9 GROUP BY pid"
CTES["up"] = "SELECT pid, arg_max(ppid, i) AS ppid FROM ev WHERE ppid > 0 AND pid <> 0 GROUP BY pid"
WALK = " UNION ALL ".join(
    f"SELECT p{d}.ppid AS pid, f.resource, f.flag_us, f.flag_id FROM flag f " + " ".join(f"JOIN up p{i} ON p{i}.pid = {'f.pid' if i == 1 else f'p{i - 1}.ppid'} AND p{i}.ppid <> p{i}.pid" for i in range(1, d + 1)) for d in range(1, 9)
)
put("s056_ancestors", f"SELECT pid, arg_min(resource, flag_us) AS resource FROM ({WALK}) w GROUP BY pid")
CTES["site"] = "SELECT 4194304 + 16 * i AS addr FROM range(100) r(i) WHERE i % 10 <> 7"
CTES["placed"] = "SELECT DISTINCT ip, CASE WHEN ip = 0 THEN 0 ELSE (SELECT min(abs(ip - addr)) FROM site) END AS distance FROM ke"
put("s057_call_sites", "SELECT event_id, distance = 0 AS inside, distance FROM ke JOIN placed USING (ip)")
put("s059_label_join", "SELECT malicious, count(*) AS n, round(avg(score), 6) AS mean_score FROM decided GROUP BY ALL")
put("s060_skipped_anti_join", """SELECT comm, count(*) AS skipped FROM ke WHERE event_id IN (SELECT event_id FROM triaged WHERE "trigger" = 'skip') GROUP BY comm""")
put(
    "s061_missed_resolutions",
    """SELECT NOT coalesce(contains(raw_path, '/lib'), false) AS missed, count(*) AS n FROM (SELECT k, resource, last_value(CASE WHEN k % 2 = 0 THEN resource END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS raw_path
    FROM ke WHERE sc_type IN (1, 2)) q WHERE k % 2 <> 0 AND contains(resource, '/lib') GROUP BY ALL""",
)

# claims and evidence
WORD = "CASE WHEN sc_type = 3 THEN 'connect' WHEN sc_type = 0 THEN 'execve' WHEN sc_type = 2 THEN 'openat(W)' ELSE 'openat(R)' END"
CTES["claim"] = f"""SELECT pid, wid, claim_id, concat({WORD}, ' ', resource) AS event_desc, 0.2::DOUBLE AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY pid, wid ORDER BY idx) AS claim_id FROM win WHERE resource <> '') q WHERE claim_id <= 2
  UNION ALL SELECT DISTINCT pid, wid, 3, concat('openat(R) /nonexistent/', pid), 0.3::DOUBLE FROM win"""


def claimed(text: str) -> str:
    words = ", ".join(f"nullif(regexp_extract({text}, '(?i){w}\\s+([^\\s,;.]+)', 1), '')" for w in C.CLAIM_WORDS)
    return f"coalesce(nullif(regexp_extract({text}, '/[\\w./-]+'), ''), nullif(regexp_extract({text}, '[\\d.]+:\\d+|[\\w.]+:\\d{{2,5}}'), ''), {words}, '')"


HINT_CLASS = "CASE " + " ".join(f"WHEN contains(lower(event_desc), '{a}') THEN {c}" for a, c in C.CLAIM_CLASSES) + " END"
CTES["hinted"] = f"SELECT *, lower({claimed('event_desc')}) AS hinted_at, {HINT_CLASS} AS hint_class FROM claim"
CTES["fit"] = """SELECT c.pid, c.wid, c.claim_id, w.idx, w.event_id, NOT ((hint_class IS NULL OR hint_class = w.sc_type) AND (hinted_at = '' OR contains(lower(w.resource), hinted_at) OR contains(hinted_at, lower(w.resource)))) AS loose,
  hinted_at <> '' AND contains(lower(w.resource), hinted_at) AS near FROM hinted c JOIN win w ON c.pid = w.pid AND c.wid = w.wid"""
CTES["matched"] = "SELECT c.pid, c.wid, c.claim_id, c.event_desc, c.contribution, m.idx, m.event_id, m.idx IS NOT NULL AS verified FROM claim c LEFT JOIN (SELECT * FROM fit WHERE NOT loose OR near QUALIFY row_number() OVER (PARTITION BY pid, wid, claim_id ORDER BY loose, idx) = 1) m USING (pid, wid, claim_id)"
put("s058_claim_matches", "SELECT pid, CAST(wid AS BIGINT) AS wid, claim_id, idx AS matched_idx FROM matched")
put("s062_match_claims", "SELECT pid, CAST(wid AS BIGINT) AS wid, claim_id, verified, event_id AS matched_id FROM matched")

# heuristic, routing
H = C.HEURISTIC
TIMES = "(length(t) - length(replace(t, '{0}', ''))) / {1}"
SIGNALS = [
    ("T1003", 0.55, has_any("t", H["credential"])), ("T1059", 0.45, has_any("t", H["staged"])), ("T1071", 0.5, has_any("t", H["c2"])), ("T1210", 0.25, TIMES.format("connect", 7) + " >= 2"),
    ("T1105", 0.45, "contains(t, 'openat(w)') AND contains(t, 'execve') AND contains(t, 'rtype: net')"), ("T1068", 0.65, "contains(t, 'setuid')"), ("T1055", 0.7, "contains(t, 'ptrace')"), ("T1562", 0.4, has_any("t", H["logs"])),
    ("T1041", 0.45, TIMES.format("openat(r)", 9) + " >= 2 AND contains(t, 'connect') AND contains(t, 'sensitive: true')"),
]
CTES["weighed"] = f"""SELECT pid, wid, round(greatest(0, least({" + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for _, w, c in SIGNALS)} - CASE WHEN {has_any("t", H["daemons"])} AND NOT {has_any("t", H["undaemonlike"])} THEN 0.3::DOUBLE ELSE 0 END
  - CASE WHEN {has_any("t", H["packages"])} THEN 0.2::DOUBLE ELSE 0 END, 0.99::DOUBLE)), 6) AS score, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in SIGNALS)}], lambda x: x IS NOT NULL)[1:4], ',') AS ttps FROM (SELECT pid, wid, lower(text) AS t FROM text) q"""
CTES["said"] = "SELECT *, CASE WHEN score >= 0.3 THEN 'MALICIOUS' ELSE 'BENIGN' END AS label, round(CASE WHEN score >= 0.3 THEN score ELSE least(1 - score, 0.08::DOUBLE) END, 2) AS confidence FROM weighed"
put("s076_heuristic", "SELECT pid, CAST(wid AS BIGINT) AS wid, score, label, confidence, ttps FROM said")
CTES["route"] = """SELECT s.pid, s.wid, CASE WHEN s.score >= 0.55 THEN 'MALICIOUS' WHEN s.score <= 0.15 THEN 'BENIGN' ELSE h.label END AS label, round(CASE WHEN s.score >= 0.55 THEN s.score WHEN s.score <= 0.15 THEN 1 - s.score ELSE h.confidence END, 4) AS confidence,
  CASE WHEN s.score >= 0.55 OR s.score <= 0.15 THEN 'graph' ELSE 'model' END AS route FROM score s JOIN said h USING (pid, wid)"""
put("s077_graph_route", "SELECT pid, CAST(wid AS BIGINT) AS wid, label, confidence, route FROM route")

# the loop of flags, eight rounds written out; verdicts of a round come from windows that the flags of the one before let pass
CTES["bad"] = "SELECT w.pid, w.wid, max(w.ts_us) AS ts_us FROM win w JOIN route r ON r.pid = w.pid AND r.wid = w.wid WHERE r.label = 'MALICIOUS' GROUP BY ALL"
LOOP = """WITH {needs}, told0 AS (SELECT * FROM bad WHERE false), {rounds}
SELECT g.event_id, g."trigger", coalesce(t.pid IS NOT NULL, false) AS verdict FROM passed8 g LEFT JOIN told8 t ON t.pid = g.pid AND t.wid = g.wid"""
ROUND = """say{n} AS MATERIALIZED (SELECT g.*, CASE WHEN first_say = 'hard_trigger' THEN first_say WHEN EXISTS (SELECT 1 FROM told{p} v WHERE v.pid IN (g.pid, g.ppid) AND g.ts_us > v.ts_us AND g.ts_us <= v.ts_us + 7200000000) THEN 'flagged_parent' ELSE first_say END AS say FROM early g),
late{n} AS (SELECT *, row_number() OVER (PARTITION BY comm, sc_type ORDER BY ts_us, event_id) = 1 AS novel_edge, row_number() OVER (PARTITION BY comm, prev, sc_type ORDER BY ts_us, event_id) = 1 AS novel_transition FROM say{n} WHERE say IS NULL),
passed{n} AS MATERIALIZED (SELECT s.event_id, s.pid, w.wid, coalesce(s.say, CASE WHEN l.entropy < 1.2 AND l.markov_entropy < 1.2 AND NOT novel_edge AND NOT novel_transition THEN 'skip' WHEN novel_transition THEN 'novel_transition'
  WHEN novel_edge THEN 'novel_edge' WHEN l.entropy < 1.2 THEN 'markov' ELSE 'entropy' END) AS "trigger" FROM say{n} s LEFT JOIN late{n} l USING (event_id) LEFT JOIN win w USING (event_id)),
told{n} AS MATERIALIZED (SELECT * FROM bad WHERE (pid, wid) IN (SELECT (pid, wid) FROM passed{n} WHERE "trigger" <> 'skip' AND wid IS NOT NULL))"""
NEEDS = sql("SELECT 1 FROM early JOIN bad ON true JOIN win ON true").removeprefix("WITH ").removesuffix(" SELECT 1 FROM early JOIN bad ON true JOIN win ON true")
ORACLE["s038b_flagging_loop"] = LOOP.format(needs=NEEDS.replace("early AS (", "early AS MATERIALIZED (").replace("bad AS (", "bad AS MATERIALIZED ("), rounds=",\n".join(ROUND.format(n=n, p=n - 1) for n in range(1, 9)))
CTES["report"] = """SELECT r.pid, r.wid, r.label, r.confidence, m.total, m.verified, m.total - m.verified AS unverified, round((m.total - m.verified) / m.total, 4) AS hallucination_rate, round(greatest(0, least(1, round(r.confidence - m.lost, 6))), 4) AS verified_confidence,
  CASE WHEN m.total = m.verified THEN 'CLEAN' WHEN (m.total - m.verified) / m.total < 0.5 THEN 'PARTIAL' ELSE 'HALLUCINATED' END AS verdict, round((m.total - m.verified) / m.total, 4) < 0.1 AS trustworthy
  FROM route r JOIN (SELECT pid, wid, count(*) AS total, count(*) FILTER (verified) AS verified, coalesce(sum(contribution) FILTER (NOT verified), 0) AS lost FROM matched GROUP BY ALL) m USING (pid, wid)"""
put("s065_evidence_report", "SELECT pid, CAST(wid AS BIGINT) AS wid, label, confidence, total, verified, unverified, hallucination_rate, verified_confidence, verdict, trustworthy FROM report")
put(
    "s066_verification_report",
    """SELECT r.pid, CAST(r.wid AS BIGINT) AS wid, r.label, round(CASE WHEN label = 'MALICIOUS' AND hallucination_rate > 0.5 THEN least(verified_confidence, 0.29::DOUBLE) ELSE verified_confidence END, 4) AS final_confidence, round(verified / total, 4) AS explainability,
    coalesce(t.evidence_ids, '') AS evidence_ids, coalesce(t.retracted, '') AS retracted, CAST(hallucination_rate > 0 AND verified > 0 AS INT) AS iterations, hallucination_rate FROM report r
    JOIN (SELECT pid, wid, array_to_string(list_transform(list_sort(list_distinct(list(event_id) FILTER (event_id IS NOT NULL))), lambda x: CAST(x AS VARCHAR)), ',') AS evidence_ids, array_to_string(list_sort(list_distinct(list(event_desc) FILTER (NOT verified))), ';') AS retracted FROM matched GROUP BY ALL) t USING (pid, wid)""",
)
put("s081_call_site_score", "SELECT pid, CAST(wid AS BIGINT) AS wid, bad AS static, 0.55::DOUBLE * bad AS score FROM (SELECT pid, wid, max(CAST(ip <> 0 AND distance > 0 AS INT)) AS bad FROM win JOIN placed USING (ip) GROUP BY ALL) q")
put("s084_call_site_evaluation", "SELECT sc_type, sc_type = 9 AS attack, count(*) AS n, round(avg(CAST(distance = 0 AS DOUBLE)), 6) AS inside_rate, CAST(sum(distance) FILTER (distance > 0) // count(*) FILTER (distance > 0) AS BIGINT) AS mean_distance, max(distance) FILTER (distance > 0) AS max_distance FROM ke JOIN placed USING (ip) WHERE ip <> 0 GROUP BY ALL")
W = {n: " AND ".join([*([f"bool_or({has_any('resource', p)})"] if p else []), *(f"bool_or(sc_type = {c})" for c in k)]) for n, _, _, p, k in C.WINDOW_RULES}
W |= {"exfiltration": f"bool_or({has_any('resource', C.EXFILTRATED)}) AND bool_or(sc_type = 3)", "lateral": "count(DISTINCT CASE WHEN sc_type = 3 THEN resource END) >= 2"}
WS = {n: (t, s) for n, t, s, _, _ in C.WINDOW_RULES} | {"exfiltration": ("T1041", C.EXFILTRATION), "lateral": ("T1210", C.LATERAL)}
CTES["ruled"] = f"""SELECT pid, wid, round(least(CASE WHEN marked AND raw < 0.5 THEN raw * 0.3::DOUBLE ELSE raw END, 0.99::DOUBLE), 6) AS score, ttps FROM (SELECT pid, wid, round({" + ".join(f"CASE WHEN {c} THEN {WS[n][1]}::DOUBLE ELSE 0 END" for n, c in W.items())}, 6) AS raw,
  bool_or({has_any("resource", C.BENIGN_MARKERS)} OR {has_any("comm", C.BENIGN_MARKERS)}) AS marked, list_filter([{", ".join(f"CASE WHEN {c} THEN '{WS[n][0]}' END" for n, c in W.items())}], lambda x: x IS NOT NULL) AS ttps FROM win GROUP BY ALL) q"""
put(
    "s094_window_rules",
    """SELECT pid, CAST(wid AS BIGINT) AS wid, score, CASE WHEN score >= 0.3 THEN 'MALICIOUS' ELSE 'BENIGN' END AS label, round(CASE WHEN score >= 0.3 THEN score ELSE greatest(0.01::DOUBLE, 1 - score) END, 4) AS confidence,
    array_to_string(list_filter(ttps, lambda x, i: list_position(ttps, x) = i)[1:4], ',') AS ttps FROM ruled""",
)
put(
    "s095_event_signatures",
    f"""SELECT event_id, 'TRC-2' AS rule FROM ke WHERE sc_type = 9 AND resource NOT IN ('', 'PTRACE_TRACEME') UNION ALL SELECT event_id, 'TRC-3' FROM ke WHERE sc_type = 2 AND contains(resource, '/proc/') AND contains(resource, '/mem')
    UNION ALL SELECT event_id, 'TRC-5' FROM ke WHERE sc_type = 0 AND contains(resource, '/.') UNION ALL SELECT event_id, 'KEY-READ' FROM ke WHERE sc_type = 1 AND {has_any("resource", C.SSH_KEYS)}
    UNION ALL SELECT event_id, 'C2' FROM ke WHERE sc_type = 3 AND (split_part(resource, ':', 1) IN ({quoted(C.C2_HOSTS)}) OR string_split(resource, ':')[-1] IN ({quoted(C.C2_PORTS)}))""",
)
CTES["wprev"] = "SELECT *, lag(sc_type) OVER (PARTITION BY pid, wid ORDER BY idx) AS before FROM win"
put("s096_ngrams", "SELECT pid, CAST(wid AS BIGINT) AS wid, gram, count(*) AS n FROM (SELECT pid, wid, CAST(sc_type AS VARCHAR) AS gram FROM win UNION ALL SELECT pid, wid, concat(before, ' ', sc_type) FROM wprev WHERE before IS NOT NULL) q GROUP BY ALL")

# evaluation
CTES["judged"] = "SELECT r.*, t.hits >= 3 AS malicious, r.label = 'MALICIOUS' AS flagged_m FROM route r JOIN truth t USING (pid, wid)"
RATES = "round(tp / greatest(tp + fn, 1), 6) AS tpr, round(fp / greatest(fp + tn, 1), 6) AS fpr, round(tp / greatest(tp + fp, 1), 6) AS precision, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, round((tp + tn) / greatest(tp + fp + tn + fn, 1), 6) AS accuracy"
CELLS = "count(*) FILTER (malicious AND {0}) AS tp, count(*) FILTER (NOT malicious AND {0}) AS fp, count(*) FILTER (NOT malicious AND NOT {0}) AS tn, count(*) FILTER (malicious AND NOT {0}) AS fn"
put("s101_confusion", f"SELECT *, {RATES} FROM (SELECT {CELLS.format('flagged_m')} FROM judged) q")
put(
    "s103_reliability",
    """SELECT CAST(b AS BIGINT) AS bin, coalesce(n, 0) AS n, acc, conf, round(abs(acc - conf), 6) AS gap, conf > acc AS overconfident FROM range(10) r(b) LEFT JOIN (SELECT least(floor(round(confidence * 10, 6)), 9) AS b, count(*) AS n, round(avg(CAST(malicious = flagged_m AS DOUBLE)), 6) AS acc, round(avg(confidence), 6) AS conf FROM judged GROUP BY ALL) q USING (b)""",
)
put("s105_cohens_d", "SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM (SELECT avg(v) FILTER (g) AS ma, avg(v) FILTER (NOT g) AS mb, var_samp(v) FILTER (g) AS va, var_samp(v) FILTER (NOT g) AS vb, count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb FROM (SELECT CAST(o_totalprice AS DOUBLE) AS v, o_orderstatus = 'F' AS g FROM orders) q) z")
LAT = "round(avg({0}), 4) AS mean, min({0}) AS least, max({0}) AS most, round(stddev_samp({0}), 4) AS sd, round(quantile_cont({0}, 0.5), 4) AS p50, round(quantile_cont({0}, 0.95), 4) AS p95, round(quantile_cont({0}, 0.99), 4) AS p99"
put("s106_latency", f"SELECT o_orderstatus, {LAT.format('v')} FROM (SELECT o_orderstatus, CAST(o_totalprice AS DOUBLE) AS v FROM orders) q GROUP BY ALL")
put("s106b_nth_percentiles", "SELECT o_orderstatus, s[greatest(floor(n * 50 / 100), 1)::INT] AS p50, s[greatest(floor(n * 95 / 100), 1)::INT] AS p95, s[greatest(floor(n * 99 / 100), 1)::INT] AS p99 FROM (SELECT o_orderstatus, list_sort(list(CAST(o_totalprice AS DOUBLE))) AS s, count(*) AS n FROM orders GROUP BY ALL) q")
put("s111_baselines", f"SELECT *, {RATES} FROM (SELECT classifier, {CELLS.format('f')} FROM (SELECT 'window_rules' AS classifier, r.score >= 0.3 AS f, t.hits >= 3 AS malicious FROM ruled r JOIN truth t USING (pid, wid) UNION ALL SELECT 'heuristic', r.score >= 0.3, t.hits >= 3 FROM said r JOIN truth t USING (pid, wid) UNION ALL SELECT 'graph', r.score >= 0.5, t.hits >= 3 FROM score r JOIN truth t USING (pid, wid)) q GROUP BY ALL) z")

# rollups
put("s115_event_rates", "SELECT ts_us - ts_us % 3600000000 AS start_us, sc_type, count(*) AS n FROM ke GROUP BY ALL")
put("s116_activity", "SELECT ts_us - ts_us % 3600000000 AS start_us, count(DISTINCT pid) AS pids, count(*) AS n FROM ke GROUP BY ALL")
put("s117_value_histogram", "SELECT CAST(u AS DOUBLE) AS upto, count(*) FILTER (u IS NULL OR value <= u) AS n FROM ke CROSS JOIN (VALUES (10.0), (50.0), (100.0), (500.0), (NULL)) v(u) GROUP BY ALL")
put("s117b_latency", f"SELECT comm, {LAT.format('value')} FROM ke GROUP BY ALL")

# sources, from the lines that the query renders
READ = "sc_type IN (0, 2, 3, 9) OR (sc_type = 1 AND k % 10 <> 9)"
put("s001_strace", f"SELECT trace_id AS trace, pid, sc_type, CASE WHEN sc_type = 9 THEN '' ELSE resource END AS resource, count(*) AS n FROM ke WHERE {READ} GROUP BY ALL")
put(
    "s002_exec_names",
    f"""SELECT pid, coalesce(name, 'unknown') AS comm, count(*) AS n FROM (SELECT pid, last_value(CASE WHEN sc_type = 0 THEN substr(string_split(resource, '/')[-1], 1, 15) END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts_us, event_id) AS name FROM ke WHERE {READ}) q GROUP BY ALL""",
)

# two tiers, calibration and breakdowns
CTES["draft"] = "SELECT pid, wid, label, round(greatest(0, 1 - score - (pid % 7) / 100.0::DOUBLE), 6) AS confidence FROM said"
CTES["mix"] = entropy_sql("edges", "pid, wid", "label")
CTES["two"] = """SELECT d.pid, d.wid, CASE WHEN h < 3.8 AND d.label = 'BENIGN' AND d.confidence >= 0.9 THEN 'draft' ELSE 'full' END AS tier, d.label AS l, d.confidence AS c, s.label AS sl, s.confidence AS sc FROM draft d JOIN said s USING (pid, wid) JOIN mix USING (pid, wid)"""
put("s078_dual_tier", "SELECT pid, CAST(wid AS BIGINT) AS wid, CASE tier WHEN 'draft' THEN l ELSE sl END AS label, CASE tier WHEN 'draft' THEN c ELSE sc END AS confidence, tier FROM two")
put("s112_dual_tier_eval", "SELECT count(*) FILTER (tier = 'draft') AS draft, count(*) FILTER (tier = 'full') AS \"full\", round(count(*) FILTER (tier = 'draft') / count(*), 6) AS reduction FROM two")
put("s079_conformal_fast_path", "SELECT n, CASE WHEN n >= 10 THEN s[least(ceil((n + 1) * 0.9), n)::INT] END AS q, round(0.1 + 1 / (n + 1), 6) AS bound FROM (SELECT count(*) AS n, list_sort(list(confidence)) AS s FROM draft JOIN truth USING (pid, wid) WHERE hits >= 3 AND label = 'BENIGN') z")
CTES["named"] = f"SELECT DISTINCT pid, wid, {SCENARIO} AS scenario FROM win"
WORKLOAD = "CASE WHEN starts_with(scenario, 'attack_') THEN 'attack' WHEN starts_with(scenario, 'benign_ext_') THEN 'extended_server' WHEN starts_with(scenario, 'benign_') THEN split_part(scenario, '_', 2) ELSE 'unknown' END"
FAMILY = "CASE WHEN regexp_matches(scenario, '^attack_T[0-9]+') THEN regexp_extract(scenario, 'attack_(T[0-9]+)', 1) ELSE scenario END"
put("s108_error_breakdown", f"""SELECT CASE WHEN flagged_m THEN 'false_alarm' ELSE 'miss' END AS kind, CASE WHEN flagged_m THEN {WORKLOAD} ELSE {FAMILY} END AS "group", count(*) AS n FROM judged JOIN named USING (pid, wid) WHERE flagged_m <> malicious GROUP BY ALL""")
put("s108b_worst_scenarios", "SELECT scenario, count(*) AS windows, count(*) FILTER (flagged_m <> malicious) AS errors FROM judged JOIN named USING (pid, wid) GROUP BY ALL ORDER BY errors DESC, scenario LIMIT 10")
put("s114_corpus_summary", f"SELECT {WORKLOAD} AS workload, hits >= 3 AS malicious, count(*) AS windows, count(DISTINCT pid) AS processes FROM truth JOIN named USING (pid, wid) GROUP BY ALL")
put("s063_claimed_resource", f"SELECT doc_id, {claimed('text')} AS resource FROM documents")
put("s092_tempered", "SELECT pid, CAST(wid AS BIGINT) AS wid, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.5::DOUBLE)), 4) AS confidence FROM (SELECT pid, wid, least(greatest(confidence, 1e-6), 1 - 1e-6) AS p FROM judged) q")

# the facts that tiers are computed from
CTES["viol"] = "SELECT w.pid, w.wid, count(*) AS n_violations, count(*) FILTER (b.severity = 'CRITICAL') AS n_critical, max(CASE b.severity WHEN 'CRITICAL' THEN 0.95::DOUBLE WHEN 'HIGH' THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END) AS severity FROM broken b JOIN win w ON w.trace_id = b.trace_id AND w.g = b.g GROUP BY ALL"
CTES["tail64"] = "SELECT a.pid, a.wid, a.ts_us, b.sc_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY a.pid, a.wid) AS total FROM win a JOIN ev b ON a.pid = b.pid AND b.i BETWEEN a.i - 63 AND a.i WHERE a.idx = 19 GROUP BY a.pid, a.wid, a.ts_us, b.sc_type"
CTES["ended"] = f"SELECT pid, wid, any_value(ts_us) AS ts_us, round(sum({PARTS}), 6) + 0.0 AS entropy FROM tail64 GROUP BY pid, wid"
CTES["called"] = "SELECT pid, wid, 0.55::DOUBLE * max(CAST(ip <> 0 AND distance > 0 AS INT)) AS callsite_score FROM win JOIN placed USING (ip) GROUP BY ALL"
CTES["known"] = """SELECT r.*, s.n_nodes, s.n_edges, s.score AS graph_score, coalesce(v.n_violations, 0) AS n_violations, coalesce(v.n_critical, 0) AS n_critical, coalesce(v.severity, 0) AS severity, c.callsite_score, e.entropy, e.ts_us,
  CASE WHEN r.label = 'MALICIOUS' THEN r.confidence ELSE 1 - r.confidence END AS signed FROM report r JOIN score s USING (pid, wid) LEFT JOIN viol v USING (pid, wid) JOIN called c USING (pid, wid) JOIN ended e USING (pid, wid)"""
CTES["facts"] = """SELECT *, round(greatest(0, least(0.4::DOUBLE * signed + 0.25::DOUBLE * signed * (1 - hallucination_rate) + 0.2::DOUBLE * least(0.25::DOUBLE * n_critical, 1) + 0.1::DOUBLE * least(n_edges / greatest(n_nodes, 1) / 5.0::DOUBLE, 1) + 0.05::DOUBLE * least(entropy / 4.0::DOUBLE, 1), 1)), 6) AS escalation,
  CASE WHEN round(confidence, 6) < 0.3 THEN 0 WHEN round(confidence, 6) < 0.5 THEN 1 WHEN round(confidence, 6) < 0.7 THEN 2 WHEN round(confidence, 6) < 0.85 THEN 3 ELSE 4 END AS band FROM known"""
CTES["audit"] = "SELECT *, CASE WHEN label = 'MALICIOUS' OR round(callsite_score, 6) >= 0.4 THEN band ELSE 0 END AS tier FROM facts"
CTES["quiet"] = "SELECT escalation FROM facts JOIN truth USING (pid, wid) WHERE hits < 3"
CTES["bound"] = "SELECT CASE WHEN n >= 10 THEN s[least(ceil((n + 1) * 0.9), n)::INT] END AS q FROM (SELECT count(*) AS n, list_sort(list(escalation)) AS s FROM quiet) z"
CTES["capped"] = "SELECT f.*, CASE WHEN q IS NULL THEN 0 WHEN escalation <= q THEN 1 ELSE 4 END AS cap FROM facts f, bound"
CTES["gated"] = """SELECT *, CASE WHEN label = 'MALICIOUS' AND hallucination_rate > 0.5 THEN 0 WHEN label = 'MALICIOUS' AND verified = 0 THEN 1 ELSE 4 END AS cove_cap, CASE WHEN n_critical > 0 AND NOT hallucination_rate > 0.5 THEN 1 ELSE 0 END AS floor,
  CASE WHEN label = 'MALICIOUS' THEN band ELSE 0 END AS tier0 FROM capped"""
KEYS = "pid, CAST(wid AS BIGINT) AS wid"
COVE = "CASE WHEN hallucination_rate > 0.5 THEN 0.29::DOUBLE END"
put("s068_explainability", f"SELECT r.pid, CAST(r.wid AS BIGINT) AS wid, round(verified / greatest(total, 1) * CASE WHEN n_violations > 0 THEN 1.0 ELSE 0.5 END, 4) AS explainability FROM report r LEFT JOIN viol v USING (pid, wid)")
FUSED = f"round(least(greatest(graph_score, callsite_score, CASE WHEN severity >= 0.7 THEN severity ELSE 0 END, CASE WHEN label = 'MALICIOUS' THEN confidence ELSE 0 END), coalesce({COVE}, 1e9)), 6)"
put("s085_fused", f"SELECT *, CASE WHEN fused >= 0.5 THEN 'MALICIOUS' ELSE 'BENIGN' END AS fused_label FROM (SELECT {KEYS}, {FUSED} AS fused FROM facts) q")
put("s086_audit_adjust", f"SELECT {KEYS}, round(least(verified_confidence + CASE WHEN label = 'MALICIOUS' THEN least(0.1::DOUBLE * n_violations, 0.2::DOUBLE) ELSE 0 END, 1), 6) AS adjusted, {COVE} AS cove_cap FROM facts")
put("s087_tiers", f"SELECT {KEYS}, tier FROM audit")
put("s088_escalation", f"SELECT {KEYS}, escalation FROM facts")
put("s089_calibrated_caps", f"SELECT {KEYS}, cap FROM capped")
put("s090_pvalues", f"SELECT {KEYS}, round(((SELECT count(*) FROM quiet b WHERE b.escalation >= f.escalation) + 1) / ((SELECT count(*) FROM quiet) + 1), 6) AS p FROM facts f")
put(
    "s091_gates",
    f"""SELECT {KEYS}, cove_cap, floor, least(greatest(least(tier0, cove_cap), floor), cap) AS tier, CASE WHEN cap < greatest(least(tier0, cove_cap), floor) THEN 'calibration' WHEN floor > least(tier0, cove_cap) THEN 'ltl' WHEN cove_cap < tier0 THEN 'cove' END AS capped_by FROM gated""",
)
CTES["warm"] = "SELECT i / 10.0::DOUBLE AS t, malicious = flagged_m AS correct, round(1 / (1 + exp(-ln(p / (1 - p)) / (i / 10.0::DOUBLE))), 4) AS c FROM (SELECT *, least(greatest(confidence, 1e-6), 1 - 1e-6) AS p FROM judged) j, range(5, 31) r(i)"
put(
    "s093_fitted_temperature",
    """SELECT t, ece FROM (SELECT t, round(sum(n / total * abs(acc - conf)), 6) AS ece FROM (SELECT t, least(floor(round(c * 10, 6)), 9) AS b, count(*) AS n, sum(count(*)) OVER (PARTITION BY t) AS total, avg(CAST(correct AS DOUBLE)) AS acc, avg(c) AS conf FROM warm GROUP BY t, b) q GROUP BY t) z ORDER BY ece, t LIMIT 1""",
)
CTES["bins"] = "SELECT least(floor(round(confidence * 10, 6)), 9) AS b, count(*) AS n, round(abs(round(avg(CAST(malicious = flagged_m AS DOUBLE)), 6) - round(avg(confidence), 6)), 6) AS gap FROM judged GROUP BY ALL"
put(
    "s103b_calibration_error",
    """SELECT ece, CASE WHEN ece < 0.05 THEN 'well calibrated' WHEN ece < 0.1 THEN 'acceptable' WHEN ece < 0.2 THEN 'poor' ELSE 'unreliable' END AS verdict, (SELECT count(*) FROM judged WHERE confidence > 0.8 AND malicious <> flagged_m) AS sure_errors FROM (SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM bins) q""",
)
put("s115b_threat_rates", "SELECT ts_us - ts_us % 86400000000 AS start_us, ttp, count(*) AS n FROM (SELECT a.ts_us, unnest(string_split(s.ttps, ',')) AS ttp FROM audit a JOIN said s USING (pid, wid) WHERE a.label = 'MALICIOUS' AND s.ttps <> '') q GROUP BY ALL")
put("s116b_tier_usage", "SELECT ts_us - ts_us % 86400000000 AS start_us, tier, count(*) AS n FROM audit GROUP BY ALL")
put("s118_recent", f"SELECT {KEYS}, label, tier, ts_us FROM audit ORDER BY ts_us DESC, pid DESC LIMIT 100")
put("s118b_status", "SELECT count(*) AS decisions, count(*) FILTER (label = 'MALICIOUS') AS malicious, count(*) FILTER (tier >= 3) AS isolated, max(ts_us) AS last_us FROM audit")

# what a model might have said, requests and answers
CTES["entity"] = "SELECT pid, wid, unnest(['/etc/shadow', concat('/tmp/stage', pid), concat('185.220.101.', pid % 20, ':4444')]) AS x, unnest([0, 1, 2]) AS k FROM said"
put("s064_reasoning_claims", f"SELECT {KEYS}, CAST(k AS INT) AS claim_id, x AS event_desc, CASE k WHEN 0 THEN 'T1003' ELSE 'T1071.001' END AS supports, round(1.0::DOUBLE / greatest(CASE WHEN ttps = '' THEN 0 ELSE len(string_split(ttps, ',')) END, 1) / 3, 4) AS contribution FROM entity JOIN said USING (pid, wid)")
CTES["backed"] = "SELECT e.pid, e.wid, e.x, bool_or(contains(w.resource, x) OR (starts_with(x, '/') AND ends_with(x, w.comm))) AS ok FROM entity e JOIN win w ON e.pid = w.pid AND e.wid = w.wid GROUP BY ALL"
put(
    "s067_entity_audit",
    f"""SELECT {KEYS}, CASE WHEN label = 'BENIGN' OR missing = 0 THEN label ELSE 'BENIGN' END AS label, CASE WHEN label = 'BENIGN' OR missing = 0 THEN confidence ELSE 0 END AS confidence, CAST(entities AS INT) AS entities, CAST(missing AS INT) AS missing
    FROM said JOIN (SELECT pid, wid, count(*) AS entities, count(*) FILTER (NOT ok) AS missing FROM backed GROUP BY ALL) b USING (pid, wid)""",
)
put("s080_requests", f"SELECT {KEYS}, CAST(length(CAST(to_json([{{'role': 'system', 'content': 'Classify the process graph.'}}, {{'role': 'user', 'content': text}}]) AS VARCHAR)) AS INT) AS size, text AS content FROM text")
put("s080b_responses", f"SELECT {KEYS}, CASE WHEN pid % 5 = 0 THEN 'BENIGN' ELSE label END AS label, CASE WHEN pid % 5 = 0 THEN 0.5::DOUBLE ELSE score END AS confidence FROM said")
CTES["coord"] = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"
CTES["centre"] = "SELECT i, avg(x) FILTER (label = 1) AS m, avg(x) FILTER (label <> 1) AS o FROM coord GROUP BY i"
put("s083_centroid_divergence", "SELECT vec_id, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END, 6) AS divergence FROM (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS a, sqrt(sum((x - o) * (x - o))) AS b FROM coord JOIN centre USING (i) GROUP BY vec_id) q")

# labels, samples and comparisons of classifiers
CTES["tag"] = f"SELECT *, split_part(resource, ':', 1) IN ('185.220.101.4', '185.220.101.7') AS c2, {has_any('resource', C.MALWARE_PATHS)} AS bad FROM hit"
CTES["c2pid"] = "SELECT DISTINCT pid FROM tag WHERE c2"
CTES["above"] = " UNION ".join(
    f"SELECT p{d}.ppid AS pid FROM c2pid f " + " ".join(f"JOIN up p{i} ON p{i}.pid = {'f.pid' if i == 1 else f'p{i - 1}.ppid'} AND p{i}.ppid <> p{i}.pid" for i in range(1, d + 1)) for d in range(1, 9)
)
CTES["seen_in"] = "SELECT pid, wid, count(attack) AS hits, arg_min(attack, idx) FILTER (attack IS NOT NULL) AS attack, lower(arg_min(comm, idx)) AS comm, bool_or(c2) AS c2, bool_or(bad) AS malware FROM tag GROUP BY ALL"
CTES["labelled"] = f"""SELECT {KEYS}, hits, comm, c2, malware, malicious, CASE WHEN malicious THEN coalesce(attack, CASE WHEN c2 THEN 'c2_detected' WHEN malware THEN 'malware_detected' ELSE '' END) ELSE '' END AS name
  FROM (SELECT *, c2 OR malware OR hits >= 3 AND comm IN ('nginx', 'vugefal') AS malicious FROM (SELECT * REPLACE (c2 OR NOT malware AND pid IN (SELECT pid FROM above) AS c2) FROM seen_in) q) z"""
put("s099_label_windows", "SELECT * FROM labelled")
put(
    "s100_stratified_sample",
    "SELECT pid, wid, malicious, name FROM labelled QUALIFY row_number() OVER (PARTITION BY malicious ORDER BY CASE name WHEN 'c2_detected' THEN 0 WHEN 'malware_detected' THEN 1 ELSE 3 END, pid, wid) <= 50",
)
CTES["two_ways"] = "SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM (SELECT malicious = flagged_m AS x, (r.score >= 0.3) = malicious AS y FROM judged j JOIN ruled r USING (pid, wid)) q"
put(
    "s104_mcnemar",
    "SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(100000) r(i) WHERE i <= least(b, c))) END, 6) AS p FROM two_ways",
)
CTES["of_trace"] = "SELECT trace_id, bool_or(malicious) AS malicious, bool_or(flagged_m) AS flagged FROM judged JOIN (SELECT DISTINCT pid, wid, trace_id FROM win) w USING (pid, wid) GROUP BY ALL"
put(
    "s107_entropy_sweep",
    f"SELECT *, {RATES} FROM (SELECT threshold, {CELLS.format('f')}, count(*) FILTER (skipped) AS skipped FROM (SELECT threshold, malicious, flagged AND max_entropy >= threshold AS f, max_entropy < threshold AS skipped FROM of_trace JOIN sliding USING (trace_id) CROSS JOIN (VALUES (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) v(threshold)) q GROUP BY ALL) z",
)
CTES["ablated"] = """SELECT s.pid, s.wid, s.score, h.label = 'MALICIOUS' AS outside, t.hits >= 3 AS malicious, coalesce(v.n_violations, 0) > 0 AS violated, r.hallucination_rate > 0.1 AS unsure, c.callsite_score >= 0.4 AS astray, s.score > 0.15 AND s.score < 0.55 AS gray,
  CASE WHEN s.score >= 0.55 THEN true WHEN s.score <= 0.15 THEN false ELSE h.label = 'MALICIOUS' END AS hybrid FROM score s JOIN said h USING (pid, wid) JOIN truth t USING (pid, wid) LEFT JOIN viol v USING (pid, wid) JOIN report r USING (pid, wid) JOIN called c USING (pid, wid)"""
CTES["modes"] = """SELECT 'llm_only' AS mode, malicious, outside AS f, true AS asked FROM ablated UNION ALL SELECT 'graph_only', malicious, score >= 0.5, false FROM ablated UNION ALL SELECT 'hybrid', malicious, hybrid, gray FROM ablated
  UNION ALL SELECT 'hybrid_ltl', malicious, hybrid OR violated, gray FROM ablated UNION ALL SELECT 'full', malicious, (hybrid OR violated) AND NOT (gray AND unsure), gray FROM ablated"""
put("s109_ablation", f"SELECT *, {RATES} FROM (SELECT mode, {CELLS.format('f')}, count(*) FILTER (asked) AS calls FROM modes GROUP BY ALL) q")
put(
    "s110_layered",
    "SELECT count(*) AS attacks, count(*) FILTER (outside OR violated OR astray) AS found, count(*) FILTER (outside AND NOT violated AND NOT astray) AS model_only, count(*) FILTER (violated AND NOT outside AND NOT astray) AS rules_only, count(*) FILTER (astray AND NOT outside AND NOT violated) AS callsite_only FROM ablated WHERE malicious",
)
CTES["figures"] = f"SELECT {RATES} FROM (SELECT {CELLS.format('flagged_m')} FROM judged) q"
CTES["claims_of"] = "SELECT 'tpr' AS metric, round(tpr, 3) AS value, tpr AS found, 3 AS digits FROM figures UNION ALL SELECT 'fpr', fpr + 0.2::DOUBLE, fpr, 3 FROM figures UNION ALL SELECT 'accuracy', round(accuracy, 2), accuracy, 2 FROM figures UNION ALL SELECT 'other', 0.5::DOUBLE, NULL, 2"
put("s113_reconciled", "SELECT metric, value, found, coalesce(floor(found * power(10, digits) + 0.5) = floor(value * power(10, digits) + 0.5), false) AS passed FROM claims_of")
put("s082_behaviour_vectors", f"SELECT {KEYS}, round(avg((sc_type % 16) / 16), 6) AS v1, round(avg(ln(distance + 1.0::DOUBLE) / 30), 6) AS v2, round(avg(({CATEGORY}) / 8), 6) AS v3 FROM win JOIN placed USING (ip) GROUP BY ALL")

# readers over rendered records
CTES["subject"] = "SELECT DISTINCT pid AS cid, ppid AS parent, comm AS name FROM ke"
CTES["act"] = """SELECT e.*, event_id AS seq, s.cid, s.parent, s.name, CASE WHEN sc_type = 0 AND k % 3 = 0 THEN concat(resource, '.run') END AS named, CASE WHEN sc_type = 0 AND k % 3 = 1 THEN concat(comm, '-by-its-own-name') END AS exec,
  CASE WHEN sc_type < 3 OR (sc_type = 3 AND k % 5 <> 4) THEN resource ELSE '' END AS object FROM ke e LEFT JOIN subject s ON s.cid = e.pid AND e.event_id % 50 <> 0"""
put(
    "s003_provenance_events",
    """SELECT seq, ts_us, coalesce(cid, 0) AS pid, CASE WHEN parent IN (SELECT pid FROM ke) THEN parent ELSE 0 END AS ppid, substr(coalesce(exec, name, 'unknown'), 1, 15) AS comm, CAST(CASE WHEN sc_type IN (9, 10) THEN 15 ELSE sc_type END AS INT) AS sc_type,
    coalesce(named, CASE WHEN object = '' AND sc_type = 3 THEN resource ELSE object END) AS resource FROM act WHERE sc_type <> 15""",
)
put(
    "s006_whole_windows",
    """SELECT seq, (place - 1) // 20 AS wid, CAST((place - 1) % 20 AS INT) AS idx, coalesce(cid, 0) AS pid, substr(CASE WHEN cid IS NULL THEN coalesce(exec, 'unknown') ELSE coalesce(so_far, lite_name) END, 1, 15) AS comm, CAST(sc_type AS INT) AS sc_type,
    coalesce(named, CASE WHEN object = '' AND sc_type = 3 AND k % 2 = 0 THEN split_part(resource, ':', 1) ELSE object END) AS resource
    FROM (SELECT *, CASE WHEN pid % 4 <> 0 THEN name ELSE 'unknown' END AS lite_name, row_number() OVER (ORDER BY seq) AS place, last_value(exec IGNORE NULLS) OVER (PARTITION BY cid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM act WHERE sc_type IN (0, 1, 2, 3)) q""",
)
CTES["numbers"] = """SELECT *, concat('/root/', CASE pid % 4 WHEN 0 THEN concat('Attack_Data_Master/Web_Shell_', pid) WHEN 1 THEN concat('Attack_Data_Master/Adduser_', pid) ELSE 'Training_Data_Master' END, '/', pid, '.txt') AS path FROM ke WHERE sc_type IN (0, 1, 2, 3, 4, 5, 7, 8, 9, 10)"""
put(
    "s007_call_numbers",
    f"""SELECT 39999 + dense_rank() OVER (ORDER BY path) AS pid, (row_number() OVER (PARTITION BY path ORDER BY event_id) - 1) * 1000 AS ts_us, CAST(sc_type AS INT) AS sc_type, {case("sc_type", C.CALL_RESOURCES, "[other]")} AS resource,
    CASE pid % 4 WHEN 0 THEN 'Web_Shell' WHEN 1 THEN 'Adduser' END AS attack_type, CASE pid % 4 WHEN 0 THEN 'T1505' WHEN 1 THEN 'T1136' END AS technique, CASE WHEN pid % 4 < 2 THEN 'MALICIOUS' ELSE 'BENIGN' END AS label FROM numbers""",
)
put("s008_call_number_summary", "SELECT CASE WHEN pid % 4 < 2 THEN 'MALICIOUS' ELSE 'BENIGN' END AS label, CASE pid % 4 WHEN 0 THEN 'Web_Shell' WHEN 1 THEN 'Adduser' END AS attack_type, count(DISTINCT path) AS traces FROM numbers GROUP BY ALL")
CTES["parted"] = "SELECT ppid % 7 AS scenario, ts_us // 21600000000 AS file, event_id AS seq, CAST(sc_type IN (0, 2, 3, 7) AS INT) AS hit FROM ke"
CTES["part_ends"] = "SELECT scenario, file FROM parted UNION SELECT scenario, file + 1 FROM parted"
put(
    "s010_file_end_windows",
    """SELECT scenario, file, CAST(attacks AS INT) AS attacks, CASE WHEN attacks >= 3 THEN 1 ELSE 0 END AS label, CASE WHEN attacks > 4 THEN 1 ELSE 0 END AS predicted, round(CASE WHEN attacks > 4 THEN attacks / 20 ELSE 1 - attacks / 20 END, 6) AS confidence
    FROM (SELECT scenario, file, sum(hit) AS attacks, count(*) AS held FROM (SELECT e.scenario, e.file, p.hit, row_number() OVER (PARTITION BY e.scenario, e.file ORDER BY p.file DESC, p.seq DESC) AS r
    FROM part_ends e JOIN parted p ON p.scenario = e.scenario AND p.file <= e.file) t WHERE r <= 20 GROUP BY ALL) q WHERE held = 20""",
)

# the same results by other plans
ORACLE["s014b_windows_of_large_pids"], ORACLE["s036b_triage_in_blocks"] = ORACLE["s014_tumbling_windows"], ORACLE["s036_triage"]

# result files as rendered.artifacts writes them
META = """concat('"meta":{"backend":"', CASE pid % 3 WHEN 0 THEN 'trusted' WHEN 1 THEN 'unknown' ELSE 'other' END, '","system":"', CASE WHEN pid % 5 = 0 THEN 'Darwin' ELSE 'Linux' END, '","platform":"', CASE WHEN pid % 10 = 0 THEN 'MacBook-1' ELSE 'vm' END, '","fallbacks":', pid % 4, ',"machine":"', CASE WHEN pid % 2 = 0 THEN 'x86_64' ELSE 'arm64' END, '"}')"""
CTES["made"] = f"""SELECT pid, n, pid % 6 <> 0 AS is_json, pid % 11 = 0 AS broken, CASE WHEN pid % 2 = 0 THEN concat('{{"p50":', n, ',"p99":', 2 * n, '}}') ELSE concat('{{"mean":', n, '}}') END AS timing,
  CASE WHEN pid % 7 = 0 THEN '' ELSE concat(',', {META}) END AS meta FROM (SELECT pid, count(*) AS n FROM ke GROUP BY pid) q"""
CTES["artifact"] = "SELECT *, concat(CASE WHEN broken THEN '{' ELSE '' END, '{\"f1\":', n, ',\"n_windows\":', n // 20, ',\"ipg_ms\":', timing, meta, '}') AS body FROM made"
put(
    "s013_manifest",
    """SELECT concat('run', pid, CASE WHEN is_json THEN '.json' ELSE '.txt' END) AS name, CAST(length(body) AS BIGINT) AS bytes, sha256(body) AS sha256, CASE WHEN is_json AND NOT broken THEN concat('f1=', n, ';ipg_ms=', timing, ';n_windows=', n // 20) ELSE '' END AS headline,
    CASE WHEN NOT is_json OR broken THEN '' WHEN meta = '' THEN 'NO META BLOCK' ELSE concat_ws(';', CASE pid % 3 WHEN 1 THEN 'backend=unknown (non-LLM eval?)' WHEN 2 THEN 'backend=other' END, CASE WHEN pid % 5 = 0 THEN 'MAC_HOST_REJECT' END, CASE WHEN pid % 10 = 0 THEN 'MAC_PLATFORM_REJECT' END,
      CASE WHEN pid % 4 > 0 THEN concat('MOCK_FALLBACKS=', pid % 4) END, CASE WHEN pid % 2 = 1 THEN 'machine=arm64' END) END AS flags, CASE WHEN is_json AND broken THEN 'invalid JSON' END AS error FROM artifact""",
)

# call sites blended with the divergence of behaviour
CTES["vector"] = f"SELECT v.*, bad AS static FROM (SELECT pid, wid, round(avg((sc_type % 16) / 16), 6) AS v1, round(avg(ln(distance + 1.0::DOUBLE) / 30), 6) AS v2, round(avg(({CATEGORY}) / 8), 6) AS v3, max(CAST(ip <> 0 AND distance > 0 AS INT)) AS bad FROM win JOIN placed USING (ip) GROUP BY ALL) v"
CTES["centre"] = "SELECT avg(v1) FILTER (static = 0) AS i1, avg(v2) FILTER (static = 0) AS i2, avg(v3) FILTER (static = 0) AS i3, avg(v1) FILTER (static = 1) AS o1, avg(v2) FILTER (static = 1) AS o2, avg(v3) FILTER (static = 1) AS o3 FROM vector"
CTES["apart"] = "SELECT pid, wid, static, sqrt((v1 - i1) ** 2 + (v2 - i2) ** 2 + (v3 - i3) ** 2) AS i, sqrt((v1 - o1) ** 2 + (v2 - o2) ** 2 + (v3 - o3) ** 2) AS o FROM vector JOIN centre ON true"
put("s081b_call_site_blend", f"SELECT {KEYS}, static, round(ai, 6) AS ai, round(greatest(0.4::DOUBLE * static + 0.6::DOUBLE * ai, 0.55::DOUBLE * static), 6) AS score FROM (SELECT *, CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0.5::DOUBLE END AS ai FROM apart) q")
put(
    "s112b_tiers_by_scenario",
    """SELECT scenario, count(*) AS windows, count(*) FILTER ((CASE t.tier WHEN 'draft' THEN l ELSE sl END = 'MALICIOUS') = (hits >= 3)) AS dual_correct, count(*) FILTER ((s.label = 'MALICIOUS') = (hits >= 3)) AS full_correct,
    count(*) FILTER (t.tier = 'draft') AS draft, count(*) FILTER (t.tier = 'full') AS "full", round(100 * count(*) FILTER (t.tier = 'draft') / count(*), 1) AS saved FROM two t JOIN said s USING (pid, wid) JOIN truth USING (pid, wid) JOIN named USING (pid, wid) GROUP BY scenario""",
)
put("s080c_gray_requests", f"SELECT {KEYS}, 'graph of a shell that reads /etc/shadow and connects out' AS m1, '{{\"label\": \"benign\", \"confidence\": 0.9}}' AS m4, text AS m5, 'user' AS role FROM text WHERE (pid, wid) IN (SELECT (pid, wid) FROM score WHERE score > 0.15 AND score < 0.55)")
