"""DuckDB SQL that states the same results as the queries of the catalogue."""

from __future__ import annotations

_RAW = """
select case when l_shipdate < timestamp '1998-06-01' then 'baseline' else 'current' end as run,
  case when l_suppkey % 2 = 0 then 'Supplier#' || l_suppkey when l_shipdate < timestamp '1998-06-01' then 'SUPPLIER#' || l_suppkey else ' supplier#' || l_suppkey end as server,
  case when l_suppkey % 7 = 0 then '' else p_brand || ' STIG V' || (p_size % 3) || 'R1' end as stig_title,
  case when l_partkey % 5 = 0 then '' else 'V-' || l_partkey end as vuln_id,
  'xccdf_mil.disa.stig_rule_SV-' || l_partkey || 'r' || l_linenumber || '_rule' as rule_id,
  case when p_size <= 10 then 'CAT I' when p_size <= 30 then 'CAT II' when p_size <= 45 then 'CAT III' else 'Unknown' end as severity,
  case l_returnflag || l_linestatus when 'RF' then 'fail' when 'RO' then 'notchecked' when 'AF' then 'error' when 'AO' then 'unknown' when 'NF' then 'pass' else 'notapplicable' end as raw_status,
  '10.0.' || (l_suppkey % 4) || '.' || (l_partkey % 2) as ip_address, p_type as check_text, p_name as fix_text,
  p_brand, l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice
from lineitem join part on l_partkey = p_partkey
where not (l_shipdate < timestamp '1998-06-01' and (l_suppkey % 10 = 1 or (l_suppkey % 10 = 2 and p_brand = 'Brand#5')))
  and not (l_shipdate >= timestamp '1998-06-01' and (l_suppkey % 10 = 3 or (l_suppkey % 10 = 4 and p_brand = 'Brand#13')))
"""
_UNEVEN = "On shared hosts the runs differ in how many findings lack a vulnerability id, so New and Resolved may be off there; were benchmarks given for one run only? Baseline, current: "
_NOT_RESCANNED = " host and benchmark pairs of the baseline were not scanned again; what was found there is Not re-scanned, not Resolved: "
_NEWLY_SCANNED = " host and benchmark pairs of the current run are not in the baseline; what was found there is Newly scanned, not New: "
_UNTITLED = " hosts have scans without a benchmark title, and nothing shows that they were scanned again; benchmarks for both runs would tell. Hosts: "
_SPACE = r"[\s]"

_STIG = r"""case when t.x in ('', 'unknown stig', 'nessus compliance') then '' else coalesce(nullif(array_to_string(list_filter(
  string_split_regex(replace(regexp_replace(t.x, '\.audit$', ''), 'security technical implementation guide', ' '), '[^a-z0-9]+'),
  lambda w: w <> '' and w not in ('stig', 'scap', 'benchmark', 'manual', 'disa') and not regexp_full_match(w, 'v\d+r\d+')), ' '), ''), t.x) end"""


def _title(c: str) -> str:
    return rf"(select {_STIG} from (select lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))) as x) t)"


def _host(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def _stem(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^xccdf_[^_]+_rule_', ''), 'r\d+_rule$', '')"


_STATUS = "case raw_status when 'fail' then 'Open' when 'notchecked' then 'Not Reviewed' when 'notselected' then 'Not Reviewed' when 'error' then 'Error' when 'unknown' then 'Unknown' end"
_ORDER = "l_orderkey, l_linenumber, rule_id, l_quantity, l_extendedprice, server"
_SIZES = "case when p_size <= 10 then 'CAT I' when p_size <= 30 then 'CAT II' when p_size <= 45 then 'CAT III' else 'Unknown' end"

_FOUND = f"""raw as ({_RAW}),
findings as (
  select *, {_host("server")} as host_key, {_title("stig_title")} as stig_key, nullif(vuln_id, '') as vuln_key, nullif({_stem("rule_id")}, '') as rule_key, coalesce(nullif(vuln_id, ''), rule_id) as finding_key,
    row_number() over (order by {_ORDER}) as o
  from (select *, {_STATUS} as status from raw) where status is not null)"""

_COVERED = f"""covered as (select run, {_host("server")} as host_key, {_title("stig_title")} as stig_key, server, stig_title from (select distinct run, server, stig_title from raw)),
pairs as (select run, host_key, stig_key, min(row(server, stig_title)) as m from covered group by all),
sides as (select host_key, min(m[1]) filter (where run = 'baseline') as b, min(m[1]) filter (where run = 'current') as c from pairs group by host_key),
common as (select host_key from sides where b is not null and c is not null)"""


def _pass(name: str, base: str, curr: str, key: str) -> str:
    """CTEs {name}_b, {name}_c (numbered rows), {name} (pairs) and {name}_b_left, {name}_c_left."""
    out = []
    for p, rows in (("b", base), ("c", curr)):
        out.append(f"{name}_{p} as (select *, case when {key} is null then null else row_number() over (partition by host_key, {key} order by o) end as copy_no from {rows})")
    out.append(f"{name} as (select b.o as bo, c.o as co from {name}_b b join {name}_c c on b.host_key = c.host_key and b.{key} = c.{key} where b.copy_no = 1 and c.copy_no = 1)")
    out.extend(f"{name}_{p}_left as (select * exclude (copy_no) from {name}_{p} where coalesce(copy_no, 1) = 1 and o not in (select {p}o from {name}))" for p in "bc")
    return ",\n".join(out)


_DELTA = f"""{_FOUND},
{_COVERED},
b_in as (select * from findings where run = 'baseline' and host_key in (from common)),
c_in as (select * from findings where run = 'current' and host_key in (from common)),
outside as (select *, row_number() over (partition by run, host_key, finding_key order by o) as copy_no from findings where host_key not in (from common)),
{_pass("p1", "b_in", "c_in", "vuln_key")},
{_pass("p2", "p1_b_left", "p1_c_left", "rule_key")},
titled as (select distinct run, host_key, stig_key from pairs where stig_key <> ''),
tagged as (
  select o, case run when 'baseline' then 'Not re-scanned' else 'Newly scanned' end as delta_status, case run when 'baseline' then status else '' end as baseline_status, case run when 'current' then status else '' end as current_status from outside where copy_no = 1
  union all select co, 'Persisting', b.status, c.status from (select * from p1 union all select * from p2) join findings b on b.o = bo join findings c on c.o = co
  union all select o, case when t.host_key is null then 'Not re-scanned' else 'Resolved' end, status, '' from p2_b_left l left join titled t on t.run = 'current' and t.host_key = l.host_key and t.stig_key = l.stig_key
  union all select o, case when t.host_key is null then 'Newly scanned' else 'New' end, '', status from p2_c_left l left join titled t on t.run = 'baseline' and t.host_key = l.host_key and t.stig_key = l.stig_key),
delta as (select f.*, delta_status, baseline_status, current_status from findings f join tagged using (o))"""

_GAPS = {
    side: f"select host_key, stig_key, m[1] as server, m[2] as stig_title from pairs p where run = '{side}' and (stig_key = '' or not exists (select 1 from pairs q where q.run = '{other}' and q.host_key = p.host_key and q.stig_key = p.stig_key))"
    for side, other in (("baseline", "current"), ("current", "baseline"))
}
_LIST = """select count(*)::bigint as n, string_agg(server || ' / ' || coalesce(nullif(stig_title, ''), '(untitled)'), '; ' order by host_key, stig_key, server, stig_title) filter (where k <= 20)
  || case when count(*) > 20 then '; and ' || (count(*) - 20) || ' more' else '' end as text
from (select *, row_number() over (order by host_key, stig_key, server, stig_title) as k from ({gap}))"""
_CATS = "count_if(severity = 'CAT I')::bigint as cat_i, count_if(severity = 'CAT II')::bigint as cat_ii, count_if(severity = 'CAT III')::bigint as cat_iii"
_RAW_SEVERITY = "case p_size % 4 when 0 then 'High' when 1 then 'medium' when 2 then 'LOW' else 'critical' end"


def _severity(c: str) -> str:
    return f"case lower({c}) when 'high' then 'CAT I' when 'medium' then 'CAT II' when 'low' then 'CAT III' else 'Unknown' end"


def _cklb(c: str) -> str:
    return f"case lower(trim({c})) when 'open' then 'Open' when 'not_reviewed' then 'Not Reviewed' when 'not_a_finding' then 'Not A Finding' when 'not_applicable' then 'Not Applicable' when 'error' then 'Error' else 'Unknown' end"


def _nessus(c: str) -> str:
    return f"case upper(trim({c})) when 'FAILED' then 'Open' when 'PASSED' then 'Not A Finding' when 'WARNING' then 'Not Reviewed' when 'ERROR' then 'Error' else 'Unknown' end"


def _token(key: str) -> str:
    return rf"trim(regexp_extract(ref, '(?:^|,)\s*{key}\s*\|([^,]*)', 1))"


_LOOKUP = f"rules as (select p_partkey as rule_id, 'V-' || p_partkey as vuln_id, {_SIZES} as severity, p_type as check_text, p_name as fix_text from part where p_partkey % 10 <> 0)"


def _copy(label: str) -> str:
    return f"'{label} run: ' || server || ' has ' || coalesce(nullif(vuln_id, ''), rule_id) || ' more than once, the first counts'"


_ID = "'SV-' || l_partkey || 'r' || l_linenumber || '_rule'"
_LINES = f"""lines as (select *, {_ID} as rule_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as k,
    case l_returnflag || l_linestatus when 'RF' then 'fail' when 'RO' then 'notchecked' when 'AF' then 'error' when 'AO' then 'unknown' when 'NF' then 'pass' else 'notapplicable' end as raw_status
  from lineitem)"""
_SCANS = f"""{_LINES},
results as (select l_suppkey as file_ord, k - 1 as row_ord, rule_id, raw_status as status, l_partkey, l_linenumber from lines where l_linenumber < 6),
scans as (select s_suppkey as file_ord, s_suppkey || '.xml' as source_file, case when s_suppkey % 6 = 4 then s_suppkey::text else s_name end as hostname,
    case s_suppkey % 4 when 0 then '10.0.0.1' when 1 then '::1' when 2 then '10.0.0.2' else 'N/A' end as ip_address, case s_suppkey % 3 when 1 then './dir/BENCH_' || s_nationkey || '.xml' else '' end as benchmark_href,
    case s_suppkey % 3 when 0 then 'xccdf_bench_' || s_nationkey else '' end as benchmark_id,
    case when s_suppkey % 6 = 5 and s_suppkey % 5 in (1, 3) then 'Unknown' else ['OpenSCAP', 'SCC', 'Nessus', 'Evaluate-STIG', 'Unknown'][s_suppkey % 5 + 1] end as scanner,
    (select count(*) from results r where r.file_ord = s_suppkey)::bigint as n_rules, case when s_suppkey % 3 < 2 then s_nationkey end as nation
  from supplier)"""
_MARKS = """rules as (select p_partkey % 25 as nation, row_number() over (partition by p_partkey % 25 order by p_partkey) - 1 as row_ord, 'SV-' || p_partkey || 'r1_rule' as rule_id, case when p_size % 7 = 0 then '' else 'V-' || p_partkey end as vuln_id,
    ['CAT I', 'CAT II', 'CAT III', 'Unknown'][p_size % 4 + 1] as severity, case when p_size % 5 = 0 then '' else p_type end as check_text, p_name as fix_text from part),
marks as (select n_nationkey as nation, n_regionkey, 'xccdf_bench_' || n_nationkey as benchmark_id, n_name || ' STIG' as title from nation)"""
_CKLB = """cklb as (select case when s_suppkey % 4 = 3 then 'Unknown STIG' else s_name || ' STIG' end as stig_title, 'V-' || l_partkey as vuln_id, case when l_linenumber = 3 then 'x' else '' end || rule_id as rule_id,
    case when l_linenumber % 3 = 1 then 'CAT III' else ['CAT I', 'CAT II', 'CAT III', 'Unknown'][l_linenumber % 4 + 1] end as severity, ['Open', 'Not Reviewed', 'Not A Finding', 'Unknown', 'Error', 'Not Applicable'][l_orderkey % 7 + 1] as status,
    case when s_suppkey % 3 = 2 then s_suppkey::text else s_name end as server, case when s_suppkey % 2 = 0 then '10.2.2.2' else 'N/A' end as ip_address, 'c' as check_text, raw_status as fix_text, 1::bigint as kind_rank, s_suppkey + 1000000 as file_ord, k as row_ord
  from lines join supplier on s_suppkey = l_suppkey where l_linenumber < 7 and l_orderkey % 7 < 6)"""
_NESSUS = """nessus as (select case when l_linenumber = 2 then 'Named' else 'plugin' end as stig_title, 'V-' || l_partkey as vuln_id, case l_linenumber % 3 when 0 then rule_id when 1 then 'ST-' || l_partkey else 'check ' || l_partkey end as rule_id,
    ['CAT I', 'CAT II', 'CAT III', 'Unknown'][l_linenumber % 4 + 1] as severity, ['Open', 'Not A Finding', 'Not Reviewed', 'Error', 'Unknown'][l_orderkey % 5 + 1] as status,
    case when s_suppkey % 4 < 3 then s_name when s_suppkey % 8 = 3 then s_suppkey::text else 'n' || s_suppkey end as server, case when s_suppkey % 3 > 0 then '10.3.3.3' when s_suppkey % 8 = 3 then 'N/A' else 'n' || s_suppkey end as ip_address,
    'i' || case when l_linenumber = 1 then chr(10) || chr(10) || 'Scan output: v' else '' end as check_text, raw_status as fix_text, 1::bigint as kind_rank, s_suppkey + 2000000 as file_ord, row_number() over (partition by l_suppkey order by k) as row_ord
  from lines join supplier on s_suppkey = l_suppkey where l_partkey % 5 <> 0)"""
_FIELDS = "stig_title, vuln_id, rule_id, severity, status, server, ip_address, check_text, fix_text"
_SET = f"""with {_SCANS}, {_MARKS}, {_CKLB}, {_NESSUS},
found as (select s.source_file, s.nation, coalesce(m.title, '') as stig_title, coalesce(u.vuln_id, '') as vuln_id, r.rule_id, coalesce(u.severity, '') as severity, {_STATUS.replace("raw_status", "r.status")} as status, s.hostname as server, s.ip_address,
    coalesce(u.check_text, '') as check_text, coalesce(u.fix_text, '') as fix_text, 0::bigint as kind_rank, r.file_ord, r.row_ord, u.rule_id is not null as matched
  from results r join scans s using (file_ord) left join marks m on m.nation = s.nation left join rules u on u.nation = s.nation and u.rule_id = r.rule_id),
own as (select * from cklb union all by name select * from nessus),
every as (select {_FIELDS}, kind_rank, file_ord, row_ord from found where status is not null union all select {_FIELDS}, kind_rank, file_ord, row_ord from own),
findings as (select * from every where status in ('Open', 'Not Reviewed', 'Error', 'Unknown'))"""
_WIDTHS = ", ".join(
    f"least(greatest(max(least(length({c}), {w})), {h}) + 2, {w})::bigint as {c}"
    for c, h, w in (("stig_title", 10, 50), ("vuln_id", 7, 12), ("rule_id", 7, 40), ("severity", 8, 10), ("status", 6, 14), ("server", 6, 30), ("ip_address", 10, 18), ("check_text", 10, 80), ("fix_text", 8, 80))
)


SQL: dict[str, str] = {
    "host_keys": "select s_suppkey, lower(case when s_suppkey % 2 = 0 then upper(s_name) else s_name end) || case s_suppkey % 3 when 0 then 'strasse' when 1 then 'οδοσ' else 'film' end as host_key from supplier",
    "xccdf_scans": f"with {_SCANS} select * exclude (nation) from scans",
    "xccdf_rule_results": f"with {_SCANS} select file_ord, row_ord, rule_id, status from results",
    "benchmark_rules": f"with {_MARKS} select nation * 1000000 as bm_ord, row_ord, rule_id, vuln_id, severity, check_text, fix_text, benchmark_id, title from rules join marks using (nation)",
    "bundle_benchmarks": f"""with {_MARKS} select n_regionkey * 1000000 + row_number() over (partition by n_regionkey order by nation % 2, nation) - 1 as bm_ord, benchmark_id, title, (select nullif(count(*), 0) from rules r where r.nation = m.nation)::bigint as n_rules
from marks m""",
    "cklb_findings": f"with {_LINES}, {_CKLB} select * from cklb",
    "nessus_findings": f"with {_LINES}, {_NESSUS} select * from nessus",
    "odd_files": """select s_suppkey || ['.xml', '.xml', '.XML', '.xml', '.xml', '.xml', '.cklb', '.CKLB', '.nessus', '.nessus'][s_suppkey % 10 + 1] as source_file, case when s_suppkey % 10 in (0, 3, 6, 9) then 'failed' else 'parsed' end as outcome,
  case when s_suppkey % 10 in (1, 2, 5) then 1 else 0 end::bigint as n_rows, case s_suppkey % 10 when 1 then s_suppkey::text when 2 then s_suppkey::text when 4 then s_suppkey::text when 5 then '<!ENTITY' else '' end as hostname from supplier""",
    "scan_findings": f"{_SET} select * from findings",
    "scan_coverage": f"{_SET} select hostname as server, coalesce(title, '') as stig_title from scans s left join marks m on m.nation = s.nation where n_rules > 0 union select server, stig_title from own",
    "scan_warnings": f"""{_SET}, lacking as (select *, row_number() over (partition by file_ord order by row_ord) as k from found where status is not null and nation is not null and not matched)
select file_ord, 0::bigint as row_ord, source_file || ' names a benchmark that isn''t there (href ''' || benchmark_href || ''', id ''' || benchmark_id || '''), so its rules have no texts' as message, 'log' as level from scans where nation is null
union all select file_ord, 1::bigint, source_file || ': ' || count(*) || ' rules have no texts, as benchmark xccdf_bench_' || nation || ' lacks them: ' || string_agg(rule_id, ', ' order by row_ord) filter (where k <= 5) || case when count(*) > 5 then '...' else '' end, 'log'
from lacking group by file_ord, source_file, nation""",
    "scan_totals": f"""{_SET} select (select count(*) from supplier) * 3 as files, count(distinct server)::bigint as hosts, count(*)::bigint as findings, count_if(severity = 'CAT I')::bigint as cat1, count_if(severity = 'CAT II')::bigint as cat2, count_if(severity = 'CAT III')::bigint as cat3,
  ((select count(*) from results) + (select count(*) from own))::bigint as total_rules from findings""",
    "resolved_folders": "select distinct n_regionkey::bigint as n_regionkey, n_nationkey::bigint as n_nationkey from nation",
    "findings_json": f"with {_FOUND} select {_FIELDS}, count(*)::bigint as n from findings group by all",
    "findings_parquet": f"with {_FOUND} select {_FIELDS}, count(*)::bigint as n from findings group by all",
    "report_workbook": f"with {_FOUND} select o + 1 as row, stig_title, vuln_id, rule_id, severity, status, server, ip_address, check_text, fix_text from (select * exclude (o), row_number() over (order by o) as o from findings)",
    "delta_workbook": f"with {_DELTA} select row_number() over (order by host_key, vuln_id, rule_id, delta_status, run, o) + 1 as row, delta_status, stig_title, vuln_id, rule_id, severity, baseline_status, current_status, server, ip_address, check_text, fix_text from delta",
    "delta_coverage_listing": f"""with raw as ({_RAW}), {_COVERED} select b as server, null::text as stig_title from sides where b is not null and c is not null
union all select server, coalesce(nullif(trim(stig_title), ''), '(untitled)') from ({_GAPS["baseline"]}) union all select server, coalesce(nullif(trim(stig_title), ''), '(untitled)') from ({_GAPS["current"]})""",
    "report_summary_formulas": f"""with {_FOUND}, mine as (select * from findings where run = 'current'), cats as (select unnest(['CAT I', 'CAT II', 'CAT III']) as cat),
told as (select 'COUNTIFS(Findings!$D:$D,"' || cat || '",Findings!$E:$E,"' || status || '")' as text from cats, (select unnest(['Open', 'Not Reviewed', 'Error', 'Unknown']) as status)
  union all select 'COUNTIFS(Findings!$F:$F,"' || server || '",Findings!$D:$D,"' || cat || '")' from cats, (select distinct server, ip_address from mine)
  union all select 'COUNTIFS(Findings!$A:$A,"' || stig_title || '",Findings!$D:$D,"' || cat || '")' from cats, (select distinct stig_title from mine where stig_title <> ''))
select text, count(*)::bigint as n from told group by text""",
    "column_widths": f"with {_FOUND} select {_WIDTHS} from findings",
    "job_transitions": """with named as (select *, ['cancelled', 'complete', 'error', 'pending', 'queued', 'running'][event_id % 6 + 1] as status from events),
moves as (select lag(status) over (partition by user_id order by ts, event_id) as previous, status from named)
select previous, status, previous is null or (previous = 'pending' and status in ('queued', 'cancelled')) or (previous = 'queued' and status in ('running', 'error', 'cancelled')) or (previous = 'running' and status in ('complete', 'error', 'cancelled')) as legal,
  count(*)::bigint as n from moves group by all""",
    "report_findings": f"""with raw as ({_RAW}), {_LOOKUP},
results as (select *, {_STATUS} as status from raw)
select run, server, stig_title, status, l_partkey as rule_id, ip_address, l_orderkey, l_linenumber, coalesce(u.vuln_id, '') as vuln_id, coalesce(u.severity, '') as severity,
  coalesce(u.check_text, '') as check_text, coalesce(u.fix_text, '') as fix_text, u.rule_id is not null as matched
from results r left join rules u on u.rule_id = r.l_partkey where status is not null""",
    "status_map": f"""with raw as ({_RAW})
select raw_status, {_STATUS} as xccdf, {_cklb("raw_status")} as cklb, {_nessus("raw_status || 'ed'")} as nessus, count(*)::bigint as n from raw group by raw_status
union all select raw_status, {_STATUS}, {_cklb("raw_status")}, {_nessus("raw_status")}, 0::bigint from (select distinct ' ' || lower(o_orderpriority) || '  ' as raw_status from orders)""",
    "severity_map": f"select p_partkey, {_severity(_RAW_SEVERITY)} as severity, case p_size % 3 when 0 then 'CAT I' when 1 then 'CAT II' else 'Unknown' end as category from part",
    "severity_override": f"select p_partkey, case when p_size % 5 = 0 then 'CAT III' else {_severity(_RAW_SEVERITY)} end as severity from part",
    "actionable_filter": f"""with raw as ({_RAW}), mapped as (select *, {_cklb("case raw_status when 'pass' then 'not_a_finding' when 'fail' then 'open' else raw_status end")} as status from raw)
select run, server, rule_id, status, l_orderkey, l_linenumber from mapped where status in ('Open', 'Not Reviewed', 'Error', 'Unknown')""",
    "rule_lookup_left": f"""with {_LOOKUP}
select u.rule_id is not null as matched, coalesce(severity, '') as severity, count(*)::bigint as n, count(distinct l_partkey)::bigint as rules from lineitem left join rules u on u.rule_id = l_partkey group by all""",
    "benchmark_cascade": r"""with refs as (
  select s_suppkey, case s_suppkey % 5 when 0 then './path/NATION_' || s_nationkey || '.xml' when 1 then 'a/b/xx_nation_' || s_nationkey || '_v1.xml/' when 3 then 'dir/none.xml' else '' end as href,
    case s_suppkey % 5 when 2 then 'nation_' || s_nationkey when 3 then 'xccdf_nation_' || s_nationkey || '_benchmark' else '' end as bid from supplier),
stems as (select *, lower(regexp_replace(regexp_extract(href, '([^/]+)/*$', 1), '^(.+)\.[^.]+$', '\1')) as stem from refs),
steps as (
  select s_suppkey, n_nationkey, n_name, case when bid <> '' and bid = id then 1 when stem <> '' and (contains(id, stem) or contains(stem, id)) then 2 when bid <> '' and (contains(id, bid) or contains(bid, id)) then 3 end as step
  from stems, (select *, lower('NATION_' || n_nationkey) as id from nation)),
best as (select s_suppkey, arg_min(row(n_nationkey, n_name), row(step, n_nationkey)) as hit from steps where step is not null group by s_suppkey)
select s.s_suppkey, coalesce(hit[1], -1)::bigint as bm_ord, coalesce(hit[2], '') as title from supplier s left join best using (s_suppkey)""",
    "benchmark_last_wins": "select o_custkey as rule_id, arg_max(o_orderpriority, o_orderkey) as vuln_id, arg_max(o_orderstatus, o_orderkey) as severity from orders group by o_custkey",
    "stig_keys": f"""with titles as (select p_partkey, case p_partkey % 8 when 0 then p_type || '  Security Technical Implementation Guide V' || p_size || 'R' || p_size when 1 then p_brand || '_STIG.audit'
  when 2 then 'Unknown  STIG' when 3 then 'STIG Manual' when 4 then ' ' when 5 then 'DISA ' || upper(p_type) || ' Benchmark' when 6 then 'Nessus Compliance' else p_name || ' - SCAP (v' || p_size || 'r1)' end as title from part)
select p_partkey, {_title("title")} as stig_key from titles""",
    "rule_stems": "select p_partkey, case when p_partkey % 3 = 2 then 'cis_' || p_partkey else 'SV-' || p_partkey end as stem from part",
    "coverage_pairs": f"with raw as ({_RAW}) select distinct server, stig_title, run from raw",
    "coverage_hosts": f"with raw as ({_RAW}), {_COVERED} select host_key, coalesce(b, c) as server, case when c is null then 'baseline' when b is null then 'current' else 'common' end as side from sides",
    "coverage_spelling": f"with raw as ({_RAW}), {_COVERED} select host_key, stig_key, min(row(server, stig_title))[1] as server, min(row(server, stig_title))[2] as stig_title from covered group by host_key, stig_key",
    "not_rescanned_pairs": f"with raw as ({_RAW}), {_COVERED} {_GAPS['baseline']}",
    "newly_scanned_pairs": f"with raw as ({_RAW}), {_COVERED} {_GAPS['current']}",
    "pair_list_capped": f"with raw as ({_RAW}), {_COVERED} " + _LIST.format(gap=_GAPS["baseline"]),
    "dedupe_first": f"with {_FOUND} select run, host_key, finding_key, l_orderkey, l_linenumber, rule_id, status from findings qualify row_number() over (partition by run, host_key, finding_key order by o) = 1",
    "duplicate_warnings": f"""with {_FOUND}, numbered as (select *, row_number() over (partition by run, host_key, vuln_key order by o) as copy_no from findings where vuln_key is not null)
select run || ' run: ' || server || ' has ' || coalesce(nullif(vuln_id, ''), rule_id) || ' more than once, the first counts' as message, count(*)::bigint as n from numbered where copy_no > 1 group by 1""",
    "merged_warnings": f"""with raw as ({_RAW}),
told as (select run, 'part ' || l_partkey || case raw_status when 'fail' then '' else ' line ' || l_orderkey end as message, l_orderkey, l_linenumber, row_number() over (partition by run order by {_ORDER}) as k from raw where raw_status in ('fail', 'error')),
shared as (select message, min(k) filter (where run = 'baseline') as k from told group by message having count(distinct run) = 2)
select 0::int as side, l_orderkey, l_linenumber, 'both sets: ' || message as message from told join shared using (message, k) where run = 'baseline'
union all select case run when 'baseline' then 1 else 2 end, l_orderkey, l_linenumber, run || ' set: ' || message from told where message not in (select message from shared)""",
    "delta_findings": f"with {_DELTA} select server, stig_title, vuln_id, rule_id, severity, ip_address, check_text, fix_text, delta_status, baseline_status, current_status, case run when 'baseline' then 'b' else 'c' end as run, l_orderkey, l_linenumber from delta",
    "delta_counts": f"with {_DELTA} select delta_status, count(*)::bigint as n from delta group by delta_status",
    "delta_summary": f"""with {_DELTA}, spine as (select * from (values (0, 'New'), (1, 'Resolved'), (2, 'Persisting'), (3, 'Not re-scanned'), (4, 'Newly scanned')) s(ord, delta_status)),
counts as (select delta_status, {_CATS}, count(*)::bigint as total from delta group by delta_status)
select ord::bigint as ord, delta_status, coalesce(cat_i, 0) as cat_i, coalesce(cat_ii, 0) as cat_ii, coalesce(cat_iii, 0) as cat_iii, coalesce(total, 0) as total from spine left join counts using (delta_status)""",
    "summary_by_severity": f"""with {_FOUND}, spine as (select * from (values (0, 'CAT I'), (1, 'CAT II'), (2, 'CAT III')) s(ord, severity))
select s.ord::bigint as ord, s.severity, count_if(status = 'Open')::bigint as open, count_if(status = 'Not Reviewed')::bigint as not_reviewed, count_if(status = 'Error')::bigint as error, count_if(status = 'Unknown')::bigint as unknown, count(status)::bigint as total
from spine s left join findings f on f.severity = s.severity group by all""",
    "summary_by_server": f"""with {_FOUND}, sums as (select server, {_CATS} from findings group by server), firsts as (select server, ip_address, arg_min(l_orderkey, o) as first from findings group by all)
select server, ip_address, first, cat_i, cat_ii, cat_iii, (cat_i + cat_ii + cat_iii)::bigint as total from firsts join sums using (server)""",
    "summary_by_stig": f"with {_FOUND} select stig_title, arg_min(l_orderkey, o) as first, {_CATS}, count_if(severity like 'CAT%')::bigint as total from findings where stig_title <> '' group by stig_title",
    "countifs_counts": rf"""with {_FOUND},
named as (select case l_suppkey % 11 when 0 then 'Web' || k when 1 then 'web' || k when 2 then 'we?' || k when 3 then 'w*' || k || '*' when 4 then '~*web' || k || '?' when 5 then '>web' || k when 6 then '=Web' || k
    when 7 then '<>web' || k when 8 then 'web~' || k || 'x' when 9 then '<' || k else '[w]eb.' || k || '+' end as server, severity from (select *, l_suppkey % 4 as k from findings)),
exact as (select server, severity, count(*)::bigint as exact from named group by all),
cells as (select case when left(server, 1) in ('=', '+', '-', '@', '|') then chr(39) || server else server end as cell, severity, count(*) as n from named group by all),
wanted as (select server, regexp_extract(server, '^(<>|<=|>=|=|<|>)', 1) as op, lower(regexp_replace(server, '^(<>|<=|>=|=|<|>)', '')) as rest from (select distinct server from named)),
held as (select *, regexp_replace(rest, '~([*?~])', chr(1) || '\1', 'g') as h from wanted),
quoted as (select *, regexp_replace(replace(replace(replace(h, chr(1) || '*', chr(2)), chr(1) || '?', chr(3)), chr(1) || '~', chr(4)), '([\\.^$|()\[\]{{}}+])', '\\\1', 'g') as q from held),
patterns as (select *, '^' || replace(replace(replace(replace(replace(q, '*', '.*'), '?', '.'), chr(2), '\*'), chr(3), '\?'), chr(4), '~') || '$' as pat from quoted),
fits as (select p.server, c.severity, c.n from patterns p, cells c where case
    when op in ('', '=') then regexp_matches(lower(cell), pat) when op = '<>' then not regexp_matches(lower(cell), pat) when regexp_matches(rest, '^[0-9]+$') then false
    when op = '<' then lower(cell) < rest when op = '>' then lower(cell) > rest when op = '<=' then lower(cell) <= rest else lower(cell) >= rest end),
counted as (select server, severity, sum(n)::bigint as counted from fits group by all)
select server, severity, coalesce(counted, 0)::bigint as counted, coalesce(exact, 0)::bigint as exact from counted full join exact using (server, severity)""",
    "run_summary": f"with {_FOUND} select 2::bigint as files, count(distinct nullif(server, ''))::bigint as hosts, count(*)::bigint as findings, count_if(severity = 'CAT I')::bigint as cat1, count_if(severity = 'CAT II')::bigint as cat2, count_if(severity = 'CAT III')::bigint as cat3 from findings",
    "blank_vuln_rate": f"with {_FOUND} select avg(case when vuln_id = '' then 1.0::double else 0.0::double end) as rate from findings",
    "reference_tokens": f"""with refs as (select p_partkey, 'CAT|' || case when p_size % 2 = 0 then 'II' else 'I' end || ',CCI|CCI-' || p_size || ', CCI |second,Rule-ID|SV-' || p_size || 'r1_rule,STIG-ID| x' || p_size || ' |y,CAT|III' as ref from part)
select p_partkey, {_token("CAT")} as cat, {_token("CCI")} as cci, {_token("Rule-ID")} as rule_id, {_token("STIG-ID")} as stig_id, {_token("Vuln-ID")} as vuln_id from refs""",
    "cell_sanitise": "select p_partkey, case p_partkey % 9 when 0 then '''=' when 1 then '''+' when 2 then '''-' when 3 then '''@' when 4 then '''|' when 5 then '''' || chr(9) when 6 then '''' || chr(13) when 7 then 'x' else '' end || p_name as cell from part",
    "formula_quote": "select p_partkey, '\"a\"\"' || replace(p_name, '\"', '\"\"') || '\"\"\"\"\"' as quoted from part",
    "upload_checks": "select s_suppkey, s_suppkey % 6 in (0, 3) and s_suppkey * 10000000 <= 200 * 1024 * 1024 as accepted from supplier",
    "zero_rule_scans": "select p_partkey as file_ord, p_name as source_file from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)",
    "rate_limited_events": """with recursive limits as (select * from (values (10, 60), (2, 3600)) l(most, seconds)),
hits as (select event_id, case when event_id % 3 = 0 then 0 else user_id % 40 + 1 end::bigint as client, epoch_us(ts) // 30000000 * 30 as sec from events),
ordered as (select *, row_number() over (partition by client, most, seconds order by sec, event_id) as k from hits, limits),
walk as (
  select event_id, client, most, seconds, k, true as accepted, [sec] as held from ordered where k = 1
  union all
  select o.event_id, o.client, o.most, o.seconds, o.k, len(list_filter(w.held, lambda t: o.sec - t < o.seconds)) < o.most,
    case when len(list_filter(w.held, lambda t: o.sec - t < o.seconds)) < o.most then list_append(list_filter(w.held, lambda t: o.sec - t < o.seconds), o.sec) else w.held end
  from walk w join ordered o on o.client = w.client and o.most = w.most and o.seconds = w.seconds and o.k = w.k + 1)
select event_id, client, most::int as most, seconds::int as seconds, accepted from walk""",
    "expired_events": """select event_id, ts, status from (select *, ['cancelled', 'complete', 'error', 'pending', 'queued', 'running', null][event_id % 7 + 1] as status from events)
where ts < (select max(ts) from events) - interval 8 hours and (status is null or status in ('complete', 'error', 'cancelled'))""",
    "swept_jobs": """with named as (select *, ['cancelled', 'complete', 'error', 'pending', 'queued', 'running'][event_id % 6 + 1] as status, (select max(ts) from events) as last from events),
listed as (select * from named where user_id % 4 > 0 or ts < last - interval 20 days)
select 'u' || user_id as job, count(*)::bigint as files, max(ts) as modified from listed group by user_id
having max(ts) < any_value(last) - interval 8 hours and (user_id % 5 = 0 or arg_max(status, row(ts, event_id)) in ('complete', 'error', 'cancelled'))""",
}
for _n in ("1", "2"):
    _select = ", ".join(f"{p}.{c} as {p}_{c}" for p in "bc" for c in ("l_orderkey", "l_linenumber", "rule_id"))
    SQL[f"delta_pass{_n}"] = f"with {_DELTA} select {_select}, b.status as b_status, c.status as c_status from p{_n} join findings b on b.o = bo join findings c on c.o = co"

_PHASES = " union all ".join(
    f"select {k} as phase, {_copy(label)} as message from {rows}"
    for k, (rows, label) in enumerate((
        ("outside where copy_no > 1 and run = 'baseline'", "baseline"), ("outside where copy_no > 1 and run = 'current'", "current"), ("p1_b where copy_no > 1", "baseline"), ("p1_c where copy_no > 1", "current"),
        ("p2_b where copy_no > 1", "baseline"), ("p2_c where copy_no > 1", "current"),
    ))
)
_NOT, _NEW = (_LIST.format(gap=_GAPS[s]) for s in ("baseline", "current"))
_BLANK = """untitled as (
  select host_key, server, 1 as rank from covered where stig_key = '' and run = 'baseline' union all select host_key, server, 2 from covered where stig_key = '' and run = 'current'
  union all select host_key, server, 3 from findings where stig_key = '' and run = 'baseline' union all select host_key, server, 4 from findings where stig_key = '' and run = 'current'),
blank as (select host_key, coalesce(any_value(b), any_value(c), arg_min(u.server, row(rank, u.server))) as name from untitled u left join sides using (host_key) group by host_key)"""
SQL["untitled_hosts"] = f"with {_DELTA}, {_BLANK} select host_key, name as server from blank"
SQL["delta_warnings"] = f"""with {_DELTA},
rates as (select avg(case when vuln_id = '' then 1.0 else 0.0 end) filter (where run = 'baseline') as b, avg(case when vuln_id = '' then 1.0 else 0.0 end) filter (where run = 'current') as c from (from b_in union all from c_in)),
{_BLANK},
told as ({_PHASES}
  union all select 6, '{_UNEVEN}' || round_even(b * 100, 0)::int || '%, ' || round_even(c * 100, 0)::int || '%'
  from rates where b <> c and exists (select 1 from delta where delta_status in ('New', 'Resolved'))
  union all select 8, n || '{_NOT_RESCANNED}' || text from ({_NOT}) where n > 0
  union all select 9, n || '{_NEWLY_SCANNED}' || text from ({_NEW}) where n > 0
  union all select 10, count(*) || '{_UNTITLED}' || string_agg(name, ', ' order by host_key, name) from blank having count(*) > 0)
select phase::int as phase, message, count(*)::bigint as n from told group by all"""
