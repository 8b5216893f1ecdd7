"""Small scan files."""

from __future__ import annotations

import json

CDF = "http://checklists.nist.gov/xccdf/1.2"


def results(host="web01", ip="10.1.1.1", bid="bench_a", href="", rules=(("SV-1r1_rule", "fail"), ("SV-2r1_rule", "pass")), prefix="cdf:", extra=""):
    p = prefix
    ns = f'xmlns:cdf="{CDF}"' if p else f'xmlns="{CDF}"'
    body = "".join(f'<{p}rule-result idref="{r}">' + (f"<{p}result>{s}</{p}result>" if s else "") + f"</{p}rule-result>" for r, s in rules)
    target = f"<{p}target>{host}</{p}target>" if host else ""
    address = f"<{p}target-address>{ip}</{p}target-address>" if ip else ""
    return f'<{p}TestResult {ns} id="t"><{p}benchmark id="{bid}" href="{href}"/>{target}{address}{extra}{body}</{p}TestResult>'


def benchmark(bid="bench_a", title="Server STIG", rules=(("V-1", "SV-1r1_rule", "high"), ("V-2", "SV-2r1_rule", "medium"))):
    body = "".join(f'<Group id="xccdf_group_{v}"><Rule id="{r}" severity="{s}"><fixtext>fix {v}</fixtext><check><check-content>check {v}</check-content></check></Rule></Group>' for v, r, s in rules)
    return f'<Benchmark xmlns="{CDF}" id="{bid}"><title>{title}</title>{body}</Benchmark>'


def cklb(rules, host="app01", title="App STIG"):
    return json.dumps({"target_data": {"host_name": host, "ip_address": "10.2.2.2"}, "stigs": [{"display_name": title, "rules": list(rules)}]})


def nessus(items, host="db01"):
    body = "".join(
        f'<ReportItem pluginFamily="{f}" pluginName="p"><cm:compliance-result>{r}</cm:compliance-result><cm:compliance-check-name>n</cm:compliance-check-name><cm:compliance-info>i</cm:compliance-info>'
        f"<cm:compliance-actual-value>v</cm:compliance-actual-value><cm:compliance-reference>{ref}</cm:compliance-reference></ReportItem>"
        for f, r, ref in items
    )
    return f'<NessusClientData_v2 xmlns:cm="http://www.nessus.org/cm"><Report><ReportHost name="{host}"><HostProperties><tag name="host-ip">10.3.3.3</tag></HostProperties>{body}</ReportHost></Report></NessusClientData_v2>'
