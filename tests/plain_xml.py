"""Parsers of XML files by whole trees, as plain versions of those that free what they have read."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.parsers import expat

from attesta import schemas
from attesta.sources.formats import NESSUS_NAMESPACES, SCANNER_HINTS, SCC_NAMESPACE, CM, Record, _stem, _warn, tokens
from attesta.sources.xml_tree import Unreadable

XCCDF_12 = "http://checklists.nist.gov/xccdf/1.2"


@dataclass
class Tree:
    root: ET.Element
    namespaces: set[str]


class _Prologue(Exception):
    """Stops a scan at the first element."""


def _declares_entities(data: bytes) -> bool:
    found: list[str] = []

    def begun(*_: object) -> None:
        raise _Prologue

    scan = expat.ParserCreate()
    scan.EntityDeclHandler = lambda name, *_: found.append(name)
    scan.StartElementHandler = begun
    try:
        scan.Parse(data, True)
    except _Prologue:
        pass
    return bool(found)


def _without_entities(data: bytes) -> Tree:
    """A default handler makes expat hand over references instead of expanding them."""
    builder, namespaces = ET.TreeBuilder(), set()
    named = lambda name: f"{{{name}" if "}" in name else name
    parser = expat.ParserCreate(namespace_separator="}")
    parser.DefaultHandler = lambda _: None
    parser.StartElementHandler = lambda name, attributes: builder.start(named(name), {named(k): v for k, v in attributes.items()})
    parser.EndElementHandler = lambda name: builder.end(named(name))
    parser.CharacterDataHandler = builder.data
    parser.StartNamespaceDeclHandler = lambda _, uri: namespaces.add(uri or "")
    parser.Parse(data, True)
    return Tree(builder.close(), namespaces)


def read(data: bytes) -> Tree:
    namespaces: set[str] = set()
    try:
        if _declares_entities(data):
            return _without_entities(data)
        events = ET.iterparse(io.BytesIO(data), events=("start-ns",))
        for _, (_, uri) in events:
            namespaces.add(uri)
        return Tree(events.root, namespaces)
    except (ET.ParseError, expat.ExpatError, ValueError, LookupError) as e:
        raise Unreadable(str(e)) from e


def local(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def children(el: ET.Element, name: str) -> Iterator[ET.Element]:
    """Direct children by local name; those of XCCDF 1.2 alone if there are any."""
    own = el.findall(f"{{{XCCDF_12}}}{name}")
    return iter(own or [c for c in el if local(c) == name])


def text_of(el: ET.Element | None) -> str:
    return (el.text or "").strip() if el is not None else ""


def first_text(el: ET.Element, name: str) -> str:
    """The stripped text of the first XCCDF 1.2 child of that name if it has any, else of the first child by local name that has."""
    named = el.find(f"{{{XCCDF_12}}}{name}")
    if named is not None and named.text:
        return named.text.strip()
    return next((c.text.strip() for c in el if local(c) == name and c.text), "")


def scanner_of(tree: Tree) -> str:
    """The tool that wrote a results file, Unknown if nothing tells."""
    if tree.namespaces & set(NESSUS_NAMESPACES):
        return "Nessus"
    if SCC_NAMESPACE in tree.namespaces:
        return "SCC"
    result = next((e for e in tree.root.iter() if local(e) == "TestResult"), None)
    if result is not None and "scc" in result.get("test-system", "").lower():
        return "SCC"
    tools = ("generator", "product", "scanner-version", "creator")
    said = " ".join(text_of(e) for e in tree.root.iter() if local(e).lower() in tools).lower()
    named = next((name for hint, name in SCANNER_HINTS if hint in said), "")
    return named or ("Evaluate-STIG" if "evaluate-stig" in tree.root.get("id", "").lower() else "Unknown")


def _fact(root: ET.Element, names: tuple[str, ...]) -> str:
    facts: dict[str, str] = {}
    for group in root:
        if local(group) == "target-facts":
            for fact in group:
                if fact.text and isinstance(fact.tag, str):
                    facts.setdefault(fact.get("name", ""), fact.text.strip())
    return next((facts[n] for n in names if n in facts), "")


def xccdf_results(name: str, data: bytes) -> Iterator[Record]:
    """A results file: one scan with its rule results; of several TestResults the last, the state after remediation."""
    try:
        tree = read(data)
    except Unreadable as e:
        yield _warn(f"{name} is left out, its XML can't be read: {e}")
        yield Record("file", 0, 0, ("failed", "0"))
        return
    if local(tree.root) == "CHECKLIST":
        yield _warn(f"{name} is left out: an XML checklist (.ckl) has no scan results; save it in the JSON form (.cklb) to have it read")
        yield Record("file", 0, 0, ("failed", "0"))
        return
    scanner = scanner_of(tree)
    if scanner == "Unknown":
        yield _warn(f"{name}: nothing says which tool wrote it, so the scanner is Unknown")
    root = tree.root
    if local(root) != "TestResult":
        inner = [e for e in root.iter() if local(e) == "TestResult"]
        root = inner[-1] if inner else root
        if len(inner) > 1:
            yield _warn(f"{name}: of {len(inner)} TestResult elements the last counts, the state after remediation")
    host = first_text(root, "target") or _fact(root, schemas.HOST_FACTS) or first_text(root, "title")
    if not host:
        host = _stem(name)
        yield _warn(f"{name} names no host, so it goes by its file name: {host}")
    ip = _fact(root, schemas.IP_FACTS) or first_text(root, "target-address")
    if not ip:
        ip = "N/A"
        yield _warn(f"{name} names no address, so N/A stands for it")
    ref = next(children(root, "benchmark"), None)
    href, ref_id = ("", "") if ref is None else (ref.get("href", ""), ref.get("id", ""))
    rows = 0
    for row, el in enumerate(children(root, "rule-result")):
        rule_id = el.get("idref", "").strip()
        if not rule_id:
            continue
        status = next((c.text.strip() for c in el if local(c) == "result" and c.text), "")
        if not status:
            yield _warn(f"{name}: {rule_id} is left out, it has no result", row)
            continue
        rows += 1
        yield Record("result", 0, row, (rule_id, status))
    if not rows:
        yield _warn(f"{name} has no usable rule-result; is it a results file?")
    yield Record("scan", 0, 0, (host, ip, href, ref_id, scanner, str(rows)))
    yield Record("file", 0, 0, ("parsed", str(rows)))


def benchmark(name: str, data: bytes, member: int = 0) -> Iterator[Record]:
    """A benchmark definition with the rules of its direct groups."""
    try:
        root = read(data).root
    except Unreadable as e:
        yield _warn(f"benchmark {name} is left out, its XML can't be read: {e}")
        yield Record("file", member, 0, ("failed", "0"))
        return
    rows = 0
    for group in (g for g in root if local(g) == "Group"):
        for rule in (r for r in group if local(r) == "Rule"):
            checks = (c for check in rule if local(check) == "check" for c in check.iter() if local(c) == "check-content" and c.text and c.text.strip())
            fixes = (f for f in rule if local(f) == "fixtext" and f.text and f.text.strip())
            yield Record("rule", member, rows, (rule.get("id", ""), group.get("id", "").rpartition("_group_")[2], rule.get("severity", ""), text_of(next(checks, None)), text_of(next(fixes, None))))
            rows += 1
    if not rows:
        yield _warn(f"benchmark {name} defines no rule")
    yield Record("benchmark", member, 0, (root.get("id", ""), first_text(root, "title")))
    yield Record("file", member, 0, ("parsed", str(rows)))


def nessus(name: str, data: bytes) -> Iterator[Record]:
    """Compliance items of an export."""
    try:
        root = read(data).root
    except Unreadable as e:
        yield _warn(f"{name} is left out, its XML can't be read: {e}")
        yield Record("file", 0, 0, ("failed", "0"))
        return
    if local(root) != "NessusClientData_v2":
        yield _warn(f"{name} is left out: an export begins with NessusClientData_v2, this with {local(root)}")
        yield Record("file", 0, 0, ("failed", "0"))
        return
    rows = 0
    for host in root.iter("ReportHost"):
        tags = {t.get("name"): t.text.strip() for t in (host.find("HostProperties") if host.find("HostProperties") is not None else ()) if t.get("name") and t.text}
        named = host.get("name", "").strip()
        server = tags.get("hostname") or tags.get("host-fqdn") or tags.get("netbios-name") or named
        if not server:
            server = _stem(name)
            yield _warn(f"{name}: a host without a name goes by the file name: {server}", rows)
        ip = tags.get("host-ip") or named or "N/A"
        for item in host.iter("ReportItem"):
            if item.get("pluginFamily") != "Policy Compliance":
                continue
            rows += 1
            said = lambda what: (item.findtext(f"{CM}compliance-{what}") or "").strip()  # noqa: B023, E731
            result, refs, actual, info = said("result"), tokens(said("reference")), said("actual-value"), said("info")
            if result.upper() not in schemas.NESSUS_STATUS:
                yield _warn(f"{name}: an item counts as Unknown, no result is called {result or 'nothing'}", rows)
            rule_id = refs.get("Rule-ID") or refs.get("STIG-ID") or said("check-name")
            title = said("benchmark-name") or said("audit-file") or item.get("pluginName", "").strip() or "Nessus Compliance"
            check = "\n\n".join(x for x in (info, f"Scan output: {actual}" if actual else "") if x)
            yield Record("nessus", 0, rows, (title, refs.get("Vuln-ID", ""), rule_id, result, refs.get("CAT", ""), "", server, ip, check, said("solution")))
    if not rows:
        yield _warn(f"{name} has vulnerability items at most; only a scan with a compliance policy gives results to report")
    yield Record("file", 0, 0, ("parsed", str(rows)))
