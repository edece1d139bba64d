"""Columns computed from one event. All are built-in expressions and stay in code generation."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlake.functions import constants as C


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def starts_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([F.startswith(text, F.lit(p)) for p in prefixes])


def mapped(code: Column, values: dict[int, str], default: str) -> Column:
    out = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), values.items(), F)
    return out.otherwise(default)


def rtype(sc: Column) -> Column:
    """Resource type of an event class; unknown codes are UNK."""
    return mapped(sc, C.RTYPES, "UNK")


def syscall_label(sc: Column) -> Column:
    return mapped(sc, C.LABELS, "syscall")


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def ipv4_number(host: Column) -> Column:
    """The address as a number, null unless it is dotted decimal without leading zeros."""
    part = lambda i: F.split(host, r"\.")[i].cast("long")
    return F.when(host.rlike(IPV4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def is_external_routable(resource: Column) -> Column:
    """Whether a resource is a routable IPv4 address (with any port but 53); host names aren't."""
    last = F.substring_index(resource, "→", -1)
    host = F.substring_index(last, ":", 1)
    dns = F.contains(last, F.lit(":")) & (F.substring_index(last, ":", -1) == "53")
    number = ipv4_number(host)
    spans = [(int(n.network_address), int(n.broadcast_address)) for n in (ipaddress.ip_network(f"{a}/{k}") for a, k in C.RESERVED_RANGES)]
    # the number is bound once: each range would take the text apart again
    routable = F.transform(F.array(number), lambda n: n.isNotNull() & ~any_of([n.between(a, b) for a, b in spans]))[0]
    return F.coalesce(~dns & routable, F.lit(False))


def is_sensitive(resource: Column) -> Column:
    return starts_any(resource, C.SENSITIVE_PREFIXES)


def is_hard_trigger(resource: Column, sc: Column | None = None) -> Column:
    """Resources that always matter; with ``sc`` every process rename counts as well."""
    found = contains_any(resource, C.HARD_TRIGGERS)
    return found if sc is None else found | (sc == C.PRCTL)


def semantic(sc: Column, resource: Column) -> Column:
    """STRUCT(label, ttps, risk, benign) of the first rule that fits."""
    low = F.lower(resource)

    def made(label: Column, ttps: tuple[str, ...], risk: str, benign: bool) -> Column:
        return F.struct(label.alias("label"), F.array(*map(F.lit, ttps)).cast("array<string>").alias("ttps"), F.lit(risk).alias("risk"), F.lit(benign).alias("benign"))

    out = F
    for parts, classes, label, ttps, risk, benign in C.SEMANTIC_RULES:
        fits = sc.isin(*classes)
        out = out.when(fits & contains_any(low, parts) if parts else fits, made(F.lit(label), ttps, risk, benign))
    shown = F.when(resource == "", F.lit("unknown resource")).otherwise(F.substring(resource, 1, 40))
    return out.otherwise(made(F.concat(syscall_label(sc), F.lit(" on "), shown), (), "LOW", False))


def semantic_compact(meaning: Column) -> Column:
    """One line of a semantic struct: label [techniques/risk]."""
    ttps = F.when(F.size(meaning["ttps"]) > 0, F.array_join(meaning["ttps"], ",")).otherwise("BENIGN")
    return F.concat(meaning["label"], F.lit(" ["), ttps, F.lit("/"), meaning["risk"], F.lit("]"))


def semantic_hint(sc: Column, resource: Column) -> Column:
    """The compact line where it says something (techniques, or a high risk), else empty: one CASE over literals."""
    low = F.lower(resource)
    out = F
    for parts, classes, label, ttps, risk, _ in C.SEMANTIC_RULES:
        fits = sc.isin(*classes)
        line = f"{label} [{','.join(ttps)}/{risk}]" if ttps or risk in ("HIGH", "CRITICAL") else ""
        out = out.when(fits & contains_any(low, parts) if parts else fits, line)
    return out.otherwise("")


def resource_category(sc: Column, resource: Column) -> Column:
    """0 read, 1 write, 2 network, 3 exec, 4 memory, 5 sensitive, 6 temporary path, 7 other."""
    return (
        F.when(sc.isin(C.NET_CON, C.NET_LIS), 2)
        .when(sc == C.EXEC, 3)
        .when(sc.isin(C.MMAP, C.PTRACE), 4)
        .when(contains_any(resource, ("/etc/shadow", "/etc/passwd", "/.ssh/", "/proc/self")), 5)
        .when(contains_any(resource, ("/tmp/", "/dev/shm/")), 6)
        .when(sc == C.FILE_R, 0)
        .when(sc == C.FILE_W, 1)
        .otherwise(7)
    )


def ip_region(ip: Column, text_base: int, size: int, load_addr: int = 0) -> Column:
    return (
        F.when(ip == 0, "UNKNOWN")
        .when((F.lit(text_base) != 0) & (ip - load_addr >= text_base) & (ip - load_addr < text_base + size), "TEXT")
        .when(ip.between(0x0060_0000_0000_0000, 0x007F_FFFF_FFFF_FFFF), "HEAP_MMAP")
        .otherwise("UNKNOWN")
    )


# predicates of the temporal rules


def execve(prefix: str) -> Column:
    return (F.col("sc_type") == C.EXEC) & F.startswith("resource", F.lit(prefix))


def file_read(prefix: str) -> Column:
    return (F.col("sc_type") == C.FILE_R) & F.startswith("resource", F.lit(prefix))


def file_write(prefix: str) -> Column:
    return (F.col("sc_type") == C.FILE_W) & F.startswith("resource", F.lit(prefix))


def comm_is(name: str) -> Column:
    return F.col("comm") == name


def comm_matches(pattern: str) -> Column:
    """A regular expression that matches from the start of the name."""
    return F.col("comm").rlike(rf"\A(?:{pattern})")


def connects() -> Column:
    return F.col("sc_type") == C.NET_CON


def setuid_to_root() -> Column:
    return (F.col("sc_type") == C.SETUID) & (F.contains("resource", F.lit("uid=0")) | F.contains("resource", F.lit("->0")))


def prctl_rename() -> Column:
    return (F.col("sc_type") == C.PRCTL) | ((F.col("sc_type") == C.OTHER) & F.contains("resource", F.lit("PR_SET_NAME")))


def suspicious_shadow_read() -> Column:
    return file_read("/etc/shadow") & ~F.col("comm").isin(*C.PAM_COMMS)


def workload_type(scenario: Column) -> Column:
    """attack, extended_server, the kind of a benign scenario, or unknown."""
    return (
        F.when(F.startswith(scenario, F.lit("attack_")), "attack")
        .when(F.startswith(scenario, F.lit("benign_ext_")), "extended_server")
        .when(F.startswith(scenario, F.lit("benign_")), F.split(scenario, "_")[1])
        .otherwise("unknown")
    )


def attack_family(scenario: Column) -> Column:
    """The technique in an attack's name; other names stay as they are."""
    found = F.regexp_extract(scenario, r"^attack_(T\d+)", 1)
    return F.when(found != "", found).otherwise(scenario)


def entropy(counts: list[Column], total: Column) -> Column:
    """Shannon bits of counts, in their order; zero counts and an empty total give zero."""
    part = lambda c: F.when((c > 0) & (total > 0), -(c / total) * F.log(2.0, c / total)).otherwise(0.0)
    return reduce(lambda a, b: a + b, [part(c) for c in counts]) + F.lit(0.0)
