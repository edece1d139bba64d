"""Provenance graphs of windows as node and edge tables.

A node is a process name with a resource type; every two events in a row give an edge, labelled by the
second one's call; edges of equal ends and label merge. Windows are rows with pid, wid, idx (see windows).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.functions import constants as C
from hostlake.functions.events import entropy, is_external_routable, is_sensitive, rtype, semantic, semantic_hint, syscall_label

KEY = ["pid", "wid"]


def nodes(windows: DataFrame) -> DataFrame:
    """``pid``, ``wid``, ``node`` (n0, n1, ... by first appearance), ``comm``, ``rtype``, ``first_idx``."""
    seen = windows.groupBy(*KEY, "comm", rtype(F.col("sc_type")).alias("rtype")).agg(F.min("idx").alias("first_idx"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("first_idx")) - 1
    return seen.withColumn("node", F.concat(F.lit("n"), rank))


def edges(windows: DataFrame) -> DataFrame:
    """Merged edges: ends (comm and resource type), ``label``, ``count``, ``min_dt``, ``max_dt`` (ms, 2 places), ``first_idx`` and,
    from the first occurrence, ``resource`` (64 characters), ``sensitive``, ``semantic``; plus ``external`` and ``ord``, the place in the graph's own
    iteration order (first appearance of the source, then of the pair, then of the edge)."""
    order = Window.partitionBy(*KEY).orderBy("idx")
    kind = windows.withColumn("rtype", rtype(F.col("sc_type")))
    first_of_node = F.min("idx").over(Window.partitionBy(*KEY, "comm", "rtype"))
    paired = kind.withColumn("node_idx", first_of_node).select(
        *KEY, "idx", "sc_type", "resource", F.col("comm").alias("dst_comm"), F.col("rtype").alias("dst_rtype"),
        F.lag("comm").over(order).alias("src_comm"), F.lag("rtype").over(order).alias("src_rtype"), F.lag("node_idx").over(order).alias("src_idx"),
        (F.floor((F.col("ts_us") - F.lag("ts_us").over(order) + 5) / 10) / 100.0).alias("dt"),
    ).where(F.col("idx") > 0)
    labelled = paired.withColumn("label", syscall_label(F.col("sc_type")))
    merged = labelled.groupBy(*KEY, "src_comm", "src_rtype", "dst_comm", "dst_rtype", "label").agg(
        F.count("*").alias("count"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.min("idx").alias("first_idx"),
        F.min("src_idx").alias("src_idx"), F.min_by(F.struct("sc_type", "resource"), "idx").alias("first"),
    )
    pair_idx = F.min("first_idx").over(Window.partitionBy(*KEY, "src_comm", "src_rtype", "dst_comm", "dst_rtype"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("src_idx", "pair_idx", "first_idx"))
    resource = F.substring(F.col("first.resource"), 1, 64)
    return (
        merged.withColumn("pair_idx", pair_idx)
        .withColumn("ord", rank)
        .withColumn("resource", resource)
        .withColumn("sensitive", is_sensitive(F.col("first.resource")))
        .withColumn("semantic", semantic_hint(F.col("first.sc_type"), F.col("first.resource")))
        .withColumn("external", (F.col("label") == "connect") & is_external_routable(F.col("resource")))
        .drop("first")
    )


def meta(windows: DataFrame) -> DataFrame:
    """One row per window with the graph's eight figures."""
    return _figures(windows).drop("odd")


#: Bits of what an event's call tells of an edge that it ends, and of its process as the source of the next.
EXTERNAL, SENSITIVE, STAGED, CONNECT, EXECVE, SUSPECT, UNUSUAL = (1 << i for i in range(7))


def _figures(windows: DataFrame) -> DataFrame:
    """:func:`meta` and ``odd``: an external connection of a server or of a process that isn't a known daemon.

    A window is gathered once, as the arrays of its nodes, labels and bits in order, and its figures are read off them: an edge counts where it
    occurs first, and its place in the graph's iteration order is that of its source, then of the pair, then its own.
    """
    label, comm = syscall_label(F.col("sc_type")), F.lower("comm")
    shown = F.substring("resource", 1, 64)
    marks = {
        EXTERNAL: (label == "connect") & is_external_routable(shown), SENSITIVE: (label == "openat(R)") & is_sensitive(F.col("resource")),
        STAGED: (label == "execve") & F.coalesce(_starts(shown), F.lit(False)), CONNECT: label == "connect", EXECVE: label == "execve",
        SUSPECT: comm.isin(*C.SERVERS) | ~comm.isin(*C.DAEMONS), UNUSUAL: ~comm.isin(*C.DAEMONS),
    }
    bits = reduce(lambda a, b: a + b, [F.when(c, bit).otherwise(0) for bit, c in marks.items()])
    node = F.concat("comm", F.lit("\x00"), rtype(F.col("sc_type")))
    whole = windows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", node.alias("node"), label.alias("label"), bits.alias("bits")))).alias("e")).where(F.size("e") > 1)
    tail = lambda c: F.slice(c, 2, 1 << 30)
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(y.isNotNull(), F.concat(x, F.lit("\x01"), y)))
    has = lambda c, bit: c.bitwiseAND(F.lit(bit)) > 0

    def merged(v: Column) -> Column:
        """Edges where they occur first: bits, those of the event before, and the place in iteration order."""
        node, pair, key, bits = (v[c] for c in ("node", "pair", "key", "bits"))
        wide = F.size(node).cast("long") + 1
        place = lambda j: (F.array_position(node, node[j - 1]) * wide + F.array_position(pair, pair[j - 1])) * wide + j
        first = F.filter(F.sequence(F.lit(1), F.size(node) - 1), lambda j: F.array_position(key, key[j - 1]) == j)
        return F.transform(first, lambda j: F.struct(bits[j].alias("bits"), bits[j - 1].alias("source"), place(j).alias("place")))

    def figures(v: Column, edge: Column) -> Column:
        ends = lambda bit: F.filter(edge, lambda e: has(e["bits"], bit))
        places = lambda bit: F.transform(ends(bit), lambda e: e["place"])
        return F.struct(
            F.size(F.array_distinct(v["node"])).cast("long").alias("n_nodes"), F.exists(v["bits"], lambda b: has(b, UNUSUAL)).alias("unusual_comm"),
            F.size(edge).cast("long").alias("n_edges"), F.size(ends(EXTERNAL)).cast("long").alias("outbound_ext"), F.size(ends(SENSITIVE)).cast("long").alias("sensitive_reads"),
            (F.size(ends(STAGED)) > 0).alias("tmp_exec"), F.coalesce(F.array_min(places(CONNECT)) < F.array_max(places(EXECVE)), F.lit(False)).alias("exec_after_net"),
            F.exists(edge, lambda e: has(e["bits"], EXTERNAL) & has(e["source"], SUSPECT)).alias("odd"),
        )

    # each array is bound to a variable, so that it is computed once however often it is read
    own = F.struct(F.col("e.node").alias("node"), F.col("e.label").alias("label"), F.col("e.bits").alias("bits"))
    paired = _let(own, lambda v: F.struct(v["node"].alias("node"), v["label"].alias("label"), v["bits"].alias("bits"), joined(v["node"], tail(v["node"])).alias("pair")))
    keyed = _let(paired, lambda v: F.struct(v["node"].alias("node"), v["bits"].alias("bits"), v["pair"].alias("pair"), joined(v["pair"], tail(v["label"])).alias("key")))
    found = _let(keyed, lambda v: _let(merged(v), lambda edge: figures(v, edge)))
    return whole.select(*KEY, F.inline(F.array(found))).withColumn("external_connect", F.col("outbound_ext") > 0)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _starts(resource: Column) -> Column:
    return F.startswith(resource, F.lit(C.STAGED_EXEC_PREFIXES[0])) | F.startswith(resource, F.lit(C.STAGED_EXEC_PREFIXES[1])) | F.startswith(resource, F.lit(C.STAGED_EXEC_PREFIXES[2]))


def provenance_score(windows: DataFrame) -> DataFrame:
    """The figures of :func:`meta` with ``score`` (0 to 1)."""
    raw = (
        F.when(F.col("tmp_exec"), 0.75).otherwise(0.0)
        + F.when(F.col("odd"), 0.80).otherwise(0.0)
        + F.least(F.col("sensitive_reads") * 0.20, F.lit(0.45))
        + F.when(F.col("exec_after_net"), 0.30).otherwise(0.0)
        + F.when(F.col("unusual_comm"), 0.15).otherwise(0.0)
    )
    return _figures(windows).withColumn("score", F.round(F.least(raw, F.lit(1.0)), 6)).drop("odd")


def serialized(windows: DataFrame) -> DataFrame:
    """``text``: one description per window, of figures, nodes, edges and processes."""
    graph, points = edges(windows), nodes(windows)
    figures = meta(windows)
    named = lambda side: points.select(*KEY, F.col("comm").alias(f"{side}_comm"), F.col("rtype").alias(f"{side}_rtype"), F.col("node").alias(side))
    lines = graph.join(named("src"), [*KEY, "src_comm", "src_rtype"]).join(named("dst"), [*KEY, "dst_comm", "dst_rtype"])
    one = lambda c: F.format_string("%.1f", F.floor(F.col(c) * 10 + 0.5) / 10.0)
    text = F.concat(
        F.lit("  - {src: "), "src", F.lit(", dst: "), "dst", F.lit(", syscall: "), "label", F.lit(", dt_ms: "), one("min_dt"),
        F.when(F.col("count") > 1, F.concat(F.lit(", n: "), "count", F.lit(", dt_max_ms: "), one("max_dt"))).otherwise(""),
        F.when(F.col("resource") != "", F.concat(F.lit(", res: "), "resource")).otherwise(""),
        F.when(F.col("sensitive"), ", sensitive: true").otherwise(""),
        F.when(F.col("external"), ", anomaly: ext_outbound").otherwise(""),
        F.when(F.col("semantic") != "", F.concat(F.lit(', semantic: "'), "semantic", F.lit('"'))).otherwise(""),
        F.lit("}"),
    )
    joined = lambda rows, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, rows.alias("line")))), lambda x: x["line"]), "\n")
    edge_text = lines.groupBy(*KEY).agg(joined(text, F.col("ord")).alias("edge_text"))
    node_line = F.concat(F.lit("  - {id: "), "node", F.lit(", comm: "), "comm", F.lit(", rtype: "), "rtype", F.lit("}"))
    node_text = points.groupBy(*KEY).agg(joined(node_line, F.col("first_idx")).alias("node_text"), F.array_join(F.array_sort(F.collect_set("comm")), ", ").alias("procs"))
    flag = lambda c: F.when(F.col(c), f", {c}: true").otherwise("")
    number = lambda c: F.when(F.col(c) > 0, F.concat(F.lit(f", {c}: "), c)).otherwise("")
    head = F.concat(
        F.lit("# provenance graph\nmeta: {nodes: "), "n_nodes", F.lit(", edges: "), "n_edges", number("outbound_ext"), flag("exec_after_net"),
        flag("unusual_comm"), number("sensitive_reads"), flag("tmp_exec"), flag("external_connect"), F.lit("}\nnodes:\n"),
    )
    whole = F.concat(head, "node_text", F.lit("\nedges:\n"), "edge_text", F.lit("\nprocs: ["), "procs", F.lit("]"))
    return figures.join(edge_text, KEY).join(node_text, KEY).select(*KEY, whole.alias("text"))


def serialized_arrows(windows: DataFrame) -> DataFrame:
    """The older form: one line per merged edge with its smallest interval."""
    mark = F.when(F.col("sensitive"), " [SENSITIVE]").otherwise("")
    path = F.when(F.col("resource") != "", F.concat(F.lit(" path="), "resource")).otherwise("")
    line = F.concat(F.lit("PROC["), "src_comm", F.lit("/"), "src_rtype", F.lit("] --["), "label", F.lit(", dt="), F.format_string("%.1f", F.floor(F.col("min_dt") * 10 + 0.5) / 10.0), F.lit("ms]--> PROC["), "dst_comm", F.lit("/"), "dst_rtype", F.lit("]"), mark, path)
    return edges(windows).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def tls_edges(windows: DataFrame, tls_events: DataFrame) -> DataFrame:
    """Edges that captured payloads add: from the process's NET node, else from its first node, to ``(comm, LLM)``.

    ``tls_events``: pid, wid, comm, payload. Payloads of processes without a node are dropped.
    """
    at = nodes(windows).groupBy(*KEY, "comm").agg(F.min_by("rtype", F.struct((F.col("rtype") != "NET").alias("o"), "first_idx")).alias("src_rtype"))
    return tls_events.join(at, [*KEY, "comm"]).select(*KEY, F.col("comm").alias("src_comm"), "src_rtype", F.lit("LLM").alias("dst_rtype"), F.lit("tls_read").alias("label"), F.substring("payload", 1, 128).alias("resource"), F.lit(True).alias("sensitive"))


def fingerprints(graph: DataFrame) -> DataFrame:
    """``fingerprint``: SHA-256 over the sorted edge descriptions of each window; equal graphs, equal values."""
    line = F.concat_ws("|", F.concat_ws("/", "src_comm", "src_rtype"), F.concat_ws("/", "dst_comm", "dst_rtype"), "label")
    return graph.groupBy(*KEY).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def structural_entropy(graph: DataFrame) -> DataFrame:
    labels = sorted(set(C.LABELS.values()))
    return graph.groupBy(*KEY).agg((F.round(entropy([F.count_if(F.col("label") == x) for x in labels], F.count("*")), 6) + 0.0).alias("structural_entropy"))


def features(windows: DataFrame) -> DataFrame:
    """The twenty figures that learned scorers use, all doubles."""
    graph = edges(windows)
    under = lambda label, prefix: (F.col("label") == label) & F.startswith("resource", F.lit(prefix))
    counts = {
        "openat_r_tmp": under("openat(R)", "/tmp/"),
        "openat_w_tmp": under("openat(W)", "/tmp/"),
        "openat_r_var_log": under("openat(R)", "/var/log/"),
        "openat_w_var_log": under("openat(W)", "/var/log/"),
        "openat_r_etc_shadow": (F.col("label") == "openat(R)") & (F.col("resource") == "/etc/shadow"),
        "execve_tmp": under("execve", "/tmp/"),
        "execve_var_log": under("execve", "/var/log/"),
        "execve_cache": under("execve", "/home/admin/cache"),
        "ext_outbound_edges": F.col("external"),
    }
    by_edge = graph.groupBy(*KEY).agg(*(F.count_if(c).cast("double").alias(n) for n, c in counts.items()))
    parallel = graph.groupBy(*KEY, "src_comm", "src_rtype", "dst_comm", "dst_rtype").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.max("n").cast("double").alias("max_parallel_edges"))
    by_comm = nodes(windows).groupBy(*KEY, "comm").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*KEY)))
    spread = by_comm.groupBy(*KEY).agg((F.round(F.sum(-(F.col("n") / F.col("total")) * F.log(2.0, F.col("n") / F.col("total"))), 6) + 0.0).alias("comm_entropy"))
    figures = meta(windows).select(*KEY, *(F.col(c).cast("double").alias(c) for c in ("n_nodes", "n_edges", "outbound_ext", "sensitive_reads")), *(F.col(c).cast("int").cast("double").alias(c) for c in ("exec_after_net", "unusual_comm", "tmp_exec", "external_connect")))
    return figures.join(structural_entropy(graph), KEY).join(by_edge, KEY).join(spread, KEY).join(parallel, KEY)


def compression(windows: DataFrame) -> DataFrame:
    """Words of a window's raw events and of its description, and what the latter saves."""
    raw = windows.groupBy(*KEY).agg(F.sum(F.size(F.split(F.trim(F.concat_ws(" ", F.col("ts_us").cast("string"), "comm", syscall_label(F.col("sc_type")), "resource")), r"\s+"))).alias("raw_words"))
    said = serialized(windows).select(*KEY, F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("graph_words"))
    return raw.join(said, KEY).withColumn("saved", F.round(1 - F.col("graph_words") / F.col("raw_words"), 6))


def insights(texts: DataFrame) -> DataFrame:
    """Short findings in a window's description, as an array."""
    has = lambda *parts: F.greatest(*(F.contains("text", F.lit(p)) for p in (*parts, parts[0])))
    found = F.array(
        F.when(has("/etc/shadow", "/etc/passwd", "id_rsa"), "credential access"),
        F.when(has("/tmp/") & has("execve"), "execution from a temporary path"),
        F.when(has("connect") & has("execve"), "network and execution"),
        F.when(has("setuid"), "privilege change"),
        F.when(has("ptrace"), "process inspection"),
    )
    return texts.select(*KEY, F.array_compact(found).alias("insights"))


def window_semantics(windows: DataFrame) -> DataFrame:
    """``max_risk`` of a window and its techniques, each once, in order of appearance."""
    said = windows.select(*KEY, "idx", semantic(F.col("sc_type"), F.col("resource")).alias("s"))
    rank = F.array_position(F.array(*map(F.lit, C.RISKS)), F.col("s.risk"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("s.ttps").alias("ttps")))), lambda x: x["ttps"])
    return said.groupBy(*KEY).agg(F.element_at(F.array(*map(F.lit, C.RISKS)), F.max(rank).cast("int")).alias("max_risk"), F.array_join(F.array_distinct(F.flatten(ordered)), ",").alias("ttps"))


def label_matrix(figures: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the figures' rules hold, by true label."""
    both = figures.join(truth, KEY)
    names = ("tmp_exec", "external_connect", "exec_after_net", "unusual_comm")
    rules = {n: F.col(n) for n in names} | {"sensitive": F.col("sensitive_reads") > 0, "tmp_and_external": F.col("tmp_exec") & F.col("external_connect")}
    wide = both.groupBy("malicious").agg(*(F.count_if(c).alias(n) for n, c in rules.items()), F.count("*").alias("windows"))
    return wide.unpivot(["malicious"], [*rules, "windows"], "rule", "n")
