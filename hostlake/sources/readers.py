"""Readers of trace logs, provenance records and labels, and the writers of audit records. Explicit schemas, no inference."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.functions import constants as C
from hostlake.functions.events import mapped
from hostlake.operators.windows import in_whole_order
from hostlake.staging import staged

LINE = r"^\s*\[?(\d+)\]?\s+(\d+):(\d+):(\d+)\.(\d+)\s+(\w+)\s*\((.*)\)\s*=\s*(-?\d+|0x[0-9a-f]+)"


def strace_events(lines: DataFrame, default_comm: str = "unknown") -> DataFrame:
    """Events from call-trace lines (``trace``, ``seq``, ``value``).

    Only ten known calls are kept; failed opens are dropped; times count from the first line of a trace that parses. An execve names
    its process from that line on.
    """
    part = lambda i: F.regexp_extract("value", LINE, i)
    us = ((part(2).cast("long") * 60 + part(3).cast("long")) * 60 + part(4).cast("long")) * 1_000_000 + F.rpad(part(5), 6, "0").cast("long")
    parsed = lines.where(F.col("value").rlike(LINE)).select("trace", "seq", part(1).cast("long").alias("pid"), us.alias("us"), F.lower(part(6)).alias("call"), part(7).alias("args"), part(8).alias("ret"))
    base = parsed.groupBy("trace").agg(F.min_by("us", "seq").alias("base"))
    code = F
    for name, sc in C.STRACE_CALLS.items():
        code = code.when(F.col("call") == name, sc)
    paths = F.regexp_extract_all("args", F.lit(r'"(/[^"]*)"'), F.lit(1))
    opens = F.col("call").isin("open", "openat")
    writes = F.col("args").rlike("O_WRONLY|O_RDWR|O_CREAT")
    address = F.regexp_extract("args", r'inet_addr\("([^"]+)"\)', 1)
    port = F.regexp_extract("args", r"sin_port=htons\((\d+)\)", 1)
    resource = (
        F.when(opens, F.coalesce(F.try_element_at(paths, F.lit(-1)), F.lit("")))
        .when(F.col("call") == "execve", F.coalesce(F.try_element_at(paths, F.lit(1)), F.lit("")))
        .when(F.col("call") == "connect", F.concat(address, F.lit(":"), port))
        .when(F.col("call") == "listen", "0.0.0.0:0")
        .otherwise("")
    )
    known = parsed.where(F.col("call").isin(*C.STRACE_CALLS)).withColumn("sc_type", F.when(opens & writes, C.FILE_W).otherwise(code)).withColumn("resource", resource)
    kept = known.where(~(opens & F.startswith("ret", F.lit("-"))) & ~((F.col("call") == "connect") & (address == "")))
    named = F.when((F.col("call") == "execve") & (F.col("resource") != ""), F.substring(F.substring_index("resource", "/", -1), 1, 15))
    so_far = Window.partitionBy("trace", "pid").orderBy("seq")
    out = kept.withColumn("comm", F.coalesce(F.last(named, True).over(so_far), F.lit(default_comm))).join(F.broadcast(base), "trace")
    return out.select("trace", "seq", "pid", F.greatest(F.col("pid") - 1, F.lit(1)).alias("ppid"), F.lit(0).cast("long").alias("uid"), "comm", F.col("sc_type").cast("int").alias("sc_type"), "resource", (F.col("us") - F.col("base")).alias("ts_us"))


def read_strace(spark: SparkSession, path: str, default_comm: str = "unknown") -> DataFrame:
    """Call-trace logs; a file is a trace. The row index of the scan keeps the order of lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("trace"), F.monotonically_increasing_id().alias("seq"))
    return strace_events(lines, default_comm)


def read_call_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Traces of one call number per line; the folder names say what a trace is (Attack_Data_Master/<type>, else benign)."""
    return call_numbers(spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"), "value"))


def call_numbers(lines: DataFrame) -> DataFrame:
    """Events of lines (``path``, ``seq``, ``value``). pid is 40000 plus the place of the file among all files by path; lines that are no number are skipped.

    ``technique`` is what the attack's type hints at, null for benign traces.
    """
    rows = lines.withColumn("value", F.trim("value")).where(F.col("value").rlike(r"^\d{1,6}$")).withColumn("number", F.col("value").cast("int"))
    code = F
    for n, sc in C.CALL_NUMBERS.items():
        code = code.when(F.col("number") == n, sc)
    kind = F.regexp_extract("path", r"Attack_Data_Master/([^/]+?)(?:_\d+)?/", 1)
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1
    files = in_whole_order(rows.select("path").distinct(), "path").select("path", (F.col("place") + 40000).alias("pid"))
    out = rows.withColumn("sc_type", code.otherwise(C.OTHER)).withColumn("ts_us", place * 1000).withColumn("attack_type", F.when(kind != "", kind)).join(files, "path")
    technique = F
    for name, hint in C.ATTACK_TECHNIQUES.items():
        technique = technique.when(F.lower(F.replace("attack_type", F.lit("_"), F.lit(""))) == name.replace("_", ""), hint)
    return out.withColumn("resource", mapped(F.col("sc_type"), C.CALL_RESOURCES, "[other]")).select("path", "pid", "ts_us", "sc_type", "resource", "attack_type", technique.otherwise(None).alias("technique"), F.when(F.col("attack_type").isNotNull(), "MALICIOUS").otherwise("BENIGN").alias("label"))


def call_number_summary(traces: DataFrame) -> DataFrame:
    return traces.groupBy("label", "attack_type").agg(F.count_distinct("path").alias("traces"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth beside traces: one JSON document per trace."""
    return spark.read.schema("trace string, ground_truth string, technique string, command string, label_source string, capture_mode string, label_rationale string").option("multiLine", "true").json(path)


def labels_of(traces: DataFrame, sidecars: DataFrame, known: DataFrame) -> DataFrame:
    """``trace``, ``label`` and ``technique``: from the trace's sidecar, else from the ``known`` map, else unknown to either and left out.

    ``traces``: trace; ``sidecars``: as read_labels gives them; ``known``: trace, label, technique. Labels are upper case.
    """
    told = sidecars.where(F.col("ground_truth").isNotNull()).groupBy("trace").agg(F.min(F.struct(F.upper("ground_truth").alias("label"), "technique")).alias("told"))
    mapped_ = known.groupBy("trace").agg(F.min(F.struct(F.upper("label").alias("label"), "technique")).alias("known"))
    met = traces.select("trace").distinct().join(told, "trace", "left").join(mapped_, "trace", "left").withColumn("it", F.coalesce("told", "known"))
    return met.where(F.col("it").isNotNull()).select("trace", "it.label", "it.technique")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration scores as JSON lines; malformed rows and other labels are dropped. A missing file is an empty table."""
    schema = "score double, label string"
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.withColumn("label", F.lower("label")).where(F.col("score").isNotNull() & F.col("label").isin("benign", "malicious"))


def write_calibration(rows: DataFrame, path: str) -> None:
    rows.select("score", "label").write.mode("append").json(path)


def write_audit(audit: DataFrame, path: str, incidents_path: str | None = None, isolated_path: str | None = None) -> None:
    """Append audit records as JSON; malicious ones of tier 3 and 4 also go to the incidents, those of tier 4 (ISOLATE) to a sink of their own.

    The records are computed once: the further sinks are written from what the first has taken.
    """
    held = staged(audit)
    held.write.mode("append").json(path)
    bad = F.col("label") == "MALICIOUS"
    if incidents_path:
        held.where(bad & (F.col("tier") >= 3)).write.mode("append").json(incidents_path)
    if isolated_path:
        held.where(bad & (F.col("tier") >= 4)).write.mode("append").json(isolated_path)


#: Figures that a manifest shows: plain ones, and blocks of which the percentiles are shown where they have them. fixed values
HEADLINES = ("f1", "tpr", "fpr", "precision", "accuracy", "fpr_ci_95", "n_windows", "n_traces", "recommended_claim")
TIMINGS = ("ipg_ms", "cwae_ms", "memory", "detector_throughput")


def artifact_facts(files: DataFrame, trusted: str = "trusted", fallbacks: str = "fallbacks") -> DataFrame:
    """Per result file (``name``, ``content``, ``bytes``, ``modified``): ``sha256``, ``headline`` (figure to its JSON), ``flags`` and ``error``.

    Files may have any shape; only JSON files are looked into. ``trusted`` is the backend that needs no flag, ``fallbacks`` the name in the
    meta block of the count of answers that weren't a model's.
    """
    is_json = F.endswith("name", F.lit(".json"))
    doc = F.when(is_json, F.try_parse_json(F.col("content").cast("string")))
    one = files.withColumn("__doc", doc)
    at = lambda path, kind="string": F.try_variant_get("__doc", f"$.{path}", kind)
    text = lambda path: F.to_json(F.try_variant_get("__doc", f"$.{path}", "variant"))
    shown = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    tail = lambda name: F.concat(F.lit('{"p50":'), text(f"{name}.p50"), F.lit(',"p99":'), F.coalesce(text(f"{name}.p99"), F.lit("null")), F.lit("}"))
    block = lambda name: F.when(F.startswith(text(name), F.lit("{")), F.coalesce(tail(name), text(name)))
    headline = F.map_from_entries(F.array_compact(F.array(*(shown(n, text(n)) for n in HEADLINES), *(shown(n, block(n)) for n in TIMINGS))))
    has_meta = F.startswith(F.coalesce(text("meta"), F.lit("")), F.lit("{"))
    backend, machine = at("meta.backend"), at("meta.machine")
    mocks = at(f"meta.{fallbacks}", "bigint")
    flags = F.array_compact(F.array(
        F.when(backend == "unknown", "backend=unknown (non-LLM eval?)").when(backend != trusted, F.concat(F.lit("backend="), backend)),
        F.when(at("meta.system") == "Darwin", "MAC_HOST_REJECT"), F.when(F.contains(at("meta.platform"), F.lit("MacBook")), "MAC_PLATFORM_REJECT"),
        F.when(mocks > 0, F.concat(F.lit("MOCK_FALLBACKS="), mocks)), F.when((machine != "") & (machine != "x86_64"), F.concat(F.lit("machine="), machine)),
    ))
    broken = is_json & F.col("__doc").isNull()
    flags = F.when(is_json & ~broken & ~has_meta, F.array(F.lit("NO META BLOCK"))).otherwise(flags)
    return one.select("name", "bytes", F.sha2("content", 256).alias("sha256"), "modified", headline.alias("headline"), flags.alias("flags"), F.when(broken, "invalid JSON").alias("error"))


def artifact_manifest(spark: SparkSession, path: str, **names: str) -> DataFrame:
    """artifact_facts of every file under ``path``. A file is read whole, as its digest and its figures ask."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return artifact_facts(files.select(F.substring_index("path", "/", -1).alias("name"), "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")), **names)
