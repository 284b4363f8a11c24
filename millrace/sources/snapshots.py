"""Captured snapshots: nested JSON to fact tables and back, loose files, and response sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import fingerprint, glob_regex, utf16_order
from millrace.operators.graph import has_cycle

VERSION = 6
DOCUMENT = "document_id string, path string, text string, is_generated boolean, file_identity string, is_editable boolean, fingerprint string, encoding_name string, has_bom boolean, is_default_compile_item boolean"
DOCUMENTS = f"array<struct<{','.join(f.replace(' ', ':', 1) for f in DOCUMENT.split(', '))}>>"
CONTEXT = (
    "context_id string, name string, assembly_name string, project_path string, target_framework string, is_analysis_target boolean, is_test_project boolean, "
    "nullable_context int, language_version int, output_kind int, preprocessor_symbols array<string>, properties map<string,string>, packages array<struct<id:string,version:string>>, "
    f"referenced_context_ids array<string>, documents {DOCUMENTS}"
)
FIELDS = [f.split(" ", 1)[0] for f in CONTEXT.split(", ")]
SCHEMA = f"version int, contexts array<struct<{', '.join(f.replace(' ', ':', 1) for f in CONTEXT.split(', '))}>>"


class Snapshot:
    """The fact tables of a snapshot: contexts, context_edges, packages, documents."""

    def __init__(self, contexts: DataFrame, context_edges: DataFrame, packages: DataFrame, documents: DataFrame):
        self.contexts, self.context_edges, self.packages, self.documents = contexts, context_edges, packages, documents

    @property
    def files(self) -> DataFrame:
        """Document memberships of analysis targets, without generated ones."""
        return self.files_including_generated.where("not is_generated")

    @property
    def files_including_generated(self) -> DataFrame:
        targets = self.contexts.where("is_analysis_target").select("context_id", "project_path", "is_test_project", "target_framework")
        return self.documents.join(targets, "context_id")

    @property
    def projects(self) -> DataFrame:
        return self.contexts.where("is_analysis_target")


def read_snapshot(spark: SparkSession, path: str, version: int = VERSION) -> Snapshot:
    """Read and check a snapshot of exactly this version."""
    root = spark.read.schema(SCHEMA).json(path, multiLine=True)
    wrong = root.where(~F.col("version").eqNullSafe(F.lit(version)))
    if not wrong.isEmpty():
        raise ValueError(f"the snapshot's version is not {version}")
    flat = root.select(F.inline("contexts"))
    contexts = flat.drop("documents", "referenced_context_ids", "packages")
    edges = flat.select(F.col("context_id").alias("src"), F.explode("referenced_context_ids").alias("dst"))
    packages = flat.select("context_id", F.inline("packages"))
    documents = flat.select("context_id", F.inline("documents"))
    twice = documents.groupBy("document_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("document ids repeat")
    if not contexts.groupBy("context_id").count().where("count > 1 or context_id is null").isEmpty():
        raise ValueError("context ids repeat")
    if not edges.join(contexts.select(F.col("context_id").alias("dst")), "dst", "left_anti").isEmpty():
        raise ValueError("a context refers to one that is not there")
    if has_cycle(edges):
        raise ValueError("contexts refer to each other in a circle")
    return Snapshot(contexts, edges, packages, documents)


def write_snapshot(snapshot: Snapshot, path: str, version: int = VERSION) -> None:
    """Write a snapshot as JSON lines of one context each group; Spark's committer makes it appear at once."""
    own = [f.split(" ")[0] for f in DOCUMENT.split(", ")]
    docs = snapshot.documents.groupBy("context_id").agg(F.collect_list(F.struct(*own)).alias("documents"))
    edges = snapshot.context_edges.groupBy(F.col("src").alias("context_id")).agg(F.array_sort(F.collect_set("dst")).alias("referenced_context_ids"))
    packs = snapshot.packages.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("id", "version"))).alias("packages"))
    rows = snapshot.contexts.join(docs, "context_id", "left").join(edges, "context_id", "left").join(packs, "context_id", "left")
    rows.select(F.lit(version).alias("version"), F.array(F.struct(*FIELDS)).alias("contexts")).write.json(path)


def loose_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below ``root`` that match a glob, as documents of one context called loose; none is an error."""
    read = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root)
    rows = read.select(F.col("value").alias("text"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"))
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(base)), F.substr("path", F.lit(len(base) + 1))).otherwise(F.col("path"))
    rows = rows.withColumn("relative", relative).where(F.col("relative").rlike(glob_regex(glob)))
    if rows.isEmpty():
        raise ValueError(f"no file matches {glob}")
    return rows.select(F.lit("loose").alias("context_id"), F.col("relative").alias("document_id"), F.col("relative").alias("path"), "text", F.lit(False).alias("is_generated"), F.col("path").alias("file_identity"), fingerprint(F.col("text")).alias("fingerprint")).orderBy(utf16_order(F.col("path")))


def response_json(aggregates: DataFrame, protocol: int = 11) -> DataFrame:
    """One JSON text for each finding, with the protocol's version."""
    return aggregates.select(F.to_json(F.struct(F.lit(protocol).alias("version"), F.struct(*aggregates.columns).alias("finding"))).alias("value"))


def escaped(path: str) -> str:
    """A path as it is, or as a JSON text where it holds control characters, quotes or outer blanks."""
    return json.dumps(path) if path != path.strip() or any(ord(c) < 32 or c == '"' for c in path) else path


def render(rows: Iterator) -> Iterator[str]:
    """Lines of a report from ordered aggregates with line and column: by rule, then file, then place."""
    rule = file = None
    for r in rows:
        if r["rule_id"] != rule:
            rule, file = r["rule_id"], None
            yield f"{rule}: {r['message']}"
        if r["path"] != file:
            file = r["path"]
            yield f"  {escaped(file)}"
        place = str(r["line"]) if r["column"] == 1 else f"{r['line']}:{r['column']}"
        yield f"    {place}{' +' if r['batch_id'] else ''}{' (review)' if r['disposition'] == 'Review' else ''}"


def render_status(rows: Iterator) -> Iterator[str]:
    """Lines of a status report from (project_path, fix_complexity, n) by project: its total, then each complexity."""
    own: dict[str, list] = {}
    for r in rows:
        own.setdefault(r["project_path"], []).append((r["fix_complexity"], r["n"]))
    for project, kinds in own.items():
        yield f"{escaped(project)}: {sum(n for _, n in kinds)}"
        for kind, n in sorted(kinds, key=lambda x: (x[0] is None, x[0] or "")):
            yield f"  {kind or 'unspecified'}: {n}"


def response_documents(findings: DataFrame, contexts: DataFrame, edits: DataFrame, protocol: int = 11) -> DataFrame:
    """The response in one JSON text for each context: its findings in order, and the batches that they propose with their edits.

    A context without findings answers too.
    """
    columns = [c for c in findings.columns if c != "context_id"]
    order = F.struct("rule_id", utf16_order(F.col("path")).alias("_path"), "start", "ordinal", F.struct(*columns).alias("finding"))
    own = findings.groupBy("context_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["finding"]).alias("findings"))
    used = findings.where("batch_id is not null").select("context_id", "batch_id").distinct().join(edits, "batch_id")
    batches = used.groupBy("context_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("file_identity", "start", "length", "replacement"))).alias("edits"))
    batches = batches.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("batch_id", "edits"))).alias("batches"))
    joined = contexts.select("context_id").join(own, "context_id", "left").join(batches, "context_id", "left")
    return joined.select(F.to_json(F.struct(F.lit(protocol).alias("version"), "context_id", "findings", "batches")).alias("value"))
