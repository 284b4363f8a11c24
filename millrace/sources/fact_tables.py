"""Fact tables of captured code: their columns, a reader that checks them, and the selections that rules start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.facts import distinct_definitions
from millrace.plans.selection import Selection

#: Where a row lies: what every table of occurrences begins with.
PLACE = "context_id string, document_id string, start int, length int"
TABLES = {
    "contexts": "context_id string, name string, project_path string, target_framework string, is_analysis_target boolean, is_test_project boolean, properties map<string,string>",
    "context_edges": "src string, dst string",
    "packages": "context_id string, id string, version string",
    "documents": "context_id string, document_id string, path string, text string, is_generated boolean, file_identity string",
    "available_types": "context_id string, type_key string",
    "type_parts": f"{PLACE}, symbol string, name string, namespace string, kind string, path string, accessibility string, modifiers array<string>, containing_type string",
    "bases": "type string, base string, is_interface boolean",
    "members": f"{PLACE}, symbol string, owner string, name string, kind string, type_key string, accessibility string, modifiers array<string>, body_kind string, parameters array<string>",
    "attributes": "context_id string, symbol string, attribute_type string",
    "overrides": "context_id string, symbol string, overridden string, distance int",
    "variables": f"{PLACE}, kind string, type_key string, has_explicit_type boolean, has_initializer boolean, reads int, is_var_safe boolean, is_top_level boolean",
    "statements": f"{PLACE}, kind string, has_else boolean, has_braces boolean, parent_kind string",
    "catches": f"{PLACE}, try_id string, exception_type string, has_declaration boolean, has_filter boolean, rethrows boolean, n_statements int",
    "calls": f"{PLACE}, call_id string, caller string, owner string, name string, target string, receiver_type string, receiver_call string, is_resolved boolean, in_expression_tree boolean, in_nameof boolean",
    "arguments": "call_id string, ordinal int, parameter string, parameter_type string, value_start int, value_length int, type_key string, has_value boolean, value string",
    "object_creations": f"{PLACE}, type_key string, definition string, to_collection boolean, parameters array<string>",
    "member_refs": f"{PLACE}, member string, name string, owner string, in_nameof boolean",
    "type_refs": f"{PLACE}, type_key string, name string",
    "null_checks": f"{PLACE}, form string, is_negated boolean",
    "expressions": f"{PLACE}, type_key string, converted_type string, refers_to string, has_value boolean, constant_type string, value string, is_nameof boolean, is_awaited boolean",
    "bodies": f"{PLACE}, body_id string, owner string",
    "functions": f"{PLACE}, function_id string, containing_type string",
    "nodes": f"{PLACE}, kind string, bits int",
    "operations": f"{PLACE}, kind string",
    "comments": f"{PLACE}, kind string, text string, line int",
    "conditions": f"{PLACE}, body_id string, pattern string",
}
#: Tables whose rows lie in a document.
PLACED = tuple(name for name, columns in TABLES.items() if columns.startswith(PLACE))


class Facts:
    """Fact tables by name, and selections over those of the analysis target, without generated documents."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> Facts:
        """Tables from the Parquet folders of their names; a table with other columns or types is an error."""
        tables = {}
        for name in names:
            rows = spark.read.parquet(f"{folder}/{name}")
            wanted = spark.createDataFrame([], TABLES[name]).schema
            for field in wanted:
                if field.name not in rows.columns or rows.schema[field.name].dataType != field.dataType:
                    raise ValueError(f"{name}: {field.name} is not a column of type {field.dataType.simpleString()}")
            tables[name] = rows.select(*wanted.names)
        return cls(tables)

    def write(self, folder: str) -> None:
        for name, rows in self.tables.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def reported(self, name: str, including_generated: bool = False) -> Selection:
        """Rows of a table that lie in a document of the analysis target, named by their place, in the order of path and place."""
        rows = self.table(name)
        if "document_id" in rows.columns:
            documents = self.table("documents")
            chosen = documents if including_generated else documents.where("not is_generated")
            rows = rows.join(chosen.select("context_id", "document_id"), ["context_id", "document_id"], "left_semi")
        targets = self.table("contexts").where("is_analysis_target").select("context_id")
        rows = rows.join(targets, "context_id", "left_semi")
        place = tuple(c for c in ("context_id", "document_id", "start", "length") if c in rows.columns)
        return Selection(rows, place or ("context_id",))

    def files(self, including_generated: bool = False) -> Selection:
        return self.reported("documents", including_generated)

    def projects(self) -> Selection:
        return Selection(self.table("contexts").where("is_analysis_target"), ("context_id",))

    def type_declarations(self) -> Selection:
        """Every written part of a type."""
        return self.reported("type_parts")

    def types(self) -> Selection:
        """Each type once in a context: its first part by path and place."""
        return Selection(distinct_definitions(self.reported("type_parts").rows), ("context_id", "symbol"))

    def interfaces(self) -> Selection:
        return self.types().where(F.col("kind") == "interface")

    def members(self, *kinds: str) -> Selection:
        """Declared members: methods, fields, enum members, properties, parameters."""
        return self.reported("members").where(F.col("kind").isin(*kinds))

    def declarations(self) -> DataFrame:
        """(context_id, document_id, start, length, symbol, name, kind) of every declared symbol, types among them."""
        columns = ["context_id", "document_id", "start", "length", "symbol", "name", "kind"]
        return self.reported("type_parts").rows.select(*columns).unionByName(self.reported("members").rows.select(*columns))

    def variables(self, kind: str) -> Selection:
        """Local variables, for-each loops' variables or out variables."""
        return self.reported("variables").where(F.col("kind") == kind)

    def statements(self, kind: str) -> Selection:
        """If statements, embedded statements or enumerations."""
        return self.reported("statements").where(F.col("kind") == kind)

    def calls(self, *names: str) -> Selection:
        """Calls; with names only those, which the scan can filter on."""
        rows = self.reported("calls")
        return rows.named("name", *names) if names else rows

    def nodes(self, kind: str) -> Selection:
        return self.reported("nodes").where(F.col("kind") == kind)

    def operations(self, kind: str) -> Selection:
        return self.reported("operations").where(F.col("kind") == kind)

    def fact(self, make: Callable[[Facts], DataFrame]) -> DataFrame:
        """A frame derived from the session's tables, made once for each function that makes it."""
        held = self.__dict__.setdefault("_made", {})
        if make not in held:
            held[make] = make(self)
        return held[make]


def project_fact(rows: DataFrame, aggregates: dict, key: str = "context_id") -> DataFrame:
    """One row for each context: values that a caller aggregates (name: Column) over its rows."""
    return rows.groupBy(key).agg(*[value.alias(name) for name, value in aggregates.items()])
