"""Graphs as batches of merge statements, and a sink of statement files with commit and abort.

A statement merges many nodes of one type, or many edges of one relation, that travel as its
parameter ``rows``. Names of types and relations come from data, so they are quoted.
All nodes of a file set are applied before its edges; merging twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from textloom.functions.text import relation_name
from textloom.skew import join_counted
from textloom.storage import materialize

STATEMENTS = "stage string, statement string, rows array<map<string,string>>"


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def node_statement(kind: Column) -> Column:
    return F.concat(F.lit("UNWIND $rows AS r MERGE (n:"), _quoted(F.coalesce(kind, F.lit("Entity"))), F.lit(" {id: r.id}) SET n.name = r.name, n.doc_id = r.doc_id"))


def edge_statement(relation: Column) -> Column:
    named = relation_name(F.coalesce(relation, F.lit("RELATED_TO")))
    return F.concat(F.lit("UNWIND $rows AS r MATCH (a {id: r.source}), (b {id: r.target}) MERGE (a)-[:"), _quoted(named), F.lit("]->(b)"))


def merges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """stage, statement, a, b, c: each different node with an id (id, name, doc_id) and edge with two ends (source, target, null)."""
    of_nodes = nodes.where("id is not null").select(F.lit("nodes").alias("stage"), node_statement(F.col("type")).alias("statement"), F.col("id").cast("string").alias("a"), F.coalesce("label", "id").cast("string").alias("b"), F.col("doc_id").cast("string").alias("c"))
    of_edges = edges.where("source is not null and target is not null").select(F.lit("edges").alias("stage"), edge_statement(F.col("relation")).alias("statement"), F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    return of_nodes.unionByName(of_edges).distinct()


def batched(nodes: DataFrame, edges: DataFrame, rows: int = 1000) -> DataFrame:
    """STATEMENTS of about ``rows`` rows each, however many of them one type or relation has.

    Rows are dealt to as many batches as their statement needs, by a hash of their values, so the same
    graph gives the same batches. Counts of statements meet the rows by ``join_counted``: a frequent
    statement's rows are not gathered before they are dealt.
    """
    each = materialize(merges(nodes, edges), "merges")
    counts = materialize(each.groupBy("stage", "statement").agg(F.count(F.lit(1)).alias("n")), "merge-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    dealt = join_counted(each, counts, ["stage", "statement"], "n", total)
    batch = F.pmod(F.xxhash64("a", "b", "c"), F.ceil(F.col("n") / rows))
    grouped = dealt.groupBy("stage", "statement", batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "c"))).alias("found"))

    def fields(*names: str) -> Column:
        return F.transform("found", lambda x: F.create_map(*[y for name, at in zip(names, "abc", strict=False) for y in (F.lit(name), x[at])]))

    return grouped.select("stage", "statement", F.when(F.col("stage") == "nodes", fields("id", "name", "doc_id")).otherwise(fields("source", "target")).alias("rows"))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Tasks write into a folder of their own job; the driver moves what counts and names it in a manifest."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        system, folder = fs.FileSystem.from_uri(self.uri)
        folder = folder.rstrip("/")
        return system, folder, f"{folder}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, _, pending = self._open()
        system.create_dir(pending)
        attempt, files, open_files = uuid.uuid4().hex, [], {}
        try:
            for row in iterator:
                if row.stage not in ("nodes", "edges"):
                    raise ValueError(f"stage is {row.stage!r}, not nodes or edges")
                if row.stage not in open_files:
                    files.append(f"{row.stage}-{self.job}-{attempt}.jsonl")
                    open_files[row.stage] = system.open_output_stream(f"{pending}/{files[-1]}")
                line = {"stage": row.stage, "statement": row.statement, "rows": row.rows}
                open_files[row.stage].write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
        except BaseException:
            for stage in open_files:
                open_files[stage].close()
            for name in files:
                system.delete_file(f"{pending}/{name}")
            raise
        for stream in open_files.values():
            stream.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder, pending = self._open()
        system.create_dir(folder)
        before = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file] if self.overwrite else []
        names = sorted(name for m in messages if m for name in m.files)
        for name in names:
            system.move(f"{pending}/{name}", f"{folder}/{name}")
        # What no manifest names does not count, so a commit that dies half-way has added nothing.
        with system.open_output_stream(f"{folder}/_manifest-{self.job}.part") as out:
            out.write(json.dumps({"files": names}).encode())
        system.move(f"{folder}/_manifest-{self.job}.part", f"{folder}/_manifest-{self.job}.json")
        for path in sorted(before, key=lambda p: "/_manifest-" not in p):
            system.delete_file(path)
        self._discard(system, pending)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, pending = self._open()
        self._discard(system, pending)

    def _discard(self, system: fs.FileSystem, pending: str) -> None:
        if system.get_file_info(pending).type != fs.FileType.NotFound:
            system.delete_dir(pending)


class StatementSink(DataSource):
    """``df.write.format("merge_statements").mode("append").save(uri)`` for a frame of STATEMENTS."""

    @classmethod
    def name(cls) -> str:
        return "merge_statements"

    def schema(self) -> str:
        return STATEMENTS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def export(nodes: DataFrame, edges: DataFrame, uri: str, rows: int = 1000, mode: str = "append") -> None:
    """Writes a graph as merge statements into a folder that all executors reach."""
    nodes.sparkSession.dataSource.register(StatementSink)
    batched(nodes, edges, rows).write.format(StatementSink.name()).mode(mode).save(uri)


def statements(spark: SparkSession, uri: str) -> DataFrame:
    """STATEMENTS of all exports that were committed to a folder."""
    system, folder = fs.FileSystem.from_uri(uri)
    held = [x.path for x in system.get_file_info(fs.FileSelector(folder.rstrip("/"), allow_not_found=True)) if x.base_name.startswith("_manifest-") and x.extension == "json"]
    names = [name for path in held for name in json.loads(system.open_input_stream(path).read())["files"]]
    if not names:
        return spark.createDataFrame([], STATEMENTS)
    return spark.read.schema(STATEMENTS).json([f"{uri.rstrip('/')}/{name}" for name in names])
