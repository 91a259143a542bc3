"""Graphs as a data source: folders of GML files, one for each scenario, read and written by Spark tasks.

    spark.dataSource.register(GmlSource)
    spark.read.format("gml").load(folder)
    write_graphs(table, folder)

A table of graphs has a row for each node and edge: graph (the file's name), kind
("node" or "edge"), id of a node, source and target of an edge, and all other
attributes as strings in a map; nested lists have names with dots.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "graph string, kind string, id long, source long, target long, attributes map<string, string>"
TOKEN = re.compile(r"\s*(?:#[^\n]*\n\s*)*(\"[^\"]*\"|\[|\]|[^\s\[\]\"]+)")
ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}


def tokens(text: str) -> Iterator[str]:
    at = 0
    while m := TOKEN.match(text, at):
        at = m.end()
        yield m[1]


def unquoted(x: str) -> str:
    if x[:1] != '"':
        return x
    return re.sub(r"&(?:quot|amp|lt|gt|#\d+);", lambda m: ENTITIES.get(m[0]) or chr(int(m[0][2:-1])), x[1:-1])


def quoted(x: str) -> str:
    """A value as GML has it: numbers as they are, all else as a string of ASCII characters with entities."""
    if re.fullmatch(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", x):
        return x
    return '"' + "".join({'"': "&quot;", "&": "&amp;"}.get(c) or (c if 32 <= ord(c) < 127 else f"&#{ord(c)};") for c in x) + '"'


def parsed(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(kind, attributes) of the nodes and edges of a GML text, in its order."""
    stream = tokens(text)

    def values(prefix: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for key in stream:
            if key == "]":
                break
            value = next(stream, "")
            if value == "[":
                out |= values(f"{prefix}{key}.")
            else:
                out[prefix + key] = unquoted(value)
        return out

    for key in stream:
        value = next(stream, "")
        if value != "[" or key != "graph":
            if value == "[":
                values("")
            continue
        for inner in stream:
            if inner == "]":
                break
            value = next(stream, "")
            if value == "[":
                found = values("")
                if inner in ("node", "edge"):
                    yield inner, found


def block(kind: str, attributes: list[tuple[str, str]]) -> str:
    """A node or edge; names with dots become nested lists."""

    def lines(items: list[tuple[str, str]], indent: str) -> Iterator[str]:
        done = set()
        for k, v in items:
            head, dot, _ = k.partition(".")
            if not dot:
                yield f"{indent}{k} {quoted(v)}\n"
            elif head not in done:
                done.add(head)
                yield f"{indent}{head} [\n"
                yield from lines([(x[len(head) + 1 :], y) for x, y in items if x.startswith(head + ".")], indent + "  ")
                yield f"{indent}]\n"

    return f"  {kind} [\n{''.join(lines(attributes, '    '))}  ]\n"


@dataclass
class GraphFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class GmlReader(DataSourceReader):
    """A task for each file of the folder."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=False))
        return [GraphFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".gml")]

    def read(self, partition: GraphFile | None) -> Iterator[tuple]:
        if partition is None:
            return
        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with where.open_input_stream(partition.path) as f:
            text = f.read().decode()
        name = partition.path.rsplit("/", 1)[-1][: -len(".gml")]
        for kind, a in parsed(text):
            ends = [int(a.pop(k)) if a.get(k) is not None else None for k in ("id", "source", "target")]
            yield (name, kind, *ends, a)


class GmlWriter(DataSourceWriter):
    """Rows of one graph must stand together, nodes first; a file is complete before it gets its name."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        where, root = self._store()
        where.create_dir(root, recursive=True)
        files, name, out = [], None, None
        for r in rows:
            if r.graph != name:
                if out:
                    out.write(b"]\n")
                    out.close()
                name = r.graph
                final, draft = f"{root}/{name}.gml", f"{root}/.{uuid.uuid4().hex}"
                if not self.overwrite and where.get_file_info(final).type != fs.FileType.NotFound:
                    raise FileExistsError(f"{final} exists")
                files.append((draft, final))
                out = where.open_output_stream(draft)
                out.write(b"graph [\n")
            own = [(k, str(r[k])) for k in ("id", "source", "target") if r[k] is not None]
            out.write(block(r.kind, own + sorted((r.attributes or {}).items())).encode())
        if out:
            out.write(b"]\n")
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _ = self._store()
        for draft, final in (f for m in messages if m for f in m.files):
            where.move(draft, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _ = self._store()
        for draft, _final in (f for m in messages if m for f in m.files):
            where.delete_file(draft)


class GmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GmlReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GmlWriter(self.options["path"], overwrite)


def write_graphs(graphs: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each graph of the table; one that is there already is refused unless ``overwrite``."""
    graphs.sparkSession.dataSource.register(GmlSource)
    dealt = graphs.select("graph", "kind", "id", "source", "target", "attributes").repartition("graph").sortWithinPartitions("graph", (graphs["kind"] == "edge"), "id", "source", "target")
    dealt.write.format("gml").mode("overwrite" if overwrite else "append").save(folder)


def read_graphs(spark, folder: str) -> DataFrame:
    """All graphs of a folder."""
    spark.dataSource.register(GmlSource)
    return spark.read.format("gml").load(folder)
