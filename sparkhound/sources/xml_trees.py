"""XML as node rows: the form in which parsers hand over concrete syntax trees (S-09).

A document is one row and is parsed by itself, event by event; nothing larger than one document's nodes and a batch is held.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = "file string, node_id long, parent_id long, child_ix int, depth int, pre_order long, subtree_end long, tag string, field string, text string, line int, column int, end_line int, end_column int, error string"
#: Rows that are sent on together, about.
ROWS = 8192
#: Attributes of a node's place; rows and columns count from 0.
PLACE = ("srow", "scol", "erow", "ecol")


class _Reader:
    """Nodes of one document in pre-order; text is a node's own, without its children's."""

    def __init__(self):
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.children: list[int] = []
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.data
        # entities stay as they are: nothing is read from elsewhere and nothing expands
        self.parser.DefaultHandler = lambda _: None

    def start(self, tag: str, attributes: dict) -> None:
        place = [int(attributes[k]) if attributes.get(k, "").isdigit() else None for k in PLACE]
        row = {"node_id": len(self.rows), "parent_id": self.open[-1] if self.open else None, "child_ix": self.children[-1] if self.children else 0, "depth": len(self.open), "tag": tag, "field": attributes.get("field"), "text": [], "place": place}
        if self.children:
            self.children[-1] += 1
        self.open.append(row["node_id"])
        self.children.append(0)
        self.rows.append(row)

    def end(self, _tag: str) -> None:
        self.rows[self.open.pop()]["subtree_end"] = len(self.rows) - 1
        self.children.pop()

    def data(self, text: str) -> None:
        if self.open:
            self.rows[self.open[-1]]["text"].append(text)


def parse(text: str | None) -> tuple[list[tuple], str | None]:
    """(nodes, error): what stands before the first fault, and the fault."""
    reader, error = _Reader(), None
    try:
        reader.parser.Parse((text or "").encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        error = str(e)
    out = []
    for r in reader.rows:
        line, column, end_line, end_column = (x if x is None else x + 1 for x in r["place"])
        out.append((r["node_id"], r["parent_id"], r["child_ix"], r["depth"], r["node_id"], r.get("subtree_end", len(reader.rows) - 1), r["tag"], r["field"], "".join(r["text"]).strip(), line, column, end_line, end_column, error))
    return out, error


def xml_trees(documents: DataFrame, text: str = "content") -> DataFrame:
    """Node rows of documents(file, content); lines and columns count from 1. A document without a node gives one row with its error."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        rows = []
        for b in batches:
            for file, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes, error = parse(body)
                rows += [(file, *n) for n in nodes] or [(file, *[None] * 13, error)]
                if len(rows) >= ROWS:  # a document's rows and so many others at once, at most
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return documents.selectExpr("cast(file AS string) AS file", f"cast(`{text}` AS string) AS body").mapInArrow(run, NODES)
