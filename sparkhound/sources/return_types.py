"""What calls return, by language: the table that operators.types looks names up in.

Fixed values: names, kinds and types. A name without its module stands for a method of any receiver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CRYSTAL = {
    "nullable": ["Hash#[]?", "Array#first?", "Array#last?", "Array#[]?", "DB.query_one?", "Repo.get?", "File.read?", "Regex.match?", "String.match?"],
    "safe": [
        "Hash#[]", "Array#first", "Array#last", "Array#[]", "JSON.parse", "JSON.parse_io", "HTTP::Client.get", "HTTP::Client.post", "HTTP::Client.put", "HTTP::Client.delete", "HTTP::Client.patch", "HTTP::Client.head",
        "to_s", "to_i", "to_f", "to_h", "to_a",
    ],
}
GLEAM = {
    "result": ["int.parse", "float.parse", "file.read", "file.write", "http.send", "http.get", "dict.get"],
    "nullable": ["list.first", "list.last", "map.get"],
}
RETURNS = "language string, name string, kind string"


def return_types(spark: SparkSession, languages: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Rows of RETURNS; kinds are safe, nullable and result."""
    table = languages or {"crystal": CRYSTAL, "gleam": GLEAM}
    return spark.createDataFrame([(language, name, kind) for language, kinds in table.items() for kind, names in kinds.items() for name in names], RETURNS)
