"""Read-only SQL over registered tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import clean_statement, first_token
from tablewright.session import stored

#: plan and expression nodes that reach outside the tables: programs, and methods called by name
FORBIDDEN = ("ScriptTransformation", "ScriptInputOutputSchema", "CallMethodViaReflection", "PythonUDF", "PythonUDTF")


def forbidden_nodes(df: DataFrame) -> list[str]:
    """Names of the nodes in the analysed plan that a read-only statement must not have.

    The plan is looked at, not the text: comments, aliases and literals cannot hide or fake a
    node. Commands count as forbidden too.
    """
    found = set()

    def walk(node) -> None:
        if isinstance(node, dict):
            name = str(node.get("class", "")).rpartition(".")[2]
            if name in FORBIDDEN or name.endswith("Command"):
                found.add(name)
            for child in node.values():
                walk(child)
        elif isinstance(node, list):
            for child in node:
                walk(child)

    walk(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
    return sorted(found)


class SqlDesk:
    """Registers tables and runs one cleaned SELECT at a time, errors returned as values.

    ``WITH …`` is refused like any text that does not start with SELECT; a second
    statement is refused by Spark's parser.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: list[str] = []

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        if name not in self.tables:
            self.tables.append(name)

    def clean(self, text: str) -> tuple[str, str]:
        """The statement without fences and comments, and its first word."""
        row = self.spark.range(1).select(clean_statement(F.lit(text)).alias("s"))
        row = row.select("s", first_token(F.col("s")).alias("t")).first()
        return row["s"], row["t"]

    def run(self, text: str | None = None, executed: bool = False) -> dict:
        """``{success, sql, result, error}``; no text means a look at the first table.

        A result is lazy, so a cast that fails on some row fails when it is read. With
        ``executed`` the statement runs here, into a table on the shared folder, and such
        errors are values as well.
        """
        if text is None:
            if not self.tables:
                return {"success": False, "sql": "", "result": None, "error": "no tables registered"}
            text = f"SELECT * FROM {self.tables[0]} LIMIT 10"
        statement, token = self.clean(text)
        if token != "SELECT":
            error = f"statement does not start with SELECT: {statement[:120]!r}"
            return {"success": False, "sql": statement, "result": None, "error": error}
        try:
            result = self.spark.sql(statement)
            bad = forbidden_nodes(result)
            if bad:
                error = f"statement reaches outside the tables: {', '.join(bad)}"
                return {"success": False, "sql": statement, "result": None, "error": error}
            if executed:
                result = stored(result)
            return {"success": True, "sql": statement, "result": result, "error": ""}
        except Exception as exc:
            return {"success": False, "sql": statement, "result": None, "error": str(exc)}

    def execute_sql(self, text: str) -> tuple[DataFrame | None, str]:
        out = self.run(text)
        return out["result"], out["error"]
