"""Cases of a rule as rows, taken by the rows of a given table: the same rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP", "date": "DATE"}
#: Of a given table: its key, and what a row puts in for OWN.
OWNERS = {"events": ("event_id", "concat(event_type, '-', user_id)"), "pages": ("page_id", "concat('p', page_id)"), "documents": ("doc_id", "concat(lang, doc_id)")}
OWN = "§"


def _type(kind: str) -> str:
    return _type(kind[6:-1]) + "[]" if kind.startswith("array<") else _TYPES[kind]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


class Fixture:
    """schema: "name type, .." with simple types and arrays of them; rows: tuples.

    With a table in front, as in "events: id int, ..", every row of that table takes one case under its own key: the rows
    whose first column is the key modulo the number of cases (one more than the largest, or "events/8: .."), with OWN in
    texts replaced by a value of the row. A first column of texts has a case for each and gets the key behind a dash. With
    a star behind the table the cases are strewn by a hash of the key, so that neighbouring rows differ in what they take.
    """

    def __init__(self, schema: str, rows: list[tuple]):
        owner, _, schema = schema.rpartition(": ")
        self.owner, _, cases = owner.partition("/")
        self.strewn, self.owner = self.owner.endswith("*"), self.owner.rstrip("*")
        self.schema, self.rows = schema, rows
        self.fields = [tuple(f.split(" ", 1)) for f in schema.split(", ")]
        self.named = self.fields[0][1] == "string"
        keys = list(dict.fromkeys(r[0] for r in rows))
        self.keys = keys if self.named else list(range(int(cases) if cases else max(keys, default=0) + 1))

    @property
    def place(self) -> str:
        return f"({'_key * 7919 % 10007' if self.strewn else '_key'}) % {len(self.keys)}"

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        """The rows taken by the table's rows, or as they are without a folder of tables."""
        made = spark.createDataFrame(self.rows, self.schema)
        if not self.owner or sf_dir is None:
            return made
        key, own = OWNERS[self.owner]
        taken = spark.read.parquet(f"{sf_dir}/{self.owner}.parquet").select(F.col(key).cast("long").alias("_key"), F.expr(own).alias("_own"))
        case = F.lit(self.keys)[F.expr(f"cast({self.place} as int)")]
        first = self.fields[0][0]
        joined = taken.join(F.broadcast(made), case == made[first])
        out = [(F.concat_ws("-", first, "_key") if self.named else F.col("_key")).alias(first)]
        for i, (name, kind) in list(enumerate(self.fields))[1:]:
            own_ = any(OWN in str(r[i]) for r in self.rows)
            out.append((F.replace(F.col(name), F.lit(OWN), F.col("_own")) if kind == "string" else F.transform(name, lambda x: F.replace(x, F.lit(OWN), F.col("_own")))).alias(name) if own_ else F.col(name))
        return joined.select(*out)

    @property
    def sql(self) -> str:
        names = ", ".join(f'"{n}"' for n, _ in self.fields)
        casts = ", ".join(f'CAST("{n}" AS {_type(t)}) AS "{n}"' for n, t in self.fields)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        rows = f"(SELECT {casts} FROM (VALUES {values}) v({names}))"
        if not self.owner:
            return rows
        key, own = OWNERS[self.owner]
        first = self.fields[0][0]
        put = [f"concat(\"{first}\", '-', _key) AS \"{first}\"" if self.named else f'_key AS "{first}"']
        put += [f"replace(\"{n}\", '{OWN}', _own) AS \"{n}\"" if t == "string" else f"list_transform(\"{n}\", lambda x: replace(x, '{OWN}', _own)) AS \"{n}\"" if t == "array<string>" else f'"{n}"' for n, t in self.fields[1:]]
        return f"(SELECT {', '.join(put)} FROM (SELECT CAST({key} AS BIGINT) AS _key, {own} AS _own FROM {self.owner}) JOIN {rows} f ON f.\"{first}\" = {_literal(self.keys)}[{self.place} + 1])"
