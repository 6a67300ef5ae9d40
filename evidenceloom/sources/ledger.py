"""Schema changes of a versioned table: in their order, each once, pinned by the hash of its text.

A change is a name and a SQL query over {table}. What was applied is a versioned table of its own; a change that was applied and
then edited, renamed, moved or dropped is an error before anything is touched.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import DataFrame, SparkSession

from evidenceloom.sources.tables import Versioned

LEDGER = "number int, name string, sha256 string, version int"


@dataclasses.dataclass(frozen=True)
class Change:
    name: str
    query: str

    @property
    def sha256(self) -> str:
        return hashlib.sha256(f"{self.name}\n{self.query}".encode()).hexdigest()


class Edited(Exception):
    """A change that was applied is not what it was."""


def applied(ledger: Versioned) -> list[tuple]:
    """number, name, sha256, version of the changes so far: as many rows as there are changes."""
    return [tuple(r) for r in ledger.read().orderBy("number").collect()] if ledger.number() else []


def migrate(spark: SparkSession, table: Versioned, ledger: Versioned, changes: list[Change]) -> list[str]:
    """Applies what is not applied yet, each change as a version of the table; the names of these.

    Two who migrate at once can't both apply a change: the table's next number is one writer's, and the other gives up with a conflict. Changes should
    bear to be applied again, as the row of the last one is missing if its writer was lost before he wrote it.
    """
    done = applied(ledger)
    for i, (number, name, sha256, _) in enumerate(done):
        if i >= len(changes) or (number, name, sha256) != (i + 1, changes[i].name, changes[i].sha256):
            raise Edited(f"change {number} ({name}) was applied and is not what it was")
    new = []
    for number, change in enumerate(changes[len(done) :], len(done) + 1):
        base = table.number()
        version = table.swap(spark.sql(change.query, table=table.read(base)), after=base)
        row = spark.createDataFrame([(number, change.name, change.sha256, version)], LEDGER)
        ledger.update(lambda before, row=row: row if before is None else before.unionByName(row))
        new.append(change.name)
    return new


def state(ledger: Versioned) -> DataFrame:
    return ledger.read()
