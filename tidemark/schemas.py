"""Declared tables of a transactional ledger store and the codes that their columns hold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

PREPARED, DELETED, COMMITTED, ABORTED = "PREPARED", "DELETED", "COMMITTED", "ABORTED"
LOCK_NONE, LOCK_READ, LOCK_WRITE = 1, 2, 3
DEFAULT_NAMESPACE = "default"
#: How long a lock is valid; the lock boundary lies this far before the start of a run.
LOCK_VALID_MS = 15_000
#: Columns that mark a table as transactional.
TRANSACTION_COLUMNS = ("tx_id", "tx_state", "tx_prepared_at")


class MissingColumns(ValueError):
    """A table lacks a column that a job needs."""


@dataclass(frozen=True)
class TableSpec:
    """A table's declared columns, key, and the column whose age decides.

    ``state_codes`` maps the integers of a store to state names where ``state_col`` is stored as numbers.
    """

    name: str
    schema: str
    keys: tuple[str, ...]
    age_col: str
    before: dict[str, str] = field(default_factory=dict)
    state_codes: dict[int, str] | None = None
    state_col: str = "tx_state"

    def struct(self) -> StructType:
        return _parse_datatype_string(self.schema)

    def check(self, df: DataFrame) -> DataFrame:
        """The frame itself, or an error that names the missing columns."""
        missing = [f.name for f in self.struct() if f.name not in df.columns]
        if missing:
            raise MissingColumns(f"{self.name}: no column {', '.join(missing)}")
        return df

    def named(self, df: DataFrame) -> DataFrame:
        """The frame with states by name; a number without a name fails the job, null stays null."""
        if not self.state_codes:
            return df
        code, names = F.col(self.state_col), F.create_map(*[F.lit(x) for pair in self.state_codes.items() for x in pair])
        unknown = F.raise_error(F.concat(F.lit(f"{self.name}: unknown {self.state_col} "), code.cast("string")))
        return df.withColumn(self.state_col, F.when(code.isNotNull(), F.coalesce(F.try_element_at(names, code), unknown)))

    def coded(self, df: DataFrame) -> DataFrame:
        """The opposite of :meth:`named`."""
        if not self.state_codes:
            return df
        codes = F.create_map(*[F.lit(x) for code, name in self.state_codes.items() for x in (name, code)])
        return df.withColumn(self.state_col, F.try_element_at(codes, F.col(self.state_col)))


LEDGER = TableSpec(
    "ledger_records", "pk string, tx_id string, tx_state string, tx_prepared_at bigint, val double, before_val double", ("pk",), "tx_prepared_at", {"val": "before_val"}
)
COORDINATOR = TableSpec("coordinator_state", "tx_id string, c_state string, tx_created_at bigint", ("tx_id",), "tx_created_at", state_col="c_state")
LOCKS = TableSpec("asset_lock", "ns string, id string, lock_type int, last_updated_at bigint, owner_nonces array<string>", ("ns", "id"), "last_updated_at")
WATERMARKS = TableSpec("watermarks", "domain string, server_type string, started_at_ms bigint", ("domain", "server_type"), "started_at_ms")
PROOFS = TableSpec("request_proof", "nonce string, registered_at bigint", ("nonce",), "registered_at")
ATTEMPTS = TableSpec("lock_attempts", "run string, ns string, id string, outcome string, attempt int, due_ms bigint", ("run", "ns", "id", "attempt"), "due_ms")
