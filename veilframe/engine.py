"""The engine: registration, checks, budget, release."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .accounting import Accountant
from .errors import EngineError, ExecutionBackendError, InsufficientPrivacyBudgetError, InvalidPrivacyParametersError, ValidationError
from .functions.noise import NoiseMode
from .model import DPParams
from .plans.guard import check_relations, check_text
from .plans.release import release
from .plans.sql import Parser, Query
from .sources import catalog


class Engine:
    def __init__(self, spark: SparkSession, accountant: Accountant, noise_mode: NoiseMode = NoiseMode.SECURE, strict: bool = True, enforce_global_min_frequency: bool = False):
        self.spark, self.accountant, self.mode, self.strict = spark, accountant, noise_mode, strict
        self.enforce_global_min_frequency = enforce_global_min_frequency
        self.db_schema: dict[str | None, catalog.Schema] = {}
        self.privacy_unit_columns: dict[tuple[str | None, str], str] = {}

    def register_database(self, db: str | None = None, privacy_unit_columns: dict[str, str] | None = None) -> None:
        """Records the tables of a database and the privacy units of some."""
        found = catalog.schema(self.spark, db)
        by_name = {t.lower(): t for t in found}
        for table, column in (privacy_unit_columns or {}).items():
            if table.lower() not in by_name:
                raise EngineError(f"table {table} does not exist")
            if column.lower() not in {c.lower() for c in found[by_name[table.lower()]]}:
                raise EngineError(f"column {column} does not exist in {table}")
        self.db_schema[db] = found
        self.privacy_unit_columns |= {(db, t): c for t, c in (privacy_unit_columns or {}).items()}

    def analyze(self, sql: str) -> Query:
        return Parser(sql, self.privacy_unit_columns, self.spark.catalog.currentDatabase(), self.strict).parse()

    def execute_query(self, sql: str, dpparams: DPParams | None = None, temporary_table_name: str | None = None) -> DataFrame:
        query = self.analyze(sql)
        if (dpparams is not None) == bool(query.options):
            raise InvalidPrivacyParametersError("give parameters either as an argument or in OPTIONS")
        if dpparams is None:
            o = query.options
            dpparams = DPParams(int(o["CONTRIBUTION_BOUND"]), [a.clip() for a in query.aggregates], int(o.get("MIN_FREQUENCY", 1)), o["EPSILON"], o["DELTA"], accountant_class=None)
        view = None if temporary_table_name is None else self._view_name(temporary_table_name)
        if not self.accountant.check_budget(query.aggregates, dpparams):
            raise InsufficientPrivacyBudgetError("the privacy budget does not suffice")
        check_text(query.inner_sql)
        check_relations(self.spark, query.inner_sql, query.relations)
        try:
            inner = self.spark.sql(query.inner_sql)
        except Exception as e:
            raise ExecutionBackendError("the query could not be analysed", cause=e) from None
        known = {c.lower(): c for c in inner.columns}
        for c in [*query.keys, *[c for a in query.aggregates for c in a.columns if c != "*"], query.unit]:
            if c.lower() not in known:
                raise ValidationError(f"column {c} does not exist")
        out = release(inner, query.unit, query.items, query.keys, dpparams, query.order, query.limit, query.offset, self.mode, self.enforce_global_min_frequency)
        self.accountant.update_budget(query.aggregates, dpparams)  # the noise is drawn
        if view:
            out.createTempView(view)
        return out

    def get_db_schema(self, db: str | None = None) -> dict[str, list[str]]:
        """Tables of a database with their columns."""
        return dict(catalog.schema(self.spark, db))

    def _view_name(self, name: str) -> str:
        """The view's name; temp.x and global_temp.x name plain views too."""
        if "." in name:
            space, _, name = name.partition(".")
            if space.lower() not in ("temp", "global_temp"):
                raise ValidationError("a temporary table is no part of a database")
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValidationError("a temporary table needs a plain name")
        if self.spark.catalog.tableExists(name):
            raise ValidationError(f"table {name} exists")
        return name
