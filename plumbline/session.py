"""A set of tables under one name: SQL, joins, and saving to a shared folder."""

from __future__ import annotations

import secrets
import string
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .functions import guard
from .functions.clean import field_type
from .functions.stages import new_path
from .operators import boost, learn, prep, relate
from .sources.appends import AppendLog
from .sources.files import hadoop_path, read_json, write_json
from .sources.readers import insert_rows, read_table, stem, table_name, typed_columns
from .table import Table

_KEY_LETTERS = string.ascii_lowercase + string.digits


def new_key() -> str:
    return "s_" + "".join(secrets.choice(_KEY_LETTERS) for _ in range(6))


class Session:
    def __init__(self, spark: SparkSession, key: str | None = None, folder: str | None = None) -> None:
        self.spark = spark
        self.key = key
        self.folder = folder
        self._tables: dict[str, Table] = {}
        self._version: dict[str, int] = {}
        self._logs: dict[str, AppendLog] = {}

    # --- building -----------------------------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, paths: str | Sequence[str]) -> "Session":
        """A session over one or more CSV or Parquet tables, not saved anywhere."""
        session = cls(spark)
        for path in [paths] if isinstance(paths, str) else paths:
            session.add_table(path)
        if not session._tables:
            raise ValueError("At least one path is needed.")
        return session

    @classmethod
    def create(cls, spark: SparkSession, paths: Sequence[str], base: str, key: str | None = None) -> "Session":
        session = cls.load(spark, paths)
        session.key = key or new_key()
        session.folder = f"{base.rstrip('/')}/sessions/{session.key}"
        session.save()
        return session

    @classmethod
    def open(cls, spark: SparkSession, key: str, base: str) -> "Session":
        folder = f"{base.rstrip('/')}/sessions/{key}"
        meta = read_json(spark, f"{folder}/meta.json")
        if not meta or "tables" not in meta:
            raise FileNotFoundError(f"There is no session {key!r} under {base}.")
        session = cls(spark, key, folder)
        for name, info in meta["tables"].items():
            if info.get("log"):
                log = AppendLog.open(spark, f"{folder}/tables/{name}/{info['log']}", info["log_version"])
                table = session._add(name, log.frame(), info.get("key"))
                session._logs[name] = log
                if log.is_newest():  # else rows were added and never saved: inserts go on from what was
                    session._logged(table, log)
            else:
                table = session._add(name, spark.read.parquet(f"{folder}/tables/{name}/v{info['version']}"), info.get("key"))
            table._types = dict(info.get("types", {}))
            table.derived = set(info.get("derived", []))
            session._version[name] = info["version"]
            for model in info.get("models", []):
                session.load_model(table, model)
        return session

    @staticmethod
    def list(spark: SparkSession, base: str) -> list[str]:
        root = hadoop_path(spark, f"{base.rstrip('/')}/sessions")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.getName() for p in found if fs.exists(hadoop_path(spark, f"{p}/meta.json")))

    def _add(self, name: str, df: DataFrame, key: Sequence[str] | None = None) -> Table:
        table = Table(name, df, self, key)
        self._tables[name] = table
        return table

    def add_table(self, source: str | DataFrame, name: str | None = None, key: Sequence[str] | None = None) -> Table:
        df = read_table(self.spark, source) if isinstance(source, str) else source
        raw = name or (stem(source) if isinstance(source, str) else "tbl")
        return self._add(table_name(raw, list(self._tables)), df, key)

    def create_table(self, name: str, columns: Sequence[tuple[str, str]] | None = None, select_sql: str | None = None) -> Table:
        if (columns is None) == (select_sql is None):
            raise ValueError("Give either columns (an empty table) or select_sql, not both.")
        name = table_name(name, list(self._tables))
        if columns is not None:
            log = AppendLog.new(self.spark, self._log_folder(name), typed_columns(list(columns)))
        else:
            rows = self.run_sql(select_sql)
            log = AppendLog.new(self.spark, self._log_folder(name), rows.schema)
            log.append(rows)
        return self._logged(self._add(name, log.frame()), log)

    def insert_into(self, name: str, source_sql: str, batch: str | None = None) -> dict[str, int]:
        """Append rows by column position; ``{inserted, n_rows}``.

        Rows are written once, as a part of their own. A ``batch`` name makes a repeated call harmless: the first one's
        count comes back and nothing is added. Rows that came before the first insert stay where they are.
        """
        table = self.table(name)
        source = insert_rows(table.df.limit(0), self.run_sql(source_sql))
        log = self._logs.get(name)
        if log is None or table.df is not log.seen:  # the rows were replaced since, or never came from a log
            schema = table.df.schema
            log = AppendLog.new(self.spark, self._log_folder(name), schema, base=table.df, batches=log.batches() if log else {})
        inserted = log.append(source, batch)
        types = dict(table._types) if not inserted else {}
        table.replace(log.frame())
        table._types = types
        self._logged(table, log)
        return {"inserted": inserted, "n_rows": log.count()}

    def _logged(self, table: Table, log: AppendLog) -> Table:
        log.seen = table.df
        self._logs[table.name] = log
        return table

    def _log_folder(self, name: str) -> str:
        return f"{self.folder}/tables/{name}/log-{uuid.uuid4().hex}" if self.folder else new_path(self.spark, f"log-{name}")

    # --- asking ---------------------------------------------------------------------------

    def table(self, name: str) -> Table:
        if name not in self._tables:
            raise KeyError(f"No table {name!r}; known: {self.tables}.")
        return self._tables[name]

    @property
    def tables(self) -> list[str]:
        return list(self._tables)

    def run_sql(self, query: str) -> DataFrame:
        """A read-only query; this session's tables, and no other's, are visible by their bare names."""
        return guard.run_query(self.spark, query, self._frames())

    def query(self, query: str, limit: int = 1000) -> dict[str, Any]:
        """First ``limit`` rows and whether there are more; only limit + 1 rows are fetched."""
        df = self.run_sql(query)
        rows = [r.asDict() for r in df.limit(limit + 1).collect()]
        more = len(rows) > limit
        return {"n_rows": df.count() if more else len(rows), "truncated": more, "rows": rows[:limit]}

    def _frames(self) -> dict[str, DataFrame]:
        return {n: t.df for n, t in self._tables.items()}

    def relationships(self) -> relate.Graph:
        return relate.find_edges(self._frames())

    def join(self, tables: Sequence[str], name: str | None = None, how: str = "left", by_evidence: bool = False) -> Table:
        graph = self.relationships()
        if by_evidence:
            graph = relate.ranked_by_evidence(graph)
        df = relate.join_tables(self._frames(), tables, graph, how)
        return self._add(table_name(name or "join_" + "_".join(tables), self.tables), df)

    def info(self) -> dict[str, Any]:
        lost = {n: t.unloaded_models for n, t in self._tables.items() if t.unloaded_models}
        out: dict[str, Any] = {"session_key": self.key, "tables": self.tables, "relationships": self.relationships()}
        return {**out, "unloaded_models": lost} if lost else out

    def __getattr__(self, name: str) -> Any:
        """With exactly one table, its analytics can be called on the session."""
        if name.startswith("_") or not (hasattr(Table, name) or any(name in vars(t) for t in self._tables.values())):
            raise AttributeError(name)
        if len(self._tables) != 1:
            raise ValueError(f"There are {len(self._tables)} tables; call session.table(name).{name}(…).")
        return getattr(next(iter(self._tables.values())), name)

    # --- saving -----------------------------------------------------------------------------

    def save(self) -> None:
        """Write every table as a new Parquet version, then switch the metadata to it in one rename.

        A table that only grew by inserts since it was made is in the folder already: its metadata names the log's version.
        """
        if self.folder is None:
            raise ValueError("This session has no folder; create it with Session.create.")
        for name, table in self._tables.items():
            if self._saved_log(name):
                continue
            version = self._version.get(name, 0) + 1
            path = f"{self.folder}/tables/{name}/v{version}"
            table.df.write.mode("overwrite").parquet(path)
            table.df = self.spark.read.schema(table.df.schema).parquet(path)
            self._version[name] = version
        self._write_meta()

    def _saved_log(self, name: str) -> AppendLog | None:
        log = self._logs.get(name)
        mine = log is not None and log.base is None and log.folder.startswith(f"{self.folder}/tables/")
        return log if mine and self._tables[name].df is log.seen else None

    def _write_meta(self) -> None:
        path = f"{self.folder}/meta.json"
        now = datetime.now(timezone.utc).isoformat()
        old = read_json(self.spark, path) or {}
        tables = {
            n: {"version": self._version.get(n, 1), "types": t._types, "derived": sorted(t.derived), "key": t.key,
                "models": sorted({*t.models, *t.unloaded_models})}
            for n, t in self._tables.items()
        }
        for n in tables:
            log = self._saved_log(n)
            if log:
                tables[n] |= {"log": log.folder.rsplit("/", 1)[1], "log_version": log.version}
        write_json(self.spark, path, {"session_id": self.key, "created_at": old.get("created_at") or now,
                                       "updated_at": now, "tables": tables})

    def _model_folder(self, table: str, model: str) -> str:
        return f"{self.folder}/models/{table}__{quote(model, safe='')}"

    def save_model(self, table: Table, name: str) -> None:
        if self.folder is None:
            raise ValueError("Models are saved in a session folder; create one with Session.create.")
        m = table.model(name)
        folder = self._model_folder(table.name, name)
        for i, c in enumerate(m.plan.levels):
            m.plan.levels[c].write.mode("overwrite").parquet(f"{folder}/levels/{i}")
        m.data.write.mode("overwrite").parquet(f"{folder}/data")
        kind = field_type(m.data, m.target)
        classes = self.spark.createDataFrame(
            list(enumerate(m.classes)), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("class", kind)]))
        classes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/classes")  # typed: dates and decimals come back as such
        write_json(self.spark, f"{folder}/model.json", {
            "target": m.target, "task": m.task, "algorithm": m.algorithm, "n_rows": m.n_rows,
            "numeric": m.roles.numeric, "nominal": m.roles.nominal, "ordinal": m.roles.ordinal,
            "medians": m.plan.medians, "modes": m.plan.modes, "sizes": m.plan.sizes, "levels": list(m.plan.levels),
            "booster": m.booster.to_json(),
        })
        self._write_meta()

    def load_model(self, table: Table, name: str) -> None:
        """Load a saved model; one that cannot be read is listed with the reason and tried again on use."""
        if self.folder is None:
            return
        folder = self._model_folder(table.name, name)
        try:
            info = read_json(self.spark, f"{folder}/model.json")
            if info is None:
                raise FileNotFoundError(f"no saved model {name!r}")
            roles = prep.Roles(*(tuple(info[k]) for k in ("numeric", "nominal", "ordinal")))
            levels = {c: self.spark.read.parquet(f"{folder}/levels/{i}") for i, c in enumerate(info["levels"])}
            plan = prep.Plan(roles, info["medians"], info["modes"], levels, info["sizes"])
            table.models[name] = learn.TrainedModel(
                plan, boost.Booster.from_json(info["booster"]), roles, info["target"], info["task"], info["algorithm"],
                [r["class"] for r in self.spark.read.parquet(f"{folder}/classes").orderBy("i").collect()],
                self.spark.read.parquet(f"{folder}/data"), info["n_rows"])
            table.unloaded_models.pop(name, None)
        except Exception as exc:
            table.unloaded_models[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
