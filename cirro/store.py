"""The store: observations with transaction time, immutable forecasts, logs, calibrations, reports, watermarks.

Tables are hive-partitioned Parquet below one root. All paths go through Hadoop's file system API, so a
root may be in any store that Spark reads. Supersede rewrites only partitions that change: new files
are written beside the table and moved in by dynamic partition overwrite.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro import schema
from cirro.errors import EngineError
from cirro.operators.reshape import newest_per_key

TABLES = {"observations": ("site_id", "year"), "forecasts": ("source", "site_id", "issue_date"), "forecast_aux": ("source", "site_id", "issue_date"), "qc_log": ("site_id",), "obs_transport": ("site_id",), "verification": ("site_id",), "verification_diagnostics": ("site_id",)}
_WITH = lambda s, *more: T.StructType([*s.fields, *[T.StructField(n, t) for n, t in more]])
SCHEMAS = {
    "observations": _WITH(schema.STORED_OBS, ("year", T.IntegerType())),
    "forecasts": _WITH(schema.FORECAST, ("issue_date", T.DateType())),
    "forecast_aux": _WITH(schema.AUX, ("issue_date", T.DateType())),
    "qc_log": _WITH(schema.QC_LOG, ("logged_at", T.TimestampType())),
    "obs_transport": _WITH(schema.TRANSPORT, ("ingested_at", T.TimestampType())),
    "verification": schema.REPORT,
    "verification_diagnostics": schema.DIAGNOSTICS,
}


def supersede(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Rows of current and incoming observations after an upsert, with action: kept, superseded, new or unchanged (incoming that changes nothing).

    current: stored rows with ingested_at, superseded. One full outer join on the null-safe key with the current versions;
    history passes by. Equal value (nulls are equal), flag and method mean unchanged.
    """
    sup = F.coalesce("superseded", F.lit(False))
    live = current.where(~sup)
    a = live.select(*[F.col(c).alias(f"a_{c}") for c in live.columns], F.lit(True).alias("_a"))
    b = incoming.select(*schema.OBS.names, F.lit(True).alias("_b"))
    on = [F.col(f"a_{c}").eqNullSafe(F.col(c)) for c in schema.OBS_KEY]
    j = a.join(b, on, "full_outer")
    same = F.col("a_value").eqNullSafe(F.col("value")) & F.col("a_qc_flag").eqNullSafe(F.col("qc_flag")) & F.col("a_method").eqNullSafe(F.col("method"))
    old = F.struct(*[F.col(f"a_{c}").alias(c) for c in schema.OBS.names], F.col("a_ingested_at").alias("ingested_at"))
    new = F.struct(*schema.OBS.names, now.cast("timestamp").alias("ingested_at"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    entry = lambda r, s, what: F.struct(r.alias("r"), F.lit(s).alias("superseded"), F.lit(what).alias("action"))
    out = F.when(both & same, F.array(entry(old, False, "unchanged"))).when(both, F.array(entry(old, True, "superseded"), entry(new, False, "new"))).when(F.col("_b").isNull(), F.array(entry(old, False, "kept"))).otherwise(F.array(entry(new, False, "new")))
    merged = j.select(F.explode(out).alias("e")).select("e.r.*", "e.superseded", "e.action")
    history = current.where(sup).select(*schema.OBS.names, "ingested_at", F.lit(True).alias("superseded"), F.lit("kept").alias("action"))
    return merged.unionByName(history)


def as_of(stored: DataFrame, time: Column) -> DataFrame:
    """What was known at a time: of rows ingested by then the newest of each key, superseded or not."""
    known = stored.where(F.col("ingested_at") <= time)
    return newest_per_key(known, schema.OBS_KEY, [F.col("ingested_at"), F.col("value"), F.col("qc_flag"), F.col("method")])


def new_rows(incoming: DataFrame, stored: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Incoming rows whose null-safe key isn't stored yet."""
    have = stored.select(*[F.col(c).alias(f"_h_{c}") for c in key])
    return incoming.join(have, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in key], "left_anti")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which executors share; on one machine a temporary one where that is unset. It goes with the session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/cirro-store-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files
    def path(self, table: str) -> str:
        if table not in TABLES:
            raise EngineError("unknown_table", table)
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _read_text(self, path: str) -> str | None:
        p, fs = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        """Through a temporary file in the same folder and a rename over the old one: readers see the one or the other."""
        p, fs = self._fs(path)
        tmp, _ = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context.rename(tmp, p, over)

    # reads
    def table(self, table: str) -> DataFrame:
        path, spec = self.path(table), SCHEMAS[table]
        return self.spark.read.schema(spec).parquet(path) if self.exists(path) else self.spark.createDataFrame([], spec)

    def read_obs(self, site_id: str | list[str] | None = None, variables: list[str] | None = None, start=None, end=None, include_superseded: bool = False, at=None) -> DataFrame:
        """Observations in [start, end]; sites and years prune partitions, the rest is pushed to the files. at: as of that ingestion time."""
        df = self.table("observations")
        if site_id is not None:
            df = df.where(F.col("site_id").isin([site_id] if isinstance(site_id, str) else site_id))
        if start is not None:
            df = df.where((F.col("year") >= start.year) & (F.col("datetime_utc") >= F.lit(start)))
        if end is not None:
            df = df.where((F.col("year") <= end.year) & (F.col("datetime_utc") <= F.lit(end)))
        if variables is not None:
            df = df.where(F.col("variable").isin(variables))
        if at is not None:
            df = as_of(df, F.lit(at))
        elif not include_superseded:
            df = df.where(~F.coalesce("superseded", F.lit(False)))
        return df.select(*(schema.STORED_OBS.names if include_superseded else schema.OBS.names))

    def _read_forecast_like(self, table: str, site_id, source, issue_from, issue_to, valid_from, valid_to) -> DataFrame:
        df = self.table(table)
        for column, want in (("site_id", site_id), ("source", source)):
            if want is not None:
                df = df.where(F.col(column).isin([want] if isinstance(want, str) else list(want)))
        if issue_from is not None:
            df = df.where((F.col("issue_date") >= F.lit(issue_from.date())) & (F.col("issue_time") >= F.lit(issue_from)))
        if issue_to is not None:
            df = df.where((F.col("issue_date") <= F.lit(issue_to.date())) & (F.col("issue_time") <= F.lit(issue_to)))
        if valid_from is not None:
            df = df.where(F.col("valid_time") >= F.lit(valid_from))
        if valid_to is not None:
            df = df.where(F.col("valid_time") <= F.lit(valid_to))
        return df

    def read_forecast(self, site_id=None, source=None, issue_from=None, issue_to=None, valid_from=None, valid_to=None, members: bool = True) -> DataFrame:
        df = self._read_forecast_like("forecasts", site_id, source, issue_from, issue_to, valid_from, valid_to)
        return (df if members else df.where("member is null")).select(*schema.FORECAST.names)

    def read_forecast_aux(self, site_id=None, source=None, issue_from=None, issue_to=None, valid_from=None, valid_to=None) -> DataFrame:
        return self._read_forecast_like("forecast_aux", site_id, source, issue_from, issue_to, valid_from, valid_to).select(*schema.AUX.names)

    def read_qc_log(self, site_id: str | None = None) -> DataFrame:
        df = self.table("qc_log") if site_id is None else self.table("qc_log").where(F.col("site_id") == site_id)
        return newest_per_key(df, schema.QC_LOG_KEY, [F.col("logged_at"), F.col("outcome"), F.col("detail")]).select(*schema.QC_LOG.names).orderBy("datetime_utc", "variable", "rule")

    def read_transport(self, site_id: str | None = None, start=None, end=None) -> DataFrame:
        df = self.table("obs_transport")
        for cond in ((F.col("site_id") == site_id) if site_id else None, (F.col("datetime_utc") >= F.lit(start)) if start else None, (F.col("datetime_utc") <= F.lit(end)) if end else None):
            df = df if cond is None else df.where(cond)
        return newest_per_key(df, schema.TRANSPORT_KEY, [F.col("ingested_at"), F.col("transport")]).select(*schema.TRANSPORT.names).orderBy("datetime_utc", "variable", "source")

    def read_report(self, site_id: str | None = None) -> DataFrame:
        df = self.table("verification").select(*schema.REPORT.names)
        return df if site_id is None else df.where(F.col("site_id") == site_id)

    def read_diagnostics(self, site_id: str | None = None) -> DataFrame:
        df = self.table("verification_diagnostics").select(*schema.DIAGNOSTICS.names)
        return df if site_id is None else df.where(F.col("site_id") == site_id)

    def connect(self) -> SparkSession:
        """A view for each table, with superseded and ingested_at; then spark.sql()."""
        for t in TABLES:
            self.table(t).createOrReplaceTempView(t)
        return self.spark

    # writes
    def _append(self, df: DataFrame, table: str) -> None:
        df.select(*SCHEMAS[table].names).write.partitionBy(*TABLES[table]).mode("append").parquet(self.path(table))

    def _replace_partitions(self, df: DataFrame, table: str) -> None:
        """Overwrites the partitions that df has, and only those. df is written beside the table first: it may read from there."""
        side = f"{self.root}/_side/{uuid.uuid4().hex}"
        names = SCHEMAS[table].names
        df.select(*names).write.parquet(side)
        self.spark.read.schema(SCHEMAS[table]).parquet(side).write.partitionBy(*TABLES[table]).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(table))
        p, fs = self._fs(side)
        fs.delete(p, True)

    def write_obs(self, obs: DataFrame, now: dt.datetime, mode: str = "append", check: bool = True) -> dict[str, int]:
        """append: blindly. supersede: changed rows replace the current ones, which stay as history; returns counts by action."""
        if mode not in ("append", "supersede"):
            raise EngineError("bad_mode", mode)
        obs = schema.new_obs(obs, check)
        if mode == "append":
            stamped = obs.withColumns({"ingested_at": F.lit(now).cast("timestamp"), "superseded": F.lit(False), "year": F.year("datetime_utc")})
            self._append(stamped, "observations")
            return {}
        parts = obs.select("site_id", F.year("datetime_utc").alias("year")).distinct()
        # a row for each touched site and year: the configured sites times the years of one batch
        touched = self.table("observations").join(F.broadcast(parts), ["site_id", "year"], "left_semi") if self.exists(self.path("observations")) else self.table("observations")
        merged = supersede(touched, obs, F.lit(now)).withColumn("year", F.year("datetime_utc"))
        side = f"{self.root}/_side/{uuid.uuid4().hex}"
        merged.write.parquet(side)
        merged = self.spark.read.parquet(side)
        counts = {r["action"]: r["count"] for r in merged.groupBy("action").count().collect()}
        if counts.get("new") or counts.get("superseded"):
            changed = merged.where(F.col("action").isin("new", "superseded")).select("site_id", "year").distinct()
            dirty = merged.join(changed, ["site_id", "year"], "left_semi")
            dirty.select(*SCHEMAS["observations"].names).write.partitionBy("site_id", "year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path("observations"))
        p, fs = self._fs(side)
        fs.delete(p, True)
        return {"n_new": counts.get("new", 0) - counts.get("superseded", 0), "n_superseded": counts.get("superseded", 0), "n_unchanged": counts.get("unchanged", 0)}

    def write_forecast(self, fc: DataFrame, check: bool = True) -> int:
        """Adds rows whose key isn't archived; archived ones never change. Returns how many were added."""
        return self._write_new(schema.new_forecast(fc, check), "forecasts", schema.FORECAST_KEY)

    def write_forecast_aux(self, aux: DataFrame, check: bool = True) -> int:
        return self._write_new(schema.new_forecast_aux(aux, check), "forecast_aux", schema.AUX_KEY)

    def _write_new(self, df: DataFrame, table: str, key: tuple[str, ...]) -> int:
        dated = df.withColumn("issue_date", F.to_date("issue_time"))
        have = self.table(table)
        bounds = dated.agg(F.min("issue_date"), F.max("issue_date")).first()
        if bounds[0] is None:
            return 0
        have = have.where(F.col("issue_date").between(*map(F.lit, bounds)))  # only partitions that the batch can meet
        side = f"{self.root}/_side/{uuid.uuid4().hex}"
        new_rows(dated, have, key).write.parquet(side)
        fresh = self.spark.read.schema(SCHEMAS[table]).parquet(side)
        n = fresh.count()
        if n:
            self._append(fresh, table)
        p, fs = self._fs(side)
        fs.delete(p, True)
        return n

    def write_qc_log(self, log: DataFrame, now: dt.datetime) -> None:
        self._append(log.withColumn("logged_at", F.lit(now).cast("timestamp")), "qc_log")

    def write_transport(self, rows: DataFrame, now: dt.datetime) -> None:
        self._append(rows.withColumn("ingested_at", F.lit(now).cast("timestamp")), "obs_transport")

    def write_report(self, report: DataFrame, sites: list[str] | None = None) -> None:
        """Replaces the report of every site that it has, and of those named: one that has no rows loses its old ones."""
        self._replace_partitions(report, "verification")
        if sites:
            for site_id in set(sites) - {r["site_id"] for r in report.select("site_id").where(F.col("site_id").isin(sites)).distinct().collect()}:
                p, fs = self._fs(f"{self.path('verification')}/site_id={quote(site_id, safe='')}")
                fs.delete(p, True)

    @contextmanager
    def side(self, df: DataFrame) -> Iterator[DataFrame]:
        """df, written once beside the tables and removed afterwards, whatever happens."""
        path = f"{self.root}/_side/{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            p, fs = self._fs(path)
            fs.delete(p, True)

    def write_diagnostics(self, rows: DataFrame) -> None:
        self._replace_partitions(rows, "verification_diagnostics")

    def compact(self, tables: list[str] | None = None) -> dict[str, int]:
        """Rewrites partitions of more than one file as one; returns how many of each table."""
        out = {}
        for t in tables or list(TABLES):
            path = self.path(t)
            if not self.exists(path):
                continue
            cols = list(TABLES[t])
            files = self.table(t).select(*cols, F.input_file_name().alias("_f")).groupBy(*cols).agg(F.count_distinct("_f").alias("n")).where("n > 1").drop("n")
            many = files.count()
            if many:
                left = self.table(t)
                same = files.select(*[F.col(c).alias(f"_p_{c}") for c in cols])
                df = left.join(F.broadcast(same), [left[c].eqNullSafe(F.col(f"_p_{c}")) for c in cols], "left_semi")  # a row for each partition
                self._replace_partitions(df.repartition(*cols), t)
            out[t] = many
        return out

    # calibrations: a manifest and a coefficient file for each version
    def _calib(self, site_id: str) -> str:
        return f"{self.root}/calibrations/site_id={quote(site_id, safe='')}"

    def manifest(self, site_id: str) -> list[dict]:
        text = self._read_text(f"{self._calib(site_id)}/manifest.json")
        return json.loads(text) if text else []

    def write_calibration(self, site_id: str, variable: str, source: str, tier: str, coefficients: DataFrame, meta: dict, now: dt.datetime) -> int:
        rows = self.manifest(site_id)
        version = 1 + max((r["version"] for r in rows if (r["variable"], r["source"]) == (variable, source)), default=0)
        path = f"{variable}-{source}-v{version}.parquet"
        coefficients.coalesce(1).write.mode("overwrite").parquet(f"{self._calib(site_id)}/{path}")
        entry = {"variable": variable, "source": source, "version": version, "tier": tier, "fit_date": now.isoformat(), "path": path} | {k: meta.get(k) for k in ("train_start", "train_end", "n_pairs", "lead_bucket")}
        self._write_text(f"{self._calib(site_id)}/manifest.json", json.dumps([*rows, entry], default=str))
        return version

    def read_calibration(self, site_id: str, variable: str, source: str, version: int | str = "current") -> tuple[dict, DataFrame]:
        rows = [r for r in self.manifest(site_id) if (r["variable"], r["source"]) == (variable, source) and version in ("current", r["version"])]
        if not rows:
            raise EngineError("calib_not_found", f"{site_id} {variable} {source} {version}")
        entry = max(rows, key=lambda r: r["version"])
        return entry, self.spark.read.parquet(f"{self._calib(site_id)}/{entry['path']}")

    # watermarks
    def _marks(self, site_id: str) -> str:
        return f"{self.root}/watermarks/site_id={quote(site_id, safe='')}/watermarks.json"

    def watermark(self, site_id: str, table: str, source: str = "") -> dt.datetime | None:
        for r in json.loads(self._read_text(self._marks(site_id)) or "[]"):
            if (r["table"], r["source"]) == (table, source):
                return dt.datetime.fromisoformat(r["watermark"])
        return None

    def set_watermark(self, site_id: str, table: str, time: dt.datetime, source: str = "") -> None:
        rows = [r for r in json.loads(self._read_text(self._marks(site_id)) or "[]") if (r["table"], r["source"]) != (table, source)]
        self._write_text(self._marks(site_id), json.dumps([*rows, {"table": table, "source": source, "watermark": time.isoformat()}]))

    def fetch_window(self, site_id: str, table: str, source: str, refetch: dt.timedelta, now: dt.datetime) -> tuple[dt.datetime | None, dt.datetime]:
        mark = self.watermark(site_id, table, source)
        return (None if mark is None else mark - refetch), now
