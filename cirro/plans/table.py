"""The wide hourly table with its provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro import registry
from cirro.errors import EngineError, warn

UNVERIFIED = "unverified"
PROVENANCE = ("variable", "tier", "train_overlap", "source")
VERSIONS = ("schema", "manifest")


def column_hashes(df: DataFrame, time: str = "time") -> DataFrame:
    """variable, digest of each value column: an order-free sum of hashes of time and value, in one pass."""
    values = [c for c in df.columns if c != time]
    if not values:
        return df.sparkSession.createDataFrame([], "variable string, digest string")
    sums = df.agg(*[F.sum(F.xxhash64(time, c).cast("decimal(38,0)")).alias(c) for c in values])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("0")).alias("digest")) for c in values])).alias("e")).select("e.*")


class MetTable:
    """df: time and a column for each variable; provenance: a dict for each variable with tier, train_overlap (hours), source.

    Operations keep provenance where they can and lower it visibly, with a warning, where they can't.
    """

    def __init__(self, df: DataFrame, provenance: dict[str, dict], keys: dict | None = None, versions: dict | None = None, hashes: dict[str, str] | None = None):
        if "time" not in df.columns:
            raise EngineError("bad_ingest")
        missing = [c for c in df.columns if c != "time" and (c not in provenance or not {"tier", "train_overlap", "source"} <= set(provenance[c]))]
        if missing:
            raise EngineError("bad_provenance", ", ".join(missing))
        if versions is not None and not set(VERSIONS) <= set(versions):
            raise EngineError("bad_versions", ", ".join(VERSIONS))
        self.df, self.keys, self.versions = df, keys or {}, versions or dict.fromkeys(VERSIONS, 0)
        self.provenance = {c: provenance[c] for c in self.value_columns}
        self._hashes = hashes

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "time"]

    @property
    def content_hash(self) -> dict[str, str]:
        """Digest of each value column as the table was made; computed when first asked for."""
        if self._hashes is None:
            self._hashes = {r["variable"]: r["digest"] for r in column_hashes(self.df).collect()}
        return self._hashes

    def _with(self, df: DataFrame, provenance: dict | None = None) -> MetTable:
        return MetTable(df, provenance or self.provenance, self.keys, self.versions, self._hashes)

    def _checked(self) -> MetTable:
        """Before the hash is given up: a table that may have been changed since it was made is validated."""
        return self if self._hashes is None else self.validate()

    def filter(self, condition: Column | str) -> MetTable:
        own = self._checked()
        return MetTable(own.df.where(condition), own.provenance, own.keys, own.versions)

    def order_by(self, *columns: str | Column) -> MetTable:
        return self._with(self.df.orderBy(*columns))

    def with_column(self, name: str, value: Column) -> MetTable:
        """Provenance stays as it is, for it may have gone stale; validate() finds out. New columns are unverified."""
        self.content_hash  # noqa: B018  of the values before
        known = self.provenance | ({} if name in self.provenance or name == "time" else {name: {"tier": UNVERIFIED, "train_overlap": None, "source": None}})
        return self._with(self.df.withColumn(name, value), known)

    def select(self, *columns: str) -> MetTable | DataFrame:
        """A plain DataFrame, with a warning, if value columns or the time are lost."""
        lost = [c for c in self.df.columns if c not in columns]
        if lost:
            warn("tier_downgraded", f"without {', '.join(lost)} the table is plain data")
            return self.df.select(*columns)
        return self._with(self.df.select(*columns))

    def union(self, other: MetTable) -> MetTable:
        """Rows of both; variables whose tiers differ become unverified."""
        a, b = self._checked(), other._checked()
        prov = dict(b.provenance) | dict(a.provenance)
        for c in set(a.value_columns) & set(b.value_columns):
            if a.provenance[c]["tier"] != b.provenance[c]["tier"]:
                warn("tier_downgraded", f"{c}: {a.provenance[c]['tier']} and {b.provenance[c]['tier']}")
                prov[c] = prov[c] | {"tier": UNVERIFIED}
        return MetTable(a.df.unionByName(b.df, allowMissingColumns=True), prov, a.keys, a.versions)

    def validate(self) -> MetTable:
        """Columns whose values aren't those of the stored hash, or have none, become unverified."""
        now = {r["variable"]: r["digest"] for r in column_hashes(self.df).collect()}
        prov = {}
        for c in self.value_columns:
            same = self.content_hash.get(c) == now[c]
            if not same and self.provenance[c]["tier"] != UNVERIFIED:
                warn("content_changed", c)
            prov[c] = self.provenance[c] if same else self.provenance[c] | {"tier": UNVERIFIED}
        return MetTable(self.df, prov, self.keys, self.versions, now)

    def __repr__(self) -> str:
        rows = [f"# {c}: {p['tier']}, {p['source']}, trained on {p['train_overlap']} h" for c, p in self.provenance.items()]
        return "\n".join([f"# wide table {self.keys}", *rows, repr(self.df)])

    def show(self, n: int = 20) -> None:
        print("\n".join(repr(self).splitlines()[:-1]))
        self.df.show(n)


def ingest(x: MetTable | DataFrame) -> MetTable:
    """A table is validated; plain data need a time column and are unverified."""
    if isinstance(x, MetTable):
        return x.validate()
    if "time" not in x.columns:
        raise EngineError("bad_ingest")
    return MetTable(x, {c: {"tier": UNVERIFIED, "train_overlap": None, "source": None} for c in x.columns if c != "time"})


def assert_single_tier(table: MetTable, variables: list[str] | None = None) -> str | None:
    """The one tier of the variables; a warning and the lowest if there are several."""
    tiers = {table.provenance[v]["tier"] for v in variables or table.value_columns}
    if len(tiers) > 1:
        warn("mixed_tier", ", ".join(sorted(tiers)))
    return min(tiers, key=registry.tier_rank, default=None)
