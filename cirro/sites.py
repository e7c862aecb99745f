"""Sites, instruments, collections of sites, and their configuration files."""

from __future__ import annotations

import os
import re
import zoneinfo
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro import registry
from cirro.errors import EngineError

_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


@dataclass(frozen=True)
class Instrument:
    name: str
    variables: tuple[str, ...]
    height: float
    roughness: float | None = None

    def __post_init__(self):
        unknown = [v for v in self.variables if v not in registry.variables()]
        if unknown or not self.variables:
            raise EngineError("bad_instrument", f"{self.name}: unknown variables {unknown}" if unknown else f"{self.name} measures nothing")
        if any(v.startswith("wind_speed") for v in self.variables) and self.roughness is None:
            raise EngineError("bad_instrument", f"{self.name}: a wind instrument needs a roughness length")


@dataclass(frozen=True)
class Site:
    site_id: str
    latitude: float
    longitude: float
    elevation: float
    timezone: str
    store_root: str = ""
    instruments: tuple[Instrument, ...] = ()
    sources: dict[str, dict] = field(default_factory=dict)
    resolved: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        problems = [
            (not _ID.fullmatch(self.site_id or ""), f"id {self.site_id!r}"),
            (not -90 <= self.latitude <= 90, f"latitude {self.latitude}"),
            (not -180 <= self.longitude <= 180, f"longitude {self.longitude}"),
            (not -500 <= self.elevation <= 9000, f"elevation {self.elevation}"),
        ]
        try:
            zoneinfo.ZoneInfo(self.timezone)
        except (KeyError, ValueError, OSError):
            problems.append((True, f"time zone {self.timezone!r}"))
        bad = [what for wrong, what in problems if wrong]
        if bad:
            raise EngineError("bad_site", ", ".join(bad))

    @property
    def coords(self) -> dict[str, float]:
        return {"latitude": self.latitude, "longitude": self.longitude, "elevation": self.elevation}

    @property
    def roughness(self) -> dict[str, float | None]:
        return {i.name: i.roughness for i in self.instruments}

    def instrument_for(self, variable: str) -> Instrument | None:
        return next((i for i in self.instruments if variable in i.variables), None)

    def get_resolved(self, *path: str) -> Any:
        """The whole cache, or the value at a nested path; None where there is none."""
        node: Any = self.resolved
        for key in path:
            node = node.get(key) if isinstance(node, dict) else None
        return node

    def set_resolved(self, path: Iterable[str], value: Any) -> Site:
        """A new site with the value at the path; this one stays as it is."""
        first, *rest = path

        def put(node: Any, keys: list[str]) -> dict:
            own = dict(node) if isinstance(node, dict) else {}
            own[keys[0]] = value if len(keys) == 1 else put(own.get(keys[0]), keys[1:])
            return own

        return replace(self, resolved=put(self.resolved, [first, *rest]))


class Sites:
    """A collection with unique ids."""

    def __init__(self, sites: Iterable[Site]):
        self._by_id = {}
        for s in sites:
            if s.site_id in self._by_id:
                raise EngineError("duplicate_site", s.site_id)
            self._by_id[s.site_id] = s

    def __iter__(self) -> Iterator[Site]:
        return iter(self._by_id.values())

    def __len__(self) -> int:
        return len(self._by_id)

    def __getitem__(self, site_id: str) -> Site:
        return self._by_id[site_id]

    @property
    def ids(self) -> list[str]:
        return list(self._by_id)

    def dimension(self, spark: SparkSession) -> DataFrame:
        """site_id, latitude, longitude, elevation, timezone; a configured handful, so joins broadcast it."""
        rows = [(s.site_id, float(s.latitude), float(s.longitude), float(s.elevation), s.timezone) for s in self]
        return spark.createDataFrame(rows, "site_id string, latitude double, longitude double, elevation double, timezone string")


def as_sites(x: Site | Sites | Iterable[Site]) -> Sites:
    return x if isinstance(x, Sites) else Sites([x] if isinstance(x, Site) else x)


_SITE_KEYS = {"site_id", "latitude", "longitude", "elevation", "timezone", "store_root", "instruments", "sources", "resolved"}
_INSTRUMENT_KEYS = {"name", "variables", "height", "roughness"}
_SECRET_KEYS = {"token", "api_key", "password", "secret", "key"}


def check_no_inline_secrets(node: Any, at: str = "") -> None:
    """Keys that name a secret must name where it is kept instead: they end in _env or _keyring."""
    if isinstance(node, dict):
        for k, v in node.items():
            low = str(k).lower()
            if not low.endswith(("_env", "_keyring")) and (low in _SECRET_KEYS or any(low.endswith("_" + s) for s in _SECRET_KEYS)) and isinstance(v, str):
                raise EngineError("inline_secret", f"{at}{k}")
            check_no_inline_secrets(v, f"{at}{k}.")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            check_no_inline_secrets(v, f"{at}{i}.")


def _known(spec: dict, allowed: set[str], what: str) -> dict:
    more = sorted(set(spec) - allowed)
    if more:
        raise EngineError("unknown_key", f"{what}: {', '.join(more)}")
    return spec


def site_from_spec(spec: dict) -> Site:
    _known(spec, _SITE_KEYS, "site")
    check_no_inline_secrets(spec.get("sources", {}))
    own = [Instrument(**(_known(i, _INSTRUMENT_KEYS, "instrument") | {"variables": tuple(i["variables"])})) for i in spec.get("instruments") or []]
    return Site(**(spec | {"instruments": tuple(own), "sources": spec.get("sources") or {}, "resolved": spec.get("resolved") or {}}))


def read_sites_yaml(path: str) -> Sites:
    import yaml

    with open(path) as f:
        spec = yaml.safe_load(f) or {}
    _known(spec, {"sites"}, "file")
    return Sites(map(site_from_spec, spec.get("sites") or []))


def write_sites_yaml(sites: Sites | Site, path: str, include_resolved: bool = True) -> None:
    import yaml

    out = []
    for s in as_sites(sites):
        spec = {k: getattr(s, k) for k in ("site_id", "latitude", "longitude", "elevation", "timezone", "store_root")}
        spec["instruments"] = [{"name": i.name, "variables": list(i.variables), "height": i.height, "roughness": i.roughness} for i in s.instruments]
        spec["sources"] = s.sources
        if include_resolved and s.resolved:
            spec["resolved"] = s.resolved
        out.append(spec)
    with open(path, "w") as f:
        yaml.safe_dump({"sites": out}, f, sort_keys=False)


def read_deployment_config(path: str) -> dict:
    """store_root, sites_file, refetch_windows (periods become timedeltas), adapter_defaults, sources."""
    import yaml

    with open(path) as f:
        spec = yaml.safe_load(f) or {}
    _known(spec, {"store_root", "sites_file", "refetch_windows", "adapter_defaults", "sources"}, "deployment")
    check_no_inline_secrets(spec)
    return spec | {"refetch_windows": {k: registry.parse_period(v) for k, v in (spec.get("refetch_windows") or {}).items()}}


def resolve_secret(name: str | None) -> str | None:
    """The value of an environment variable; None for no name."""
    if not name:
        return None
    if name not in os.environ:
        raise EngineError("missing_secret", name)
    return os.environ[name]


def redact(text: str, secrets: Iterable[str | None]) -> str:
    return reduce(lambda t, s: t.replace(s, "***") if s else t, secrets, text)


def assert_no_secrets_in(df: DataFrame, secrets: Iterable[str]) -> DataFrame:
    """df, unless a string column holds a secret's value."""
    text = [c for c, t in df.dtypes if t == "string"]
    found = [F.col(c).contains(s) for c in text for s in secrets if s]
    if found and not df.where(reduce(or_, found)).isEmpty():
        raise EngineError("secret_in_data")
    return df
