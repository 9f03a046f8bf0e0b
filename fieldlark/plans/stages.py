"""Named stages in order, each cached by the digest of what it reads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

StageFn = Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]


def deep_merge(base: Mapping, overlay: Mapping) -> dict:
    """Nested overlay; lists and scalars replace."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def config_digest(config: Mapping, keys: Sequence[str]) -> str:
    """sha1 of the canonical JSON of the named subtrees."""
    return hashlib.sha1(json.dumps({k: config.get(k) for k in sorted(keys)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    name: str
    run: StageFn
    reads: tuple[str, ...] = ()
    version: str = "1"
    config_keys: tuple[str, ...] = ()


@dataclass
class Report:
    ran: list[str] = field(default_factory=list)
    cached: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


class Pipeline:
    """Stages that read each other's tables; results are Parquet folders named by digest."""

    def __init__(self, stages: Sequence[Stage], folder: str, config: Mapping | None = None):
        self.stages, self.folder, self.config = {s.name: s for s in stages}, folder, config or {}
        if len(self.stages) != len(stages):
            raise ValueError("two stages have one name")

    def between(self, first: str | None = None, last: str | None = None) -> list[str]:
        """The stages from one to another, both included."""
        names = list(self.stages)
        a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
        return names[a : b + 1]

    def digest(self, name: str, inputs: Mapping[str, str]) -> str:
        s = self.stages[name]
        parts = [name, s.version, config_digest(self.config, s.config_keys), *sorted(self.digest(r, inputs) if r in self.stages else inputs[r] for r in s.reads)]
        return hashlib.sha1("|".join(parts).encode()).hexdigest()

    def run(self, spark: SparkSession, inputs: Mapping[str, DataFrame], versions: Mapping[str, str], names: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], Report]:
        """Tables of the stages that ran or were there; a failed stage fails those that read it, no others."""
        tables, report = dict(inputs), Report()
        for name in names or list(self.stages):
            s = self.stages[name]
            if gone := [r for r in s.reads if r not in tables]:
                report.failed[name] = f"no {', '.join(gone)}"
                continue
            path = f"{self.folder}/{name}-{self.digest(name, versions)[:16]}"
            try:
                if _done(spark, path):
                    report.cached.append(name)
                else:
                    s.run(spark, {r: tables[r] for r in s.reads}).write.mode("overwrite").parquet(path)
                    report.ran.append(name)
                tables[name] = spark.read.parquet(path)
            except Exception as e:  # noqa: BLE001  a stage's failure is part of the report
                report.failed[name] = f"{type(e).__name__}: {e}"[:500]
        return tables, report


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
