"""Settings of the linkage plans, from Spark's configuration or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """``checkpoint_dir`` is required on a cluster; ``lookup_limit`` 0 means no limit."""

    checkpoint_dir: str = ""
    org_code: str = "DG"
    status: str = "ACTIVE"
    lookup_limit: int = 0

    @classmethod
    def of(cls, spark: SparkSession, env: dict[str, str] | None = None) -> Settings:
        """``spark.weftwise.NAME`` first, then ``WEFTWISE_NAME``, then the default; a missing required one is an error."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.weftwise.{f.name}", None) or env.get(f"WEFTWISE_{f.name.upper()}")
            if f.name == "checkpoint_dir" and not raw:
                raw = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if raw:
                found[f.name] = int(raw) if f.type == "int" else raw
        made = cls(**found)
        if not made.checkpoint_dir and not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        return made

    @property
    def limit(self) -> int | None:
        return self.lookup_limit or None
