"""Settings of a job, from defaults, a mapping or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JobConfig:
    """What the matching and describing jobs may be told."""

    reasoned: bool = False
    with_samples: bool = True
    prefilter: bool = True
    top_k: int = 5
    threshold: float = 0.25
    variants: int = 3
    model: str = "offline"
    server: str = ""
    embedding: str = "offline"
    head_rows: int = 0
    sample_rows: int = 0

    def __post_init__(self):
        if self.top_k < 1 or not -1 <= self.threshold <= 1 or self.variants < 1 or self.head_rows < 0 or self.sample_rows < 0:
            raise ValueError(f"settings out of range: {asdict(self)}")

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None, prefix: str = "REVIEWLOOM_") -> JobConfig:
        """From variables such as REVIEWLOOM_TOP_K; unknown ones are left alone."""
        env = os.environ if env is None else env
        read = {"bool": lambda s: s.strip().lower() in ("1", "true", "yes"), "int": int, "float": float, "str": str}
        return cls(**{f.name: read[f.type](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env})

    def test_rows(self, pairs: DataFrame) -> DataFrame:
        """the first or a fixed random choice of pairs, where a test mode is on."""
        order = ("source_file", "source_column", "target_column")
        if self.head_rows:
            return pairs.orderBy(*order).limit(self.head_rows)
        if self.sample_rows:
            return pairs.orderBy(F.xxhash64(*order), *order).limit(self.sample_rows)
        return pairs

    def run_name(self) -> str:
        """A name for outputs that tells the settings apart."""
        return "_".join([self.model.replace("/", "-"), "reasoned" if self.reasoned else "direct", "samples" if self.with_samples else "names", f"top{self.top_k}" if self.prefilter else "all"])
