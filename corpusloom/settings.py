"""Settings of an application on this engine: typed, checked, read from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from corpusloom.operators.matching import WEIGHTS, check_weights

PREFIX = "spark.corpusloom."


@dataclass(frozen=True)
class Settings:
    """max_upload_mb 1 to 25; the four match weights add up to 1."""

    max_upload_mb: int = 5
    lexicons: str = ""
    artifacts: str = ""
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def __post_init__(self) -> None:
        if not 1 <= self.max_upload_mb <= 25:
            raise ValueError("max_upload_mb must be 1 to 25")
        check_weights(self.weights)


def read(spark: SparkSession, prefix: str = PREFIX) -> Settings:
    """Settings from `<prefix><name>` and `<prefix>weight.<part>`; what is unset keeps its default."""
    get = lambda name: spark.conf.get(prefix + name, None)
    given = {f.name: type(f.default)(v) for f in fields(Settings) if f.name != "weights" and (v := get(f.name)) is not None}
    weights = {k: float(get(f"weight.{k}") or v) for k, v in WEIGHTS.items()}
    return Settings(**given, weights=weights)
