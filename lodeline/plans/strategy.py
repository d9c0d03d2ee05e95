"""Which search mode fits a collection, by its size and the memory at hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("flat", "hnsw", "sq8", "pq", "ivf", "auto")
_ALIASES = {"scalar": "sq8", "product": "pq"}


@dataclass(frozen=True)
class AutoTunerConfig:
    available_ram_gb: float = 4.0
    threshold: int = 50_000
    low_ram_gb: float = 8.0


def mode_of(name: str) -> str:
    m = _ALIASES.get(name.lower(), name.lower())
    if m not in MODES:
        raise ValueError(f"unknown mode {name!r}: one of {', '.join(MODES)}, scalar, product")
    return m


def decide_mode(n: int, config: AutoTunerConfig = AutoTunerConfig()) -> str:
    """flat below the threshold, then sq8 with little memory, else hnsw."""
    if n < config.threshold:
        return "flat"
    return "sq8" if config.available_ram_gb < config.low_ram_gb else "hnsw"


def decide_mode_column(n: Column, ram_gb: Column, config: AutoTunerConfig = AutoTunerConfig()) -> Column:
    return F.when(n < config.threshold, F.lit("flat")).when(ram_gb < config.low_ram_gb, F.lit("sq8")).otherwise(F.lit("hnsw"))


def detect_ram_gb(path: str = "/proc/meminfo", fallback: float = 4.0) -> float:
    """Total memory of this machine."""
    try:
        with open(path) as f:
            for line in f:
                if line.startswith("MemTotal:"):
                    return int(line.split()[1]) / (1 << 20)
    except (OSError, ValueError, IndexError):
        pass
    return fallback
