"""Thread budgets: how many cores a local session uses, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Variables of the environment: all threads, and those of native numeric libraries in Python workers.
THREADS_VARIABLE = "TESSERA_THREADS"
NATIVE_VARIABLE = "TESSERA_NATIVE_THREADS"
#: What the numeric libraries read.
_NATIVE = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "NUMEXPR_NUM_THREADS", "ARROW_NUM_THREADS")


@dataclass(frozen=True)
class RuntimeThreadBudget:
    """``threads``: cores of a local master and shuffle partitions. ``native``: threads of each numeric library. None leaves the default."""

    threads: int | None = None
    native: int | None = None

    def __post_init__(self):
        for n in (self.threads, self.native):
            if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
                raise ValueError("a thread budget is an integer of 1 at least")

    def builder(self, builder: SparkSession.Builder | None = None) -> SparkSession.Builder:
        """A session builder with the budget. On a cluster the master's own settings rule and only the partitions are set."""
        builder = builder or SparkSession.builder
        if self.threads is not None:
            if not os.environ.get("SPARK_MASTER") and not os.environ.get("MASTER"):
                builder = builder.master(f"local[{self.threads}]")
            builder = builder.config("spark.default.parallelism", self.threads).config("spark.sql.shuffle.partitions", self.threads)
        for name in _NATIVE if self.native is not None else ():
            builder = builder.config(f"spark.executorEnv.{name}", self.native)
        return builder

    def apply_native(self) -> None:
        """Bound the driver's own numeric libraries; they read it when they are first imported."""
        for name in _NATIVE if self.native is not None else ():
            os.environ[name] = str(self.native)


def _positive(name: str) -> int | None:
    raw = os.environ.get(name, "").strip()
    if not raw:
        return None
    try:
        value = int(raw)
    except ValueError:
        raise ValueError(f"{name} is no integer: {raw!r}") from None
    if value < 1:
        raise ValueError(f"{name} must be 1 at least")
    return value


def configure_runtime_threads_from_env() -> RuntimeThreadBudget:
    """The budget that the environment gives, applied to the driver's numeric libraries."""
    budget = RuntimeThreadBudget(_positive(THREADS_VARIABLE), _positive(NATIVE_VARIABLE))
    budget.apply_native()
    return budget
