"""What is asked and what comes back: problems, assumptions, return codes, solutions, tolerances."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


class RetCode(str, enum.Enum):
    SUCCESS = "Success"
    FAILURE = "Failure"
    INFEASIBLE = "Infeasible"
    MAXITERS = "MaxIters"
    CONVERGENCE_FAILURE = "ConvergenceFailure"
    RESIDUAL_FAILURE = "APosterioriSafetyFailure"

    @property
    def ok(self) -> bool:
        return self is RetCode.SUCCESS


class Condition(enum.IntEnum):
    """How well conditioned the matrix is said to be; ill by default."""

    ILL = 0
    VERY_ILL = 1
    SUPER_ILL = 2
    WELL = 3


class Zeros(enum.Enum):
    """What becomes of stored zeros over a sequence of matrices."""

    AUTO = "auto"
    NONE = "none"
    PERSISTENT = "persistent"
    PRESENT = "present"


class WarmStart(enum.Enum):
    AUTO = "auto"
    NONE = "none"
    PREVIOUS = "previous"
    HEGEDUS = "hegedus"


class EigenTarget(enum.Enum):
    LARGEST_MAGNITUDE = "LM"
    SMALLEST_MAGNITUDE = "SM"
    LARGEST_REAL = "LR"
    SMALLEST_REAL = "SR"
    LARGEST_IMAGINARY = "LI"
    SMALLEST_IMAGINARY = "SI"


@dataclass(frozen=True)
class Assumptions:
    square: bool | None = None
    condition: Condition = Condition.ILL
    zeros: Zeros = Zeros.AUTO


def default_tolerance(dtype: str = "double") -> float:
    return {"double": math.sqrt(2.0**-52), "float": math.sqrt(2.0**-23)}.get(dtype, 0.0)


@dataclass
class LinearProblem:
    """``A u = b``. ``A``: a matrix of :mod:`tessera.sources.matrix` or an operator; ``b``: (i, x) or (i, k, x)."""

    A: Any
    b: DataFrame | Any
    u0: Any = None
    p: Any = None


@dataclass
class EigenProblem:
    """``A v = lambda v`` or ``A v = lambda B v``."""

    A: Any
    B: Any = None
    count: int | None = None
    target: EigenTarget = EigenTarget.LARGEST_MAGNITUDE
    shift: complex | float | None = None


@dataclass
class Solution:
    u: Any
    retcode: RetCode
    alg: str
    iters: int = 0
    resid: float | None = None
    stats: dict[str, Any] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.retcode.ok
