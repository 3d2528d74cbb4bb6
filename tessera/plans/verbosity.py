"""What a solve says: named messages with levels, in groups and presets."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

log = logging.getLogger("tessera")

# The toggles by group, and the level of each in the presets minimal, standard, detailed and all
# (- silent, I information, W warning); numbered message levels of other libraries count as information.
_TOGGLES = """
error_control default_lu_fallback          - - W W
error_control residual_safety              - - W W
performance   no_right_preconditioning     - - I I
numerical     using_IterativeSolvers       - - I I
numerical     IterativeSolvers_iterations  - - - I
numerical     KrylovKit_verbosity          - I I I
numerical     KrylovJL_verbosity           - - I I
numerical     HYPRE_verbosity              - I I I
numerical     pardiso_verbosity            - - I I
error_control blas_errors                  W W W W
error_control blas_invalid_args            W W W W
numerical     blas_info                    - - I I
numerical     blas_success                 - - I I
numerical     condition_number             - - - I
numerical     convergence_failure          - W W W
numerical     solver_failure               - W W W
numerical     max_iters                    - W W W
"""
_ROWS = [row.split() for row in _TOGGLES.split("\n") if row]
_OFF = 0
_LEVELS = {"-": _OFF, "I": logging.INFO, "W": logging.WARNING}
NAMES = tuple(row[1] for row in _ROWS)
GROUPS = {group: tuple(row[1] for row in _ROWS if row[0] == group) for group in ("error_control", "performance", "numerical")}
PRESETS: dict[str, dict[str, int]] = {"none": {}} | {preset: {row[1]: _LEVELS[row[2 + k]] for row in _ROWS} for k, preset in enumerate(("minimal", "standard", "detailed", "all"))}
#: Who says how an iteration went, by how the algorithm's name begins; others say it as KrylovJL.
ITERATIONS = {"IterativeSolvers": "IterativeSolvers_iterations", "KrylovKit": "KrylovKit_verbosity", "HYPRE": "HYPRE_verbosity", "MKLPardiso": "pardiso_verbosity", "PanuaPardiso": "pardiso_verbosity"}


def iterating(algorithm: str) -> str:
    return next((name for start, name in ITERATIONS.items() if algorithm.startswith(start)), "KrylovJL_verbosity")


@dataclass
class Verbosity:
    """A preset with changes to single names or whole groups."""

    preset: str = "standard"
    changes: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        unknown = sorted(set(self.changes) - set(NAMES) - set(GROUPS))
        if self.preset not in PRESETS or unknown:
            raise ValueError(f"no preset {self.preset!r}" if self.preset not in PRESETS else f"no message {', '.join(unknown)}")

    def level(self, name: str) -> int:
        if name in self.changes:
            return self.changes[name]
        for group, names in GROUPS.items():
            if name in names and group in self.changes:
                return self.changes[group]
        return PRESETS[self.preset].get(name, _OFF)

    def say(self, name: str, message: str, *args) -> None:
        if level := self.level(name):
            log.log(level, message, *args)
