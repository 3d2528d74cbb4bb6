"""Algorithm objects: what each accepted name does here, and its traits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from ..operators import krylov
from .problem import WarmStart


@dataclass(frozen=True)
class Algorithm:
    """``kernel``: a name in :data:`tessera.functions.dense.KERNELS`, a Krylov method's name, or a callable."""

    name: str
    family: str  # direct, normal, diagonal, ldiv, function, krylov, default, lhl
    kernel: Any = None
    needs_concrete: bool = True
    needs_square: bool = True
    adjoint: str = "direct"
    note: str = ""
    options: dict = field(default_factory=dict, hash=False)

    def with_options(self, **kw) -> Algorithm:
        return replace(self, options={**self.options, **kw})


# Accepted names by the kernel that serves them. Names that differ only in the library or device
# that does the arithmetic have one kernel here.
_DIRECT = {
    "lu": (
        "LUFactorization GenericLUFactorization SimpleLUFactorization RFLUFactorization ButterflyFactorization FastLUFactorization "
        "GESVFactorization MKLLUFactorization OpenBLASLUFactorization AppleAccelerateLUFactorization BLISLUFactorization "
        "SpecializedLUFactorization CudaOffloadLUFactorization CudaOffloadFactorization AMDGPUOffloadLUFactorization MetalLUFactorization "
        "ElementalJL"
    ),
    "sparse_lu": (
        "PureKLUFactorization KLUFactorization SupernodalLUFactorization UMFPACKFactorization PureUMFPACKFactorization SparspakFactorization "
        "STRUMPACKFactorization PardisoJL MKLPardisoFactorize PanuaPardisoFactorize ParUFactorization MUMPSFactorization "
        "SuperLUDISTFactorization CUSOLVERRFFactorization"
    ),
    "mixed_lu": (
        "MKL32MixedLUFactorization OpenBLAS32MixedLUFactorization AppleAccelerate32MixedLUFactorization RF32MixedLUFactorization "
        "CUDAOffload32MixedLUFactorization MetalOffload32MixedLUFactorization"
    ),
    "cholesky": "CholeskyFactorization CHOLMODFactorization CliqueTreesFactorization",
    "bunch_kaufman": "BunchKaufmanFactorization HSLMA57Factorization HSLMA97Factorization",
    "ldlt": "LDLtFactorization",
}
_ANY_SHAPE = {
    "qr": "QRFactorization FastQRFactorization CudaOffloadQRFactorization AMDGPUOffloadQRFactorization",
    "pivoted_qr": "QRFactorization(ColumnNorm()) SparseColumnPivotedQRFactorization SpecializedQRFactorization",
    "svd": "SVDFactorization",
    "min_norm": "MinNormQR",
}
_KRYLOV = {
    "cg": "KrylovJL_CG ConjugateGradientsJL ConjugateGradientsJL_CG IterativeSolversJL_CG KrylovKitJL_CG GinkgoJL_CG GinkgoJL PartitionedSolversAlgorithm HYPREAlgorithm",
    "minres": "KrylovJL_MINRES IterativeSolversJL_MINRES",
    "minares": "KrylovJL_MINARES",
    "gmres": "KrylovJL KrylovJL_GMRES IterativeSolversJL IterativeSolversJL_GMRES KrylovKitJL KrylovKitJL_GMRES GinkgoJL_GMRES SimpleGMRES PETScAlgorithm",
    "fgmres": "KrylovJL_FGMRES",
    "bicgstab": "KrylovJL_BICGSTAB ConjugateGradientsJL_BICGSTAB IterativeSolversJL_BICGSTAB",
    "cgs": "MKLPardisoIterate PanuaPardisoIterate",
    "idrs": "IterativeSolversJL_IDRS",
    "lsmr": "KrylovJL_LSMR",
    "craigmr": "KrylovJL_CRAIGMR",
}
#: Names whose preconditioners are refused rather than dropped.
NO_PRECONDITIONER = (*krylov.UNPRECONDITIONED, "KrylovJL_CRAIGMR", "KrylovJL_MINARES", "IterativeSolversJL_MINRES", "KrylovKitJL", "KrylovKitJL_CG", "KrylovKitJL_GMRES")
#: Iterations that the first matrix's factor preconditions, for later matrices too.
FROZEN_LU = ("MKLPardisoIterate", "PanuaPardisoIterate")
LEFT_ONLY = ("KrylovJL_CG", "KrylovJL_MINRES", "ConjugateGradientsJL_CG")
BATCHED_KRYLOV = ("KrylovJL_GMRES", "KrylovJL_MINRES", "KrylovJL", "SimpleGMRES")


# Arguments by which some names choose their method, with the family and kernel that serve it here.
CHOICES = {
    "HYPREAlgorithm": ("solver", {
        "PCG": ("krylov", "cg"), "BiCGSTAB": ("krylov", "bicgstab"), "GMRES": ("krylov", "gmres"), "FlexGMRES": ("krylov", "fgmres"),
        "Hybrid": ("krylov", "cg"), "ILU": ("krylov", "gmres"), "BoomerAMG": ("multigrid", "classical"),
    }),
    "PETScAlgorithm": ("solver_type", {
        "gmres": ("krylov", "gmres"), "fgmres": ("krylov", "fgmres"), "cg": ("krylov", "cg"), "cr": ("krylov", "cr"), "minres": ("krylov", "minres"),
        "symmlq": ("krylov", "symmlq"), "bcgs": ("krylov", "bicgstab"), "cgs": ("krylov", "cgs"), "lsqr": ("krylov", "lsqr"),
    }),
    "ElementalJL": ("method", {"LU": ("direct", "lu"), "QR": ("direct", "qr"), "LQ": ("direct", "min_norm"), "Cholesky": ("direct", "cholesky")}),
}
#: Preconditioners that come with a choice: ILU runs inside GMRES; Hybrid scales by the diagonal and takes multigrid where that doesn't converge.
COMES_WITH = {"ILU": "ILU", "Hybrid": "jacobi"}


def _registry() -> dict[str, Algorithm]:
    out: dict[str, Algorithm] = {}
    for kernel, names in _DIRECT.items():
        for n in names.split():
            out[n] = Algorithm(n, "direct", kernel)
    for kernel, names in _ANY_SHAPE.items():
        for n in names.split():
            out[n] = Algorithm(n, "direct", kernel, needs_square=False)
    for n, kernel in (("NormalCholeskyFactorization", "normal_cholesky"), ("NormalBunchKaufmanFactorization", "normal_bunch_kaufman")):
        out[n] = Algorithm(n, "normal", kernel, needs_square=False, adjoint="normal")
    for method, names in _KRYLOV.items():
        rectangular = method in krylov.LEAST_SQUARES or method in krylov.LEAST_NORM
        for n in names.split():
            out[n] = Algorithm(n, "krylov", method, needs_concrete=False, needs_square=not rectangular, adjoint="krylov")
    for method in krylov.METHODS:
        rectangular = method in (*krylov.LEAST_SQUARES, *krylov.LEAST_NORM, *krylov.COUPLED, "usymlq", "usymqr", "trilqr")
        out[method] = Algorithm(method, "krylov", method, needs_concrete=False, needs_square=not rectangular, adjoint="krylov")
    out["DiagonalFactorization"] = Algorithm("DiagonalFactorization", "diagonal")
    out["DirectLdiv"] = Algorithm("DirectLdiv", "ldiv", needs_square=False)
    out["LHLFactorization"] = Algorithm("LHLFactorization", "lhl", options={"refine": 1})
    out["AlgebraicMultigridJL"] = Algorithm("AlgebraicMultigridJL", "multigrid", "aggregation", note="a V-cycle over smoothed aggregates as a preconditioner of cg; the residual is checked")
    for n, kind in (("PyAMG", "classical"), ("PyAMG_RugeStuben", "classical"), ("PyAMG_SmoothedAggregation", "aggregation")):
        out[n] = Algorithm(n, "multigrid", kind)
    return out


ALGORITHMS = _registry()


def algorithm(name: str, **options) -> Algorithm:
    if name not in ALGORITHMS:
        raise ValueError(f"no algorithm {name!r}; see algorithm_names()")
    found = ALGORITHMS[name]
    check_control(options.get("control", {}))
    argument, served = CHOICES.get(name, (None, {}))
    if argument in options:
        choice = options[argument]
        if choice not in served:
            raise ValueError(f"{name} has no {argument} {choice!r}; it has {', '.join(served)}")
        family, kernel = served[choice]
        found = replace(found, family=family, kernel=kernel, needs_square=kernel not in ("qr", "min_norm", "lsqr"))
        if choice in COMES_WITH:
            options = {"pc_type": COMES_WITH[choice], **options}
    if options.get("nullspace", "none") not in ("none", "constant", "custom") or options.get("nullspace") == "custom" and not options.get("nullspace_vecs"):
        raise ValueError("nullspace is none, constant, or custom with nullspace_vecs")
    return found.with_options(**options) if options else found


def algorithm_names() -> list[str]:
    return sorted(ALGORITHMS)


def solve_function(f: Callable, name: str = "LinearSolveFunction") -> Algorithm:
    """The user's ``f(A, b, u, p, fresh, Pl, Pr, cache)`` returning u; whole numbers are handed on as they are."""
    return Algorithm(name, "function", f, needs_square=False, adjoint="none")


def generic_factorization(f: Callable) -> Algorithm:
    """``f(a)`` returns a function that solves with the factor; it is called once for each matrix."""
    from ..functions.factors import Given

    return Algorithm("GenericFactorization", "direct", lambda a: Given(f, a), needs_square=False, adjoint="none")


# Keys of the sparse control table.
CONTROL_KEYS = (
    "prl", "dense_row", "dense_col", "block_size", "ordering", "fixq", "amd_dense", "aggressive", "singletons", "alloc_init",
    "sym_pivot_tolerance", "scale", "front_alloc_init", "droptol", "irstep",
)


def check_control(control: dict[str, float]) -> None:
    unknown = sorted(set(control) - set(CONTROL_KEYS))
    if unknown:
        raise ValueError(f"no such control key: {', '.join(unknown)}")


def user_algorithm(own) -> Algorithm:
    """An object of a user's class: ``init_cache(A, b)`` is called for each new matrix, ``solve(cache, A, b, u)`` for each right-hand side."""
    issues = check_algorithm(type(own))
    if issues:
        raise TypeError("; ".join(issues))
    return Algorithm(type(own).__name__, "user", own, needs_concrete=getattr(own, "needs_concrete", True), needs_square=getattr(own, "needs_square", True), adjoint="none")


def check_algorithm(cls) -> list[str]:
    """What a user's algorithm class lacks: ``init_cache`` and ``solve``, and traits of the wrong type."""
    issues = [f"{m} is missing" for m in ("init_cache", "solve") if not callable(getattr(cls, m, None))]
    for trait in ("needs_concrete", "needs_square"):
        if hasattr(cls, trait) and not isinstance(getattr(cls, trait), bool):
            issues.append(f"{trait} is not a boolean")
    return issues


__all__ = ["ALGORITHMS", "Algorithm", "WarmStart", "algorithm", "algorithm_names", "check_algorithm", "check_control", "generic_factorization", "solve_function", "user_algorithm"]
