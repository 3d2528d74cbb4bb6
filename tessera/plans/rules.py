"""The default choice, as an ordered rule table without Spark; and where a choice runs."""

from __future__ import annotations

from dataclasses import dataclass

from .problem import Condition


@dataclass(frozen=True)
class Facts:
    rows: int
    cols: int
    kind: str = "dense"  # dense, sparse, diagonal, tridiagonal, symtridiagonal, bidiagonal, factorization, hermitian, symmetric, static, operator, shifted, banded, almost_banded, block_diagonal, distributed, table, unknown
    nnz: int | None = None
    dtype: str = "double"
    condition: Condition = Condition.ILL
    has_solve: bool = False
    square_blocks: bool = True
    gpu: bool = False

    @property
    def square(self) -> bool:
        return self.rows == self.cols


#: Measured choices that were adopted: the algorithm for a type and size class.
PREFERRED: dict[tuple[str, str], str] = {}


def light(rows: int, cols: int, nnz: int) -> bool:
    """Whether a sparse matrix has little structure to use: small, or of middle size and very sparse."""
    return rows <= 1_000 or rows <= 10_000 and nnz / (rows * cols) < 2e-4


def default_choice(f: Facts) -> str:
    """The first rule that holds names the algorithm."""
    sq, c = f.square, f.condition
    if f.kind == "static":
        return "LUFactorization" if sq else "SVDFactorization"
    if f.kind == "diagonal":
        return "DiagonalFactorization"
    if f.kind == "tridiagonal":
        return "DirectLdiv" if sq else "QRFactorization"
    if f.kind == "symtridiagonal":
        return "LDLtFactorization"
    if f.kind in ("bidiagonal", "factorization"):
        return "DirectLdiv"
    if f.kind == "hermitian":
        return "CholeskyFactorization"
    if f.kind == "symmetric":
        return "BunchKaufmanFactorization"
    if f.kind == "symmetric_sparse":
        return "CHOLMODFactorization"
    if f.kind == "banded":
        return "LUFactorization" if sq else "QRFactorization"
    if f.kind == "almost_banded":
        return "DirectLdiv" if sq else "QRFactorization"
    if f.kind == "block_diagonal":
        return "LUFactorization" if f.square_blocks else "KrylovJL_GMRES"
    if f.kind == "distributed":
        if not sq:
            raise ValueError("a distributed matrix has to be square")
        return "KrylovJL_CG"
    if f.kind == "shifted":
        return "LHLFactorization" if sq and f.rows >= 32 else "LUFactorization"
    if f.kind == "operator":
        if f.has_solve:
            return "DirectLdiv"
        return "KrylovJL_CRAIGMR" if f.rows < f.cols else "KrylovJL_LSMR" if f.rows > f.cols else "KrylovJL_GMRES"
    if f.gpu:
        return "QRFactorization" if c is Condition.ILL or not sq else "LUFactorization"
    if f.kind == "sparse":
        few = light(f.rows, f.cols, f.nnz or 0)
        if f.dtype not in ("double", "complex"):
            if not sq:
                raise ValueError("a sparse matrix of this type has to be square")
            return "PureKLUFactorization"
        if sq:
            return "PureKLUFactorization" if few else "SupernodalLUFactorization"
        return "SparseColumnPivotedQRFactorization" if few else "QRFactorization"
    if f.kind == "unknown":
        if not sq:
            raise ValueError("a structure that no rule knows; name an algorithm")
        return "KrylovJL_GMRES"
    if sq:
        if c is Condition.VERY_ILL:
            return "QRFactorization"
        if c is Condition.SUPER_ILL:
            return "SVDFactorization"
        if c not in (Condition.ILL, Condition.WELL):
            return "LUFactorization"
        return "GenericLUFactorization" if f.rows <= 10 else PREFERRED.get((f.dtype, size_class(f.rows)), "LUFactorization")
    if c is Condition.WELL:
        return "NormalCholeskyFactorization"
    if c is Condition.SUPER_ILL:
        return "SVDFactorization"
    return "QRFactorization(ColumnNorm())" if f.rows < f.cols else "QRFactorization"


SIZE_CLASSES = (("tiny", 20), ("small", 100), ("medium", 300), ("large", 1_000), ("big", None))


def size_class(n: int) -> str:
    return next(name for name, most in SIZE_CLASSES if most is None or n <= most)


#: Bounds for what the driver or one task takes at once.
LOCAL_ENTRIES = 2_000_000
DRIVER_UNKNOWNS = 10_000_000
DENSE_UNKNOWNS = 5_000


def placement(f: Facts, groups: int = 1) -> str:
    """native: SQL expressions; reduced: one aggregate, then a small solve; grouped: a task for each group; packed: Krylov with vectors on the driver; table: with vectors in tables; single: one dense task."""
    if f.kind in ("diagonal", "tridiagonal", "symtridiagonal", "bidiagonal") or f.kind == "static" and f.rows <= 3:
        return "native"
    if groups > 1:
        return "grouped"
    if f.kind == "table" and f.cols <= 1_000:
        return "reduced"
    if max(f.rows, f.cols) <= DENSE_UNKNOWNS:
        return "single"
    return "packed" if max(f.rows, f.cols) <= DRIVER_UNKNOWNS else "table"
