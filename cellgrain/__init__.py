"""Multidimensional analytics on Spark DataFrames at cell grain."""

from .catalog import Catalog, Cube, Dimension, Hierarchy
from .engine import Engine
from .errors import AccessDenied, BindError, QuerySyntaxError, TooManyIndicesError
from .operators.tensors import Tensor, build_einsum, build_spec, contract, convolve, suppressed
from .result import ResultSet

__all__ = [
    "AccessDenied", "BindError", "Catalog", "Cube", "Dimension", "Engine", "Hierarchy", "QuerySyntaxError", "ResultSet", "Tensor",
    "TooManyIndicesError", "build_einsum", "build_spec", "contract", "convolve", "suppressed",
]
