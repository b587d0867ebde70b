"""Transforms: importing this package registers all of them."""

from loomwright.operators import columns, contract, encode, features, impute, numeric, rows, select, text  # noqa: F401
from loomwright.operators.base import TRANSFORMS, get  # noqa: F401
