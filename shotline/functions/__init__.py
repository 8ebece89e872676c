"""Scalar functions as Spark columns."""

from .scalars import *  # noqa: F403
