"""Scalar functions on columns."""

from .text import *  # noqa: F403
from .titles import *  # noqa: F403
from .unicode import *  # noqa: F403
