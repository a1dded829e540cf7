"""Column-level functions (built-in Spark expressions only)."""
from .scalars import *  # noqa: F401,F403
