"""Column expressions (built-in Spark functions only, codegen friendly)."""

from docket.functions.exprs import *  # noqa: F401,F403
