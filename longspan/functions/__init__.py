"""Column functions: ids, dates, numbers, seasons, weights and grids."""

from longspan.functions.columns import *  # noqa: F401,F403
