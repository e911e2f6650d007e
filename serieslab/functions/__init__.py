"""Column expressions that are of use on their own: gates, weights and p values."""

from serieslab.core import finite
from serieslab.operators.metrics import two_sided_p
from serieslab.operators.rolling import df_t
from serieslab.operators.stationary import baxter_king_weights, fracdiff_weights, stepped_p

__all__ = ["baxter_king_weights", "df_t", "finite", "fracdiff_weights", "stepped_p", "two_sided_p"]
