"""Column functions that stand on their own: builders from columns to columns."""

from panelforge.operators.alignment import softmax, trigram_similarity
from panelforge.operators.features import log_ratio_change, moment_corr, momentum, rsi, skew, volatility, zscore
from panelforge.operators.ledger import formula_id, hypothesis_id, valid_weights
from panelforge.operators.scoring import saturated, sharpe
from panelforge.plans.formula import average_rank, ordinal_rank

__all__ = ["average_rank", "formula_id", "hypothesis_id", "log_ratio_change", "moment_corr", "momentum", "ordinal_rank", "rsi", "saturated", "sharpe", "skew", "softmax", "trigram_similarity", "valid_weights", "volatility", "zscore"]
