"""Column expressions."""

from scorelake.functions.missing import is_missing, nan_to_null
from scorelake.functions.text import auc_text, parse_prediction, percent_text, render_prompt

__all__ = ["is_missing", "nan_to_null", "auc_text", "parse_prediction", "percent_text", "render_prompt"]
