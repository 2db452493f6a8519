"""The three workflows: prepare data, train and evaluate, score by prompt and evaluate."""

from scorelake.plans.workflows import evaluate, prepare, score_by_prompt, train_and_evaluate

__all__ = ["evaluate", "prepare", "score_by_prompt", "train_and_evaluate"]
