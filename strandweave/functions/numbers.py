"""Numeric helpers of scoring, budgets and candidates, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quality(f: Column, l: Column, alpha: float = C.ALPHA, unit: bool = False) -> Column:  # noqa: E741
    return alpha * f + (1 - alpha) * (((l + 1) / 2) if unit else l)


def commercial_count(n: Column, ratio: float = C.COMMERCIAL_RATIO, enabled: bool = True) -> Column:
    """Commercial candidates of ``n``, rounded half to even."""
    share = F.bround(n.cast("double") * F.lit(ratio if enabled else 0.0), 0).cast("int")
    return F.greatest(F.lit(0), F.least(n.cast("int"), share))


def candidate_source(index: Column, n: Column, ratio: float = C.COMMERCIAL_RATIO, enabled: bool = True) -> Column:
    return F.when((n > 0) & (index >= n - commercial_count(n, ratio, enabled)), F.lit("commercial")).otherwise(F.lit("base"))


def prompt_tokens(chars: Column, per_token: float = C.CHARS_PER_TOKEN) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / F.lit(min(8.0, max(1.5, per_token)))).cast("int"))


def completion_budget(chars: Column, wanted: Column, context: int = C.CONTEXT_TOKENS, margin: int = C.COMPLETION_MARGIN, per_token: float = C.CHARS_PER_TOKEN) -> Column:
    """Tokens left for a completion: at least 1, at most ``wanted``."""
    return F.greatest(F.lit(1), F.least(wanted, F.lit(context) - prompt_tokens(chars, per_token) - margin))


def completion_room(message: str | None) -> int | None:
    """Tokens that a context-limit message leaves for a completion (limit - input - 16, at least 1), else null.

    The limit is the first number after "context length", the input the number before "input tokens".
    """
    low = (message or "").lower()
    _, found, rest = low.partition("context length")
    said, also, _ = rest.partition("input tokens")
    numbers = [int(w) for w in said.replace(",", " ").replace(".", " ").split() if w.isdigit()]
    if not (found and also) or len(numbers) < 2:
        return None
    return max(1, numbers[0] - numbers[-1] - 16)


def allowed_tokens(error: Column) -> Column:
    """``completion_room`` of a column of messages."""

    @F.pandas_udf("int")
    def read(messages: pd.Series) -> pd.Series:
        return messages.map(completion_room).astype("Int32")

    return read(error)


def effective_rounds(windows: Column, requested: int = C.ROUNDS) -> Column:
    return F.when(windows >= 3, F.greatest(F.lit(1), F.least(F.lit(requested), windows - 2))).otherwise(F.lit(0))


def mean_three(a: Column, b: Column, c: Column) -> Column:
    return (a + b + c) / 3
