"""Token costs and model names, as columns or plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prices in USD for a million tokens.
EMBEDDING_PRICE = 0.02
ESTIMATE_TOKENS = (7000, 900)
ESTIMATE_PRICES = {"anthropic": (3.0, 15.0), "large": (2.5, 10.0), "small": (0.15, 0.6)}
ACTUAL_PRICES = {"anthropic": 9.0, "small": 0.4, "large": 2.0}


def indexing_cost(tokens: Column) -> Column:
    return tokens / 1e6 * EMBEDDING_PRICE


def estimate(provider: Column, model: Column) -> Column:
    prompt, output = ESTIMATE_TOKENS
    usd = {k: round((a * prompt + b * output) / 1e6, 4) for k, (a, b) in ESTIMATE_PRICES.items()}
    p = F.lower(F.coalesce(provider, F.lit("openai")))
    big = F.contains(model, F.lit("4o")) & ~F.contains(model, F.lit("mini"))
    return F.when(p == "anthropic", usd["anthropic"]).when(p == "ollama", 0.0).when(big, usd["large"]).otherwise(usd["small"])


def actual(provider: Column, model: Column, tokens: Column) -> Column:
    price = F.when(provider == "ollama", 0.0).when(provider == "anthropic", ACTUAL_PRICES["anthropic"]).when(F.contains(model, F.lit("mini")), ACTUAL_PRICES["small"]).otherwise(ACTUAL_PRICES["large"])
    return F.round(tokens / 1e6 * price, 6)


def model_route(provider: Column, model: Column) -> Column:
    p = F.lower(F.coalesce(provider, F.lit("openai")))
    return F.when(p == "ollama", F.concat(F.lit("ollama/"), model)).when(p == "anthropic", F.when(model.startswith("claude"), model).otherwise(F.concat(F.lit("anthropic/"), model))).when((p != "custom") & (model.startswith("gpt") | model.startswith("o")), model).otherwise(F.concat(F.lit("openai/"), model))
