"""SQL equivalents of the registered queries, by operator id."""

import importlib

MODULES = ["fairness", "prepare", "drift", "text_bias", "mitigation", "counterfactual", "causal", "graph", "streaming", "models", "sources"]


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"oracles.{name}")
        except ModuleNotFoundError:
            continue
        out.update(module.ORACLES)
    return out
