"""Runnable queries over the canonical tables."""

from importlib import import_module

MODULES = ["q_health", "q_dedup", "q_text", "q_routing", "q_sources", "q_streaming"]


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"newslake.plans.{name}")
