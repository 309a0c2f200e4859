"""Queries over the driver's tables, each registered beside its oracle SQL."""

from importlib import import_module

MODULES = ("lookup_plans", "charge_plans", "running_plans", "grounding_plans", "retrieval_plans", "check_plans", "text_plans", "source_plans", "layout_plans", "specified_plans", "answer_plans")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tallybook.plans.{name}")
