"""Registered queries, one module for each group of operators."""

from importlib import import_module

#: Modules that register queries when they are imported.
MODULES: tuple[str, ...] = ("retrieval", "relational", "texts", "pipelines", "knowledge", "lessons", "transitions", "layouts", "facades")


def load_plans() -> None:
    for name in MODULES:
        import_module(f"heronmill.plans.{name}")
