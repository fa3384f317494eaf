"""Named plans over the test tables."""
from importlib import import_module

MODULES = ("q_sources", "q_clean", "q_joins", "q_aggregate", "q_cohorts", "q_estimators", "q_audits", "q_verdicts", "q_models", "q_streaming")


def load_all() -> None:
    """Import every query module once; each registers its queries."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
