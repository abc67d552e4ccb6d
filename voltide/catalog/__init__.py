"""Query catalog."""


def load():
    """Import every query module and return the registry."""
    import importlib

    for m in ("returns", "metrics", "recursions", "particle_sets", "filters", "runs", "edges"):
        importlib.import_module(f"voltide.catalog.{m}")
    from voltide.catalog import registry

    return registry
