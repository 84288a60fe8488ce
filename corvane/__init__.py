"""A hybrid vector and metadata query engine on PySpark."""

from __future__ import annotations

#: Where the public names live; they are imported on first use, so executors that need one module load no more.
_PUBLIC = {
    "CheckpointPolicy": "sources.collection", "Collection": "sources.collection", "ViewCollection": "sources.collection",
    "CommandResult": "engine", "Engine": "engine", "Params": "engine",
    "bind": "language.binder", "parse": "language.parser", "to_sql": "language.printer",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        from importlib import import_module

        return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
