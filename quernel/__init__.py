"""Full-text search and ranking over DataFrames.

``Index`` turns documents into postings and answers queries; ``Pipeline`` says how text becomes
terms; ``Manager`` and the storage providers keep indexes by name.
"""

import importlib

_FROM = {
    "functions.analysis": ("Pipeline", "Runner", "default_runners"),
    "operators.docstore": ("DocumentStore",),
    "operators.index": ("Index",),
    "sources.manager": ("Manager",),
    "sources.storage": ("BlackholeProvider", "DiskProvider", "StorageProvider"),
}
__all__ = sorted(name for names in _FROM.values() for name in names)


def __getattr__(name: str):
    """Loads a module when one of its names is asked for, so that workers load only what their tasks need."""
    for module, names in _FROM.items():
        if name in names:
            return getattr(importlib.import_module(f".{module}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
