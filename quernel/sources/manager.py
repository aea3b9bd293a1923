"""A catalog of indexes by name, backed by a storage provider."""

from __future__ import annotations

from ..operators.index import Index
from .storage import BlackholeProvider, StorageProvider


class AlreadyExists(ValueError):
    """An index of this name is loaded."""


class NotLoaded(KeyError):
    """No index of this name is loaded."""


class Manager:
    """Holds loaded indexes; saves and updates write first, so a failed write changes nothing."""

    def __init__(self, provider: StorageProvider | None = None):
        self.provider = provider or BlackholeProvider()
        self._loaded: dict[str, Index] = {}

    def preload(self) -> Manager:
        """Loads every stored index."""
        for index in self.provider.load_all():
            self._loaded[index.name] = index
        return self

    def get(self, name: str) -> Index:
        if name not in self._loaded:
            raise NotLoaded(name)
        return self._loaded[name]

    def save(self, index: Index) -> Index:
        if index.name in self._loaded:
            raise AlreadyExists(f"index {index.name} is loaded already")
        self.provider.write(index)
        self._loaded[index.name] = index
        return index

    def update(self, index: Index) -> Index:
        self.get(index.name)
        self.provider.write(index)
        self._loaded[index.name] = index
        return index

    def remove(self, index: Index | str) -> None:
        name = index if isinstance(index, str) else index.name
        self.get(name)
        self.provider.delete(name)
        del self._loaded[name]

    def loaded(self, name: str) -> bool:
        return name in self._loaded

    def loaded_indices(self) -> list[str]:
        return sorted(self._loaded)
