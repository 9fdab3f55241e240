"""Named results of which each is built when it is first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping


class Parts(Mapping):
    """A read-only mapping from names to results; ``makers`` maps each name to a
    function of no arguments that builds it, so parts nobody reads start no job."""

    def __init__(self, makers: dict[str, Callable]):
        self._makers, self._built = makers, {}

    def __getitem__(self, name: str):
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def makers(self, prefix: str = "") -> dict[str, Callable]:
        """The parts, still unbuilt, under prefixed names, for a larger mapping."""
        return {prefix + name: (lambda name=name: self[name]) for name in self._makers}
