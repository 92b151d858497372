"""Settings of a search, with what a single call overrides."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class Options:
    expand: bool = True
    rerank: bool = True
    correct: bool = True
    k: int = 5
    threshold: float = 2.0

    def override(self, **given) -> Options:
        """These settings with those given; ``None`` keeps what is set, an unknown name is an error."""
        return dataclasses.replace(self, **{k: v for k, v in given.items() if v is not None})
