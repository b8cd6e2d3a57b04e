"""Parameters that change results. Builders take them as an argument; nothing is global."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    # Routing and captions
    min_text_chars: int = 100
    min_ocr_chars: int = 100
    blank_ink: float = 0.002
    image_cap: int = 5000
    # Search
    top_k: int = 10
    top_n: int = 5
    rrf_k: int = 60
    hybrid: bool = True
    filter_no_content: bool = False
    overfetch: int = 3
    k1: float = 1.5
    b: float = 0.75
    # Context and answer
    neighbor: bool = True
    image_rank: int = 2
    image_most: int = 2
    image_extra: int = 1
    context_tokens: int = 4096
    answer_tokens: int = 500
    reserved_tokens: int = 200
    tokens_per_image: int = 1500
    chars_per_token: float = 1.5
    chars_per_chunk: int = 2500
    least_budget: int = 300
    least_answer_chars: int = 40

    @classmethod
    def from_environment(cls, values: dict[str, str] | None = None, prefix: str = "PAPERLOOM_") -> "Params":
        """The defaults, each replaced by the variable of its name in capitals after ``prefix``, if that is set."""
        values, own = os.environ if values is None else values, {}
        for f in fields(cls):
            given = values.get(prefix + f.name.upper())
            if given is not None:
                kind = type(f.default)
                own[f.name] = given.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(given)
        return cls(**own)


DEFAULT = Params()
