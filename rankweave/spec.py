"""What a corpus and its division are, as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorpusSpec:
    """Columns of a corpus: its key, its searchable texts and the column that names the stripe."""

    id_col: str = "doc_id"
    text_cols: tuple[str, ...] = ("text",)
    stripe_col: str = "stripe"
    vector_col: str | None = None
    vector_size: int | None = None


@dataclass(frozen=True)
class Split:
    """How a corpus is divided. The name goes into paths and into every statistics table."""

    kind: str = "category"
    cut: int | None = None
    seed: int = 42

    @property
    def name(self) -> str:
        if self.kind == "temporal":
            return f"temporal-{self.cut}"
        return f"random-{self.seed}" if self.kind == "hash" else self.kind
