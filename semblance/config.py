"""Settings of the text stages, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextConfig:
    """How texts become tokens and shingles. Without ``exact_unicode`` no text goes
    through Python, and NFKC and full case folding are left out."""

    shingle_size: int = 3
    language: str = "auto"
    remove_stopwords: bool = True
    short_text_policy: str = "single"
    adaptive_short_text: bool = False
    short_text_token_limit: int = 10
    custom_stopwords: tuple[str, ...] = ()
    exact_unicode: bool = True

    def __post_init__(self) -> None:
        if self.shingle_size not in (3, 4, 5):
            raise ValueError(f"shingle_size is 3, 4 or 5, not {self.shingle_size}")
        if self.language not in ("auto", "en", "fa"):
            raise ValueError(f"unknown language {self.language!r}")
        if self.short_text_policy not in ("single", "empty"):
            raise ValueError(f"unknown short_text_policy {self.short_text_policy!r}")
        if self.short_text_token_limit <= 0:
            raise ValueError("short_text_token_limit must be above 0")


@dataclass(frozen=True)
class LshConfig:
    """Permutations, bands and hash profile: ``blake2b`` or ``md5`` (SQL knows only the latter)."""

    num_perm: int = 128
    bands: int = 64
    seed: int = 42
    profile: str = "blake2b"

    def __post_init__(self) -> None:
        if self.num_perm <= 0 or self.bands <= 0 or self.num_perm % self.bands:
            raise ValueError("num_perm and bands must be above 0, and bands divide num_perm")
        if self.profile not in ("blake2b", "md5"):
            raise ValueError(f"unknown hash profile {self.profile!r}")

    @property
    def rows(self) -> int:
        return self.num_perm // self.bands

    @property
    def approximate_threshold(self) -> float:
        return (1 / self.bands) ** (1 / self.rows)


@dataclass(frozen=True)
class PairConfig:
    """Decision thresholds of the pair methods."""

    jaccard_threshold: float = 0.25
    simhash_max_distance: int = 25
    simhash_ngram_size: int = 1
    simhash_mode: str = "standard"
    cosine_threshold: float | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.jaccard_threshold <= 1:
            raise ValueError("jaccard_threshold is between 0 and 1")
        if not 0 <= self.simhash_max_distance <= 64:
            raise ValueError("simhash_max_distance is between 0 and 64")
        if self.simhash_ngram_size < 1:
            raise ValueError("simhash_ngram_size must be above 0")
        if self.simhash_mode not in ("standard", "hybrid"):
            raise ValueError(f"unknown simhash_mode {self.simhash_mode!r}")
        if self.cosine_threshold is not None and not 0 <= self.cosine_threshold <= 1:
            raise ValueError("cosine_threshold is between 0 and 1")
