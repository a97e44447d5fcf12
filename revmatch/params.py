"""Job arguments and their checks."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("tfidf", "embedding", "rerank")

# Shipped scoring parameters, run defaults and limits.
BID_MAX = 20
BID_LIMIT = 100
REF_MAX = 20.0
INTEREST_WEIGHT = 0.35
SEM_GAIN = 9.0
NEUTRAL_GAIN = 9.0
POSITIVE_FRAC = 0.1
MIN_PAPERS = 5
LEADING_PAGES = 3
TOP_PAPERS = 3
TOP_TERMS = 40
MIN_DF = 2
MAX_DF = 0.3
SHORTLIST_FLOOR = 150
SHORTLIST_CUSHION = 3
FRACTION_TOLERANCE = 0.10


@dataclass(frozen=True)
class ScoringParams:
    """How similarity and interests become a value and a bid."""

    bid_max: int = BID_MAX
    bid_limit: int = BID_LIMIT
    ref_max: float = REF_MAX
    interest_weight: float = INTEREST_WEIGHT
    sem_gain: float = SEM_GAIN

    def __post_init__(self):
        if isinstance(self.bid_max, bool) or not isinstance(self.bid_max, int):
            raise ValueError(f"bid_max must be an int, got {self.bid_max!r}")
        if not 1 <= self.bid_max <= self.bid_limit:
            raise ValueError(f"bid_max must be in [1, {self.bid_limit}], got {self.bid_max}")
        if not 0.0 <= self.interest_weight <= 1.0:
            raise ValueError(f"interest_weight must be in [0, 1], got {self.interest_weight}")

    @property
    def exponent(self) -> float:
        return NEUTRAL_GAIN / self.sem_gain if self.sem_gain > 0 else 1.0


@dataclass(frozen=True)
class RunOptions:
    """What to run, and how finely to cut the work.

    ``cell_submissions`` x ``cell_papers`` bounds one cell of the similarity grid, and
    ``pair_cell`` squared one cell of jointly scored pairs. They only steer the physical plan; results do not depend on them.
    """

    positive_frac: float = POSITIVE_FRAC
    method: str = "tfidf"
    rerank_topn: int | None = None
    min_papers: int = MIN_PAPERS
    strict: bool = False
    cell_submissions: int = 256
    cell_papers: int = 1024
    pair_cell: int = 256

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; choose one of {METHODS}")
        if not 0.0 <= self.positive_frac <= 1.0:
            raise ValueError("positive_frac must be between 0 and 1")
        if self.rerank_topn is not None and self.rerank_topn < 1:
            raise ValueError("rerank_topn must be a positive integer")
