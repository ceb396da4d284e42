"""Fixed schemas, instruments and feature names."""

from __future__ import annotations

from dataclasses import dataclass, field

SPOT_CSV = "trade_id BIGINT, price DOUBLE, quantity DOUBLE, quote_quantity DOUBLE, trade_time BIGINT, is_buyer_maker BOOLEAN, is_best_match BOOLEAN"
FUTURES_CSV = "trade_id BIGINT, price DOUBLE, quantity DOUBLE, quote_quantity DOUBLE, trade_time BIGINT, is_buyer_maker BOOLEAN"
SIDED_CSV = "symbol STRING, trade_id BIGINT, side STRING, quantity DOUBLE, price DOUBLE, trade_time BIGINT"
EVENTS_JSON = "symbol STRING, time STRING, exchange STRING"
IMPORTANCES = "feature STRING, importance DOUBLE"

#: Base step of the sampled grid, and window lengths, in milliseconds. Fixed values.
BASE_MS = 500
WINDOWS_MS = (500, 1_000, 2_000, 5_000, 10_000, 30_000, 60_000, 120_000, 300_000)
HORIZONS_S = (1, 2, 3, 4, 5, 10, 15, 30, 60, 120, 300)

#: Venues, and currencies that aren't targets of a forecast. Fixed values.
VENUES = ("BINANCE_SPOT", "BINANCE_USDM", "OKX_SPOT")
STABLECOINS = ("USDT", "USDC", "BUSD", "TUSD", "FDUSD")


def window_slug(ms: int) -> str:
    """500MS, 1S, 300S."""
    return f"{ms}MS" if ms % 1000 else f"{ms // 1000}S"


def feature_name(prefix: str, statistic: str, window_ms: int, venue: str) -> str:
    return f"{prefix}-{statistic}-{window_slug(window_ms)}@{venue}"


def difference_name(prefix: str, window_ms: int, venue: str, other: str) -> str:
    return f"{prefix}-exchange_diff-{window_slug(window_ms)}@{venue}-{other}"


@dataclass(frozen=True)
class Pair:
    """An instrument, BASE-TERM."""

    base: str
    term: str

    @classmethod
    def parse(cls, name: str) -> Pair:
        base, _, term = name.partition("-")
        if not base or not term or "-" in term:
            raise ValueError(f"{name!r} is not BASE-TERM")
        return cls(base, term)

    @property
    def name(self) -> str:
        return f"{self.base}-{self.term}"

    @property
    def joined(self) -> str:
        return self.base + self.term


@dataclass(frozen=True)
class FeatureSet:
    """Ordered, distinct column lists of a panel."""

    regressors: tuple[str, ...]
    target: str
    categorical: tuple[str, ...] = ()
    evaluation: tuple[str, ...] = ()

    def with_regressors(self, more: list[str], categorical: list[str] | None = None) -> FeatureSet:
        merge = lambda a, b: tuple(dict.fromkeys([*a, *b]))
        return FeatureSet(merge(self.regressors, more), self.target, merge(self.categorical, categorical or []), self.evaluation)

    def without(self, names: set[str]) -> FeatureSet:
        keep = lambda a: tuple(x for x in a if x not in names)
        return FeatureSet(keep(self.regressors), self.target, keep(self.categorical), self.evaluation)

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.regressors, *self.categorical, *self.evaluation, self.target]))


@dataclass(frozen=True)
class FeatureFilter:
    """Which panel columns to build; all of them, or a list of names."""

    names: frozenset[str] | None = field(default=None)

    @classmethod
    def all(cls) -> FeatureFilter:
        return cls(None)

    @classmethod
    def first(cls, ranked: list[str], use_first: int = 25) -> FeatureFilter:
        return cls(frozenset(ranked[:use_first]))

    def allows(self, name: str) -> bool:
        return self.names is None or name in self.names
