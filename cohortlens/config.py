"""Run parameters: segments, windows, product families.

The reference edits literals by hand in every script; here they are
frozen dataclasses passed to the metric functions.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# Fixed values (fixture workload).  These literals describe the fixture
# tables in FIXTURES.md, not the production market: segment labels,
# internal e-mail patterns, the credit SKU family and its packs, the
# subscription tiers and the experiment-arm map.
COUNTRY_A = "UK"
COUNTRY_B = "ES"
CITY_A = "London"
ORGANIC_CHANNELS = ("Organic", "Not available")
ORGANIC_SUB_CHANNEL = "Organic"
EXCLUDED_CHANNEL_B = "Sales"
PLATFORM = "iOS"
INTERNAL_EMAIL_PATTERNS = ("%@qa.%", "%@staff.example.com%")
SKU_FAMILY = "app.credits%"
PACK_PATTERNS = ("app.credits.pack1%", "app.credits.pack2%", "app.credits.pack3%")
FREE_TIER = "FREE_PREMIUM"
PAID_TIERS = ("MOBILE_PREMIUM_S", "MOBILE_PREMIUM_M", "MOBILE_PREMIUM_L")
PREMIUM_ARMS = (1, 2, 5)
EXCLUDED_DEVICE_TYPES = (3,)
EXPERIMENT_ARMS = (
    ("premium", 1), ("premium", 2), ("premium", 5), ("sales", 4),
    ("paid chats", 10), ("paid chats", 11), ("paid listing", 9),
)
ADHOC_PACK_DIGITS = ("%3%", "%2%")


def _monday(d: dt.date, what: str) -> dt.date:
    if d.weekday() != 0:
        raise ValueError(f"{what} must be a Monday, got {d} ({d:%A})")
    return d


@dataclass(frozen=True)
class SegmentRules:
    """Which employers enter a cohort.

    ``holders`` says how the credit-holder table is used: ``"require"``
    (inner join, the paid-chat arm), ``"exclude"`` (null-aware NOT IN,
    the free and premium arms) or ``None``.
    """

    country: str
    city: str | None = None
    organic_only: bool = False
    organic_channels: tuple[str, ...] = ORGANIC_CHANNELS
    organic_sub_channel: str = ORGANIC_SUB_CHANNEL
    channel_not_like: str | None = None
    platform: str | None = PLATFORM
    good_employer: bool = True
    internal_emails: tuple[str, ...] = INTERNAL_EMAIL_PATTERNS
    holders: str | None = None
    require_user_row: bool = False
    # premium arm: join the subscription history, one row per event
    subscriptions: bool = False
    excluded_tier: str = FREE_TIER
    arms: tuple[int, ...] = ()
    # employers linked to a device of one of these types are left out (null-aware NOT IN)
    excluded_device_types: tuple[int, ...] = ()


@dataclass(frozen=True)
class ReportConfig:
    """One report run: a segment, a cohort window and an activity spine."""

    segment: SegmentRules
    spine_start: dt.date
    spine_end: dt.date
    cohort_from: dt.date
    cohort_to: dt.date | None = None
    sku_family: str = SKU_FAMILY
    packs: tuple[str, ...] = PACK_PATTERNS
    tiers: tuple[str, ...] = PAID_TIERS
    # column prefixes of the tiers; further tiers are tier_4_premium, ...
    tier_labels: tuple[str, ...] = ("small_premium", "medium_premium", "large_premium")
    # "week": rank de-duplicated payments by payment week (market A);
    # "timestamp": rank raw payments by creation time (market B)
    rank_mode: str = "week"
    name: str = field(default="report", compare=False)

    def __post_init__(self):
        _monday(self.spine_start, "spine_start")
        _monday(self.cohort_from, "cohort_from")
        if self.cohort_to is not None:
            _monday(self.cohort_to, "cohort_to")
        if self.spine_end < self.spine_start:
            raise ValueError("spine_end precedes spine_start")
        if self.rank_mode not in ("week", "timestamp"):
            raise ValueError(f"unknown rank_mode {self.rank_mode!r}")

    @property
    def last_week(self) -> dt.date:
        """Last Monday of the spine (the end need not be a Monday)."""
        return self.spine_end - dt.timedelta(days=(self.spine_end - self.spine_start).days % 7)

    @property
    def n_weeks(self) -> int:
        return (self.last_week - self.spine_start).days // 7 + 1

    def _pack_columns(self, form: str) -> tuple[str, ...]:
        return tuple(form.format(i) for i in range(1, len(self.packs) + 1))

    def _tier_columns(self, suffix: str) -> tuple[str, ...]:
        labels = list(self.tier_labels[:len(self.tiers)])
        labels += [f"tier_{i}_premium" for i in range(len(labels) + 1, len(self.tiers) + 1)]
        return tuple(f"{label}_{suffix}" for label in labels)

    @property
    def pack_names(self) -> tuple[str, ...]:
        return self._pack_columns("pack_{}_orders")

    @property
    def first_names(self) -> tuple[str, ...]:
        return self._pack_columns("first_orders_pack_{}")

    @property
    def repeat_names(self) -> tuple[str, ...]:
        return self._pack_columns("repeat_orders_pack_{}")

    @property
    def tier_names(self) -> tuple[str, ...]:
        return self._tier_columns("orders")

    @property
    def first_tier_names(self) -> tuple[str, ...]:
        return self._tier_columns("first_orders")

    def with_(self, **kw) -> "ReportConfig":
        return replace(self, **kw)


D = dt.date
SEG_FREE_A = SegmentRules(country=COUNTRY_A, city=CITY_A, organic_only=True)
SEG_FREE_B = SegmentRules(country=COUNTRY_B, channel_not_like=EXCLUDED_CHANNEL_B, holders="exclude")
SEG_PAID_A = SegmentRules(country=COUNTRY_A, city=CITY_A, organic_only=True, holders="require",
                          require_user_row=True)
SEG_PAID_B = SegmentRules(country=COUNTRY_B, channel_not_like=EXCLUDED_CHANNEL_B, holders="require")
SEG_PREMIUM = SegmentRules(country=COUNTRY_A, city=CITY_A, organic_only=True, holders="exclude",
                           subscriptions=True, arms=PREMIUM_ARMS)

# Test windows of the fixture (FIXTURES.md "Test windows").
FREE_A = ReportConfig(SEG_FREE_A, D(2016, 12, 5), D(2017, 2, 13), D(2016, 12, 5), D(2017, 1, 9),
                      name="free_a")
FREE_B = ReportConfig(SEG_FREE_B, D(2016, 11, 28), D(2017, 2, 13), D(2016, 12, 5), name="free_b")
PAID_A = ReportConfig(SEG_PAID_A, D(2016, 12, 5), D(2017, 2, 13), D(2016, 12, 5), rank_mode="week",
                      name="paid_a")
PAID_B = ReportConfig(SEG_PAID_B, D(2016, 11, 28), D(2017, 2, 13), D(2016, 12, 5),
                      rank_mode="timestamp", name="paid_b")
# spine end on a Tuesday, as in the premium script: last week is the Monday before
PREMIUM = ReportConfig(SEG_PREMIUM, D(2016, 12, 5), D(2017, 2, 14), D(2016, 12, 5), name="premium")
# the premium arm with the device rule that the premium script holds disabled
PREMIUM_DEVICES = PREMIUM.with_(segment=replace(SEG_PREMIUM, excluded_device_types=EXCLUDED_DEVICE_TYPES),
                                name="premium_devices")
