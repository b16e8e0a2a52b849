"""Options of the structure cascade. Unknown names are rejected."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Point types, strength measures and the settings they are chosen by.
POINT_TYPES = ("1", "1p", "2", "2s", "3a", "3b")
STRENGTHS = ("area", "peak", "full_area", "diff", "slope", "amp", "amount", "volumn", "amount_avg", "volumn_avg",
             "turnrate_avg", "rsi")


@dataclass(frozen=True)
class PointRules:
    """Settings of one side (buy or sell) on one line level (strokes or segments)."""

    divergence_rate: float = float("inf")
    min_zs_cnt: int = 1
    bsp1_only_multibi_zs: bool = True
    max_bs2_rate: float = 0.9999
    macd_algo: str = "peak"
    bs1_peak: bool = True
    bs_type: str = "1,1p,2,2s,3a,3b"
    bsp2_follow_1: bool = True
    bsp3_follow_1: bool = True
    bsp3_peak: bool = False
    bsp2s_follow_2: bool = False
    max_bsp2s_lv: int | None = None
    strict_bsp3: bool = False
    bsp3a_max_zs_cnt: int = 1

    def __post_init__(self) -> None:
        if self.macd_algo not in STRENGTHS:
            raise ValueError(f"unknown strength {self.macd_algo}")
        if self.max_bs2_rate > 1 or self.bsp3a_max_zs_cnt < 1:
            raise ValueError("max_bs2_rate must be <= 1 and bsp3a_max_zs_cnt >= 1")
        if not set(self.types) <= set(POINT_TYPES):
            raise ValueError(f"unknown point types in {self.bs_type}")

    @property
    def types(self) -> tuple[str, ...]:
        return tuple(t.strip() for t in self.bs_type.split(","))


SEGMENT_RULES = PointRules(macd_algo="slope", bsp1_only_multibi_zs=False)


@dataclass(frozen=True)
class StructureConfig:
    # strokes
    bi_algo: str = "normal"  # "normal" or "fx" (no span rule)
    bi_strict: bool = True
    bi_fx_check: str = "strict"  # strict, loss, half, totally
    gap_as_kl: bool = False
    bi_end_is_peak: bool = True
    bi_allow_sub_peak: bool = True
    # segments
    seg_algo: str = "chan"  # chan, 1+1, break
    left_seg_method: str = "peak"  # peak, all
    # zones
    zs_combine: bool = True
    zs_combine_mode: str = "zs"  # zs, peak
    one_bi_zs: bool = False
    zs_algo: str = "normal"  # normal, over_seg, auto
    # points
    buy: PointRules = field(default_factory=PointRules)
    sell: PointRules = field(default_factory=PointRules)
    seg_buy: PointRules = SEGMENT_RULES
    seg_sell: PointRules = SEGMENT_RULES

    def __post_init__(self) -> None:
        allowed = {
            "bi_algo": ("normal", "fx"),
            "bi_fx_check": ("strict", "loss", "half", "totally"),
            "seg_algo": ("chan", "1+1", "break"),
            "left_seg_method": ("peak", "all"),
            "zs_combine_mode": ("zs", "peak"),
            "zs_algo": ("normal", "over_seg", "auto"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name}={getattr(self, name)!r}, expected one of {values}")
        if self.zs_algo == "over_seg" and self.one_bi_zs:
            raise ValueError("over_seg zones need one_bi_zs=False")

    @classmethod
    def from_dict(cls, conf: dict) -> "StructureConfig":
        """Flat settings; `name-buy`, `name-sell`, `name-seg`, `name-segbuy`, `name-segsell` narrow a point rule."""
        own = {f.name for f in fields(cls)} - {"buy", "sell", "seg_buy", "seg_sell"}
        rule = {f.name for f in fields(PointRules)}
        sides = {"buy": ("buy",), "sell": ("sell",), "segbuy": ("seg_buy",), "segsell": ("seg_sell",), "seg": ("seg_buy", "seg_sell")}
        base: dict = {}
        shared: dict = {}
        narrow: dict[str, dict] = {"buy": {}, "sell": {}, "seg_buy": {}, "seg_sell": {}}
        for key, value in conf.items():
            name, _, side = key.partition("-")
            if not side and name in own:
                base[name] = value
            elif not side and name in rule:
                shared[name] = value
            elif side in sides and name in rule:
                for target in sides[side]:
                    narrow[target][name] = value
            else:
                raise ValueError(f"unknown setting {key}")
        stroke = replace(PointRules(), **shared)
        segment = replace(PointRules(), **{**shared, "macd_algo": "slope", "bsp1_only_multibi_zs": False})
        return cls(
            **base,
            buy=replace(stroke, **narrow["buy"]),
            sell=replace(stroke, **narrow["sell"]),
            seg_buy=replace(segment, **narrow["seg_buy"]),
            seg_sell=replace(segment, **narrow["seg_sell"]),
        )


# The settings the screening jobs use.
SCREEN = {"divergence_rate": 0.7, "min_zs_cnt": 0, "bs_type": "1,2,3a,1p,2s,3b"}
