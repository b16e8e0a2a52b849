"""Result labels and decision tables shared by the rules."""

# Signals and positions
IN_ZONE_BUY = "Buy-中枢内买点"
BUYS = {"3": "Buy-三买", "2": "Buy-二买", "1": "Buy-一买"}
SELLS = {"3": "Sell-三卖", "2": "Sell-二卖", "1": "Sell-一卖"}
INSIDE, ABOVE, BELOW, NOWHERE = "内", "上", "下", "-"
OTHER = "其他"

# Volume and price
VOL_DOWN = "放量下跌 — 主力出货信号"
VOL_UP = "放量上涨 — 主力吸筹信号"
THIN_UP = "缩量上涨 — 惜售信号，趋势延续"
THIN_DOWN = "缩量下跌 — 无人接盘，趋势偏弱"
VOL_NORMAL = "量价正常"
VOL_SHORT = "数据不足"

# Confirmation of a point
CONFIRM_INSIDE = "中枢内买点 — 标准二买/三买形态"
CONFIRM_THIRD = "三买/三卖 — 最强信号，需量能配合"
CONFIRM_BELOW = "中枢下买点 — 风险偏高，等次级别确认"
CONFIRM_SELL = "卖出信号 — 中枢上方减仓或中枢下破止损"
RISK_MID, RISK_LOW, RISK_HIGH = "中", "低", "偏高"

# Query text of a signal
QUERY_PARTS = [("1", "一类买点 背驰 "), ("2", "二类买点 中枢下沿 "), ("3", "三类买点 中枢上破 "), ("1p", "盘整背驰买点 ")]
QUERY_POSITION = {"内": "中枢震荡 区间套", "下": "中枢下方 支撑", "上": "中枢上方 压力"}
QUERY_DEFAULT = "买卖点 确认 操作"

# Smart-money view: concept names and verdicts
SMC_SHIFT = "Market Structure Shift (CHoCH)"
SMC_RANGE = "Range / Consolidation"
SMC_BLOCK = "Order Block"
SMC_PREMIUM = "Premium Zone"
SMC_DISCOUNT = "Discount Zone"
SMC_POOL = "Liquidity Pool"
SMC_GAP = "Fair Value Gap"
SMC_UP, SMC_DOWN, SMC_NONE = "SMC与缠论共振看多", "SMC与缠论共振看空", "SMC辅助但需更多确认"

# Market regime × score: (threshold, grade, decision, position %)
REGIMES = {
    "主升": [(80, "A", "低吸建仓", 20), (65, "B", "试探仓", 15), (50, "C", "试探仓", 10), (0, "D", "不介入", 0)],
    "震荡偏强": [(80, "A", "低吸建仓", 15), (65, "B", "试探仓", 10), (50, "C", "微量试探", 5), (0, "D", "不介入", 0)],
    "震荡偏弱": [(80, "A", "试探仓", 10), (65, "B", "微量试探", 5), (50, "C", "不介入", 0), (0, "D", "不介入", 0)],
    "退潮": [(80, "A", "微量试探", 5), (65, "B", "不介入", 0), (50, "C", "不介入", 0), (0, "D", "不介入", 0)],
    "冰点": [(80, "D", "不介入", 0), (65, "D", "不介入", 0), (50, "D", "不介入", 0), (0, "D", "不介入", 0)],
}
DEFAULT_REGIME = "震荡偏弱"
FIX_HOT, FIX_COLD, FIX_SECTOR = "资金强但技术超买-5", "技术好但资金不配合-3", "板块强但个股资金不跟-2"

# Leader levels: action, position, entry, stop, cycle
ADVICE = {
    "S": ("龙头-重仓", "15-20%", "回踩5日线或分时承接", "-3%短线止损", "3-5天"),
    "A": ("强股-试探", "10-15%", "放量突破前高或中枢上沿", "-3%短线止损", "2-3天"),
    "B": ("观察", "≤5%", "等回踩中枢下沿确认", "买入价-3%", "1-2天"),
}

# Factor presets: column, comparison that fails, limit
PRESETS = {
    "成长股": [("roe", "<", 15), ("revenue_growth", "<", 20), ("gross_margin", "<", 30)],
    "价值股": [("pe", ">", 15), ("pb", ">", 2), ("dividend_yield", "<", 2)],
    "质优股": [("roe", "<", 20), ("gross_margin", "<", 40), ("debt_ratio", ">", 50)],
    "困境反转": [("pe", ">", 10)],
    "小盘成长": [("market_cap", ">", 200), ("roe", "<", 12), ("revenue_growth", "<", 25)],
    "高现金流": [("fcf", "<=", 0), ("cash_to_debt", "<", 1.0), ("roe", "<", 10)],
}
# Declared for the turnaround preset but off unless asked for: historical PE percentile and narrowing decline.
TURNAROUND_EXTRA = [("pe_historical_pct", ">", 20), ("revenue_narrowing", "<=", 0)]
NO_MATCH = "无匹配"

# Sector, macro and futures classes
SECTOR_LEAD, SECTOR_STRONG, SECTOR_FLAT, SECTOR_WEAK, SECTOR_NONE = "🔥 板块领涨", "🟢 板块偏强", "🟡 板块中性", "🔴 板块偏弱", "无数据"
LONG, SHORT, NEUTRAL = "偏多", "偏空", "中性"
USD_STRONG, USD_WEAK = "USD强→商品承压", "USD弱→商品利好"
PANIC, CALM, HIGH_RATE = "恐慌→降仓", "低波→正常仓位", "高利率→成长股承压"
INVERTED, NORMAL = "倒挂", "正常"
VIX_CLASSES = [(30, "极度恐慌"), (25, "恐慌"), (20, "偏恐慌"), (15, "正常")]
VIX_LOW = "极度乐观"
WARN_EXTENDED = "⚠️二买存疑"

# Named macro series
MACRO_SERIES = ["US3M", "US2Y", "US5Y", "US10Y", "US30Y", "DXY", "USDCNY", "USDJPY", "EURUSD", "VIX", "SPX", "N225",
                "HSI", "OIL", "GOLD", "COPPER"]

# Structure × money flow × sector -> action, size factor
FUSION = [
    ("buy", "positive", "resonant", "normal", 1.0),
    ("buy", "weak", "resonant", "half_or_wait", 0.5),
    ("buy", "positive", "none", "micro_test", 0.1),
    ("none", "positive", "hot", "do_not_chase", 0.0),
    ("oscillation", "mixed", "mixed", "intraday_only", 0.25),
    ("sell", "any", "any", "reduce_or_exit", 0.0),
    ("unclear", "any", "any", "observe", 0.0),
]
FUSION_MODIFIER = {"confirmed_buy": 5, "possible_buy": 2, "unclear": 0, "zone_reentry": -3, "confirmed_sell": -5}
SIZE_CAP = [("high", "strong", "existing"), ("high", "weak", "half"), ("medium", "any", "micro"), ("low", "any", "none"),
            ("sell", "any", "exit")]

# Report sections in order
SECTIONS = ["🗓️ 未来一周关键事件", "🇨🇳 中国宏观", "🌍 美国宏观", "📈 股指期货持仓", "🔥 板块热点 (概念+行业)",
            "🎯 A股买入标的 (中枢内)", "🇭🇰 港股机会", "📋 操作建议"]
