"""Closed vocabularies, weights and feature lists. Fixed values, in their natural order."""

# Participant types in the order that decides ties.
RETAIL, HOT_MONEY, QUANT = "散户", "游资", "量化"
TYPES = (RETAIL, HOT_MONEY, QUANT)

# Intents.
BUY, SELL, NEUTRAL, DAY_TRADE = "买入", "卖出", "中性", "T0交易"
INTENTS = (BUY, SELL, NEUTRAL, DAY_TRADE)

# Market phases.
ACCUMULATE, PROBE, RALLY, DISTRIBUTE, CONSOLIDATE = "吸筹", "试盘", "拉升", "派发", "整理"
PHASES = (ACCUMULATE, PROBE, RALLY, DISTRIBUTE, CONSOLIDATE)

# Trading patterns, their explanations and the intent that each suggests.
PATTERNS = {
    "大单吸筹": ("资金大笔挂单买入，短时间内集中扫货", BUY),
    "对倒拉升": ("通过自买自卖制造成交量放大假象，吸引跟风盘", BUY),
    "压单吸货": ("在卖盘挂大单压制股价，同时在低位悄悄吸纳筹码", BUY),
    "尾盘突袭": ("在下午2点半之后集中拉升，制造假象和典型技术形态", BUY),
    "集合竞价异动": ("在集合竞价阶段大幅拉高或压低，影响开盘价", BUY),
    "分时脉冲": ("短时间内快速拉升后迅速回落，试探上方抛压", BUY),
    "量化T0": ("利用Level2行情数据高频捕捉盘口价差，自动完成T0回转", DAY_TRADE),
    "日内套利": ("资金在一定价格区间来回高抛低吸", DAY_TRADE),
    "连续小单推升": ("用大量小单持续买入缓慢推高股价，避免引起注意", BUY),
    "盘中诱多": ("盘中快速拉升吸引跟风后迅速砸盘出货", SELL),
    "涨停板打开": ("封涨停后反复打开，制造换手假象引诱散户接盘", SELL),
    "散户博弈": ("全天成交量低迷，缺乏主力引导，散户之间互相换手", NEUTRAL),
}
DEFAULT_PATTERN = "散户博弈"

# Score weights of each participant type.
WEIGHTS = {
    QUANT: {"regularity": 1.0, "rs_split_similarity": 0.8, "cb_fast_cancel_ratio": 0.7, "t0_balance": 0.6, "iceberg": 0.5, "iceberg_repeat": 0.6},
    HOT_MONEY: {
        "oss_hot_money_count_pct": 1.0,
        "edge_concentration": 0.9,
        "pi_herfindahl_30min": 0.6,
        "aggression": 0.8,
        "oss_mega_amount_pct": 0.7,
        "manual_irregularity": 0.5,
        "big_order_pct": 0.7,
    },
    RETAIL: {"small_order_pct": 1.0, "low_big_order": 0.9, "direction_noise": 0.7, "low_concentration": 0.6, "oss_small_amount_pct": 0.6, "l1_order_entropy": 0.6},
}

# Model features and the distribution vector, in order.
MODEL_FEATURES = (
    "regularity manual_irregularity iceberg spoof aggression net_active balance edge_concentration impact_per_amount t0_balance rs_interval_cv "
    "rs_split_similarity cb_fast_cancel_ratio oss_hot_money_count_pct oss_mega_amount_pct pi_herfindahl_30min pi_max_price_impact_pct "
    "ap_unilateral_intensity iceberg_repeat l1_order_entropy ob_imbalance_10 depth_slope_bid"
).split()
DISTRIBUTION = ["oss_mega_amount_pct", "oss_large_amount_pct", "oss_medium_amount_pct", "oss_small_amount_pct", "oss_buy_amount_pct", "oss_sell_amount_pct"]

# Columns of the two submission tables.
PATTERN_COLUMNS = ["stock_code", "transaction_date", "pattern_type", "pattern_explanation"]
PREDICT_COLUMNS = ["stock_code", "transaction_date", "capital_type", "capital_intention"]
