"""Participant types, intents, market phases and patterns: rules over daily features.

Every rule is a column expression. A comparison with a missing figure is false, so rules fall
through to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import clip, half_even, number
from marlstone.functions.vocabulary import (
    ACCUMULATE,
    BUY,
    CONSOLIDATE,
    DAY_TRADE,
    DEFAULT_PATTERN,
    DISTRIBUTE,
    HOT_MONEY,
    NEUTRAL,
    PATTERNS,
    PROBE,
    QUANT,
    RALLY,
    RETAIL,
    SELL,
    WEIGHTS,
)
from marlstone.operators.features import with_ranges
from marlstone.operators.settling import settled

SCORES = {RETAIL: "retail_score", HOT_MONEY: "hot_money_score", QUANT: "quant_score"}


def weighted_score(within: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of batch-normalised features that are there; 0 where none is."""
    used = {c: w for c, w in weights.items() if c in within}
    if not used:
        return F.lit(0.0)
    return sum((w * within[c] for c, w in used.items()), F.lit(0.0)) / sum(used.values())


def classify_type(df: DataFrame, batch: str) -> DataFrame:
    """df with three scores, ``capital_type`` (ties: retail, hot money, quant) and its softmax confidence."""
    kinds = (QUANT, HOT_MONEY, RETAIL)
    names = [c for c in dict.fromkeys(c for t in kinds for c in WEIGHTS[t]) if c in df.columns]
    if names:
        df, within = with_ranges(settled(df), batch, names)
    else:
        within = {}
    df = df.withColumns({SCORES[t]: weighted_score(within, WEIGHTS[t]) for t in kinds}).drop("ranges")
    r, h, q = (F.col(SCORES[t]) for t in (RETAIL, HOT_MONEY, QUANT))
    best = F.when((r >= h) & (r >= q), RETAIL).when(h >= q, HOT_MONEY).otherwise(QUANT)
    top = F.greatest(r, h, q)
    confidence = 1 / (F.exp(r - top) + F.exp(h - top) + F.exp(q - top))
    return df.withColumns({"capital_type": best, "type_confidence": half_even(confidence)})


def classify_intent(df: DataFrame, net_tau: float = 0.15, balance_tau: float = 0.10, regular_tau: float = 0.6) -> DataFrame:
    """df with ``capital_intention`` and ``intention_confidence``."""
    net, one_sided, balance, regular = (number(df, c) for c in ("net_active", "ap_unilateral_intensity", "balance", "regularity"))
    day_trade = (F.abs(net) <= balance_tau) & (regular > regular_tau)
    intent = F.when(day_trade, DAY_TRADE).when(net > net_tau, BUY).when(net < -net_tau, SELL).otherwise(NEUTRAL)
    confidence = F.when(day_trade, balance * 0.6 + 0.4).otherwise(clip(F.abs(net), 0, 1) * 0.6 + clip(one_sided, 0, 1) * 0.4)
    return df.withColumns({"capital_intention": intent, "intention_confidence": half_even(confidence)})


def market_phase(df: DataFrame) -> DataFrame:
    """df with ``market_phase`` and ``phase_confidence``; the first rule that holds decides."""
    net, impact, ice, big = (number(df, c) for c in ("net_active", "pi_max_price_impact_pct", "iceberg", "oss_mega_amount_pct"))
    spoof, fast = number(df, "spoof"), number(df, "cb_fast_cancel_ratio")
    rules = [
        ((net > 0.1) & (impact > 2), RALLY, F.least(F.lit(1.0), 0.5 + impact / 10)),
        ((net < -0.1) & (impact > 1.5), DISTRIBUTE, F.least(F.lit(1.0), 0.5 + F.abs(net))),
        ((net > 0.05) & ((ice > 0.4) | (big > 0.3)) & (impact < 2), ACCUMULATE, F.least(F.lit(1.0), 0.5 + ice)),
        (((spoof > 0.2) | (fast > 0.4)) & (impact < 1.5), PROBE, F.lit(0.6)),
    ]
    phase, confidence = F.lit(CONSOLIDATE), F.lit(0.5)
    for holds, name, sure in reversed(rules):
        phase, confidence = F.when(holds, name).otherwise(phase), F.when(holds, sure).otherwise(confidence)
    return df.withColumns({"market_phase": phase, "phase_confidence": half_even(confidence)})


def pattern_of(df: DataFrame) -> Column:
    """The pattern of a row of (mean) features; the first rule that holds decides."""
    get = lambda c: number(df, c)
    either = lambda a, b: get(a if a in df.columns else b)
    regular, balance, edge, impact = get("regularity"), get("balance"), get("edge_concentration"), get("pi_max_price_impact_pct")
    net, ice, herf = get("net_active"), get("iceberg"), get("pi_herfindahl_30min")
    big, small = either("big_order_pct", "oss_mega_amount_pct"), either("small_order_pct", "oss_small_amount_pct")
    rules = [
        ((regular > 0.65) & (balance > 0.8), "量化T0"),
        ((edge > 0.5) & (impact > 2), "尾盘突袭"),
        ((net > 0.1) & ((ice > 0.4) | (big > 0.35)) & (impact < 3), "大单吸筹"),
        ((net > 0.05) & (big > 0.3) & (impact < 1.5), "压单吸货"),
        ((impact > 3) & (herf > 0.25), "分时脉冲"),
        ((F.abs(net) < 0.1) & (impact > 2), "对倒拉升"),
        ((small > 0.6) & (net > 0.05), "连续小单推升"),
        ((impact > 6) & (herf < 0.3), "涨停板打开"),
        ((net > 0.1) & (impact > 2.5), "盘中诱多"),
        (balance > 0.7, "日内套利"),
    ]
    found = F.lit(DEFAULT_PATTERN)
    for holds, name in reversed(rules):
        found = F.when(holds, name).otherwise(found)
    return found


def _lookup(of: Column, field: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in PATTERNS.items() for x in (k, v[field])])[of]


def explanation(pattern: Column) -> Column:
    return _lookup(pattern, 0)


def prior_intent(pattern: Column) -> Column:
    return _lookup(pattern, 1)


def _unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, so that a left join can't fan out; of several the least is taken."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("of_key")).select(*keys, "of_key.*")


def reconcile(predicted: DataFrame, patterns: DataFrame, phases: DataFrame | None = None, least_sure: float = 0.55) -> DataFrame:
    """Predictions joined with patterns (and phases) by (symbol, date), intents checked against priors.

    An intent that contradicts its pattern's prior gives way if its confidence is under
    ``least_sure`` (missing: 1).
    """
    keys = ["symbol", "date"]
    rows = predicted.join(_unique(patterns.select(*keys, "pattern_type"), keys), keys, "left")
    if phases is not None:
        rows = rows.join(_unique(phases.select(*keys, "market_phase", "phase_confidence"), keys), keys, "left")
    prior = prior_intent(F.col("pattern_type"))
    agrees = prior.isNull() | (prior == F.col("capital_intention"))
    gives_way = ~agrees & (F.coalesce("intention_confidence", F.lit(1.0)) < least_sure)
    rows = rows.withColumns({"intent_consistent": agrees | gives_way, "intent_overridden": gives_way})
    return rows.withColumn("capital_intention", F.when(F.col("intent_overridden"), prior).otherwise(F.col("capital_intention")))
