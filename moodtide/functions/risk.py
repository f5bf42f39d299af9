"""Risk level, product score, and the bands shown next to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.fixed_values import (
    DRAWDOWN_WEIGHT,
    HIGH_FROM,
    LEVEL_HIGH,
    LEVEL_LOW,
    LEVEL_MID,
    MID_FROM,
    REASON_SENTIMENT_FROM,
    REASON_VOLATILITY_FROM,
    REASON_YIELD_FROM,
    SHARPE_SCALE,
    SHARPE_WEIGHT,
    STEP_DOWN_ABOVE,
    YIELD_WEIGHT,
)

REASON_CALM_GROWTH = "growth"
REASON_STEADY = "steady"
REASON_BALANCED = "balanced"

# printf templates over (yield, drawdown, sharpe, score), by reason code
REASON_TEMPLATES = {
    REASON_STEADY: (
        "夏普比率 %3$.2f,最大回撤 %2$.2f%%:近期情绪起伏较大,此产品更能抵御波动。"
        "匹配得分 %4$.2f。"
    ),
    REASON_CALM_GROWTH: (
        "年化收益 %1$.2f%%,夏普比率 %3$.2f:情绪平稳且乐观,可追求更高收益。"
        "匹配得分 %4$.2f。"
    ),
    REASON_BALANCED: (
        "年化收益 %1$.2f%%,最大回撤 %2$.2f%%,夏普比率 %3$.2f:收益与风险相对均衡。"
        "匹配得分 %4$.2f。"
    ),
}


def settled(statistic: Column) -> Column:
    """A mean or deviation as compared with thresholds.

    The last bits of a distributed sum depend on the order rows arrive in. Twelve places are
    far above that noise, so a mean of exactly 0.52 is 0.52 on every run.
    """
    return F.round(statistic, 12)


def risk_level(
    avg_sentiment: Column,
    volatility: Column,
    high_from: float = HIGH_FROM,
    mid_from: float = MID_FROM,
    step_down_above: float = STEP_DOWN_ABOVE,
) -> Column:
    """Level by mean score; one level lower when the scores vary strongly."""
    mean = settled(avg_sentiment)
    jumpy = settled(volatility) > step_down_above
    return (
        F.when((mean >= high_from) & ~jumpy, F.lit(LEVEL_HIGH))
        .when(mean >= high_from, F.lit(LEVEL_MID))
        .when((mean >= mid_from) & ~jumpy, F.lit(LEVEL_MID))
        .otherwise(F.lit(LEVEL_LOW))
    )


def product_score(
    annual_yield: Column, sharpe: Column, drawdown: Column, volatility: Column
) -> Column:
    return (
        annual_yield * YIELD_WEIGHT
        + sharpe * SHARPE_SCALE * SHARPE_WEIGHT
        - drawdown * volatility * DRAWDOWN_WEIGHT
    )


def reason_code(
    avg_sentiment: Column, volatility: Column, annual_yield: Column
) -> Column:
    return (
        F.when(settled(volatility) >= REASON_VOLATILITY_FROM, F.lit(REASON_STEADY))
        .when(
            (settled(avg_sentiment) >= REASON_SENTIMENT_FROM)
            & (annual_yield >= REASON_YIELD_FROM),
            F.lit(REASON_CALM_GROWTH),
        )
        .otherwise(F.lit(REASON_BALANCED))
    )


def reason_text(
    code: Column,
    annual_yield: Column,
    drawdown: Column,
    sharpe: Column,
    score: Column,
    templates: dict[str, str] | None = None,
) -> Column:
    text = F.when(F.lit(False), F.lit(""))
    for name, template in (templates or REASON_TEMPLATES).items():
        text = text.when(
            code == name,
            F.format_string(template, annual_yield, drawdown, sharpe, score),
        )
    return text


def market_band(global_avg: Column) -> Column:
    return (
        F.when(settled(global_avg) >= 0.6, F.lit("positive"))
        .when(settled(global_avg) >= 0.4, F.lit("neutral_to_bearish"))
        .otherwise(F.lit("bearish"))
    )


def score_band(score: Column) -> Column:
    return (
        F.when(settled(score) >= 9, F.lit("high"))
        .when(settled(score) >= 7.5, F.lit("mid"))
        .otherwise(F.lit("low"))
    )


def drawdown_band(drawdown: Column) -> Column:
    return (
        F.when(drawdown <= 1, F.lit("low"))
        .when(drawdown <= 10, F.lit("mid"))
        .otherwise(F.lit("high"))
    )


def sentiment_band(avg_sentiment: Column) -> Column:
    return (
        F.when(settled(avg_sentiment) >= 0.6, F.lit("high"))
        .when(settled(avg_sentiment) >= 0.4, F.lit("mid"))
        .otherwise(F.lit("low"))
    )


def volatility_band(volatility: Column) -> Column:
    return (
        F.when(settled(volatility) > 0.15, F.lit("high"))
        .when(settled(volatility) >= 0.1, F.lit("mid"))
        .otherwise(F.lit("low"))
    )
