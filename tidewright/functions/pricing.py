"""Fee arithmetic in integers: pricing, escalation ladders, backoff.

Columns are BIGINT, whose DIV floors exactly; *_wide do the same over the full unsigned 128-bit range, as Python
integers or, for columns of decimal text, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U128 = 2**128 - 1
U64 = 2**64 - 1
U32 = 2**32 - 1


class PricingError(ValueError):
    pass


@dataclass(frozen=True)
class Fees:
    max_fee: int
    priority_fee: int

    def clamped(self) -> Fees:
        return Fees(self.max_fee, min(self.priority_fee, self.max_fee))


def price_wide(estimate: Fees, gas: int, bump: int = 100, profit: int | None = None, bid: int | None = None) -> Fees:
    """Without a bid: what the estimate leaves above its priority fee, plus the bumped priority fee. With one: that
    percentage of the profit per unit of gas, and the bumped priority fee clamped to it."""
    headroom = max(0, estimate.max_fee - estimate.priority_fee)
    tip = min(U128, estimate.priority_fee * bump) // 100
    if bid is None:
        return Fees(min(U128, headroom + tip), tip).clamped()
    if bid > 100:
        raise PricingError(f"bid of {bid} % exceeds 100 %")
    if not gas:
        raise PricingError("gas is zero")
    return Fees(min(U128, (profit or 0) // gas * bid) // 100, tip).clamped()


def escalate_wide(fees: Fees, percent: int) -> Fees:
    """Both fees times percent / 100, floored, never over 128 bits; then clamped."""
    return Fees(*(min(U128, v * percent // 100) for v in (fees.max_fee, fees.priority_fee))).clamped()


def escalation_percent(percent: int) -> int:
    """At least 110, or nodes refuse the replacement."""
    if percent < 110:
        raise PricingError(f"an escalation of {percent} % is under 110 %")
    return percent


class ReplacementSchedule:
    """The fees of each attempt: the first, then escalations, None when max_replacements are used up."""

    def __init__(self, fees: Fees, percent: int, max_replacements: int):
        self.fees, self.percent, self.left, self.issued = fees, escalation_percent(percent), max_replacements, 1

    def escalate(self) -> Fees | None:
        if not self.left:
            return None
        self.left -= 1
        self.issued += 1
        self.fees = escalate_wide(self.fees, self.percent)
        return self.fees


def backoff_ms(base_ms: int, attempt: int) -> int:
    """base times 2^attempt, the factor at most 2^32 - 1."""
    return min(base_ms * min(1 << min(attempt, 32), U32), U64)


def backoff_column(base_ms: Column, attempt: Column) -> Column:
    factor = F.when(attempt >= 32, F.lit(U32)).otherwise(F.pow(F.lit(2.0), F.least(attempt, F.lit(32))).cast("long"))
    return base_ms * F.least(factor, F.lit(U32))


def price_columns(max_fee: Column, priority_fee: Column, gas: Column, bump: Column, profit: Column | None = None, bid: Column | None = None) -> tuple[Column, Column, Column]:
    """(max_fee, priority_fee, error) as BIGINT, BIGINT and text; fees are null where there is an error."""
    div = lambda a, b: F.call_function("div", a, b)
    tip = div(priority_fee * bump, F.lit(100).cast("long"))
    free = F.greatest(max_fee - priority_fee, F.lit(0).cast("long")) + tip
    if bid is None:
        return free, F.least(tip, free), F.lit(None).cast("string")
    error = F.when(bid > 100, F.lit("bid exceeds 100 percent")).when(bid.isNotNull() & (gas == 0), F.lit("gas is zero"))
    per_gas = div(profit, F.when(gas != 0, gas))
    top = F.when(error.isNull(), F.when(bid.isNull(), free).otherwise(div(per_gas * bid, F.lit(100).cast("long"))))
    return top, F.when(error.isNull(), F.least(tip, top)), error


def ladder_columns(max_fee: Column, priority_fee: Column, percent: int, steps: int) -> Column:
    """Array of (attempt, max_fee, priority_fee): the first attempt and `steps` escalations, each of the one before."""
    percent = escalation_percent(percent)
    up = lambda v: F.call_function("div", v * F.lit(percent).cast("long"), F.lit(100).cast("long"))
    rung = lambda n, m, p: F.struct(n.cast("int").alias("attempt"), m.alias("max_fee"), F.least(p, m).alias("priority_fee"))
    first = F.array(rung(F.lit(0), max_fee.cast("long"), priority_fee.cast("long")))
    if not steps:
        return first

    def more(rungs: Column, n: Column) -> Column:
        last = F.element_at(rungs, -1)
        return F.concat(rungs, F.array(rung(n, up(last["max_fee"]), up(last["priority_fee"]))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, more)


def price_wide_udf():
    """An Arrow UDF over decimal text (max_fee, priority_fee, gas, bump, profit, bid) -> struct of text fees and error."""

    @F.pandas_udf("max_fee string, priority_fee string, error string")
    def price(max_fee: pd.Series, priority_fee: pd.Series, gas: pd.Series, bump: pd.Series, profit: pd.Series, bid: pd.Series) -> pd.DataFrame:
        rows = []
        for m, p, g, b, r, d in zip(max_fee, priority_fee, gas, bump, profit, bid, strict=True):
            try:
                if any(pd.isna(x) for x in (m, p, g, b)):
                    rows.append((None, None, None))
                    continue
                fees = price_wide(Fees(int(m), int(p)), int(g), int(b), None if pd.isna(r) else int(r), None if pd.isna(d) else int(d))
                rows.append((str(fees.max_fee), str(fees.priority_fee), None))
            except PricingError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["max_fee", "priority_fee", "error"])

    return price
