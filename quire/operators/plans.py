"""Plans, zones and quota periods. Money is in minor units; times are zone-free."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries by price zone (all others: C), and each zone's currency, page price and
#: monthly prices by plan, paid by the month and by the year (none: by quote).
ZONES = {
    "A": "CM GA TD CF CG GQ SN CI BF ML NE TG BJ GW NG GH KE TZ UG RW CD MG ET ZM",
    "B": "MA DZ TN EG IN PK BD ID PH VN TH BR MX CO AR PE TR UA RO BG RS",
}
CURRENCIES = {"A": "XAF", "B": "USD", "C": "EUR"}
PAGE_PRICES = {"A": 75, "B": 12, "C": 19}
PRICES = {
    "A": {"free": (0, 0), "starter": (1500, 1200), "pro": (4500, 3500), "enterprise": (None, None)},
    "B": {"free": (0, 0), "starter": (490, 390), "pro": (1190, 890), "enterprise": (None, None)},
    "C": {"free": (0, 0), "starter": (790, 590), "pro": (1990, 1490), "enterprise": (None, None)},
}
#: Order of the plans that can be bought; any other outranks them all.
RANKS = {"free": 0, "starter": 1, "pro": 2}


def _lookup(key: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def zone(country: Column) -> Column:
    c = F.upper(F.trim(country))
    return F.coalesce(*[F.when(c.isin(names.split()), F.lit(z)) for z, names in ZONES.items()], F.lit("C"))


def currency(z: Column) -> Column:
    return _lookup(z, CURRENCIES)


def page_price(z: Column) -> Column:
    return F.coalesce(_lookup(z, PAGE_PRICES), F.lit(PAGE_PRICES["C"])).cast("long")


def price(plan: Column, z: Column, annual: Column) -> Column:
    """Monthly price; null: by quote."""
    out = F.lit(None).cast("long")
    for k, plans in PRICES.items():
        for p, (month, year) in plans.items():
            out = F.when((z == k) & (plan == p), F.when(annual, F.lit(year).cast("long")).otherwise(F.lit(month).cast("long"))).otherwise(out)
    return out


def current(plan: Column, expires: Column, now: Column) -> Column:
    """The plan in force: an expired one counts as free."""
    return F.when(expires <= now, "free").otherwise(plan)


def loses_rights(plan: Column, expires: Column, bought: Column, now: Column) -> Column:
    """Whether buying a plan would take rights away: a plan that ranks higher or is not for sale, or
    the same one without an end."""
    held = current(plan, expires, now)
    rank = _lookup(held, RANKS)
    return rank.isNull() | (rank > _lookup(bought, RANKS)) | ((held == bought) & expires.isNull())


def carried(plan: Column, expires: Column, bought: Column, z: Column, now: Column) -> Column:
    """Microseconds of the bought plan that the paid rest of another one is worth."""
    old, new = price(plan, z, F.lit(False)), price(bought, z, F.lit(False))
    rest = (F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))).cast("double")
    worth = F.bround(rest * (old / new)).cast("long")
    return F.when((plan != bought) & (expires > now) & (old > 0) & (new > 0), worth).otherwise(F.lit(0).cast("long"))


def later(at: Column, micros: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)"))


def months_on(at: Column, months: Column) -> Column:
    """The same day and time so many months on, or the month's last day."""
    return at + F.make_ym_interval(F.lit(0), months.cast("int"))


def applied(plan: Column, started: Column, expires: Column, bought: Column, months: Column, z: Column, now: Column) -> dict[str, Column]:
    """Plan, start and end after a payment, and whether it is to be paid back instead."""
    refused = loses_rights(plan, expires, bought, now)
    same = (plan == bought) & (expires > now)
    begin = F.when(same, expires).otherwise(later(now, carried(plan, expires, bought, z, now)))
    return {
        "new_plan": F.when(refused, plan).otherwise(bought),
        "started": F.when(refused, started).when(same, F.coalesce(started, now)).otherwise(now),
        "ends": F.when(refused, expires).otherwise(months_on(begin, months)),
        "refund_due": refused,
    }


def quota_period(started: Column, expires: Column, now: Column) -> tuple[Column, Column]:
    """Start and end of the quota's month: from the day of subscription, or the calendar month where
    there is none. Both ends are counted from the subscription, so the 31st does not drift."""
    n = F.greatest(F.lit(0), (F.year(now) - F.year(started)) * 12 + F.month(now) - F.month(started))
    k = n - F.when((n > 0) & (months_on(started, n) > now), 1).otherwise(0)
    month = F.date_trunc("month", now).cast("timestamp_ntz")
    none = started.isNull() | expires.isNull()
    return F.when(none, month).otherwise(months_on(started, k)), F.when(none, months_on(month, F.lit(1))).otherwise(months_on(started, k + 1))
