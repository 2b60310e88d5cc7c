"""Queries of plans, prices and quota periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import folds
from quire.operators import plans as P
from quire.plans.tables import read

NOW = "TIMESTAMP '1998-01-15 12:00:00'"
#: Test accounts: a country, plan, end, and the plan bought, by key.
COUNTRIES = ["CM", "fr", "MA", "US", "IN", "SN", "ZZ"]
HELD = ["free", "starter", "pro", "enterprise", "admin"]
PRICES_SQL = "prices(zone, plan, month, year) AS (VALUES " + ", ".join(f"('{z}', '{p}', {'NULL' if m is None else m}::BIGINT, {'NULL' if y is None else y}::BIGINT)" for z, ps in P.PRICES.items() for p, (m, y) in ps.items()) + ")"


def list_sql(xs, i):
    return "[" + ", ".join(f"'{x}'" for x in xs) + f"][({i} + 1)::INT]"


ZONE_SQL = " ".join(f"WHEN upper(country) IN ({', '.join(repr(c) for c in names.split())}) THEN '{z}'" for z, names in P.ZONES.items())
ACCOUNTS_SQL = f"""{PRICES_SQL}, a0 AS (SELECT c_custkey AS user_id, {list_sql(COUNTRIES, 'c_nationkey % 7')} AS country, {list_sql(HELD, 'c_custkey % 5')} AS plan,
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {NOW} - INTERVAL 1 DAY ELSE {NOW} + INTERVAL 20 DAY END AS expires, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {NOW} - to_days((c_custkey % 97)::INT) END AS started,
 CASE WHEN (c_custkey // 5) % 2 = 0 THEN 'starter' ELSE 'pro' END AS bought, c_custkey % 2 = 0 AS annual FROM customer),
accounts AS (SELECT *, CASE {ZONE_SQL} ELSE 'C' END AS zone, CASE WHEN expires <= {NOW} THEN 'free' ELSE plan END AS held FROM a0),
ranked AS (SELECT *, CASE held WHEN 'free' THEN 0 WHEN 'starter' THEN 1 WHEN 'pro' THEN 2 END AS rank, CASE bought WHEN 'starter' THEN 1 ELSE 2 END AS bought_rank FROM accounts),
rights AS (SELECT *, rank IS NULL OR rank > bought_rank OR (held = bought AND expires IS NULL) AS loses FROM ranked)"""


def now():
    return F.expr("TIMESTAMP_NTZ '1998-01-15 12:00:00'")


def day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def accounts(s, d):
    k = F.col("c_custkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    return read(s, d, "customer").select(
        k.alias("user_id"), pick(COUNTRIES, F.col("c_nationkey") % 7).alias("country"), pick(HELD, k % 5).alias("plan"),
        F.when(k % 3 == 1, now() - F.make_dt_interval(F.lit(1))).when(k % 3 == 2, now() + F.make_dt_interval(F.lit(20))).alias("expires"),
        F.when(k % 4 != 0, now() - F.make_dt_interval((k % 97).cast("int"))).alias("started"),
        F.when(F.floor(k / 5) % 2 == 0, "starter").otherwise("pro").alias("bought"), (k % 2 == 0).alias("annual"),
    ).withColumn("zone", P.zone(F.col("country")))


def C(*names):
    return [F.col(n) for n in names]


def price_by_zone(s, d):
    return accounts(s, d).select("user_id", "zone", P.currency(F.col("zone")).alias("currency"), P.page_price(F.col("zone")).alias("page"), P.price(*C("plan", "zone", "annual")).alias("price"))


def price_grid(s, d):
    """Every plan in every zone: the library's own table of fixed size."""
    rows = [(p, z, m, y) for z, ps in P.PRICES.items() for p, (m, y) in ps.items()]
    return s.createDataFrame(rows, "plan string, zone string, month long, year long").withColumn("quote", F.col("month").isNull())


def plan_offer(s, d):
    p = P.price(*C("bought", "zone", "annual"))
    months = F.when(F.col("annual"), 12).otherwise(1).cast("long")
    return accounts(s, d).select("user_id", p.alias("monthly"), months.alias("months"), (p * months).alias("total"))


def loses_rights(s, d):
    return accounts(s, d).select("user_id", P.loses_rights(*C("plan", "expires", "bought"), now()).alias("loses"))


def carry_over(s, d):
    return accounts(s, d).select("user_id", P.carried(*C("plan", "expires", "bought", "zone"), now()).alias("micros"))


def apply_plan(s, d):
    a = accounts(s, d)
    out = P.applied(*C("plan", "started", "expires", "bought"), F.when(F.col("annual"), 12).otherwise(1), F.col("zone"), now())
    return a.select("user_id", out["new_plan"].alias("plan"), day(out["started"]).alias("started"), day(out["ends"]).alias("ends"), out["refund_due"].alias("refund_due"))


CARRY_SQL = f"CASE WHEN plan <> bought AND expires > {NOW} AND o.month > 0 AND n.month > 0 THEN round_even((epoch_us(expires) - epoch_us({NOW}))::DOUBLE * (o.month / n.month), 0)::BIGINT ELSE 0 END"
JOIN_SQL = "FROM rights r LEFT JOIN prices o ON o.zone = r.zone AND o.plan = r.plan LEFT JOIN prices n ON n.zone = r.zone AND n.plan = r.bought"


def quota_period(s, d):
    lo, hi = P.quota_period(*C("started", "expires"), now())
    started = F.col("started") - F.make_dt_interval(F.lit(30) * (F.col("user_id") % 5).cast("int"), F.lit(0), F.lit(7))
    a = accounts(s, d).withColumn("started", started)
    return a.select("user_id", day(lo).alias("start"), day(hi).alias("end"))


QUOTA_SQL = f"""WITH {ACCOUNTS_SQL}, q AS (SELECT user_id, expires, started - to_days((30 * (user_id % 5))::INT) - INTERVAL 7 MINUTE AS st FROM accounts), m AS (SELECT *, greatest(0, (1998 - year(st)) * 12 + 1 - month(st)) AS n FROM q),
k AS (SELECT *, n - CASE WHEN n > 0 AND st + to_months(n::INT) > {NOW} THEN 1 ELSE 0 END AS k FROM m)
SELECT user_id, strftime(CASE WHEN st IS NULL OR expires IS NULL THEN TIMESTAMP '1998-01-01' ELSE st + to_months(k::INT) END, '%Y-%m-%d %H:%M:%S') AS start, strftime(CASE WHEN st IS NULL OR expires IS NULL THEN TIMESTAMP '1998-02-01' ELSE st + to_months((k + 1)::INT) END, '%Y-%m-%d %H:%M:%S') AS "end" FROM k"""


def storage_charge(s, d):
    """Documents in the order they came: a size is charged if it still fits; administrators pay nothing."""
    f = read(s, d, "documents").select((F.col("doc_id") % 97).alias("user_id"), "doc_id", F.col("n_chars").cast("long").alias("size"))
    out = folds.fold(f, ["user_id"], ["doc_id"], folds.charged("size", 20_000), "charged long", ["charged"])
    return out.select("user_id", "doc_id", F.when(F.col("user_id") == 0, F.col("size")).otherwise(F.col("charged")).alias("charged"))


STORAGE_SQL = """WITH RECURSIVE f AS (SELECT doc_id % 97 AS user_id, doc_id, n_chars::BIGINT AS size, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS rn FROM documents),
g AS (SELECT user_id, doc_id, rn, size, CASE WHEN size <= 20000 THEN size ELSE 0 END AS charged, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used FROM f WHERE rn = 1
 UNION ALL SELECT f.user_id, f.doc_id, f.rn, f.size, CASE WHEN g.used + f.size <= 20000 THEN f.size ELSE 0 END, g.used + CASE WHEN g.used + f.size <= 20000 THEN f.size ELSE 0 END FROM g JOIN f ON f.user_id = g.user_id AND f.rn = g.rn + 1)
SELECT user_id, doc_id, CASE WHEN user_id = 0 THEN size ELSE charged END AS charged FROM g"""

QUERIES = {
    "price_by_zone": (price_by_zone, f"WITH {ACCOUNTS_SQL} SELECT user_id, a.zone, CASE a.zone WHEN 'A' THEN 'XAF' WHEN 'B' THEN 'USD' ELSE 'EUR' END AS currency, CASE a.zone WHEN 'A' THEN 75 WHEN 'B' THEN 12 ELSE 19 END AS page, CASE WHEN annual THEN year ELSE month END AS price FROM accounts a LEFT JOIN prices p ON p.zone = a.zone AND p.plan = a.plan"),
    "price_grid": (price_grid, f"WITH {PRICES_SQL} SELECT plan, zone, month, year, month IS NULL AS quote FROM prices"),
    "plan_offer": (plan_offer, f"WITH {ACCOUNTS_SQL} SELECT user_id, CASE WHEN annual THEN year ELSE month END AS monthly, CASE WHEN annual THEN 12 ELSE 1 END AS months, CASE WHEN annual THEN 12 * year ELSE month END AS total FROM accounts a JOIN prices p ON p.zone = a.zone AND p.plan = a.bought"),
    "loses_rights": (loses_rights, f"WITH {ACCOUNTS_SQL} SELECT user_id, loses FROM rights"),
    "carry_over": (carry_over, f"WITH {ACCOUNTS_SQL} SELECT user_id, {CARRY_SQL.replace('plan <>', 'r.plan <>')} AS micros {JOIN_SQL}"),
    "apply_plan": (apply_plan, f"""WITH {ACCOUNTS_SQL}, c AS (SELECT r.*, {CARRY_SQL.replace('plan <>', 'r.plan <>')} AS micros {JOIN_SQL})
SELECT user_id, CASE WHEN loses THEN plan ELSE bought END AS plan, strftime(CASE WHEN loses THEN started WHEN plan = bought AND expires > {NOW} THEN coalesce(started, {NOW}) ELSE {NOW} END, '%Y-%m-%d %H:%M:%S') AS started,
 strftime(CASE WHEN loses THEN expires WHEN plan = bought AND expires > {NOW} THEN expires + to_months(CASE WHEN annual THEN 12 ELSE 1 END) ELSE {NOW} + to_microseconds(micros) + to_months(CASE WHEN annual THEN 12 ELSE 1 END) END, '%Y-%m-%d %H:%M:%S') AS ends, loses AS refund_due FROM c"""),
    "quota_period": (quota_period, QUOTA_SQL),
    "storage_charge": (storage_charge, STORAGE_SQL),
}
