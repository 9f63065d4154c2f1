"""Cross-sectional queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as V
from ..fixtures import add_view
from ..functions.stats import safe_corr
from ..operators import xsection as XS
from ..session import staged
from .registry import query, r, rounded

KEYS = ["trade_date", "symbol"]
FACTORS = ["f_size", "f_value", "f_turn"]


def pct_sql(v: str, src: str, part: str = "trade_date") -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0::DOUBLE)"
            f" / count({v}) OVER (PARTITION BY {part})")


add_view("z_value", ("factors",), """
    SELECT trade_date, symbol, industry, next_ret, f_size, f_turn, (x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0) AS z
    FROM (SELECT *, w - avg(w) OVER (PARTITION BY trade_date, industry) AS x
          FROM (SELECT f.*, least(greatest(f_value, lo), hi) AS w FROM factors f
                JOIN (SELECT trade_date, quantile_cont(f_value, 0.01) AS lo, quantile_cont(f_value, 0.99) AS hi
                      FROM factors GROUP BY 1) q USING (trade_date)))
    WINDOW d AS (PARTITION BY trade_date)""")
add_view("q_value", ("z_value",), """
    SELECT trade_date, symbol, industry, next_ret, z, rows, bucket,
           rows >= 50 AND e0 < e1 AND
           count(DISTINCT bucket) OVER (PARTITION BY trade_date) = 5 AS valid
    FROM (SELECT z.*, rows, e0, e1, (e1 < z)::INT + (e2 < z)::INT + (e3 < z)::INT + (e4 < z)::INT AS bucket
          FROM z_value z JOIN (SELECT trade_date, count(z) AS rows, min(z) AS e0, quantile_cont(z, 0.2) AS e1, quantile_cont(z, 0.4) AS e2,
                                      quantile_cont(z, 0.6) AS e3, quantile_cont(z, 0.8) AS e4
                               FROM z_value GROUP BY 1) e USING (trade_date) WHERE z IS NOT NULL)""")


def z_value(spark, d):
    """Standardised value signal."""
    f = staged(V.factors(spark, d).select(*KEYS, "industry", "next_ret", "f_size", "f_turn", "f_value"))
    z = XS.industry_zscore(f, "f_value", out="z").drop("f_value")
    return staged(z)


def q_value(spark, d):
    return XS.qcut(z_value(spark, d), "z")


@query("winsorize_by_date", """
    SELECT trade_date, symbol, round(least(greatest(f_value, lo), hi), 10) AS f_value FROM factors
    JOIN (SELECT trade_date, quantile_cont(f_value, 0.01) AS lo, quantile_cont(f_value, 0.99) AS hi FROM factors GROUP BY 1)
    USING (trade_date)""", "factors")
def winsorize_by_date(spark, d):
    return rounded(XS.winsorize(staged(V.factors(spark, d).select(*KEYS, "f_value")), "f_value").select(*KEYS, "f_value"), "f_value", digits=10)


@query("industry_demean_zscore", "SELECT trade_date, symbol, round(z, 6) AS z FROM z_value", "z_value")
@query("factor_standardize", "SELECT trade_date, symbol, round(z, 6) AS z FROM z_value", "z_value")
def industry_demean_zscore(spark, d):
    return rounded(z_value(spark, d).select(*KEYS, "z"), "z")


@query("zscore_pop", """
    SELECT trade_date, symbol, round(CASE WHEN stddev_pop(f_size) OVER d > 0 THEN (f_size - avg(f_size) OVER d) / stddev_pop(f_size) OVER d
           ELSE 0.0 END, 6)::DOUBLE AS z FROM factors WINDOW d AS (PARTITION BY trade_date)""", "factors")
def zscore_pop(spark, d):
    return rounded(XS.zscore(V.factors(spark, d), "f_size", ddof=0, out="z", constant=0.0).select(*KEYS, "z"), "z")


@query("robust_standardize", """
    WITH m AS (SELECT *, abs(f_size - med) AS dev FROM factors JOIN
               (SELECT trade_date, quantile_cont(f_size, 0.5) AS med FROM factors GROUP BY 1) USING (trade_date)),
    q AS (SELECT trade_date, quantile_cont(dev, 0.5) AS mad FROM m GROUP BY 1)
    SELECT trade_date, symbol, round(coalesce((f_size - med) / nullif(mad, 0), 0), 6) AS robust
    FROM m JOIN q USING (trade_date)""", "factors")
def robust_standardize(spark, d):
    out = XS.robust_standardize(staged(V.factors(spark, d)), "f_size", out="robust")
    return rounded(out.select(*KEYS, "robust"), "robust")


@query("cross_section_pct_rank", f"""
    SELECT trade_date, symbol, round({pct_sql('f_turn', 'factors')} - 0.5, 6) AS cs_turn,
           round({pct_sql('f_size', 'factors')} - 0.5, 6) AS cs_size FROM factors""", "factors")
def cross_section_pct_rank(spark, d):
    f = staged(V.factors(spark, d).select(*KEYS, "f_turn", "f_size"))
    out = XS.pct_rank(XS.pct_rank(f, "f_turn", out="cs_turn", centre=0.5), "f_size", out="cs_size", centre=0.5)
    return rounded(out.select(*KEYS, "cs_turn", "cs_size"), "cs_turn", "cs_size")


@query("tercile_buckets", f"""
    SELECT trade_date, symbol, CASE WHEN p <= 1.0::DOUBLE / 3.0::DOUBLE THEN 'small' WHEN p <= 2.0::DOUBLE / 3.0::DOUBLE THEN 'mid' ELSE 'large' END AS size_bucket
    FROM (SELECT trade_date, symbol, {pct_sql('f_size', 'factors')} AS p FROM factors)""", "factors")
def tercile_buckets(spark, d):
    f = XS.pct_rank(staged(V.factors(spark, d).select(*KEYS, "f_size")), "f_size", out="p")
    return f.select(*KEYS, XS.thirds("p", ("small", "mid", "large")).alias("size_bucket"))


@query("cross_sectional_transform", f"""
    WITH w AS (SELECT trade_date, symbol, least(greatest(f_value, lo), hi) AS x FROM factors JOIN
               (SELECT trade_date, quantile_cont(f_value, 0.01) AS lo, quantile_cont(f_value, 0.99) AS hi, FROM factors GROUP BY 1) USING (trade_date)),
    m AS (SELECT *, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY trade_date)) AS dev,
                 x - quantile_cont(x, 0.5) OVER (PARTITION BY trade_date) AS c FROM w)
    SELECT trade_date, symbol, round((x - avg(x) OVER p) / nullif(stddev_samp(x) OVER p, 0), 6) AS zscore,
           round(coalesce(c / nullif(quantile_cont(dev, 0.5) OVER p, 0), 0), 6) AS robust,
           round({pct_sql('x', 'm')}, 6) AS rank
    FROM m WINDOW p AS (PARTITION BY trade_date)""", "factors")
def cross_sectional_transform(spark, d):
    f = staged(V.factors(spark, d).select(*KEYS, "f_value"))
    w = staged(XS.winsorize(f, "f_value", out="x").select(*KEYS, "x"))
    out = XS.robust_standardize(XS.zscore(w, "x", out="zscore"), "x", out="robust")
    out = XS.pct_rank(out, "x", out="rank")
    return rounded(out.select(*KEYS, "zscore", "robust", "rank"), "zscore", "robust", "rank")


@query("qcut_bucket", "SELECT trade_date, symbol, bucket, rows, valid FROM q_value", "q_value")
def qcut_bucket(spark, d):
    return q_value(spark, d).select(*KEYS, "bucket", "rows", "valid")


RESID_SQL = """
    SELECT trade_date, symbol, CASE WHEN n >= 30 THEN y - my - ba * (a - ma) - bb * (b - mb) END AS e FROM (
      SELECT s.*, n, my, ma, mb, (cay * cbb - cby * cab) / nullif(caa * cbb - cab * cab, 0) AS ba,
             (cby * caa - cay * cab) / nullif(caa * cbb - cab * cab, 0) AS bb
      FROM (SELECT trade_date, symbol, z AS y, f_size AS a, f_turn AS b FROM z_value) s
      JOIN (SELECT trade_date, count(*) AS n, avg(z) AS my, avg(f_size) AS ma, avg(f_turn) AS mb,
                   covar_pop(f_size, f_size) AS caa, covar_pop(f_size, f_turn) AS cab, covar_pop(f_turn, f_turn) AS cbb,
                   covar_pop(f_size, z) AS cay, covar_pop(f_turn, z) AS cby
            FROM z_value WHERE z IS NOT NULL GROUP BY 1) USING (trade_date))"""


@query("residualize_by_date", f"""
    WITH e AS ({RESID_SQL}) SELECT trade_date, symbol,
    round((e - avg(e) OVER d) / nullif(stddev_samp(e) OVER d, 0), 6) AS z_neutral FROM e WINDOW d AS (PARTITION BY trade_date)""",
       "z_value")
def residualize_by_date(spark, d):
    return rounded(XS.residualize(z_value(spark, d), "z", ("f_size", "f_turn")).select(*KEYS, "z_neutral"), "z_neutral")


@query("cross_section_corr_mean", """
    SELECT round(avg(c), 6) AS mean_corr, count(*) AS dates FROM (SELECT trade_date, corr(f_size, f_turn) AS c FROM factors
    GROUP BY 1 HAVING min(f_size) < max(f_size) AND min(f_turn) < max(f_turn))""", "factors")
def cross_section_corr_mean(spark, d):
    c = V.factors(spark, d).groupBy("trade_date").agg(safe_corr("f_size", "f_turn").alias("c")).where("c is not null")
    return c.agg(r(F.avg("c")).alias("mean_corr"), F.count(F.lit(1)).alias("dates"))


def ic_sql(part: str, score: str, src: str, minimum: int, target: str = "next_ret") -> str:
    """Per-group IC in SQL, from a table of (keys, score, target)."""
    return f"""SELECT {part}, count(*) AS obs, corr(s, t) AS pearson_ic, corr(rs, rt) AS rank_ic FROM (
        SELECT {part}, {score} AS s, {target} AS t,
               rank() OVER (PARTITION BY {part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {part}, {score}) - 1) / 2.0::DOUBLE AS rs,
               rank() OVER (PARTITION BY {part} ORDER BY {target}) + (count(*) OVER (PARTITION BY {part}, {target}) - 1) / 2.0::DOUBLE AS rt
        FROM {src} WHERE {score} IS NOT NULL AND {target} IS NOT NULL) GROUP BY {part} HAVING count(*) >= {minimum}"""


@query("daily_ic", f"""
    SELECT trade_date, obs, round(pearson_ic, 6) AS pearson_ic, round(rank_ic, 6) AS rank_ic
    FROM ({ic_sql('trade_date', 'f_turn', 'factors', 20)})""", "factors")
def daily_ic(spark, d):
    f = staged(V.factors(spark, d).select(*KEYS, "f_turn", "next_ret"))
    return rounded(XS.daily_ic(f, "f_turn", "next_ret"), "pearson_ic", "rank_ic")


@query("ic_mean", f"""SELECT round(avg(rank_ic), 6) AS ic, count(*) AS dates
    FROM ({ic_sql('trade_date', 'f_size', 'factors', 2)}) WHERE rank_ic IS NOT NULL""", "factors")
def ic_mean(spark, d):
    ic = XS.daily_ic(staged(V.factors(spark, d)), "f_size", "next_ret", min_obs=2).where("rank_ic is not null")
    return ic.agg(r(F.avg("rank_ic")).alias("ic"), F.count(F.lit(1)).alias("dates"))


LONG_SQL = " UNION ALL ".join(
    f"SELECT trade_date, symbol, next_ret, '{f}' AS factor, {f} AS score FROM factors" for f in FACTORS)


@query("ic_summary", f"""
    WITH long AS ({LONG_SQL}), ic AS ({ic_sql('factor, trade_date', 'score', 'long', 20)})
    SELECT factor, count(*) AS days, round(avg(rank_ic), 6) AS rank_ic_mean,
           round(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 6) AS rank_ic_ir, round(avg(pearson_ic), 6) AS pearson_ic_mean
    FROM ic GROUP BY 1""", "factors")
def ic_summary(spark, d):
    f = staged(V.factors(spark, d))
    long = XS.to_long(f, [*KEYS, "next_ret"], FACTORS)
    out = XS.ic_summary(XS.daily_ic(long, "score", "next_ret", ["factor", "trade_date"]), ["factor"])
    return rounded(out, "rank_ic_mean", "rank_ic_ir", "pearson_ic_mean")


add_view("bucketed", ("factors",), f"""
    SELECT *, CASE WHEN ps <= 1.0::DOUBLE / 3.0::DOUBLE THEN 'small' WHEN ps <= 2.0::DOUBLE / 3.0::DOUBLE THEN 'mid' ELSE 'large' END AS size_bucket,
           CASE WHEN pt <= 1.0::DOUBLE / 3.0::DOUBLE THEN 'low' WHEN pt <= 2.0::DOUBLE / 3.0::DOUBLE THEN 'mid' ELSE 'high' END AS turnover_bucket
    FROM (SELECT *, {pct_sql('f_size', 'factors')} AS ps, {pct_sql('turnover', 'factors')} AS pt FROM factors)""")


SIZES, TURNS = ("small", "mid", "large"), ("low", "mid", "high")


def bucketed(spark, d):
    f = staged(V.factors(spark, d).select(*KEYS, "f_size", "turnover", "f_value", "next_ret"))  # ranking moves every column it is given
    b = XS.pct_rank(XS.pct_rank(f, "f_size", out="ps"), "turnover", out="pt")
    return b.withColumns({"size_bucket": XS.thirds("ps", SIZES),
                          "turnover_bucket": XS.thirds("pt", TURNS)})


@query("bucket_ic", f"""
    WITH b AS (SELECT trade_date, f_value, next_ret, 'size_bucket' AS bucket_type, size_bucket, NULL AS turnover_bucket FROM bucketed
               UNION ALL SELECT trade_date, f_value, next_ret, 'turnover_bucket', NULL, turnover_bucket FROM bucketed
               UNION ALL SELECT trade_date, f_value, next_ret, 'size_x_turnover', size_bucket, turnover_bucket FROM bucketed),
    ic AS ({ic_sql('bucket_type, size_bucket, turnover_bucket, trade_date', 'f_value', 'b', 10)}),
    n AS (SELECT bucket_type, size_bucket, turnover_bucket, count(*) AS rows FROM b GROUP BY ALL),
    s AS (SELECT bucket_type, size_bucket, turnover_bucket, count(*) AS days, avg(rank_ic) AS m, stddev_pop(rank_ic) AS sd, avg(pearson_ic) AS p
          FROM ic GROUP BY ALL)
    SELECT n.bucket_type, n.size_bucket, n.turnover_bucket, rows, coalesce(days, 0) AS days, round(m, 6) AS rank_ic_mean,
           round(CASE WHEN days > 1 THEN m / nullif(sd, 0) END, 6) AS rank_ic_ir, round(p, 6) AS pearson_ic_mean
    FROM n LEFT JOIN s ON n.bucket_type = s.bucket_type AND n.size_bucket IS NOT DISTINCT FROM s.size_bucket
         AND n.turnover_bucket IS NOT DISTINCT FROM s.turnover_bucket""", "bucketed")
def bucket_ic(spark, d):
    b = staged(bucketed(spark, d).select(*KEYS, "f_value", "next_ret", "size_bucket", "turnover_bucket"))
    # A group travels as one small number: its two places in SIZES and TURNS, 0 where that bucket does not count.
    place = lambda c, names: F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0)).cast("int")
    size, turn = place("size_bucket", SIZES), place("turnover_bucket", TURNS)
    groups = F.explode(F.array(size * 4, F.lit(16) + turn, F.lit(32) + size * 4 + turn).cast("array<tinyint>"))
    long = b.select("trade_date", "f_value", "next_ret", groups.alias("g"))
    ic = XS.ic_summary(XS.daily_ic(long, "f_value", "next_ret", ["g", "trade_date"], 10), ["g"])
    out = (long.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).join(ic, "g", "left")
           .withColumn("days", F.coalesce("days", F.lit(0).cast("bigint"))))
    named = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int") - 1)
    kind = F.get(F.array(*[F.lit(k) for k in ("size_bucket", "turnover_bucket", "size_x_turnover")]), F.floor(F.col("g") / 16).cast("int"))
    out = out.select(kind.alias("bucket_type"), named(SIZES, F.floor(F.col("g") % 16 / 4)).alias("size_bucket"), named(TURNS, F.col("g") % 4).alias("turnover_bucket"),
                     *[c for c in out.columns if c != "g"])
    return rounded(out, "rank_ic_mean", "rank_ic_ir", "pearson_ic_mean")


@query("date_equal_weights", """
    SELECT trade_date, symbol, round(w / avg(w) OVER (), 6) AS weight FROM (
    SELECT trade_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS w FROM panel_supplier)""", "panel_supplier")
def date_equal_weights(spark, d):
    from ..operators.models import date_equal_weights as op
    return rounded(op(V.panel_supplier(spark, d)).select(*KEYS, "weight"), "weight")


@query("composite_score", """
    WITH z AS (SELECT trade_date, symbol, (f_size - avg(f_size) OVER d) / nullif(stddev_pop(f_size) OVER d, 0) AS a,
                      (f_value - avg(f_value) OVER d) / nullif(stddev_pop(f_value) OVER d, 0) AS b FROM factors WINDOW d AS (PARTITION BY trade_date))
    SELECT trade_date, symbol, round(-coalesce(a, 0) + coalesce(b, 0), 6) AS score FROM z""", "factors")
def composite_score(spark, d):
    from ..operators.portfolio import composite_score as op
    f = staged(V.factors(spark, d).select(*KEYS, "f_size", "f_value"))
    z = XS.zscore(XS.zscore(f, "f_size", ddof=0, out="a"), "f_value", ddof=0, out="b")
    return rounded(op(z, {"a": -1.0, "b": 1.0}).select(*KEYS, "score"), "score")


@query("value_cluster", """
    WITH z AS (SELECT trade_date, symbol, CASE WHEN symbol % 3 <> 0 THEN (f_size - avg(f_size) OVER d) / nullif(stddev_samp(f_size) OVER d, 0) END AS a,
                      (f_value - avg(f_value) OVER d) / nullif(stddev_samp(f_value) OVER d, 0) AS b FROM factors WINDOW d AS (PARTITION BY trade_date))
    SELECT trade_date, symbol, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS cluster FROM z""",
       "factors")
def value_cluster(spark, d):
    from ..operators.portfolio import mean_of_available
    f = staged(V.factors(spark, d).select(*KEYS, "f_size", "f_value"))
    z = XS.zscore(XS.zscore(f, "f_size", out="a"), "f_value", out="b")
    z = z.withColumn("a", F.when(F.col("symbol") % 3 != 0, F.col("a")))
    return rounded(z.select(*KEYS, mean_of_available(["a", "b"]).alias("cluster")), "cluster")
