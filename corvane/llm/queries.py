"""Queries of the training-data operators, with SQL where SQL can state them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.cooccurrence import cooccurrence
from corvane.llm.leaks import leaked_items, leaked_passages
from corvane.llm.mixture import BLOCK_TOKENS, Mixture, mix_sources
from corvane.llm.percentiles import combine, radix_percentiles, sketch, sketch_percentiles
from corvane.llm.topn import top_n
from corvane.llm.truncation import truncated_texts, truncation_rates
from corvane.operators.skew import hot_keys, salted_join
from corvane.tables import table

PERCENTILES = (0.5, 0.9, 0.99)
#: The vocabulary file of the public tokenizer in which sizes are counted.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "sales_orders")
    return cooccurrence(orders, "uid", "pid", min_count=8, min_share=Fraction(1, 2000))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of products that stand in at least six times as many baskets as chance gives."""
    strong = _pairs(spark, sf_dir).filter("n_ab * n_baskets >= 6 * n_a * n_b")
    return strong.select(F.col("item_a").alias("pid_a"), F.col("item_b").alias("pid_b"))


def p1_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with enough baskets, and their lift."""
    return _pairs(spark, sf_dir).select(
        F.col("item_a").alias("pid_a"), F.col("item_b").alias("pid_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's five orders with the highest total."""
    orders = table(spark, sf_dir, "sales_orders")
    return top_n(orders, ["uid"], "total", 5, ties=[("placed_at", True), ("oid", True)]).select("uid", "oid")


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals (each order once) and ages (each user once) by the user's state: ``(metric, state, month, value)``.

    A user's state and age are those of the account opened last.
    """
    users = table(spark, sf_dir, "users").filter(F.col("uid").isNotNull())
    last = users.groupBy("uid").agg(F.max(F.struct("created_at", "state", "age")).alias("a"))
    accounts = last.select("uid", F.col("a.state").alias("state"), F.col("a.age").alias("age"), F.col("a.created_at").alias("at"))
    orders = table(spark, sf_dir, "sales_orders").filter(F.col("total").isNotNull())
    hot = hot_keys(orders, "uid")  # rows as delivered are no fewer than the orders, and need not be made distinct twice
    once = orders.select("oid", "uid", "total", "placed_at").distinct()
    totals = salted_join(once, accounts.select("uid", "state"), "uid", F.col("oid"), hot=hot)
    month = lambda c: F.date_format(c, "yyyy-MM")
    return totals.select(
        F.lit("order_total").alias("metric"), "state", month("placed_at").alias("month"), F.col("total").alias("value")
    ).unionByName(accounts.select(F.lit("user_age").alias("metric"), "state", month("at").alias("month"), F.col("age").alias("value")))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median, 90th and 99th percentile per state (error bound zero), from histograms kept by month."""
    found = radix_percentiles(_measures(spark, sf_dir), "value", ["metric", "state"], PERCENTILES, period=F.col("month"))
    return found.withColumn("error_bound", F.lit(0))


def p4_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the same percentiles, within 1/128 of each other, from the combined sketches of single months."""
    by_month = sketch(_measures(spark, sf_dir), "value", ["metric", "state"], period=F.col("month"))
    return sketch_percentiles(combine(by_month), ["metric", "state"], PERCENTILES)


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bounds from the months hold the exact percentiles and are as narrow as promised."""
    groups, names = ["metric", "state"], ("p50", "p90", "p99")
    bounds = p4_monthly(spark, sf_dir)
    exact = p4_percentiles(spark, sf_dir).select(*(F.col(g).alias(f"exact_{g}") for g in groups), F.col("n").alias("exact_n"), *names)
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"exact_{g}"))

    def holds(p: str):
        low, high = F.col(f"{p}_low"), F.col(f"{p}_high")
        return ((low <= F.col(p)) & (F.col(p) <= high) & (high - low <= F.abs(low) / 128 + 1e-300)).cast("int").alias(f"{p}_inside")

    return bounds.join(exact, same).select(*groups, (F.col("n") == F.col("exact_n")).cast("int").alias("same_n"), *map(holds, names))


def _leaks(spark: SparkSession, sf_dir: str, slack: int = 0) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), slack=slack)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least a quarter of an evaluation passage's runs of five words."""
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a quarter of the runs, if up to three words may be put into each, with both counts."""
    return _leaks(spark, sf_dir, slack=3).select("item_id", "doc_id", "n_exact", "n_near", "match_kind")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items."""
    return leaked_items(_leaks(spark, sf_dir)).select("item_id", "n_docs", F.round("max_share", 6).alias("max_share"))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer=TOKENIZER)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: blocks of tokens in their slots."""
    return _mixture(spark, sf_dir).blocks


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every source contributes."""
    return _mixture(spark, sf_dir).report


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mixture keeps every source's repetitions, and comes within a block of its planned tokens."""
    made = _mixture(spark, sf_dir)
    times = made.blocks.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("tokens"))
    used = times.groupBy("source").agg(F.max("times").alias("times"), F.sum("tokens").alias("tokens"))
    rows = made.report.join(used, "source", "left").na.fill(0, ["times", "tokens"])
    return rows.select(
        "source", "target_share", "max_repeats",
        (F.col("times") <= F.col("max_repeats")).cast("int").alias("repeats_kept"),
        (F.abs(F.col("tokens") - F.col("planned_tokens")) <= BLOCK_TOKENS).cast("int").alias("plan_kept"),
        (F.col("tokens") == F.col("used_tokens")).cast("int").alias("report_true"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut off."""
    return truncated_texts(table(spark, sf_dir, "documents")).filter("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_rates(truncated_texts(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_lift, p2_found, p4_percentiles, p4_monthly, p4_bounds,
        p6_found, p6_near, p6_items, p7_mixture, p7_shares, p7_limits, p8_found, p8_rates,
    )
}

_PAIRS = """with p as (select distinct uid, pid from sales_orders where uid is not null and pid is not null),
    s as (select pid, count(*) as c from p group by pid), t as (select count(distinct uid) as n from p),
    ab as (select a.pid as pid_a, b.pid as pid_b, count(*) as n_ab from p a join p b on a.uid = b.uid and a.pid < b.pid group by 1, 2),
    pairs as (select pid_a, pid_b, sa.c as n_a, sb.c as n_b, n_ab, n from ab
        join s sa on sa.pid = pid_a join s sb on sb.pid = pid_b, t where n_ab >= 8 and n_ab * 2000 >= n)"""

_RUNS = """with d as (select doc_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9]+')] as w from documents),
    e as (select item_id, [lower(x) for x in regexp_extract_all(passage, '[A-Za-z0-9]+')] as w from eval_items),
    dr as (select distinct doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as r from d where len(w) > 4),
    er as (select distinct item_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as r from e where len(w) > 4),
    n as (select item_id, count(*) as n from er group by 1),
    hit as (select item_id, doc_id, count(*) as k from er join dr using (r) group by 1, 2),
    leak as (select item_id, doc_id, k / n as share from hit join n using (item_id) where 4 * k >= n)"""

# Each run's words in their order, the last at most three words later than without gaps.
_NEAR = f"""{_RUNS},
    w as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
    runs as (select distinct r, string_split(r, ' ') as x from er),
    g1 as (select r, x, doc_id, i as a, i from runs join w on word = x[1]),
    g2 as (select distinct r, x, g.doc_id, a, w.i from g1 g join w on w.doc_id = g.doc_id and word = x[2] and w.i > g.i and w.i <= a + 4),
    g3 as (select distinct r, x, g.doc_id, a, w.i from g2 g join w on w.doc_id = g.doc_id and word = x[3] and w.i > g.i and w.i <= a + 5),
    g4 as (select distinct r, x, g.doc_id, a, w.i from g3 g join w on w.doc_id = g.doc_id and word = x[4] and w.i > g.i and w.i <= a + 6),
    g5 as (select distinct r, g.doc_id from g4 g join w on w.doc_id = g.doc_id and word = x[5] and w.i > g.i and w.i <= a + 7),
    whole as (select item_id, doc_id, count(*) as m from er join g5 using (r) group by 1, 2)"""

_MEASURES = """with a as (select uid, state, age from users where uid is not null qualify row_number() over (
            partition by uid order by created_at desc nulls last, state desc nulls last, age desc nulls last) = 1),
        o as (select distinct oid, uid, total, placed_at from sales_orders where total is not null),
        m as (select 'order_total' as metric, state, total as value from o left join a using (uid)
            union all select 'user_age', state, age from a where age is not null)"""

SQL = {
    "p6_near": f"""{_NEAR} select item_id, doc_id, coalesce(k, 0) as n_exact, m - coalesce(k, 0) as n_near,
        case when 4 * coalesce(k, 0) >= n then 'exact' else 'near' end as match_kind
        from whole left join hit using (item_id, doc_id) join n using (item_id) where 4 * m >= n""",
    "p1_found": f"{_PAIRS} select pid_a, pid_b from pairs where n_ab * n >= 6 * n_a * n_b",
    "p1_lift": f"""{_PAIRS} select pid_a, pid_b, n_a, n_b, n_ab,
        round(n_ab * cast(n as double) / (n_a * cast(n_b as double)), 6) as lift from pairs""",
    "p2_found": """select uid, oid from (select distinct uid, oid, total, placed_at from sales_orders
        where uid is not null and total is not null)
        qualify row_number() over (partition by uid order by total desc, placed_at, oid) <= 5""",
    "p4_percentiles": f"""{_MEASURES}
        select metric, state, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90,
            quantile_disc(value, 0.99) as p99, 0 as error_bound from m group by 1, 2""",
    "p4_bounds": f"""{_MEASURES}
        select distinct metric, state, 1 as same_n, 1 as p50_inside, 1 as p90_inside, 1 as p99_inside from m""",
    "p6_found": f"{_RUNS} select item_id, doc_id from leak",
    "p7_limits": """select source, coalesce(target_share, 0) as target_share, coalesce(max_repeats, 0) as max_repeats,
        1 as repeats_kept, 1 as plan_kept, 1 as report_true
        from (select distinct source from documents where source is not null) full join mix_targets using (source)""",
    "p6_items": f"""{_RUNS} select item_id, count(*) as n_docs, round(max(share), 6) as max_share from leak group by 1""",
}
