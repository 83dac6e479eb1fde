"""The decision as one CASE over gate columns, and running session costs as one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.config import EngineConfig

DECISIONS = ("ANSWER", "REFUSE_STALE", "REFUSE_UNGROUNDED", "REFUSE_NO_EVIDENCE", "REFUSE_DISAGREE", "REFUSE_BUDGET", "REFUSE_CANARY", "REFUSE_PII", "PROPOSE_WRITE", "REFUSE_AMBIGUOUS_WRITE")


def decide(cfg: EngineConfig = EngineConfig()) -> Column:
    """The first gate that closes decides; needs the columns named here, nulls meaning that a gate has nothing to say.

    ``over_budget``, ``write_action``, ``write_ambiguous``, ``n_retrieved``, ``n_supporting``, ``best_support``,
    ``n_fresh``, ``disagreed``, ``grounded``, ``canary_leaked``, ``pii_action``.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        F.when(yes("over_budget"), "REFUSE_BUDGET")
        .when(F.col("write_action").isNotNull(), "PROPOSE_WRITE")
        .when(yes("write_ambiguous"), "REFUSE_AMBIGUOUS_WRITE")
        .when(n("n_retrieved") == 0, "REFUSE_NO_EVIDENCE")
        .when((n("n_supporting") == 0) & (F.coalesce("best_support", F.lit(0.0)) < cfg.support_floor), "REFUSE_NO_EVIDENCE")
        .when(n("n_supporting") == 0, "REFUSE_UNGROUNDED")
        .when(n("n_fresh") == 0, "REFUSE_STALE")
        .when(yes("disagreed"), "REFUSE_DISAGREE")
        .when(~yes("grounded"), "REFUSE_UNGROUNDED")
        .when(yes("canary_leaked"), "REFUSE_CANARY")
        .when(F.col("pii_action") == "refuse", "REFUSE_PII")
        .otherwise("ANSWER")
    )


def request_cost(n_retrieved: Column, dense: bool = True, disagreement: bool = True) -> Column:
    """Units of one request: 1, 0.15 a chunk, 0.40 for dense scores, 0.25 for the second ranker."""
    return F.lit(1.0) + 0.15 * n_retrieved + (0.40 if dense else 0.0) + (0.25 if disagreement else 0.0)


def budget(requests: DataFrame, session: str, order: tuple[str, ...], cost: str, limit: float, opening: str | None = None, stretch: Column | None = None) -> DataFrame:
    """Adds ``spent_before``, ``projected`` and ``over_budget``; each request is charged, refused or not.

    Requests without a session are never over budget. The running sum is exact in
    thousandths. ``stretch`` cuts a session's sequence into consecutive parts (a day of its
    order, for instance): sums run within a part, and what earlier parts spent is added from
    one total each, so that a session that holds a third of all requests is no one task's work.
    Its value must never fall along ``order``.
    """
    milli = F.round(F.col(cost) * 1000).cast("bigint")
    start = F.round(F.coalesce(F.col(opening), F.lit(0.0)) * 1000).cast("bigint") if opening else F.lit(0).cast("bigint")
    x = requests.withColumn("__m", milli).withColumn("__s", F.lit(0) if stretch is None else stretch)
    # rows without a session are no sequence: they need no window and make no hot partition
    own, rest = x.where(F.col(session).isNotNull()), x.where(F.col(session).isNull())
    before = F.sum("__t").over(Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    earlier = own.groupBy(F.col(session).alias("__k"), F.col("__s").alias("__p")).agg(F.sum("__m").alias("__t")).select("__k", "__p", F.coalesce(before, F.lit(0)).alias("__before"))
    own = own.join(earlier, (F.col(session) == F.col("__k")) & F.col("__s").eqNullSafe(F.col("__p"))) if stretch is not None else own.withColumn("__before", F.lit(0))
    w = Window.partitionBy(session, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("projected", (F.sum("__m").over(w) + F.col("__before") + start) / 1000.0)
    both = own.drop("__k", "__p", "__before").unionByName(rest.withColumn("projected", F.col("__m") / 1000.0))
    both = both.withColumn("spent_before", F.round(F.col("projected") - F.col("__m") / 1000.0, 3))
    return both.withColumn("over_budget", F.col(session).isNotNull() & (F.col("projected") > limit)).drop("__m", "__s")
