"""Intent of messages."""

import pytest
from pyspark.sql import functions as F

from sluiceway.operators.intent import intent, read_intent


@pytest.mark.parametrize(("text", "want"), [
    ("Please restart checkout-api", ("imperative", "restart_service", "checkout-api", "propose")),
    ("can you roll back ledger-store now?", ("request", "rollback_deploy", "ledger-store", "propose")),
    ("hey team, page the on-call", ("imperative", "page_oncall", "on-call", "propose")),
    ("increase checkout-api replicas to 20", ("imperative", "scale_service", "checkout-api", "propose")),
    ("bump checkout-api timeout", ("imperative", "patch_config", "checkout-api", "propose")),
    ("restart it", ("imperative", "restart_service", None, "ambiguous")),
    ("delete checkout-api", ("imperative", None, None, "ambiguous")),
    ("restart checkout-api if errors climb again", ("imperative", "restart_service", "checkout-api", "ambiguous")),
    ("if it fails, restart checkout-api", ("imperative", "restart_service", "checkout-api", "ambiguous")),
    ("don't restart checkout-api", ("negated", None, None, "none")),
    ("How do we restart checkout-api?", ("informational", None, None, "none")),
    ("show me the checkout-api replicas", ("informational", None, None, "none")),
    ("restart policy for checkout-api", ("declarative", None, None, "none")),
    ("we restart it nightly", ("declarative", None, None, "none")),
    ("clear checkout-api", ("imperative", None, None, "none")),
    ("clear the checkout-api cache", ("imperative", "clear_cache", "checkout-api", "propose")),
    ("", ("empty", None, None, "none")),
    (None, ("empty", None, None, "none")),
])
def test_messages(text, want):
    r = read_intent(text)
    assert (r["mood"], r["action"], r["target"], r["status"]) == want


def test_column(spark):
    df = spark.createDataFrame([(1, "Please restart checkout-api"), (2, None), (3, "x " * 50_000)], "i int, t string")
    assert [r.s for r in df.select("i", intent(F.col("t"))["status"].alias("s")).orderBy("i").collect()] == ["propose", "none", "none"]
    assert df.limit(0).select(intent(F.col("t")).alias("x")).count() == 0


def test_column_as_message(spark):
    """The column expression and the reader of single messages agree, on the questions of the test tables and on made-up ones."""
    import random

    rng = random.Random(2)
    bits = ["please", "can you", "don't", "restart", "scale up", "clear", "the cache", "delete", "increase", "replicas", "checkout-api", "on-call", "page", "if it fails again", ",", "?", "we", "is", "how do we", "policy", "but", "update", "let us", "do not", "ledger_store", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + ["", " ", None, "Ｐlease restart it"[1:]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", intent(F.col("t")).alias("s")).collect():
        assert r.s.asDict() == read_intent(r.t), r.t
