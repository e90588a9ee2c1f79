"""Hand-typed spans."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions import labels
from rankweave.plans import registry


@pytest.mark.parametrize(
    "label, want",
    [("0", "StripeLocal"), ("1", "CrossStripe"), ("CrosStripe", "CrossStripe"), ("Cross-Strip", "CrossStripe"), ("StripLocal", "StripeLocal"), ("Stripe Locale", "StripeLocal"), (" cross_stripe\t", "CrossStripe"), ("-1", None), ("2", None), ("n/a", None), ("", None), (None, None)],
)
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "span string")
    assert df.select(labels.category(F.col("span"), labels.CATEGORIES["span"])).first()[0] == want


def test_numbers_and_misspellings_keep_their_records(spark, small):
    plain, named = (f(spark, small).select("query_id") for f in (registry._spans, registry._named_spans))
    assert plain.join(named, "query_id", "left_anti").isEmpty()
    assert named.count() > plain.count()
