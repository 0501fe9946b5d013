"""Small frames with hand-checkable numbers."""

import datetime as dt
import random

DAY = dt.date(2025, 1, 1)


def task_frame(spark):
    """Five rows; ctr = .01 .025 .01 .03 .01, roas = 5 6 2 6 4."""
    rows = []
    clicks, shown = [10, 50, 15, 90, 25], [1000, 2000, 1500, 3000, 2500]
    spend, revenue = [100, 200, 150, 300, 250], [500, 1200, 300, 1800, 1000]
    for i in range(5):
        rows.append(
            (
                DAY + dt.timedelta(days=i), f"c{i}", f"a{i}", float(spend[i]), shown[i], clicks[i], i, float(revenue[i]),
                clicks[i] / shown[i], revenue[i] / spend[i], ["Image", "Video"][i % 2], f"m{i}",
            )
        )
    return spark.createDataFrame(
        rows,
        "date date, campaign_name string, adset_name string, spend double, impressions long, clicks long, "
        "purchases long, revenue double, ctr double, roas double, creative_type string, creative_message string",
    )


def drift_rows(roas=1.0, ctr=1.0, cvr=1.0, n=100):
    rng = random.Random(42)
    rows = []
    for i in range(n):
        rows.append(
            (
                DAY + dt.timedelta(days=i), f"Campaign {i % 10}", rng.gauss(2.5, 0.5) * roas, rng.gauss(0.02, 0.005) * ctr,
                rng.gauss(0.04, 0.01) * cvr, rng.gauss(150, 30),
            )
        )
    return rows


DRIFT_SCHEMA = "date date, campaign_name string, roas double, ctr double, cvr double, spend double"


def drift_frame(spark, **factors):
    return spark.createDataFrame(drift_rows(**factors), DRIFT_SCHEMA)


def insight(spark, *rows):
    """Insight rows from dicts; absent fields are NULL."""
    names = ("id", "category", "hypothesis", "evidence", "confidence", "reasoning", "recommendation")
    schema = "id string, category string, hypothesis string, evidence array<string>, confidence double, reasoning string, recommendation string"
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
