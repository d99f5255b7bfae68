"""Hour gaps over the whole table."""

import datetime

from plumbline.plans.catalogue import QUERIES
from plumbline.sources.state import small_table


def test_hour_gaps_read_every_event(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    hours = [0, 1, 3, 4, 7]
    rows = [(2 * i + 1, start + datetime.timedelta(hours=h, minutes=5), 1, "view", 1.0, None) for i, h in enumerate(hours)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    # Odd ids are not shifted; of them only one is a multiple of five.
    small_table(spark, rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(r.period for r in QUERIES["t11_hour_gaps"](spark, str(tmp_path)).collect())
    assert found == ["2024-01-01 02:00", "2024-01-01 05:00", "2024-01-01 06:00"]
