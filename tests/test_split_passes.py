"""Splits read stored items, not the tables that items come from."""

from loomtext.operators import labels
from loomtext.plans import q_labels


def test_splits_read_stored_items(spark, monkeypatch):
    seen, split = [], labels.split_items

    def noted(items, *args, **settings):
        seen.append(items._jdf.queryExecution().optimizedPlan().toString())
        return split(items, *args, **settings)

    monkeypatch.setattr(labels, "split_items", noted)
    q_labels.split_group_safe(spark, "/root/testdata/sf0.001")
    assert q_labels.split_restore(spark, "/root/testdata/sf0.001").first()["same"]
    assert len(seen) == 2 and not any("Join" in p or "sha2" in p for p in seen)
