"""Delivery of alerts as a change of state: claimed, then sent.

The rows a hook is about to get are claimed in the ``outbox`` table before it
runs, and their status is logged after it has run. A repeated batch finds what
it has logged or claimed, so the hook never gets a row twice. A row that was
claimed but not logged (the job died in between) may or may not have gone out;
it is logged as ``unconfirmed`` and left to the operator (``claim_again``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut
from newsloom.sources.tables import Deliver, Store

KEYS = ["news_id", "channel"]
UNCONFIRMED = "unconfirmed"


def deliver_once(store: Store, due: DataFrame, channel: str, hook: Deliver | None, batch_id: str) -> int:
    """Deliver and log those of ``due`` (alert-log rows of one channel) that this batch has not handled yet.

    Returns how many rows the hook got. Without a hook the rows are logged as
    they are. What the hook returns is written before it is logged, so the hook
    does not run again for the log. All reads and writes are of this batch's
    rows of one channel.
    """
    mine = (F.col("channel") == channel)
    logged = cut(store.read("alert_log", batch_id).drop("batch_id"))
    fresh = due.join(logged.select(*KEYS), KEYS, "left_anti")
    handed = 0
    if hook is not None:
        claimed = cut(store.read("outbox", batch_id).filter(mine))
        lost = fresh.join(claimed.select(*KEYS), KEYS, "left_semi").withColumn("status", F.lit(UNCONFIRMED))
        lost = cut(lost)
        fresh = cut(fresh.join(claimed.select(*KEYS), KEYS, "left_anti"))
        handed = fresh.count()
        if handed:
            claims = claimed.select("news_id", "claimed_at").unionByName(
                fresh.select("news_id", F.col("sent_at").alias("claimed_at")))
            store.write("outbox", claims.select(
                "*", F.lit(batch_id).alias("batch_id"), F.lit(channel).alias("channel")))
            fresh = cut(hook(fresh))
        fresh = lost.unionByName(fresh)
    store.write("alert_log", logged.unionByName(fresh), batch_id)
    return handed


def claim_again(store: Store, channel: str, batch_id: str) -> None:
    """Forget the unconfirmed rows of a batch's channel, so that its next repeat delivers them."""
    log = cut(store.read("alert_log", batch_id).drop("batch_id"))
    open_ = (F.col("channel") == channel) & (F.col("status") == UNCONFIRMED)
    claimed = cut(store.read("outbox", batch_id))
    kept = claimed.filter(F.col("channel") == channel).join(log.filter(open_).select("news_id"), "news_id", "left_anti")
    rest = claimed.filter(F.col("channel") != channel).unionByName(kept)
    store.write("outbox", rest.drop("batch_id"), batch_id)
    store.write("alert_log", log.filter(~open_), batch_id)
