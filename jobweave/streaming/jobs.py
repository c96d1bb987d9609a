"""Always-on jobs as bounded micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from jobweave.operators.board import apply_link, channel_queue, due_reminders, html_escape, urgency
from jobweave.operators.snapshots import SnapshotStore


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Event rows appended to a Parquet table partitioned by day; late rows land too, so recounting from the table is exact."""
    return events.withColumn("day", F.to_date("ts")).writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path, format="parquet")


def ingest_files(spark: SparkSession, path: str, schema: StructType, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Newly landed payload files, each handed on once: handle() gets every batch."""
    files = spark.readStream.schema(schema).option("multiLine", True).json(path)
    return files.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(
    spark: SparkSession, path: str, schema: StructType, store: SnapshotStore, change: Callable[[DataFrame], Callable[[DataFrame | None], DataFrame]], checkpoint: str, name: str = "files",
) -> StreamingQuery:
    """Newly landed payload files merged into a table of snapshots: change(batch) makes the next rows of the latest ones.
    A batch that is played again after a loss is known to the table's ledger and changes nothing."""
    files = spark.readStream.schema(schema).option("multiLine", True).json(path)
    merged = lambda batch, number: store.update(change(batch), name, number) and None
    return files.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_channel(listings: DataFrame, outbox: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    """Rows for the outbox (id, send, posted_at) of the next listings, without those that it holds: running it twice sends nothing twice."""
    waiting = listings.join(outbox.select("id"), "id", "left_anti")
    return channel_queue(waiting, as_of, n).select("id", "send", F.lit(as_of).cast("timestamp").alias("posted_at"))


def _link(listing_id: Column, site: str, ref: str, inner: Column) -> Column:
    return F.concat(F.lit(f'<a href="{site}/?listing='), listing_id.cast("string"), F.lit(f'&amp;ref={ref}">'), inner, F.lit("</a>"))


def _cut(name: str, n: int) -> Column:
    return html_escape(F.substring(name, 1, n))


def remind(saves: DataFrame, listings: DataFrame, as_of: str, sent: DataFrame, site: str = "https://board.example.org") -> DataFrame:
    """Reminders due now that the sent log doesn't hold, with their text (words are fixed values)."""
    due = due_reminders(saves, listings, as_of, sent)
    named = due.join(listings.select("id", "title", "org_name", apply_link(F.col("raw"), F.col("apply_url")).alias("apply")), "id")
    apply = F.concat(F.lit('<a href="'), html_escape(F.col("apply")), F.lit('">Apply now</a>'))
    links = F.concat_ws(" · ", _link(F.col("id"), site, "tg-reminder", F.lit("Read")), apply)
    head = F.concat(F.lit("⏰ <b>Closes in ~"), "band", F.lit("</b>\n<b>"), _cut("org_name", 120), F.lit("</b> — "), _cut("title", 120), F.lit("\n"))
    return named.select("chat_id", "id", "band", F.concat_ws("\n", head, links).alias("message"))


def saved_lines(saved: DataFrame, listings: DataFrame, as_of: str, site: str = "https://board.example.org") -> DataFrame:
    """Lines of a subscriber's list, as saved_open() numbers it: the title as a link, then organisation, place and urgency."""
    rows = saved.select("chat_id", "page", "n", "id").join(listings.select("id", "title", "org_name", "location", "is_remote", "deadline"), "id")
    town = F.trim(F.substring_index("location", ",", 1))
    place = F.when(F.col("is_remote"), "Remote").otherwise(F.coalesce(town, F.lit("—")))
    title = F.concat(F.lit("<b>"), _cut("title", 80), F.lit("</b>"))
    about = F.concat_ws(" · ", _cut("org_name", 60), html_escape(place), urgency(F.col("deadline"), as_of))
    return rows.select("chat_id", "page", "n", F.concat(F.col("n").cast("string"), F.lit(". "), _link(F.col("id"), site, "tg-saved", title), F.lit("\n    "), about).alias("line"))


def save_confirmations(requests: DataFrame, listings: DataFrame, as_of: str) -> DataFrame:
    """Messages that tell a subscriber (chat_id, id) that a listing is saved (words are fixed values)."""
    told = F.when(
        F.col("deadline").isNotNull(), F.concat(urgency(F.col("deadline"), as_of), F.lit(" · I'll remind you 24h &amp; 72h before it closes."))
    ).otherwise("Rolling deadline — no reminders needed, apply when ready.")
    head = F.concat(F.lit("✅ Saved — <b>"), _cut("title", 120), F.lit("</b>"))
    return requests.select("chat_id", "id").join(listings.select("id", "title", "deadline"), "id").select("chat_id", "id", F.concat_ws("\n", head, told).alias("message"))
