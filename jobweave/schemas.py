"""Schemas of the tables that operators read and write; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _B, _I, _L, _TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType()

#: What every source yields.
SCRAPED_LISTING = _struct(
    source=_S, source_url=_S, source_id=_S, apply_url=_S, org_name=_S, org_slug=_S, title=_S, location=_S, is_remote=_B, is_paid=_B,
    stipend_text=_S, deadline=_TS, posted_at=_TS, description_html=_S, description_text=_S, raw=_S,
)
LISTING = T.StructType([
    T.StructField("id", _S), *SCRAPED_LISTING.fields, T.StructField("scraped_at", _TS), T.StructField("field_tags", T.ArrayType(_S)),
    T.StructField("fit_score", _I), T.StructField("status", _S), T.StructField("posted_to_channel", _B),
])
ORG = _struct(
    slug=_S, name=_S, category=_S, region=_S, hq_location=_S, addis_office=_B, website=_S, careers_url=_S, internship_url=_S,
    contact_email=_S, linkedin=_S, twitter=_S, facebook=_S, posts_publicly=_S, scrape_priority=_S, scrape_url=_S, notes=_S,
)
PAGE_EVENT = _struct(id=_S, ts=_TS, type=_S, path=_S, listing_id=_S, ref=_S, country=_S, device=_S, visitor_hash=_S)
SUBSCRIBER = T.StructType([
    T.StructField("chat_id", _L), T.StructField("username", _S), T.StructField("joined_at", _TS), T.StructField("active", _B),
    T.StructField("filters", _S), T.StructField("saved_listing_ids", T.ArrayType(_S)),
    T.StructField("notify_24h", _B), T.StructField("notify_72h", _B),
])
ORG_STATS = _struct(slug=_S, adapter=_S, scraped=_L, kept=_L, new=_L, updated=_L, errors=_L, duration_ms=_L, error=_S)
SCRAPE_RUN = T.StructType([
    T.StructField("id", _S), T.StructField("source", _S), T.StructField("started_at", _TS), T.StructField("finished_at", _TS),
    T.StructField("new_count", _L), T.StructField("updated_count", _L), T.StructField("error_count", _L),
    T.StructField("orgs", T.ArrayType(ORG_STATS)),
])
CLASSIFICATION = T.StructType([
    T.StructField("fits", _B), T.StructField("fields", T.ArrayType(_S)), T.StructField("fit_score", _I), T.StructField("reason", _S),
])
SECTION = T.StructType([T.StructField("title", _S), T.StructField("paragraphs", T.ArrayType(_S)), T.StructField("bullets", T.ArrayType(_S))])
