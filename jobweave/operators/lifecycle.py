"""Expiry, reconciliation, repair and re-extraction of stored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import find_deadline, once
from jobweave.operators.classify import evidenced, url_guard
from jobweave.operators.gates import is_roundup
from jobweave.operators.merge import raw_merge
from jobweave.operators.traffic import moment

_days = lambda n: F.expr(f"INTERVAL '{n}' DAY")


def expire_now(listings: DataFrame, as_of: str) -> DataFrame:
    """Listings with active ones past their deadline expired."""
    late = (F.col("status") == "active") & (F.col("deadline") < moment(as_of))
    return listings.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def reconcile(listings: DataFrame, as_of: str, grace: int = 1, stale: int = 21, purge: int = 90, text: str = "description") -> DataFrame:
    """Listings with effective (the deadline, else one found in the text) and action; the first rule that holds decides:
    delete a roundup, purge an expired row long past, expire, stale-expire one not seen lately, backfill a recovered deadline."""
    now = moment(as_of)
    with_date = listings.withColumn("effective", F.coalesce("deadline", find_deadline(F.col(text))))
    active = F.col("status") == "active"
    action = (
        F.when(is_roundup(F.col("title")), "delete")
        .when((F.col("status") == "expired") & (F.coalesce("effective", "scraped_at") < now - _days(purge)), "purge")
        .when(active & (F.col("effective") < now - _days(grace)), "expire")
        .when(active & (F.col("scraped_at") < now - _days(stale)), "stale")
        .when(F.col("effective").isNotNull() & F.col("deadline").isNull(), "backfill")
    )
    return with_date.withColumn("action", action)


def apply_reconcile(decided: DataFrame, preserve_hidden: bool = False) -> DataFrame:
    """The listings after their actions.  A backfilled row becomes active whatever it was, unless hidden rows are preserved."""
    stays = decided.where(F.col("action").isNull() | ~F.col("action").isin("delete", "purge"))
    fill = F.col("action") == "backfill"
    revived = fill & (F.col("status") != "hidden") if preserve_hidden else fill
    status = F.when(F.col("action").isin("expire", "stale"), "expired").when(revived, "active").otherwise(F.col("status"))
    return stays.withColumn("deadline", F.when(fill, F.col("effective")).otherwise(F.col("deadline"))).withColumn("status", status).drop("effective", "action")


def prune_counters(decided: DataFrame) -> DataFrame:
    named = {"deleted": "delete", "purged": "purge", "expired": "expire", "stale": "stale", "backfilled": "backfill"}
    return decided.agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("action") == a).alias(n) for n, a in named.items()])


def repair_columns(listings: DataFrame, structured: DataFrame, as_of: str, html: str = "description_html", text: str = "description") -> DataFrame:
    """Listings overwritten from structured payloads (id, location, is_paid, stipend_text, apply_url, deadline, realistic, org_name).

    Pay and figure are what the payload says, nothing included; place and deadline where it has one.  An empty apply
    address is filled if the payload's stands in the listing's page or text.  The status is expired past the deadline,
    hidden if the role is not realistic, else active.  A name replaces one that is unknown or shorter than three characters.
    """
    s = structured.select(F.col("id"), *[F.col(c).alias(f"_s_{c}") for c in structured.columns if c != "id"], F.lit(True).alias("_s"))
    j = listings.join(s, "id", "left")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    deadline = F.coalesce("_s_deadline", "deadline")
    status = F.when(deadline < moment(as_of), "expired").when(F.col("_s_realistic") == False, "hidden").otherwise("active")  # noqa: E712
    name = F.trim("_s_org_name")
    weak = (F.col("org_name") == "Unknown") | (F.length(F.trim("org_name")) < 3)
    said = lambda c: F.when(F.col("_s"), F.col(f"_s_{c}")).otherwise(F.col(c))
    new = {
        "location": F.coalesce(some("_s_location"), "location"), "is_paid": said("is_paid"), "stipend_text": said("stipend_text"),
        "apply_url": F.coalesce(some("apply_url"), url_guard(F.col("_s_apply_url"), F.col(html), F.col(text)), "apply_url"), "deadline": deadline,
        "status": F.when(F.col("_s"), status).otherwise(F.col("status")), "org_name": F.when(weak & (name != ""), name).otherwise(F.col("org_name")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in listings.columns])


#: Columns that a new extraction fills or corrects, but never clears.
NEVER_CLEARED = ("deadline", "description_html", "description_text")


def reextract_diff(old: DataFrame, new: DataFrame, columns: tuple[str, ...], as_of: str, source_prefix: str = "generic:") -> DataFrame:
    """id, changed (columns whose extracted value differs), their new values and status, for rows of a source prefix that change.

    A null or empty value is no change for the columns in NEVER_CLEARED; any other column takes it.  With a new deadline
    the status becomes expired or active.  Where both sides have ``raw``, the new one's object is merged into raw.scraped.
    """
    n = new.select("id", *[F.col(c).alias(f"_n_{c}") for c in (*columns, *(["raw"] if "raw" in new.columns else []))])
    j = old.where(F.col("source").startswith(source_prefix)).join(n, "id")
    held = lambda c: F.when(F.col(f"_n_{c}").cast("string") != "", F.col(f"_n_{c}"))
    value = {c: F.coalesce(held(c), c) if c in NEVER_CLEARED else F.col(f"_n_{c}") for c in columns}
    changed = F.array_compact(F.array(*[F.when(~value[c].eqNullSafe(F.col(c)), F.lit(c)) for c in columns]))
    status = F.col("status")
    if "deadline" in columns:
        moved = ~value["deadline"].eqNullSafe(F.col("deadline"))
        status = F.when(moved & (value["deadline"] < moment(as_of)), "expired").when(moved, "active").otherwise(status)
    raw = [merge_scraped(F.col("raw"), F.col("_n_raw")).alias("raw")] if "raw" in new.columns and "raw" in old.columns else []
    return j.withColumn("changed", changed).where(F.size("changed") > 0).select("id", "changed", *[value[c].alias(c) for c in columns], status.alias("status"), *raw)


def merge_scraped(raw: Column, scraped: Column) -> Column:
    """A stored payload with its scraped object's keys replaced by those of a new one; everything else in it stays."""
    inner = raw_merge(F.get_json_object(raw, "$.scraped"), scraped)
    return raw_merge(raw, F.concat(F.lit('{"scraped":'), inner, F.lit("}")))


def fix_apply_urls(listings: DataFrame, found: DataFrame, html: str = "description_html", text: str = "description") -> DataFrame:
    """Listings with apply_url replaced by the one found on the page (id, url), where there is one; a stored address that
    nobody found is cleared unless it stands in the posting."""
    j = listings.join(found.where(F.col("url").isNotNull()).select("id", F.col("url").alias("_url")), "id", "left")
    stands = evidenced(F.col("apply_url"), F.col(html), F.col(text))
    return j.withColumn("apply_url", F.coalesce("_url", F.when(stands, F.col("apply_url")))).drop("_url")


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))


def _strings(v: Column) -> Column:
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, _string), lambda s: s.isNotNull())


def reader_sections(sections: Column) -> Column:
    """Sections (title, paragraphs, bullets) of a parsed JSON array: what is no string is left out, and so are sections
    without any of the three; null if none is left."""
    part = lambda s, name: F.try_variant_get(s, f"$.{name}", "variant")
    shaped = F.transform(
        F.try_variant_get(sections, "$", "array<variant>"),
        lambda s: F.struct(
            F.coalesce(_string(part(s, "title")), F.lit("")).alias("title"), _strings(part(s, "paragraphs")).alias("paragraphs"), _strings(part(s, "bullets")).alias("bullets")
        ),
    )
    some = F.filter(shaped, lambda s: (s["title"] != "") | (F.size(s["paragraphs"]) > 0) | (F.size(s["bullets"]) > 0))
    return once(some, lambda x: F.when(F.size(x) > 0, x))


def reader(raw: Column) -> Column:
    """sections, how_to_apply and apply_email (strings or null) of a structured payload; null if no section is left."""

    def told(parsed: Column) -> Column:
        data = lambda name: F.try_variant_get(parsed, f"$.structured.data.{name}", "variant")
        return F.struct(reader_sections(data("sections")).alias("sections"), _string(data("how_to_apply")).alias("how_to_apply"), _string(data("application_email")).alias("apply_email"))

    return once(once(F.try_parse_json(raw), told), lambda r: F.when(r["sections"].isNotNull(), r))
