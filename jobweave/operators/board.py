"""The listing board: what is live, searches, display rows and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.config import CHANNEL_FIT
from jobweave.functions.text import once
from jobweave.operators.traffic import moment

DAY_MICROS = 86_400_000_000


def board_order() -> list[Column]:
    """Best fit first, then the soonest deadline with open ones last; the identifier makes it total."""
    return [F.col("fit_score").desc_nulls_last(), F.col("deadline").asc_nulls_last(), F.col("id").asc()]


def live(listings: DataFrame, as_of: str) -> DataFrame:
    """Active listings that close at ``as_of`` or later, or have no deadline."""
    return listings.where((F.col("status") == "active") & (F.col("deadline").isNull() | (F.col("deadline") >= moment(as_of))))


def live_board(listings: DataFrame, as_of: str, n: int = 50) -> DataFrame:
    return live(listings, as_of).orderBy(*board_order()).limit(n)


def board_with_focus(listings: DataFrame, as_of: str, focus_id: object, n: int = 50) -> DataFrame:
    """The board, with one more listing on top if it isn't hidden and not on the board: rank_group 0, else 1."""
    board = live_board(listings, as_of, n)
    focus = listings.where((F.col("id") == F.lit(focus_id)) & (F.col("status") != "hidden")).join(board.select("id"), "id", "left_anti")
    return focus.select(F.lit(0).alias("rank_group"), *listings.columns).unionByName(board.select(F.lit(1).alias("rank_group"), *listings.columns))


def search(board: DataFrame, source: str | None = None, tag: Column | None = None, hide_unpaid: bool = False, text: str | None = None) -> DataFrame:
    """Facets of the board: source without regard to case, a tag test, not unpaid, and a substring of title, organisation or place."""
    out = board
    if source is not None:
        out = out.where(F.lower("source") == source.lower())
    if tag is not None:
        out = out.where(tag)
    if hide_unpaid:
        out = out.where(F.col("is_paid").isNull() | F.col("is_paid"))
    if text:
        hay = F.lower(F.concat_ws("\n", "title", "org_name", "location"))
        out = out.where(F.contains(hay, F.lit(text.strip().lower())))
    return out


def listings_query(
    listings: DataFrame, as_of: str, paid: bool | None = None, remote: bool | None = None, status: str = "active", deadline_within: int | None = None, limit: int = 20, offset: int = 0,
    field: str | None = None,
) -> DataFrame:
    """The declared query contract: filters that are given hold; limit 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset 0 or more")
    out = listings if status == "all" else listings.where(F.col("status") == status)
    if field is not None:
        out = out.where(F.array_contains("field_tags", field))
    if paid is not None:
        out = out.where(F.col("is_paid") == paid)
    if remote is not None:
        out = out.where(F.col("is_remote") == remote)
    if deadline_within is not None:
        end = moment(as_of) + F.expr(f"INTERVAL '{deadline_within}' DAY")
        out = out.where((F.col("deadline") >= moment(as_of)) & (F.col("deadline") <= end))
    return out.orderBy(*board_order()).offset(offset).limit(limit)


def days_left(deadline: Column, as_of: str) -> Column:
    """Whole days up to a deadline, begun ones counted."""
    return F.ceil((F.unix_micros(deadline) - F.unix_micros(moment(as_of))) / DAY_MICROS).cast("int")


def days_label(deadline: Column, as_of: str) -> Column:
    left = days_left(deadline, as_of)
    return F.when(deadline.isNull(), "open").when(left < 0, "expired").otherwise(F.concat(left.cast("string"), F.lit("d")))


def long_date(c: Column) -> Column:
    """A day as 1 Jun 2025; September is Sept, as British English has it."""
    return F.replace(F.date_format(c, "d MMM yyyy"), F.lit(" Sep "), F.lit(" Sept "))


def urgency(deadline: Column, as_of: str) -> Column:
    """How soon a listing closes, in words (fixed values)."""
    left = days_left(deadline, as_of)
    days = F.concat(left.cast("string"), F.lit("d left"))
    return (
        F.when(deadline.isNull(), "rolling deadline").when(left < 0, "closed").when(left == 0, "🔴 closes today")
        .when(left <= 3, F.concat(F.lit("🔴 "), days)).when(left <= 14, F.concat(F.lit("⏳ "), days)).otherwise(F.concat(long_date(deadline), F.lit(" · "), days))
    )


def safe_url(url: Column) -> Column:
    """The address if it is one of the web, else null."""
    return F.when(url.rlike(r"(?i)^https?://"), url)


def listing_view(listings: DataFrame, as_of: str) -> DataFrame:
    """Rows as the board shows them (labels are fixed values)."""
    short = lambda c: F.date_format(c, "MMM d")
    from jobweave.operators.lifecycle import reader

    # A generator, so that no later expression parses the payload again.
    read = listings.select("*", F.inline(F.array(reader(F.col("raw")))).alias("_sections", "_how_to_apply", "_apply_email"))
    return read.select(
        "id", F.upper("source").alias("source_label"), F.col("org_name").alias("org"), "title", F.coalesce(short("deadline"), F.lit("Rolling")).alias("deadline_label"),
        F.coalesce("location", F.lit("—")).alias("location_label"),
        F.when(F.col("is_paid") == False, "Unpaid").otherwise(F.coalesce("stipend_text", F.lit("Pay unclear"))).alias("pay_label"),  # noqa: E712
        F.col("fit_score").alias("fit"), days_label(F.col("deadline"), as_of).alias("days_label"), F.col("field_tags").alias("tags"), "source_url", safe_url(F.col("apply_url")).alias("apply_url"),
        F.col("_apply_email").alias("apply_email"), short("scraped_at").alias("scraped_label"), F.col("_sections").alias("sections"), F.col("_how_to_apply").alias("how_to_apply"),
    )


def uri_component(c: Column) -> Column:
    """A text as part of an address: everything but letters, digits and -_.!~*'() in percent signs."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def apply_target(listings: DataFrame) -> DataFrame:
    """Where to apply: the form, else a mail with a subject, else the source page (labels are fixed values)."""
    web = safe_url(F.col("apply_url"))
    mail = F.concat(F.lit("mailto:"), F.col("apply_email"), F.lit("?subject="), uri_component(F.concat(F.lit("Application — "), "title")))
    return listings.select(
        "id", F.coalesce(web, mail, F.col("source_url")).alias("target"),
        F.when(web.isNotNull(), "Apply at source").when(mail.isNotNull(), "Apply by email").otherwise("Open source").alias("label"),
    )


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def first_sentences(text: Column, n: int = 2) -> Column:
    """The first sentences, up to 280 characters; of a text without any, 200 characters."""
    one = r"([^.!?]+[.!?]+)"
    pattern = r"^[.!?]*" + one + (one + "?") * (n - 1)

    def told(clean: Column) -> Column:
        parts = F.array(*[F.regexp_extract(clean, pattern, i) for i in range(1, n + 1)])
        return F.when(clean.rlike(pattern), F.substring(F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " ")), 1, 280)).otherwise(F.substring(clean, 1, 200))

    return once(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), told)


def structured_text(raw: Column, name: str) -> Column:
    """A text of the structured payload, trimmed; null if blank."""
    value = F.trim(F.get_json_object(raw, f"$.structured.data.{name}"))
    return F.when(value != "", value)


def apply_link(listings_raw: Column, apply_url: Column) -> Column:
    """The stored application address, else that of the structured payload, if it is one of the web and not too long."""
    url = F.coalesce(F.when(F.trim(apply_url) != "", F.trim(apply_url)), structured_text(listings_raw, "application_url"))
    return safe_url(F.when(F.length(url) <= 512, url))


def _anchor(url: Column, text: str) -> Column:
    return F.concat(F.lit('<a href="'), html_escape(url), F.lit(f'">{text}</a>'))


def caption_fields(listings: DataFrame, as_of: str, site: str = "https://board.example.org") -> DataFrame:
    """Fields of a channel post, bounded and escaped, and the post itself: names, a summary (structured, else the first
    two sentences), the deadline and links (words are fixed values)."""
    left = days_left(F.col("deadline"), as_of)
    when = F.when(left < 0, "").when(left == 0, " (today)").otherwise(F.concat(F.lit(" ("), left.cast("string"), F.lit("d left)")))
    summary = F.substring(F.coalesce(structured_text(F.col("raw"), "summary"), first_sentences(F.col("description"))), 1, 300)
    told = F.struct(
        html_escape(F.substring("org_name", 1, 120)).alias("org"), html_escape(F.substring("title", 1, 200)).alias("title"), html_escape(once(summary, lambda s: F.when(s != "", s))).alias("summary"),
        html_escape(F.concat(F.lit("Deadline "), long_date(F.col("deadline")), when)).alias("deadline_text"), apply_link(F.col("raw"), F.col("apply_url")).alias("apply_link"),
    )
    # A generator, so that the post takes what is computed here and doesn't compute it again.
    fields = listings.select("id", "source_url", F.inline(F.array(told))).select("id", "org", "title", "summary", "deadline_text", "apply_link", "source_url")
    read = F.concat(F.lit(f'<a href="{site}/?listing='), F.col("id").cast("string"), F.lit('&amp;ref=tg">Read</a>'))
    links = F.concat_ws(" · ", read, _anchor(F.col("apply_link"), "Apply"), _anchor(F.col("source_url"), "Source"))
    head = F.concat(F.lit("<b>"), "org", F.lit("</b>\n"), "title", F.lit("\n"))
    return fields.withColumn("post", F.concat_ws("\n", head, F.concat("summary", F.lit("\n")), "deadline_text", links))


def channel_queue(listings: DataFrame, as_of: str, n: int = 10, least: int = CHANNEL_FIT) -> DataFrame:
    """The next listings for the channel; one past its deadline is marked posted without being sent."""
    waiting = listings.where(~F.col("posted_to_channel") & (F.col("status") == "active") & (F.col("fit_score") >= least))
    return waiting.orderBy(*board_order()).limit(n).withColumn("send", F.col("deadline").isNull() | (F.col("deadline") >= moment(as_of)))


def mark_posted(listings: DataFrame, posted_ids: DataFrame) -> DataFrame:
    """Listings with the flag set for the given ids; setting it twice changes nothing."""
    done = posted_ids.select("id").distinct().withColumn("_done", F.lit(True))
    return listings.join(done, "id", "left").withColumn("posted_to_channel", F.col("posted_to_channel") | F.coalesce("_done", F.lit(False))).drop("_done")


def repost_candidates(listings: DataFrame, as_of: str, least: int = CHANNEL_FIT, n: int = 10, source: str | None = None) -> DataFrame:
    """Open listings that the channel may show again: those whose payload doesn't say that it was reposted."""
    again = F.coalesce(F.get_json_object("raw", "$.repostedToChannel"), F.lit("false")) != "true"
    out = live(listings, as_of).where((F.col("fit_score") >= least) & again)
    return (out.where(F.col("source") == source) if source else out).orderBy(*board_order()).limit(n)


def ready_to_repost(repaired: DataFrame, as_of: str, unstructured: bool = False) -> DataFrame:
    """Candidates that still hold once their columns are repaired (structured: whether a payload was found): active, not past
    their deadline, and structured unless ``unstructured`` ones may go."""
    out = live(repaired, as_of)
    return out if unstructured else out.where("structured")


def saved_open(saves: DataFrame, listings: DataFrame, as_of: str, page: int = 15) -> DataFrame:
    """Each subscriber's saved listings that are open, numbered by deadline, in pages.

    ``saves``: chat_id and saved_listing_ids (array).
    """
    one = saves.select("chat_id", F.explode("saved_listing_ids").alias("id")).distinct()
    open_ = one.join(live(listings, as_of).select("id", "title", "deadline"), "id")
    number = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("deadline").asc_nulls_last(), "id"))
    return open_.withColumn("n", number).withColumn("page", F.floor((F.col("n") - 1) / page).cast("int"))


def saved_board(bookmarks: DataFrame, listings: DataFrame, user_id: object) -> DataFrame:
    """A user's bookmarked listings, newest bookmark first."""
    own = bookmarks.where(F.col("user_id") == F.lit(user_id)).groupBy("listing_id").agg(F.max("created_at").alias("bookmarked_at"))
    return own.join(listings, own["listing_id"] == listings["id"]).drop("listing_id").orderBy(F.col("bookmarked_at").desc(), "id")


#: Hours before the deadline at which reminders go out: later than the first, up to the second; the near band first.
BANDS = ((21, 24, "24h"), (69, 72, "72h"))


def due_reminders(saves: DataFrame, listings: DataFrame, as_of: str, sent: DataFrame | None = None) -> DataFrame:
    """chat_id, id and band of the reminders due now, without those in ``sent`` (the same columns).

    ``saves``: chat_id, saved_listing_ids, and notify_24h and notify_72h, which tell the bands that a subscriber wants; where
    these columns are absent or null, both.  Any listing with a deadline counts, whatever its status."""
    hours = (F.unix_micros("deadline") - F.unix_micros(moment(as_of))) / 3_600_000_000
    band = F.coalesce(*[F.when((hours > a) & (hours <= b), name) for a, b, name in BANDS])
    soon = listings.where((hours > BANDS[0][0]) & (hours <= BANDS[-1][1])).select("id", band.alias("band")).where("band IS NOT NULL")
    wants = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"notify_{b}"), F.lit(True)) if f"notify_{b}" in saves.columns else F.lit(True), b) for _, _, b in BANDS]))
    asked = saves.select("chat_id", wants.alias("_wants"), F.explode("saved_listing_ids").alias("id"))
    due = asked.join(soon, "id").where(F.array_contains("_wants", F.col("band"))).select("chat_id", "id", "band").distinct()
    return due if sent is None else due.join(sent, ["chat_id", "id", "band"], "left_anti")


def apply_saves(subscribers: DataFrame, requests: DataFrame, listings: DataFrame, most: int = 50) -> DataFrame:
    """Subscribers with the requested listings (chat_id, id, seq) appended in order: active ones not yet saved, up to ``most`` in all."""
    active = listings.where("status = 'active'").select("id")
    first = requests.groupBy("chat_id", "id").agg(F.min("seq").alias("seq")).join(active, "id", "left_semi")
    wanted = first.join(subscribers.select("chat_id", "saved_listing_ids"), "chat_id").where(~F.array_contains("saved_listing_ids", F.col("id")))
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy("seq", "id"))
    taken = wanted.withColumn("rank", rank).where(F.col("rank") <= F.lit(most) - F.size("saved_listing_ids"))
    added = taken.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("new"))
    ids = F.coalesce(F.transform("new", lambda x: x["id"]), F.array().cast(subscribers.schema["saved_listing_ids"].dataType))
    return subscribers.join(added, "chat_id", "left").withColumn("saved_listing_ids", F.concat("saved_listing_ids", ids)).drop("new")


def bookmark_state(bookmarks: DataFrame, toggles: DataFrame, listings: DataFrame) -> DataFrame:
    """Bookmarks (user_id, listing_id) after toggles: one that was toggled an odd number of times changes; unknown listings are left out."""
    odd = toggles.groupBy("user_id", "listing_id").count().where("count % 2 = 1").select("user_id", "listing_id")
    have = bookmarks.select("user_id", "listing_id").distinct()
    kept, new = have.join(odd, ["user_id", "listing_id"], "left_anti"), odd.join(have, ["user_id", "listing_id"], "left_anti")
    return kept.unionByName(new).join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").select("user_id", "listing_id")


def backfill_batch(listings: DataFrame, n: int | None = 500) -> DataFrame:
    """The latest listings without a structured payload, newest first; all of them if n is None."""
    out = listings.where(F.get_json_object("raw", "$.structured").isNull()).orderBy(F.col("scraped_at").desc(), "id")
    return out if n is None else out.limit(n)
