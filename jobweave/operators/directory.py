"""The organisation directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.config import PRIORITIES
from jobweave.operators.board import board_order

# Playbook of an organisation's category; others use the default one.
PLAYBOOKS = {
    "un": "institutional", "au": "institutional", "multilateral": "institutional", "regional": "institutional",
    "embassy": "embassy", "bilateral": "bilateral", "think-tank": "thinktank", "academic": "academic",
    "human-rights": "advocacy", "peace": "advocacy", "election": "advocacy", "democracy": "advocacy", "governance": "advocacy", "gender": "advocacy",
    "migration": "advocacy", "climate": "advocacy", "media": "advocacy", "digital-rights": "advocacy",
    "ingo": "ingo", "foundation": "foundation", "gov": "gov",
}


def with_openings(orgs: DataFrame, listings: DataFrame) -> DataFrame:
    """Organisations with openings (active listings) and hiring."""
    counts = listings.where((F.col("status") == "active") & F.col("org_slug").isNotNull()).groupBy(F.col("org_slug").alias("slug")).agg(F.count(F.lit(1)).alias("_n"))
    joined = orgs.join(counts, "slug", "left")
    return joined.withColumn("openings", F.coalesce("_n", F.lit(0))).withColumn("hiring", F.col("openings") > 0).drop("_n")


def reach(orgs: DataFrame) -> DataFrame:
    """A score of how promising it is to approach each organisation."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points(F.col("hiring"), 100) + points(F.col("contact_email").isNotNull(), 40) + points(F.col("internship_url").isNotNull(), 30)
        + points(F.col("addis_office"), 15) + points(F.col("careers_url").isNotNull(), 10)
        + F.when(F.col("scrape_priority") == "critical", 8).when(F.col("scrape_priority") == "high", 4).when(F.col("scrape_priority") == "medium", 2).otherwise(0)
        + points(F.col("notes").isNotNull(), 2)
    )
    return orgs.withColumn("reach", score)


#: Names stand in the order of a reader's eyes: accents and case decide only between names that are equal without them.
NAME_ORDER = "UNICODE"


def by_name() -> Column:
    return F.collate("name", NAME_ORDER)


def best_first(orgs: DataFrame) -> DataFrame:
    return orgs.orderBy(F.col("reach").desc(), by_name(), "slug")


def badges(orgs: DataFrame) -> DataFrame:
    """Up to three badges in fixed order (fixed values), and the best way to get in touch."""
    named = ((F.col("hiring"), "hiring now"), (F.col("contact_email").isNotNull(), "email"), (F.col("internship_url").isNotNull(), "internships"), (F.col("addis_office"), "addis"))
    every = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in named]))
    only = F.when(F.col("careers_url").isNotNull(), F.array(F.lit("careers page"))).otherwise(F.array().cast("array<string>"))
    ways = ((F.concat(F.lit("mailto:"), F.col("contact_email")), "Email introduction"), (F.col("internship_url"), "Open internship page"), (F.col("careers_url"), "Open careers page"), (F.col("website"), "Open website"))
    label = F.coalesce(*[F.when(c.isNotNull(), name) for c, name in ways])
    return orgs.withColumn("badges", F.when(F.size(every) > 0, F.slice(every, 1, 3)).otherwise(only)).withColumn("contact", F.coalesce(*[c for c, _ in ways])).withColumn("contact_label", label)


def summary(orgs: DataFrame) -> DataFrame:
    """Counts of organisations by category, and in total under ``all``."""
    rolled = orgs.rollup("category").agg(
        F.count(F.lit(1)).alias("orgs"), F.count_if("hiring").alias("hiring"), F.count("contact_email").alias("with_email"), F.count_if("addis_office").alias("local_office"), F.grouping("category").alias("g")
    )
    return rolled.withColumn("category", F.when(F.col("g") == 1, "all").otherwise(F.col("category"))).drop("g")


def search(orgs: DataFrame, category: str | None = None, text: str | None = None, alphabetic: bool = False) -> DataFrame:
    out = orgs if category is None else orgs.where(F.col("category") == category)
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "name", "category", "region")), F.lit(text.strip().lower())))
    return out.orderBy(by_name(), "slug") if alphabetic else best_first(out)


def with_listings(orgs: DataFrame, listings: DataFrame, most: int = 25) -> DataFrame:
    """Each organisation with its best active listings, numbered; one row with nulls where it has none."""
    rank = F.row_number().over(Window.partitionBy("org_slug").orderBy(*board_order()))
    own = listings.where((F.col("status") == "active") & F.col("org_slug").isNotNull()).withColumn("n", rank).where(F.col("n") <= most)
    return orgs.join(own.select(F.col("org_slug").alias("slug"), "n", "id", "title", "deadline", "fit_score"), "slug", "left")


def history(listings: DataFrame, most: int = 4) -> DataFrame:
    """slug and past: title and date of each organisation's latest listings that are no longer active."""
    rank = F.row_number().over(Window.partitionBy("org_slug").orderBy(F.col("scraped_at").desc(), "id"))
    past = listings.where((F.col("status") != "active") & F.col("org_slug").isNotNull()).withColumn("n", rank).where(F.col("n") <= most)
    one = F.struct("n", "title", F.coalesce("deadline", "scraped_at").alias("at"))
    return past.groupBy(F.col("org_slug").alias("slug")).agg(F.array_sort(F.collect_list(one)).alias("past"))


def similar(orgs: DataFrame, most: int = 3) -> DataFrame:
    """The best other organisations of the same category.

    Among the best ``most`` + 1 of a category there are ``most`` others for each of its
    members, so members meet only those and not each other.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("reach").desc(), "name", "slug"))
    best = orgs.select("category", F.col("slug").alias("similar"), rank.alias("rank")).where(F.col("rank") <= most + 1)
    pairs = orgs.select("slug", "category").join(best, "category").where("slug <> similar")
    number = F.row_number().over(Window.partitionBy("slug").orderBy("rank"))
    return pairs.withColumn("n", number).where(F.col("n") <= most).select("slug", "similar", "n")


def outreach(orgs: DataFrame, n: int = 12) -> DataFrame:
    """Organisations that don't reliably post, to be written to."""
    return orgs.where(F.col("posts_publicly").isin("no", "sometimes") & (F.col("category") != "aggregator")).orderBy("name", "slug").limit(n)


def work_queue(orgs: DataFrame, priorities: tuple[str, ...] = PRIORITIES, slug: str | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """slug, url, source and n: organisations to collect from, by priority; a single one if ``slug`` is given.

    ``overrides`` names the source of organisations that have one of their own (by slug): they are in the queue without an address too."""
    own = F.create_map(*[F.lit(x) for kv in (overrides or {}).items() for x in kv]).cast("map<string,string>")
    source = F.try_element_at(own, F.col("slug"))
    url = F.coalesce("internship_url", "careers_url")
    who = F.col("slug") == slug if slug else F.col("posts_publicly").isin("yes", "sometimes") & F.col("scrape_priority").isin(*priorities)
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.coalesce("scrape_priority", F.lit("low"))).cast("int")
    # Numbered inside each priority; those before are counted, a row for each.
    rows = orgs.where(who & (url.isNotNull() | source.isNotNull())).select("slug", url.alias("url"), source.alias("source"), order.alias("_order"))
    counts = rows.groupBy("_order").agg(F.count(F.lit(1)).alias("_n"))
    later = counts.select(F.col("_n").alias("_m"), F.explode(F.sequence(F.col("_order") + 1, F.lit(len(PRIORITIES) + 1))).alias("_order"))
    before = later.groupBy("_order").agg(F.sum("_m").alias("_before"))
    number = F.row_number().over(Window.partitionBy("_order").orderBy("slug"))
    return rows.withColumn("n", number).join(F.broadcast(before), "_order", "left").select("slug", "url", "source", (F.col("n") + F.coalesce("_before", F.lit(0))).cast("int").alias("n"))


def playbook(orgs: DataFrame) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in PLAYBOOKS.items() for x in kv])
    return orgs.withColumn("playbook", F.coalesce(F.try_element_at(pairs, F.col("category")), F.lit("default")))


def social_url(handle: Column, site: str) -> Column:
    """Address of an account given by handle or address; null if there is none."""
    h = F.trim(handle)
    return F.when((h == "") | h.isNull(), None).when(h.rlike(r"(?i)^https?://"), h).otherwise(F.concat(F.lit(site), F.regexp_replace(h, "^@", "")))


def normalize(rows: DataFrame) -> DataFrame:
    """Rows of the seed file as directory rows: blanks are null, yes and no are booleans, unknown words fall back; rows without slug or name go."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    word = lambda c, allowed: F.when(F.lower(blank(c)).isin(*allowed), F.lower(blank(c)))
    out = rows.select(*[blank(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]).where("slug IS NOT NULL AND name IS NOT NULL")
    return (
        out.withColumn("category", F.coalesce("category", F.lit("other")))
        .withColumn("addis_office", F.when(F.lower("addis_office") == "yes", True).when(F.lower("addis_office") == "no", False))
        .withColumn("posts_publicly", F.coalesce(word("posts_publicly", ("yes", "no", "sometimes", "unknown")), F.lit("unknown")))
        .withColumn("scrape_priority", word("scrape_priority", PRIORITIES))
    )
