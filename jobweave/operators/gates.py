"""Gates that a posting or an event passes before it is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.config import DOMESTIC_SOURCES, SHOW_FIT, UNDATED_STALE_DAYS
from jobweave.functions import patterns as P
from jobweave.functions.text import collapse, matches, once
from jobweave.operators.traffic import moment


def is_internship(title: Column) -> Column:
    """An internship, and not a staff role that runs internships."""
    return once(collapse(title), lambda t: matches(t, P.INTERN) & ~matches(t, P.STAFF))


def is_roundup(title: Column) -> Column:
    """A post that bundles many roles."""
    return matches(collapse(title), P.ROUNDUP)


def access_decision(location: Column, title: Column, text: Column) -> Column:
    """Whether someone in the home country can take the role: accessible, category and reason; the first rule that holds decides."""
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return once(collapse(location), lambda place: once(whole, lambda body: _access(place, body)))


def _access(place: Column, body: Column) -> Column:
    remote = (matches(place, P.REMOTE_WORD) & ~matches(place, P.REMOTE_GEOGRAPHY)) | (matches(body, P.REMOTE_MODALITY) & ~matches(body, P.REMOTE_GEOGRAPHY))
    # Categories and reasons are fixed values.
    rules = (
        (matches(place, P.HOME_COUNTRY) | matches(body, P.HOME_COUNTRY), True, "ethiopia", F.lit("Ethiopia-based duty station.")),
        (remote & ~matches(F.concat_ws("\n", place, body), P.REMOTE_NEGATED), True, "remote", F.lit("Remote / home-based, not locked to a foreign duty station.")),
        (matches(body, P.RESTRICTED), False, "restricted", F.lit("Requires work authorization in a country other than Ethiopia.")),
        (matches(body, P.SPONSORED) & ~matches(body, P.SPONSOR_NEGATED), True, "sponsored", F.lit("Abroad, but travel/visa/relocation support is offered.")),
        (place != "", False, "elsewhere", F.concat(F.lit('In-person at "'), place, F.lit('", outside Ethiopia, with no remote option or travel support.'))),
        (F.lit(True), False, "unclear", F.lit("No Ethiopia, remote, or sponsorship signal found.")),
    )
    out = None
    for test, accessible, category, reason in rules:
        value = F.struct(F.lit(accessible).alias("accessible"), F.lit(category).alias("category"), reason.alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def base_source(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def ingest_gate(postings: DataFrame, as_of: str, domestic: tuple[str, ...] = DOMESTIC_SOURCES, least: int = SHOW_FIT) -> DataFrame:
    """Postings with drop_reason (null for those that stay) and status.

    ``postings``: deadline, posted_at, source, accessible, fits, fit_score.  A deadline up to a day ago still passes
    and is stored as expired.
    """
    day = F.expr("INTERVAL '1' DAY")
    reason = (
        F.when(F.col("deadline") < moment(as_of) - day, "closed")
        .when(F.col("deadline").isNull() & (F.col("posted_at") < moment(as_of) - F.expr(f"INTERVAL '{UNDATED_STALE_DAYS}' DAY")), "stale")
        .when(~F.col("accessible") & ~base_source(F.col("source")).isin(*domestic), "inaccessible")
        .when(~F.col("fits") | (F.col("fit_score") < least), "unfit")
    )
    return postings.withColumn("drop_reason", reason).withColumn("status", status_for(F.col("deadline"), as_of))


def fill_gaps(gated: DataFrame, gaps: DataFrame, as_of: str) -> DataFrame:
    """Gated postings (with is_paid) whose missing deadline or pay takes what a closer reading found (id, deadline, is_paid); a deadline
    found so that has long passed drops the posting after all, and the status follows the deadline."""
    found = gaps.select("id", F.col("deadline").alias("_deadline"), F.col("is_paid").alias("_paid"))
    stays = F.col("drop_reason").isNull() & (F.col("deadline").isNull() | F.col("is_paid").isNull())
    j = gated.join(found, "id", "left")
    deadline = F.when(stays, F.coalesce("deadline", "_deadline")).otherwise(F.col("deadline"))
    closed = stays & (deadline < moment(as_of) - F.expr("INTERVAL '1' DAY"))
    new = {
        "deadline": deadline, "is_paid": F.when(stays, F.coalesce("is_paid", "_paid")).otherwise(F.col("is_paid")),
        "drop_reason": F.when(closed, "closed").otherwise(F.col("drop_reason")), "status": F.when(stays, status_for(deadline, as_of)).otherwise(F.col("status")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in gated.columns])


def status_for(deadline: Column, as_of: str) -> Column:
    return F.when(deadline < moment(as_of), "expired").otherwise("active")


def is_bot(agent: Column) -> Column:
    """No user agent, or one of a program."""
    return (F.coalesce(agent, F.lit("")) == "") | matches(agent, P.BOT_AGENT)


def device_class(agent: Column) -> Column:
    return F.when(matches(agent, P.MOBILE_AGENT), "mobile").otherwise("desktop")


def pageviews(requests: DataFrame) -> DataFrame:
    """Requests (method, route, accept) that count as page views."""
    inside = F.col("route").startswith("/api") | F.col("route").startswith("/analytics")
    return requests.where((F.col("method") == "GET") & F.col("route").isNotNull() & ~inside & F.contains("accept", F.lit("text/html")))


def log_errors(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines (as spark.read.text gives them) with is_error."""
    return lines.withColumn("is_error", matches(F.col(column), P.LOG_ERROR))
