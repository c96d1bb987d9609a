"""Addresses: hosts, kinds of source, cleaning and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which kind of source serves an address; the first match decides, any other web address is generic.
KINDS = (
    ("inspira", r"(?i)^https?://careers\.un\.org"),
    ("idealist", r"(?i)^https?://([a-z0-9-]+\.)*idealist\.org"),
    ("oracle-hcm", r"(?i)^https?://[^/]*\.oraclecloud\.com"),
    ("reliefweb", r"(?i)^https?://([a-z0-9-]+\.)*reliefweb\.int"),
    ("workday", r"(?i)^https?://[^/]*\.myworkdayjobs\.com"),
    ("greenhouse", r"(?i)^https?://[^/]*greenhouse\.io"),
    ("lever", r"(?i)^https?://[^/]*lever\.co"),
    ("smartrecruiters", r"(?i)^https?://[^/]*smartrecruiters\.com"),
    ("successfactors", r"(?i)^https?://(?:jobs\.au\.int(?:[:/?#]|$)|[^/?#]*\.(?:successfactors|sapsf)\.)"),
    ("wordpress", r"(?i)^https?://(?:www\.)?(?:ngojobsinafrica\.com|opportunitiesforafricans\.com|opportunitydesk\.org|globalsouthopportunities\.com|opportunitiesforyouth\.org|harmeejobs\.com)(?:[:/?#]|$)"),
    ("generic-html", r"(?i)^https?://[^/]+"),
)
# Parameters that only track.
TRACKING = r"(?i)^(?:utm_[^=]*|gh_src|source|ref|amp)(?:=|$)"


def kind_of(url: Column, kinds: tuple[tuple[str, str], ...] = KINDS) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in kinds:
        out = out.when(url.rlike(pattern), name)
    return out


def host(url: Column) -> Column:
    """Host in lower case without port, user and a leading www.; null for what is no web address."""
    h = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", F.regexp_replace(h, r"^www\.", ""))


def site(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def query_param(url: Column, name: str) -> Column:
    v = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(v != "", v)


def canonical(url: Column) -> Column:
    """The address without tracking parameters, empty parameters and an empty fragment; scheme and host in lower
    case, a path at least, and spaces in parameters as plus signs, as a URL parser writes them."""
    origin, path = F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1), F.regexp_extract(url, r"(?i)^(?:https?://[^/?#]*)?([^?#]*)", 1)
    page = F.concat(F.lower(origin), F.when((origin != "") & (path == ""), "/").otherwise(path))
    params = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING) & ~p.rlike(r"^[^=]*=?$"))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.replace(F.array_join(params, "&"), F.lit("%20"), F.lit("+")))).otherwise("")
    return F.concat(page, query, F.regexp_extract(url, r"(#.+)$", 1))


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(site(a) == site(b), F.lit(False))
