"""The domain's tables, derived from the star-schema test tables.

Each table exists twice with the same meaning: as a DataFrame for the queries, and as
the text of a common table expression for the oracles.  ``oracle()`` puts the
expressions that a statement names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What "now" means for the event tables and for the listing tables.
EVENTS_AS_OF, LISTINGS_AS_OF = "2024-01-31 00:00:00", "1998-08-02 00:00:00"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over the cores where a scan has fewer tasks than there are cores: a small file of one row group
    is read by one task, which would then do all work on its texts.  Tables with more tasks stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables whose texts the rules work on for long.
_LONG_WORK = {"postings"}
_EXPRESSIONS: dict[str, dict[str, str]] = {
    "page_events": {
        "id": "event_id",
        "ts": "CAST(ts AS TIMESTAMP)",
        "type": "CASE event_type WHEN 'view' THEN 'listing_view' WHEN 'click' THEN 'apply_click' WHEN 'purchase' THEN 'tg_save' WHEN 'signup' THEN 'tg_subscribe' ELSE 'pageview' END",
        "visitor_hash": "user_id",
        "listing_id": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END",
        "ref": "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN 'tg' WHEN user_id % 7 = 2 THEN 'deeplink' ELSE c_mktsegment END",
        "device": "CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END",
        "country": "n_name",
    },
    "listings": {
        "id": "o_orderkey",
        "source_url": "concat('https://jobs', o_orderkey % 13, '.example.org/post/', o_orderkey)",
        "source": "CASE o_orderkey % 5 WHEN 0 THEN concat('greenhouse:org', o_orderkey % 7) WHEN 1 THEN concat('lever:org', o_orderkey % 7) WHEN 2 THEN concat('generic:site', o_orderkey % 11) WHEN 3 THEN 'ethiongojobs' ELSE 'undp' END",
        "org_slug": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat('org-', o_custkey % 100 + 1) END",
        "org_name": "CASE WHEN o_orderkey % 23 = 0 THEN 'Unknown' ELSE concat('Org ', o_custkey % 100 + 1) END",
        "title": "CASE o_orderkey % 6 WHEN 0 THEN 'Policy Intern' WHEN 1 THEN 'Communications Internship' WHEN 2 THEN 'Internship Coordinator' WHEN 3 THEN 'Governance and human rights internship' WHEN 4 THEN '10 jobs at the Center' ELSE concat('Research Intern ', o_orderkey % 50) END",
        "location": "CASE o_orderkey % 4 WHEN 0 THEN 'Addis Ababa, Ethiopia' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Nairobi, Kenya' END",
        "is_remote": "o_orderkey % 4 = 1",
        "is_paid": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
        "stipend_text": "CASE WHEN o_orderkey % 3 = 0 THEN concat('USD ', 100 + o_orderkey % 900) END",
        "deadline": "CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END",
        "posted_at": "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL '90' DAY END",
        "scraped_at": "CAST(o_orderdate AS TIMESTAMP) - INTERVAL '20' DAY",
        "fit_score": "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 95 WHEN '2' THEN 80 WHEN '3' THEN 70 WHEN '4' THEN 60 ELSE 45 END",
        "status": "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' ELSE 'hidden' END",
        "posted_to_channel": "o_orderkey % 4 = 0",
        "apply_url": "CASE o_orderkey % 3 WHEN 1 THEN concat('https://apply.example.org/', o_orderkey) WHEN 2 THEN concat('ftp://apply.example.org/', o_orderkey) END",
        "apply_email": "CASE WHEN o_orderkey % 5 = 0 THEN concat('jobs', o_orderkey, '@example.org') END",
        "description": "concat('About the role. The ', CASE o_orderkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'health' ELSE 'gender' END, ' team hosts an intern. Apply by the date.')",
        "raw": "CASE WHEN o_orderkey % 2 = 0 THEN concat('{\"structured\":{\"data\":{\"application_email\":\"hr', o_orderkey % 9, '@example.org\",\"application_url\":\"https://forms.example.org/', o_orderkey, '\",\"how_to_apply\":\"Send a letter\",\"sections\":[{\"bullets\":[\"a\"],\"paragraphs\":[\"Line ', o_orderkey % 5, '\",7],\"title\":\"About\"},{\"bullets\":[null],\"paragraphs\":[],\"title\":\"\"}],\"summary\":\"', CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE concat('Role ', o_orderkey) END, '\"}},\"repostedToChannel\":', CASE WHEN o_orderkey % 8 = 0 THEN 'true' ELSE 'false' END, '}') ELSE '{}' END",
        "field_tags": "split(CASE o_orderkey % 3 WHEN 0 THEN 'policy,governance' WHEN 1 THEN 'health' ELSE 'gender,human-rights' END, ',')",
    },
    "postings": {
        "id": "o_orderkey",
        "url": "concat(CASE o_orderkey % 13 WHEN 0 THEN 'https://careers.un.org/job/' WHEN 1 THEN 'https://www.idealist.org/en/' WHEN 2 THEN 'https://x.fa.em2.oraclecloud.com/hcm/' WHEN 3 THEN 'https://reliefweb.int/job/' WHEN 4 THEN 'https://acme.wd1.myworkdayjobs.com/Ext/' WHEN 5 THEN 'https://boards.greenhouse.io/acme/' WHEN 6 THEN 'https://jobs.lever.co/acme/' WHEN 7 THEN 'https://careers.smartrecruiters.com/acme/' WHEN 8 THEN 'https://career5.successfactors.eu/' WHEN 9 THEN 'https://www.opportunitydesk.org/jobs/' WHEN 10 THEN 'HTTPS://WWW.Jobs.Example.org:8080/' WHEN 11 THEN 'mailto:a@example.org?' ELSE 'http://example.com/' END, o_orderkey, CASE o_custkey % 5 WHEN 0 THEN '?utm_source=x&a=1&b=&utm_medium=m#' WHEN 1 THEN '?gh_src=abc&amp=1' WHEN 2 THEN '?q=a%20b&ref=tw#top' WHEN 3 THEN '' ELSE '?x=1&y=2' END)",
        "source": "CASE o_orderkey % 4 WHEN 0 THEN 'ethiongojobs' WHEN 1 THEN 'greenhouse:acme' WHEN 2 THEN 'generic:site' ELSE 'undp' END",
        "title": "CASE o_orderkey % 12 WHEN 0 THEN 'Policy  Intern' WHEN 1 THEN 'Internship Programme Coordinator' WHEN 2 THEN 'Communications Internship at Green Fund.' WHEN 3 THEN '5 Interns Required' WHEN 4 THEN '10 Job and Internship opportunities at Acme' WHEN 5 THEN 'Internship: Human Resources Intern' WHEN 6 THEN '(MEL and Communication Intern)' WHEN 7 THEN 'IT Support Internship (5 Required)' WHEN 8 THEN 'Health Officer' WHEN 9 THEN 'Traineeship in Migration' WHEN 10 THEN 'International Relations fellow' ELSE 'Vacancies at UNECA' END",
        "location": "CASE o_custkey % 8 WHEN 0 THEN 'Addis Ababa, Ethiopia' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Remote areas of Kenya' WHEN 3 THEN 'Geneva, Switzerland' WHEN 5 THEN '' WHEN 6 THEN 'Nairobi, Kenya' WHEN 7 THEN 'Home-based / remote' END",
        "org_name": "CASE o_custkey % 6 WHEN 0 THEN concat('Supplier#', lpad(CAST(o_custkey % 100 + 1 AS VARCHAR(9)), 9, '0')) WHEN 1 THEN concat('THE supplier ', lpad(CAST(o_custkey % 100 + 1 AS VARCHAR(9)), 9, '0'), ' Ltd') WHEN 2 THEN concat('Joint office of Supplier#', lpad(CAST(o_custkey % 100 + 1 AS VARCHAR(9)), 9, '0'), ' & Co') WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Somebody else' END",
        "text": "concat(CASE o_orderkey % 9 WHEN 0 THEN 'Location: Addis Ababa Deadline Date: May 29, 2026' WHEN 1 THEN 'Deadline: 29/05/2026\nOrganization: Green Fund; ' WHEN 2 THEN 'Applications close on 21st June 2025.' WHEN 3 THEN 'Submit your form no later than 4 January 2022.' WHEN 4 THEN 'Please apply by 25 October 2024 with a letter.' WHEN 5 THEN 'The project will end by March 3, 2025.' WHEN 6 THEN 'Closing Date: tomorrow' WHEN 7 THEN 'Duty Station: Nairobi\nDepartment: Policy' ELSE 'Apply by 99/99/2024.' END, '\n', CASE o_orderkey % 7 WHEN 0 THEN 'Fully remote position.' WHEN 1 THEN 'Visa sponsorship is offered.' WHEN 2 THEN 'We do not cover travel costs.' WHEN 3 THEN 'Must be eligible to work in the United States.' WHEN 4 THEN 'Hybrid work, 2 days remote per week.' WHEN 5 THEN 'Travel costs are covered.' ELSE 'Work in remote areas.' END, ' ', CASE o_orderkey % 5 WHEN 0 THEN 'A stipend of USD 1,500 per month is paid.' WHEN 1 THEN 'This is unpaid.' WHEN 2 THEN 'Salary: ETB 5,000 - 7,000 monthly.' WHEN 3 THEN 'Costs $200 for a visit.' ELSE 'Gender, peace and human rights policy work in civil society.' END, ' ', CASE o_orderkey % 3 WHEN 0 THEN 'The health and nutrition team.' WHEN 1 THEN 'Governance and elections.' ELSE '' END)",
        "posted_at": "CASE WHEN o_orderkey % 6 = 0 THEN TIMESTAMP '2025-12-01 00:00:00' WHEN o_orderkey % 6 < 4 THEN TIMESTAMP '2025-03-01 00:00:00' END",
    },
    "orgs": {
        "slug": "concat('org-', s_suppkey)",
        "name": "CASE WHEN s_suppkey % 4 = 0 THEN concat('The ', s_name, ' Organization') ELSE s_name END",
        "category": "CASE s_nationkey % 5 WHEN 0 THEN 'un' WHEN 1 THEN 'ingo' WHEN 2 THEN 'think-tank' WHEN 3 THEN 'aggregator' ELSE 'media' END",
        "region": "n_name",
        "posts_publicly": "CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'sometimes' WHEN 2 THEN 'no' END",
        "scrape_priority": "CASE s_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END",
        "contact_email": "CASE WHEN s_suppkey % 3 = 0 THEN concat('info', s_suppkey, '@example.org') END",
        "internship_url": "CASE WHEN s_suppkey % 5 = 0 THEN concat('https://org', s_suppkey, '.example.org/internships') END",
        "website": "CASE WHEN s_suppkey % 11 <> 0 THEN concat('https://org', s_suppkey, '.example.org/') END",
        "careers_url": "CASE WHEN s_suppkey % 2 = 0 THEN concat('https://org', s_suppkey, '.example.org/careers') END",
        "addis_office": "CASE s_suppkey % 6 WHEN 0 THEN true WHEN 1 THEN false END",
        "twitter": "CASE s_suppkey % 4 WHEN 0 THEN concat('@org', s_suppkey) WHEN 1 THEN concat('https://x.com/org', s_suppkey) WHEN 2 THEN '' END",
        "notes": "CASE WHEN s_suppkey % 7 = 0 THEN 'Known host' END",
    },
    "subscribers": {
        "chat_id": "c_custkey",
        "joined_at": "TIMESTAMP '2024-01-31 00:00:00' - (c_custkey % 60) * INTERVAL '1' DAY - (c_custkey % 24) * INTERVAL '1' HOUR",
    },
    "bookmarks": {
        "user_id": "user_id",
        "listing_id": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)",
        "created_at": "CAST(ts AS TIMESTAMP)",
    },
    "org_stats": {
        "run_id": "year(o_orderdate) * 100 + month(o_orderdate)",
        "slug": "concat('org-', o_custkey % 12)",
        "adapter": "CASE o_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'generic-html' END",
        "scraped": "count(*)",
        "kept": "count(CASE WHEN o_orderstatus <> 'P' THEN 1 END)",
        "new_rows": "count(CASE WHEN o_orderstatus = 'O' THEN 1 END)",
        "errors": "count(CASE WHEN o_orderkey % 97 = 0 THEN 1 END)",
        "error": "CASE WHEN count(*) % 5 = 0 THEN 'browser challenge' END",
        "duration_ms": "CAST(sum(o_orderkey % 1000) AS BIGINT)",
        "started_at": "min(CAST(o_orderdate AS TIMESTAMP))",
        "finished_at": "CASE WHEN count(*) % 17 = 0 THEN NULL ELSE max(CAST(o_orderdate AS TIMESTAMP)) END",
    },
}
_FROM = {
    "page_events": "events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "listings": "orders",
    "postings": "orders",
    "orgs": "supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "subscribers": "customer",
    "bookmarks": "events WHERE event_type = 'purchase'",
    "org_stats": "orders GROUP BY year(o_orderdate) * 100 + month(o_orderdate), o_custkey % 12, o_custkey % 3",
}


def _select(name: str) -> str:
    columns = ", ".join(f"{sql} AS {column}" for column, sql in _EXPRESSIONS[name].items())
    return f"SELECT {columns} FROM {_FROM[name]}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the domain's tables as a DataFrame."""
    tables = re.findall(r"\b(events|customer|nation|orders|supplier)\b", _FROM[name])
    text = _select(name).replace("{", "{{").replace("}", "}}")
    for t in dict.fromkeys(tables):
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    spread = dealt if name in _LONG_WORK else lambda df: df
    return spark.sql(text, **{t: spread(base(spark, sf_dir, t)) for t in tables})


def oracle(statement: str, *names: str) -> str:
    """The statement with the tables that it names defined in front."""
    names = names or tuple(n for n in _EXPRESSIONS if re.search(rf"\b{n}\b", statement))
    heads = [f"{n} AS ({_select(n)})" for n in names]
    body = statement.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper().startswith("RECURSIVE ")
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*heads, rest])}"
    return f"WITH {', '.join(heads)} {body}" if heads else body
