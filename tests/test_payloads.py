"""Landed payloads of each kind, from files to listings."""

from __future__ import annotations

import json

import pytest

from jobweave.schemas import SCRAPED_LISTING
from jobweave.sources import normalize, payloads

LONG = "The intern supports governance research and policy drafting in the team. " * 3


@pytest.fixture
def landed(spark, tmp_path):
    def put(kind: str, *docs, name: str = "x"):
        folder = tmp_path / f"{kind}-{name}"
        folder.mkdir()
        for i, d in enumerate(docs):
            (folder / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d))
        return payloads.read(spark, str(folder), kind)

    return put


def rows(df):
    assert df.schema.fieldNames() == SCRAPED_LISTING.fieldNames()
    return df.orderBy("source_id").collect()


def test_greenhouse(landed):
    job = lambda i, title, place, text: {"id": i, "title": title, "absolute_url": f"https://boards.greenhouse.io/acme/jobs/{i}", "content": text, "updated_at": "2026-01-02T03:04:05Z", "location": {"name": place}}
    df = landed("greenhouse", {"jobs": [job(1, "Policy Intern", "Remote", "&lt;p&gt;A stipend of $500 monthly&lt;/p&gt;"), job(2, "Policy Officer", "Remote", ""), job(3, "Policy Intern", "Berlin", "")]}, {"jobs": []})
    (r,) = rows(payloads.greenhouse(df))
    assert (r["source"], r["source_id"], r["description_text"], r["is_paid"], r["is_remote"]) == ("greenhouse:acme", "1", "A stipend of $500 monthly", True, True)


def test_lever(landed):
    p = {"id": "a", "text": "Communications helper", "hostedUrl": "https://jobs.lever.co/acme/a", "createdAt": 1700000000000, "description": "<p>Unpaid</p>", "categories": {"location": "Addis Ababa", "commitment": "Internship"}, "lists": [{"text": "Duties", "content": "<li>x</li>"}]}
    (r,) = rows(payloads.lever(landed("lever", [p, dict(p, id="b", categories={"location": "Paris", "commitment": "Intern"})])))
    assert (r["source"], r["description_text"], r["is_paid"], str(r["posted_at"])[:10]) == ("lever:acme", "Unpaid\nDuties\nx", False, "2023-11-14")


def test_workday(landed):
    search = landed("workday_search", {"jobPostings": [{"title": "Legal Intern", "externalPath": "/j/1", "locationsText": "Addis Ababa"}, {"title": "Legal Intern", "externalPath": "/j/2", "locationsText": "Rome"}]})
    details = landed("workday_detail", *[{"jobPostingInfo": {"id": str(i), "externalPath": f"/j/{i}", "jobDescription": "<p>Text</p>", "location": "Addis Ababa", "additionalLocations": ["Remote"]}} for i in (1, 2)])
    (r,) = rows(payloads.workday(search, details, "https://acme.wd1.myworkdayjobs.com", "Ext"))
    assert (r["location"], r["source_url"]) == ("Addis Ababa, Remote", "https://acme.wd1.myworkdayjobs.com/Ext/j/1")


def test_smartrecruiters(landed):
    search = landed("smartrecruiters_search", {"content": [{"id": "1", "name": "Data Intern", "location": {"city": "Oslo", "country": "no", "remote": True}}, {"id": "2", "name": "Data Intern", "location": {"city": "Oslo", "country": "no"}}]})
    detail = {"id": "1", "location": {"city": "Oslo", "country": "no", "remote": True}, "jobAd": {"sections": {"a": {"title": "About", "text": "<p>x</p>"}, "b": {"text": "y"}}}}
    (r,) = rows(payloads.smartrecruiters(search, landed("smartrecruiters_detail", detail), "Acme"))
    assert (r["location"], r["description_text"], r["source_url"]) == ("Oslo, no, Remote", "About\nx\ny", "https://jobs.smartrecruiters.com/Acme/1")


def test_reliefweb(landed):
    fields = {"title": "Protection Internship", "body": "Voluntary basis", "source": [{"name": "NRC"}], "city": [{"name": "Jijiga"}], "country": [{"name": "Ethiopia"}], "date": {"closing": "2026-05-01T00:00:00+00:00"}}
    (r,) = rows(payloads.reliefweb(landed("reliefweb", {"data": [{"id": "9", "fields": fields}, {"id": "8", "fields": {"title": "Driver", "country": [{"name": "Ethiopia"}]}}]})))
    assert (r["location"], r["org_name"], r["is_paid"], str(r["deadline"])) == ("Jijiga, Ethiopia", "NRC", False, "2026-05-01 00:00:00")


def test_idealist(landed):
    hit = {"objectID": "1", "type": "INTERNSHIP", "name": "Research Intern", "url": {"en": "/en/x"}, "description": f"<p>{LONG}</p>", "remoteOk": True, "detailsStipendProvided": True}
    df = landed("idealist", {"hits": [hit, dict(hit, objectID="2", remoteCountry="US"), dict(hit, objectID="3", type="JOB"), dict(hit, objectID="4", remoteOk=False, country="ET", city="Adama"), dict(hit, objectID="5", description="short")]})
    got = rows(payloads.idealist(df))
    assert [(r["source_id"], r["location"], r["is_paid"]) for r in got] == [("1", "Remote", True), ("4", "Adama, Ethiopia", True)]


def test_inspira(landed):
    row = {"jobId": 7, "postingTitle": "Intern", "categoryCode": "INT", "dept": "Economic Commission for Africa", "dutyStation": [{"description": "ADDIS ABABA"}], "jobDescription": "<div>x</div>", "endDate": "2026-03-01"}
    df = landed("inspira", {"data": [row, dict(row, jobId=8, dutyStation=[{"description": "NEW YORK"}]), dict(row, jobId=9, categoryCode="P"), dict(row, jobId=10, dutyStation=[{"description": "Home based"}], dept="DPO")]})
    got = payloads.inspira(df, [("uneca", "ECA", r"\bECA\b|Economic Commission for Africa"), (None, None, None)]).collect()
    assert sorted((r["source_id"], r["org_slug"]) for r in got) == [("10", "un-careers"), ("7", "un-careers"), ("7", "uneca")]


def test_oracle(landed):
    search = landed("oracle_search", {"items": [{"requisitionList": [{"Id": "1", "Title": "Policy Intern"}, {"Id": "2", "Title": "Cook"}]}, {"requisitionList": None}]})
    details = landed("oracle_detail", {"items": [{"Id": "1", "Title": "Policy Intern", "ExternalDescriptionStr": "<p>paid</p>", "PrimaryLocation": "Addis Ababa", "ExternalPostedEndDate": "2026-02-03"}]})
    (r,) = rows(payloads.oracle_hcm(search, details, "https://x.oraclecloud.com", "CX_1"))
    assert (r["source"], r["is_paid"], str(r["deadline"])[:10]) == ("oracle-hcm:x.oraclecloud.com", True, "2026-02-03")


def test_successfactors(spark, tmp_path):
    item = f"<item><title>Internship Program (Addis Ababa, Ethiopia)</title><link>https://jobs.au.int/job/Addis/123/?feed=1</link><description>&lt;p&gt;{LONG} Deadline: 3 May 2026&lt;/p&gt;</description><pubDate>Fri, 02 Jan 2026 00:00:00 +0000</pubDate></item>"
    (tmp_path / "f.xml").write_text(f"<rss><channel>{item}<item><title>Cook (Addis)</title><link>https://a/1</link><description>short</description></item></channel></rss>")
    (r,) = rows(payloads.successfactors(payloads.read(spark, str(tmp_path), "successfactors"), "https://www.jobs.au.int"))
    assert (r["title"], r["location"], r["source_id"], r["source_url"]) == ("Internship Program", "Addis Ababa, Ethiopia", "123", "https://jobs.au.int/job/Addis/123/")
    assert (str(r["deadline"])[:10], str(r["posted_at"])[:10]) == ("2026-05-03", "2026-01-02")


def test_wordpress(landed):
    post = {"id": 5, "link": "https://blog.example.org/p", "date": "2026-01-01T00:00:00", "title": {"rendered": "Internship at Foo &amp; Bar"}, "content": {"rendered": "<p>Location: Addis Ababa</p>\n<p>Deadline: May 4, 2026</p><div class=\"my-related-box\">Remote: other posts</div><ins>ad</ins>"}}
    (r,) = rows(payloads.wordpress(landed("wordpress", [post, dict(post, id=6, title={"rendered": "30 Jobs and Internships"}), dict(post, id=7, link=None)])))
    assert (r["org_name"], r["location"], str(r["deadline"])[:10]) == ("Foo & Bar", "Addis Ababa", "2026-05-04")
    assert (r["description_text"], r["is_remote"]) == ("Location: Addis Ababa Deadline: May 4, 2026", False)


def test_cards_and_vacancy_tables(spark, landed):
    cards = spark.createDataFrame([("u1", "Policy Intern", "1", 0), ("u1", "Policy Intern", "1", 1), ("u2", "10 jobs at X", "2", 2)], "url string, title string, source_id string, pos int")
    details = spark.createDataFrame([("u1", "<p>Organization: Green Fund</p><p>Location: Jimma</p>"), ("u2", "")], "url string, html string")
    (r,) = rows(payloads.board_cards(cards, details, "ethiongojobs"))
    assert (r["org_name"], r["location"]) == ("Green Fund", "Jimma")
    table = spark.createDataFrame([("1", "u", "Assistant", "Addis", "IN", "May-04-26", "ETH"), ("2", "u", "Assistant", "Rome", "IN", "May-04-26", "ITA")], "source_id string, url string, title string, location string, post_level string, apply_by string, country string")
    docs = landed("oracle_detail", {"items": [{"Id": "1", "Title": "Assistant", "ExternalDescriptionStr": "gratis personnel"}]})
    (r,) = rows(payloads.vacancy_rows(table, docs))
    assert (str(r["deadline"])[:10], r["is_paid"]) == ("2026-05-04", False)


def test_registry_and_union(spark, landed):
    assert {"greenhouse", "lever", "reliefweb", "idealist", "wordpress"} <= set(normalize.REGISTRY)
    empty = normalize.normalize("greenhouse", landed("greenhouse", {"jobs": []}))
    assert normalize.union_sources(empty, empty).count() == 0
