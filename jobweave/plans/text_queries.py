"""Text rules, gates and classification over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.config import EXCLUDE_TERMS, HIGH_SIGNAL_TERMS, INCLUDE_TERMS, TAG_TERMS
from jobweave.functions import keywords, lexicon, text, urls
from jobweave.functions import patterns as P
from jobweave.operators import classify, gates
from jobweave.plans.registry import query
from jobweave.plans.tables import base, dealt, load, oracle

AS_OF = "2026-01-15 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def hits(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {q(pattern)}), false)"


def collapsed(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), {q(P.SPACE + '+')}, ' ', 'g'))"


def _postings(spark, sf_dir):
    return load(spark, sf_dir, "postings")


@query("title_gate", oracle(f"SELECT id, {hits(collapsed('title'), P.INTERN)} AND NOT {hits(collapsed('title'), P.STAFF)} AS internship FROM postings"))
def title_gate(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", gates.is_internship(F.col("title")).alias("internship"))


@query("roundup_titles", oracle(f"SELECT id, {hits(collapsed('title'), P.ROUNDUP)} AS roundup FROM postings"))
def roundup_titles(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", gates.is_roundup(F.col("title")).alias("roundup"))


ACCESS = f"""p AS (SELECT *, {collapsed('location')} AS loc, concat(title, chr(10), text) AS body FROM postings),
x AS (SELECT *, CASE WHEN {hits('loc', P.HOME_COUNTRY)} OR {hits('body', P.HOME_COUNTRY)} THEN 'ethiopia'
  WHEN (({hits('loc', P.REMOTE_WORD)} AND NOT {hits('loc', P.REMOTE_GEOGRAPHY)}) OR ({hits('body', P.REMOTE_MODALITY)} AND NOT {hits('body', P.REMOTE_GEOGRAPHY)}))
    AND NOT {hits("concat(loc, chr(10), body)", P.REMOTE_NEGATED)} THEN 'remote'
  WHEN {hits('body', P.RESTRICTED)} THEN 'restricted' WHEN {hits('body', P.SPONSORED)} AND NOT {hits('body', P.SPONSOR_NEGATED)} THEN 'sponsored'
  WHEN loc <> '' THEN 'elsewhere' ELSE 'unclear' END AS category FROM p),
a AS (SELECT *, category IN ('ethiopia', 'remote', 'sponsored') AS accessible FROM x)"""


def _access(df):
    return df.withColumn("access", gates.access_decision(F.col("location"), F.col("title"), F.col("text")))


@query("access_decision", oracle(f"""WITH {ACCESS} SELECT id, accessible, category, CASE category WHEN 'ethiopia' THEN 'Ethiopia-based duty station.' WHEN 'remote' THEN 'Remote / home-based, not locked to a foreign duty station.'
  WHEN 'restricted' THEN 'Requires work authorization in a country other than Ethiopia.' WHEN 'sponsored' THEN 'Abroad, but travel/visa/relocation support is offered.'
  WHEN 'elsewhere' THEN concat('In-person at "', loc, '", outside Ethiopia, with no remote option or travel support.') ELSE 'No Ethiopia, remote, or sponsorship signal found.' END AS reason FROM a""", "postings"))  # fmt: skip
def access_decision(spark, sf_dir):
    return _access(_postings(spark, sf_dir)).select("id", "access.accessible", "access.category", "access.reason")


# Dates.


def _part(c: str, pattern: str, i: int) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {i})"


def sql_date(c: str) -> str:
    """The oracle's form of parse_deadline, over a column."""
    c = f"regexp_replace({c}, '(?i)([0-9]{{1,2}})(?:st|nd|rd|th)\\b', '\\1', 'g')"
    made = lambda y, m, d: f"try_cast(concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS DATE)"

    def month(name: str) -> str:
        at = f"strpos('{text.MONTHS}', lower({name}[1:3]))"
        return f"CASE WHEN {at} > 0 AND {at} % 3 = 1 AND length({name}) >= 3 THEN CAST(({at} + 2) // 3 AS VARCHAR) END"

    name_first, day_first = r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s*(\d{4})", r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s*(\d{4})"
    iso, slashes = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
    y = _part(c, slashes, 3)
    year = f"CASE WHEN length({y}) = 2 THEN concat(CASE WHEN {y} < '50' THEN '20' ELSE '19' END, {y}) ELSE {y} END"
    tried = [
        (name_first, made(_part(c, name_first, 3), month(_part(c, name_first, 1)), _part(c, name_first, 2))),
        (day_first, made(_part(c, day_first, 3), month(_part(c, day_first, 2)), _part(c, day_first, 1))),
        (iso, made(_part(c, iso, 1), _part(c, iso, 2), _part(c, iso, 3))),
        (slashes, f"coalesce({made(year, _part(c, slashes, 1), _part(c, slashes, 2))}, {made(year, _part(c, slashes, 2), _part(c, slashes, 1))})"),
    ]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({c}, {q(p)}) THEN {v} END" for p, v in tried) + ")"


DATES = "dates AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 1 THEN strftime(o_orderdate, '%d %b %Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%y') WHEN 5 THEN concat(strftime(o_orderdate, '%B %d'), 'th, ', year(o_orderdate), ' (midnight)') WHEN 6 THEN 'soon' WHEN 7 THEN 'Smarch 3, 2024' END AS raw FROM orders)"


@query("deadline_parse", f"WITH {DATES} SELECT id, CAST({sql_date('raw')} AS VARCHAR) AS deadline FROM dates")
def deadline_parse(spark, sf_dir):
    f = lambda fmt: F.date_format("o_orderdate", fmt)
    k = F.col("o_orderkey") % 9
    raw = (
        F.when(k == 0, f("MMMM dd, yyyy")).when(k == 1, f("dd MMM yyyy")).when(k == 2, f("yyyy-MM-dd")).when(k == 3, f("dd/MM/yyyy")).when(k == 4, f("MM/dd/yy"))
        .when(k == 5, F.concat(f("MMMM dd"), F.lit("th, "), f("yyyy"), F.lit(" (midnight)"))).when(k == 6, "soon").when(k == 7, "Smarch 3, 2024")
    )
    return base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(text.parse_deadline(raw), "yyyy-MM-dd").alias("deadline"))


def sql_deadline(c: str) -> str:
    near = f"regexp_extract({c}, {q('(?is)' + P.DEADLINE_LABEL + '.*')}, 0)[1:80]"
    token = lambda pattern, x: sql_date(f"regexp_extract({x}, {q(pattern)}, 1)")
    return f"""CASE WHEN regexp_matches({c}, {q('(?i)' + P.DEADLINE_LABEL)}) AND regexp_matches({near}, {q(P.DATE_TOKEN)}) THEN {token(P.DATE_TOKEN, near)}
      WHEN regexp_matches({c}, {q(P.STRONG_DEADLINE)}) THEN {token(P.STRONG_DEADLINE, c)}
      WHEN regexp_matches({c}, {q(P.ABOUT_APPLYING)}) AND regexp_matches({c}, {q(P.WEAK_DEADLINE)}) THEN {token(P.WEAK_DEADLINE, c)} END"""


@query("deadline_find", oracle(f"SELECT id, CAST({sql_deadline('text')} AS VARCHAR) AS deadline FROM postings"))
def deadline_find(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", F.date_format(text.find_deadline(F.col("text")), "yyyy-MM-dd").alias("deadline"))


def sql_meta(c: str, label: str) -> str:
    head = f"{c}[1:600]"
    rest = f"regexp_extract({head}, {q('(?is)' + label + '(.*)')}, 1)"
    value = collapsed(f"regexp_split_to_array({rest}, {q(P.LABEL_STOP)})[1]")
    return f"CASE WHEN regexp_matches({head}, {q('(?i)' + label)}) THEN nullif(regexp_replace({value}, '[.;]+$', ''), '') END"


@query("top_meta", oracle("SELECT id, " + ", ".join(f"{sql_meta('text', p)} AS {k}" for k, p in P.LABELS.items()) + " FROM postings"))
def top_meta(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", text.top_meta(F.col("text")).alias("m")).select("id", "m.*")


@query("paid_flag", oracle(f"""
WITH h AS (SELECT id, concat(lower(title), chr(10), lower(text[1:1500])) AS head FROM postings)
SELECT id, CASE WHEN regexp_matches(head, {q(P.UNPAID)}) THEN false WHEN regexp_matches(head, {q(P.PAID)}) THEN true END AS paid FROM h"""))  # fmt: skip
def paid_flag(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", text.detect_paid(F.col("title"), F.col("text")).alias("paid"))


SQL_STIPEND = f"""CASE WHEN value <> '' AND regexp_matches(substring(text, greatest(spot - 80, 1), least(spot - 1, 80) + length(value) + 40), {q(P.STIPEND_CONTEXT)})
  THEN regexp_replace({collapsed('value')}, '[\\s.,;:–—-]+$', '') END"""


@query("stipend", oracle(f"""
WITH v AS (SELECT id, text, regexp_extract(text, {q(P.STIPEND)}, 0) AS value FROM postings), w AS (SELECT *, strpos(text, value) AS spot FROM v)
SELECT id, {SQL_STIPEND} AS stipend FROM w"""))  # fmt: skip
def stipend(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", text.extract_stipend(F.col("text")).alias("stipend"))


@query("org_from_title", oracle(f"SELECT id, nullif(trim(regexp_replace(regexp_extract(title, {q(P.AT_ORG)}, 1), '[.,;]+$', '')), '') AS org FROM postings"))
def org_from_title(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", text.org_from_title(F.col("title")).alias("org"))


def sql_norm_title(c: str) -> str:
    t = rf"regexp_replace(lower({c}), '\(\s*\d+\s*(required|positions?|posts?|vacancies|needed)\s*\)', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '^\s*(internship|intern)\s*[:\-–]\s*', ''), '[^a-z0-9]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '\b(internships?|interns?)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_norm_location(c: str) -> str:
    return f"trim(regexp_replace(split_part(lower(coalesce({c}, '')), ',', 1), '[^a-z0-9]+', ' ', 'g'))"


@query("norm_titles", oracle(f"SELECT id, {sql_norm_title('title')} AS norm_title, {sql_norm_location('location')} AS norm_location FROM postings"))
def norm_titles(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", text.normalize_title(F.col("title")).alias("norm_title"), text.normalize_location(F.col("location")).alias("norm_location"))


def sql_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 4))"


@query("doc_tokens", f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, sha256(array_to_string(list_sort({sql_tokens('text')}), ' ')) AS tokens_sha256 FROM documents")
def doc_tokens(spark, sf_dir):
    t = F.array_sort(text.description_tokens(F.col("text")))
    return dealt(base(spark, sf_dir, "documents")).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


# Keywords.


def sql_has(c: str, term: str) -> str:
    import re

    return f"regexp_matches({c}, {q('(^|[^a-z0-9])' + re.escape(term.lower()) + '([^a-z0-9]|$)')})"


def sql_matched(c: str, terms) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_has(c, t)} THEN {q(t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"


def sql_tags(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(sql_has(c, t) for t in ts)} THEN {q(tag)} END" for tag, ts in TAG_TERMS.items()) + "], lambda x: x IS NOT NULL)"


#: A lexicon that the test documents hold, beside the default one that the postings hold.
COMMON = ("the", "of", "license", "rights", "la", "die", "que", "version 2.0")


@query("keyword_hits", f"SELECT doc_id, array_to_string({sql_matched('lower(text)', COMMON)}, ',') AS terms FROM documents")
def keyword_hits(spark, sf_dir):
    return dealt(base(spark, sf_dir, "documents")).select("doc_id", F.array_join(keywords.matched(F.col("text"), COMMON), ",").alias("terms"))


@query("lexicon_hits", """
WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark),
d AS (SELECT doc_id, concat(' ', regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', ' ', 'g'), ' ') AS t FROM documents),
w AS (SELECT DISTINCT doc_id, unnest(string_split(t, ' ')) AS term FROM d), h AS (SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms FROM w SEMI JOIN l USING (term) GROUP BY doc_id)
SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN h USING (doc_id)""")  # fmt: skip
def lexicon_hits(spark, sf_dir):
    """The longer words of the benchmark's passages as a lexicon, over all documents."""
    words = base(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term"))
    found = lexicon.matched(dealt(base(spark, sf_dir, "documents")).select("doc_id", "text"), words)
    return found.select("doc_id", F.array_join("terms", ",").alias("terms"))


@query("field_tags", oracle(f"SELECT id, array_to_string({sql_tags('lower(concat(title, chr(10), text))')}, ',') AS tags FROM postings"))
def field_tags(spark, sf_dir):
    body = F.concat_ws("\n", "title", "text")
    return _postings(spark, sf_dir).select("id", F.array_join(keywords.tags(body, TAG_TERMS), ",").alias("tags"))


CLASSIFY = f"""m AS (SELECT *, {sql_matched('lower(concat(title, chr(10), text))', INCLUDE_TERMS)} AS inc, {sql_matched('lower(concat(title, chr(10), text))', EXCLUDE_TERMS)} AS exc,
  {sql_matched('lower(title)', EXCLUDE_TERMS)} AS exct, {sql_tags('lower(concat(title, chr(10), text))')} AS tags FROM postings),
d AS (SELECT *, CASE WHEN len(inc) > 0 AND len(exc) = 0 THEN 'include' WHEN len(inc) = 0 AND len(exct) > 0 THEN 'exclude' ELSE 'ambiguous' END AS decision FROM m),
k AS (SELECT *, CASE decision WHEN 'include' THEN true WHEN 'exclude' THEN false ELSE len(inc) > 0 END AS fits,
  CAST(CASE decision WHEN 'include' THEN least(95, CASE WHEN list_has_any(inc, [{', '.join(map(q, HIGH_SIGNAL_TERMS))}]) THEN 85 + 3 * len(inc) ELSE 70 + 4 * len(inc) END)
    WHEN 'exclude' THEN 0 ELSE CASE WHEN len(inc) > 0 THEN 60 ELSE 0 END END AS INT) AS fit_score,
  CASE decision WHEN 'exclude' THEN '' ELSE array_to_string(tags, ',') END AS fields,
  CASE decision WHEN 'include' THEN concat('Matched social-studies terms: ', array_to_string(inc, ', ')) WHEN 'exclude' THEN concat('Matched excluded role terms: ', array_to_string(exct, ', '))
    ELSE CASE WHEN len(inc) > 0 THEN concat('Ambiguous keyword match without LLM fallback: ', array_to_string(inc, ', ')) ELSE 'No clear social-studies match and LLM fallback unavailable' END END AS reason FROM d)"""


@query("classify", oracle(f"WITH {CLASSIFY} SELECT id, decision, fits, fit_score, fields, reason FROM k", "postings"))
def classify_query(spark, sf_dir):
    return classify.classify(_postings(spark, sf_dir)).select("id", "decision", "fits", "fit_score", F.array_join("fields", ",").alias("fields"), "reason")


@query("model_guard", oracle("SELECT id, least(100, greatest(0, CAST(floor((id % 300 - 100) + 0.5) AS INT))) AS fit_score, CASE WHEN id % 2 = 0 THEN 'policy,gender' ELSE 'policy' END AS fields FROM postings WHERE id % 5 <> 0"))
def model_guard(spark, sf_dir):
    tagged = F.when(F.col("id") % 2 == 0, F.array(F.lit("policy"), F.lit("nonsense"), F.lit("gender"))).otherwise(F.array(F.lit("policy")))
    answer = F.when(F.col("id") % 5 != 0, F.struct(F.lit(True).alias("fits"), tagged.alias("fields"), (F.col("id") % 300 - 100).alias("fit_score"), F.lit("r").alias("reason")))
    rows = _postings(spark, sf_dir).select("id", answer.alias("a")).select("id", classify.model_guard(F.col("a")).alias("g")).where("g IS NOT NULL")
    return rows.select("id", "g.fit_score", F.array_join("g.fields", ",").alias("fields"))


QUOTES = "CASE id % 4 WHEN 0 THEN 'stipend  of usd 1,500' WHEN 1 THEN 'unpaid' WHEN 2 THEN 'salary: etb 5,000' ELSE 'travel costs are covered' END"


@query("evidence_guard", oracle(f"""
SELECT id, CASE WHEN length(lower({collapsed(QUOTES)})) >= 8 AND contains(lower({collapsed('text')}), lower({collapsed(QUOTES)})) THEN 'kept' END AS value FROM postings"""))  # fmt: skip
def evidence_guard(spark, sf_dir):
    k = F.col("id") % 4
    quote = F.when(k == 0, "stipend  of usd 1,500").when(k == 1, "unpaid").when(k == 2, "salary: etb 5,000").otherwise("travel costs are covered")
    return _postings(spark, sf_dir).select("id", classify.evidence_guard(F.lit("kept"), quote, F.col("text")).alias("value"))


@query("url_guard", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/' WHEN 1 THEN upper(url) WHEN 2 THEN concat('https://f.example.org/?a=1&b=', page_id) END AS url FROM pages""")
def url_guard(spark, sf_dir):
    """Given with a slash more, in capitals, with what the page holds escaped, with two slashes, elsewhere, and nothing at all."""
    k = F.col("page_id") % 6
    n = F.col("page_id").cast("string")
    given = F.when(k == 0, F.concat("url", F.lit("/"))).when(k == 1, F.upper("url")).when(k == 2, F.concat(F.lit("https://f.example.org/?a=1&b="), n)).when(k == 3, F.concat("url", F.lit("//")))
    given = given.when(k == 4, "https://elsewhere.example.net/x").otherwise("/")
    page = F.concat("html", F.lit('<a href="https://F.example.org/?a=1&amp;b='), n, F.lit('">'))
    seen = F.when(k != 5, F.concat(F.lit("See "), "url", F.lit(" now")))
    return dealt(base(spark, sf_dir, "pages")).select("page_id", classify.url_guard(given, page, seen).alias("url"))


@query("ingest_gate", oracle(f"""
WITH {ACCESS}, {CLASSIFY}, j AS (SELECT a.*, {sql_deadline('a.text')} AS deadline, k.fits, k.fit_score FROM a JOIN k ON k.id = a.id)
SELECT id, CASE WHEN deadline < {NOW} - INTERVAL 1 DAY THEN 'closed' WHEN deadline IS NULL AND posted_at < {NOW} - INTERVAL 120 DAY THEN 'stale'
  WHEN NOT accessible AND split_part(source, ':', 1) NOT IN ('ethiongojobs', 'ehrdc', 'undp') THEN 'inaccessible' WHEN NOT fits OR fit_score < 50 THEN 'unfit' END AS drop_reason,
  CASE WHEN deadline < {NOW} THEN 'expired' ELSE 'active' END AS status FROM j""", "postings"))  # fmt: skip
def ingest_gate(spark, sf_dir):
    rows = _access(classify.classify(_postings(spark, sf_dir))).withColumn("deadline", text.find_deadline(F.col("text"))).withColumn("accessible", F.col("access.accessible"))
    return gates.ingest_gate(rows, AS_OF).select("id", "drop_reason", "status")


@query("filled_gaps", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'unfit' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'closed' END AS drop_reason,
  CASE WHEN o_orderkey % 5 = 0 THEN 'active' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 IN (0, 1) THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 <> 0 THEN false END AS is_paid FROM orders""")  # fmt: skip
def filled_gaps(spark, sf_dir):
    """What a closer reading finds: long past, half a day past or open, for those without a deadline; and the pay of a quarter."""
    k = F.col("o_orderkey")
    open_ = F.timestamp_add("DAY", F.lit(9), F.lit(AS_OF).cast("timestamp"))
    gated = base(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 1, open_).alias("deadline"), F.when(k % 4 != 0, False).alias("is_paid"), F.when(k % 5 == 0, "unfit").alias("drop_reason"), F.lit("active").alias("status"))
    hours = F.when(k % 3 == 0, -240).when(k % 3 == 1, -12).otherwise(240)
    gaps = base(spark, sf_dir, "orders").select(k.alias("id"), F.timestamp_add("HOUR", hours, F.lit(AS_OF).cast("timestamp")).alias("deadline"), F.lit(True).alias("is_paid"))
    return gates.fill_gaps(gated, gaps, AS_OF).select("id", "drop_reason", "status", "is_paid")


AGENT = "CASE user_id % 6 WHEN 0 THEN 'Mozilla/5.0 (iPhone)' WHEN 1 THEN 'Googlebot/2.1' WHEN 2 THEN '' WHEN 3 THEN 'curl/8.0' WHEN 4 THEN 'Mozilla/5.0 (X11; Linux)' END"


def _agents(spark, sf_dir):
    k = F.col("user_id") % 6
    agent = F.when(k == 0, "Mozilla/5.0 (iPhone)").when(k == 1, "Googlebot/2.1").when(k == 2, "").when(k == 3, "curl/8.0").when(k == 4, "Mozilla/5.0 (X11; Linux)")
    return base(spark, sf_dir, "events").withColumn("agent", agent)


@query("clamped", """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 60 THEN regexp_replace(t[1:59], '[ \\t\\n\\r\\f\\x0B]+$', '') || '…' ELSE t END AS line FROM d""")  # fmt: skip
def clamped(spark, sf_dir):
    return dealt(base(spark, sf_dir, "documents")).select("doc_id", text.clamp(F.coalesce("text", F.lit("")), 60).alias("line"))


@query("bot_filter", "WITH a AS (SELECT event_id, user_id FROM events) SELECT event_id FROM a WHERE user_id % 6 IN (0, 4)")
def bot_filter(spark, sf_dir):
    return _agents(spark, sf_dir).where(~gates.is_bot(F.col("agent"))).select("event_id")


@query("device_class", f"WITH a AS (SELECT event_id, {AGENT} AS agent FROM events) SELECT event_id, CASE WHEN {hits('agent', P.MOBILE_AGENT)} THEN 'mobile' ELSE 'desktop' END AS device FROM a")
def device_class(spark, sf_dir):
    return _agents(spark, sf_dir).select("event_id", gates.device_class(F.col("agent")).alias("device"))


@query("content_hash", """
SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256, sha256(concat_ws(':', CAST(doc_id % 30 AS VARCHAR), source, lang)) AS visitor_sha256 FROM documents""")
def content_hash(spark, sf_dir):
    visitor = F.sha2(F.concat_ws(":", (F.col("doc_id") % 30).cast("string"), "source", "lang"), 256)
    return dealt(base(spark, sf_dir, "documents")).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), visitor.alias("visitor_sha256"))


# Addresses.

KIND = "CASE " + " ".join(f"WHEN regexp_matches(url, {q(p)}) THEN {q(k)}" for k, p in urls.KINDS) + " END"
HOST = "nullif(regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '')"


@query("route_urls", oracle(f"SELECT id, {KIND} AS kind FROM postings"))
def route_urls(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", urls.kind_of(F.col("url")).alias("kind"))


@query("url_parts", oracle(f"""SELECT id, {HOST} AS host, array_to_string(string_split({HOST}, '.')[-2:], '.') AS site, nullif(regexp_extract(url, '[?&]a=([^&#]*)', 1), '') AS a FROM postings"""))
def url_parts(spark, sf_dir):
    u = F.col("url")
    return _postings(spark, sf_dir).select("id", urls.host(u).alias("host"), urls.site(u).alias("site"), urls.query_param(u, "a").alias("a"))


def sql_canonical(u: str) -> str:
    """The address u as a URL parser writes it without tracking and empty parameters."""
    params = f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^[^=]*=?$') AND NOT regexp_matches(lower(p), '^(utm_|(gh_src|source|ref|amp)(=|$))'))"
    path = f"regexp_extract({u}, '(?i)^(?:https?://[^/?#]*)?([^?#]*)', 1)"
    return f"""concat(lower(regexp_extract({u}, '(?i)^(https?://[^/?#]*)', 1)), CASE WHEN regexp_matches({u}, '(?i)^https?://') AND {path} = '' THEN '/' ELSE {path} END,
  CASE WHEN len({params}) > 0 THEN replace('?' || array_to_string({params}, '&'), '%20', '+') ELSE '' END, regexp_extract({u}, '(#.+)$', 1))"""


@query("canonical_urls", oracle(f"SELECT id, {sql_canonical('url')} AS url FROM postings"))
def canonical_urls(spark, sf_dir):
    return _postings(spark, sf_dir).select("id", urls.canonical(F.col("url")).alias("url"))
