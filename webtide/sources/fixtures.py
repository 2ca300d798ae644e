"""Derived input views over the driver tables.

Each view is one SQL text run by Spark (``spark.sql(text, pages=df, ...)``,
so no global temp view is touched) and by DuckDB for the oracle (as a CTE).
Where the dialects differ the view has a Spark and a DuckDB spelling.
Every view reads whole tables; its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pages_table, table

# fetch attempt log over `events` (shared text; checked equal in both engines)
FETCH_LOG = """
select user_id*1000000000 + cast(floor(rn/3) as bigint) as req_id,
       cast(rn%3 as int) as attempt, ts, event_id,
       case when event_id%2=0 then 'http' else 'playwright' end as engine,
       case event_type
         when 'error' then (case event_id%4 when 0 then 503 when 1 then 429 when 2 then 403 else 0 end)
         when 'signup' then 404 else 200 end as status,
       case when event_type='error' and event_id%4=3 then
         (case event_id%5 when 0 then 'Timeout' when 1 then 'net::ERR_CONNECTION_REFUSED'
           when 2 then 'SSRF blocked' when 3 then 'Too many redirects'
           else 'Something went wrong' end) end as err_msg,
       case event_id%6 when 0 then 'text/html; charset=utf-8' when 1 then 'application/rss+xml'
         when 2 then 'IMAGE/PNG' when 3 then 'application/json' when 4 then 'application/pdf' end as content_type,
       case event_id%5 when 0 then '2' when 1 then '999999' when 2 then '0' end as retry_after,
       cast(floor(value*1000) as bigint) as dur_ms
from (select e.*, row_number() over (partition by user_id order by ts, event_id)-1 as rn
      from {events} e) x
"""

# redirect edges between pages (chains of up to 9 hops)
HOP = """
select p.page_id as src, p.page_id+1 as dst, p.url as src_url, q.url as location
from {pages} p join {pages} q on q.page_id = p.page_id + 1
where p.page_id%10 <> 9
"""

# IPv4 literal hosts from `customer`, hitting every blocked range and near misses
HOSTS = """
select c_custkey,
  cast(case c_custkey%8 when 0 then 10 when 1 then 172 when 2 then 192 when 3 then 127
       when 4 then 169 when 5 then 0 when 6 then 8 else 203 end as string) || '.' ||
  cast(case c_custkey%8 when 1 then 16+c_custkey%32 when 2 then 167+c_custkey%3
       when 4 then 253+c_custkey%3 else c_custkey%256 end as string) || '.' ||
  cast(c_custkey%256 as string) || '.' || cast(c_custkey%256 as string) as host
from {customer}
"""

# [ours] URLs of every shape the URL gates distinguish
PROBE_URLS = """
select c_custkey as url_id,
  case c_custkey%37
    when 1 then 'http://127.0.0.1./'
    when 2 then 'http://0177.0.0.1/'
    when 3 then 'http://012.0.0.1/x'
    when 4 then 'http://127%2e0.0.1/'
    when 5 then 'http://[::0001]/'
    when 6 then 'http://256.1.1.1/'
    when 7 then 'http://2130706433/'
    when 8 then 'http://127\u3002\u0030\uff0e0.1/'
    when 9 then 'https://ex.com:99999/'
    when 10 then 'http://\uff11\uff10.1.2/x'
    when 13 then 'HTTP://EX.com:80/a/./b/../c?d#e'
    when 14 then 'http://0x7f000001/'
    when 15 then 'http://1.2.3.4.5/'
    when 16 then 'http://0300.168.1/'
    when 17 then 'http://ex%41mple.com/'
    when 18 then 'http://ex%zzmple.com:0/'
    when 19 then 'http://host.99/'
    else case c_custkey%12
    when 0 then 'http://' || host || '/a?x=1#f'
    when 1 then 'https://' || host || ':8443/p'
    when 2 then 'ftp://files' || cast(c_custkey%7 as string) || '.example.com/x'
    when 3 then 'not-a-url'
    when 4 then 'http://[::1]/'
    when 5 then 'http://[fe80::' || cast(c_custkey%97 as string) || ']/x'
    when 6 then 'https://[fd00::1]:8080/q?y'
    when 7 then 'HTTP://Mixed' || cast(c_custkey%13 as string) || '.Example.COM/Path'
    when 8 then 'http://a_b.example.com/p|q'
    when 9 then 'http://0x7f.1/'
    when 10 then 'https://[2001:db8::' || cast(c_custkey%50 as string) || ']/'
    else 'https://user:pw@www' || cast(c_custkey%5 as string) || '.example.org/'
  end end as url
from ({hosts}) h
"""

# [ours] resolved addresses for hostnames: h0..h49 resolve (several
# addresses each); h50..h59 appear only in the URL list (no address)
RESOLVED = """
select 'h' || cast(c_custkey%50 as string) || '.example.com' as host, host as address
from ({hosts}) h
"""
NAMED_URLS = """
select c_custkey as url_id,
       'http://h' || cast(c_custkey%60 as string) || '.example.com/p' || cast(c_custkey as string) as url
from {customer}
"""

# [ours] pages with the tags that the corpus lacks, in both quote styles and
# attribute orders, unquoted values, references and a nested article
# (~ stands for a single quote)
RICH_PAGES = """
select page_id, url, replace(replace(html, '<meta charset="utf-8">', '<meta charset="utf-8">' || replace(
  case page_id%6
    when 0 then '<meta property="og:title" content="Caf&eacute; &amp; more"><meta name="description" content="Tom &#8217;s &#x27;x&#x27;"><meta name="author" content="A. Writer">'
    when 1 then '<meta content=~Said &ldquo;so&rdquo;~ name=~twitter:title~><meta content=~short~ property=~og:description~><meta property=~og:image~ content=~/img/a.png~>'
    when 2 then '<meta name=author content=Writer><meta property="article:published_time" content="2024-05-06T07:08:09Z"><link rel=~icon~ href=~/fav.ico~>'
    when 3 then '<link href="https://cdn.example.com/i.png" rel="shortcut icon"><meta property="og:type" content="article"><meta property=~og:site_name~ content=~The &Uuml;bersicht~>'
    when 4 then '<meta name="date" content=""><meta name=~pubdate~ content=~2020~><meta content="website" property="og:type"><link rel=icon href=fav.png>'
    else '' end, '~', chr(39))),
  '<article>', '<article>' || replace(
  case page_id%5
    when 0 then '<p><img src=~/a.png~ alt=~A~> see <a href=/rel/x>rel</a> or <a class=~k~ href=~https://ex.org/y?z=1~>abs &rsquo;</a></p><hr><p>so <mark>bright</mark></p>'
    when 1 then '<time datetime=~2021-02-03~>then</time><p>&#169; &Eacute;t&eacute; &#8364; &bogus; &amp;lt; <a href="../up">up</a></p>'
    when 2 then '<article><p>inner text</p></article><p>after the inner article</p>'
    when 3 then '<img alt="B" src="b.jpg"><hr>'
    else '' end, '~', chr(39))) as html
from {pages}
"""

# [ours] page requests with missing / odd values
PAGE_REQUESTS = """
select page_id as req_id,
  case when page_id%23=7 then null when page_id%19=5 then 'not-a-url' else url end as url,
  case page_id%7 when 0 then 'playwright' when 1 then null when 2 then 'bogus' when 3 then ''
       else 'extractor' end as mode,
  case page_id%11 when 0 then 0 when 1 then null else 30 + page_id%5 end as task_timeout_secs,
  case page_id%5 when 0 then true when 1 then null else false end as raw_body,
  case page_id%4 when 0 then ' tracker.example.com, ,ads.example.net ' when 1 then '' end as block_list
from {pages}
"""

# [ours] page requests with what came back for them, for the gate pipeline:
# every gate has rows that it is the first to stop
GATED_REQUESTS = """
select page_id as req_id,
  case when page_id%29=7 then null when page_id%31=5 then 'not-a-url' when page_id%37=3 then 'ftp://ex.org/x'
       when page_id%41=2 then 'http://10.0.0.' || cast(page_id%250 as string) || '/' when page_id%43=4 then 'http://[::1]/' else url end as url,
  case page_id%17 when 0 then 'bogus' when 1 then 'playwright' else 'extractor' end as mode,
  case page_id%19 when 0 then 0 else 60 end as task_timeout_secs,
  '{{"url": "u", "mode": "m"' || case page_id%23 when 0 then ', "proxy": true' else '' end || '}}' as payload,
  case when page_id%2=0 then 'http' else 'playwright' end as engine,
  case page_id%9 when 0 then 404 when 1 then 301 when 2 then 302 when 3 then 503 when 4 then 304 when 5 then 429 when 6 then null else 200 end as status,
  case when page_id%9 in (1, 4) then '/next/' || cast(page_id as string) end as location,
  case page_id%6 when 0 then 'text/html; charset=utf-8' when 1 then 'image/png' when 2 then null
       when 3 then '' when 4 then 'application/octet-stream' else 'text/plain' end as content_type,
  case page_id%8 when 2 then '999999999' else '10' end as declared_length,
  case page_id%13 when 0 then '' when 1 then null else html end as html
from {pages}
"""
# [ours] addresses of the pages' hosts: some private, some hosts without any
PAGE_ADDRESSES = """
select regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) as host,
  case when page_id%47=0 then '192.168.1.1' when page_id%53=0 then 'fe80::1' else '93.184.' || cast(page_id%256 as string) || '.34' end as address
from {pages} where page_id%11 <> 3
"""

# [ours] fetch requests: the first attempt of every request in the log
FETCH_REQUESTS = """
select req_id,
  'https://h' || cast(event_id%50 as string) || '.example.com/p/' || cast(event_id as string) as url,
  case event_id%7 when 0 then 'nope' when 1 then null else engine end as engine,
  case event_id%9 when 0 then 0 when 1 then null else 60 end as timeout_secs,
  case event_id%4 when 0 then true when 1 then null else false end as debug
from ({fetch_log}) f
where attempt = 0
"""

# [ours] HTTP responses to pages: status, location, type, declared length
RESPONSES = """
select page_id, url, engine, status, location, content_type, declared_length, html
from (select page_id, url, html,
  case when page_id%2=0 then 'http' else 'playwright' end as engine,
  case page_id%9 when 0 then 404 when 1 then 301 when 2 then 302 when 3 then 503 when 4 then 304
       when 5 then 429 else 200 end as status,
  case when page_id%9 in (1, 4) then '/next/' || cast(page_id as string) end as location,
  case page_id%6 when 0 then 'text/html; charset=utf-8' when 1 then 'image/png' when 2 then null
       when 3 then '' when 4 then ' Application/XHTML+XML ' else 'application/octet-stream' end as content_type,
  case page_id%4 when 0 then null when 1 then 'abc' when 2 then '999999999' else '10' end as declared_length
from {pages}) r
"""

# [ours] access log rows over events
ACCESS_RAW = """
select event_id, ts,
  case event_type when 'view' then '/page?u=' || cast(user_id as string)
       when 'click' then '/fetch' when 'error' then '/file?x=1&y=2' else '/health' end as url,
  case event_type when 'error' then (case event_id%3 when 0 then 502 when 1 then 404 else 500 end)
       when 'signup' then 400 else 200 end as status,
  case when event_id%5=0 then 'Bearer t' || cast(event_id as string) end as auth_header,
  case when event_id%3=0 then 'k' || cast(user_id as string) end as api_key_header,
  'agent/' || cast(event_id%4 as string) as ua_header
from {events}
"""

# 512-character slices of each page's html (index generation differs)
CHUNKS_SPARK = """
select page_id as object_id, i as seq, substr(html, i*512+1, 512) as chunk
from (select page_id, html,
             explode(sequence(0, cast(ceil(length(html)/512.0) as int)-1)) as i
      from {pages} where length(html) > 0) x
"""
CHUNKS_DUCK = """
select page_id as object_id, i as seq, substr(html, i*512+1, 512) as chunk
from (select page_id, html,
             unnest(range(0, cast(ceil(length(html)/512.0) as int))) as i
      from pages where length(html) > 0) x
"""

# [ours] file requests with header maps (Spark spelling; DuckDB below)
FILE_REQUESTS_SPARK = """
select c_custkey as req_id,
  'https://' || host || '/f' as url,
  case c_custkey%5 when 0 then 'auto' when 1 then 'http' when 2 then 'playwright'
       when 3 then 'bogus' end as mode,
  case c_custkey%7 when 0 then 0 when 1 then null else 1000 + c_custkey end as max_bytes,
  case when c_custkey%97 = 0 then
         map_from_arrays(transform(sequence(1, 51), i -> 'X-H' || cast(i as string)),
                         transform(sequence(1, 51), i -> 'v'))
       else map_from_arrays(
         transform(filter(sequence(0, 5), k -> k between 1 and c_custkey%6),
                   i -> element_at(array('Accept', 'Connection', 'Cookie', 'Host', 'content-length',
                                         'Authorization', 'Proxy-Authorization', 'X-Trace',
                                         'Keep-Alive', 'X-Long-Value', 'Accept-Language'),
                                   cast((c_custkey + i) % 11 + 1 as int))),
         transform(filter(sequence(0, 5), k -> k between 1 and c_custkey%6),
                   i -> case when (c_custkey + i) % 11 = 9 then repeat('x', 2001)
                             else 'v' || cast(i as string) end))
  end as headers
from ({hosts}) h
"""
FILE_REQUESTS_DUCK = """
select c_custkey as req_id,
  'https://' || host || '/f' as url,
  case c_custkey%5 when 0 then 'auto' when 1 then 'http' when 2 then 'playwright'
       when 3 then 'bogus' end as mode,
  case c_custkey%7 when 0 then 0 when 1 then null else 1000 + c_custkey end as max_bytes,
  case when c_custkey%97 = 0 then
         map_from_entries(list_transform(range(1, 52), lambda i: {{'key': 'X-H' || cast(i as varchar), 'value': 'v'}}))
       else map_from_entries(list_transform(range(1, cast(c_custkey%6 as int) + 1),
         lambda i: {{'key': ['Accept', 'Connection', 'Cookie', 'Host', 'content-length',
                   'Authorization', 'Proxy-Authorization', 'X-Trace',
                   'Keep-Alive', 'X-Long-Value', 'Accept-Language'][cast((c_custkey + i) % 11 + 1 as int)],
                   'value': case when (c_custkey + i) % 11 = 9 then repeat('x', 2001)
                                 else 'v' || cast(i as varchar) end}}))
  end as headers
from hosts h
"""

# [ours] response header maps over pages (drop list check)
RESPONSE_HEADERS_SPARK = """
select page_id,
  map_from_arrays(
    array('Content-Type', 'Content-Encoding', 'Set-Cookie', 'Connection', 'X-Page',
          'Transfer-Encoding', 'ETag'),
    array('text/html', case when page_id%2=0 then 'gzip' else 'br' end, 'sid=' || cast(page_id as string),
          'keep-alive', cast(page_id as string), 'chunked', 'W/"' || cast(page_id%13 as string) || '"')) as headers
from {pages}
where page_id%3 <> 0
union all
select page_id, map_from_arrays(array('SET-COOKIE', 'Vary'), array('a=1', 'Accept')) as headers
from {pages}
where page_id%3 = 0
"""

BASE_TABLES = ["pages", "events", "customer"]


def duck_ctes(*names: str) -> str:
    """``with`` clause defining the named derived views for DuckDB."""
    defs = {
        "fetch_log": FETCH_LOG.format(events="events"),
        "hop": HOP.format(pages="pages"),
        "hosts": HOSTS.format(customer="customer"),
        "probe_urls": PROBE_URLS.format(hosts="select * from hosts"),
        "resolved": RESOLVED.format(hosts="select * from hosts"),
        "named_urls": NAMED_URLS.format(customer="customer"),
        "rich_pages": RICH_PAGES.format(pages="pages"),
        "page_requests": PAGE_REQUESTS.format(pages="pages"),
        "fetch_requests": FETCH_REQUESTS.format(fetch_log="select * from fetch_log"),
        "gated_requests": GATED_REQUESTS.format(pages="pages"),
        "page_addresses": PAGE_ADDRESSES.format(pages="pages"),
        "responses": RESPONSES.format(pages="pages"),
        "access_raw": ACCESS_RAW.format(events="events"),
        "chunks": CHUNKS_DUCK,
        "file_requests": FILE_REQUESTS_DUCK.format(),
    }
    deps = {
        "probe_urls": ["hosts"],
        "resolved": ["hosts"],
        "fetch_requests": ["fetch_log"],
        "file_requests": ["hosts"],
    }
    order: list[str] = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({defs[n]})" for n in order) + "\n"


class Fixtures:
    """Spark DataFrames of the derived views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from ..session import utc

        utc(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _sql(self, text: str, **kw) -> DataFrame:
        return self.spark.sql(text, **kw)

    def fetch_log(self) -> DataFrame:
        """Same rows as FETCH_LOG; a user's events are numbered day by day, so
        a hot user is split over several tasks."""
        from ..plans.sequence import row_number_by_key

        ev = self.t("events").selectExpr(
            "event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value"
        )
        numbered = row_number_by_key(ev, "user_id", ["ts", "event_id"], F.to_date("ts"), out="rn1")
        body = FETCH_LOG[: FETCH_LOG.index("from (select e.*")]
        return self._sql(body + " from (select e.*, rn1 - 1 as rn from {events} e) x", events=numbered)

    def hop(self) -> DataFrame:
        p = self.t("pages").select("page_id", "url")
        return self._sql(HOP, pages=p)

    def hosts(self) -> DataFrame:
        return self._sql(HOSTS, customer=self.t("customer").select("c_custkey"))

    def probe_urls(self) -> DataFrame:
        return self._sql(PROBE_URLS.replace("({hosts})", "{hosts}"), hosts=self.hosts())

    def resolved(self) -> DataFrame:
        return self._sql(RESOLVED.replace("({hosts})", "{hosts}"), hosts=self.hosts())

    def named_urls(self) -> DataFrame:
        return self._sql(NAMED_URLS, customer=self.t("customer").select("c_custkey"))

    def rich_pages(self) -> DataFrame:
        return self._sql(RICH_PAGES, pages=pages_table(self.spark, self.sf_dir))

    def page_requests(self) -> DataFrame:
        return self._sql(PAGE_REQUESTS, pages=self.t("pages").select("page_id", "url"))

    def fetch_requests(self) -> DataFrame:
        return self._sql(FETCH_REQUESTS.replace("({fetch_log})", "{fetch_log}"), fetch_log=self.fetch_log())

    def page_addresses(self) -> DataFrame:
        return self._sql(PAGE_ADDRESSES, pages=self.t("pages").select("page_id", "url"))

    def responses(self) -> DataFrame:
        return self._sql(RESPONSES, pages=self.t("pages"))

    def access_raw(self) -> DataFrame:
        ev = self.t("events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type")
        return self._sql(ACCESS_RAW, events=ev)

    def chunks(self) -> DataFrame:
        return self._sql(CHUNKS_SPARK, pages=self.t("pages"))

    def file_requests(self) -> DataFrame:
        return self._sql(FILE_REQUESTS_SPARK.replace("({hosts})", "{hosts}"), hosts=self.hosts())

    def response_headers(self) -> DataFrame:
        return self._sql(RESPONSE_HEADERS_SPARK, pages=self.t("pages").select("page_id"))
