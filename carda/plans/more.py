"""Further core queries: runs, requests, settings, lists and writes. Small tables no data set has are given here by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from carda.functions import codes, contact, times
from carda.operators import crawl, dedup, feed, kpi, ledger, parse, requests, settings
from carda.plans.registry import _BLANK, _FOLD, _OPEN, _RID, _TRIM, AS_OF, SITES, _as_of, _gate_sql, oracle_sql, query
from carda.session import fixed_rows, spread, table


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str, alias: str) -> str:
    """Constant rows as a table of SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) {alias}({names})"


# --- functions --------------------------------------------------------------------------------------------------

_PATH = "regexp_replace(source_url, '^[a-z]+://[^/]*', '')"


@query("safe_backs", f"SELECT id, CASE WHEN regexp_matches(p, '^/') AND NOT starts_with(p, '//') AND NOT contains(p, chr(92)) THEN p ELSE '/' END AS back FROM (SELECT id, {_PATH} AS p FROM jobs_clean)")
def safe_backs(spark, d):
    return table(spark, d, "jobs_clean").select("id", F.coalesce(contact.safe_back(F.regexp_replace("source_url", "^[a-z]+://[^/]*", "")), F.lit("/")).alias("back"))


@query("purge_days", "SELECT id, (collected_at::DATE + 90)::DATE AS purge_after FROM jobs_clean")
def purge_days(spark, d):
    return table(spark, d, "jobs_clean").select("id", times.purge_after(F.col("collected_at")).alias("purge_after"))


STATUS = {0: "expired", 1: "online", 2: "taken down", 3: "deleted"}


@query("status_labels", "SELECT id, CASE status WHEN 0 THEN 'expired' WHEN 1 THEN 'online' WHEN 2 THEN 'taken down' WHEN 3 THEN 'deleted' ELSE '?' END AS label FROM posts")
def status_labels(spark, d):
    return table(spark, d, "posts").select("id", codes.labels(F.col("status"), STATUS, "?").alias("label"))


@query("packed_addresses", "SELECT id, CASE WHEN octet_length(post_ip) IN (4, 16) THEN hex(post_ip) WHEN post_ip IS NULL THEN '00000000' ELSE '00000000' END AS packed FROM posts")
def packed_addresses(spark, d):
    return table(spark, d, "posts").select("id", F.hex(contact.ip_pack(F.coalesce(contact.ip_text(F.col("post_ip")), F.lit("")))).alias("packed"))


@query("forwarded_addresses", "SELECT user_id, event_id, 'h' || user_id AS seen_ip FROM events")
def forwarded_addresses(spark, d):
    e = table(spark, d, "events")
    header = F.concat(F.lit(" h"), F.col("user_id").cast("string"), F.lit(" , 10.0.0.1"))
    return e.select("user_id", "event_id", contact.forwarded_ip(header, F.lit("peer"), True).alias("seen_ip"))


@query("clamped_limits", "SELECT event_id, greatest(5, least(50, coalesce(json_extract_string(props, '$.k')::INT, 1)))::INT AS lim FROM events")
def clamped_limits(spark, d):
    return table(spark, d, "events").select("event_id", codes.clamp(F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(1)), 5, 50).alias("lim"))


# --- pages ------------------------------------------------------------------------------------------------------

_META = r"(?is)^(.*?<meta[^>]*charset=[\"'']?)[A-Za-z0-9_-]+"


@query("pages_as_utf8", f"SELECT id, md5(regexp_replace(raw_html, '{_META}', '\\1utf-8')) AS body_md5 FROM raw_pages WHERE raw_html IS NOT NULL")
def pages_as_utf8(spark, d):
    p = table(spark, d, "raw_pages").where("raw_html is not null")
    return p.select("id", F.md5(parse.to_utf8(F.encode("raw_html", "UTF-8"), "UTF-8")).alias("body_md5"))


@query("page_records")
def page_records(spark, d):
    configs = [parse.SiteConfig(c.site, {("desc" if k == "description" else k): v for k, v in c.fields.items()}, c.list_item, c.link, c.contact_mode, "listing") for c in SITES]
    return parse.page_records(spread(table(spark, d, "raw_pages").select("id", "source_site", "source_url", "raw_html")), configs)


@query("probe_links", f"SELECT page_id, count(*)::BIGINT AS links FROM ({oracle_sql()['page_links']}) GROUP BY page_id")
def probe_links(spark, d):
    x = parse.page_links(spread(table(spark, d, "raw_pages").select("id", "source_site", "source_url", "raw_html")), SITES, titles=True)
    return x.groupBy("page_id").agg(F.count("*").alias("links"))


_SITES = [(c.site, c.site != "xingzhan", c.contact_mode) for c in SITES]


@query("site_list", f"SELECT site, contact_mode FROM {_values(_SITES, 'site, enabled, contact_mode', 's')} WHERE enabled")
def site_list(spark, d):
    return settings.enabled_sites(fixed_rows(spark, _SITES, "site string, enabled boolean, contact_mode string")).select("site", "contact_mode")


@query("one_site", f"SELECT site, contact_mode FROM {_values(_SITES, 'site, enabled, contact_mode', 's')} WHERE site = 'lanhai'")
def one_site(spark, d):
    return settings.enabled_sites(fixed_rows(spark, _SITES, "site string, enabled boolean, contact_mode string"), "../lanhai;").select("site", "contact_mode")


# --- crawl runs -------------------------------------------------------------------------------------------------

_WALK = f"""WITH l AS (SELECT id, source_site || ':' || collected_at::DATE AS run, title, dedup_status, collected_at, {_FOLD.format(c='source_url')} AS k FROM jobs_clean),
    h AS (SELECT DISTINCT {_FOLD.format(c='source_url')} AS k FROM raw_pages WHERE source_url IS NOT NULL),
    a AS (SELECT l.*, row_number() OVER (PARTITION BY run ORDER BY collected_at, id) AS pos, CASE WHEN k IN (SELECT k FROM h) OR row_number() OVER (PARTITION BY run, k ORDER BY collected_at, id) > 1 THEN 'known' WHEN title = '!' THEN 'error' WHEN dedup_status IN ('dup_cross', 'exists_in_main') THEN 'dup' ELSE 'new' END AS outcome FROM l)"""
_RUN = (
    _WALK
    + """, b AS (SELECT *, sum((outcome <> 'known')::INT) OVER w AS island, sum((outcome = 'new')::INT) OVER w AS n, sum((outcome = 'new' AND coalesce(title = '', true))::INT) OVER w AS bare FROM a WINDOW w AS (PARTITION BY run ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, sum((outcome = 'known')::INT) OVER (PARTITION BY run, island ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_row FROM b),
    s AS (SELECT *, CASE WHEN outcome = 'known' AND in_row >= 2 THEN 'known' WHEN outcome <> 'known' AND n >= 3 AND bare / n > 0.1 THEN 'layout' END AS st FROM c),
    t AS (SELECT *, min(CASE WHEN st IS NOT NULL THEN pos END) OVER (PARTITION BY run) AS fin FROM s),
    u AS (SELECT id, run, pos::INT AS pos, outcome, CASE WHEN pos = fin THEN st END AS stop FROM t WHERE fin IS NULL OR pos <= fin)"""
)


def _links(spark, d):
    return table(spark, d, "jobs_clean").select("id", F.concat_ws(":", "source_site", F.col("collected_at").cast("date").cast("string")).alias("run"), "title", "dedup_status", "collected_at", "source_url")


def _crawled(spark, d):
    return crawl.crawl_run(_links(spark, d), table(spark, d, "raw_pages"), "run", ["collected_at", "id"], failed=F.coalesce(F.col("title") == "!", F.lit(False)), stop_after=2, min_new=3, alert_ratio=0.1)


@query("crawl_run", _RUN + " SELECT * FROM u")
def crawl_run(spark, d):
    return _crawled(spark, d).select("id", "run", "pos", "outcome", "stop")


_LEDGER = "SELECT run, count(*)::BIGINT AS seen, (count(*) FILTER (outcome = 'new'))::BIGINT AS new_jobs, (count(*) FILTER (outcome IN ('known', 'dup')))::BIGINT AS dup_jobs, (count(*) FILTER (outcome = 'error'))::BIGINT AS errors, {st} AS status FROM u GROUP BY run"


@query("crawl_ledger", _RUN + " " + _LEDGER.format(st="CASE WHEN bool_or(coalesce(stop = 'layout', false)) THEN 'failed' ELSE 'ok' END"))
def crawl_ledger(spark, d):
    return crawl.run_ledger(_crawled(spark, d), "run")


_SYNC = _WALK + ", b AS (SELECT *, sum((outcome = 'new')::INT) OVER (PARTITION BY run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM a), u AS (SELECT * FROM b WHERE n < 4 OR (n = 4 AND outcome = 'new'))"


def _synced(spark, d):
    return crawl.crawl_sync(_links(spark, d), table(spark, d, "raw_pages"), "run", ["collected_at", "id"], 4, failed=F.coalesce(F.col("title") == "!", F.lit(False)))


@query("sync_ledger", _SYNC + " " + _LEDGER.format(st="CASE WHEN count(*) FILTER (outcome = 'error') > 0 AND count(*) FILTER (outcome = 'new') = 0 THEN 'failed' ELSE 'ok' END"))
def sync_ledger(spark, d):
    return crawl.run_ledger(_synced(spark, d), "run", sync=True)


@query("sync_summary", _SYNC + " SELECT run, (count(*) FILTER (outcome = 'new'))::BIGINT AS new_jobs, (count(*) FILTER (outcome IN ('known', 'dup')))::BIGINT AS dup_jobs, coalesce(string_agg(CASE WHEN outcome = 'new' AND n <= 2 THEN coalesce(title, '') END, ' / ' ORDER BY pos), '') AS sample_titles FROM u GROUP BY run")
def sync_summary(spark, d):
    return crawl.sync_summary(_synced(spark, d), "run", samples=2)


_STARTED = "SELECT source_site || ':' || collected_at::DATE AS run, min(collected_at) AS started_at, 'running' AS status FROM jobs_clean GROUP BY 1"


def _open_runs(spark, d):
    x = _links(spark, d).groupBy("run").agg(F.min("collected_at").alias("started_at"))
    z = F.lit(0).cast("long")
    return x.select("run", "started_at", F.lit(None).cast("timestamp_ntz").alias("finished_at"), z.alias("new_jobs"), z.alias("dup_jobs"), z.alias("errors"), F.lit("running").alias("status"))


@query("finished_runs", _RUN + f", v AS ({_LEDGER.format(st='''CASE WHEN bool_or(coalesce(stop = 'layout', false)) THEN 'failed' ELSE 'ok' END''')}), s0 AS ({_STARTED}) SELECT s0.run, coalesce(v.status, s0.status) AS status, coalesce(v.new_jobs, 0)::BIGINT AS new_jobs, CASE WHEN v.run IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS finished_at FROM s0 LEFT JOIN v ON v.run = s0.run AND v.new_jobs > 0")
def finished_runs(spark, d):
    done = crawl.run_ledger(_crawled(spark, d), "run").where("new_jobs > 0")
    return crawl.finish_runs(_open_runs(spark, d), done, "run", _as_of()).select("run", "status", "new_jobs", "finished_at")


@query("runs_after_reset", _RUN + f", v AS ({_LEDGER.format(st="'ok'")}) SELECT run FROM v WHERE new_jobs > 0")
def runs_after_reset(spark, d):
    done = crawl.run_ledger(_crawled(spark, d), "run").where("new_jobs > 0")
    return crawl.reset_running(crawl.finish_runs(_open_runs(spark, d), done, "run", _as_of())).select("run")


@query("last_start", f"SELECT max(started_at) AS last_started FROM ({_STARTED})")
def last_start(spark, d):
    return crawl.last_start(_open_runs(spark, d))


# --- requests ---------------------------------------------------------------------------------------------------

_T = lambda c: _TRIM.format(c=f"coalesce({c}, '')")
_PH = "left(regexp_replace(coalesce(phone, ''), '[^0-9+]', '', 'g'), 20)"
_CC = r"(coalesce(regexp_matches(content, '\+?[0-9][0-9 ().-]{7,}') OR regexp_matches(content, '(?i)(微信|weixin|wechat|wx)[\s\x{A0}\x{3000}]*[:：]?[\s\x{A0}\x{3000}]*[A-Za-z0-9_-]{5,}'), false))"
_FIELDS = f"""WHEN {_T('content')} = '' OR length({_T('content')}) > 1000 THEN 'content' WHEN {_T('contact_name')} = '' OR length({_T('contact_name')}) > 50 THEN 'contact_name'
    WHEN NOT coalesce(regexp_full_match({_TRIM.format(c='phone')}, '\\+?[0-9 ().-]{{9,20}}') AND length({_PH.replace('phone', _TRIM.format(c='phone'))}) >= 9, false) THEN 'phone' WHEN length({_T('wechat')}) > 60 THEN 'wechat'
    WHEN region_id NOT IN (SELECT id FROM regions WHERE status = 1) OR region_id IS NULL THEN 'region' WHEN category_id NOT IN (SELECT id FROM categories WHERE status = 1) OR category_id IS NULL THEN 'category' WHEN {_CC} THEN 'contact_in_content'"""


@query(
    "publish_verdicts",
    f"""WITH a AS (SELECT *, {_PH} AS ph, sha256(lower(regexp_replace(content, '{_BLANK.format()}', '', 'g'))) AS hash, CASE WHEN post_ip IS NOT NULL THEN count(*) OVER (PARTITION BY post_ip ORDER BY created_at RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) ELSE 0 END AS lately FROM posts),
    b AS (SELECT *, last_value(CASE WHEN status IN (0, 1) THEN {{'id': id, 'at': created_at, 'kind': poster_type, 'owner': user_id}} END IGNORE NULLS) OVER (PARTITION BY ph, hash ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dup FROM a),
    c AS (SELECT *, coalesce(dup.at > created_at - INTERVAL 7 DAY, false) AND ph <> '' AS recent FROM b),
    v AS (SELECT id, dup, CASE {_FIELDS} WHEN lately >= 5 THEN 'rate' WHEN recent AND coalesce(dup.kind = 2 AND poster_type = 2 AND dup.owner = user_id, false) THEN 'bump' WHEN recent THEN 'duplicate' ELSE 'ok' END AS verdict FROM c)
    SELECT id, verdict, CASE WHEN verdict IN ('bump', 'duplicate') THEN dup.id END AS earlier_id FROM v""",
)
def publish_verdicts(spark, d):
    return requests.validate_posts(table(spark, d, "posts"), table(spark, d, "regions"), table(spark, d, "categories"))


@query(
    "edited_posts",
    f"""WITH e AS (SELECT id AS pid, user_id AS owner, upper(content) AS content, contact_name, phone, wechat, region_id, category_id FROM posts WHERE user_id IS NOT NULL), g AS (SELECT *, CASE {_FIELDS} END AS bad FROM e)
    SELECT p.id, md5(coalesce(CASE WHEN g.pid IS NOT NULL THEN g.content ELSE p.content END, '')) AS body, CASE WHEN g.pid IS NOT NULL THEN sha256(lower(regexp_replace(g.content, '{_BLANK.format()}', '', 'g'))) ELSE p.content_hash END AS content_hash, CASE WHEN g.pid IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE p.updated_at END AS updated_at
    FROM posts p LEFT JOIN g ON g.pid = p.id AND g.bad IS NULL""",
)
def edited_posts(spark, d):
    p = table(spark, d, "posts")
    e = p.where("user_id is not null").select(F.col("id").alias("post_id"), "user_id", F.upper("content").alias("content"), "contact_name", "phone", "wechat", "region_id", "category_id")
    out = requests.edit_posts(p, e, table(spark, d, "regions"), table(spark, d, "categories"), _as_of())
    return out.select("id", F.md5(F.coalesce("content", F.lit(""))).alias("body"), "content_hash", "updated_at")


_COUNTED = _gate_sql("event_type, user_id", "NULL::TIMESTAMP", f"CASE WHEN {_OPEN.format(n=7200)} THEN e.ts ELSE r.state END", _OPEN.format(n=7200), "event_type IN ('error', 'view')")


@query("report_flow", _COUNTED.replace(") SELECT event_id, accepted FROM r", "), k AS (SELECT event_id FROM r WHERE accepted)") + " SELECT event_id, coalesce(lag(ts) OVER w <= ts - INTERVAL 60 MINUTE, true) AS sends, (row_number() OVER w)::INT AS so_far FROM events JOIN k USING (event_id) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def report_flow(spark, d):
    return requests.report_flow(table(spark, d, "events").where("event_type in ('error', 'view')"), "event_type", "user_id", 7200)


# --- small tables of a site, by value ----------------------------------------------------------------------------

_REPORTS = [(1, 3, "spam", 0), (2, 3, "fake", 0), (3, 5, "old", 1), (4, 999_999_999, "spam", 0), (5, 7, None, 0)]
_REPORT_COLS, _REPORT_SCHEMA = "id, post_id, reason, status", "id int, post_id long, reason string, status int"
_MARKS = [(1, 3), (2, 3), (3, 8), (4, None)]
_SETTINGS = [("top_slot_limit", "7", 1), ("top_slot_limit", "9", 2), ("bump_window_days", "many", 1), ("site_name", "carda", 1), ("fields", '{"phone":"p1","extra":"x"}', 1)]


def _reports(spark):
    return fixed_rows(spark, _REPORTS, _REPORT_SCHEMA)


def _marks(spark):
    return fixed_rows(spark, _MARKS, "id int, post_id long")


@query("report_list", f"SELECT r.id, r.post_id, r.reason, p.public_code, (SELECT count(*) FROM {_values(_REPORTS, _REPORT_COLS, 'q')} WHERE q.post_id = r.post_id)::BIGINT AS of_post FROM {_values(_REPORTS, _REPORT_COLS, 'r')} JOIN posts p ON p.id = r.post_id")
def report_list(spark, d):
    return kpi.report_list(_reports(spark), table(spark, d, "posts")).select("id", "post_id", "reason", "public_code", "of_post")


_ACTIONS = [(1, "take_down", 1), (2, "handled", 1), (2, "ignored", 2), (3, "handled", 1), (5, "archive", 1)]
_ACT = f"(SELECT report_id, arg_max(action, ord) AS act FROM {_values(_ACTIONS, 'report_id, action, ord', 'a')} WHERE action IN ('handled', 'ignored', 'take_down') GROUP BY report_id)"


def _handled(spark, d):
    return requests.handle_reports(_reports(spark), fixed_rows(spark, _ACTIONS, "report_id int, action string, order int"), table(spark, d, "posts"))


@query("handled_reports", f"SELECT r.id, CASE WHEN r.status = 0 AND act = 'ignored' THEN 2 WHEN r.status = 0 AND act IS NOT NULL THEN 1 ELSE r.status END AS status FROM {_values(_REPORTS, _REPORT_COLS, 'r')} LEFT JOIN {_ACT} a ON a.report_id = r.id")
def handled_reports(spark, d):
    return _handled(spark, d)[0].select("id", "status")


@query("posts_after_reports", f"SELECT id, CASE WHEN id IN (SELECT r.post_id FROM {_values(_REPORTS, _REPORT_COLS, 'r')} JOIN {_ACT} a ON a.report_id = r.id WHERE r.status = 0 AND act = 'take_down') THEN 2 ELSE status END AS status FROM posts")
def posts_after_reports(spark, d):
    return _handled(spark, d)[1].select("id", "status")


@query("kpi_admin", f"SELECT count(*)::BIGINT AS posts, (count(*) FILTER (status = 1))::BIGINT AS online, (count(*) FILTER (created_at >= TIMESTAMP '2026-04-01'))::BIGINT AS new_posts, (count(*) FILTER (suspicious = 1))::BIGINT AS suspicious, (SELECT count(*) FROM {_values(_REPORTS, _REPORT_COLS, 'r')} WHERE status = 0)::BIGINT AS open_reports, (SELECT count(*) FROM {_values(_MARKS, 'id, post_id', 'm')})::BIGINT AS marks FROM posts")
def kpi_admin(spark, d):
    return kpi.kpi_admin(table(spark, d, "posts"), _reports(spark), _marks(spark), times.ntz("2026-04-01 00:00:00"))


@query("all_but_last_report", f"SELECT id FROM {_values(_REPORTS, _REPORT_COLS, 'r')} WHERE id <> (SELECT max(id) FROM {_values(_REPORTS, _REPORT_COLS, 'q')})")
def all_but_last_report(spark, d):
    return kpi.all_but_last(_reports(spark)).select("id")


@query("next_sort", "SELECT coalesce(max(sort), 0)::INT AS top_sort FROM categories WHERE sort < 999")
def next_sort(spark, d):
    return kpi.next_sort(table(spark, d, "categories"))


@query("pinned_posts", f"SELECT (count(*) FILTER (is_top = 1 AND top_expire_at > TIMESTAMP '{AS_OF}'))::BIGINT AS pinned FROM posts")
def pinned_posts(spark, d):
    return kpi.pinned(table(spark, d, "posts"), _as_of())


@query("marks_after_reset", f"SELECT id, post_id FROM {_values(_MARKS, 'id, post_id', 'm')} WHERE post_id IS NULL OR post_id <> 3")
def marks_after_reset(spark, d):
    return settings.reset_marks(table(spark, d, "posts"), _marks(spark), fixed_rows(spark, [(3,)], "id long"))[0]


@query("posts_after_mark_reset", "SELECT id, CASE WHEN id = 3 THEN 0 ELSE invalid_count END AS invalid_count FROM posts")
def posts_after_mark_reset(spark, d):
    return settings.reset_marks(table(spark, d, "posts"), _marks(spark), fixed_rows(spark, [(3,)], "id long"))[1].select("id", "invalid_count")


@query("settings_values", "SELECT 9 AS slots, 7 AS days, 'carda' AS name, 'none' AS other, '{\"extra\":\"x\",\"phone\":\"p1\",\"wechat\":\"w\"}' AS fields")
def settings_values(spark, d):
    m = F.col("settings")
    x = settings.settings_map(fixed_rows(spark, _SETTINGS, "skey string, svalue string, updated_at int"))
    merged = settings.field_map(settings.setting(m, "fields"), {"phone": "phone", "wechat": "w"})
    ordered = F.map_from_entries(F.array_sort(F.map_entries(merged)))
    return x.select(settings.setting_int(m, "top_slot_limit", 5).alias("slots"), settings.setting_int(m, "bump_window_days", 7).alias("days"), settings.setting(m, "site_name", "x").alias("name"), settings.setting(m, "motto", "none").alias("other"), F.to_json(ordered).alias("fields"))


_CHANGES = [("site_name", "new"), ("motto", "hi")]


@query("updated_settings", "SELECT * FROM (VALUES ('site_name', 'new'), ('motto', 'hi'), ('a', 'b')) t(skey, svalue)")
def updated_settings(spark, d):
    return settings.update_settings(fixed_rows(spark, [("site_name", "carda"), ("a", "b")], "skey string, svalue string"), fixed_rows(spark, _CHANGES, "skey string, svalue string"))


_BODIES = [(1, '{"code":"ab","ctype":"wechat"}'), (2, "code=a%20b&ctype=phone"), (3, ""), (4, None), (5, '{"code":')]


@query("request_bodies", "SELECT * FROM (VALUES (1, 'ab', 'wechat'), (2, 'a b', 'phone'), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, NULL)) t(id, code, ctype)")
def request_bodies(spark, d):
    x = fixed_rows(spark, _BODIES, "id int, raw string").withColumn("b", settings.request_body(F.col("raw")))
    get = lambda k: F.try_element_at("b", F.lit(k)).alias(k)
    return x.select("id", get("code"), get("ctype"))


@query("toggled_categories", "SELECT id, CASE WHEN id IN (2, 3) THEN 1 - status ELSE status END AS status FROM categories")
def toggled_categories(spark, d):
    return settings.toggle(table(spark, d, "categories"), fixed_rows(spark, [(2,), (3,), (3,)], "id int")).select("id", "status")


_USERS = [("a", "Ana", 1, 1), ("b", "Bo", 2, 0), ("c", "Cy", 3, 1)]
_LOGINS = [("a", "Ann", 5), ("a", "Anna", 7), ("b", "Bob", 8), ("d", "Di", 9)]


@query("signed_in", "SELECT * FROM (VALUES ('a', 'Anna', 7, 1, true), ('b', 'Bo', 2, 0, true), ('c', 'Cy', 3, 1, true), ('d', 'Di', 9, 1, false)) t(subject, display_name, last_login_at, status, known)")
def signed_in(spark, d):
    return settings.sign_in(fixed_rows(spark, _USERS, "subject string, display_name string, last_login_at int, status int"), fixed_rows(spark, _LOGINS, "subject string, display_name string, at int"))


@query("allowed_resolutions", "SELECT id, resolution FROM review_queue WHERE resolution IN ('keep', 'merge')")
def allowed_resolutions(spark, d):
    return settings.allowed(table(spark, d, "review_queue"), "resolution", fixed_rows(spark, [("keep", 1), ("merge", 1), ("discard", 0)], "name string, on int"), "on").select("id", "resolution")


# --- lists and writes -------------------------------------------------------------------------------------------

_ADMIN = f"status = 1 AND suspicious = 1 AND (coalesce({_FOLD.format(c='content')} LIKE '%a%', false) OR coalesce({_FOLD.format(c='contact_name')} LIKE '%a%', false) OR coalesce({_FOLD.format(c='phone')} LIKE '%a%', false))"


@query("admin_posts", f"SELECT id FROM posts WHERE {_ADMIN}")
def admin_posts(spark, d):
    return feed.admin_posts(table(spark, d, "posts"), status=1, suspicious=True, text="Á").select("id")


@query("shown_facets", "SELECT category_id, n FROM (SELECT c.id AS category_id, (SELECT count(*) FROM posts p WHERE p.category_id = c.id AND p.status = 1 AND p.type = 2 AND p.suspicious = 1)::BIGINT AS n FROM categories c) WHERE n > 0 OR category_id = 1")
def shown_facets(spark, d):
    p = table(spark, d, "posts").where("status = 1 and type = 2 and suspicious = 1").groupBy("category_id").agg(F.count("*").alias("n"))
    x = table(spark, d, "categories").select(F.col("id").alias("category_id")).join(p, "category_id", "left").select("category_id", F.coalesce("n", F.lit(0)).alias("n"))
    return feed.shown_facets(x, "category_id", selected=1)


@query("post_by_code", "SELECT p.id, p.public_code, r.name AS region_name, c.name AS category_name FROM posts p JOIN regions r ON r.id = p.region_id JOIN categories c ON c.id = p.category_id WHERE p.status IN (0, 1) AND p.public_code = (SELECT min(public_code) FROM posts WHERE status = 1)")
def post_by_code(spark, d):
    p = table(spark, d, "posts")
    first = p.where("status = 1").agg(F.min("public_code").alias("public_code"))
    return feed.post_by_code(p, first, table(spark, d, "regions"), table(spark, d, "categories")).select("id", "public_code", "region_name", "category_name")


@query("rejudge_scan", "SELECT id FROM jobs_clean WHERE dedup_status IN ('unique', 'review') AND imported_at IS NULL ORDER BY id LIMIT 5000")
def rejudge_scan(spark, d):
    return dedup.rejudge_scan(table(spark, d, "jobs_clean"), 5000).select("id")


@query("import_ready", "SELECT id FROM jobs_clean WHERE import_ready = 1 AND imported_at IS NULL ORDER BY id LIMIT 200")
def import_ready(spark, d):
    return ledger.import_ready(table(spark, d, "jobs_clean"), 200).select("id")


@query("inserted_jobs", "SELECT (SELECT max(id) FROM jobs_clean) + row_number() OVER (ORDER BY p.id) AS id, p.id AS page_id, source_url FROM raw_pages p WHERE http_status = 200")
def inserted_jobs(spark, d):
    new = table(spark, d, "raw_pages").where("http_status = 200").select(F.col("id").alias("page_id"), "source_url")
    return ledger.assign_ids(table(spark, d, "jobs_clean"), new, ["page_id"]).select("id", "page_id", "source_url")


def _imported(spark, d):
    t = lambda n: table(spark, d, n)
    return ledger.import_outputs(t("jobs_clean"), t("posts"), t("import_map"), t("regions"), t("categories"), _as_of(), "batch-1", 200)


_BATCH = "(SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT id FROM jobs_clean WHERE import_ready = 1 AND imported_at IS NULL ORDER BY id LIMIT 200))"


@query("import_posts", f"SELECT (SELECT max(id) FROM posts) + rn AS id, b.id AS crawler_job_id, coalesce({_RID.format(t='regions', c='district')}, {_RID.format(t='regions', c='city')}, 1)::INT AS region_id FROM {_BATCH} b JOIN jobs_clean j ON j.id = b.id")
def import_posts(spark, d):
    return _imported(spark, d)[0].select("id", "crawler_job_id", "region_id")


@query("import_entries", f"SELECT (SELECT max(id) FROM import_map) + rn AS id, b.id AS crawler_job_id, (SELECT max(id) FROM posts) + rn AS main_job_id, 'batch-1' AS import_batch, 0 AS purged FROM {_BATCH} b")
def import_entries(spark, d):
    return _imported(spark, d)[1].select("id", "crawler_job_id", "main_job_id", "import_batch", "purged")


@query("jobs_after_import", f"SELECT id, CASE WHEN id IN (SELECT id FROM {_BATCH}) THEN TIMESTAMP '{AS_OF}' ELSE imported_at END AS imported_at FROM jobs_clean")
def jobs_after_import(spark, d):
    return _imported(spark, d)[2].select("id", "imported_at")


@query("sorted_dimensions", "SELECT id, (row_number() OVER (ORDER BY level, sort, id))::INT AS place FROM regions")
def sorted_dimensions(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "regions").select("id", F.row_number().over(Window.orderBy("level", "sort", "id")).alias("place"))  # a fixed list of 74
