"""All core queries and the SQL each is checked against. Both sides alias every column alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carda.functions import codes, contact, text, times
from carda.operators import dedup, feed, gates, hamming, kpi, ledger, parse
from carda.session import spread, table

#: The moment the queries take for now; nothing reads a clock.
AS_OF = "2026-04-20 12:00:00"
TODAY = "2026-06-15"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _as_of():
    return times.ntz(AS_OF)


#: Pieces of SQL several queries share.
TRIM_CHARS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"
_FOLD = "strip_accents(lower({c}))"
_MADRID = "(({c} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid')"
_MIDNIGHT = f"((date_trunc('day', ((TIMESTAMP '{AS_OF}' AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid')) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC')"
_WIDE_SQL = f"'{text._WIDE}'"
_NARROW_SQL = f"'{text._NARROW}'"
_NORM = f"regexp_replace(lower(translate({{c}}, {_WIDE_SQL}, {_NARROW_SQL})), '[^\\p{{{{Han}}}}\\p{{{{L}}}}\\p{{{{N}}}}]+', '', 'g')"
_BLANK = r"[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+"


# --- scalar functions -------------------------------------------------------------------------------------------


@query("text_normalize", f"SELECT id, {_NORM.format(c='title')} AS norm FROM jobs_clean WHERE title IS NOT NULL")
def text_normalize(spark, d):
    return table(spark, d, "jobs_clean").where("title is not null").select("id", text.text_normalize(F.col("title")).alias("norm"))


@query(
    "bigram_tf",
    f"""WITH t AS (SELECT id, {_NORM.format(c='title')} AS s FROM jobs_clean WHERE title IS NOT NULL),
    g AS (SELECT id, unnest(CASE WHEN length(s) = 0 THEN []::VARCHAR[] WHEN length(s) = 1 THEN [s] ELSE [substring(s, i, 2) FOR i IN range(1, length(s))] END) AS gram FROM t)
    SELECT id, gram, count(*)::BIGINT AS tf FROM g GROUP BY ALL""",
)
def bigram_tf(spark, d):
    t = table(spark, d, "jobs_clean").where("title is not null").select("id", text.bigrams(text.text_normalize(F.col("title"))).alias("g"))
    return t.select("id", F.explode("g").alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def _simhash_sql(source: str, expr: str, key: str = "id", extra: str = "") -> str:
    """SQL of the fingerprint of ``expr`` over the rows of ``source``."""
    return f"""WITH t AS (SELECT {key}{extra}, {_NORM.format(c=expr)} AS s FROM {source}),
    g AS (SELECT {key}, unnest(CASE WHEN length(s) = 0 THEN []::VARCHAR[] WHEN length(s) = 1 THEN [s] ELSE [substring(s, i, 2) FOR i IN range(1, length(s))] END) AS gram FROM t),
    c AS (SELECT {key}, ('0x' || substr(md5(gram), 1, 16))::UBIGINT AS h, count(*) AS tf FROM g GROUP BY {key}, gram),
    b AS (SELECT {key}, {", ".join(f"(CASE WHEN sum(CASE WHEN (h >> {k}) & 1 = 1 THEN tf ELSE -tf END) > 0 THEN 1 ELSE 0 END)::UBIGINT << {k} AS b{k}" for k in range(63))}, sum(CASE WHEN (h >> 63) & 1 = 1 THEN tf ELSE -tf END) > 0 AS top FROM c GROUP BY {key})
    SELECT t.{key}{extra}, coalesce(({" + ".join(f"b{k}::HUGEINT" for k in range(63))}) - (CASE WHEN top THEN 9223372036854775808::HUGEINT ELSE 0 END), 0)::BIGINT AS simhash FROM t LEFT JOIN b USING ({key})"""


_SIMHASH_SQL = _simhash_sql("jobs_clean", "trim(coalesce(title, '') || ' ' || coalesce(company, ''))")


@query("simhash64", _SIMHASH_SQL)
def simhash64(spark, d):
    e = F.lit("")
    return table(spark, d, "jobs_clean").select("id", text.simhash64(F.trim(F.concat_ws(" ", F.coalesce("title", e), F.coalesce("company", e)))).alias("simhash"))


@query("simhash_job", _simhash_sql("jobs_clean", _TRIM.format(c="(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(description, ''))")))
def simhash_job(spark, d):
    return spread(table(spark, d, "jobs_clean").select("id", "title", "company", "description")).select("id", text.simhash_job(F.col("title"), F.col("company"), F.col("description")).alias("simhash"))


@query("simhash_forms", "SELECT id, printf('%016X', simhash) AS simhash_hex, (CASE WHEN simhash < 0 THEN simhash::HUGEINT + 18446744073709551616 ELSE simhash END)::VARCHAR AS simhash_u64, bit_count(simhash)::INT AS bits FROM jobs_clean WHERE simhash IS NOT NULL")
def simhash_forms(spark, d):
    s = F.col("simhash")
    return table(spark, d, "jobs_clean").where("simhash is not null").select("id", text.simhash_hex(s).alias("simhash_hex"), text.simhash_to_u64(s).cast("string").alias("simhash_u64"), F.bit_count(s).cast("int").alias("bits"))


@query("content_hash", f"SELECT id, sha256(lower(regexp_replace(content, '{_BLANK.format()}', '', 'g'))) AS content_hash FROM posts WHERE content IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "posts").where("content is not null").select("id", text.content_hash(F.col("content")).alias("content_hash"))


@query(
    "phone_keys",
    f"""WITH t AS (SELECT id, contact_phone, contact_wechat, regexp_replace({_TRIM.format(c='contact_phone')}, '[^0-9]', '', 'g') AS d0 FROM jobs_clean),
    u AS (SELECT *, CASE WHEN starts_with(d0, '0034') THEN substring(d0, 5) WHEN starts_with(d0, '34') AND length(d0) = 11 THEN substring(d0, 3) ELSE d0 END AS d FROM t),
    v AS (SELECT *, nullif(CASE WHEN length(d) < 9 THEN d ELSE right(d, 9) END, '') AS phone9, nullif(regexp_replace(lower({_TRIM.format(c='contact_wechat')}), '{_BLANK.format()}', '', 'g'), '') AS wechat_norm FROM u)
    SELECT id, phone9, left(regexp_replace(coalesce(contact_phone, ''), '[^0-9+]', '', 'g'), 20) AS phone_main, wechat_norm,
    CASE WHEN phone9 IS NOT NULL OR wechat_norm IS NOT NULL THEN coalesce(phone9, '') || '|' || coalesce(wechat_norm, '') END AS contact_key,
    (CASE WHEN regexp_replace(coalesce(contact_phone, ''), '[^0-9]', '', 'g') = '' THEN '···' ELSE left(regexp_replace(coalesce(contact_phone, ''), '[^0-9]', '', 'g'), 3) END) || ' ·· ··' AS masked,
    coalesce(regexp_matches(contact_phone, '^\\+?[0-9 ().-]{{9,20}}$') AND length(left(regexp_replace(coalesce(contact_phone, ''), '[^0-9+]', '', 'g'), 20)) >= 9, false) AS valid FROM v""",
)
def phone_keys(spark, d):
    p, w = F.col("contact_phone"), F.col("contact_wechat")
    return table(spark, d, "jobs_clean").select(
        "id",
        contact.phone9(p).alias("phone9"),
        contact.phone_main(p).alias("phone_main"),
        contact.wechat_norm(w).alias("wechat_norm"),
        contact.contact_key(contact.phone9(p), contact.wechat_norm(w)).alias("contact_key"),
        contact.phone_mask(p).alias("masked"),
        F.coalesce(contact.valid_phone(p), F.lit(False)).alias("valid"),
    )


@query("contact_in_content", r"SELECT id, regexp_matches(content, '\+?[0-9][0-9 ().-]{7,}') OR regexp_matches(content, '(?i)(微信|weixin|wechat|wx)[\s\x{A0}\x{3000}]*[:：]?[\s\x{A0}\x{3000}]*[A-Za-z0-9_-]{5,}') AS has_contact FROM posts WHERE content IS NOT NULL")
def contact_in_content(spark, d):
    return table(spark, d, "posts").where("content is not null").select("id", contact.contact_in_content(F.col("content")).alias("has_contact"))


_CONTENT_SQL = f"""left(CASE WHEN body = '' THEN '（无正文）' ELSE body END, 1000)"""
_BODY_SQL = "trim(concat_ws(chr(10), CASE WHEN title IS NOT NULL AND title NOT IN ('', '0') THEN " + _TRIM.format(c="title") + " END, CASE WHEN company IS NOT NULL AND company NOT IN ('', '0') THEN '【' || " + _TRIM.format(c="company") + " || '】' END, CASE WHEN salary_raw IS NOT NULL AND salary_raw NOT IN ('', '0') THEN '薪资：' || " + _TRIM.format(c="salary_raw") + " END, CASE WHEN description IS NOT NULL AND description NOT IN ('', '0') THEN " + _TRIM.format(c="description") + " END), " + TRIM_CHARS + ")"


@query("build_content", f"SELECT id, {_CONTENT_SQL} AS content FROM (SELECT id, {_BODY_SQL} AS body FROM jobs_clean)")
def build_content(spark, d):
    c = F.col
    return table(spark, d, "jobs_clean").select("id", text.build_content(c("title"), c("company"), c("salary_raw"), c("description")).alias("content"))


@query(
    "post_excerpts",
    f"""WITH t AS (SELECT id, {_TRIM.format(c="regexp_extract(content, '^\\n*([^\\n]*)', 1)")} AS line, content FROM posts WHERE content IS NOT NULL)
    SELECT id, CASE WHEN length(line) > 40 THEN left(line, 40) || '…' ELSE line END AS excerpt, len([x FOR x IN string_split_regex(content, '\\n+') IF {_TRIM.format(c='x')} <> ''])::INT AS n_paragraphs FROM t""",
)
def post_excerpts(spark, d):
    c = F.col("content")
    return table(spark, d, "posts").where("content is not null").select("id", text.excerpt(c, 40).alias("excerpt"), F.size(text.paragraphs(c)).alias("n_paragraphs"))


_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') // 1000000 - epoch_us({{c}}) // 1000000)"


@query(
    "time_labels",
    f"""WITH t AS (SELECT id, created_at, top_expire_at, is_top, {_AGE.format(c='created_at')} AS a, date_diff('day', {_MADRID.format(c='created_at')}::DATE, {_MADRID.format(c=f"TIMESTAMP '{AS_OF}'")}::DATE) AS dd FROM posts)
    SELECT id, {_MADRID.format(c='created_at')} AS madrid, CASE WHEN a < 60 THEN '刚刚' WHEN a < 3600 THEN (a // 60)::VARCHAR || '分钟前' WHEN a < 86400 THEN (a // 3600)::VARCHAR || '小时前' WHEN a < 172800 THEN '昨天' ELSE (a // 86400)::VARCHAR || '天前' END AS ago,
    CASE WHEN dd = 0 THEN 'today' WHEN dd = 1 THEN 'yesterday' ELSE 'earlier' END AS bucket, greatest(0, 30 - floor(a / 86400.0))::INT AS left_days,
    CASE WHEN is_top = 1 AND top_expire_at IS NOT NULL THEN greatest(0, ceil((epoch_us(top_expire_at) // 1000000 - epoch_us(TIMESTAMP '{AS_OF}') // 1000000) / 86400.0))::INT END AS top_left FROM t WHERE created_at <= TIMESTAMP '{AS_OF}'""",
)
def time_labels(spark, d):
    c, now = F.col("created_at"), _as_of()
    return table(spark, d, "posts").where(c <= now).select(
        "id", times.to_madrid(c).alias("madrid"), times.time_ago(c, now).alias("ago"), times.day_bucket(c, now).alias("bucket"), times.days_left(c, now, 30).alias("left_days"), times.top_days_left(F.col("is_top"), F.col("top_expire_at"), now).alias("top_left")
    )


_BYTE = lambda i: f"('0x' || substr(h, {1 + 2 * i}, 2))::INT"


@query("public_codes", f"SELECT id, {' || '.join(f'''substr('{codes.ALPHABET}', {_BYTE(i)} % {len(codes.ALPHABET)} + 1, 1)''' for i in range(10))} AS code FROM (SELECT id, sha256(id::VARCHAR || ':listing') AS h FROM jobs_clean)")
def public_codes(spark, d):
    return table(spark, d, "jobs_clean").select("id", codes.public_code(F.col("id"), "listing").alias("code"))


@query("post_addresses", "SELECT id, CASE WHEN octet_length(post_ip) = 4 THEN list_aggregate([('0x' || substr(hex(post_ip), 1 + 2 * i, 2))::INT::VARCHAR FOR i IN range(4)], 'string_agg', '.') WHEN post_ip IS NOT NULL THEN list_aggregate([substr(lower(hex(post_ip)), 1 + 4 * i, 4) FOR i IN range(octet_length(post_ip) // 2)], 'string_agg', ':') END AS ip FROM posts")
def post_addresses(spark, d):
    return table(spark, d, "posts").select("id", contact.ip_text(F.col("post_ip")).alias("ip"))


@query("region_labels", "SELECT r.id, split_part(r.name, ' ', 1) AS short_name, lower(trim(r.name)) AS name_key, coalesce(nullif(r.parent_id, 0), r.id) AS top_id FROM regions r")
def region_labels(spark, d):
    return table(spark, d, "regions").select("id", text.first_token(F.col("name")).alias("short_name"), text.map_key(F.col("name")).alias("name_key"), F.coalesce(F.nullif("parent_id", F.lit(0)), F.col("id")).alias("top_id"))


# --- pages ------------------------------------------------------------------------------------------------------

_ABS = """CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '^(?i)https?://') THEN h WHEN starts_with(h, 'javascript:') OR starts_with(h, '#') THEN NULL WHEN sch = '' OR hst = '' THEN NULL
    WHEN starts_with(h, '//') THEN sch || ':' || h WHEN starts_with(h, '/') THEN sch || '://' || hst || h ELSE sch || '://' || hst || CASE WHEN contains(pth, '/') THEN regexp_replace(pth, '/[^/]*$', '/') ELSE '/' END || h END"""


@query(
    "page_links",
    f"""WITH x AS (SELECT id AS page_id, source_url, regexp_extract_all(raw_html, '<a\\s+href=["'']([^"'']*)["'']', 1) AS l FROM raw_pages WHERE raw_html IS NOT NULL),
    y AS (SELECT page_id, source_url, unnest(l) AS h0, unnest(range(len(l))) AS p FROM x),
    z AS (SELECT page_id, p, {_TRIM.format(c="replace(h0, '&amp;', '&')")} AS h, regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS sch, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS hst, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS pth FROM y),
    u AS (SELECT page_id, p, {_ABS} AS url FROM z)
    SELECT page_id, min(p)::INT AS pos, url FROM u WHERE url IS NOT NULL GROUP BY page_id, url""",
)
def page_links(spark, d):
    return parse.page_links(spread(table(spark, d, "raw_pages").select("id", "source_site", "source_url", "raw_html")), SITES)


SITES = [
    parse.SiteConfig("yunqiao", {"title": ("h1.job-title", "h1.post-h", "h1.category-title", "h1"), "description": ("div.job-desc", "div.post-body", "div.detail")}, "div.item", "a"),
    parse.SiteConfig("lanhai", {"title": ("h1",), "description": ("section",)}, "aside li", "a"),
    parse.SiteConfig("hongmian", {"title": ("font b", "b")}, "table td", "a"),
    parse.SiteConfig("xingzhan", {"title": ("title",)}, "", "a", contact_mode="login_wall"),
]


@query("page_fields")
def page_fields(spark, d):
    return parse.page_fields(spread(table(spark, d, "raw_pages").select("id", "source_site", "raw_html")), SITES)


@query("page_list_items")
def page_list_items(spark, d):
    return parse.list_items(table(spark, d, "raw_pages"), SITES)


@query("stated_dates", r"""SELECT id, CASE WHEN regexp_matches(raw_html, '(\d{4})[/\-年](\d{1,2})[/\-月](\d{1,2})') THEN regexp_extract(raw_html, '(\d{4})[/\-年](\d{1,2})[/\-月](\d{1,2})', 1) || '-' || lpad(regexp_extract(raw_html, '(\d{4})[/\-年](\d{1,2})[/\-月](\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(raw_html, '(\d{4})[/\-年](\d{1,2})[/\-月](\d{1,2})', 3), 2, '0') END AS stated FROM raw_pages WHERE raw_html IS NOT NULL""")
def stated_dates(spark, d):
    return table(spark, d, "raw_pages").where("raw_html is not null").select("id", parse.parse_date(F.col("raw_html")).alias("stated"))


@query("contact_names", f"SELECT id, nullif({_TRIM.format(c=r"string_split_regex(regexp_replace(contact_name, '^.*?(?:联络人|联系人)\s*[:：]\s*', ''), '·|\||联络电话|联系电话')[1]")}, '') AS name FROM jobs_clean WHERE contact_name IS NOT NULL")
def contact_names(spark, d):
    return table(spark, d, "jobs_clean").where("contact_name is not null").select("id", parse.clean_contact_name(F.col("contact_name")).alias("name"))


@query("list_page_urls", "SELECT i::INT AS page, 'https://www.yunqiao.test/list/' || i || '.html' AS url FROM range(1, 11) t(i)")
def list_page_urls(spark, d):
    return parse.list_pages(spark, "https://www.yunqiao.test/list/%d.html", 10)


# --- duplicate judgement ----------------------------------------------------------------------------------------


@query("known_addresses", f"SELECT p.id FROM raw_pages p WHERE EXISTS (SELECT 1 FROM jobs_clean j WHERE {_FOLD.format(c='j.source_url')} = {_FOLD.format(c='p.source_url')})")
def known_addresses(spark, d):
    return dedup.known_addresses(table(spark, d, "raw_pages").select("id", "source_url"), table(spark, d, "jobs_clean")).select("id")


@query("new_addresses", f"SELECT j.id FROM jobs_clean j WHERE NOT EXISTS (SELECT 1 FROM raw_pages p WHERE {_FOLD.format(c='j.source_url')} = {_FOLD.format(c='p.source_url')})")
def new_addresses(spark, d):
    return dedup.new_addresses(table(spark, d, "jobs_clean").select("id", "source_url"), table(spark, d, "raw_pages")).select("id")


_CONTACT = f"SELECT id, {_FOLD.format(c='contact_key')} AS k FROM jobs_clean WHERE contact_key IS NOT NULL AND contact_key <> ''"


@query("contact_match", f"WITH t AS ({_CONTACT}) SELECT a.id, min(b.id) AS match_id FROM t a JOIN t b ON a.k = b.k AND a.id <> b.id GROUP BY a.id")
def contact_match(spark, d):
    return dedup.contact_match(table(spark, d, "jobs_clean"))


@query("phone_match", "WITH j AS (SELECT id, left(regexp_replace(contact_phone, '[^0-9+]', '', 'g'), 20) AS p FROM jobs_clean WHERE contact_phone IS NOT NULL AND contact_phone <> '') SELECT j.id, min(m.id) AS match_id FROM j JOIN posts m ON m.phone_norm = j.p AND m.status IN (0, 1) WHERE length(j.p) >= 9 GROUP BY j.id")
def phone_match(spark, d):
    return dedup.phone_match(table(spark, d, "jobs_clean"), table(spark, d, "posts"))


_NEAR = "SELECT a.id, arg_min(b.id, {{'d': bit_count(xor(a.simhash, b.simhash))::INT, 'i': b.id}}) AS best_id, min(bit_count(xor(a.simhash, b.simhash)))::INT AS dist FROM {a} a JOIN {b} b ON bit_count(xor(a.simhash, b.simhash)) <= 8 {cond} GROUP BY a.id"


@query("hamming_neighbors", "WITH f AS (SELECT id, simhash FROM jobs_clean WHERE simhash IS NOT NULL), g AS (SELECT id, simhash FROM posts WHERE simhash IS NOT NULL) " + _NEAR.format(a="f", b="g", cond=""))
def hamming_neighbors(spark, d):
    return hamming.nearest(table(spark, d, "jobs_clean"), table(spark, d, "posts"), 8)


@query("hamming_pairs", "SELECT a.id, b.id AS base_id, bit_count(xor(a.simhash, b.simhash))::INT AS dist FROM jobs_clean a JOIN posts b ON bit_count(xor(a.simhash, b.simhash)) <= 3")
def hamming_pairs(spark, d):
    return hamming.neighbor_pairs(table(spark, d, "jobs_clean").select("id", "simhash"), table(spark, d, "posts").select("id", "simhash"), 3)


def _judge_sql(mode: str, tail: str) -> str:
    cond = "AND a.id <> b.id" if mode == "rejudge" else "AND b.id < a.id"
    return f"""WITH j AS (SELECT id, simhash, contact_phone, contact_key IS NOT NULL AND contact_key <> '' AS has FROM jobs_clean),
    f AS (SELECT id, simhash FROM jobs_clean WHERE simhash IS NOT NULL), p AS (SELECT id, simhash FROM f WHERE simhash <> 0), g AS (SELECT id, simhash FROM posts WHERE simhash IS NOT NULL AND status IN (0, 1)),
    k AS ({_CONTACT}), c AS (SELECT a.id, min(b.id) AS cid FROM k a JOIN k b ON a.k = b.k {cond} GROUP BY a.id),
    n AS ({_NEAR.format(a='p', b='f', cond=cond)}), m AS ({_NEAR.format(a='p', b='g', cond='')}),
    h AS (SELECT j.id, min(x.id) AS pid FROM (SELECT id, left(regexp_replace(contact_phone, '[^0-9+]', '', 'g'), 20) AS ph FROM jobs_clean WHERE contact_phone IS NOT NULL AND contact_phone <> '') j JOIN posts x ON x.phone_norm = j.ph AND x.status IN (0, 1) WHERE length(j.ph) >= 9 GROUP BY j.id),
    x AS (SELECT j.id, j.has, CASE WHEN j.has THEN 3 ELSE 2 END AS cap, CASE WHEN j.has THEN 'high' ELSE 'low' END AS conf, c.cid, n.best_id AS iid, n.dist AS idist, h.pid, m.best_id AS oid, m.dist AS odist FROM j LEFT JOIN c USING (id) LEFT JOIN n USING (id) LEFT JOIN h USING (id) LEFT JOIN m USING (id)),
    y AS (SELECT *, CASE WHEN cid IS NOT NULL THEN 1 WHEN idist <= cap THEN 2 WHEN idist <= 8 THEN 3 WHEN pid IS NOT NULL THEN 4 WHEN odist <= cap THEN 5 WHEN odist <= 8 THEN 6 ELSE 7 END AS r FROM x),
    v AS (SELECT id, CASE WHEN r <= 2 THEN 'dup_cross' WHEN r IN (3, 6) THEN 'review' WHEN r IN (4, 5) THEN 'exists_in_main' ELSE 'unique' END AS status, CASE WHEN r IN (1, 4) THEN 'high' WHEN r IN (3, 6) THEN 'low' ELSE conf END AS confidence,
    CASE WHEN r IN (4, 5, 6) THEN 'main' ELSE 'crawler' END AS matched_against, CASE r WHEN 1 THEN cid WHEN 2 THEN iid WHEN 3 THEN iid WHEN 4 THEN pid WHEN 5 THEN oid WHEN 6 THEN oid END AS matched_id,
    CASE WHEN r IN (1, 4) THEN 'contact_key' ELSE 'simhash' END AS signal, CASE WHEN r IN (2, 3) THEN idist WHEN r IN (5, 6) THEN odist END AS hamming_dist, CASE WHEN r IN (1, 2, 4, 5) THEN 'dup' WHEN r IN (3, 6) THEN 'review' ELSE 'unique' END AS decision,
    (r = 7 AND conf = 'high')::INT AS import_ready FROM y) {tail}"""


def _judged(spark, d, mode):
    return dedup.judge(table(spark, d, "jobs_clean"), table(spark, d, "posts"), mode)


@query("dedup_rejudge", _judge_sql("rejudge", "SELECT * FROM v"))
def dedup_rejudge(spark, d):
    return _judged(spark, d, "rejudge")


@query("dedup_online", _judge_sql("online", "SELECT * FROM v"))
def dedup_online(spark, d):
    return _judged(spark, d, "online")


@query("dedup_log", _judge_sql("online", "SELECT id AS job_id, matched_against, matched_id, signal, hamming_dist, decision FROM v"))
def dedup_log(spark, d):
    return dedup.log_rows(_judged(spark, d, "online"))


@query("review_candidates", _judge_sql("online", "SELECT id AS job_id, CASE WHEN matched_against = 'crawler' THEN matched_id END AS candidate_id, hamming_dist FROM v WHERE decision = 'review'"))
def review_candidates(spark, d):
    return dedup.review_rows(_judged(spark, d, "online"))


@query("rejudge_applied", _judge_sql("rejudge", "SELECT j.id, CASE WHEN v.status <> 'unique' THEN v.status ELSE j.dedup_status END AS dedup_status, CASE WHEN v.status <> 'unique' THEN v.confidence ELSE j.confidence END AS confidence, CASE WHEN v.status <> 'unique' THEN 0 ELSE j.import_ready END AS import_ready FROM jobs_clean j JOIN v USING (id)"))
def rejudge_applied(spark, d):
    return dedup.apply_rejudge(table(spark, d, "jobs_clean"), _judged(spark, d, "rejudge")).select("id", "dedup_status", "confidence", "import_ready")


@query("exact_repost", "SELECT id, earlier_id FROM (SELECT id, created_at, lag(id) OVER w AS earlier_id, lag(created_at) OVER w AS t FROM posts WHERE status IN (0, 1) AND phone_norm IS NOT NULL AND phone_norm <> '' WINDOW w AS (PARTITION BY phone_norm, content_hash ORDER BY created_at, id)) WHERE t > created_at - INTERVAL 7 DAY")
def exact_repost(spark, d):
    return dedup.exact_repost(table(spark, d, "posts"))


# --- feed, facets, lists ----------------------------------------------------------------------------------------

_KEPT = f"""kept AS (SELECT * REPLACE (CASE WHEN is_top = 1 AND (top_expire_at IS NULL OR top_expire_at < TIMESTAMP '{AS_OF}') THEN 0 ELSE is_top END AS is_top, CASE WHEN status = 1 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 0 ELSE status END AS status) FROM posts)"""
_SHOWN = _KEPT + ", shown AS (SELECT k.*, r.name AS region_name, r.parent_id, coalesce(nullif(r.parent_id, 0), r.id) AS top_id, c.name AS category_name FROM kept k JOIN regions r ON r.id = k.region_id JOIN categories c ON c.id = k.category_id)"
_BUCKET = f"CASE date_diff('day', {_MADRID.format(c='bumped_at')}::DATE, {_MADRID.format(c=f"TIMESTAMP '{AS_OF}'")}::DATE) WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE 'earlier' END AS bucket"
_FEED_COLS = ("id", "is_top", "bumped_at", "region_name", "category_name", "part", "bucket")


@query("housekeeping", f"WITH {_KEPT} SELECT id, is_top, status FROM kept")
def housekeeping(spark, d):
    return feed.housekeeping(table(spark, d, "posts"), _as_of()).select("id", "is_top", "status")


def _feed(spark, d, **filters):
    return feed.feed(table(spark, d, "posts"), table(spark, d, "regions"), table(spark, d, "categories"), _as_of(), 1, **filters).select(*_FEED_COLS)


def _feed_sql(where: str, fill: bool) -> str:
    online = f"o AS (SELECT *, 0 AS part FROM shown WHERE type = 1 AND status = 1 {where} ORDER BY is_top DESC, bumped_at DESC, id DESC LIMIT 60)"
    spare = "s AS (SELECT *, 1 AS part FROM shown WHERE type = 1 AND status = 0 ORDER BY bumped_at DESC, id DESC LIMIT (SELECT greatest(0, 30 - count(*)) FROM o))" if fill else "s AS (SELECT * FROM o WHERE false)"
    return f"WITH {_SHOWN}, {online}, {spare} SELECT id, is_top, bumped_at, region_name, category_name, part, {_BUCKET} FROM (SELECT * FROM o UNION ALL SELECT * FROM s)"


@query("feed_unfiltered", _feed_sql("", True))
def feed_unfiltered(spark, d):
    return _feed(spark, d)


@query("feed_region", _feed_sql("AND (region_id = 1 OR parent_id = 1)", False))
def feed_region(spark, d):
    return _feed(spark, d, region=1)


@query("feed_search", _feed_sql(f"AND ({_FOLD.format(c='content')} LIKE '%malaga%' OR {_FOLD.format(c='contact_name')} LIKE '%malaga%')", False))
def feed_search(spark, d):
    return _feed(spark, d, text="Málaga")


@query("search_posts", f"SELECT id FROM posts WHERE {_FOLD.format(c='content')} LIKE '%cocinero_de%' OR {_FOLD.format(c='contact_name')} LIKE '%cocinero_de%'")
def search_posts(spark, d):
    return feed.matching(table(spark, d, "posts"), text="Cocinero_de").select("id")


@query("facet_types", f"WITH {_KEPT} SELECT type, count(*)::BIGINT AS n FROM kept WHERE status = 1 GROUP BY type")
def facet_types(spark, d):
    return feed.facet_types(feed.housekeeping(table(spark, d, "posts"), _as_of()))


@query("facet_regions", "SELECT coalesce(nullif(r.parent_id, 0), r.id) AS top_id, count(*)::BIGINT AS n FROM posts p JOIN regions r ON r.id = p.region_id WHERE p.status = 1 AND p.type = 1 GROUP BY 1")
def facet_regions(spark, d):
    return feed.facet_regions(table(spark, d, "posts"), table(spark, d, "regions"), 1)


@query("facet_categories", "SELECT c.id AS category_id, c.sort, (SELECT count(*) FROM posts p WHERE p.category_id = c.id AND p.status = 1)::BIGINT AS n FROM categories c")
def facet_categories(spark, d):
    return feed.facet_categories(table(spark, d, "posts"), table(spark, d, "categories"))


@query("covered_regions", "SELECT count(DISTINCT coalesce(nullif(r.parent_id, 0), r.id))::BIGINT AS covered FROM posts p JOIN regions r ON r.id = p.region_id WHERE p.status = 1 AND p.type = 1")
def covered_regions(spark, d):
    return feed.facet_regions(table(spark, d, "posts"), table(spark, d, "regions"), 1).agg(F.count("*").alias("covered"))


@query("new_today", f"SELECT type, count(*)::BIGINT AS n FROM posts WHERE status = 1 AND created_at >= {_MIDNIGHT} AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY type")
def new_today(spark, d):
    return feed.new_today(table(spark, d, "posts"), _as_of())


@query(
    "related_top3",
    """WITH x AS (SELECT p.id, p.type, p.category_id, coalesce(nullif(r.parent_id, 0), r.id) AS top_id, p.bumped_at FROM posts p JOIN regions r ON r.id = p.region_id JOIN categories c ON c.id = p.category_id WHERE p.status = 1),
    y AS (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.bumped_at DESC, b.id DESC)::INT AS rank FROM x a JOIN x b ON a.type = b.type AND a.category_id = b.category_id AND a.top_id = b.top_id AND a.id <> b.id)
    SELECT id, rank, related_id FROM y WHERE rank <= 3""",
)
def related_top3(spark, d):
    return feed.related(table(spark, d, "posts"), table(spark, d, "regions"), table(spark, d, "categories"))


@query("post_page_2", "SELECT id, type, status FROM posts ORDER BY id DESC LIMIT 50 OFFSET 50")
def post_page_2(spark, d):
    return feed.page(table(spark, d, "posts"), 2).select("id", "type", "status")


@query("most_invalid", "SELECT id, invalid_count, invalid_count >= 5 AS flagged FROM posts WHERE invalid_count > 0 AND status IN (0, 1) ORDER BY invalid_count DESC, id DESC LIMIT 100")
def most_invalid(spark, d):
    x = table(spark, d, "posts").where("invalid_count > 0 and status in (0, 1)")
    return x.select("id", "invalid_count", (F.col("invalid_count") >= 5).alias("flagged")).orderBy(F.desc("invalid_count"), F.desc("id")).limit(100)


@query("region_tree", "SELECT parent_id AS city_id, string_agg(name, ',' ORDER BY sort, id) AS districts FROM regions WHERE parent_id <> 0 GROUP BY parent_id")
def region_tree(spark, d):
    return feed.region_tree(table(spark, d, "regions"))


@query("owner_posts", "SELECT user_id, count(*)::BIGINT AS posts, max(created_at) AS newest FROM posts WHERE user_id IS NOT NULL AND poster_type = 2 AND status <> 3 GROUP BY user_id")
def owner_posts(spark, d):
    x = table(spark, d, "posts").where("user_id is not null and poster_type = 2 and status <> 3")
    return x.groupBy("user_id").agg(F.count("*").alias("posts"), F.max("created_at").alias("newest"))


# --- ledgered writes --------------------------------------------------------------------------------------------


@query("raw_page_upsert", f"WITH t AS (SELECT *, {_FOLD.format(c='source_url')} AS k FROM raw_pages) SELECT k AS url_key, arg_min(source_site, {{'a': fetched_at, 'b': id}}) AS source_site, arg_max(http_status, {{'a': fetched_at, 'b': id}}) AS http_status, max(fetched_at) AS fetched_at FROM t GROUP BY k")
def raw_page_upsert(spark, d):
    x = table(spark, d, "raw_pages").select(dedup.url_key(F.col("source_url")).alias("url_key"), "source_site", "http_status", "fetched_at", "id")
    return ledger.upsert_latest(x, ["url_key"], ["fetched_at", "id"], ["source_site"]).select("url_key", "source_site", "http_status", "fetched_at")


@query("insert_ignore_marks", "WITH n AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'view'), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT user_id, event_type, event_id FROM n WHERE rn = 1 AND NOT (event_type = 'signup' AND user_id IN (SELECT user_id FROM e))")
def insert_ignore_marks(spark, d):
    e = table(spark, d, "events")
    existing = e.where("event_type = 'signup'").select("user_id", "event_type")
    return ledger.insert_ignore(existing, e.where("event_type <> 'view'").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("counter_bumps", "SELECT p.id, (p.phone_views + coalesce(e.a, 0))::BIGINT AS phone_views, (p.invalid_count + coalesce(e.b, 0))::BIGINT AS invalid_count FROM posts p LEFT JOIN (SELECT user_id AS id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b FROM events GROUP BY 1) e USING (id)")
def counter_bumps(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "id")
    x = ledger.bump_counters(table(spark, d, "posts"), e, "id", {"phone_views": F.col("event_type") == "click", "invalid_count": F.col("event_type") == "error"})
    return x.select("id", F.col("phone_views").cast("long").alias("phone_views"), F.col("invalid_count").cast("long").alias("invalid_count"))


_RID = "(SELECT min(id) FROM {t} n WHERE lower(" + _TRIM.format(c="n.name") + ") = lower(" + _TRIM.format(c="j.{c}") + "))"


@query("name_resolution", f"SELECT j.id, coalesce({_RID.format(t='regions', c='district')}, {_RID.format(t='regions', c='city')}, 1)::INT AS region_id, coalesce({_RID.format(t='categories', c='category')}, 1)::INT AS category_id FROM jobs_clean j")
def name_resolution(spark, d):
    return ledger.resolve_names(table(spark, d, "jobs_clean"), table(spark, d, "regions"), table(spark, d, "categories"), 1, 1).select("id", "region_id", "category_id")


@query(
    "import_batch",
    f"""WITH j AS (SELECT *, {_BODY_SQL} AS body FROM jobs_clean WHERE import_ready = 1 AND imported_at IS NULL), t AS (SELECT *, {_CONTENT_SQL} AS content FROM j)
    SELECT j.id AS crawler_job_id, content, sha256(lower(regexp_replace(content, '{_BLANK.format()}', '', 'g'))) AS content_hash, left(regexp_replace(coalesce(contact_phone, ''), '[^0-9+]', '', 'g'), 20) AS phone_norm,
    coalesce({_RID.format(t='regions', c='district')}, {_RID.format(t='regions', c='city')}, 1)::INT AS region_id, coalesce({_RID.format(t='categories', c='category')}, 1)::INT AS category_id FROM t j""",
)
def import_batch(spark, d):
    x = ledger.import_rows(table(spark, d, "jobs_clean"), table(spark, d, "regions"), table(spark, d, "categories"), _as_of(), "batch-1", fingerprint=False)
    return x.select("crawler_job_id", "content", "content_hash", "phone_norm", "region_id", "category_id")


_READY = f"(SELECT id AS crawler_job_id, {' || '.join(f"substr('{codes.ALPHABET}', {_BYTE(i)} % {len(codes.ALPHABET)} + 1, 1)" for i in range(10))} AS public_code, {_CONTENT_SQL} AS content FROM (SELECT id, sha256(id::VARCHAR || ':batch-1') AS h, {_BODY_SQL} AS body FROM jobs_clean WHERE import_ready = 1 AND imported_at IS NULL))"


@query("import_fingerprints", _simhash_sql(_READY, "content", "crawler_job_id", ", public_code"))
def import_fingerprints(spark, d):
    x = ledger.import_rows(table(spark, d, "jobs_clean"), table(spark, d, "regions"), table(spark, d, "categories"), _as_of(), "batch-1")
    return x.select("crawler_job_id", "public_code", "simhash")


@query("purge_main", "SELECT m.id AS map_id, m.main_job_id, CASE WHEN EXISTS (SELECT 1 FROM posts p WHERE p.id = m.main_job_id AND p.origin = 'crawler') THEN 'deleted' ELSE 'skipped' END AS outcome FROM import_map m WHERE m.purged = 0")
def purge_main(spark, d):
    return ledger.purge_report(table(spark, d, "import_map"), table(spark, d, "posts"))


@query("posts_after_purge", "SELECT p.id FROM posts p WHERE NOT (p.origin = 'crawler' AND p.id IN (SELECT main_job_id FROM import_map WHERE purged = 0))")
def posts_after_purge(spark, d):
    return ledger.posts_after_purge(table(spark, d, "import_map"), table(spark, d, "posts")).select("id")


@query("purge_expired", f"SELECT id FROM jobs_clean j WHERE purge_after < DATE '{TODAY}' AND NOT EXISTS (SELECT 1 FROM import_map m WHERE m.crawler_job_id = j.id AND m.purged = 0)")
def purge_expired(spark, d):
    return ledger.expired_jobs(table(spark, d, "jobs_clean"), table(spark, d, "import_map"), F.lit(TODAY).cast("date")).select("id")


@query("purge_site", "SELECT id FROM jobs_clean j WHERE source_site = 'lanhai' AND NOT EXISTS (SELECT 1 FROM import_map m WHERE m.crawler_job_id = j.id AND m.purged = 0)")
def purge_site(spark, d):
    return ledger.site_jobs(table(spark, d, "jobs_clean"), table(spark, d, "import_map"), "lanhai").select("id")


@query("purge_all_guard", "SELECT count(*) FILTER (purged = 0) = 0 AS allowed, (count(*) FILTER (purged = 0))::BIGINT AS open_rows FROM import_map")
def purge_all_guard(spark, d):
    return ledger.purge_allowed(table(spark, d, "import_map"))


@query("simhash_backfill", _simhash_sql("posts WHERE simhash IS NULL AND content IS NOT NULL", "content"))
def simhash_backfill(spark, d):
    return ledger.backfill_simhash(table(spark, d, "posts"))


@query("review_resolutions", "SELECT j.id, CASE WHEN r = 'keep' THEN 'unique' ELSE 'dup_cross' END AS dedup_status, CASE WHEN r = 'keep' THEN 1 ELSE 0 END AS import_ready FROM jobs_clean j JOIN (SELECT job_id, arg_max(resolution, {'a': created_at, 'b': id}) AS r FROM review_queue WHERE resolved = 1 AND resolution IS NOT NULL GROUP BY job_id) q ON q.job_id = j.id")
def review_resolutions(spark, d):
    return ledger.resolve_reviews(table(spark, d, "jobs_clean"), table(spark, d, "review_queue"))


@query("review_queue_list", "SELECT q.id, q.job_id, q.candidate_id, q.reason, j.title, j.company, j.source_site, c.title AS candidate_title, c.source_site AS candidate_site FROM review_queue q JOIN jobs_clean j ON j.id = q.job_id LEFT JOIN jobs_clean c ON c.id = q.candidate_id WHERE q.resolved = 0")
def review_queue_list(spark, d):
    return ledger.review_list(table(spark, d, "review_queue"), table(spark, d, "jobs_clean"))


@query("first_in_line", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1")
def first_in_line(spark, d):
    return ledger.first_in_line(table(spark, d, "events").where("event_type = 'purchase'"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


# --- gates over events ------------------------------------------------------------------------------------------


def _gate_sql(keys: str, start: str, state: str, accepted: str, where: str = "true", extra: str = "", out: str = "accepted") -> str:
    """A gate as recursion over each key's events in order: ``state`` and ``accepted`` read r.state, e.ts and ``extra``."""
    on = " AND ".join(f"e.{k} IS NOT DISTINCT FROM r.{k}" for k in keys.split(", "))
    s0 = lambda x: x.replace("r.state", f"({start})")
    cols = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE e AS (SELECT {keys}, event_id, ts{extra}, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM events WHERE {where}),
    r AS (SELECT {cols}, e.event_id, e.rn, {s0(state)} AS state, {s0(accepted)} AS {out} FROM e WHERE rn = 1
    UNION ALL SELECT {cols}, e.event_id, e.rn, {state}, {accepted} FROM r JOIN e ON {on} AND e.rn = r.rn + 1) SELECT event_id, {out} FROM r"""


_OPEN = "(r.state IS NULL OR e.ts >= r.state + INTERVAL {n} SECOND)"
_LATELY = "list_filter(r.state, lambda t: t > e.ts - INTERVAL {n} SECOND)"


@query("throttle_views", _gate_sql("user_id, event_type", "NULL::TIMESTAMP", f"CASE WHEN {_OPEN.format(n=3600)} THEN e.ts ELSE r.state END", _OPEN.format(n=3600)))
def throttle_views(spark, d):
    return gates.throttle(table(spark, d, "events"), ["user_id", "event_type"], 3600)


@query("bump_gate", _gate_sql("user_id", "NULL::TIMESTAMP", f"CASE WHEN {_OPEN.format(n=86400)} THEN e.ts ELSE r.state END", _OPEN.format(n=86400), "event_type = 'purchase'"))
def bump_gate(spark, d):
    return gates.throttle(table(spark, d, "events").where("event_type = 'purchase'"), ["user_id"], 86400)


@query("rate_limit_reveals", _gate_sql("user_id", "[]::TIMESTAMP[]", f"CASE WHEN len({_LATELY.format(n=86400)}) < 3 THEN list_append({_LATELY.format(n=86400)}, e.ts) ELSE {_LATELY.format(n=86400)} END", f"len({_LATELY.format(n=86400)}) < 3"))
def rate_limit_reveals(spark, d):
    return gates.rate_limit(table(spark, d, "events"), ["user_id"], 86400, 3)


_LOG = "list_filter(r.state, lambda t: t.a > e.ts - INTERVAL 604800 SECOND)"
_SEEN = f"len(list_filter({_LOG}, lambda t: t.b = e.event_type)) > 0"


@query(
    "reveal_contacts",
    _gate_sql("user_id", "[]::STRUCT(a TIMESTAMP, b VARCHAR)[]", f"CASE WHEN len({_LOG}) < 3 AND NOT {_SEEN} THEN list_append({_LOG}, {{'a': e.ts, 'b': e.event_type}}) ELSE {_LOG} END", f"CASE WHEN len({_LOG}) >= 3 THEN 'rate' WHEN {_SEEN} THEN 'seen' ELSE 'counted' END", extra=", event_type", out="outcome"),
)
def reveal_contacts(spark, d):
    return gates.reveal(table(spark, d, "events"), "user_id", "event_type", 604800, 3)


_K = "coalesce(json_extract_string(props, '$.k')::BIGINT, 0)"
_HELD = "list_filter(r.state, lambda t: t > e.ts)"


@query("slot_admission", _gate_sql("one", "[]::TIMESTAMP[]", f"CASE WHEN len({_HELD}) < 5 THEN list_append({_HELD}, e.ts + to_seconds(e.hold)) ELSE {_HELD} END", f"len({_HELD}) < 5", extra=", hold").replace("FROM events WHERE true", f"FROM (SELECT *, 1 AS one, 3600 + {_K} * 600 AS hold FROM events WHERE event_type = 'purchase')"))
def slot_admission(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").withColumn("hold", 3600 + 600 * F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    return gates.admit_slots(e, "ts", "hold", 5, 86400)


_RUNS = "list_filter(r.state.runs, lambda t: t.a > e.ts - INTERVAL 6 HOUR AND t.b > e.ts)"
_GO = f"(e.force OR (len({_RUNS}) = 0 AND (r.state.last IS NULL OR e.ts >= r.state.last + INTERVAL 3600 SECOND)))"


@query(
    "trigger_gate",
    _gate_sql("one", "{'last': NULL::TIMESTAMP, 'runs': []::STRUCT(a TIMESTAMP, b TIMESTAMP)[]}", f"CASE WHEN {_GO} THEN {{'last': e.ts, 'runs': list_append({_RUNS}, {{'a': e.ts, 'b': e.ends}})}} ELSE {{'last': r.state.last, 'runs': {_RUNS}}} END", _GO, extra=", force, ends").replace(
        "FROM events WHERE true", f"FROM (SELECT *, 1 AS one, {_K} > 95 AS force, CASE WHEN {_K} < 10 THEN TIMESTAMP '9999-01-01' ELSE ts + to_seconds({_K} * 300) END AS ends FROM events WHERE event_type = 'signup')"
    ),
)
def trigger_gate(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    e = table(spark, d, "events").where("event_type = 'signup'").withColumns({"one": F.lit(1), "force": k > 95, "run_seconds": F.when(k >= 10, k * 300)})
    return gates.trigger_gate(e, "one", 1800)


@query("report_alerts", "SELECT event_id, coalesce(lag(ts) OVER w <= ts - INTERVAL 60 MINUTE, true) AS sends, (row_number() OVER w)::INT AS so_far FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def report_alerts(spark, d):
    return gates.alert_merge(table(spark, d, "events").where("event_type = 'error'"), "user_id", 60)


@query(
    "stop_after_known",
    """WITH a AS (SELECT user_id, event_id, event_type = 'view' AS known, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    b AS (SELECT *, sum(known::INT) OVER (PARTITION BY user_id, island ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT *, min(CASE WHEN run >= 2 THEN pos END) OVER (PARTITION BY user_id) AS stop FROM b)
    SELECT event_id, user_id, pos::INT AS pos FROM c WHERE stop IS NULL OR pos <= stop""",
)
def stop_after_known(spark, d):
    e = table(spark, d, "events").withColumn("known", F.col("event_type") == "view")
    return gates.stop_after_known(e, "user_id", "known", 2, ["ts", "event_id"]).select("event_id", "user_id", "pos")


@query("layout_alert", "WITH a AS (SELECT user_id, row_number() OVER w AS pos, sum((event_type IN ('error', 'view'))::INT) OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, min(pos)::INT AS stop_pos FROM a WHERE pos >= 5 AND bad / pos > 0.5 GROUP BY user_id")
def layout_alert(spark, d):
    e = table(spark, d, "events").withColumn("bad", F.col("event_type").isin("error", "view"))
    return gates.layout_alert(e, "user_id", "bad", 5, 0.5, ["ts", "event_id"])


# --- dashboards -------------------------------------------------------------------------------------------------


@query("kpi_site", f"SELECT count(*)::BIGINT AS posts, (count(*) FILTER (status = 1))::BIGINT AS online, (count(*) FILTER (created_at >= {_MIDNIGHT}))::BIGINT AS today, (count(*) FILTER (suspicious = 1))::BIGINT AS suspicious, (count(*) FILTER (report_count > 0))::BIGINT AS reported, sum(phone_views + wechat_views)::BIGINT AS views FROM posts")
def kpi_site(spark, d):
    return kpi.site_kpis(table(spark, d, "posts"), _as_of())


@query("kpi_pipeline", "SELECT count(*)::BIGINT AS total, (count(*) FILTER (dedup_status = 'unique'))::BIGINT AS unique_jobs, (count(*) FILTER (import_ready = 1 AND imported_at IS NULL))::BIGINT AS ready, (SELECT count(*) FROM review_queue WHERE resolved = 0)::BIGINT AS review_open, (SELECT count(*) FROM import_map WHERE purged = 0)::BIGINT AS imported FROM jobs_clean")
def kpi_pipeline(spark, d):
    return kpi.pipeline_kpis(table(spark, d, "jobs_clean"), table(spark, d, "review_queue"), table(spark, d, "import_map"))


@query(
    "run_counters",
    """WITH j AS (SELECT source_site, collected_at::DATE AS day, count(*) FILTER (dedup_status IN ('unique', 'review')) AS new_jobs, count(*) FILTER (dedup_status NOT IN ('unique', 'review')) AS dup_jobs FROM jobs_clean GROUP BY ALL),
    p AS (SELECT source_site, fetched_at::DATE AS day, count(*) AS pages_fetched, count(*) FILTER (http_status <> 200) AS errors FROM raw_pages GROUP BY ALL),
    x AS (SELECT source_site, day, coalesce(pages_fetched, 0)::BIGINT AS pages_fetched, coalesce(new_jobs, 0)::BIGINT AS new_jobs, coalesce(dup_jobs, 0)::BIGINT AS dup_jobs, coalesce(errors, 0)::BIGINT AS errors FROM j FULL JOIN p USING (source_site, day))
    SELECT *, CASE WHEN dup_jobs + new_jobs > 0 THEN round(100.0 * dup_jobs / (dup_jobs + new_jobs))::INT::VARCHAR || '%' ELSE '—' END AS dup_rate FROM x""",
)
def run_counters(spark, d):
    return kpi.run_counters(table(spark, d, "jobs_clean"), table(spark, d, "raw_pages"))


@query("company_gaps", "SELECT source_site, count(*)::BIGINT AS rows, round(avg((company IS NULL OR company = '')::INT), 6) AS empty_share FROM jobs_clean GROUP BY source_site")
def company_gaps(spark, d):
    return kpi.empty_share(table(spark, d, "jobs_clean"), "source_site", "company")


@query("settings_json", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k FROM events")
def settings_json(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("coupon_ledger", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def coupon_ledger(spark, d):
    """The three-way outer lookup of a ledger against its dimensions."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    x = o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c.select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), "c_custkey", "left")
    return x.join(n.select("n_nationkey", "n_name"), "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


from carda.plans import more  # noqa: E402, F401  registers its queries here
