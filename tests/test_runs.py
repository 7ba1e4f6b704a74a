"""Crawl runs, page records, gates over one key, addresses and id assignment, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from carda.functions import codes, contact
from carda.operators import crawl, gates, ledger, parse, requests
from carda.sources import tables

PAGE = """<div class="list"><div class="item"><a class="t" href="/a?x=1&amp;y=2">Uno</a><span class="pay">1200</span><i class="who">联系人：王先生 · 电话</i><b class="d">2026/7/4</b><em class="tel">612345678</em></div>
<div class="item"><a class="t" href="/a?x=1&amp;y=2">Otra vez</a></div><div class="item"><a class="t" href="#no">Sin</a></div><div class="item"><a class="t" href="b"></a></div><div class="item"><a class="t" href="b">Dos</a></div></div>"""
SITE = parse.SiteConfig("s", {"title": ("h1", "a.t"), "salary": (".pay",), "contact_name": ("i.who",), "date": ("b.d",), "phone": (".tel",)}, "div.item", "a", category="jobs")


def pages(spark, rows):
    return spark.createDataFrame(rows, "id long, source_site string, source_url string, raw_html string").withColumn("title", F.lit("clash"))


def test_item_records(spark):
    p = pages(spark, [(1, "s", "https://h.t/l/p1", PAGE), (2, "other", "https://h.t/l/p1", PAGE), (3, "s", "https://h.t/l/p1", None), (4, "s", "https://h.t/", "")])
    got = {(r["page_id"], r["source_url"]): r for r in parse.item_records(p, [SITE]).collect()}
    assert set(got) == {(1, "https://h.t/a?x=1&y=2"), (1, "https://h.t/l/b")}
    r = got[1, "https://h.t/a?x=1&y=2"]
    assert (r["title"], r["salary_raw"], r["contact_name"], r["publish_date"], r["contact_phone"], r["category"]) == ("Uno", "1200", "王先生", "2026-07-04", "612345678", "jobs")
    assert got[1, "https://h.t/l/b"]["title"] == "Dos" and got[1, "https://h.t/l/b"]["salary_raw"] is None
    walled = parse.SiteConfig("s", SITE.fields, SITE.list_item, "a", contact_mode="login_wall")
    assert {r["contact_phone"] for r in parse.item_records(p, [walled]).collect()} == {None}
    d = parse.page_records(p, [SITE]).collect()
    assert {(r["page_id"], r["title"]) for r in d} == {(1, "Uno"), (4, None)}
    links = {(r["pos"], r["url"], r["title"]) for r in parse.page_links(p, [SITE], titles=True).where("page_id = 1").collect()}
    assert links == {(0, "https://h.t/a?x=1&y=2", "Uno"), (3, "https://h.t/l/b", "")}


@pytest.mark.parametrize("css, steps", [("a.b-c #d", [("a", "class", "b-c"), ("", "id", "d")]), ("h1", [("h1", "", "")]), ("a.b.c", [("", "", "")]), ("1a", [("", "", "")]), (".", [("", "", "")]), ("", [])])
def test_selector(css, steps):
    assert [(s.tag, s.attr, s.value) for s in parse.selector(css)] == steps


@pytest.mark.parametrize("text, packed", [("10.0.0.255", "0A0000FF"), ("256.1.1.1", "00000000"), ("2001:db8::1", "20010DB8000000000000000000000001"), ("::", "0" * 32), ("1:2:3:4:5:6:7:8", "00010002000300040005000600070008"), ("1::2::3", "00000000"), ("1:2", "00000000"), ("", "00000000")])
def test_ip_pack(spark, text, packed):
    assert spark.range(1).select(F.hex(contact.ip_pack(F.lit(text)))).first()[0] == packed


def test_alphabet():
    assert codes.ALPHABET == "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"


def test_crawl_run_stops(spark):
    """Known rows of the run itself count; five in a row stop it; bare titles stop another; a failed row is an error."""
    rows = [("k", i, u, "t", "unique") for i, u in enumerate(["new1", "old1", "NEW1", "new2", "old1", "old2", "old1", "old2", "old1", "new3"])]
    rows += [("b", i, f"b{i}", None if i % 3 else "t", "dup_cross" if i == 4 else "unique") for i in range(20)]
    links = spark.createDataFrame(rows, "run string, n int, source_url string, title string, dedup_status string").withColumn("pos", F.lit(-1))
    old = spark.createDataFrame([("old1",), ("old2",), (None,)], "source_url string")
    x = crawl.crawl_run(links, old, "run", ["n"]).collect()
    k = [(r["pos"], r["outcome"], r["stop"]) for r in sorted(x, key=lambda r: r["pos"]) if r["run"] == "k"]
    assert [o for _, o, _ in k] == ["new", "known", "known", "new", "known", "known", "known", "known", "known"] and k[-1][2] == "known"
    b = [r for r in sorted(x, key=lambda r: r["pos"]) if r["run"] == "b"]
    assert len(b) == 11 and b[-1]["stop"] == "layout"
    led = {r["run"]: (r["new_jobs"], r["dup_jobs"], r["errors"], r["status"]) for r in crawl.run_ledger(crawl.crawl_run(links, old, "run", ["n"]), "run").collect()}
    assert led == {"k": (2, 7, 0, "ok"), "b": (10, 1, 0, "failed")}
    s = crawl.crawl_sync(links, old, "run", ["n"], 2, failed=F.col("source_url") == "new1")
    assert s.where("run = 'k'").count() == 10 and s.where("run = 'b'").count() == 2
    assert crawl.crawl_run(links.limit(0), old, "run", ["n"]).count() == 0


def events(spark, rows, extra="", start="2026-01-01 00:00:00"):
    df = spark.createDataFrame(rows, "event_id long, who string, s long" + extra)
    return df.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("s") * 1_000_000).cast("timestamp_ntz"))


def accepted(df):
    return {r["event_id"] for r in df.where("accepted").collect()}


def test_stretches_change_nothing(spark):
    """One key of long and short gaps, and a null key, judged as one sequence each."""
    import random

    r = random.Random(3)
    at, rows, t = 0, [], 0
    for i in range(300):
        t += r.choice([5, 40, 100, 101, 250])
        rows.append((i, r.choice(["a", None]), t))
    del at
    e = events(spark, rows)
    want: set[int] = set()
    last: dict = {}
    for i, k, s in rows:
        if k not in last or s - last[k] >= 100:
            last[k] = s
            want.add(i)
    assert accepted(gates.throttle(e, ["who"], 100)) == want
    lim, seen = set(), {}
    for i, k, s in rows:
        kept = [x for x in seen.get(k, []) if x > s - 100]
        if len(kept) < 2:
            kept.append(s)
            lim.add(i)
        seen[k] = kept
    assert accepted(gates.rate_limit(e, ["who"], 100, 2)) == lim


def test_own_holds_and_running_crawls(spark):
    e = events(spark, [(1, "x", 0, 100), (2, "x", 10, 1000), (3, "x", 20, 5), (4, "x", 100, 5), (5, "x", 101, 5), (6, "x", 106, 5)], ", hold long")
    assert accepted(gates.admit_slots(e, "ts", "hold", 2, 1000)) == {1, 2, 4, 6}
    h = 3600
    runs = [(1, "x", 0, False, None), (2, "x", 2 * h, False, 60), (3, "x", 3 * h, True, 600), (4, "x", 6 * h + 1, False, 60), (5, "x", 7 * h, False, 60), (6, "x", 8 * h, False, 60)]
    g = events(spark, runs, ", force boolean, run_seconds long")
    assert accepted(gates.trigger_gate(g, "who", 60)) == {1, 3, 4, 6}  # 1 never ends and blocks six hours; 5 comes too soon
    assert accepted(gates.trigger_gate(g, "who", 60, debug=True)) == {1, 3, 4, 5, 6}


def test_reveal_asks_the_limit_first(spark):
    e = events(spark, [(1, "a", 0, "p"), (2, "a", 1, "p"), (3, "a", 2, "q"), (4, "a", 3, "p"), (5, "a", 3601, "p")], ", item string")
    got = {r["event_id"]: r["outcome"] for r in gates.reveal(e, "who", "item", 3600, 2).collect()}
    assert got == {1: "counted", 2: "seen", 3: "counted", 4: "rate", 5: "counted"}


def test_ids_follow_the_order(spark):
    old = spark.createDataFrame([(7,)], "id long")
    new = spark.createDataFrame([(f"u{i:03d}",) for i in reversed(range(50))], "u string")
    got = sorted((r["u"], r["id"]) for r in ledger.assign_ids(old, new, ["u"]).collect())
    assert got == [(f"u{i:03d}", 8 + i) for i in range(50)]
    assert ledger.assign_ids(old.limit(0), new.limit(0), ["u"]).count() == 0


def test_publish_rules(spark):
    reg, cat = spark.createDataFrame([(1, 1), (2, 0)], "id int, status int"), spark.createDataFrame([(1, 1)], "id int, status int")
    base = dict(content="Se busca cocinero", contact_name="Ana", phone="612 345 678", wechat=None, region_id=1, category_id=1, poster_type=1, user_id=None, status=1, post_ip=None)
    cases = [({}, "ok"), ({}, "duplicate"), ({"content": " "}, "content"), ({"contact_name": "x" * 51}, "contact_name"), ({"phone": "abc"}, "phone"), ({"phone": None}, "phone"), ({"wechat": "w" * 61}, "wechat"), ({"region_id": 2}, "region"), ({"category_id": None}, "category"), ({"content": "llama 612345678"}, "contact_in_content")]
    rows = [(i, *[{**base, **c}[k] for k in base], f"2026-01-0{1 + i // 9} 10:00:0{i % 9}") for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, content string, contact_name string, phone string, wechat string, region_id int, category_id int, poster_type int, user_id long, status int, post_ip binary, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    got = {r["id"]: r["verdict"] for r in requests.validate_posts(df, reg, cat).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}


def test_page_files_of_a_charset(spark, tmp_path):
    (tmp_path / "a.html").write_bytes('<html><head><meta charset="gb2312"></head><h1>招聘</h1><meta charset="x"></html>'.encode("gb18030"))
    p = tables.pages_from_files(spark, str(tmp_path / "*.html"), "s", "GB18030")
    html = p.first()["raw_html"]
    assert html.startswith('<html><head><meta charset="utf-8">') and '<meta charset="x">' in html
    assert parse.page_records(p, [SITE]).first()["title"] == "招聘"
    bad = spark.createDataFrame([(bytearray(b"a\xffb"),), (None,)], "b binary")
    for charset in ("UTF-8", "GB18030"):
        assert [r[0] for r in bad.select(parse.to_utf8(F.col("b"), charset)).collect()] == ["a\ufffdb", None]
