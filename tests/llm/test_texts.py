"""Personal items, truncation, boilerplate, wrong encodings, leaks and history."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carda.llm import blocks, history, leakage, mojibake, pii, truncation

REGIONS = [(1, 0, "Madrid 马德里", 1), (2, 0, "Málaga 马拉加", 1)]


# --- personal items


@pytest.mark.parametrize(
    "text, want",
    [
        ("请致电 +34 612 345 678 预约。条码 8410007112556 开头的货归你管。", [("phone", 4)]),
        ("Contacto: Sra. Lucía Zarzuelo. Referencia interna 48-7-507-26, cítala.", [("name", 15)]),
        ("居留号：Ｙ 9777813 K。邮箱：rosal_x (arroba) buzon (punto) test 。", [("id_number", 4), ("email", 19)]),
        ("地址：钟楼巷20号。到店找 老徐 。", [("address", 3), ("name", 14)]),
        ("Entrevistas en C/ Batalla Chica, 11 . Tfno 七九三二五一零四六 (solo mensajes).", [("address", 15), ("phone", 43)]),
        ("每月13号准时发工资，前任店长会带新人。", []),
        ("", []),
    ],
)
def test_items(text, want):
    got = [(t, a) for a, _, t in pii.Tagger(pii.load_model()["weights"]).items(text)]
    assert got == want


def test_long_names_are_taken_whole():
    text = "Preguntar por Maria del Carmen Garcia Lopez de 10 a 14."
    got = pii.Tagger(pii.load_model()["weights"]).items(text)
    assert [(text[a:b], t) for a, b, t in got] == [("Maria del Carmen Garcia Lopez", "name")]


def test_masking_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "电话：696854657。明天见"), (2, None), (3, ""), (3, "")], "row_id long, text string").withColumn("src_table", F.lit("t")).withColumn("masked", F.lit("clash"))
    got = {r["row_id"]: r["masked"] for r in pii.mask_text(df.drop("masked")).collect()}
    assert got == {1: "电话：[PHONE]。明天见", 2: None, 3: ""}
    assert pii.find_items(df).count() == 1 and pii.find_items(df.limit(0)).count() == 0


def test_decode_is_the_best_segmentation():
    r = random.Random(1)
    for _ in range(200):
        c = [(a := r.randrange(20), a + r.randrange(1, 8), "name") for _ in range(r.randrange(1, 8))]
        s = [r.uniform(-1, 3) for _ in c]
        best = 0.0
        for m in range(1 << len(c)):
            pick = sorted((c[i] for i in range(len(c)) if m >> i & 1), key=lambda x: x[0])
            if all(x[1] <= y[0] for x, y in zip(pick, pick[1:])):
                best = max(best, sum(s[i] for i in range(len(c)) if m >> i & 1))
        got = pii.decode(c, s)
        chosen = sorted((c[i] for i in got), key=lambda x: x[0])
        assert all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])) and sum(s[i] for i in got) == pytest.approx(best)


def test_marginals_equal_enumeration():
    from math import exp, log

    from carda.llm.pii_training import marginals

    c, s = [(0, 3, "a"), (2, 5, "b"), (5, 6, "a"), (1, 2, "b")], [0.5, -0.2, 1.0, 0.1]
    sets = [m for m in range(16) if all(c[i][1] <= c[j][0] or c[j][1] <= c[i][0] for i in range(4) for j in range(i) if m >> i & 1 and m >> j & 1)]
    w = {m: exp(sum(s[i] for i in range(4) if m >> i & 1)) for m in sets}
    z, p = marginals(c, s)
    assert z == pytest.approx(log(sum(w.values())))
    for i in range(4):
        assert p[i] == pytest.approx(sum(v for m, v in w.items() if m >> i & 1) / sum(w.values()))


# --- truncation


def test_structure_flags():
    assert truncation.structure("abc�") & 2 and truncation.structure("abc...") & 4 and truncation.structure("hola &nb") & 8
    assert truncation.structure("dijo (algo") & 1 and truncation.structure("dijo (algo) y") == 0 and truncation.structure("a <b>x</b>") == 0
    assert truncation.structure("") == 0 and truncation.structure("x <div") & 8 and truncation.structure("R & D") == 0


def test_cut_ends_stand_out(spark):
    r = random.Random(3)
    whole = ["招炒锅师傅，周末双休，包吃住", "招理货员，待遇从优，老板人好", "招司机，老板人好，周末双休", "招美甲师，包吃住，待遇从优"]
    rows = [(i, r.choice(whole)) for i in range(400)] + [(1000, "招炒锅师傅，周末双"), (1001, "招司机，老板人"), (1002, "招炒锅师傅，"), (1003, "招理货员，待遇�"), (1004, None), (1005, ""), (1006, "好"), (1000, "招炒锅师傅，周末双")]
    df = spark.createDataFrame(rows, "row_id long, text string").withColumn("src_table", F.lit("t")).withColumn("source", F.lit("s")).withColumn("cut", F.lit("clash"))
    got = {x["row_id"] for x in truncation.judge_truncation(df).where("cut").collect()}
    assert got == {1000, 1001, 1002, 1003}
    rates = truncation.truncation_rates(truncation.judge_truncation(df)).first()
    assert rates["rows"] >= 400 and rates["cut_share"] > 0
    assert truncation.judge_truncation(df.limit(0)).count() == 0


# --- main body


PAGE = "<html><body><div class='menu'><a href='/1'>首页</a> <a href='/2'>招聘</a></div><div class='wrap'><h1 class='job-title'>马德里招<em>炒锅</em>师傅</h1><div class='job-meta'>薪资：1200到1350</div><div class='job-meta'>发布&nbsp;2026-03-20</div><div class='job-desc'><p>月港食府在马德里招炒锅师傅2名，能吃苦者先谈。店面不大，没有杂事。</p></div></div><div class='rel'><h4>相关职位</h4><div class='item'><a href='/j'>巴塞罗那招司机</a><span>3分钟前</span></div></div><div class='ft'>© 2024 版权所有 · 关于我们</div><div style='display:none'>月港食府在马德里</div><script>var x='<p>no</p>'</script></body></html>"


def test_copies_do_not_decide_what_is_cut(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfghjklp") for _ in range(r.randrange(3, 9)))
    whole = [(i, "a", f"{word()} {word()} mantenimiento {word()} {word()}.") for i in range(300)]
    cut_copies = [(1000 + i, "a", "Zq mant") for i in range(6)]
    popular = [(2000 + i, "b", "xyzw vuts rqon eaea ieie aoao ueue ouou iaia uiui") for i in range(40)]
    varied = [(3000 + i, "b", f"{word()} {word()} {word()}.") for i in range(300)]
    ended = [(4000 + i, "c", (f"{i} " + word() * 9)[:29] + ".") for i in range(40)]
    df = spark.createDataFrame(whole + cut_copies + popular + varied + ended, "row_id long, source string, text string").withColumn("src_table", F.lit("t"))
    got = {x["row_id"] for x in truncation.judge_truncation(df).where("cut").collect()}
    assert got == {i for i, _, _ in cut_copies}



def test_blocks_split_at_block_tags():
    b = [x.squeezed for x in blocks.leaf_blocks("<p>a <b>b</b><br>c<td>d&nbsp;e</td><!-- <p>x</p> --><script>y</script>f")]
    assert b == ["ab", "c", "de", "f"]
    assert blocks.leaf_blocks("") == [] and blocks.leaf_blocks("<div></div>") == []


def test_main_body_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (1, PAGE)], "id long, raw_html string").withColumn("pos", F.lit("clash"))
    got = {r["text"] for r in blocks.main_blocks(pages).collect()}
    assert got == {"马德里招炒锅师傅", "薪资：1200到1350", "发布\xa02026-03-20", "月港食府在马德里招炒锅师傅2名，能吃苦者先谈。店面不大，没有杂事。"}
    assert blocks.main_blocks(pages.limit(0)).count() == 0


def test_backpropagation_matches_differences():
    from carda.llm import blocks_training as T

    m = blocks.new_model(1)
    feats = [blocks.features(blocks.leaf_blocks(PAGE)), blocks.features(blocks.leaf_blocks(PAGE)[:3])]
    x, mask = blocks.inputs(m, feats)
    kept: list = []
    out = blocks.lstm(x, mask, m["Wf"], m["cf"], kept)
    weight = np.random.default_rng(0).normal(size=out.shape).astype(np.float32) * mask[..., None]
    grad = {"Wf": np.zeros_like(m["Wf"]), "cf": np.zeros_like(m["cf"])}
    T._back(x, kept, weight, m["Wf"], grad, "f")
    for at in ((3, 5), (40, 70), (50, 100)):
        w = m["Wf"].astype(np.float64)
        step = 1e-3
        up, down = w.copy(), w.copy()
        up[at] += step
        down[at] -= step
        f = lambda v: float((blocks.lstm(x, mask, v.astype(np.float32), m["cf"]) * weight).sum())
        assert grad["Wf"][at] == pytest.approx((f(up) - f(down)) / (2 * step), abs=2e-2)


# --- wrong encodings


def test_garbled_rows_are_found_and_restored(spark):
    clean = ["马德里大市场对面的店诚请厨师，要求能吃苦，五年经验更好。", "Se busca cocinero en Málaga, con nociones de chino y tres años de oficio.", "月底统一回复，每周休两天，不收中介费，也不押工资。"]
    rows = [(i, clean[i % 3]) for i in range(300)]
    bad = {
        900: (clean[0].encode().decode("latin-1"), clean[0]),
        901: (clean[1].encode().decode("latin-1"), clean[1]),
        902: (clean[0].encode("gb18030").decode("latin-1"), clean[0]),
        903: (clean[2][:8] + clean[2][8:].encode().decode("cp437"), clean[2]),
        904: (clean[0].encode("gb18030").decode("utf-8", "replace"), None),
    }
    fine = [(950, "NÃO FUMADORES, período da manhã, São João."), (951, "Объявление для соседей: ищем помощника."), (952, None), (953, ""), (954, "月底统一回复，每周休两�")]
    df = spark.createDataFrame(rows + [(k, v[0]) for k, v in bad.items()] + fine, "row_id long, text string").withColumn("src_table", F.lit("t")).withColumn("source", F.when(F.col("row_id") % 2 == 0, F.lit("s"))).withColumn("gains", F.lit("clash"))
    got = {r["row_id"]: r["restored"] for r in mojibake.find_garbled(df).collect()}
    assert set(got) == set(bad)
    assert all(got[k] == v[1] for k, v in bad.items())
    assert mojibake.find_garbled(df.limit(0)).count() == 0


def garbled_in_places(r):
    """Clean texts with stretches that some chain was gone through, once or twice, between long plain ones."""
    clean = ["马德里大市场对面的店诚请厨师，要求能吃苦。", "Se busca cocinero en Málaga, con nociones de chino y tres años de oficio.", "<p class='x'>?~ 0�9</p>"]
    for wrong, right in mojibake.CHAINS:
        for turns in (1, 2):
            bad = r.choice(clean[:2])[: r.randrange(3, 30)]
            for _ in range(turns):
                bad = bad.encode(right, "replace").decode(wrong, "replace")
            yield r.choice(clean) + "plain " * r.randrange(9) + bad + r.choice(["", "ab", "?", " 12 " * 5]) + bad[:3] + "Å0ä9" + r.choice(clean)


def test_gains_weigh_only_what_is_not_plain(monkeypatch):
    texts = list(garbled_in_places(random.Random(4)))
    model = mojibake.character_model({c: 9 for c in "马德里大市场对面的店诚请厨师，要求能吃苦。áñ " + "abcdefghilmnoprstuv"})
    whole = mojibake._Repairer(model)
    want = [[whole.undo_deep(t, *c)[1] for c in mojibake.CHAINS] for t in texts]
    assert sum(g > 0 for x in want for g in x) > len(texts)
    seen, narrow = [], mojibake._Repairer._narrow
    monkeypatch.setattr(mojibake._Repairer, "_narrow", lambda self, text, *c: seen.append(text) or narrow(self, text, *c))
    r = mojibake._Repairer(model)
    assert np.allclose([r.gains(t) for t in texts], want, rtol=1e-12)
    assert not any("plain" in t for t in seen)


def test_signs_are_searched_without_plain_text(monkeypatch):
    texts = list(garbled_in_places(random.Random(5)))
    seen, trades = [], mojibake._trades
    monkeypatch.setattr(mojibake, "_trades", lambda cp, *x: seen.append(len(cp)) or trades(cp, *x))
    got = mojibake.could_be(texts + ["plain " * 10_000, "plain " * 10_000 + "é"]).tolist()
    assert max(seen) < sum(map(len, texts)) + 100
    assert got == [bool(mojibake.could_be([t])[0]) for t in texts] + [False, False]


def test_frequent_garbling_does_not_pass_for_normal_text(spark):
    """A third of the rows garbled: their characters are frequent, yet whole texts, single sentences and long runs come back."""
    clean = ["马德里大市场对面的店诚请厨师，要求能吃苦，五年经验更好。", "Se busca cocinero en Málaga, con nociones de chino y tres años de oficio.", "月底统一回复，每周休两天，不收中介费，也不押工资。"]
    garble = lambda t: t.encode().decode("gb18030")
    whole = clean[2][:10] * 3 + clean[0][:12]
    part = clean[2] + "<br>" + garble(clean[0][:12])
    bad = [(1000 + i, garble(whole if i % 2 else clean[1])) for i in range(150)] + [(2000, part)]
    df = spark.createDataFrame([(i, clean[i % 3]) for i in range(300)] + bad, "row_id long, text string").withColumn("src_table", F.lit("t")).withColumn("source", F.lit("s"))
    got = {r["row_id"]: r["restored"] for r in mojibake.find_garbled(df).collect()}
    assert set(got) == {i for i, _ in bad}
    assert all(got[1000 + i] == (whole if i % 2 else clean[1]) for i in range(150))
    assert got[2000] == clean[2] + "<br>" + clean[0][:12]


# --- leaks


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(7)) for _ in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(60))) for i in range(6)]
    filler = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    w = items[0][1].split()
    docs = [
        (1, filler(200) + " " + items[0][1].upper() + " " + filler(100)),
        (2, filler(50) + " " + " ".join(w[:40]) + " " + filler(50)),
        (3, filler(50) + " " + " ".join(w[:20]) + " " + filler(50)),
        (4, " ".join("otra" if i % 6 == 0 else x for i, x in enumerate(w))),
        (5, filler(400)),
        (6, None),
        (7, ""),
        (8, "<p>" + "<br/>".join(w[:30]) + "</p> insertado aquí <b>" + " ".join(w[30:]) + "</b>"),
    ]
    d = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame([*items, (9, items[1][1]), (10, ""), (11, None)], "item_id long, text string")
    got = {(x[0], x[1]) for x in leakage.leaked_items(d, e).collect()}
    code = lambda t: leakage.word_codes([t])[0].tolist()
    brute = {(i, k) for i, t in docs for k, x in items if t and leakage.holds_item(code(x), code(t))}
    assert got == brute == {(1, 0), (2, 0), (4, 0), (8, 0)}
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0


def test_common_run_equals_the_table():
    r = random.Random(2)
    for _ in range(50):
        a, b = [r.choice("abcd") for _ in range(r.randrange(1, 30))], [r.choice("abcd") for _ in range(r.randrange(0, 30))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert leakage.common_run(a, b) == t[-1, -1]


def test_automaton_reads_from_end_to_end():
    f = truncation.structure
    assert f("(contrato indefinido con todas las pagas incluidas y") == 1 and f("a (b) «c» <b>x</b> ¡Hola! ¿Sí?") == 0
    assert f("x (a [b c) d") == 0 and f("<b>negrita") == 1 and f("</b> x") == 0 and f("¡Hola") == 16
    assert f("x ...") == 4 and f("x &nbs") == 8 and f("x <a hre") == 8 and f("x \ufffd") == 2 and f("") == 0


def test_open_structures_and_missing_terminators_count_by_source(spark):
    """One source always closes and ends its values, the other never does: only the first one's odd value is cut."""
    rows = [(i, "tidy", f"Texto número {i} (con detalle) que acaba bien, de veras, en la calle {i * 7}.") for i in range(60)]
    rows += [(100 + i, "loose", f"- punto {i * 13} (sin cerrar, linea {i}") for i in range(60)]
    rows += [(900, "tidy", "Se ofrece puesto fijo (contrato indefinido con pagas incluidas y"), (901, "loose", "- otra cosa (sin cerrar del todo")]
    df = spark.createDataFrame(rows, "row_id long, source string, text string").withColumn("src_table", F.lit("t"))
    got = {r["row_id"]: (r["unclosed"], r["unended"], r["cut"]) for r in truncation.judge_truncation(df).collect()}
    assert got[900] == (True, True, True) and got[901][:2] == (False, False) and not got[0][2]


# --- history


def _jobs(spark):
    t = lambda d: dt.datetime(2026, 3, d)
    base = "月港食府在马德里大市场对面招炒锅师傅4名，能吃苦者先谈。店面不大，15平米，节奏偏快。不收中介费，也不押工资。每月7号准时发工资，从不拖欠。合同先签3个月，合适就转长期。"
    other = base.replace("月港食府", "千帆酒家")
    town = base.replace("马德里", "马拉加")
    far = "Se busca planchadora en Madrid, con letra clara y dos años de oficio; se paga el día 21 de cada mes y no se cobra comisión ni fianza alguna."
    rows = [
        (1, "yq", "http://a/1", "马德里月港食府招炒锅师傅", "月港食府有限公司", "Madrid", base, "6|", t(1)),
        (2, "lh", "http://b/2", "马德里月港食府招炒锅师傅，高薪", None, None, "急招！" + base, None, t(2)),
        (3, "lh", "http://b/3", "马德里千帆酒家招炒锅师傅", "千帆酒家", "Madrid", other, None, t(2)),
        (4, "lh", "http://b/4", "马拉加月港食府招炒锅师傅", "月港食府", "Málaga", town, "6|", t(3)),
        (5, "yq", "http://A/1/", "马德里月港食府招炒锅师傅", "月港食府", "Madrid", None, None, t(3)),
        (6, "yq", "http://c/6", "Planchadora", "Oromar 千帆", "Madrid", far, "7|", t(1)),
        (7, "yq", "http://c/7", "Planchadora", "★Oromar 千帆 Inversiones S.L.★急聘中", "Madrid", far.replace("dos", "tres"), "7|", t(4)),
        (8, "yq", "http://c/8", "x", None, None, "", None, t(4)),
        (9, "yq", None, None, None, None, base, None, t(2)),
        (9, "yq", None, None, None, None, base, None, t(2)),
    ]
    df = spark.createDataFrame(rows, "id long, source_site string, source_url string, title string, company string, city string, description string, contact_key string, collected_at timestamp_ntz")
    return df.withColumn("simhash", F.lit(None).cast("long")).withColumn("words", F.lit("clash"))


def _add_days(store, jobs, days):
    got = set()
    for day in days:
        batch = jobs.where(F.dayofmonth(F.col("collected_at").cast("timestamp")) == day)
        got |= {(min(r["id"], r["accepted_id"]), max(r["id"], r["accepted_id"])) for r in store.add_batch(batch, f"2026-03-{day:02d}").collect() if r["id"] != r["accepted_id"]}
    return got


def test_history_in_one_load_and_in_three(spark):
    reg = spark.createDataFrame(REGIONS, "id int, parent_id int, name string, level int")
    jobs = _jobs(spark)
    want = {(1, 2), (1, 5), (1, 9), (6, 7)}
    for loads in (1, 3):
        assert {(r[0], r[1]) for r in history.repeats(jobs, reg, loads).collect()} == want
    assert history.repeats(jobs.limit(0), reg).count() == 0


def test_history_survives_a_lost_load_and_a_retry(spark, tmp_path):
    """A load without decisions does not count; one given twice is answered, not added; a reopened store goes on."""
    reg = spark.createDataFrame(REGIONS, "id int, parent_id int, name string, level int")
    jobs = _jobs(spark)
    path = str(tmp_path / "store")
    store = history.HistoryStore(spark, path, reg, 8)
    first = _add_days(store, jobs, (1, 2))
    store._fs.delete(store._hadoop(f"{path}/load=2026-03-02/decisions"), True)
    store.close()
    again = history.HistoryStore(spark, path, reg, 16)
    assert again.buckets == 8 and again.loads() == ["2026-03-01"]
    assert _add_days(again, jobs, (2, 2, 3, 4)) | first == {(1, 2), (1, 5), (1, 9), (6, 7)}
    assert again.loads() == [f"2026-03-0{d}" for d in (1, 2, 3, 4)]
    again.close(discard=True)
    assert not (tmp_path / "store").exists() and not [t for t in spark.catalog.listTables() if t.name.startswith("history_")]


def test_rows_without_text_repeat_by_contact(spark):
    reg = spark.createDataFrame(REGIONS, "id int, parent_id int, name string, level int")
    t = dt.datetime(2026, 3, 1)
    rows = [(1, "u1", "Cocinero", None, None, None, "6|", 77, t), (2, "u2", "Cocinero", None, None, "", "6|", 77, t), (3, "u3", "Otro", None, None, "", "6|", 77, t), (4, "u4", "Cocinero", None, None, "", "7|", 77, t)]
    jobs = spark.createDataFrame(rows, "id long, source_url string, title string, company string, city string, description string, contact_key string, simhash long, collected_at timestamp_ntz")
    assert {tuple(r) for r in history.repeats(jobs, reg).collect()} == {(1, 2)}


def test_signatures_follow_similarity():
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(200)]
    near = base[:195] + [r.choice(words) for _ in range(5)]
    far = [r.choice(words) for _ in range(200)]
    k = history._band_keys([" ".join(base), " ".join(near), " ".join(far), " ".join(base), ""])
    assert (k[0] == k[3]).all() and (k[0] == k[1]).sum() >= 5 and not (k[0] == k[2]).any()
    one = history.shingle_hashes("a b c d e f")
    assert len(one) == 2 and set(one) <= set(history._shingles(["x y", "a b c d e f"], 5)[0].tolist())
    assert history.containment("a b c d", "a b c d e") == 1.0 and history.containment("", "a") == 0.0
