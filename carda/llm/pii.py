"""Personal items in free text, found by a semi-Markov conditional random field and replaced by typed placeholders.

Candidate segments of bounded length are proposed for every type. Whole-span features (shape, length, checks, words of
the span, words around it) score each, and dynamic programming over the candidates of a text picks boundaries and
types jointly; text between chosen segments is the background, whose segments score zero. The weights in
``pii_model.json`` are fitted by ``carda.llm.pii_training``.

Defined cases: null texts have no items and stay null; empty texts stay empty; a text of any length is read whole; of
equally scored segmentations the one with the earlier, longer segment is taken; repeated rows are treated alike; empty
tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carda.functions.chars import SIMPLIFIED, TRADITIONAL

TYPES = ("phone", "email", "id_number", "address", "name")
#: Longest segment of each type, in code points.
MAX_SPAN = {"phone": 30, "email": 90, "id_number": 30, "address": 70, "name": 50}

_NARROW = str.maketrans(TRADITIONAL, SIMPLIFIED)
_NARROW.update({c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)})
_NARROW.update({0x3000: 32, 0xA0: 32})
for _c in (0xFF0C, 0xFF1A, 0xFF01, 0xFF1F, 0xFF1B, 0xFF08, 0xFF09):  # sentence punctuation keeps its width
    _NARROW.pop(_c)

_TO_NARROW = re.compile("[" + re.escape("".join(map(chr, _NARROW))) + "]")

# Digits, surnames and forms of address of Chinese, street words of Spanish and Chinese.
HAN_DIGITS = "零〇一二三四五六七八九"
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷黎史龙陶贺顾毛郝龚邵万钱严覃武莫孔向汤项季麻"
ADDRESS_FORMS = "先生|女士|小姐|经理|师傅|老板|哥|姐|叔|姨|总"
STREETS_ES = r"calle|c/|cl\.|avda\.?|avenida|av\.|plaza|pza\.?|paseo|pº|ctra\.?|carretera|camino|travesía|travesia|ronda|rambla|glorieta|callejón|cuesta|urbanización"
STREETS_ZH = "大街|大道|街|路|巷|弄|胡同"

_UP = "A-ZÁÉÍÓÚÜÑÇ"
_LOW = "a-záéíóúüñç"
_L = _UP + _LOW
_FINDER = re.compile(
    rf"(?P<mail>(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]+ ?(?:@|\(at\)|\[at\]|\(arroba\)|\[arroba\]|\barroba\b) ?[A-Za-z0-9-]+(?:(?: ?(?:\.|\(punto\)|\[punto\]|\(dot\)|\bpunto\b) ?)[A-Za-z0-9-]+)+)"
    rf"|(?P<num>(?<![A-Za-z0-9_@])(?:\+ ?|[XYZxyz][ -]?(?=\d)|[A-Z]{{1,2}}(?=\d))?\d(?:[ .\-/·]{{0,2}}(?:\d|[Xx](?![a-z]))){{5,24}}(?:[ -]?[A-Za-z](?![{_L}\d]))?)"
    rf"|(?P<han>[{HAN_DIGITS}]{{8,}})"
    rf"|(?P<es>(?=[cCaApPtTrRgGuU])(?<![{_L}])(?i:{STREETS_ES}) ?(?:[{_L}'ºª]+,? ){{1,6}}?(?:(?:n[úu]m\.?|nº|n\.º|km\.?) ?\d+|\d+(?!\d)|s/n))(?P<tail>(?:, ?(?:\d+º(?: ?[A-Z]\b)?|bajo|local \d+|ático|piso \d+))*)"
    rf"|(?P<zh>(?:{STREETS_ZH})\d{{1,4}}号(?:底铺|\d{{1,2}}楼|\d{{1,4}}室)?)"
    rf"|(?P<hon>(?<![前一])[{SURNAMES}](?:{ADDRESS_FORMS}))"
    rf"|(?P<lat>(?<![{_L}\d])[{_UP}][{_L}'-]*(?: (?:de |del |la |de la )?[{_UP}][{_L}'-]*){{0,3}})"
    rf"|(?<=[^一-鿿])(?P<nick>[小老阿][{SURNAMES}](?![一-鿿]))"
    rf"|(?P<cue>负责人|联系人|请问|店找|找|老板|店主|我是|我叫)[ :：]*(?P<zname>[{SURNAMES}小老阿][一-鿿]{{1,3}})"
)
_EDGE = "，。！？、；：,.;:!?()（） \n\t"
_CUE_WORD = re.compile(rf"([一-鿿]{{1,3}}|[{_L}/]+)[^{_L}一-鿿\d]*$")


def narrow(text: str) -> str:
    """Full-width letters, digits and signs to ASCII and traditional characters to simplified, position by position."""
    return text.translate(_NARROW) if _TO_NARROW.search(text) else text


@lru_cache(maxsize=200_000)
def _shape(s: str) -> str:
    out: list[str] = []
    for ch in s:
        k = "9" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.islower() else "汉" if "一" <= ch <= "鿿" else ch
        if not out or out[-1] != k or k == "9" and len(out) < 24:
            out.append(k)
    return "".join(out)


_NIE = {"X": "0", "Y": "1", "Z": "2"}


def _check(s: str) -> str:
    """Whether a control letter or digit fits, where the shape has one."""
    t = re.sub(r"[^0-9A-Za-z]", "", s).upper()
    if m := re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", t):
        return "nif" if "TRWAGMYFPDXBNJZSQVHLCKE"[int(_NIE.get(m[1], "") + m[2]) % 23] == m[3] else "nif?"
    if re.fullmatch(r"\d{17}[\dX]", t):
        w = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
        return "cn" if "10X98765432"[sum(int(c) * k for c, k in zip(t, w)) % 11] == t[17] else "cn?"
    if re.fullmatch(r"[A-Z]{1,2}\d{7}", t):
        return "pass"
    return "none"


def candidates(n: str) -> list[tuple[int, int, str]]:
    """(start, end, type) segments worth scoring, in order of start; ``n`` is the narrowed text."""
    out: list[tuple[int, int, str]] = []
    at, find = 0, _FINDER.search
    while m := find(n, at):
        kind = m.lastgroup
        a, b = m.span()
        at = b
        if kind == "mail":
            out.append((a, b, "email"))
        elif kind == "num":
            s = m[0]
            digits = sum(c.isdigit() for c in s)
            if digits >= 7:
                letters = s[0].isalpha() or s[-1].isalpha()
                if not letters and 8 <= digits <= 15:
                    out.append((a, b, "phone"))
                if s[0] != "+" and (letters or digits >= 8):
                    out.append((a, b, "id_number"))
                if s[-1].isalpha() and not s[0].isalpha() and digits <= 15:  # the letter may belong to what follows
                    out.append((a, a + len(s[:-1].rstrip(" -")), "phone"))
        elif kind == "han":
            out.append((a, b, "phone"))
        elif kind in ("es", "tail"):
            out.append((a, b, "address"))
        elif kind == "zh":
            for k in range(a - 1, max(-1, a - 6), -1):
                if not "一" <= n[k] <= "鿿":
                    break
                out.append((k, b, "address"))
        elif kind in ("hon", "nick"):
            out.append((a, b, "name"))
        elif kind == "zname":
            s, e = m.span("zname")
            for k in range(s + 2, e + 1):
                if k == e or n[k] in _EDGE or k - s >= 2:
                    out.append((s, k, "name"))
            at = s + 1 if find(n, s) is None else s + 2
        elif kind == "lat":
            before = n[a - 1] if a else "\n"
            first = m[0].split(" ", 1)[0]
            if before != "\n" and not (before == " " and n[max(0, a - 2) : a - 1] in (".", "!", "?", "。") and not re.search(r"(?:Sra?|D|Dña|Dª)\. $", n[max(0, a - 6) : a])):
                words = m[0].split(" ")
                if words[0] in ("D", "Sra", "Sr", "Dña", "Don", "Doña") and len(words) == 1:
                    continue
                e = a
                for k, w in enumerate(words):
                    e = e + len(w) + (1 if k else 0)
                    if w in ("de", "del", "la"):
                        continue
                    out.append((a, e, "name"))
            elif _given(first):
                out.append((a, b, "name"))
    return out


@lru_cache(maxsize=1)
def _given_names() -> frozenset[str]:
    return frozenset(load_model().get("given", ()))


def _given(word: str) -> bool:
    return word.lower() in _given_names()


def span_features(n: str, a: int, b: int, t: str) -> list[str]:
    """Whole-span features of segment n[a:b] as type ``t``."""
    s = n[a:b]
    left, right = n[max(0, a - 16) : a], n[b : b + 3]
    m = _CUE_WORD.search(left)
    cue = m[1].lower()[-8:] if m else "^" if not left.strip() else "#"
    f = [f"{t}|bias", f"{t}|c={cue}", f"{t}|l1={left[-1:] or '^'}", f"{t}|l3={left[-3:]}", f"{t}|r1={right[:1] or '$'}", f"{t}|r2={right[:2] or '$'}"]
    if t in ("phone", "id_number"):
        d = [c for c in s if c.isdigit() or c in HAN_DIGITS]
        sep = "".join(sorted({c for c in s if not c.isalnum() and c != "+"}))
        head = "+" if s[0] == "+" else "00" if s[:2] == "00" else s[0]
        f += [f"{t}|n={len(d)}", f"{t}|n={len(d)}&h={head}", f"{t}|sep={sep}", f"{t}|sh={_shape(s)}", f"{t}|k={_check(s)}", f"{t}|e={s[-1].isalpha()}", f"{t}|h2={s[:2]}"]
    elif t == "email":
        f.append(f"{t}|tld={re.split(r'[^a-z]+', s.lower())[-1]}")
    elif t == "address":
        f += [f"{t}|w={s.lower()[:3]}", f"{t}|sh={_shape(s)[:12]}", f"{t}|zh={s[:6] if s[0] >= '一' else ''}", f"{t}|len={min(9, len(s) // 4)}"]
    else:
        words = s.lower().split(" ")
        han = s[0] >= "一"
        f += [f"{t}|nw={len(words)}&han={han}&len={min(5, len(s)) if han else 0}", f"{t}|w0={words[0][:12] if not han else s[0]}", f"{t}|w9={words[-1][:12] if not han else s[-1]}", f"{t}|han={han}&c={cue}", f"{t}|sh={_shape(s)[:12]}", f"{t}|han={han}&r1={right[:1] or '$'}"]
        nxt = n[b + 1 : b + 2]
        if not han:
            f.append(f"{t}|given={_given(words[0])}")
            f.append(f"{t}|more={bool(right[:1] == ' ' and nxt.isupper())}")
    return f


def decode(cands: list[tuple[int, int, str]], scores: list[float]) -> list[int]:
    """Indices of the best non-overlapping candidates: Viterbi over segment ends."""
    order = sorted(range(len(cands)), key=lambda i: (cands[i][1], cands[i][0]))
    best: list[tuple[int, float, int, int]] = [(0, 0.0, -1, -1)]  # end, score, candidate, previous state
    for i in order:
        if scores[i] <= 0:
            continue
        a, b, _ = cands[i]
        k = len(best) - 1
        while best[k][0] > a:
            k -= 1
        total = best[k][1] + scores[i]
        if total > best[-1][1]:
            best.append((b, total, i, k))
    out, k = [], len(best) - 1
    while best[k][2] >= 0:
        out.append(best[k][2])
        k = best[k][3]
    return out[::-1]


class Tagger:
    def __init__(self, weights: dict[str, float]) -> None:
        self.w = weights

    def items(self, text: str) -> list[tuple[int, int, str]]:
        n = narrow(text)
        c = candidates(n)
        if not c:
            return []
        c = [x for x in c if x[1] - x[0] <= MAX_SPAN[x[2]]]
        get = self.w.get
        scores = [sum(get(f, 0.0) for f in span_features(n, *x)) for x in c]
        return [c[i] for i in decode(c, scores)]


@lru_cache(maxsize=1)
def load_model() -> dict:
    import pkgutil

    try:
        raw = pkgutil.get_data("carda.llm", "pii_model.json")
    except FileNotFoundError:
        raw = None
    return json.loads(raw) if raw else {}


def find_items(texts: DataFrame) -> DataFrame:
    """(src_table, row_id, text) -> (src_table, row_id, pii_type, start_pos, end_pos): one row per item."""
    weights = texts.sparkSession.sparkContext.broadcast(load_model()["weights"])  # fixed size, fitted beforehand

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Tagger(weights.value).items
        for pdf in batches:
            rows = [(s, i, t, a, b) for s, i, x in zip(pdf["src_table"], pdf["row_id"], pdf["text"]) for a, b, t in items(x)]
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "pii_type", "start_pos", "end_pos"])

    src = texts.select("src_table", "row_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return src.mapInPandas(tag, "src_table string, row_id long, pii_type string, start_pos int, end_pos int")


def mask_text(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with ``masked``: the column with every item replaced by its type in brackets."""
    weights = texts.sparkSession.sparkContext.broadcast(load_model()["weights"])

    @F.pandas_udf("string")
    def mask(series: pd.Series) -> pd.Series:
        items = Tagger(weights.value).items

        def one(x: str | None) -> str | None:
            if not x:
                return x
            out, at = [], 0
            for a, b, t in items(x):
                out += [x[at:a], f"[{t.upper()}]"]
                at = b
            return "".join([*out, x[at:]])

        return series.map(one, na_action="ignore")

    return texts.withColumn("masked", mask(F.col(column)))


def listing_texts(jobs: DataFrame, posts: DataFrame) -> DataFrame:
    """Job descriptions and post contents."""
    a = jobs.select(F.lit("jobs_clean").alias("src_table"), F.col("id").alias("row_id"), F.col("description").alias("text"))
    return a.unionByName(posts.select(F.lit("posts").alias("src_table"), F.col("id").alias("row_id"), F.col("content").alias("text")))
