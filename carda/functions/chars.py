"""Character-level folding as native expressions (``translate`` and ``regexp_replace`` stay in codegen)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII and the ideographic space, by rule.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "


def _accents() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii():
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


_ACC_FROM, _ACC_TO = _accents()

# Traditional characters of listing texts and their simplified forms.
TRADITIONAL = "會點個學單開東時來貨請間車馬試邊長節發崗門誠亞電羅裝驗經銀歲優兩處這師對員機們鐘過園場話業語動計價護維飲飮儲倉聯灣蘭務紅遠說譯賣農樓莊縫紉關錢國為後從兒區號圖書萬無與專廣應進還運達選邏續網線結給統總編羣義習聽職聲腦臺華葉藝衛補規視覺觀訂認設許論證識變讓負責費買貿資質趕較輕輛辦鄉醫錄鋪錦險際隨難頂順須領頭題顏願風飯餅館驅體魚鮮鳥麵黃齊齡頁燈爐煙熱獎現環產畢療發監盤礦禮種稅積"
SIMPLIFIED = "会点个学单开东时来货请间车马试边长节发岗门诚亚电罗装验经银岁优两处这师对员机们钟过园场话业语动计价护维饮饮储仓联湾兰务红远说译卖农楼庄缝纫关钱国为后从儿区号图书万无与专广应进还运达选逻续网线结给统总编群义习听职声脑台华叶艺卫补规视觉观订认设许论证识变让负责费买贸资质赶较轻辆办乡医录铺锦险际随难顶顺须领头题颜愿风饭饼馆驱体鱼鲜鸟面黄齐龄页灯炉烟热奖现环产毕疗发监盘矿礼种税积"


def fold_width(c: Column) -> Column:
    """Full-width ASCII, ideographic and no-break spaces to plain ASCII."""
    return F.translate(c, _WIDE, _NARROW)


def fold_accents(c: Column) -> Column:
    """Precomposed Latin letters to their base letter, combining marks dropped."""
    return F.regexp_replace(F.translate(c, _ACC_FROM, _ACC_TO), "[\\u0300-\\u036f]", "")


def fold_han(c: Column) -> Column:
    """Traditional characters of the fixed list to simplified ones."""
    return F.translate(c, TRADITIONAL, SIMPLIFIED)


def fold_text(c: Column) -> Column:
    """Width, case, accents and traditional forms folded: the comparison form of a listing text."""
    return fold_han(fold_accents(F.lower(fold_width(c))))


def fold_py(s: str) -> str:
    """The Python twin of :func:`fold_text`, for the small driver-side lists."""
    s = s.translate(str.maketrans(_WIDE, _NARROW)).lower().translate(str.maketrans(_ACC_FROM, _ACC_TO))
    return "".join(ch for ch in s if not "̀" <= ch <= "ͯ").translate(str.maketrans(TRADITIONAL, SIMPLIFIED))
