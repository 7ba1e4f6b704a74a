"""Text decoded with the wrong encoding: found and, where it can be had, restored.

A latent variable per record says which chain of wrong decodings it went through, or none. Character statistics of
the whole corpus say how likely a text and each of its possible restorations are; expectation-maximization over
(source, field, chain) rates pools the weak evidence of many records, and each record is judged and repaired by its
posterior.

Defined cases: null and empty texts are clean; a text whose characters are all common in the clean part of the corpus
is clean unless its bytes make a readable text in a chain's true encoding (:func:`could_be`); a single
replacement character where a field was cut is no wrong decoding; text lost beyond repair is reported with
``restored`` null; ties between chains go to the first of :data:`CHAINS`; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carda.session import cut

#: (wrong decoder, true encoding): the text was bytes of the true encoding, read with the wrong decoder.
CHAINS: tuple[tuple[str, str], ...] = (
    ("cp1252", "utf-8"),
    ("latin-1", "utf-8"),
    ("gb18030", "utf-8"),
    ("cp1252", "gb18030"),
    ("latin-1", "gb18030"),
    ("cp1252", "big5"),
    ("latin-1", "big5"),
    ("cp437", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp850", "utf-8"),
    ("cp1251", "utf-8"),
    ("koi8-r", "utf-8"),
    ("big5", "utf-8"),
    ("shift_jis", "utf-8"),
    ("mac_roman", "gb18030"),
    ("cp437", "gb18030"),
    ("gb18030", "big5"),
    ("big5", "gb18030"),
    ("iso8859-2", "utf-8"),
)
LOSSY = "lossy"
#: A character is common when it makes up this share of the corpus.
COMMON_SHARE = 2e-6
#: Characters never taken as common: C1 controls, the replacement character, private use, and the letters and signs
#: that only multi-byte text read as single bytes strews about.
_TELLTALE = re.compile("[\u0080-\u009f�-¡-ÿĀ-ɏͰ-ӿ─-▟]")
_SPANISH = set("áéíóúñüÁÉÍÓÚÑÜ¿¡ªº·«»°©®€")
#: Log probability of a character foreign to the corpus where it stands, and of one a restoration would bring in.
_FOREIGN, _INVENTED = -12.0, -25.0
#: How far a sum of gains may fall before a stretch is closed.
_MARGIN = 16
_MAX_CP = 0x110000
#: Rates stand still when none moves by more.
STILL = 2e-4
_BYTES_1252 = {0x81: "\x81", 0x8D: "\x8d", 0x8F: "\x8f", 0x90: "\x90", 0x9D: "\x9d"}
_BACK_1252 = {v: k for k, v in _BYTES_1252.items()}


def _char_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_MAX_CP, dtype=np.int64)
    for pdf in batches:
        joined = "".join(pdf["text"])
        if joined:
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            total += np.bincount(cp[cp < _MAX_CP], minlength=_MAX_CP)
    nz = np.nonzero(total)[0]
    yield pd.DataFrame({"cp": nz.astype("int32"), "n": total[nz]})


def character_counts(texts: DataFrame) -> dict[str, int]:
    """How often every character occurs. The result is bounded by the size of Unicode."""
    counts = texts.select("text").where("text is not null").mapInPandas(_char_counts, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {chr(r["cp"]): r["n"] for r in counts}


def character_model(counts: dict[str, int], without: dict[str, int] | None = None) -> dict[str, float]:
    """Log probability of every character, ``without`` the counts of texts that may be garbled, unless hardly any text is left."""
    clean = {c: n - (without or {}).get(c, 0) for c, n in counts.items()}
    if sum(clean.values()) < 0.05 * sum(counts.values()):
        clean = counts
    total = sum(clean.values()) or 1
    return {c: math.log(n / total) for c, n in clean.items() if n > 0}


def common_characters(model: dict[str, float]) -> str:
    bound = math.log(COMMON_SHARE)
    return "".join(sorted(c for c, p in model.items() if p >= bound and (c in _SPANISH or not _TELLTALE.match(c))))


def _encode(ch: str, codec: str) -> bytes | None:
    if ch == "\ufffd":
        return b"\xff"  # one or more bytes that are gone
    if codec == "cp1252" and ch in _BACK_1252:
        return bytes([_BACK_1252[ch]])
    try:
        return ch.encode(codec)
    except UnicodeError:
        return None


_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})")


#: One character of each true encoding, as bytes.
_ONE = {
    "utf-8": _UTF8.pattern,
    "gb18030": rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9])",
    "big5": rb"(?:[\x81-\xf9][\x40-\x7e\xa1-\xfe])",
}
#: Stretches of nothing but such characters; of UTF-8 also what is left of one whose last byte is gone.
_STRETCH = {e: re.compile(b"(?:" + one + b")+" + (rb"(?:[\xc2-\xf4][\x80-\xbf]{0,2}\xff)?" if e == "utf-8" else b"")) for e, one in _ONE.items()}
_WIDE = ("gb18030", "big5", "shift_jis")
_THREE = rb"(?:\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf])"
#: What follows the leading byte of a character of two bytes, of three, of any number.
_AFTER_2 = rb"(?<=[\xc2-\xdf])[\x80-\xbf]"
_AFTER_3 = rb"(?:(?<=\xe0)[\xa0-\xbf][\x80-\xbf]|(?<=[\xe1-\xec\xee\xef])[\x80-\xbf]{2}|(?<=\xed)[\x80-\x9f][\x80-\xbf])"
_AFTER = b"(?:" + _AFTER_2 + b"|" + _AFTER_3 + rb"|(?<=\xf0)[\x90-\xbf][\x80-\xbf]{2}|(?<=[\xf1-\xf3])[\x80-\xbf]{3})"
#: Bytes of a wide codec that can be UTF-8: some characters in a row, or one with no other high byte around it. The
#: search runs from leading byte to leading byte.
_WIDE_HINT = re.compile(rb"(?s)[\xc2-\xf4](?:" + _AFTER_3 + _THREE + b"|" + _AFTER_2 + rb"(?:[\xc2-\xdf][\x80-\xbf]){5}|(?<![\x80-\xff?].)" + _AFTER + _ONE["utf-8"] + rb"*(?![\x80-\xff?]))")
_NARROW = re.compile("[\x00-\u2e7f]+")
#: Chains of decoders that read bytes one by one, and the longest part of a text whose steps are kept.
_NARROW_AT, _SHORT = [i for i, (w, _) in enumerate(CHAINS) if w not in _WIDE], 16
#: All that single bytes read as other than ASCII, and where two such characters stand together, one letter between at most.
_LOW = "\x80-\u2e7f\uf8ff\ufb01\ufb02"
_LOW_PAIR = re.compile(f"[{_LOW}][@-~]?[{_LOW}]")
_LOW_PARTS = re.compile(f"(?:[{_LOW}\ufffd][\x00-\x7f]{{0,2}})+")
_ASCII = re.compile("[\x00-\x7f]+")
_PLAIN = re.compile("([\x00-\x7f])[\x00-\x7f]+([\x00-\x7f])")
#: Other characters than ASCII with the ASCII that may be part of two-byte ones.
_WHOLE = re.compile("(?s).+")
_SEGMENT = re.compile("(?:[^\x00-\x7f][\x00-\x7f]{0,2})+")


def _byte_char(byte: int, codec: str) -> str:
    if codec == "cp1252" and byte in _BYTES_1252:
        return _BYTES_1252[byte]
    return bytes([byte]).decode(codec, "ignore")


class _Bytes(dict):
    """Characters to the byte a one-byte decoder reads them from; a line end for those it never makes."""

    def __missing__(self, cp: int) -> int:
        self[cp] = cp if cp < 0x80 else 0x0A
        return self[cp]


@lru_cache(maxsize=len(CHAINS))
def _byte_table(codec: str) -> _Bytes:
    out = _Bytes({0xFFFD: 0xFF})  # one or more bytes that are gone
    for byte in range(0x80, 0x100):
        if len(ch := _byte_char(byte, codec)) == 1:
            out.setdefault(ord(ch), byte)
    return out


def _class(codec: str, lo: int, hi: int) -> str:
    return re.escape("".join(_byte_char(x, codec) for x in range(lo, hi)))


def _single_hint(wrong: str, right: str) -> re.Pattern:
    if right == "utf-8":
        return re.compile(f"[{_class(wrong, 0xC2, 0xF5)}][{_class(wrong, 0x80, 0xC0)}]")
    high = _class(wrong, 0x81, 0xFF)
    return re.compile(f"[{high}][@-~{high}]")


#: A text without such a place cannot be the output of a chain that reads bytes one by one.
_HINTS = {(w, e): _single_hint(w, e) for w, e in CHAINS if w not in _WIDE}
#: Two characters in a row, which clean accented text hardly has.
_TWICE = {c: re.compile(f"(?:{h.pattern}){{2}}") for c, h in _HINTS.items() if c[1] != "utf-8"}


def possible_characters(counts: dict[str, int]) -> frozenset[str]:
    """Characters that can be common in any character model made of ``counts``, which keeps at least a twentieth of them."""
    bound = 0.05 * COMMON_SHARE * sum(counts.values())
    return frozenset(c for c, n in counts.items() if n >= bound and (c in _SPANISH or not _TELLTALE.match(c)))


def _without_plain(joined: str) -> tuple[str, np.ndarray]:
    """The joined texts and their code points without the ASCII that no sign of a chain reaches: two characters on
    either side of others stay, and the ends of the texts."""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = cp >= 0x80
    keep = high | (cp == 0)
    for n in (1, 2):
        keep[n:] |= high[:-n]
        keep[:-n] |= high[n:]
    cp = cp[keep]
    return cp.tobytes().decode("utf-32-le", "surrogatepass"), cp


def could_be(texts: list[str], possible: frozenset[str] | None = None) -> np.ndarray:
    """Whether the bytes of some chain make a readable text: a cheap test, which clean texts may pass, too.

    Two wide codecs read each other's bytes nearly always; of them the leading bytes must be those of frequent
    characters in the true encoding and not in the wrong one. Text that was lost counts, too. A stretch none of whose
    characters is in ``possible`` is no likelier undone, so it is no sign; the texts of a batch are searched together.
    """
    out = np.zeros(len(texts), bool)
    if not len(texts):
        return out
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
    if joined.isascii():
        return out
    joined, cp = _without_plain(joined)
    ends = np.flatnonzero(cp == 0)
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(cp == 0xFFFD))):
        out[i] = lossy_evidence(texts[i]) > 0
    pairs = np.fromiter((m.start() for m in _LOW_PAIR.finditer(joined)), np.int64)
    for i in np.unique(np.searchsorted(ends, pairs)):
        if not out[i]:
            t = _PLAIN.sub(r"\1 \2", texts[i])
            out[i] = any((_TWICE.get(c) or h).search(t) for c, h in _HINTS.items())
    # a question mark stands for what the codec does not have
    masked = joined.replace("\ufffd", " ").replace("?", " ")
    for wrong in _WIDE:
        raw = masked.encode(wrong, "replace")
        nul = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
        hits = np.fromiter((m.start() for m in _WIDE_HINT.finditer(raw) if possible is None or not possible.isdisjoint(m[0].decode("utf-8", "ignore"))), np.int64)
        out[np.searchsorted(nul, hits)] = True
    starts = np.concatenate(([0], ends[:-1] + 1))
    for wrong, right in CHAINS:
        if wrong in _WIDE and right != "utf-8":
            out |= _trades(cp, starts, wrong, right)
    return out


def _wide_hint(text: str, wrong: str) -> bool:
    return _WIDE_HINT.search(text.replace("\ufffd", " ").replace("?", " ").encode(wrong, "replace")) is not None


#: Leading bytes of the frequent characters.
_FREQUENT = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6)}


@lru_cache(maxsize=4)
def _leads(codec: str) -> np.ndarray:
    """Leading byte of every character of a two-byte codec, 0 for all others and for narrow ones."""
    out = np.zeros(0x10001, np.uint8)
    for cp in range(0x2E80, 0x10000):
        if not 0xD800 <= cp <= 0xDFFF and len(b := chr(cp).encode(codec, "ignore")) == 2:
            out[cp] = b[0]
    return out


def _trades(cp: np.ndarray, starts: np.ndarray, wrong: str, right: str) -> np.ndarray:
    """Of every text, whether its leading bytes are those of the true encoding rather than the wrong one's."""
    lead = _leads("gbk" if wrong == "gb18030" else wrong)[np.minimum(cp, 0x10000)]
    n = np.add.reduceat((lead > 0).astype(np.int64), starts)
    either = (lead >= 0xA1) & (lead <= 0xA3)
    share = {e: np.add.reduceat(((lead >= lo) & (lead <= hi) | either).astype(np.int64), starts) / np.maximum(n, 1) for e, (lo, hi) in _FREQUENT.items()}
    return (n >= 2) & (share[right] > 0.8) & (share[wrong] < 0.7)


class _Scores(dict):
    """Log probabilities of common characters; any other counts as rare."""

    def __init__(self, scores: dict[str, float], rare: float) -> None:
        super().__init__(scores)
        self.rare = rare

    def __missing__(self, ch: str) -> float:
        return self.rare


class _Repairer:
    """Undoes one chain in every maximal stretch it could have garbled, where the result is likelier than what stands."""

    def __init__(self, model: dict[str, float]) -> None:
        self.model = model
        self.foreign, self.invented = (_Scores({c: model[c] for c in common_characters(model)}, rare) for rare in (_FOREIGN, _INVENTED))
        self.byte: dict[str, dict[str, bytes | None]] = {w: {} for w, _ in CHAINS}
        self.steps: dict[str, dict[tuple[str, bytes], tuple[str, float]]] = {e: {} for _, e in CHAINS}
        self.judged: dict[tuple[str, str], dict[str, tuple[str, float]]] = {c: {} for c in CHAINS}
        self.single: dict[tuple[str, str], dict[str, float]] = {c: {} for c in CHAINS}
        self.parts: dict[str, list[tuple[int, list[tuple[bool, float]]]]] = {}

    def score(self, s: str, rare: float) -> float:
        return sum(map((self.foreign if rare == _FOREIGN else self.invented).__getitem__, s))

    def gains(self, text: str) -> list[float]:
        """The gain of undoing each chain, as :meth:`undo_deep` has it."""
        out = [0.0] * len(CHAINS)
        # decoders of single bytes made nothing outside these parts, and no stretch reaches from one into another
        sums: dict[int, list[list]] = {}
        for part in _LOW_PARTS.findall(text):
            for i, steps in self._part_steps(part):
                for total, (hinted, gain) in zip(sums.setdefault(i, [[False, 0.0] for _ in range(3)]), steps):
                    total[0] |= hinted
                    total[1] += gain
        for i, steps in sums.items():
            for hinted, gain in steps:
                if not hinted or gain <= 0:
                    break
                out[i] += gain
        plain, high = _PLAIN.sub(r"\1 \2", text), _ASCII.sub("", text)
        for i, (w, e) in enumerate(CHAINS):
            if w in _WIDE and (_wide_hint(plain, w) if e == "utf-8" else self._bound(high, w, e) > -_FOREIGN):
                out[i] = self.undo_deep(text, w, e)[1]
        return out

    def _part_steps(self, part: str) -> list[tuple[int, list[tuple[bool, float]]]]:
        """Of every chain that shows in a part: whether it does and what undoing it gains, once, twice and three times.

        Any part may show that a text is a chain's output; the other parts gain from that, too.
        """
        known = self.parts.get(part)
        if known is None:
            known = []
            for i in _NARROW_AT:
                wrong, right = CHAINS[i]
                x, steps = part, []
                while len(steps) < 3:
                    hinted, gain = self._hinted(x, wrong, right), 0.0
                    if hinted or right == "gb18030":  # its characters of four bytes are no sign
                        x, gain = self._narrow(x, wrong, right)
                    steps += [(hinted, gain)] * (1 if gain else 3 - len(steps))
                if any(hinted or gain for hinted, gain in steps):
                    known.append((i, steps))
            if len(part) <= _SHORT:
                if len(self.parts) > 100_000:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def restore(self, text: str, wrong: str, right: str) -> str:
        return self.undo_deep(text, wrong, right)[0]

    def _runs(self, text: str, wrong: str, right: str) -> Iterator[tuple[int, int, bytes, list[int]]]:
        """Maximal stretches the wrong decoder could have produced: their bytes and where each character's begin."""
        memo = self.byte[wrong]
        # two wide codecs are weighed over the whole text, the others where it is not plain
        for m in (_WHOLE if right != "utf-8" else _SEGMENT).finditer(text):
            start, parts = m.start(), []
            for i, ch in enumerate(m[0], start):
                if ch in memo:
                    b = memo[ch]
                else:
                    b = memo[ch] = _encode(ch, wrong)
                if b is None:
                    if parts:
                        yield start, i, b"".join(parts), list(accumulate(map(len, parts), initial=0))
                    start, parts = i + 1, []
                else:
                    parts.append(b)
            if parts:
                yield start, m.end(), b"".join(parts), list(accumulate(map(len, parts), initial=0))

    def undo(self, text: str, wrong: str, right: str) -> tuple[str, float]:
        """The text with the chain undone and the gain in log likelihood."""
        if text.isascii() or not self._hinted(text, wrong, right):
            return text, 0.0
        if wrong not in _WIDE:
            return self._narrow(text, wrong, right)
        if right != "utf-8" and self._bound(text, wrong, right) <= -_FOREIGN:
            return text, 0.0
        out, at, gain = [], 0, 0.0
        for i, j, raw, begin in self._runs(text, wrong, right):
            piece = text[i:j]
            if piece.isascii():
                continue
            fixed, g = self._wide(piece, raw, begin, right) if right != "utf-8" else self._stretches(piece, raw, begin, wrong, right)
            if g > 0:
                out += [text[at:i], fixed]
                at, gain = j, gain + g
        return "".join([*out, text[at:]]), gain

    def _narrow(self, text: str, wrong: str, right: str) -> tuple[str, float]:
        """A decoder of single bytes undone in every stretch that is valid in the true encoding, each judged as a whole."""
        raw = text.translate(_byte_table(wrong)).encode("latin-1")
        memo = self.judged[wrong, right]
        out, at, gain = [], 0, 0.0
        for m in _STRETCH[right].finditer(raw):
            a, b = m.span()
            old = text[a:b]
            known = memo.get(old)
            if known is None:
                if len(memo) > 100_000:
                    memo.clear()
                known = memo[old] = self._weigh(old, m[0], b"", b"", wrong, right)
            if known[1] > 0:
                out += [text[at:a], known[0]]
                at, gain = b, gain + known[1]
        return "".join([*out, text[at:]]), gain

    def _weigh(self, old: str, body: bytes, head: bytes, tail: bytes, wrong: str, right: str) -> tuple[str, float]:
        """A stretch read in the true encoding and what that gains; the bytes around it stay as they were read."""
        if right == "utf-8" and body[-1:] == b"\xff":
            body = re.sub(rb"[\xc2-\xf4][\x80-\xbf]{0,2}\xff$", b"\xef\xbf\xbd", body)
        new = self._back(head) + body.decode(right, "replace") + self._back(tail)
        g = self.score(new.replace("\ufffd", ""), _INVENTED) - self.score(old.replace("\ufffd", ""), _FOREIGN)
        g += _INVENTED * max(0, new.count("\ufffd") - old.count("\ufffd"))
        if g <= 0:  # garbled twice, the text is no likelier after one step
            new, more = self.undo(new, wrong, right)
            g += more
        return new, g

    @staticmethod
    def _hinted(text: str, wrong: str, right: str) -> bool:
        if wrong not in _WIDE:
            return _HINTS[wrong, right].search(text) is not None
        return right != "utf-8" or _wide_hint(text, wrong)

    def _bound(self, text: str, wrong: str, right: str) -> float:
        """The most any stretch of the text can gain by trading two wide codecs: its largest sum of single gains."""
        known, memo = self.single[wrong, right], self.byte[wrong]
        for ch in set(text).difference(known):
            b = memo[ch] if ch in memo else memo.setdefault(ch, _encode(ch, wrong))
            known[ch] = -math.inf if b is None else self._step(ch, b, right)[1]
        best = total = 0.0
        for g in map(known.__getitem__, text):
            total += g
            if total < 0.0:
                total = 0.0
            elif total > best:
                best = total
        return best

    def _step(self, ch: str, b: bytes, right: str) -> tuple[str, float]:
        x = ch if ch.isascii() else b.decode(right, "replace")
        return x, 0.0 if x == ch else self.score(x, _INVENTED) - self.score(ch, _FOREIGN)

    def _stretches(self, piece: str, raw: bytes, begin: list[int], wrong: str, right: str) -> tuple[str, float]:
        """Each stretch of a wide codec's bytes that is valid in the true encoding, judged as a whole."""
        out, at, gain = [], 0, 0.0  # at: characters of the piece that are done
        for m in _STRETCH[right].finditer(raw):
            # chance hits amid clean text: a short one must have no other high byte around it
            if m.end() - m.start() < 6 and (raw[m.start() - 1 : m.start()] > b"\x7f" or b"\x7f" < raw[m.end() : m.end() + 1] < b"\xff"):
                continue
            a, b = bisect_right(begin, m.start()) - 1, bisect_left(begin, m.end())
            if a < at:
                continue
            # bytes of the outer characters that do not belong to the stretch
            new, g = self._weigh(piece[a:b], m[0], raw[begin[a] : m.start()], raw[m.end() : begin[b]], wrong, right)
            if g > 0:
                out += [piece[at:a], new]
                at, gain = b, gain + g
        return "".join([*out, piece[at:]]), gain

    @staticmethod
    def _back(half: bytes) -> str:
        return half.decode("ascii", "replace")

    def _wide(self, piece: str, raw: bytes, begin: list[int], right: str) -> tuple[str, float]:
        """Two-byte codecs read each other's characters one for one, so the best stretches are found by their sums."""
        memo = self.steps[right]
        new, step = [], []
        for ch, i, j in zip(piece, begin, begin[1:]):
            known = memo.get((ch, raw[i:j]))
            if known is None:
                known = memo[ch, raw[i:j]] = self._step(ch, raw[i:j], right)
            new.append(known[0])
            step.append(known[1])
        out, at, gain, i = [], 0, 0.0, 0
        while i < len(step):
            if step[i] <= 0:
                i += 1
                continue
            total = best = 0.0
            end = j = i
            while j < len(step) and total >= 0 and total > best - 2 * _MARGIN:
                total += step[j]
                j += 1
                if total > best:
                    best, end = total, j
            if best > -_FOREIGN:  # less is chance
                out += [piece[at:i], *new[i:end]]
                at, gain = end, gain + best
            i = max(end, i + 1)
        return "".join([*out, piece[at:]]), gain

    def undo_deep(self, text: str, wrong: str, right: str) -> tuple[str, float]:
        """The chain may have been gone through more than once."""
        fixed, gain = self.undo(text, wrong, right)
        for _ in range(2):
            if gain <= 0:
                break
            again, more = self.undo(fixed, wrong, right)
            if more <= 0:
                break
            fixed, gain = again, gain + more
        return fixed, gain


#: A replacement character where a value was cut: before the end, a tag or the site's name.
_CUT_MARK = re.compile("�(?=$|<|\"| - )")


def lossy_evidence(text: str) -> float:
    """Replacement characters that no cut explains, as log evidence for a decoding that lost text."""
    n = text.count("�") - len(_CUT_MARK.findall(text))
    return 6.0 * n if n > 1 else (3.0 if n == 1 else 0.0)


def chain_evidence(suspects: DataFrame, model: dict[str, float]) -> DataFrame:
    """(..., gains array<double>): log likelihood gain of undoing each chain, the last for lossy decoding."""
    shared = suspects.sparkSession.sparkContext.broadcast(model)  # bounded by the size of Unicode

    @F.pandas_udf("array<double>")
    def gains(texts: pd.Series) -> pd.Series:
        r = _Repairer(shared.value)
        return pd.Series([[*r.gains(t), lossy_evidence(t)] for t in texts])

    return suspects.withColumn("gains", gains("text"))


def _likelihoods(rate_col: str):
    """log(rate_k) + gain_k for each chain with a gain; the largest is taken out before anything is exponentiated."""
    return F.zip_with("gains", rate_col, lambda g, r: F.when(g > 0, g + F.log(r)).otherwise(F.lit(-1e9)))


def find_garbled(texts: DataFrame, rounds: int = 20, prior: float = 1e-3) -> DataFrame:
    """(src_table, row_id, source, text) -> (src_table, row_id, chain, posterior, restored) of the garbled rows.

    The clean character model starts without every text that could be a chain's output and is estimated once more
    without the texts judged garbled, so that frequent garbling does not pass for normal text. The rates are
    re-estimated until they stand still, ``rounds`` times at most.
    """
    texts = texts.select("src_table", "row_id", "source", "text")
    groups = texts.groupBy("src_table", "source").agg(F.count("*").alias("total"))
    k = len(CHAINS) + 1
    start = cut(groups.select("src_table", F.col("source").alias("rs"), "total", F.array(*[F.lit(prior / k)] * k).alias("rates")))
    held = texts.where(F.col("text").isNotNull() & (F.col("text") != ""))
    counts = character_counts(texts)
    known = texts.sparkSession.sparkContext.broadcast(possible_characters(counts))  # bounded by the size of Unicode
    hint = F.pandas_udf(lambda s: pd.Series(could_be(s.tolist(), known.value)), "boolean")
    flagged = cut(held.where(hint("text")))
    model = character_model(counts, character_counts(flagged))
    first = _judged(flagged, start, model, rounds, prior).where("p > 0.5")
    model = character_model(counts, character_counts(first))
    # and texts with characters that are not common, whatever their bytes make
    common = common_characters(model)
    left = F.translate("text", common, "") if common else F.col("text")
    final = _judged(flagged.unionByName(held.where(left != "").where(~hint("text"))), start, model, rounds, prior).where("p > 0.5")
    final = final.withColumn("k", F.array_position("post", F.array_max("post")) - 1)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def restore(texts: pd.Series, which: pd.Series) -> pd.Series:
        r = _Repairer(shared.value)
        return pd.Series([r.restore(t, *CHAINS[i]) if i < len(CHAINS) else None for t, i in zip(texts, which)])

    names = F.array(*[F.lit(f"{e} read as {w}") for w, e in CHAINS], F.lit(LOSSY))
    return final.select("src_table", "row_id", "source", names[F.col("k").cast("int")].alias("chain"), F.col("p").alias("posterior"), restore("text", F.col("k").cast("int")).alias("restored"))


def _judged(suspects: DataFrame, rates: DataFrame, model: dict[str, float], rounds: int, prior: float) -> DataFrame:
    """The suspected rows with the posterior of each chain, ``post``, and of all together, ``p``."""
    # a text no chain gains on is clean at any rates
    judged = cut(chain_evidence(suspects, model).where(F.exists("gains", lambda g: g > 0)))
    k = len(CHAINS) + 1
    same = (F.col("j.src_table") == F.col("r.src_table")) & F.col("j.source").eqNullSafe(F.col("r.rs"))

    def posterior(rates: DataFrame) -> DataFrame:
        x = judged.alias("j").join(F.broadcast(rates.alias("r")) if n_groups <= 100_000 else rates.alias("r"), same)
        x = x.select("j.*", "r.rates")
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
        clean = F.log(F.greatest(F.lit(1.0) - total("rates"), F.lit(1e-6)))
        # what is used for every chain is bound once, else Spark works it out again for each
        bound = lambda value, f: F.transform(F.array(value), f)[0]
        shares = lambda e, c: bound(F.struct(e.alias("e"), (c + total(e)).alias("z")), lambda s: F.transform(s["e"], lambda v: v / s["z"]))
        shifted = lambda s: bound(F.struct(F.transform(s["l"], lambda v: F.exp(v - s["m"])).alias("e"), F.exp(s["c"] - s["m"]).alias("c")), lambda t: shares(t["e"], t["c"]))
        top = lambda s: bound(F.struct(s["l"].alias("l"), s["c"].alias("c"), F.greatest(F.array_max(s["l"]), s["c"]).alias("m")), shifted)
        return x.withColumn("post", bound(F.struct(_likelihoods("rates").alias("l"), clean.alias("c")), top)).drop("rates")

    n_groups = rates.count()
    for _ in range(rounds):
        soft = posterior(rates).groupBy("src_table", "source").agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(k)])
        new = (
            rates.alias("r")
            .join(soft.alias("s"), (F.col("r.src_table") == F.col("s.src_table")) & F.col("r.rs").eqNullSafe(F.col("s.source")), "left")
            .select("r.src_table", "r.rs", "r.total", F.array(*[(F.coalesce(f"s.s{i}", F.lit(0.0)) + prior) / (F.col("r.total") + k * prior + 1) for i in range(k)]).alias("rates"), F.col("r.rates").alias("old"))
            .withColumn("moved", F.array_max(F.zip_with("rates", "old", lambda x, y: F.abs(x - y))))
            .drop("old")
        )
        rates = cut(new)
        if (rates.agg(F.max("moved")).first()[0] or 0.0) < STILL:
            break
    return posterior(rates).withColumn("p", F.aggregate("post", F.lit(0.0), lambda a, v: a + v))


def listing_texts(pages: DataFrame | None, jobs: DataFrame | None) -> DataFrame:
    """The fields to be judged: page markup and job descriptions, each with its source."""
    parts = []
    if pages is not None:
        parts.append(pages.select(F.lit("raw_pages").alias("src_table"), F.col("id").alias("row_id"), F.col("source_site").alias("source"), F.col("raw_html").alias("text")))
    if jobs is not None:
        parts.append(jobs.select(F.lit("jobs_clean").alias("src_table"), F.col("id").alias("row_id"), F.col("source_site").alias("source"), F.col("description").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
