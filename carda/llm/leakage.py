"""Held-out passages inside a training corpus, found by latent semantic retrieval.

Documents are cut into passages; passages and items become TF-IDF vectors over hashed character and word grams. A
randomised SVD, computed distributedly over the passages, gives a latent space; every passage's cosine to every item
proposes candidates, and a longest-common-subsequence check of the item's wording in the document decides. Items are
the stated query set: they are held against all passages in blocks, block after block where there are many.

Defined cases: null and empty documents leak nothing; empty items are never found; a document of any length is cut
into overlapping passages and checked whole; an item repeated in the list is reported under each id; a document that
holds an item twice is reported once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carda.functions.chars import SIMPLIFIED, TRADITIONAL

#: Hashed terms, rank of the latent space, oversampling of the range finder.
TERMS, RANK, OVER = 8192, 64, 8
#: Words of a passage and between the starts of two passages.
PASSAGE, STRIDE = 64, 48
#: Cosine that makes a candidate, and the share of the item's words that must stand in order.
COSINE, SHARE = 0.30, 0.5
#: Share from which wording alone decides.
CLEAR = 0.62
#: Items held against the corpus at a time.
ITEM_BLOCK = 5_000
_BLOCK = 256

_HAN_FOLD = str.maketrans(TRADITIONAL, SIMPLIFIED)
_TAG = re.compile(r"<[^<>]{0,200}>|&[a-z]{2,8};|&#x?[0-9a-f]{1,6};", re.I)
_MARKS = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
# Cyrillic and Greek letters drawn like Latin ones.
_LOOK = str.maketrans("аеорсухіјѕοαειυνρτκ", "aeopcyxijsoaeiuvptk")


_FOLDABLE = re.compile("[" + re.escape("".join(map(chr, {**_HAN_FOLD, **_LOOK}))) + "]")
_POWERS = np.array([pow(0x100000001B3, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
#: Flags above a word's 32-bit hash: longer than three letters, a Han character, a number.
LONG, HAN, NUMBER = 1 << 40, 1 << 41, 1 << 42


def _fold(t: str | None) -> str:
    """Comparison form: markup, case, accents, invisible characters and character forms put aside."""
    if not t:
        return ""
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", t)
    if t.isascii():
        return t.lower()
    t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).lower()
    return t.translate(_LOOK).translate(_HAN_FOLD) if _FOLDABLE.search(t) else t


def _kinds() -> np.ndarray:
    """1 for Han characters and kana, 2 for Latin letters, 3 for digits, by code point."""
    kind = np.zeros(0x110000, np.uint8)
    kind[0x3400:0xA000] = kind[0x3040:0x3100] = 1
    kind[97:123] = 2
    kind[48:58] = 3
    return kind


_KIND = _kinds()


def word_codes(texts: list[str | None]) -> list[np.ndarray]:
    """The words of each text as codes, in order: Han characters, runs of Latin letters and runs of digits."""
    joined = "\n".join(_fold(t).replace("\n", " ") for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KIND[cp]
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    at = np.flatnonzero(first)
    if not len(at):
        return [np.empty(0, np.int64) for _ in texts]
    inside = np.flatnonzero(kind)
    word = (np.cumsum(first) - 1)[inside]
    h = np.add.reduceat((cp[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[(inside - at[word]) & 63], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
    h ^= h >> np.uint64(31)
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    code = h.astype(np.int64)
    code[np.bincount(word) > 3] |= LONG
    code[kind[at] == 1] |= HAN
    code[kind[at] == 3] |= NUMBER
    owner = np.cumsum(cp == 10)[at]
    return np.split(code, np.searchsorted(owner, np.arange(1, len(texts))))


def passages(ws: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(1, len(ws) - PASSAGE + STRIDE), STRIDE):
        if len(part := ws[at : at + PASSAGE]):
            yield at, part


def _sparse(batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed term and count of all passages of a batch, by row. Terms: word bigrams, long words, Han trigrams."""
    if not batch:
        e = np.empty(0, np.int32)
        return e, e, e.astype(np.float32)
    w = np.concatenate(batch).astype(np.uint64)
    row = np.repeat(np.arange(len(batch), dtype=np.int64), [len(p) for p in batch])
    h, flags = w & np.uint64(0xFFFFFFFF), w >> np.uint64(40)
    mul = np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * mul) ^ h[1:]
    three = (two[:-1] * mul) ^ h[2:]
    long = (flags & np.uint64(1)) == 1
    ok2 = row[:-1] == row[1:]
    ok3 = (row[:-2] == row[2:]) & ((flags[:-2] & np.uint64(2)) > 0)
    mixed = np.concatenate((h[long], two[ok2], three[ok3])) * mul
    terms = ((mixed >> np.uint64(33)) % np.uint64(TERMS)).astype(np.int64)
    rows = np.concatenate((row[long], row[:-1][ok2], row[:-2][ok3]))
    code, counts = np.unique(rows * TERMS + terms, return_counts=True)
    return (code // TERMS).astype(np.int32), (code % TERMS).astype(np.int32), counts.astype(np.float32)


def _dense(batch: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of a small batch."""
    rows, terms, c = _sparse(batch)
    x = np.zeros((len(batch), TERMS), np.float32)
    if len(rows):
        x[rows, terms] = _unit_rows(rows, (1 + np.log(c)) * idf[terms], len(batch))
    return x


def _unit_rows(rows: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    z = np.sqrt(np.bincount(rows, v * v, minlength=n))
    return v / np.maximum(z[rows], 1e-9).astype(np.float32)


def _project(batch: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit rows in the latent space."""
    out = np.concatenate([_dense(batch[i : i + _BLOCK], idf) @ basis for i in range(0, len(batch), _BLOCK)]) if batch else np.zeros((0, basis.shape[1]), np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each hashed term occurs, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TERMS, np.int64), 0
        for pdf in batches:
            ps = [p for ws in word_codes(pdf["text"].tolist()) for _, p in passages(ws)]
            _, terms, _ = _sparse(ps)
            df += np.bincount(terms, minlength=TERMS)
            n += len(ps)
        yield pd.DataFrame({"term": np.arange(-1, TERMS, dtype=np.int32), "df": np.concatenate(([n], df))})

    rows = docs.select("text").where("text is not null").mapInPandas(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(TERMS, np.int64), 0
    for r in rows:  # TERMS + 1 rows, whatever the corpus
        if r["term"] < 0:
            n = r["df"]
        else:
            df[r["term"]] = r["df"]
    return df, n


def latent_basis(docs: DataFrame, items: list[np.ndarray], idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """A basis of the right singular space of the TF-IDF passages A, by a randomised range finder, and of the items.

    Y = A'(A W) is summed over all passages; its leading left singular vectors span the corpus's directions. Cosines
    inside a span do not depend on how it is turned, so the singular vectors themselves need no second pass. What the
    items' vectors have outside that span is added, so that wording rare in the corpus is kept.
    """
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 1, (TERMS, RANK // 2 + OVER)).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((idf, start))  # a fixed number of floats

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf_, w = shared.value
        y = np.zeros_like(w)
        for pdf in batches:
            ps = [p for ws in word_codes(pdf["text"].tolist()) for _, p in passages(ws)]
            for at in range(0, len(ps), _BLOCK):
                x = _dense(ps[at : at + _BLOCK], idf_)
                y += x.T @ (x @ w)
        yield pd.DataFrame({"block": np.arange(64, dtype=np.int32), "y": [b.ravel().astype(np.float64).tobytes() for b in np.split(y, 64)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in pdf["y"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "y": [total.tobytes()]})

    parts = docs.select("text").where("text is not null").mapInPandas(gather, "block int, y binary")
    summed = parts.groupBy("block").applyInPandas(add, "block int, y binary").collect()  # 64 blocks of one fixed matrix
    y = np.zeros((TERMS, start.shape[1]))
    for r in summed:
        k = TERMS // 64
        y[r["block"] * k : (r["block"] + 1) * k] = np.frombuffer(r["y"], np.float64).reshape(k, -1)
    rows, terms, c = _sparse(items)
    a = np.zeros((len(items), TERMS))
    if len(rows):
        a[rows, terms] = _unit_rows(rows, (1 + np.log(c)) * idf[terms], len(items))
    q, s, _ = np.linalg.svd(y, full_matrices=False) if y.any() else (np.zeros((TERMS, 0)), np.zeros(0), None)
    corpus = q[:, s > 1e-9 * max(s.max(initial=0.0), 1e-300)][:, : RANK // 2]
    rest = a - (a @ corpus) @ corpus.T
    u, s2, vt = np.linalg.svd(rest, full_matrices=False)
    own = vt[s2 > 1e-9][:RANK].T
    basis, _ = np.linalg.qr(np.concatenate([corpus, own], axis=1))
    return basis.astype(np.float32)


def common_run(item: list, doc: list) -> int:
    """Length of the longest common subsequence of words, by bit-parallel dynamic programming."""
    at: dict = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for w in doc:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _answers(ws: list[int]) -> set[int]:
    """Numbers: what an item asks for or answers with."""
    return {w for w in ws if w & NUMBER}


def may_hold(item: list[int], words: set[int]) -> bool:
    """Whether enough of the item's words occur in the document at all: no subsequence is longer than that."""
    return sum(map(words.__contains__, item)) > SHARE * len(item)


def holds_item(item: list[int], doc: list[int]) -> bool:
    """Whether the document holds more than half of the item's wording in its order.

    Subsequences of common words that arise by chance are spread thin, so neighbouring words must agree as well, or
    some of them and most of the item's numbers.
    """
    n = len(item)
    share = common_run(item, doc) / n
    if share <= SHARE:
        return False
    here = set(zip(doc, doc[1:]))
    dense = sum(p in here for p in zip(item, item[1:])) / max(1, n - 1)
    numbers = _answers(item)
    agree = len(numbers & _answers(doc)) / len(numbers) if numbers else 0.0
    if share < CLEAR:  # items made alike share this much wording; their numbers tell them apart
        return n == 1 or (agree >= 0.5 if numbers else dense >= 0.5)
    return dense >= 0.35 or (dense >= 0.25 and agree >= 0.6)


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id): documents that hold more than half of an item's wording in its order."""
    given = items.select("item_id", "text").collect()  # the stated query set
    listed = [(r["item_id"], w) for r, w in zip(given, word_codes([r["text"] for r in given])) if len(w)]
    src = docs.select(F.col(key).alias("doc_id"), F.col("text"))
    if not listed:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    df, n = document_frequencies(src)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1e-3
    out = None
    for at in range(0, len(listed), ITEM_BLOCK):
        part = _search_block(src, listed[at : at + ITEM_BLOCK], idf)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _search_block(src: DataFrame, listed: list[tuple[int, np.ndarray]], idf: np.ndarray) -> DataFrame:
    """(doc_id, item_id) of one block of items against all documents."""
    item_words = [w for _, w in listed]
    # long items are retrieved by their own passages
    pieces = [(k, p) for k, w in enumerate(item_words) for _, p in passages(w)]
    basis = latent_basis(src, [p for _, p in pieces], idf)
    item_vecs = _project([p for _, p in pieces], idf, basis)
    shared = src.sparkSession.sparkContext.broadcast((idf, basis, item_vecs, [k for k, _ in pieces], [(i, w.tolist()) for i, w in listed]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf_, basis_, vecs, owner, its = shared.value
        owner = np.asarray(owner)
        for pdf in batches:
            found: set[tuple[int, int]] = set()
            texts = word_codes(pdf["text"].tolist())
            where = [(d, p) for d, ws in enumerate(texts) for _, p in passages(ws)]
            doc = np.array([d for d, _ in where], np.int64)
            ids = pdf["doc_id"].tolist()
            near: list[np.ndarray] = []
            for lo in range(0, len(where), 2048):
                cos = _project([p for _, p in where[lo : lo + 2048]], idf_, basis_) @ vecs.T
                i, j = np.nonzero(cos >= COSINE)
                near.append(doc[lo + i] * len(its) + owner[j])
            last, words, bag = -1, [], set()
            for code in np.unique(np.concatenate(near)).tolist() if near else []:
                d, k = divmod(code, len(its))
                if d != last:
                    last, words = d, texts[d].tolist()
                    bag = set(words)
                if may_hold(its[k][1], bag) and holds_item(its[k][1], words):
                    found.add((ids[d], its[k][0]))
            yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"])

    return src.where("text is not null").mapInPandas(search, "doc_id long, item_id long")
