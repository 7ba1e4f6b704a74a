"""New batches held against everything accepted before.

A store keeps, load by load, the band keys of minwise signatures (and keys of contact with title and fingerprint blocks,
and of the address), bucketed and sorted by a hash of the key, beside the accepted rows. A batch's keys probe the
buckets they fall in, without moving the history; candidates are verified on the texts; rows of no accepted vacancy are
accepted, and the batch's keys are appended, each leading to the vacancy it belongs to. Exact copies of a text held
already are known by its digest and cost neither signature nor probe.

A load is written aside and counts only once its last part, the decisions, is whole: a retry overwrites what a lost
attempt left, and a load given twice is answered from its decisions. :func:`repeats` sends a whole table through a store,
days in order.

Defined cases: a null or empty description gives no text keys, so such a row can only repeat another by address, or by
contact, title and a block of the fingerprint; ties in arrival go to the lower id; repeated ids count once; rows without
``collected_at`` come first; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carda.functions.chars import TRADITIONAL, fold_accents, fold_han, fold_py, fold_width
from carda.operators.graph import connected_components
from carda.session import checkpoint_dir, cut, fixed_rows, sized_broadcast

#: Word shingles of a signature, bands and rows of the signature matrix.
SHINGLE, BANDS, ROWS = 5, 20, 4
#: Share of the smaller text's shingles the larger one holds, at least, to be one advert lightly edited.
CONTAINED = 0.7
#: Lowest two bits of a key: a band of the text, the address, the contact.
TEXT, URL, CONTACT = 0, 1, 2
_MASK = np.uint64(0xFFFFFFFF)
#: Hashes neither repeat nor compress.
_PLAIN_FILES = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260101)
    a = rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


_POWERS = np.array([pow(0x100000001B3, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
_CHUNK = 512


def _shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the k-word shingles of all texts, and where each text's begin; a short text is one shingle.

    Each Han character is a word, runs of other letters and digits are words. Texts without words have no shingles.
    """
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    han = (cp >= 0x3400) & (cp <= 0x9FFF)
    gap = (cp == 32) | (cp == 10)
    first = np.empty(len(cp), bool)
    first[0] = True
    first[1:] = han[1:] | han[:-1] | gap[1:] | gap[:-1]
    at = np.flatnonzero(first)
    place = np.arange(len(cp)) - np.repeat(at, np.diff(np.append(at, len(cp))))
    h = np.add.reduceat((cp + np.uint64(1)) * _POWERS[place & 63], at)
    ends = np.cumsum(cp[at] == 10)  # the text a word belongs to
    word = ~gap[at]
    h, owner = h[word], (ends - (cp[at] == 10))[word]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n = np.where(counts > 0, np.maximum(1, counts - k + 1), 0)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    src = np.repeat(begin - starts, n) + np.arange(n.sum())
    left = np.repeat(begin + counts, n) - src  # words from here to the text's end
    s = np.zeros(len(src), np.uint64)
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    for j in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + np.where(left > j, padded[src + j], np.uint64(0))
    s ^= s >> np.uint64(32)
    return (s & _MASK).astype(np.uint32), np.concatenate((starts, [n.sum()]))


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of one text."""
    return np.unique(_shingles([text], k)[0])


def _band_keys(texts: list[str]) -> np.ndarray:
    """(texts, BANDS) keys; rows of texts without words are meaningless."""
    a, b = _seeds()
    out = np.zeros((len(texts), BANDS), np.uint64)
    for lo in range(0, len(texts), _CHUNK):
        part = texts[lo : lo + _CHUNK]
        s, starts = _shingles(part, SHINGLE)
        some = np.flatnonzero(np.diff(starts))
        if not len(some):
            continue
        at = starts[some]
        key = np.zeros(len(some), np.uint64)
        for j in range(BANDS * ROWS):
            x = s * a[j]
            x += b[j]
            x ^= x >> np.uint32(15)
            key = (key ^ np.minimum.reduceat(x, at)) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(28)
            if j % ROWS == ROWS - 1:
                out[lo + some, j // ROWS] = (key << np.uint64(7)) + np.uint64(4 * (j // ROWS))
                key = np.zeros(len(some), np.uint64)
    return out.view(np.int64)


@lru_cache(maxsize=8192)
def _threes(text: str) -> frozenset[int]:
    return frozenset(_shingles([text], 3)[0].tolist())


def containment(x: str, y: str) -> float:
    """Share of the smaller text's three-word shingles the other holds."""
    p, q = _threes(x), _threes(y)
    small = min(len(p), len(q))
    return len(p & q) / small if small else 0.0


def _compared(a: pd.Series, b: pd.Series, unnamed: pd.Series) -> pd.DataFrame:
    """Containment of the texts and, where no shop is named, of either's opening words in the other's beginning."""
    rows = []
    for x, y, bare in zip(a.fillna(""), b.fillna(""), unnamed):
        c = containment(x, y)
        rows.append((c, max(containment(x[:34], y[:80]), containment(y[:34], x[:80])) if bare and c >= CONTAINED else 1.0))
    return pd.DataFrame(rows, columns=["contained", "opening"])


# What stands in front of a republished advert.
_REPOST = re.compile(r"^(?:(?:urgente|republicado|急招|再次发布|重新发布|hoy|nuevo|新店)\b ?)+ ?")
_FOLD = str.maketrans(
    {c: fold_py(chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *(ord(x) for x in TRADITIONAL)] if fold_py(chr(c)) != chr(c)}
)
_FOLDABLE = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "]")
_GAPS = re.compile(r"[\W_]+")


def normal_words(text: str | None) -> str:
    """Width, case, accents and traditional forms folded, everything but letters and digits one space."""
    if not text:
        return ""
    low = text.lower()
    return _GAPS.sub(" ", low.translate(_FOLD) if _FOLDABLE.search(low) else low).strip()


def _words_of(titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    words = [_REPOST.sub("", normal_words(t)) for t in texts]
    digests = [hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words]
    return pd.DataFrame({"words": words, "title_words": [normal_words(t) for t in titles], "digest": [int.from_bytes(d, "big", signed=True) for d in digests]})


def shop_key(company: Column) -> Column:
    """The brand part of a shop name, without legal suffix, trimmings and spaces; null where no brand is named."""
    bare = F.regexp_replace(fold_accents(F.lower(fold_han(company))), "\uff08[^\uff09]*\uff09|\\([^)]*\\)|★|急聘中|<<<|>>>", "")
    brand = F.regexp_extract(F.btrim(bare), r"^((?:\p{L}+ ){0,2}\p{IsHan}{2,})", 1)
    brand = F.regexp_replace(F.regexp_replace(brand, "有限公司|有限公?$|有$", ""), " ", "")
    # the array binds the brand once
    return F.when(~company.isin("保密", "某店", "个人"), F.transform(F.array(brand), lambda b: F.when(F.length(b) >= 2, b))[0])


# Query parameters that only say where a visitor came from.
_TRACKING = "^(?:gclid|fbclid|ref|utm_[a-z]+)="


def same_address(url: Column) -> Column:
    """One form of an address: no scheme, www or mobile host, port, fragment, tracking parameter, order or case."""
    u = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(url)), r"^https?://(?:www\.|m\.)?", ""), "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^([^?]*)", 1), r":\d+(?=/|$)", ""), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.nullif(F.concat_ws("?", path, F.nullif(F.array_join(query, "&"), F.lit(""))), F.lit(""))


def town_key(spark: SparkSession, regions: DataFrame) -> dict[str, int]:
    """Town names and their halves, folded, with the town's id. The reference list is fixed."""
    out: dict[str, int] = {}
    for r in regions.where("level = 1").select("id", "name").collect():
        a, _, b = r["name"].partition(" ")
        for n in (a, b):
            if n:
                out.setdefault(fold_py(n), r["id"])
    return out


def prepare(jobs: DataFrame, regions: DataFrame) -> DataFrame:
    """The columns matching needs. ``text_id`` stands for one text of one shop in one town; copies share it."""
    towns = town_key(jobs.sparkSession, regions)
    names = "|".join(sorted(towns, key=len, reverse=True)) or "(?!)"
    ids = fixed_rows(jobs.sparkSession, sorted(towns.items()), "town_name string, town int")
    fold = F.pandas_udf(_words_of, "struct<words:string,title_words:string,digest:bigint>")
    x = jobs.select(
        "id",
        "collected_at",
        fold("title", "description").alias("w"),
        shop_key(F.col("company")).alias("shop"),
        fold_han(fold_accents(F.lower(fold_width(F.coalesce("city", F.lit("")))))).alias("city_words"),
        F.nullif(F.col("contact_key"), F.lit("")).alias("contact_key"),
        "simhash",
        same_address(F.col("source_url")).alias("url"),
    ).select("*", "w.words", "w.title_words", "w.digest")
    # the first town named in the text, else in the title, else as the city
    named = x.withColumn("town_name", F.regexp_extract(F.concat_ws("\n", "words", "title_words", "city_words"), f"({names})", 1))
    named = named.join(F.broadcast(ids), "town_name", "left")
    same_text = F.xxhash64("digest", F.length("words"), F.coalesce("shop", F.lit("")), F.coalesce("town", F.lit(0)))
    text_id = F.when(F.col("words") != "", same_text).otherwise(F.xxhash64(F.lit("row"), "id"))
    return named.select("id", "collected_at", text_id.alias("text_id"), "words", "title_words", "shop", "town", "contact_key", "simhash", "url")


def _town_keys(towns: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Band keys of texts, salted with the text's town; a text that names none probes every town's keys."""
    every = np.array(sorted(towns) or [0], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # a text repeated nearby gives its keys once
        for pdf in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            pdf = pdf.drop_duplicates("text_id")
            pdf = pdf[~pdf["text_id"].isin(seen)] if seen else pdf
            seen.update(pdf["text_id"].tolist())
            keys = _band_keys(pdf["words"].tolist())
            town = pdf["town"].fillna(-1).astype("int64").to_numpy()
            at = np.concatenate((np.flatnonzero(town >= 0), np.repeat(np.flatnonzero(town < 0), len(every))))
            salt = np.concatenate((town[town >= 0], np.tile(every, (town < 0).sum()))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            salted = keys[at].view(np.uint64) ^ (salt << np.uint64(7))[:, None]
            yield pd.DataFrame({"text_id": np.repeat(pdf["text_id"].to_numpy()[at], BANDS), "key": salted.view(np.int64).ravel()})

    return run


def probe_keys(texts: DataFrame, rows: DataFrame, towns: list[int]) -> DataFrame:
    """(text_id, key): bands of ``texts``, and of all ``rows`` the contact with title and each fingerprint
    block, and the address. The lowest bits of a key tell its kind."""
    text = texts.where("words <> ''").select("text_id", "words", "town").mapInPandas(_town_keys(towns), "text_id long, key long")
    kind = lambda k, bits: k.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(bits))
    blocks = F.array(*[kind(F.xxhash64(F.lit(i), F.col("contact_key"), F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(65535), "title_words"), CONTACT) for i in range(4)])
    contact = rows.where("contact_key is not null and simhash is not null and simhash <> 0").select("text_id", F.explode(blocks).alias("key"))
    url = rows.where("url is not null").select("text_id", kind(F.xxhash64("url"), URL).alias("key"))
    return text.unionByName(contact).unionByName(url)


_SIDE = ("text_id", "words", "title_words", "shop", "town")


def verified(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (columns of both sides suffixed _a and _b) that are one advert of one shop in one town.

    Where neither row names its shop, the opening words of one, which name it, must stand in the other almost wholly. A
    row without text is the other's repeat by its address, or by its contact with title and fingerprint.
    """
    glued = lambda x: F.regexp_replace(F.concat(F.col(f"words_{x}"), F.col(f"title_words_{x}")), " ", "")
    same_shop = F.col("shop_a").startswith(F.col("shop_b")) | F.col("shop_b").startswith(F.col("shop_a"))
    a, b = F.col("shop_a").isNotNull(), F.col("shop_b").isNotNull()
    shops = F.when(a & b, same_shop).when(a, F.instr(glued("b"), F.col("shop_a")) > 0).when(b, F.instr(glued("a"), F.col("shop_b")) > 0).otherwise(F.lit(True))
    towns = F.col("town_a").isNull() | F.col("town_b").isNull() | (F.col("town_a") == F.col("town_b"))
    compared = F.pandas_udf(_compared, "struct<contained:double,opening:double>")
    x = pairs.where(towns & shops).withColumn("c", compared("words_a", "words_b", ~a & ~b)).select("*", "c.contained", "c.opening")
    bare = (F.col("words_a") == "") | (F.col("words_b") == "")
    return x.where(((F.col("contained") >= CONTAINED) & (F.col("opening") >= 0.8)) | (F.col("same_url") & ((F.col("contained") >= 0.3) | bare)) | (F.col("same_contact") & bare))


class HistoryStore:
    """The accepted history in a folder all executors share.

    Of every load: ``rows`` (what verification and judging need), ``keys`` (bucketed and sorted by key), ``members``
    (text -> vacancy), ``accepted`` (vacancy -> its first row) and, written last, ``decisions``. ``buckets`` is fixed when
    the store is made; the more there are, the smaller each join of a batch with the history.
    """

    _ROWS = "id long, collected_at timestamp_ntz, text_id long, words string, title_words string, shop string, town int, contact_key string, simhash long, url string"

    def __init__(self, spark: SparkSession, path: str, regions: DataFrame, buckets: int = 64) -> None:
        self.spark, self.path, self.regions = spark, path.rstrip("/"), regions
        self.towns = sorted(set(town_key(spark, regions).values()))
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        made = self._names("buckets=*", "buckets=")
        self.buckets = int(made[0]) if made else buckets
        if not made:
            self._fs.mkdirs(self._hadoop(f"{self.path}/buckets={buckets}"))
        self._tables: set[str] = set()

    def _names(self, pattern: str, prefix: str) -> list[str]:
        found = self._fs.globStatus(self._hadoop(f"{self.path}/{pattern}"))
        parts = [f.getPath().toString().split("/") for f in found or []]
        return sorted(x[len(prefix) :] for p in parts for x in p if x.startswith(prefix))

    def loads(self) -> list[str]:
        """The committed loads, in order of their names."""
        return self._names("load=*/decisions/_SUCCESS", "load=")

    def _part(self, load: str, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/load={load}/{what}")

    def _all(self, what: str, loads: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/load={x}/{what}" for x in loads]) if loads else self.spark.createDataFrame([], schema)

    def _save(self, df: DataFrame, load: str, what: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/load={load}/{what}")
        return self._part(load, what)

    def _keys(self, load: str, write: DataFrame | None = None) -> DataFrame:
        """The load's keys as a table bucketed by key, so that joins of loads need no exchange."""
        name = "history_" + hashlib.md5(f"{self.path} {load}".encode()).hexdigest()
        where = f"{self.path}/load={load}/keys"
        if write is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            write.repartition(self.buckets, "key").write.mode("overwrite").bucketBy(self.buckets, "key").sortBy("key").options(**_PLAIN_FILES).option("path", where).saveAsTable(name)
        elif name not in self._tables:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (text_id BIGINT, key BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        self._tables.add(name)
        return self.spark.table(name).select("key", "text_id")

    def close(self, discard: bool = False) -> None:
        """Forget the tables of this session; ``discard`` deletes the folder as well."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()
        if discard:
            self._fs.delete(self._hadoop(self.path), True)

    def add_batch(self, batch: DataFrame, load: str | None = None) -> DataFrame:
        """(id, accepted_id) of the batch's rows. ``load`` names the batch; names are to be given in order of arrival."""
        before = self.loads()
        load = f"{len(before):06d}" if load is None else load
        if load in before:
            return self._part(load, "decisions")
        rows = self._save(prepare(batch, self.regions), load, "rows")
        members = self._all("members", before, "text_id long, vacancy long")
        # copies of texts held already belong to their vacancy and are not probed again
        known = self._picked(members, rows.select("text_id").distinct(), "text_id") if before else members
        mine = self._keys(load, probe_keys(rows.join(known.select("text_id"), "text_id", "left_anti"), rows, self.towns))
        pairs = self._candidates(mine, [self._keys(x) for x in before])
        links = self._links(pairs, rows, self._all("rows", before, self._ROWS) if before else None)
        # in links an old text stands for its vacancy; only those links touch are looked up
        old = self._picked(members, links.select(F.explode(F.array("a", "b")).alias("text_id")).distinct(), "text_id") if before else members
        for c in ("a", "b") if before else ():
            links = links.join(old.select(F.col("text_id").alias(c), F.col("vacancy").alias("_v")), c, "left").withColumn(c, F.coalesce("_v", c)).drop("_v")
        parts = cut(connected_components(links.select("a", "b")).select(F.col("node").alias("vacancy"), "component"))
        # texts that do not stand for themselves alone: known ones and ones in a part
        named = known.unionByName(parts.select(F.col("vacancy").alias("text_id"), "vacancy").join(known.select("text_id"), "text_id", "left_anti"))
        named = named.join(parts, "vacancy", "left").select("text_id", F.coalesce("component", "vacancy").alias("part"))
        if before:  # the first accepted row of each part, and its vacancy
            ends = named.select(F.col("part").alias("component")).distinct().join(parts, "component", "left").select("component", F.coalesce("vacancy", "component").alias("vacancy"))
            held = self._picked(self._all("accepted", before, "vacancy long, id long, collected_at timestamp_ntz"), ends.select("vacancy").distinct(), "vacancy")
            first_of = ends.join(held, "vacancy").groupBy(F.col("component").alias("part")).agg(F.min(F.struct("collected_at", "id", "vacancy")).alias("old"))
            named = named.join(first_of, "part", "left").select("text_id", F.coalesce("old.vacancy", "part").alias("part"), F.col("old.id").alias("held_id"))
        else:
            named = named.withColumn("held_id", F.lit(None).cast("long"))
        named = cut(named)
        x = rows.select("id", "collected_at", "text_id").join(sized_broadcast(named, named.count(), 100_000), "text_id", "left")
        x = cut(x.select("id", "collected_at", "text_id", F.coalesce("part", "text_id").alias("vacancy"), "held_id").distinct())
        first = x.where("held_id is null").groupBy("vacancy").agg(F.min(F.struct("collected_at", "id")).alias("f"))
        first = self._save(first.select("vacancy", "f.id", "f.collected_at"), load, "accepted")
        fresh = x.select("text_id", "vacancy").distinct()
        self._save(fresh.join(known.select("text_id"), "text_id", "left_anti") if before else fresh, load, "members")
        done = x.join(first.select("vacancy", F.col("id").alias("new_id")), "vacancy", "left").select("id", F.coalesce("held_id", "new_id").alias("accepted_id"))
        return self._save(done, load, "decisions")

    @staticmethod
    def _picked(history: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        """The rows of the history with one of the ``ids``; the history is not moved while the ids are few."""
        ids = cut(ids)
        return cut(history.join(sized_broadcast(ids, ids.count()), key, "left_semi"))

    @staticmethod
    def _candidates(mine: DataFrame, older: list[DataFrame]) -> DataFrame:
        """(a, b, same_url, same_contact): b a text of the batch, a one of the batch or of the history, with a common key.

        A key only one text has, which is nearly every key, is dropped before the batch is joined with itself.
        """
        busy = mine.groupBy("key").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).where("low < high").select("key")
        inside = cut(mine.join(busy, "key").select("key", F.col("text_id").alias("b")).distinct())
        found = inside.join(inside.withColumnRenamed("b", "a"), "key").where("a < b")
        for keys in older:
            found = found.unionByName(keys.select("key", F.col("text_id").alias("a")).join(mine.select("key", F.col("text_id").alias("b")), "key").where("a <> b"))
        kind = F.col("key").bitwiseAND(F.lit(3))
        return found.groupBy("a", "b").agg(F.max(kind == URL).alias("same_url"), F.max(kind == CONTACT).alias("same_contact"))

    @staticmethod
    def _links(pairs: DataFrame, rows: DataFrame, older: DataFrame | None) -> DataFrame:
        """(a, b) of the pairs that verification keeps; the texts they need are read once and only they are moved."""
        pairs = cut(pairs)
        need = cut(pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct())
        need = sized_broadcast(need, need.count(), 100_000)
        held = rows.select(*_SIDE) if older is None else rows.select(*_SIDE).unionByName(older.select(*_SIDE))
        texts = cut(held.join(need, "text_id", "left_semi").dropDuplicates(["text_id"]))
        side = lambda x: texts.select(*[F.col(c).alias(f"{c}_{x}") for c in _SIDE])
        both = pairs.join(side("a"), pairs.a == F.col("text_id_a")).join(side("b"), pairs.b == F.col("text_id_b"))
        return cut(verified(both).select("a", "b"))


def _days(jobs: DataFrame, loads: int) -> list[tuple[object, object]]:
    """(first, last) days of ``loads`` stretches of about equal size; None for an open end."""
    per = jobs.groupBy(F.col("collected_at").cast("date").alias("day")).agg(F.count("*").alias("n")).where("day is not null").orderBy("day").collect()  # a row a day
    total, ends, at = sum(r["n"] for r in per), [], 0
    sums = []
    for r in per:
        at += r["n"]
        sums.append(at)
    for k in range(1, loads):
        i = bisect_left(sums, total * k / loads)
        if i < len(per) - 1 and (not ends or per[i]["day"] > ends[-1]):
            ends.append(per[i]["day"])
    return list(zip([None, *ends], [*ends, None]))


def repeats(jobs: DataFrame, regions: DataFrame, loads: int = 2, store: HistoryStore | None = None) -> DataFrame:
    """(job_id_a, job_id_b): each later row of a vacancy with the accepted one, smaller id first.

    The table goes through a store, days in order; several days are added as one load, which changes no answer, since
    the rows of a load are taken by arrival, too. A store made here is deleted when its decisions have been read.
    """
    spark = jobs.sparkSession
    own = store is None
    if store is None:
        store = HistoryStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}", regions, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    day, out = F.col("collected_at").cast("date"), None
    for after, until in _days(jobs, loads):
        batch = jobs.where((F.coalesce(day > F.lit(after), F.lit(False)) if after else F.lit(True)) & (F.coalesce(day <= F.lit(until), F.lit(True)) if until else F.lit(True)))
        done = store.add_batch(batch)
        out = done if out is None else out.unionByName(done)
    v = out.where("id <> accepted_id").select(F.least("id", "accepted_id").alias("job_id_a"), F.greatest("id", "accepted_id").alias("job_id_b")).distinct()
    if own:
        v = cut(v)
        store.close(discard=True)
    return v
