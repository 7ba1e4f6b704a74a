"""Sources combined to target shares of the total size in tokens.

Every source is cut into blocks by a hash of the document. A source's quota of tokens is made of whole passes over its
blocks and a last pass over the first blocks of a seeded permutation. The blocks go to the output shards by a
splitting tree: at each node the sources' block counts are divided between the two halves of the shards by a
multivariate hypergeometric draw, so every quota is met exactly; blocks are drawn disjointly from the permutation and
documents are shuffled inside their shard. The one block of a pass that is taken in part is cut into blocks of its own,
again and again until what is left is small, and only that is taken document by document. Only tables of sources x
blocks and sources x shards reach the driver. The tokenizer's vocabulary is read on the driver and sent along.

Defined cases: documents with null or empty text, or of a source without target, are not used; a target source without
documents is reported with share 0 and does not bound the rest; repeated document ids are separate documents that
share one fate; targets are scaled to sum to 1, null or non-positive ones count as 0; equal hashes are ordered by id;
empty tables give an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carda.session import cut, fixed_rows, sized_broadcast

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCKS, SHARDS = 256, 64
#: Tokens of a block taken document by document, at most; a larger one is cut into BLOCKS blocks first.
SMALL = 20_000_000


def _pattern(pattern: str | None) -> str:
    """How text is cut into words before merging: as given, else as the tokenizer package says. Sizes depend on it."""
    if pattern is not None:
        return pattern
    try:
        from public_tokenizers import PATTERN
    except ImportError as e:
        raise RuntimeError("name the tokenizer's word pattern: its package is not installed here") from e
    return PATTERN


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", pattern: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with text and source. ``tokenizer`` is read on the driver alone."""
    words = _pattern(pattern)
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # about a megabyte, whatever the corpus

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary.value, words).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    src = docs.select(F.col(key).alias("doc_id"), "source", "text").where("source is not null and text is not null and text <> ''")
    return src.mapInPandas(count, "doc_id long, source string, n_tokens long")


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: every column sums to ``counts``, every row to an equal share of the blocks."""
    if shards == 1:
        return counts[None, :]
    half = shards // 2
    take = int(counts.sum()) * half // shards
    left = rng.multivariate_hypergeometric(counts, take, method="marginals") if take else np.zeros_like(counts)
    return np.concatenate([split(left, half, rng), split(counts - left, shards - half, rng)])


def plan(blocks: pd.DataFrame, targets: pd.DataFrame, total_tokens: int | None, shards: int, seed: int) -> tuple[list[tuple], pd.DataFrame]:
    """Rows (source, pass_no, block, shard, keep_tokens) and the quotas by source; keep_tokens is null for whole blocks."""
    size = blocks.groupby("source")["tokens"].sum().to_dict()
    share = {r.source: max(0.0, float(r.target_share)) if r.target_share == r.target_share and r.target_share is not None else 0.0 for r in targets.itertuples() if r.source is not None}
    cap = {r.source: max(0, int(r.max_repeats)) if r.max_repeats == r.max_repeats and r.max_repeats is not None else 1 for r in targets.itertuples() if r.source is not None}
    whole = sum(share.values()) or 1.0
    share = {s: v / whole for s, v in share.items()}
    live = [s for s in sorted(share) if share[s] > 0 and cap[s] > 0 and size.get(s, 0) > 0]
    bound = min((cap[s] * size[s] / share[s] for s in live), default=0.0)
    total = bound if total_tokens is None else min(float(total_tokens), bound)
    rng = np.random.default_rng(seed)
    drawn: list[list[tuple]] = []
    for s in live:
        own = blocks[blocks.source == s].sort_values("block")
        ids, tok = own["block"].to_numpy(), own["tokens"].to_numpy()
        quota = int(round(share[s] * total))
        rows: list[tuple] = []
        k = 0
        while quota > 0 and k < cap[s]:
            for i in rng.permutation(len(ids)):
                if quota <= 0:
                    break
                rows.append((s, k, int(ids[i]), None if tok[i] <= quota else int(quota)))
                quota -= int(min(tok[i], quota))
            k += 1
        drawn.append([rows[i] for i in rng.permutation(len(rows))])
    table = split(np.array([len(r) for r in drawn], dtype=np.int64), shards, rng) if live else np.zeros((shards, 0), np.int64)
    out: list[tuple] = []
    at = [0] * len(live)
    for shard in range(shards):
        for j, rows in enumerate(drawn):
            n = int(table[shard, j])
            out += [(s, k, b, shard, keep) for s, k, b, keep in rows[at[j] : at[j] + n]]
            at[j] += n
    return out, pd.DataFrame({"source": list(share), "target_share": list(share.values())})


def _path(level: int, seed: int, blocks: int):
    """Where a document lies: its block, and the block within that, down to ``level``."""
    part = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "doc_id"), F.lit(blocks)).cast("string")
    return F.concat_ws("/", *[part(k) for k in range(level + 1)])


_ENTRY = "source string, copy_no int, path string, shard int, keep_tokens long"


def _taken(sized: DataFrame, rows: list[tuple], level: int, seed: int, blocks: int) -> DataFrame:
    """The documents of the given blocks with the block's entry."""
    chosen = sized_broadcast(fixed_rows(sized.sparkSession, rows, _ENTRY), len(rows), 500_000)
    return sized.withColumn("path", _path(level, seed, blocks)).join(chosen, ["source", "path"])


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: int | None = None, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 1, pattern: str | None = None, small: int = SMALL) -> DataFrame:
    """(doc_id, source, copy_no, shard, order_key, n_tokens): the mix, a row for each use of a document.

    Without ``total_tokens`` the mix is the largest the repeat caps allow. Sorted by order_key, a shard is shuffled.
    """
    sized = cut(count_tokens(docs, tokenizer, pattern=pattern))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int")
    per_block = sized.groupBy("source", block.alias("block")).agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(targets.select("source").distinct()), "source").toPandas()
    wanted = targets.select("source", "target_share", "max_repeats").toPandas()  # one row a source
    planned, _ = plan(per_block, wanted, total_tokens, shards, seed)
    rows = [(s, k, str(b), shard, keep) for s, k, b, shard, keep in planned]
    size = {(r.source, str(r.block)): int(r.tokens) for r in per_block.itertuples()}
    cols = ("doc_id", "source", "copy_no", "shard", "n_tokens")
    level, out = 0, None
    while True:
        whole = [r for r in rows if r[4] is None]
        large = [r for r in rows if r[4] is not None and size[r[0], r[2]] > small and level < 7]
        last = [r for r in rows if r[4] is not None and r not in large]
        # documents of small blocks in permuted order while they fit nearest to the quota
        w = Window.partitionBy("source", "copy_no", "path").orderBy(F.xxhash64(F.lit(seed - 1), "doc_id"), "doc_id")
        part = _taken(sized, last, level, seed, blocks).withColumn("before", F.sum("n_tokens").over(w) - F.col("n_tokens"))
        got = _taken(sized, whole, level, seed, blocks).select(*cols).unionByName(part.where(F.col("before") + F.col("n_tokens") / 2 <= F.col("keep_tokens")).select(*cols))
        out = got if out is None else out.unionByName(got)
        if not large:
            break
        # what is taken in part of a large block is taken of its own blocks, in order of their hash
        inner = _taken(sized, large, level, seed, blocks).select("source", "copy_no", "shard", "keep_tokens", F.col("path").alias("outer"), _path(level + 1, seed, blocks).alias("path"), "n_tokens")
        per = inner.groupBy("source", "copy_no", "shard", "outer", "keep_tokens", "path").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # blocks x blocks taken in part
        rows = []
        size = {(r.source, r.path): int(r.tokens) for r in per.itertuples()}
        for (s, k, shard, _, keep), own in per.groupby(["source", "copy_no", "shard", "outer", "keep_tokens"]):
            left = int(keep)
            for r in sorted(own.itertuples(), key=lambda r: int(r.path.rpartition("/")[2])):
                if left <= 0:
                    break
                rows.append((s, int(k), r.path, int(shard), None if r.tokens <= left else left))
                left -= min(int(r.tokens), left)
        level += 1
    return out.select("doc_id", "source", "copy_no", "shard", F.xxhash64(F.lit(seed), "shard", "copy_no", "doc_id").alias("order_key"), "n_tokens")


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses, most_uses) for every target."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    per = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("uses"), F.max("n").alias("most_uses"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    x = targets.select("source", "target_share").join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens").alias("tokens"), zero("uses").alias("uses"), zero("most_uses").alias("most_uses"))
