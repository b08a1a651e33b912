"""Operator 6: quality classifier by importance resampling.

Hashed n-gram generative models (which words, word pairs, word shapes and repeats a document has) are fitted to the target,
labelled rows of good quality that aren't toxic, and to what the raw text mixes in: labelled rows of low quality and toxic
ones. Labelled near copies (Jaccard similarity of their sets of five-word shingles 0.8 or more) count once; every other
labelled row counts. A bucket tells two models apart only where a likelihood-ratio test finds its shares
to differ; chance counts of rare n-grams have no say. With the labels' shares as weights of the mixture the importance
weight of a document is p(target) / p(raw). Gumbel noise is added to its logarithm and the top k documents are kept, k being
the labels' share of the target times the number of documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import blank_words, distinct, segment_of, shared_folder, stored, summed_segments, table, texts, trim, vector_rows, word_hashes

BITS, SEGMENTS = 20, 16
POOLS = ("target", "low", "toxic")
#: Buckets of a repeated word and a repeated line.
REPEATS = np.array([0, 1])
SHINGLE, SIMILAR = 5, 0.8  # words of a shingle; similarity from which labelled rows are near copies
BANDS = 6  # of two min-hashes each: a pair at the threshold shares one with 1 - 0.36 ** 6 = 0.998
MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd 64-bit constant for hashing


#: Letters as a or A, digits as 9, every other ASCII character as itself.
SHAPE = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
RUNS = re.compile(rb"([aA9])\1+")


def shapes(text: str | None) -> list[bytes]:
    """Distinct shapes of the words: runs of letters or digits as one."""
    return sorted(set(RUNS.sub(rb"\1", text.encode("utf-8", "surrogatepass").translate(SHAPE)).split())) if text else []


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the distinct words, pairs of adjacent words and word shapes of the whole text, one for each repeat of a word by the next or of a line beyond what prose has."""
    h = word_hashes(blank_words(text))
    if not len(h):
        return np.zeros(0, np.int64)
    pairs = (h[:-1] * MIX ^ h[1:]) * MIX if len(h) > 1 else h
    lines = text.split("\n")
    repeats = np.repeat(REPEATS, [max(0, int((h[:-1] == h[1:]).sum()) - len(h) // 50), max(0, len(lines) - len(set(lines)) - len(lines) // 10)])
    has = distinct(np.concatenate([h * MIX, pairs, word_hashes(shapes(text)) ^ MIX]) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([has, repeats])


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, an empty one has none."""
    h = word_hashes(blank_words(text)).astype(np.uint64)
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    out = h[: len(h) - width + 1]
    for k in range(1, width):
        out = (out ^ out >> np.uint64(29)) * MIX + h[k : len(h) - width + 1 + k]
    return distinct((out ^ out >> np.uint64(32)) * MIX)


def bands(has: np.ndarray) -> list[int]:
    """Each band's two min-hashes as one number: what near copies mostly share."""
    least = [int(((has ^ has >> np.uint64(31)) * (MIX + np.uint64(2 * k))).min()) for k in range(2 * BANDS)]
    return [(least[2 * k] * int(MIX) + least[2 * k + 1]) >> 1 & (1 << 63) - 1 for k in range(BANDS)]


def linked(values: pd.DataFrame) -> np.ndarray:
    """For each row the least place of the rows that it shares a column's value with, at once or through others."""
    groups = [values.groupby(n).ngroup().to_numpy() for n in values.columns]
    label = np.arange(len(values))
    while True:
        new = label.copy()
        for g in groups:
            least = np.full(len(values), len(values))
            np.minimum.at(least, g, new)
            new = least[g]
        new = new[new]
        if (new == label).all():
            return label
        label = new


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """at and whether the row is a near copy of an earlier one, for rows (part, at, blob) sorted by part and at. Rows that share a band are compared; only rows that are no copies are held, of one part at a time."""
    part, firsts, known = None, [], {}
    for pdf in batches:
        out = []
        for own, at, blob in zip(pdf["part"].tolist(), pdf["at"].tolist(), pdf["blob"]):
            if own != part:
                part, firsts, known = own, [], {}
            has = np.frombuffer(blob, np.uint64)
            keys = list(enumerate(bands(has)))
            copy = any(firsts[k][0] < at and similar(has, firsts[k][1]) for k in dict.fromkeys(k for key in keys for k in known.get(key, ())))
            if not copy:
                for key in keys:
                    known.setdefault(key, []).append(len(firsts))
                firsts.append((at, has))
            out.append((at, copy))
        yield pd.DataFrame(out, columns=["at", "copy"])


def labels_of(labels: DataFrame, max_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids in order, their pools, and each pool's share. At most max_labels rows are taken, by a hash of doc_id."""
    pool = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), pool.alias("pool")).where("doc_id is not null and pool is not null")
    rows = rows.groupBy("doc_id").agg(F.max("pool").alias("pool")).orderBy(F.xxhash64("doc_id")).limit(max_labels).toPandas().sort_values("doc_id")
    ids, pools = rows["doc_id"].to_numpy(np.int64), rows["pool"].to_numpy(np.int8)
    return ids, pools, np.bincount(pools, minlength=len(POOLS)) / max(1, len(pools))


def labelled_texts(batches: Iterator[pd.DataFrame], ids: np.ndarray) -> Iterator[tuple[int, str | None]]:
    """(place in ids, text) of the rows of doc_id and text that are labelled."""
    for pdf in batches:
        docs = pdf["doc_id"].fillna(-1).to_numpy(np.int64)
        at = np.searchsorted(ids, docs).clip(0, max(0, len(ids) - 1))
        known = (ids[at] == docs) & pdf["doc_id"].notna().to_numpy() if len(ids) else np.zeros(len(docs), bool)
        for k in np.flatnonzero(known).tolist():
            text = pdf["text"].iat[k]
            yield int(at[k]), text if isinstance(text, str) else None


def left_out(chosen: DataFrame, ids: np.ndarray, pools: np.ndarray) -> np.ndarray:
    """Places in ids of the labelled rows that are near copies of an earlier row of their pool."""
    spark = chosen.sparkSession
    all_ids = spark.sparkContext.broadcast(ids)
    names = [f"s{k}" for k in range(BANDS)]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ((at, shingles(text)) for at, text in labelled_texts(batches, all_ids.value))
        yield pd.DataFrame([(at, *bands(has)) for at, has in found if len(has)], columns=["at", *names])
        trim()

    seen = chosen.mapInPandas(sketch, "at int, " + ", ".join(f"{n} long" for n in names))
    seen = seen.groupBy("at").agg(*[F.min(n).alias(n) for n in names]).toPandas().sort_values("at", ignore_index=True)  # max_labels rows at most
    at = seen["at"].to_numpy(np.int64)
    keys = seen[names] ^ np.int64(1 << 61) * pools[at].astype(np.int64)[:, None]  # no band joins two pools
    part = linked(keys)
    shared = np.bincount(part, minlength=len(part))[part] > 1
    if not shared.any():
        return np.zeros(0, np.int64)
    open_rows = spark.sparkContext.broadcast((ids[at[shared]], at[shared], part[shared]))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, at, part = open_rows.value
        for pdf in batches:
            out = [(int(part[k]), int(at[k]), shingles(text).tobytes()) for k, text in labelled_texts(iter([pdf]), ids) if text]
            yield pd.DataFrame(out, columns=["part", "at", "blob"])
        trim()

    dealt = chosen.mapInPandas(send, "part int, at int, blob binary").where(F.length("blob") > 0).repartition("part").sortWithinPartitions("part", "at", "blob")
    found = dealt.mapInPandas(copies, "at int, copy boolean").groupBy("at").agg(F.min("copy").alias("copy")).where("copy").select("at").toPandas()
    return found["at"].to_numpy(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 500_000, significance: float = 25.0) -> tuple[np.ndarray, np.ndarray]:
    """(log ratios of low and toxic to target by bucket, shares of the pools).

    Labels are a bounded sample of max_labels doc_ids (4.5 MB), sent to the passes over the texts. The first gives each labelled
    row's bands; the second sends the shingles of rows that share one with another row of their pool to where they are compared.
    Near copies of an earlier row are left out; all other rows are counted into vectors of fixed size by the last pass.
    """
    spark = docs.sparkSession
    ids, pools, shares = labels_of(labels, max_labels)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = np.ones(len(ids), bool)
    first[left_out(chosen, ids, pools)] = False
    sent = spark.sparkContext.broadcast((ids[first], pools[first]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, pools = sent.value
        counts = np.zeros((len(POOLS), 1 << BITS), np.int64)
        for at, text in labelled_texts(batches, ids):
            np.add.at(counts[pools[at]], buckets(text), 1)
        packer = zstandard.ZstdCompressor(level=1)
        yield pd.DataFrame([(p, s, blob) for p in range(len(POOLS)) for s, blob in enumerate(vector_rows(counts[p], SEGMENTS, packer))], columns=["pool", "segment", "blob"])
        del counts
        trim()

    made = chosen.mapInPandas(count, "pool int, segment int, blob binary")
    total = np.zeros((len(POOLS), 1 << BITS), np.int64)
    size = (1 << BITS) // SEGMENTS
    for row in summed_segments(made, ["pool", "segment"], size).toLocalIterator():  # 48 vectors of fixed size
        total[row.pool, row.segment * size : (row.segment + 1) * size] = segment_of(row.blob, size)
    return ratios(total, significance), shares


def ratios(counts: np.ndarray, significance: float) -> np.ndarray:
    """log p_pool / p_target of a bucket, for the pools after the first; 0 where the test finds no difference."""
    out = np.zeros((len(counts) - 1, counts.shape[1]), np.float32)
    t, n_t = counts[0].astype(float), float(counts[0].sum())
    for k in range(1, len(counts)):
        c, n_c = counts[k].astype(float), float(counts[k].sum())
        if not n_t or not n_c:
            continue
        both = (t + c) / (n_t + n_c)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(t > 0, t * np.log(t / (n_t * both)), 0) + np.where(c > 0, c * np.log(c / (n_c * both)), 0))
        ratio = np.log((c + 0.5) / n_c) - np.log((t + 0.5) / n_t)
        out[k - 1] = np.where((both > 0) & (g > significance), ratio, 0)
    return out


def gumbel(doc_id, text: str | None, seed: int) -> float:
    """Standard Gumbel noise from the row itself: repeated rows draw alike, a retried task draws the same."""
    h = zlib.crc32(f"{seed}:{doc_id}".encode()) << 32 | zlib.crc32((text or "").encode("utf-8", "surrogatepass"), seed)
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    u = ((h ^ h >> 32) + 0.5) / 2**64
    return -math.log(-math.log(u))


def weigh(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], temperature: float, seed: int) -> DataFrame:
    """docs with log_weight, p_target (the mixture's share of the target) and draw (log weight plus tempered noise)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("log_weight double, p_target double, draw double")
    def weights(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table, shares = sent.value
        prior = max(float(shares[0]), 1e-9)
        for doc_id, text in batches:
            out = np.empty((len(text), 3))
            for k, (doc, t) in enumerate(zip(doc_id, texts(text))):
                at = buckets(t)
                logs = [math.log(max(float(p), 1e-12)) + float(table[i, at].sum(dtype=np.float64)) for i, p in enumerate(shares[1:])]
                top = max(math.log(prior), *logs)
                raw = top + math.log(math.exp(math.log(prior) - top) + sum(math.exp(x - top) for x in logs))
                out[k] = -raw, prior * math.exp(-raw) if raw < 700 else 0.0, -raw + temperature * gumbel(doc, t, seed)
            yield pd.DataFrame(out, columns=["log_weight", "p_target", "draw"])
            trim()

    return docs.select("*", weights(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_w")).select(*docs.columns, "_w.*")


def kth_largest(frame: DataFrame, column: str, k: int) -> tuple[float, int]:
    """The k-th largest value and how many rows with just that value belong to the top k; histograms narrow it down, 4,096 cells a pass."""
    low, high = frame.agg(F.min(column), F.max(column)).first()
    left = k
    while True:
        width = (high - low) / 4096
        if low + width <= low or width == 0:
            break
        cell = F.least(F.lit(4095), F.floor((F.col(column) - low) / width))
        counts = dict(frame.where(F.col(column).between(low, high)).groupBy(cell.alias("cell")).count().collect())
        at = 4095
        while at > 0 and left > counts.get(at, 0):
            left -= counts.get(at, 0)
            at -= 1
        inside = frame.where(F.col(column).between(low, high) & (cell == at))
        low, high, n = inside.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        if low == high:
            break
        if n <= 4096:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            value = values[left - 1]
            return value, left - sum(v > value for v in values)
    return high, left


ADDED = ["log_weight", "p_target", "draw", "kept"]


def select(docs: DataFrame, labels: DataFrame, temperature: float = 1.0, seed: int = 7, max_labels: int = 500_000, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with log_weight, p_target, draw and kept; `carry` names the columns of docs that stay (all).

    Kept are the k rows with the largest draws, k being the rounded product of their number and the labels' share of the target;
    of rows that tie at the threshold those with the smallest doc_id and text are kept. Null and empty texts have no n-grams: their
    weight is 1 and they rank with clean text. Without labels of a pool nothing tells it apart and all rows are kept. Repeated
    rows draw alike. Texts of any length are read whole. No rows give no rows. Columns of docs named as the new ones are kept
    under `own_` and that name.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    model = fit(docs, labels, max_labels)
    own = F.struct(*[F.col(f"`{c}`").alias(f"own_{c}" if c in ADDED else c) for c in carry])
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("_own"))
    weighed = weigh(inner, model, temperature, seed)
    # Written once, with what stays of each row: texts are turned into n-grams for their draw a single time.
    draws = stored(weighed.select("doc_id", F.xxhash64("text").alias("sum"), "log_weight", "p_target", "draw", "_own"), shared_folder(spark, "quality"))

    def answer(kept):
        return draws.select("_own.*", *ADDED[:3], kept.alias("kept"))

    n = draws.count()
    k = round(n * float(model[1][0])) if model[0].any() else n
    if k >= n or k <= 0:
        return answer(F.lit(k > 0))
    value, ties = kth_largest(draws, "draw", k)
    at_edge = draws.where(F.col("draw") == value).select("doc_id", "sum").orderBy("doc_id", "sum").limit(ties).agg(F.max(F.struct("doc_id", "sum"))).first()[0]
    first = F.coalesce(F.col("doc_id") < at_edge[0], F.lit(True)) | ((F.col("doc_id") == at_edge[0]) & (F.col("sum") <= at_edge[1])) if at_edge[0] is not None else F.col("doc_id").isNull()
    return answer((F.col("draw") > value) | ((F.col("draw") == value) & first))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
