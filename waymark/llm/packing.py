"""Operator 1: best-fit packing of documents into sequences.

Vector best-fit decreasing. A bin has three residual capacities: tokens, documents and attention cost (the sum of squared
piece lengths). A piece goes to the open bin that holds it under every constraint and that has the largest weighted
dot product of residual and demand ("dot") or the smallest weighted norm of what stays free ("norm"); else a bin opens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table, texts, trim
from waymark.llm.tokens import pieces

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins; lengths in any order, none above tokens."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cap = np.array([tokens, documents, attention], float)
    w = np.asarray(weights, float)
    free, label, used = np.empty((3, 1024)), np.empty(1024, np.int64), 0  # the bins that can still take a piece
    count, least = 0, float(lengths.min()) if n else 0.0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = float(lengths[i])
        need = (length, 1.0, length * length)
        at = -1
        if used and length < tokens:
            f = free[:, :used]
            fits = (f[0] >= need[0]) & (f[1] >= need[1]) & (f[2] >= need[2])
            if fits.any():
                if rule == "dot":
                    score = sum(w[k] * need[k] / cap[k] / cap[k] * f[k] for k in range(3) if w[k])
                    at = int(np.where(fits, score, -np.inf).argmax())
                else:
                    score = sum(w[k] * ((f[k] - need[k]) / cap[k]) ** 2 for k in range(3) if w[k])
                    at = int(np.where(fits, score, np.inf).argmin())
        if at < 0:
            if used == free.shape[1]:
                free, label = np.concatenate([free, np.empty_like(free)], 1), np.concatenate([label, np.empty_like(label)])
            at, used = used, used + 1
            free[:, at], label[at] = cap, count
            count += 1
        bins[i], offsets[i] = label[at], tokens - free[0, at]
        free[:, at] -= need
        if free[0, at] < least or free[1, at] < 1 or free[2, at] < least * least:  # nothing that is left can fit
            used -= 1
            free[:, at], label[at] = free[:, used], label[used]
    return bins, offsets, count


def pack(
    docs: DataFrame, tokenizer: str, cut: str = "drop", end_id: int = 1, sequence: int = 4096, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm", block: int = 32_768, lean: bool = False,
) -> DataFrame:
    """A row for each piece of docs (doc_id, text): where it stands in which sequence.

    A document's ids get end_id; only documents longer than a sequence are cut. One exchange moves 36-byte rows, not texts.
    A task packs blocks of at most `block` pieces, so memory doesn't follow the partition, and a block loses one unfilled
    sequence or so. max_documents and max_attention bound each sequence; None leaves the dimension free (a document
    may then fill a sequence alone, so a bound below sequence**2 also shortens pieces). Null text is empty: one piece with
    end_id alone. A text of any length is encoded whole, about 8 MB of texts at a time. Of bins that score alike the first opened
    takes a piece; pieces of one length are taken in the order of doc_id, piece and ids. lean makes workers remember fewer pieces
    and give memory back after each batch: slower, the same rows. Repeated rows are packed each. Null doc_id stays null. No rows
    give no rows. Other columns are ignored, whatever their names.
    """
    documents, attention = max_documents or sequence, max_attention or sequence * sequence
    longest = min(sequence, int(attention**0.5))
    end = np.array([end_id], "<u4").tobytes()

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        library = pieces(tokenizer, cut, limit=150_000 if lean else 350_000)
        for pdf in batches:
            out: list[tuple] = []
            for doc, ids in zip(pdf["doc_id"], library.batch(texts(pdf["text"]), 1 << (20 if lean else 23))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * longest)):
                    part = ids[at : at + 4 * longest]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))
            if lean:
                trim()
        trim()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal first
            bins, offsets, count = best_fit(pdf["length"].to_numpy(), sequence, documents, attention, weights, rule)
            out = pdf.assign(sequence_id=bins + first, offset=offsets)
            first += count
            return out

        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= block:
                whole = pd.concat(held, ignore_index=True)
                while len(whole) >= block:
                    yield packed(whole[:block])
                    whole = whole[block:].reset_index(drop=True)
                held, rows = [whole], len(whole)
        if rows:
            yield packed(pd.concat(held, ignore_index=True))

    cut_up = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cuts, SCHEMA.partition(", sequence_id")[0])
    dealt = cut_up.repartition(F.xxhash64("doc_id", "piece", "start", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInPandas(place, SCHEMA)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
