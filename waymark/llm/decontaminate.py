"""Operator 3: benchmark decontamination by Wu-Manber search over words.

Patterns are the benchmark's windows of 13 words (an item of fewer is one window). Patterns of one length form a searcher:
a block is two adjacent words, the shift table tells for each block how far the window can move without missing a pattern,
a zero shift leads to the bucket of patterns that end in this block, a prefix block narrows it, and a direct comparison of
the words confirms an occurrence. Words that no pattern has move the window past themselves. Patterns are kept as places in
their items' words, so tables grow by some 300 bytes for a benchmark word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import plain_words, shared_folder, stored, table, texts, trim

WINDOW = 13
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Searcher:
    """Wu-Manber tables for the windows of m words of items (words, item_id); an item of m words at least has one at each of its places."""

    def __init__(self, m: int, items: list[tuple[list[bytes], int | None]]):
        self.m, self.block, self.items = m, min(2, m), items
        self.words: dict[bytes, int] = {}
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[int, int]]]] = {}
        number, b = self.words, self.block
        for k, (words, _) in enumerate(items):
            ids = [number.setdefault(w, len(number)) for w in words]
            keys = [x << 32 | y for x, y in zip(ids, ids[1:])] if b == 2 else ids  # of the blocks that end at place b, b + 1, ...
            for end, key in enumerate(keys, b):
                self.shift[key] = min(self.shift.get(key, m), m - min(end, m))
            for start in range(len(ids) - m + 1):
                self.buckets.setdefault(keys[start + m - b], {}).setdefault(keys[start], []).append((k, start))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int | None]]:
        """(start, item_id) of every occurrence."""
        m, b, n = self.m, self.block, len(words)
        number, shift_of, buckets, items, far = self.words.get, self.shift.get, self.buckets, self.items, m - b + 1
        at = m  # end of the window, exclusive
        while at <= n:
            last = number(words[at - 1])
            if last is None:
                at += m
                continue
            if b == 2:
                before = number(words[at - 2])
                key = -1 if before is None else before << 32 | last
            else:
                key = last
            shift = shift_of(key, far)
            if shift:
                at += shift
                continue
            start = at - m
            first = number(words[start])
            head = first if b == 1 or first is None else first << 32 | (-1 if (second := number(words[start + 1])) is None else second)
            for k, place in buckets[key].get(head, ()):
                if items[k][0][place : place + m] == words[start:at]:
                    yield start, items[k][1]
            at += 1


def searchers(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[Searcher]:
    """One searcher for each pattern length that occurs."""
    by_length: dict[int, list[tuple[list[bytes], int | None]]] = {}
    known: dict[bytes, bytes] = {}
    for item, text in rows:
        words = [known.setdefault(w, w) for w in plain_words(text)]
        if words:
            by_length.setdefault(min(window, len(words)), []).append((words, item))
    return [Searcher(m, items) for m, items in sorted(by_length.items())]


def search(words: list[bytes], tables: list[Searcher]) -> tuple[np.ndarray, set[int]]:
    """Which words are hit, and the items of the windows that occur (those with an id)."""
    edges, items = np.zeros(len(words) + 1, np.int32), set()
    for s in tables:
        for start, item in s.find(words):
            edges[start] += 1
            edges[start + s.m] -= 1
            if item is not None:
                items.add(item)
    return np.cumsum(edges[:-1]) > 0, items


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark, cut by item hash so that a block's texts have about block_bytes: the bound of what is broadcast."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = int(size // block_bytes) + 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


_KEPT: dict[str, list[Searcher]] = {}


def tables_of(spark: SparkSession, block: DataFrame, window: int) -> Callable[[], list[Searcher]]:
    """What gives a task the block's tables: the items are broadcast, and a worker builds the tables once for all its tasks."""
    sent, name = spark.sparkContext.broadcast([tuple(r) for r in block.toLocalIterator()]), uuid.uuid4().hex

    def tables() -> list[Searcher]:
        from waymark.llm import decontaminate as here  # the worker's module and not a copy that came with the function

        if name not in here._KEPT:
            here._KEPT.clear()
            here._KEPT[name] = searchers(sent.value, window)
        return here._KEPT[name]

    return tables


def judged(n: int, hit: int, items) -> tuple:
    """The columns after doc_id."""
    listed = sorted(map(str, items))
    return n, hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), hit > 0 and 20 * hit >= n


def ids_of(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def hits_by_row(numbered: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """_row, doc_id and the columns of hits() for rows (_row, doc_id, text), whose row numbers hold across passes: one pass for each
    block of the benchmark; hit ranges and items of a row meet by its number before they are counted."""
    spark, found = numbered.sparkSession, None
    for block in parts:
        tables = tables_of(spark, block, window)

        def one_block(batches: Iterator[pd.DataFrame], tables=tables) -> Iterator[pd.DataFrame]:
            known = tables()
            for pdf in batches:
                out = []
                for row, text in zip(pdf["_row"], texts(pdf["text"])):
                    mask, items = search(plain_words(text), known)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    if len(edges):
                        out.append((row, edges.tolist(), sorted(items)))
                yield pd.DataFrame(out, columns=["_row", "edges", "items"])
                trim()

        made = numbered.select("_row", "text").mapInPandas(one_block, "_row long, edges array<long>, items array<long>")
        found = made if found is None else found.unionByName(made)
    met = found.groupBy("_row").agg(F.collect_list("edges").alias("edges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, doc, text, edges, items in zip(pdf["_row"], pdf["doc_id"], texts(pdf["text"]), pdf["edges"], pdf["items"]):
                n = len(plain_words(text))
                mask = np.zeros(n, bool)
                for e in edges if edges is not None else ():
                    for a, b in zip(e[::2], e[1::2]):
                        mask[a:b] = True
                out.append((row, doc, *judged(n, int(mask.sum()), items if items is not None else ())))
            yield ids_of(pd.DataFrame(out, columns=["_row", *NAMES]))

    return numbered.join(met, "_row", "left").select("_row", "doc_id", "text", "edges", "items").mapInPandas(merge, f"_row long, {SCHEMA}")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs (doc_id, text).

    Each block of the benchmark is broadcast in turn to one pass over the texts; with a benchmark of one block that is one
    pass without an exchange. Every row is judged by its own text, whatever other rows have its doc_id.
    Null and empty texts have no words and are clean; a text of any length is searched whole. Items without words never occur;
    windows of an item with a null item_id hit words but have no id to list. An item_id that occurs twice counts once. Repeated
    rows are judged each, no rows give no rows, and other columns are ignored, whatever their names.
    """
    spark, parts = docs.sparkSession, blocks_of(benchmark, block_bytes)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(parts) > 1:  # row numbers hold only over rows that don't change: they are written once
        numbered = stored(chosen.withColumn("_row", F.monotonically_increasing_id()), shared_folder(spark, "decontaminate"))
        return hits_by_row(numbered, parts, window).drop("_row")
    tables = tables_of(spark, parts[0], window)

    def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = tables()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], texts(pdf["text"])):
                words = plain_words(text)
                mask, items = search(words, known)
                out.append((doc, *judged(len(words), int(mask.sum()), items)))
            yield ids_of(pd.DataFrame(out, columns=NAMES))
            trim()

    return chosen.mapInPandas(one_pass, SCHEMA)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 1 << 20) -> DataFrame:
    """docs without contaminated rows, all columns kept, whatever their names.

    Each row goes or stays by its own text: a null or repeated doc_id takes no other row along. One pass without an exchange
    while the benchmark is one block; else the rows are written with a number, by which the contaminated ones leave. Null and
    empty texts stay, and so do repeated rows that are clean.
    """
    spark, parts = docs.sparkSession, blocks_of(benchmark, block_bytes)
    if len(parts) > 1:
        held = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"))
        held = stored(held, shared_folder(spark, "decontaminate"))
        numbered = held.select("_row", F.col("_own.doc_id").cast("long").alias("doc_id"), F.col("_own.text").cast("string").alias("text"))
        bad = hits_by_row(numbered, parts, window).where("contaminated").select("_row")
        return held.join(bad, "_row", "left_anti").select("_own.*")
    tables = tables_of(spark, parts[0], window)

    @F.pandas_udf("boolean")
    def contaminated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = tables()
        for text in batches:
            out = []
            for t in texts(text):
                words = plain_words(t)
                n = int(search(words, known)[0].sum())
                out.append(n > 0 and 20 * n >= len(words))
            yield pd.Series(out, dtype=bool)
            trim()

    return docs.where(~contaminated(F.col("text").cast("string")))
