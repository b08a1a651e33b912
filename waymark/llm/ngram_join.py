"""Operator 2: n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set (copies share one) and a column for each shingle. Its product
with its transpose holds all overlaps; only entries that can reach the similarity are ever formed:

* Columns are ordered, those a sketch finds common last. Two rows that link share a column among the first
  n - ceil(s n) + 1 of each in this order, so candidates come from these columns only, and pairs whose sizes rule them out
  aren't formed. Columns that the sketch takes for common are dealt over several partitions.
* Where a pair's first shared column stands as column i of one row and column j of the other, they share min(m - i, n - j) columns
  at most: rows that have but a common passage at the end of their order are discarded there.
* A row's bitmap has a bit for each of its columns. Bits that the other row lacks bound the overlap from above; a pair whose
  bound stays below ceil(s / (1 + s) (m + n)) is discarded before any shingle moves.
* What is left is multiplied in row blocks (a row and up to 8 MB of partners) by column blocks: overlaps are accumulated block
  by block, and a pair goes as soon as its count and what the remaining columns can add stay below the bound.

A column that many rows share isn't expanded at first: its rows pair with up to three pivots only, which ties large groups of
near copies together. Then the pairs of a column whose rows are still in different components follow, all of them: none
is lost, and a group of near copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import blank_words, distinct, release, remove, segment_of, shared_folder, spread_join, stored, summed_segments, table, texts, trim, vector_rows, word_hashes
from waymark.llm.components import components

WORDS, PERCENT, SEGMENTS = 5, 80, 64
LEAST_BITS, MOST_BITS = 512, 1 << 17  # of a bitmap
SPREAD = 2048  # rows of a common column in a partition, by the sketch
ROWS, PARTNERS = 1 << 20, 128  # shingles of the partners in a row block, and partners
COLUMNS = 256  # shingles of a column block
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; a shorter text is one run; none without words."""
    h = word_hashes(blank_words(text))
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * MIX
        out ^= out >> np.uint64(29)
    return distinct(out)


def node_of(s: np.ndarray) -> int:
    """64-bit id of a shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, at its low bits: two to four times as many as shingles, a power of two between the bounds."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap in fewer bytes, a power of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), 0)


def overlap_bound(a: bytes, b: bytes, m: int, n: int) -> int:
    """What rows of m and n shingles can share at most, by their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    both = int(np.bitwise_count(x & y).sum())
    return min(m - int(np.bitwise_count(x).sum()) + both, n - int(np.bitwise_count(y).sum()) + both)


def prefix(n: int, percent: int) -> int:
    """How many first columns of a row of n must hold one that every linked row shares."""
    return n - -(-percent * n // 100) + 1


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Shingles that two sorted sets share, accumulated by column blocks; -1 as soon as `least` can't be reached."""
    found, i, j = 0, 0, 0
    while i < len(a) and j < len(b):
        if found + min(len(a) - i, len(b) - j) < least:
            return -1
        x = a[i : i + COLUMNS]
        end = j + int(np.searchsorted(b[j:], x[-1], "right"))
        y = b[j:end]
        if len(y):
            found += int(np.count_nonzero(x[np.searchsorted(x, y)] == y))
        i, j = i + len(x), end
    return found if found >= least else -1


def bit_set(ids: np.ndarray, bits: int) -> np.ndarray:
    """A Bloom filter with one hash."""
    out = np.zeros(1 << bits, bool)
    out[(ids.view(np.uint64) * MIX >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(out)


def bloom(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter of a column of longs, united by 16 tasks first."""
    un, packer = zstandard.ZstdDecompressor, zstandard.ZstdCompressor

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = None
        for pdf in batches:
            part = bit_set(pdf[column].to_numpy(np.int64), bits)
            found = part if found is None else found | part
        if found is not None:
            yield pd.DataFrame({"blob": [packer().compress(found.tobytes())]})

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros((1 << bits) // 8, np.uint8)
        for blob in pdf["blob"]:
            found |= np.frombuffer(un().decompress(blob), np.uint8)
        return pd.DataFrame({"blob": [packer().compress(found.tobytes())]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    parts = ids.select(column).mapInPandas(some, "blob binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    for row in parts.groupBy("salt").applyInPandas(united, "blob binary").toLocalIterator():
        out |= np.frombuffer(un().decompress(row.blob), np.uint8)
    return out


def links_of(docs: DataFrame, folder: str, words: int = WORDS, percent: int = PERCENT, pivots: int = 3, small: int = 64, block: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, node, n), (links between nodes: a, b, overlap), (components of linked nodes: node, component by least doc_id's node order).

    The links are a connecting subset of all similar pairs: pairs whose rows are already in one component are not formed.
    Components are those of all pairs; the number of a node's links isn't known.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = chosen.count()
    bits = int(np.clip(rows.bit_length() + 6, 18, 24))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen, packer = np.zeros(1 << bits, np.uint16), set(), zstandard.ZstdCompressor(level=1)

        def told_counts() -> pd.DataFrame:
            blobs = [(k, b) for k, b in enumerate(vector_rows(counts, SEGMENTS, packer)) if b]
            none = pd.array([None] * len(blobs), "Int64")
            return pd.DataFrame({"doc_id": none, "node": none, "n": np.int64(0), "bits": None, "segment": pd.array([k for k, _ in blobs], "Int32"), "blob": [b for _, b in blobs]})

        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], texts(pdf["text"])):
                s = shingles(text, words)
                if not len(s):
                    out.append((doc, None, 0, None, None, None))
                    continue
                node = node_of(s)
                out.append((doc, node, len(s), None if node in seen else bitmap(s), None, None))
                if node not in seen:
                    seen.add(node)
                    if len(seen) % 65_000 == 0:  # before a cell can overflow
                        yield told_counts()
                        counts[:] = 0
                    counts[(s >> np.uint64(64 - bits)).astype(np.int64)] += 1  # a row counts once in a cell
            made = pd.DataFrame(out, columns=["doc_id", "node", "n", "bits", "segment", "blob"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"), node=pd.array(made["node"].tolist(), "Int64"), segment=made["segment"].astype("Int32"))
        yield told_counts()
        del counts
        trim()

    told = stored(chosen.mapInPandas(describe, "doc_id long, node long, n long, bits binary, segment int, blob binary"), f"{folder}/told")
    members = stored(told.where("segment is null").select("doc_id", "node", "n"), f"{folder}/members")
    size = (1 << bits) // SEGMENTS
    total = np.zeros(1 << bits, np.int64)
    for row in summed_segments(told.where("segment is not null").select("segment", "blob"), ["segment"], size).toLocalIterator():
        total[row.segment * size : (row.segment + 1) * size] = segment_of(row.blob, size)
    mean = float(total.mean())
    floor = mean + 3 * mean**0.5 + 4
    common = np.where(total <= floor, 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1) / floor))).astype(np.uint8)
    sketch = spark.sparkContext.broadcast(common)  # 16 MB at most
    # Partitions over which a column's rows are dealt, by its rank in the sketch; 0 for those that stay together.
    dealt = np.where(np.arange(256) > 0, np.ceil(floor * 2 ** (np.arange(256) / 8) / SPREAD), 1).clip(1, 1 << 20).astype(np.int64)
    dealt[dealt == 1] = 0
    del total

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, seen = sketch.value, set()
        for pdf in batches:
            keys, salts, nodes, sizes, places = [], [], [], [], []
            for text in texts(pdf["text"]):
                s = shingles(text, words)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                p = prefix(len(s), percent)
                r = rank[(s >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.argsort(r, kind="stable")[:p] if r.any() else slice(p)
                over = dealt[r[order]]
                keys.append(s[order])
                salts.append(np.where(over > 0, 1 + (node & 0x7FFFFFFF) % np.maximum(over, 1), 0))
                nodes.append(np.full(p, node, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "salt": np.concatenate(salts).astype(np.int32), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "at": np.concatenate(places)})
        trim()

    # A column that one row has alone makes no pair. One exchange serves both the copies of a row and the count.
    entries = chosen.mapInPandas(columns, "key long, salt int, node long, n int, at int").repartition("key", "salt").dropDuplicates(["key", "salt", "node"])
    entries = entries.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("key", "salt"))).where("rows > 1 or salt > 0").drop("rows")
    entries = stored(entries, f"{folder}/entries")
    several = entries.select(F.col("node")).distinct()
    bitmaps = told.where("bits is not null").join(several, "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits"), F.first("n").alias("n"))
    bitmaps = stored(bitmaps, f"{folder}/bitmaps")
    remove(spark, f"{folder}/told")
    del told, several
    release(spark)

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, y: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([(100 + percent) * overlap_bound(a, b, k, l) >= percent * (k + l) for a, b, k, l in zip(x, y, m.tolist(), n.tolist())], dtype=bool)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among distinct stored pairs (a, b); the product's row blocks are those of an a. What is known of an a, and into how many
        blocks its partners go (their sizes are at most its own by the similarity), meets its pairs in one join."""
        count = pairs.count()
        per = pairs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("of"))
        shingles_of = F.col("of") * F.col("n") * (100.0 / percent)
        blocks = F.ceil(F.greatest(shingles_of / ROWS, F.col("of") / PARTNERS)).cast("int")
        one = bitmaps.join(per, "node").select(F.col("node").alias("a"), F.col("bits").alias("pa"), F.col("n").alias("na"), blocks.alias("blocks"), "of")
        two = bitmaps.select(F.col("node").alias("b"), F.col("bits").alias("pb"), F.col("n").alias("nb"))
        placed = spread_join(pairs, one, "a", "of", count).join(two, "b").where(possible("pa", "pb", "na", "nb"))
        placed = stored(placed.select("a", "b", "na", "nb", F.pmod(F.hash("b"), F.col("blocks")).alias("block")), f"{folder}/{name}-placed")
        asked = placed.select("a", "block", F.col("b").alias("node"), "na", "nb").unionByName(placed.select("a", "block", F.col("a").alias("node"), "na", F.lit(0).cast("long").alias("nb")).distinct())
        filter_bits = int(np.clip(rows.bit_length() + 4, 16, 28))
        sent = spark.sparkContext.broadcast(bloom(asked, "node", filter_bits))  # 32 MB at most

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted, seen = sent.value, set()
            for pdf in batches:
                nodes, held = [], []
                for text in texts(pdf["text"]):
                    s = shingles(text, words)
                    if not len(s):
                        continue
                    node = node_of(s)
                    at = (node * int(MIX) & 0xFFFFFFFFFFFFFFFF) >> 64 - filter_bits
                    if wanted[at >> 3] >> (7 - (at & 7)) & 1 and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        held.append(s.tobytes())
                yield pd.DataFrame({"node": np.array(nodes, np.int64), "set": held})
            trim()

        def product(key, pdf: pd.DataFrame) -> pd.DataFrame:
            a, _ = key
            sets_of = dict(zip(pdf["node"].tolist(), pdf["set"]))
            own, out = np.frombuffer(sets_of[a], np.uint64), []
            for b, m, n in zip(pdf["node"].tolist(), pdf["na"].tolist(), pdf["nb"].tolist()):
                if n:
                    shared = overlap(own, np.frombuffer(sets_of[b], np.uint64), -(-percent * (m + n) // (100 + percent)))
                    if shared >= 0:
                        out.append((a, b, shared))
            return pd.DataFrame(out, columns=["a", "b", "overlap"])

        # Copies of a set in several partitions meet in the exchange by node; each goes once to every row block that asks for it.
        held = chosen.mapInPandas(sets, "node long, set binary").repartition("node").dropDuplicates(["node"])
        full = asked.join(held, "node").groupBy("a", "block").applyInPandas(product, "a long, b long, overlap long")
        links = stored(full, f"{folder}/{name}")
        remove(spark, f"{folder}/{name}-placed")
        sent.unpersist()
        del held, full, asked, placed
        release(spark)
        return links

    # Sizes, and places of the shared column as if it were the pair's first: the pair is formed where it is, or it doesn't link.
    fits_there = "100 * least(n, m) >= {0} * greatest(n, m) and {1} * least(n - at, m - there) >= {0} * (n + m)".format(percent, 100 + percent)

    def back(rows_of: DataFrame, told_of: DataFrame) -> DataFrame:
        """rows_of with what is told of their columns (key, salts, ...): a common column's rows stay dealt as they are."""
        return rows_of.join(told_of.withColumn("salt", F.explode("salts")).drop("salts"), ["key", "salt"])

    # Each row of a column pairs with the column's pivots, its first rows by a few hashes.
    picks = [F.max(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("at").alias("there"))).alias(f"h{j}") for j in range(pivots)]
    heads = entries.groupBy("key").agg(F.collect_set("salt").alias("salts"), *picks, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    heads = heads.select("key", "salts", F.array_distinct(F.array(*[F.struct(f"h{j}.pivot", f"h{j}.m", f"h{j}.there") for j in range(pivots)])).alias("heads"))
    star = back(entries, heads).select("node", "n", "at", F.explode("heads").alias("h")).select("node", "n", "at", "h.*").where("node <> pivot").where(fits_there)
    # (pivot, row); a pair whose rows are each other's pivots stands under the larger.
    star = star.select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y"))
    tested = stored(star.groupBy("x", "y").agg(F.max(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "x", "y"), f"{folder}/star")
    first = verified(tested.select("a", "b"), "first")
    tied = stored(components(first, f"{folder}/tied"), f"{folder}/tied-nodes")
    marked = stored(entries.join(tied, "node", "left").select("key", "salt", "node", "n", "at", F.coalesce("component", "node").alias("component")), f"{folder}/marked")
    remove(spark, f"{folder}/entries")
    del entries, heads, star
    release(spark)

    # Columns whose rows are in several components: their remaining pairs, all of them. Columns of up to `small` rows form them
    # in a join. In a larger one the rows outside its largest component, the odd ones, meet all its rows, block by block, in
    # units that give only pairs within the bounds. A pair is formed in the first of its large columns alone.
    per = marked.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.collect_set("salt").alias("salts"))
    per = per.groupBy("key").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("most"), F.flatten(F.collect_set("salts")).alias("salts"), F.count(F.lit(1)).alias("parts"))
    per = per.where("parts > 1").select("key", "rows", F.array_distinct("salts").alias("salts"), F.col("most.component").alias("major"), (F.col("rows") - F.col("most.rows")).alias("odd"))
    open_rows = stored(back(marked, per), f"{folder}/open")
    remove(spark, f"{folder}/marked")
    left = open_rows.where(F.col("rows") <= small).select("key", "node", "n", "at", "component")
    right = left.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("component").alias("apart"))
    rest = left.join(right, "key").where("node < other and component <> apart").where(fits_there).select(F.col("node").alias("a"), F.col("other").alias("b"))
    large = open_rows.where(F.col("rows") > small)
    if not large.isEmpty():
        about = large.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys")).join(bitmaps.select("node", "bits"), "node")
        blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
        both = large.join(about, "node").withColumns({"nb": blocks("rows"), "no": blocks("odd"), "is_odd": F.col("component") != F.col("major")})
        common_columns = ["key", "i", "j", "node", "n", "at", "component", "keys", "bits"]
        every = both.withColumn("i", F.pmod(F.hash("node"), F.col("nb"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).select(F.lit(0).alias("side"), *common_columns)
        odd = both.where("is_odd").withColumn("j", F.pmod(F.xxhash64("node"), F.col("no")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(F.lit(1).alias("side"), *common_columns)

        def unit(key, pdf: pd.DataFrame) -> pd.DataFrame:
            own = key[0]
            pdf = pdf.reset_index(drop=True)
            signs = np.stack([folded(np.frombuffer(b, np.uint8), LEAST_BITS // 8) for b in pdf["bits"]])
            set_bits = np.bitwise_count(signs).sum(1, dtype=np.int64)
            sizes, nodes, apart, place = (pdf[c].to_numpy(np.int64) for c in ("n", "node", "component", "at"))
            keys = [k.tolist() for k in pdf["keys"]]  # in the columns' order
            earlier = [frozenset(k[: k.index(own)]) for k in keys]
            one, two = np.flatnonzero(pdf["side"] == 0), np.flatnonzero(pdf["side"] == 1)
            out = []
            for k in two.tolist():
                m, n = sizes[k], sizes[one]
                shared = np.bitwise_count(signs[k] & signs[one]).sum(1, dtype=np.int64)
                bound = np.minimum(np.minimum(m - set_bits[k], n - set_bits[one]) + shared, np.minimum(m - place[k], n - place[one]))
                fits = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & ((100 + percent) * bound >= percent * (m + n)) & (apart[one] != apart[k])
                for q in one[fits].tolist():
                    if earlier[k].isdisjoint(earlier[q]) and (100 + percent) * overlap_bound(pdf["bits"].iat[k], pdf["bits"].iat[q], m, sizes[q]) >= percent * (m + sizes[q]):
                        out.append((min(nodes[k], nodes[q]), max(nodes[k], nodes[q])))
            return pd.DataFrame(out, columns=["a", "b"])

        rest = rest.unionByName(every.unionByName(odd).groupBy("key", "i", "j").applyInPandas(unit, "a long, b long"))
    rest = rest.distinct().join(tested.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")
    second = verified(stored(rest, f"{folder}/rest"), "second")
    for name in ("open", "star", "bitmaps", "rest"):
        remove(spark, f"{folder}/{name}")
    links = first.unionByName(second)
    found = stored(components(links, f"{folder}/all"), f"{folder}/components")
    return members, links, found


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach).

    A link: 100 * intersection >= percent * union of the sets of `words`-word shingles. Copies have one set and one component.
    Null and empty texts, and texts without words, have no shingles and are linked with nothing: a component of their own. A
    null doc_id gets the component of its copies and near copies (null if it has none with an id). Repeated rows stay, and so
    do all documents of a doc_id that occurs with several texts. Texts of any length are read whole; other columns are ignored,
    whatever their names, and no rows give no rows. Sets are told apart by 64-bit hashes. Pairs inside a component are not all
    formed, so the number of a row's links isn't given.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "ngram-join")
    members, _, tied = links_of(docs, folder, words, percent)
    nodes = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    known = stored(nodes.join(tied, "node", "left"), f"{folder}/known")
    # Only linked nodes ask for their component's least id; a large component is dealt over 16 keys.
    linked = known.where("component is not null")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    linked = linked.withColumn("salt", F.pmod(F.hash("node"), F.lit(16))).join(named, ["component", "salt"]).select("node", "component_id")
    known = known.where("component is null").select("node", F.col("least").alias("component_id")).unionByName(linked)
    out = members.join(known, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
