"""Corpus gates: contamination, overlap measures, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.grams import gram_rows

SMALL_SIDE = 2_000_000
SMALL_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, most: int = SMALL_SIDE, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """df marked for broadcast if it has few enough rows, and few enough bytes in its strings and
    arrays of strings, else as it is. Counting reads at most ``most`` rows."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            width = width + F.coalesce(F.octet_length(F.array_join(name, " ")), F.lit(0))
    rows, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= most_bytes else df


def shared_ngrams(docs: DataFrame, items: DataFrame, n: int = 6, stop: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, item_id, n_shared: distinct word n-grams that a document and an item have in common. The
    items' grams, if there are at most SMALL_SIDE, go to every task as one sorted array of hashes, so
    that of the documents only grams in it leave the scan; else both sides are shuffled."""
    import numpy as np

    of_items = gram_rows(items, "item_id", "text", n, stop)
    known = [r["gram"] for r in of_items.select("gram").distinct().limit(SMALL_SIDE + 1).collect()]
    wanted = None
    if len(known) <= SMALL_SIDE:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(known, dtype=np.int64).view(np.uint64)))
        wanted = lambda: shared.value
    hits = gram_rows(docs, "doc_id", "text", n, stop, wanted).join(of_items, "gram")
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


def signature(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The distinct content words of a text, sorted."""
    return F.array_sort(F.array_distinct(T.content_words(text, stop)))


def signature_subsets(docs: DataFrame, items: DataFrame, stop: tuple[str, ...] = (), least: int = 4, n: int = 1) -> DataFrame:
    """doc_id, item_id of the items of at least ``least`` content words all of which stand in the
    document, in whatever order: the last and loosest test of a contamination gate."""
    own = items.select("item_id", "text", signature(F.col("text"), stop).alias("sig")).where(F.size("sig") >= least)
    counts = shared_ngrams(docs, own.select("item_id", F.array_join("sig", " ").alias("text")), n, stop)
    return counts.join(own.select("item_id", F.size("sig").alias("size")), "item_id").where("n_shared = size").select("doc_id", "item_id")


def contamination(docs: DataFrame, items: DataFrame, n: int = 6) -> DataFrame:
    """shared_ngrams, and whether the item stands in the document word for word."""
    pairs = shared_ngrams(docs, items, n)
    texts = items.select("item_id", F.col("text").alias("item"))
    return pairs.join(docs.select("doc_id", "text"), "doc_id").join(checked_broadcast(texts), "item_id").select("doc_id", "item_id", "n_shared", F.contains("text", "item").alias("verbatim"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(both / F.size(F.array_union(a, b)))


GRID = 1024


def similar_in_block(rows: DataFrame, block: str, words: str, threshold: float, key: str = "doc_id") -> DataFrame:
    """a, b, jaccard of the pairs of a block with word-set similarity of at least threshold. A block is
    cut into strips of GRID rows by the number of their words; strips too unlike in size hold no pair
    (a set has at least threshold times the words of one like it) and never meet. Within a cell of two
    strips the intersections are one matrix product per slice of the vocabulary. Words are compared by 64-bit hash."""
    import numpy as np
    import pyarrow as pa

    dealt = rows.where(F.size(words) > 0).select(F.col(key).cast("long").alias("id"), F.col(block).alias("block"), F.transform(words, lambda w: F.xxhash64(w)).alias("ws"))
    by_size = Window.partitionBy("block").orderBy("size", "id")
    placed = dealt.withColumn("size", F.size("ws")).withColumn("at", F.floor((F.row_number().over(by_size) - 1) / GRID).cast("int"))
    strips = placed.groupBy("block", "at").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    listed = strips.groupBy("block").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("strips"), F.sum("n").alias("n")).where("n > 1")
    least = threshold - 1e-9
    near = F.filter("strips", lambda s: (s["hi"] >= F.col("size") * F.lit(least)) & (s["lo"] * F.lit(least) <= F.col("size")) | (s["at"] == F.col("at")))
    met = placed.join(listed.select("block", "strips"), "block").select("block", "at", "id", "ws", F.explode(F.transform(near, lambda s: s["at"])).alias("other"))
    cells = met.select("block", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), "at", "id", "ws")

    def run(key, group):
        ids, at = group["id"].to_numpy(), group["at"].to_numpy()
        lists = group["ws"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        word = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        doc = np.repeat(np.arange(len(ids)), n)
        p, q = np.flatnonzero(at == key[1].as_py()), np.flatnonzero(at == key[2].as_py())
        if not len(p) or not len(q):  # none of the other strip is near in size
            return pa.table({"a": ids[:0], "b": ids[:0], "jaccard": np.empty(0)})
        both = np.zeros((len(p), len(q)), dtype=np.float32)
        order = np.argsort(word, kind="stable")
        word, doc = word[order], doc[order]
        for lo in range(0, int(word[-1]) + 1, 8192):
            i, j = np.searchsorted(word, (lo, lo + 8192))
            m = np.zeros((len(ids), 8192), dtype=np.float32)
            m[doc[i:j], word[i:j] - lo] = 1
            both += m[p] @ m[q].T
        share = both / (n[p][:, None] + n[q][None, :] - both).astype(np.float64)
        r, c = np.nonzero((share >= threshold - 1e-9) & (ids[p][:, None] != ids[q][None, :]))
        a, b = ids[p][r], ids[q][c]
        if key[1].as_py() == key[2].as_py():
            r, c, a, b = (x[ids[p][r] < ids[q][c]] for x in (r, c, a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "jaccard": share[r, c]})

    return cells.groupBy("block", "p", "q").applyInArrow(run, "a long, b long, jaccard double")


def _overlap_scores(counts: DataFrame, pair: list[str]) -> DataFrame:
    """Precision, recall and F1 from the counts e and a of each key of a pair."""
    sums = counts.groupBy(*pair).agg(F.sum(F.least("e", "a")).alias("matched"), F.sum("e").alias("expected"), F.sum("a").alias("actual"))
    m = F.col("matched").cast("double")
    f1 = lambda p, r: F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    share = lambda total, other: F.when(F.col(total) > 0, m / F.col(total)).otherwise(F.when(F.col(other) == 0, 1.0).otherwise(0.0))
    out = sums.withColumn("precision", share("actual", "expected")).withColumn("recall", share("expected", "actual"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def bag_overlap(expected: DataFrame, actual: DataFrame, pair: list[str], key: str) -> DataFrame:
    """Precision, recall and F1 of two bags per pair: matches count as often as both sides have
    them; two empty bags agree."""
    side = lambda df, e, a: df.select(*pair, key, F.lit(e).cast("long").alias("e"), F.lit(a).cast("long").alias("a"))
    both = side(expected, 1, 0).unionByName(side(actual, 0, 1))
    return _overlap_scores(both.groupBy(*pair, key).agg(F.sum("e").alias("e"), F.sum("a").alias("a")), pair)


def list_overlap(rows: DataFrame, pair: list[str], expected: str, actual: str) -> DataFrame:
    """bag_overlap of two columns of arrays: each pair's row is read once."""
    tagged = lambda c, e: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(e).cast("long").alias("e"), F.lit(1 - e).cast("long").alias("a")))
    words = rows.select(*pair, F.explode(F.concat(tagged(expected, 1), tagged(actual, 0))).alias("x")).select(*pair, "x.*")
    return _overlap_scores(words.groupBy(*pair, "w").agg(F.sum("e").alias("e"), F.sum("a").alias("a")), pair)


def furniture(pages: DataFrame, book: str, page: str, line: str, ratio: float = 0.5, least: int = 3) -> DataFrame:
    """Running lines: shapes (digits masked) found on at least ratio of a book's pages, and on
    least pages; with their support."""
    total = pages.groupBy(book).agg(F.count_distinct(page).alias("pages"))
    shapes = pages.groupBy(book, T.digit_mask(F.col(line)).alias("shape")).agg(F.count_distinct(page).alias("support"))
    return shapes.join(total, book).where((F.col("support") >= least) & (F.col("support") >= F.ceil(F.col("pages") * F.lit(ratio))))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child without a row of parent."""
    return child.join(parent.select(key), key, "left_anti")


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).count().where("count > 1")


def reader_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, only_a, only_b: words that one reader's text (doc_id, text) has and the other's has not."""
    both = a.select("doc_id", T.words(F.col("text")).alias("x")).join(b.select("doc_id", T.words(F.col("text")).alias("y")), "doc_id", "full_outer")
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("x", "y"))
    return both.select("doc_id", F.array_sort(F.array_except(x, y)).alias("only_a"), F.array_sort(F.array_except(y, x)).alias("only_b"))


def style_chains(styles: DataFrame, most: int = 32) -> DataFrame:
    """style_id, depth, ancestor of every style (style_id, based_on), the style itself at depth 0; a chain
    that comes back to itself, or is longer than most, is broken and left out."""
    edges = styles.select(F.col("style_id").alias("from_id"), "based_on").where("based_on is not null")
    level = styles.select("style_id", F.lit(0).alias("depth"), F.col("style_id").alias("ancestor"))
    found, depth = level, 0
    broken = styles.select("style_id").limit(0)
    while depth <= most:
        depth += 1
        level = level.join(edges, level["ancestor"] == edges["from_id"]).select("style_id", F.lit(depth).alias("depth"), F.col("based_on").alias("ancestor"))
        back = level.where("ancestor = style_id")
        if level.isEmpty():
            return found.join(broken, "style_id", "left_anti")
        broken = broken.union(back.select("style_id"))
        level = level.where("ancestor <> style_id")
        found = found.union(level)
    return found.join(broken.union(level.select("style_id")).distinct(), "style_id", "left_anti")
