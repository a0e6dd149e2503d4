"""Restatements, near-duplicate pairs and what merges them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T

PAIR_CAP = 24
BLOCK = 4096


def merge_restatements(units: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Units with equal keys become one: the first keeps its place; in order, a unit replaces text
    and confidence's owner if it has more authority, or as much and more confidence; authority and
    confidence then become the greater of both, each by itself, which is why this is a fold.

    A unit with the authority and confidence of an earlier one replaces nothing, so that the fold
    needs the first unit of each pair of them alone (and the first with a rationale)."""
    unit = F.struct(*order, "text", "rationale", "authority", "confidence")
    state = lambda e: F.struct(e["text"].alias("text"), e["rationale"].alias("rationale"), e["authority"].alias("authority"), e["confidence"].alias("confidence"))

    def step(s, e):
        better = (e["authority"] > s["authority"]) | ((e["authority"] == s["authority"]) & (e["confidence"] > s["confidence"]))
        return F.struct(
            F.when(better, e["text"]).otherwise(s["text"]).alias("text"),
            F.when(better, F.coalesce(e["rationale"], s["rationale"])).otherwise(F.coalesce(s["rationale"], e["rationale"])).alias("rationale"),
            F.greatest(s["authority"], e["authority"]).alias("authority"),
            F.greatest(s["confidence"], e["confidence"]).alias("confidence"),
        )

    firsts = units.groupBy(*key, "authority", "confidence", F.col("rationale").isNull().alias("bare")).agg(F.min(unit).alias("unit"), F.count("*").alias("n"))
    grouped = firsts.groupBy(*key).agg(F.array_sort(F.collect_list("unit")).alias("units"), F.sum("n").cast("int").alias("n_units"))
    folded = grouped.withColumn("m", F.aggregate(F.slice("units", F.lit(2), F.size("units")), state(F.element_at("units", 1)), step))
    # Distinct by hash: array_distinct compares each struct with all others.
    sources = units.groupBy(*key).agg(F.sort_array(F.collect_set("source")).alias("sources"))
    same = reduce(lambda x, y: x & y, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key))
    both = folded.alias("l").join(sources.alias("r"), same)
    return both.select(*(F.col(f"l.{c}").alias(c) for c in key), F.element_at("units", 1).getField(order[0]).alias(order[0]), "m.*", "n_units", "sources")


def fold_restatements(units: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """merge_restatements without rationale and sources: key, the first unit's order, text, authority,
    confidence, n_units. The fold runs over each group's sorted rows as they stream by, with a unit's
    worth of state, so that a fact found in most documents need not fit in memory."""
    kinds = {f.name: f for f in units.schema.fields}
    schema = StructType([*(kinds[c] for c in key), *(kinds[c] for c in order), kinds["text"], StructField("authority", DoubleType()), StructField("confidence", DoubleType()), StructField("n_units", LongType())])
    names = [*key, *order, "text", "authority", "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                own, (text, authority, confidence) = row[: len(key)], row[-3:]
                if state is None or own != now:
                    if state is not None:
                        out.append(state)
                    now, state = own, [*row, 1]
                    continue
                if authority > state[-3] or authority == state[-3] and confidence > state[-2]:
                    state[-4] = text
                state[-3:] = max(state[-3], authority), max(state[-2], confidence), state[-1] + 1
            yield packed(out)
        yield packed([state] if state is not None else [])

    types = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)], names=[t.name for t in types])

    given = units.select(*key, *order, "text", F.coalesce("authority", F.lit(0.0)).cast("double").alias("authority"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"))
    return given.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def restatement_counts(units: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """As merge_restatements, without texts: no list of a group's units is built, so that a line
    found in most documents is no burden."""
    return units.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_units"), F.max("authority").alias("authority"), F.count_distinct("doc_id").alias("n_sources"))


def sound_vectors(vectors: DataFrame, category: str) -> DataFrame:
    """vec_id, category, embedding (doubles) of the rows that can be compared: with an id and a category,
    no null, NaN or infinite element, and as many elements as most have (of equally common lengths
    the greatest)."""
    own = vectors.select("vec_id", F.col(category).alias("category"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and category is not null and size(embedding) > 0")
    own = own.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).select("d")
    return own.join(F.broadcast(common), F.size("embedding") == F.col("d")).drop("d")


def _blocks(own: DataFrame, across: bool) -> DataFrame:
    """Pairs of blocks of at most about BLOCK vectors: of each category, by its own size, or of all."""
    if across:
        sized = own.withColumn("side", F.lit(max(1, -(-own.count() // BLOCK)))).withColumn("group", F.lit(0))
    else:
        sizes = own.groupBy("category").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("side"))
        sized = own.join(sizes, "category").withColumn("group", F.col("category"))
    placed = sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("side")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("with_")).select("*", F.least("block", "with_").alias("p"), F.greatest("block", "with_").alias("q"))
    return cells.select("group", "p", "q", "vec_id", "category", "embedding", (F.col("block") == F.col("p")).alias("in_p"), (F.col("block") == F.col("q")).alias("in_q"))


def similar_pairs(vectors: DataFrame, threshold: float, category: str = "label", across: bool = False) -> DataFrame:
    """category_a, category_b, a, b, similarity: pairs (a < b) with cosine of at least threshold, within
    a category or, across, of two. Exact: matrix products over a grid of blocks, quadratic in a category's
    size, or in the table's. Rows that sound_vectors leaves out are in no pair; ids and categories may
    be numbers or texts."""
    own = sound_vectors(vectors, category)
    id_type, kind = own.schema["vec_id"].dataType, own.schema["category"].dataType
    schema = StructType([StructField("category_a", kind), StructField("category_b", kind), StructField("a", id_type), StructField("b", id_type), StructField("similarity", DoubleType())])

    def run(group: pa.Table) -> pa.Table:
        ids, cat = np.array(group["vec_id"].to_pylist()), np.array(group["category"].to_pylist())
        x = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        p, q = np.flatnonzero(group["in_p"].to_numpy(zero_copy_only=False)), np.flatnonzero(group["in_q"].to_numpy(zero_copy_only=False))
        out = []
        for at in range(0, len(p), 512):
            i = p[at : at + 512]
            sim = np.round(x[i] @ x[q].T, 6)
            r, c = np.nonzero(sim >= threshold)
            a, b, s = i[r], q[c], sim[r, c]
            swap = ids[a] > ids[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            keep = (ids[a] < ids[b]) & ((cat[a] != cat[b]) if across else (cat[a] == cat[b]))
            out.append(np.rec.fromarrays([a[keep], b[keep], s[keep]], names="a,b,s"))
        f = np.concatenate(out) if out else np.rec.fromarrays([np.empty(0, int), np.empty(0, int), np.empty(0)], names="a,b,s")
        if len(f):
            f = f[np.unique(np.stack([f["a"], f["b"]], axis=1), axis=0, return_index=True)[1]]
        rows = pa.array(f["a"]), pa.array(f["b"])
        columns = [group["category"].take(rows[0]), group["category"].take(rows[1]), group["vec_id"].take(rows[0]), group["vec_id"].take(rows[1]), pa.array(f["s"])]
        return pa.table(dict(zip(schema.names, columns)))

    return _blocks(own, across).groupBy("group", "p", "q").applyInArrow(run, schema)


def top_across(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The most similar pairs of different categories, for a reader to look at."""
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(most)


def capped_pairs(pairs: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """The most similar pairs of each category; the cap is the operator's: what is adjudicated."""
    w = Window.partitionBy("category_a").orderBy(F.desc("similarity"), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def absorb(pairs: DataFrame) -> DataFrame:
    """Greedy walk over each category's capped pairs, best first: a pair with an absorbed member is
    passed over, else its second member is absorbed by its first. root: by whom it is held in the end,
    where its own keeper was absorbed later."""
    pair = F.struct("rank", "a", "b")
    kind = pairs.schema["a"].dataType.simpleString()
    start = F.array().cast(f"array<struct<kept:{kind},absorbed:{kind},root:{kind}>>")

    def step(s, e):
        free = ~F.exists(s, lambda x: (x["absorbed"] == e["a"]) | (x["absorbed"] == e["b"]))
        moved = F.transform(s, lambda x: F.struct(x["kept"].alias("kept"), x["absorbed"].alias("absorbed"), F.when(x["root"] == e["b"], e["a"]).otherwise(x["root"]).alias("root")))
        return F.when(free, F.concat(moved, F.array(F.struct(e["a"].alias("kept"), e["b"].alias("absorbed"), e["a"].alias("root"))))).otherwise(s)

    walked = pairs.groupBy("category_a").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return walked.select(F.col("category_a").alias("category"), F.explode(F.aggregate("pairs", start, step)).alias("m")).select("category", "m.kept", "m.absorbed", "m.root")


def shortlist(units: DataFrame, embeddings: DataFrame, threshold: float, cap: int = PAIR_CAP) -> DataFrame:
    """category, rank, a, b, similarity: of each category the most similar pairs of units (unit_id, category,
    entity_key, text, first: what orders them), by the vectors in embeddings (unit_id, embedding); a comes
    first in order. Units that name different entities are about different things, whatever their vectors."""
    own = units.select(F.col("unit_id").alias("vec_id"), "category").join(embeddings.select(F.col("unit_id").alias("vec_id"), "embedding"), "vec_id")
    pairs = similar_pairs(own, threshold, "category")
    side = lambda x: units.select(F.col("unit_id").alias(x), F.col("entity_key").alias(f"key_{x}"), F.col("text").alias(f"text_{x}"), F.col("first").alias(f"first_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("key_a is null or key_b is null or key_a = key_b")
    swap = F.col("first_b") < F.col("first_a")
    turned = both.select("category_a", "category_b", "similarity", *(F.when(swap, F.col(f"{c}_{y}" if c else y)).otherwise(F.col(f"{c}_{x}" if c else x)).alias(f"{c}_{x}" if c else x) for c in ("", "text") for x, y in (("a", "b"), ("b", "a"))))
    return capped_pairs(turned, cap)


def decide(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """pairs with state: 'merge' where an adjudicator's answer (a, b, same_fact, surviving_text; in either order
    of a and b) says so and the texts agree in what is salient, 'vetoed' where they don't, else
    'apart'. Where the surviving text is b's, a and b change places: the first keeps."""
    either = answers.select("a", "b", "same_fact", "surviving_text").unionByName(answers.select(F.col("b").alias("a"), F.col("a").alias("b"), "same_fact", "surviving_text"))
    one = either.groupBy("a", "b").agg(F.max(F.struct("same_fact", "surviving_text")).alias("said"))
    joined = pairs.join(one, ["a", "b"], "left")
    yes = F.coalesce(F.col("said.same_fact"), F.lit(False))
    state = F.when(~yes, "apart").when(T.merge_verdict(F.col("text_a"), F.col("text_b")) == "block", "vetoed").otherwise("merge")
    swap = F.coalesce(F.col("said.surviving_text") == F.col("text_b"), F.lit(False))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return joined.withColumn("state", state).select("category_a", "category_b", "similarity", "rank", "state", pick("a", "b"), pick("b", "a"), pick("text_a", "text_b"), pick("text_b", "text_a"))


def resolve_merges(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Units after adjudication: of those merged one row stays. decisions: root (or kept), absorbed and,
    if the adjudicator wrote a text of its own, surviving_text. Where units have them, sources are put
    together and authority and confidence are the greatest; what is absorbed keeps no row."""
    keeper = "root" if "root" in decisions.columns else "kept"
    said = F.col("surviving_text") if "surviving_text" in decisions.columns else F.lit(None).cast("string")
    own = decisions.select(F.col(keeper).alias("root"), "absorbed", said.alias("said"))
    chosen = own.groupBy("root").agg(F.max_by("said", F.struct("absorbed")).alias("chosen"))
    rest = units.join(own.select(F.col("absorbed").alias("unit_id")), "unit_id", "left_anti").join(chosen, F.col("unit_id") == F.col("root"), "left").withColumn("text", F.coalesce("chosen", "text")).drop("root", "chosen")
    extra = [c for c in ("sources", "authority", "confidence") if c in units.columns]
    if not extra:
        return rest
    gone = own.join(units.select(F.col("unit_id").alias("absorbed"), *extra), "absorbed")
    sums = {"sources": lambda c: F.flatten(F.collect_list(c)), "authority": F.max, "confidence": F.max}
    taken = gone.groupBy(F.col("root").alias("unit_id")).agg(*(sums[c](c).alias(f"{c}_too") for c in extra))
    joined = rest.join(taken, "unit_id", "left")
    for c in extra:
        both = F.array_sort(F.array_distinct(F.concat("sources", F.coalesce("sources_too", F.array().cast(units.schema["sources"].dataType))))) if c == "sources" else F.greatest(c, f"{c}_too")
        joined = joined.withColumn(c, both)
    return joined.select(units.columns)
