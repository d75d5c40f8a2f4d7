"""Benchmark decontamination by SimHash of item-sized windows.

Windows of every item length are taken from the documents and fingerprinted
with a 64-bit SimHash over their weighted word shingles, a shingle weighing as
many as its words have characters.  A multi-index of BLOCKS bit blocks over the
fingerprints of all items finds, for every window, each item of its length
within RADIUS = BLOCKS - 1 bits: two such fingerprints differ in fewer bits
than there are blocks, so they agree in one block at least.  What lies within
the radius is verified by the exact weighted Jaccard similarity of the two
shingle multisets.

A window needs no fingerprint where it cannot be alike: the similarity reaches
``least`` only if shingles that it shares with an item weigh ``least`` times
the item's weight.  For every start of a window, not for chosen ones only, that
weight is bounded by the sum over the shared shingles inside, the difference of
two running sums over their places.  Starts below the bound are left out; of a
leak some tens remain, of a text that shares phrases only none.

Only DataFrame expressions are used: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.llm.common import fit_to_send, keyed_text, settle

#: Blocks of the multi-index, and the Hamming radius that they guarantee.
BLOCKS = 20
RADIUS = BLOCKS - 1
#: Words are runs of letters and digits, lower-cased.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def runs_of(words: Column, k: int | Column, body) -> Column:
    """``body`` of each run of k words and its place; none if there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - k + 1))
    return F.when(F.size(words) >= k, F.transform(places, lambda i: body(F.slice(words, i, k), i - 1))).otherwise(F.slice(F.transform(F.array(F.lit(1)), lambda i: body(F.slice(words, i, k), i - 1)), 1, 0))


def weight_of(run: Column) -> Column:
    """Characters of a run's words."""
    return F.length(F.array_join(run, ""))


def weighted(words: Column, k: int) -> Column:
    """Shingles of a window as (text, weight); with fewer than k words the whole is one shingle."""
    one = lambda run, i=None: F.struct(F.array_join(run, " ").alias("s"), weight_of(run).alias("w"))
    return let(words, lambda w: F.when(F.size(w) >= k, runs_of(w, k, one)).otherwise(F.array(one(w))))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash: bit b is set where the weights of shingles with it exceed the others'."""
    def vote(hashed: Column, b: Column) -> Column:
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.getbit(x["h"], b) == 1, x["w"]).otherwise(-x["w"]).cast("long"))

    hashed = F.transform(shingles, lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), x["w"].alias("w")))
    bits = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(vote(h, b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def block_values(fingerprint: Column) -> Column:
    """(block, value) of all blocks: the first 64 mod BLOCKS blocks are one bit wider."""
    narrow, wide = divmod(64, BLOCKS)
    out, at = [], 0
    for b in range(BLOCKS):
        width = narrow + (b < wide)
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append(F.struct(F.lit(b).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle multisets: sum of minima over sum of maxima."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda acc, s: acc + s["w"])

    def common(x: Column, y: Column) -> Column:
        # the n-th occurrence of a shingle on one side meets the n-th on the other
        def numbered(z: Column) -> Column:
            return let(F.array_sort(z), lambda s: F.transform(s, lambda e, i: F.struct(e["s"].alias("s"), e["w"].alias("w"), (i - F.array_position(F.transform(s, lambda t: t["s"]), e["s"]).cast("int")).alias("n"))))

        return total(F.array_intersect(numbered(x), numbered(y)))

    return let(F.struct(common(a, b).alias("both"), (total(a) + total(b)).alias("all")), lambda t: t["both"] / F.greatest(F.lit(1), t["all"] - t["both"]))


def shared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item, m, need, at, w): places in documents of shingles that an item has, too, in one scan of the documents."""
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # k values at most
    place = lambda k: lambda run, i: F.struct(F.lit(k).alias("k"), i.alias("at"), F.xxhash64(run).alias("h"))
    every = let(words_of(F.col("text")), lambda w: F.concat(*[runs_of(w, k, place(k)) for k in lengths]))
    known = items.select("item", "m", "k", "need", F.explode(runs_of(F.col("item_words"), F.col("k"), lambda run, i: F.struct(F.xxhash64(run).alias("h"), weight_of(run).cast("long").alias("w")))).alias("r")).select("item", "m", "k", "need", "r.h", "r.w").distinct()
    return docs.select("doc_id", F.inline(every)).join(fit_to_send(known), ["k", "h"]).select("doc_id", "item", "m", "k", "need", "at", "w").distinct()


def starts(hits: DataFrame) -> DataFrame:
    """(doc_id, m, start_word) of all windows whose shared shingles weigh enough for some item.

    A start belongs to the first shared shingle that its window holds, so the weight inside is a
    running sum up to the window's last place less one before that shingle.
    """
    pair = Window.partitionBy("doc_id", "item")
    upto = pair.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = hits.withColumn("before", F.sum("w").over(upto) - F.col("w")).withColumn("last_at", F.lag("at").over(pair.orderBy("at")))

    # first by each shared shingle as the window's start: the most that any start which belongs to it can hold
    running = pair.orderBy("place", "ask").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.sum(F.when(F.col("ask") == 0, F.col("w")).otherwise(F.lit(0).cast("long"))).over(running)
    two = F.array(F.struct(F.lit(0).alias("ask"), F.col("at").alias("place")), F.struct(F.lit(1).alias("ask"), (F.col("at") + F.col("m") - F.col("k")).alias("place")))
    heavy = held.select("*", F.inline(two)).withColumn("inside", weight - F.col("before")).filter((F.col("ask") == 1) & (F.col("inside") >= F.col("need")))
    # then by each start
    lowest = F.greatest(F.lit(0), F.col("at") - F.col("m") + F.col("k"), F.coalesce(F.col("last_at") + 1, F.lit(0)))
    tried = heavy.withColumn("start_word", F.explode(F.sequence(lowest, F.col("at")))).select("doc_id", "item", "m", "need", F.lit(1).alias("ask"), (F.col("start_word") + F.col("m") - F.col("k")).alias("place"), F.lit(0).cast("long").alias("w"), "before", "start_word")
    known = hits.select("doc_id", "item", "m", "need", F.lit(0).alias("ask"), F.col("at").alias("place"), "w", F.lit(0).cast("long").alias("before"), F.lit(-1).alias("start_word"))
    both = tried.union(known).withColumn("inside", F.sum("w").over(running) - F.col("before"))
    return both.filter((F.col("ask") == 1) & (F.col("inside") >= F.col("need"))).select("doc_id", "m", "start_word").distinct()


def find(df: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Leaked items: (doc_id, item_id, start_word, n_words, similarity), the best window of each pair.

    A row says that the n_words words of a document from the word start_word (from 0) on have a
    weighted shingle similarity of at least ``least`` with the item; of equally similar windows the
    first.  A window has as many words as the item, or those up to the document's end.  A pair at
    exactly ``least`` is lost with a chance of about 0.0003, as its fingerprints may lie beyond the
    radius.  Null and wordless texts and items match nothing, an item with fewer than k words is one
    shingle, equal rows count once, each text of a repeated id is searched, rows without an id take
    no part, other columns are ignored, and an empty table gives an empty result.  The items are
    broadcast only if their shingles were counted to be few.
    """
    docs = keyed_text(df, id_col, text_col).filter("doc_id IS NOT NULL")
    total = lambda shingles: F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + x["w"])
    items = settle(
        benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item_words"))
        .filter(F.col("item_id").isNotNull() & (F.size("item_words") > 0))
        .distinct()
        .withColumn("m", F.size("item_words"))
        .withColumn("k", F.least("m", F.lit(k)))
        .withColumn("item_shingles", weighted(F.col("item_words"), k))
        .withColumn("need", F.lit(least) * total(F.col("item_shingles")))
        .withColumn("item_fingerprint", simhash(F.col("item_shingles")))
        .withColumn("item", F.xxhash64("item_id", "item_words"))
    )
    if items.isEmpty():
        return df.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_word int, n_words int, similarity double")
    windows = settle(starts(settle(shared(docs, items))))

    held = docs.join(fit_to_send(windows.select("doc_id").distinct()), "doc_id").distinct().select("doc_id", words_of(F.col("text")).alias("words"))
    cut = windows.join(held, "doc_id").select("doc_id", "m", "start_word", F.slice("words", F.col("start_word") + 1, F.col("m")).alias("window")).filter(F.size("window") > 0)
    marked = settle(cut.withColumn("n_words", F.size("window")).withColumn("shingles", weighted(F.col("window"), k)).withColumn("fingerprint", simhash(F.col("shingles"))).drop("window"))

    # the multi-index: a window meets every item of its length that has the same bits in some block
    left = marked.select("doc_id", "start_word", "m", "fingerprint", F.inline(block_values(F.col("fingerprint"))))
    right = items.select("item", "m", "item_fingerprint", F.inline(block_values(F.col("item_fingerprint"))))
    near = left.join(fit_to_send(right), ["m", "block", "value"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS)
    near = near.select("doc_id", "start_word", "m", "fingerprint", "item").distinct()

    known = fit_to_send(items.select("item", "item_id", "item_shingles"))
    checked = near.join(marked, ["doc_id", "start_word", "m", "fingerprint"]).join(known, "item").withColumn("similarity", similarity(F.col("shingles"), F.col("item_shingles"))).filter(F.col("similarity") >= least)
    best = checked.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("x"), "start_word", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.start_word", "b.n_words", (-F.col("b.x")).alias("similarity"))
