"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are hashed word n-grams.
Two rows whose Jaccard similarity reaches num/den share a column among the
first n - ceil(n * num / den) + 1 of each, in one fixed order of columns, so
the product only has to visit those columns (the prefix).  Any order is
correct.  Columns that were counted to be in very many prefixes come last, the
others by falling length, as long n-grams are rare; so a line that a large share
of all documents holds is only visited for documents that hold little else.
Each column with two documents or more is a block of the product; a column with
many is cut into tiles of BLOCK by BLOCK documents.

Inside a block a pair is discarded by bounds derived from the sizes: the sizes
must be within num/den of each other, and the symmetric difference may be at
most a + b - 2 * ceil(num * (a + b) / (num + den)).  Each row carries a parity
sketch (bit i counts, modulo 2, the grams that fall on i); bits that differ
between two sketches are a lower bound of that difference.  What passes is
counted exactly from the full rows.

Groups of copies do not expand into all pairs.  Equal sets are one class from
the start.  A block passes on no more than a spanning forest of the pairs that
the bounds leave, so the forests' components (clusters) hold every true
component whole; of a column that is in very many prefixes even after the
reordering, rows of like sizes are simply put into one cluster.  The full rows
are then dealt out by cluster, and there the overlaps of pairs that are not yet
connected are counted exactly; a tile returns a spanning forest of the true
links.  A large cluster is first linked inside its tiles, each row once, then
by a few rows of every component found; only what is still apart from the
cluster's largest component is compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paravane.llm.common import arrow_map, fit_to_send, keyed_text, passing, retain, settle, slices, text_slices, without_repeats
from paravane.llm.components import connected
from paravane.llm.words import mix, shingle_sets

#: Documents of a tile's side, bytes of its rows, and bits of a sketch at most.
BLOCK, BLOCK_BYTES, MOST_BITS = 4096, 32 << 20, 4096
#: A column in more prefixes than this many blocks hold, or than this share of all rows, comes last;
#: in any case one above this share of all prefix entries, which bounds the number of such columns.
HEAVY_BLOCKS, HEAVY_ROWS, HEAVY_SHARE = 4, 32, 100_000
#: Times that prefixes are made anew with the columns last that were found to be heavy.
REORDERINGS = 1
#: Rows by which a component of a large cluster is compared first.
SPEAKERS = 4
#: Bits of a sketch made from a full row, for each gram of the difference that still links.
EXACT_BITS = 32


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def most_apart(a, b, num: int, den: int):
    """The largest symmetric difference of sets of sizes a and b that still link."""
    return a + b - 2 * -(-(a + b) * num // (num + den))


def prefix(grams: np.ndarray, sizes: np.ndarray, num: int, den: int, last: np.ndarray | None = None) -> np.ndarray:
    """The first columns of a row in the order of columns: those of ``last`` (sorted) at the end, else by falling length, then by hash."""
    order = ((np.uint64(127) - np.minimum(sizes >> 1, 127).astype(np.uint64)) << np.uint64(56)) | (grams >> np.uint64(8))
    if last is not None and len(last):
        order |= (last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams).astype(np.uint64) << np.uint64(63)
    return grams[np.argsort(order, kind="stable")[: prefix_length(len(grams), num, den)]]


def sketch(grams: np.ndarray, num: int, den: int, wide: int = 4) -> bytes:
    """Parities of the grams by their low mixed bits.

    The length is a power of two, about ``wide`` times the difference that still links, so that few
    bits coincide; beyond MOST_BITS the bound is weaker, and more pairs are left to the exact count.
    """
    allowed = most_apart(len(grams), len(grams), num, den)
    bits = min(MOST_BITS, max(128, 1 << (wide * allowed).bit_length()))
    return np.packbits(np.bincount((mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold_to(x: int, bits: int, target: int) -> int:
    """A sketch of fewer bits: halves laid over each other."""
    while bits > target:
        bits >>= 1
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def profile(docs: DataFrame, k: int, num: int, den: int, last: list[int] | None = None) -> DataFrame:
    """(doc_id, n, f1, f2, grams, sketch): set size, fingerprint, prefix and parity sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(last or [], np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            n, f1, f2, head, bits = [], [], [], [], []
            for grams, sizes in shingle_sets([t or "" for t in part.column("text").to_pylist()], k):
                n.append(len(grams))
                f1.append(int(mix(grams).sum().view(np.int64)) if len(grams) else 0)
                f2.append(int(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if len(grams) else 0)
                head.append(prefix(grams, sizes, num, den, shared.value).view(np.int64) if len(grams) else [])
                bits.append(sketch(grams, num, den) if len(grams) else b"")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(head, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n", "f1", "f2", "grams", "sketch"])

    return arrow_map(docs, run, "doc_id long, n long, f1 long, f2 long, grams array<long>, sketch binary")


def both_have(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted rows."""
    if len(u) > len(v):
        u, v = v, u
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())


class Block:
    """Rows (id, size, sketch, side, component) of one tile, ordered by size.

    With ``exact`` the third member is the full row, from which the sketch is made.  Rows of one
    component are connected already.
    """

    def __init__(self, rows: list[tuple], num: int, den: int, two_sided: bool, exact: bool):
        rows.sort(key=lambda r: (r[1], r[0]))
        self.num, self.den, self.two_sided, self.exact = num, den, two_sided, exact
        self.ids = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.sides = np.array([r[3] for r in rows], np.int8)
        self.known = np.array([r[4] for r in rows], np.int64)
        self.full = [np.frombuffer(r[2], np.uint64) for r in rows] if exact else []
        self.sketches = [sketch(g, num, den, EXACT_BITS) for g in self.full] if exact else [r[2] for r in rows]
        self.levels: dict[int, np.ndarray] = {}

    def level(self, i: int, bits: int) -> np.ndarray:
        """Sketches of the rows from i on, folded to ``bits``; rows before the first of that length stay empty."""
        if bits not in self.levels:
            out = np.zeros((len(self.ids), bits // 64), np.uint64)
            for j in range(i, len(self.ids)):
                raw = self.sketches[j]
                have = len(raw) * 8
                out[j] = np.frombuffer(raw if have == bits else fold_to(int.from_bytes(raw, "little"), have, bits).to_bytes(bits // 8, "little"), np.uint64)
            self.levels[bits] = out
        return self.levels[bits]

    def near(self, i: int, label: np.ndarray) -> np.ndarray:
        """Larger rows under another label that the bounds let link with row i."""
        end = int(np.searchsorted(self.sizes, self.sizes[i] * self.den // self.num, side="right"))
        other = label[i + 1 : end] != label[i]
        if self.two_sided:
            other &= self.sides[i + 1 : end] != self.sides[i]
        found = i + 1 + np.flatnonzero(other)
        if not len(found):
            return found
        at = self.level(i, len(self.sketches[i]) * 8)
        apart = np.bitwise_count(at[found] ^ at[i]).sum(axis=1, dtype=np.int64)
        return found[apart <= most_apart(self.sizes[i], self.sizes[found], self.num, self.den)]

    def linked(self, i: int, j: int) -> bool:
        both = both_have(self.full[i], self.full[j])
        return self.den * both >= self.num * (len(self.full[i]) + len(self.full[j]) - both)

    def forest(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the pairs that the bounds leave or, with full rows, of the true links."""
        label = np.unique(self.known, return_inverse=True)[1]
        for i in range(len(self.ids) - 1):
            found = self.near(i, label)
            while len(found):
                j = int(found[0])
                if not self.exact or self.linked(i, j):
                    yield self.ids[i], self.ids[j]
                    label[label == label[j]] = label[i]
                found = found[1:]
                found = found[label[found] != label[i]]


def pair_of_two(a: tuple, b: tuple, num: int, den: int) -> bool:
    """The bounds for a block of two rows with sketches, without arrays."""
    if a[1] > b[1]:
        a, b = b, a
    if a[0] == b[0] or a[1] * den < b[1] * num:
        return False
    bits = len(a[2]) * 8
    x = int.from_bytes(a[2], "little") ^ fold_to(int.from_bytes(b[2], "little"), len(b[2]) * 8, bits)
    return x.bit_count() <= most_apart(a[1], b[1], num, den)


def tiled(rows: DataFrame, key: str) -> DataFrame:
    """(key, ti, tj, side, rep, n, payload, component): a block of t tiles a side, dealt to its t * (t + 1) / 2 pairs of tiles."""
    own = F.expr("int(pmod(xxhash64(rep), tiles))")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return spread.select(key, F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), F.expr("cast(own > other as tinyint)").alias("side"), "rep", "n", "payload", "component")


def forests(dealt: DataFrame, key: str, num: int, den: int, exact: bool) -> DataFrame:
    """Distinct (a, b) of the blocks' forests, for rows (key, ti, tj, side, rep, n, payload, component).

    Rows of two sides are only compared with those of the other; of one side with each other.
    """
    keys = [key, "ti", "tj"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "rep", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: set[tuple[int, int]] = set()

        def flush() -> None:
            if len(held) == 2 and not exact and now[1] == now[2]:
                if pair_of_two(held[0], held[1], num, den):
                    out.add((min(held[0][0], held[1][0]), max(held[0][0], held[1][0])))
            elif len(held) >= 2:
                out.update((min(p), max(p)) for p in Block(held, num, den, now[1] != now[2], exact).forest())

        def batch_of(pairs: set) -> pa.RecordBatch:
            some = sorted(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64())], names=["a", "b"])

        for batch in slices(batches):
            for g, ti, tj, side, rep, n, payload, component in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (g, ti, tj) != now:
                    flush()
                    now, held = (g, ti, tj), []
                if not held or held[-1][:3] != (rep, n, payload):  # tasks may have passed on one row each
                    held.append((rep, n, payload, side, component))
            if len(out) > 200_000:
                yield batch_of(out)
                out.clear()
        flush()
        yield batch_of(out)

    return arrow_map(dealt, run, "a long, b long").distinct()


def like_sizes(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that put the rows of a column into one cluster as far as their sizes may link.

    Sizes that link fall into one step of a geometric scale or into neighbouring ones.  Each row is
    linked with its step's least row, and that with the next step's: no row meets all others.
    """
    sized = entries.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)) if num < den else 1.0) + 1e-9))
    least = sized.groupBy("gram", "step").agg(F.min("rep").alias("hub"))
    inside = sized.join(least, ["gram", "step"]).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    across = least.join(least.select("gram", (F.col("step") - 1).alias("step"), F.col("hub").alias("next")), ["gram", "step"]).select(F.col("hub").alias("a"), F.col("next").alias("b"))
    return inside.union(across)


def large_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that connect the true components of large clusters; rows are (cluster, tiles, rep, n, payload)."""
    own = F.expr("int(pmod(xxhash64(rep), tiles))")
    one_side = lambda df, tile: df.select("cluster", tile.alias("ti"), tile.alias("tj"), F.lit(0).cast("tinyint").alias("side"), "rep", "n", "payload", "component")
    links = settle(forests(one_side(rows.withColumn("component", F.col("rep")), own), "cluster", num, den, exact=True))

    def marked(links: DataFrame) -> DataFrame:
        found = settle(connected(links)).select(F.col("node").alias("rep"), F.col("component").alias("reached"))
        return rows.join(found, "rep", "left").withColumn("component", F.coalesce("reached", "rep")).drop("reached")

    # a few rows speak for each component, in tiles of their own
    by = marked(links)
    ranked = by.select("cluster", "rep", "component").withColumn("k", F.row_number().over(Window.partitionBy("cluster", "component", F.expr("pmod(xxhash64(rep), 64)")).orderBy(F.xxhash64("rep"))))
    ranked = ranked.filter(F.col("k") <= SPEAKERS).withColumn("k", F.row_number().over(Window.partitionBy("cluster", "component").orderBy(F.xxhash64("rep")))).filter(F.col("k") <= SPEAKERS)
    speakers = ranked.select("cluster", "rep")
    counts = speakers.groupBy("cluster").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("tiles"))
    speaking = by.drop("tiles").join(speakers, ["cluster", "rep"], "left_semi").join(counts, "cluster")
    links = settle(links.union(forests(tiled(speaking, "cluster"), "cluster", num, den, exact=True)))

    # what is still apart from the largest component meets all of it, and what else is apart
    by = marked(links)
    sizes = settle(by.groupBy("cluster", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")))
    base = sizes.groupBy("cluster").agg(F.max(F.struct("rows", "component")).alias("m"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams")).filter("parts > 1")
    apart = sizes.join(base.select("cluster", F.col("m.component").alias("component")), ["cluster", "component"], "left_anti").groupBy("cluster").agg(F.sum("rows").alias("r"), F.sum("grams").alias("g"))
    tiles = lambda rows, grams: F.expr(f"int(greatest(1, ceil({rows} / {BLOCK}), ceil(8 * {grams} / {BLOCK_BYTES})))")
    plan = base.join(apart, "cluster").select("cluster", F.col("m.component").alias("base"), tiles("rows", "grams").alias("across"), tiles("r", "g").alias("rest"))
    left = by.drop("tiles").join(plan, "cluster")
    rest = left.filter("component <> base").withColumn("tiles", F.col("rest"))
    among = tiled(rest, "cluster")
    # tile of the base: -1 - its number; it never equals a tile of the rest
    place = F.expr("int(pmod(xxhash64(rep), across))")
    sides = left.filter("component = base").select("cluster", (-1 - place).alias("ti"), F.explode(F.expr("sequence(0, rest - 1)")).alias("tj"), F.lit(0).cast("tinyint").alias("side"), "rep", "n", "payload", "component")
    others = rest.select("cluster", F.explode(F.expr("sequence(-across, -1)")).alias("ti"), F.expr("int(pmod(xxhash64(rep), rest))").alias("tj"), F.lit(1).cast("tinyint").alias("side"), "rep", "n", "payload", "component")
    return links.union(forests(among.unionByName(sides).unionByName(others), "cluster", num, den, exact=True))


def full_rows(docs: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(cluster, tiles, rep, n, payload): the full rows of the clusters' documents.

    The list of documents is broadcast if it was counted to be short; otherwise the join is shuffled.
    """
    wanted = docs.join(fit_to_send(clusters), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(without_repeats(batches)):
            sets = [grams for grams, _ in shingle_sets([t or "" for t in part.column("text").to_pylist()], k)]
            yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("tiles"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "tiles", "rep", "n", "payload"])

    return arrow_map(wanted, run, "cluster long, tiles int, rep long, n long, payload binary").filter("n > 0")


def components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Similarity classes: (doc_id, n_shingles long, component_id long), a row for each input row.

    Two documents link when den * |intersection| >= num * |union| of their
    sets of distinct k-word shingles; component_id is the least id reached by
    links.  With fewer than k words the whole sequence is one shingle; null,
    empty and blank texts have no shingle and link with nothing.  Rows with
    equal ids count as one document; rows with a null id link with nothing and
    have a null component.  Other columns are ignored; an empty table gives an
    empty result.
    """
    docs = keyed_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    last: list[int] = []
    for turn in range(REORDERINGS + 1):
        with passing(df.sparkSession) as files:
            every = settle(profile(docs, k, num, den, last))
            classes = every.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "grams", "sketch")).alias("r"))
            classes = settle(classes.select("n", "f1", "f2", F.col("r.doc_id").alias("rep"), "r.grams", "r.sketch"))
            single = classes.select(F.explode("grams").alias("gram"), "rep", "n")
            shared = settle(single.groupBy("gram").agg(F.count("*").alias("cnt")).filter("cnt > 1"))
            total = shared.agg(F.sum("cnt").alias("total")).first()["total"] or 0
            most = max(HEAVY_BLOCKS * BLOCK, total // HEAVY_SHARE)  # no more than HEAVY_SHARE columns are above it
            late = max(min(most, classes.count() // HEAVY_ROWS), total // HEAVY_SHARE, 2)
            heavy = [r["gram"] for r in shared.filter(F.col("cnt") > late).select("gram").collect()] if turn < REORDERINGS else []
            if not heavy:
                retain(files)
                break
            last += heavy
    entries = settle(single.join(shared, "gram").select("gram", F.col("cnt"), F.expr(f"int(ceil(cnt / {BLOCK}))").alias("tiles"), "rep", "n"))
    with_sketch = entries.filter(F.col("cnt") <= most).join(classes.select("rep", "n", F.col("sketch").alias("payload")), ["rep", "n"]).withColumn("component", F.col("rep"))
    candidates = forests(tiled(with_sketch, "gram"), "gram", num, den, exact=False)
    if not shared.filter(F.col("cnt") > most).isEmpty():
        candidates = candidates.union(like_sizes(entries.filter(F.col("cnt") > most), num, den))

    clusters = settle(connected(candidates))
    sized = clusters.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    tiles = sized.groupBy("component").agg(F.expr(f"int(greatest(ceil(count(*) / {BLOCK}), ceil(8 * sum(n) / {BLOCK_BYTES})))").alias("tiles"))
    dealt = settle(clusters.join(tiles, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "tiles"))
    small = full_rows(docs, dealt.filter("tiles <= 1"), k).withColumn("component", F.col("rep"))
    links = forests(tiled(small, "cluster"), "cluster", num, den, exact=True)
    if not (large := dealt.filter("tiles > 1")).isEmpty():
        links = links.union(large_links(settle(full_rows(docs, large, k)), num, den))
    found = settle(connected(links))

    joined = classes.select("n", "f1", "f2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", "n", "f1", "f2").join(joined, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
