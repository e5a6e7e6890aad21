"""Near-duplicate texts and texts that contradict each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import components
from cairn.session import written

#: Characters of the statements that are compared in one place.
BLOCK = 8_000_000
#: One in so many rows that have a word make its list a row of bytes.
DENSE = 128
#: Bytes that such rows take at most; what is more stays a list.
DENSE_BYTES = 64_000_000


def word_array(text: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    """Distinct hashes of ``n`` words in a row; a shorter text is one shingle."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs with Jaccard similarity of at least ``threshold``, a < b.

    ``sets`` has id and items (distinct hashes).  Prefix filter: two sets that are so alike
    share one of their n - ceil(t n) + 1 rarest items, so only those are joined; sizes have
    to fit; candidates are then counted exactly.  Items that many sets hold are the last to
    be joined on, so boilerplate makes no candidates unless a text is nothing else.
    """
    n = F.size("items")
    sized = sets.where(n > 0).select("id", "items", n.alias("n"))
    each = sized.select("id", "n", F.explode("items").alias("item"))
    df = each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    # Items of one set only can't make a pair but take their places in the prefix.
    common = each.join(df, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("c"))
    left = (keep - (F.col("n") - F.size("c"))).cast("int")
    prefix = common.where(left > 0).select("id", "n", F.explode(F.slice("c", 1, left)).alias("p")).select("id", "n", F.col("p.item").alias("item"))
    prefix, _ = written(prefix, "prefix")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "item"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "item")
    fits = (F.col("na") >= F.ceil(F.lit(threshold) * F.col("nb"))) & (F.col("nb") >= F.ceil(F.lit(threshold) * F.col("na")))
    cand = a.join(b, "item").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    both = cand.join(sized.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").join(sized.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    sim = shared / (F.size("ia") + F.size("ib") - shared)
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row per document: id, class_id and n_links, the texts other than its own that are alike.

    Copies of a text (the same words) are one class and stand in the join as its smallest
    id; links are between different texts.  ``class_id`` is the smallest id of the
    connected texts.

    Defined results: null ids are dropped; null, empty and wordless texts are a class each;
    an id that repeats counts with its greatest text; other columns are not read.
    """
    src = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).where("id is not null").groupBy("id").agg(F.max("t").alias("t"))
    words = src.select("id", word_array(F.coalesce("t", F.lit(""))).alias("w"))
    body = words.select("id", F.when(F.size("w") > 0, F.sha2(F.array_join("w", " "), 256)).otherwise(F.concat(F.lit("id:"), F.col("id"))).alias("h"), shingles(F.col("w"), width).alias("items"))
    body, _ = written(body, "shingles")
    reps = body.groupBy("h").agg(F.min("id").alias("rep"))
    sets = body.join(reps, "h").where("id = rep").select("id", "items")
    pairs, _ = written(similar_pairs(sets, threshold), "pairs")
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    joined = components(pairs).select(F.col("id").alias("rep"), "component")
    member = body.select("id", "h").join(reps, "h").join(links, "rep", "left").join(joined, "rep", "left")
    return member.select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def contradictions(facts: DataFrame, threshold: float, words: Callable[[], Callable[[str], set[int]]] | None = None, sizes: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(scope, denies, states, overlap): statements of a scope with opposite polarity whose words overlap.

    ``facts`` has scope, s, neg and w (distinct words); it needs no w where a call of
    ``words`` gives what numbers the words of a statement.  ``sizes`` has scope and n, the characters of its statements or
    more of them, and is counted where it isn't given.

    Statements are shuffled once and pairs never: small scopes go into buckets of about
    ``block`` characters; a scope above that is a grid, in which a statement that denies goes
    into all blocks of its row and one that states into all of its column, so each pair meets
    in one place.  There those that state are listed by word, and for each that denies the
    shared words are counted over the lists of its own words.

    Defined results: null scopes and polarities are dropped; a statement that repeats counts
    once; one without words overlaps with none.
    """
    facts = facts.select("scope", "s", "neg", *([] if words else ["w"])).where("scope is not null")
    if sizes is None:
        sizes = facts.groupBy("scope").agg(F.sum(F.coalesce(F.length("s"), F.lit(0)) + (F.lit(0) if words else 8 * F.size("w"))).alias("n"))
    sizes, _ = written(sizes, "scope-sizes")
    buckets = max(1, -(-int(sizes.agg(F.sum("n")).first()[0] or 0) // block))
    # At most as many as the input has blocks.
    large = sizes.where(F.col("n") > block).select("scope", F.ceil(F.col("n") / (8 * block)).cast("int").alias("rows"), F.ceil(F.col("n") / block).cast("int").alias("cols"))
    row, col = F.pmod(F.xxhash64("s"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("s"), F.col("cols")).cast("int")
    spot = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    spots = (
        F.when(F.col("cols").isNull(), F.array(spot(F.lit(0), F.lit(0))))
        .when(F.col("neg"), F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: spot(row, j)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: spot(i, col)))
    )
    key = F.when(F.col("cols").isNull(), F.pmod(F.xxhash64("scope"), F.lit(buckets))).otherwise(F.xxhash64("scope"))
    placed = facts.join(F.broadcast(large), "scope", "left").withColumn("k", key).withColumn("at", F.explode(spots)).drop("rows", "cols")
    met = placed.select(*facts.columns, "k", "at.i", "at.j").repartition("k", "i", "j").dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        if t.num_rows == 0:
            return
        scope, s, neg = (t.column(c).combine_chunks() for c in ("scope", "s", "neg"))
        if words is None:
            w = t.column("w").combine_chunks()
            n, flat = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False), pc.fill_null(w.flatten(), "\0").dictionary_encode().indices.to_numpy()
        else:
            of, sizes, every = words(), [], []
            for x in s.to_pylist():
                got = of(x) if x is not None else ()
                sizes.append(len(got))
                every += got
            n, flat = np.array(sizes, np.int64), np.array(every, np.int64)
            del sizes, every
        for a, b, overlap in opposed(scope, neg, n.astype(np.int64), flat.astype(np.int64), threshold):
            yield pa.RecordBatch.from_arrays([scope.take(a), s.take(a), s.take(b), pa.array(overlap, pa.float64())], names=["scope", "denies", "states", "exact"])

    pairs = met.groupBy("k", "i", "j").applyInArrow(run, "scope string, denies string, states string, exact double")
    return pairs.select("scope", "denies", "states", F.round("exact", 6).alias("overlap"))


def opposed(scope: pa.Array, neg: pa.Array, n: np.ndarray, words: np.ndarray, threshold: float, rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows that deny, rows that state, overlap) of the pairs of one scope that overlap by ``threshold``, about ``rows`` pairs at a time.

    Each row has the next ``n`` of ``words``, which are numbers.  Lists of words that many rows have are rows of bytes instead.
    """
    denies, states = (pc.fill_null(pc.equal(neg, x), False).to_numpy(zero_copy_only=False) for x in (True, False))
    word = np.repeat(scope.dictionary_encode().indices.to_numpy().astype(np.int64), n) * (words.max(initial=0) + 1) + words
    by = np.repeat(denies, n)
    known, mine = np.unique(word[by], return_inverse=True)
    if not len(known):
        return
    other = np.repeat(states, n)
    word, line = word[other], np.repeat(np.cumsum(states) - 1, n)[other]
    place = np.minimum(np.searchsorted(known, word), len(known) - 1)
    hit = known[place] == word
    place, line = place[hit], line[hit]
    line = line[np.argsort(place, kind="stable")]
    a_rows, b_rows, nb = np.flatnonzero(denies), np.flatnonzero(states), n[states]
    lists = np.split(line, np.cumsum(np.bincount(place, minlength=len(known)))[:-1])
    most = -(-len(b_rows) // 8) * 8
    dense: dict[int, np.ndarray] = {}
    for k in sorted(range(len(lists)), key=lambda k: -len(lists[k]))[: DENSE_BYTES // max(1, most)]:
        if len(lists[k]) * DENSE <= len(b_rows):
            break
        dense[k] = np.zeros(most, np.uint8)
        dense[k][lists[k]] = 1
    kind = np.uint8 if n[denies].max() < 256 else np.int64
    shared = np.zeros(most, kind)
    least: dict[int, np.ndarray] = {}  # by words of the one that denies: shared words without which the other isn't alike
    mine, at, held = mine.tolist(), 0, 0
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for a, na in enumerate(n[denies].tolist()):
        if na not in least:
            least[na] = np.full(most, np.iinfo(kind).max, kind)
            least[na][: len(nb)] = np.clip(np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-6), 1, np.iinfo(kind).max)
        shared.fill(0)
        for k in mine[at : at + na]:
            if k in dense:
                shared += dense[k]
            else:
                shared[lists[k]] += 1
        at += na
        enough = shared >= least[na]
        eight = np.flatnonzero(enough.view(np.uint64))  # most rows have none: eight at a time
        if len(eight):
            near = (eight[:, None] * 8 + np.arange(8)).ravel()
            near = near[enough[near]]
            near = near[near < len(nb)]
            out.append((a, near, shared[near]))
            held += len(near)
            if held >= rows:
                yield from _alike(out, a_rows, b_rows, n, threshold, rows)
                out, held = [], 0
    yield from _alike(out, a_rows, b_rows, n, threshold, rows)


def _alike(found: list[tuple[int, np.ndarray, np.ndarray]], a_rows: np.ndarray, b_rows: np.ndarray, n: np.ndarray, threshold: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Those of the pairs found that overlap by ``threshold``."""
    if not found:
        return
    a = np.repeat(a_rows[[x[0] for x in found]], [len(x[1]) for x in found])
    b, both = b_rows[np.concatenate([x[1] for x in found])], np.concatenate([x[2] for x in found]).astype(np.int64)
    overlap = both / (n[a] + n[b] - both)
    keep = overlap >= threshold
    a, b, overlap = a[keep], b[keep], overlap[keep]
    for k in range(0, len(a), rows):
        yield a[k : k + rows], b[k : k + rows], overlap[k : k + rows]


def overlapping(sets: DataFrame, threshold: float) -> DataFrame:
    """(scope, a, b, overlap) of sets within one scope with Jaccard overlap of at least ``threshold``, a < b.

    ``sets`` has scope, id (over all scopes one row) and w (distinct words).  Prefix filter by
    words rare in their scope, as in :func:`similar_pairs`.
    """
    n = F.size("w")
    base, _ = written(sets.where(n > 0).select("scope", "id", "w", n.alias("n")), "scoped")
    each = base.select("scope", "id", "n", F.explode("w").alias("x"))
    df = each.groupBy("scope", "x").agg(F.count("*").alias("df"))
    take = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "x"))
    pre = each.join(df, ["scope", "x"]).withColumn("k", rank).where((F.col("k") <= take) & (F.col("df") > 1)).select("scope", "x", "id", "n")
    a, b = pre.select("scope", "x", F.col("id").alias("a"), F.col("n").alias("na")), pre.select("scope", "x", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") >= F.ceil(F.lit(threshold) * F.col("nb"))) & (F.col("nb") >= F.ceil(F.lit(threshold) * F.col("na")))
    cand = a.join(b, ["scope", "x"]).where((F.col("a") < F.col("b")) & fits).select("scope", "a", "b").distinct()
    both = cand.join(base.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(base.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.select("scope", "a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("overlap")).where(F.col("overlap") >= threshold)


def repeated(briefs: DataFrame, threshold: float) -> DataFrame:
    """(line_id, first_line, overlap): rows whose words overlap those of an earlier row of their session, with the first such row.

    ``briefs`` has session_id, o (order, unique), line_id and w (sorted distinct words).  Rows of the
    same words are one set, of which only the first row can be the first match, so a brief that
    is repeated any number of times is compared once.

    Defined results: rows with a null session, order or word list, and rows without words, are like
    none; other columns are not read; an empty input gives an empty result.
    """
    briefs = briefs.select("session_id", "o", "line_id", "w").where("session_id is not null and o is not null and w is not null")
    same = F.xxhash64("session_id", F.array_join("w", " "))
    base, _ = written(briefs.withColumn("id", same), "briefs")
    sets = base.groupBy("id").agg(F.max("session_id").alias("scope"), F.max("w").alias("w"), F.min(F.struct("o", "line_id")).alias("first"))
    pairs = overlapping(sets.select("scope", "id", "w"), threshold).select("a", "b", "overlap")
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap")).unionByName(sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("overlap")))
    near = links.join(sets.select(F.col("id").alias("b"), "first"), "b").groupBy("a").agg(F.min(F.struct("first", "overlap")).alias("m"))
    out = base.join(near.withColumnRenamed("a", "id"), "id").where(F.col("m.first.o") < F.col("o"))
    return out.select("line_id", F.col("m.first.line_id").alias("first_line"), F.col("m.overlap").alias("overlap"))
