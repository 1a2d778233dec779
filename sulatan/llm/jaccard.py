"""Similarity join on word n-grams with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sulatan.llm.graph import components
from sulatan.llm.store import bounded, docs_of, save, texts_in
from sulatan.llm.words import mix, runs, words

#: longest multi-match: a prefix may ask for this many shared n-grams
MOST_MATCHES = 6
#: one text in so many is looked at to estimate how common an n-gram is; n-grams remembered
SAMPLE_EVERY, COMMON_GRAMS = 8, 1 << 19
#: an n-gram's list over this length is first contracted by verifying one member against the rest, in so many rounds at most
LONG_LIST, HUB_ROUNDS = 64, 2
#: n-grams of the sets that are compared with those of another block at a time; a set counts as so many at least
BLOCK_GRAMS, LEAST_GRAMS = 1 << 18, 64


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, distinct sorted n-grams and their offsets, a few rows at a time."""
    for w in words(column):
        grams, at = runs(w, size)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[first], row[first]
        yield w.lo, grams, np.searchsorted(row, np.arange(len(at)))


def _class_of(grams: np.ndarray) -> int:
    """Name of a set: equal sets have equal names."""
    h = np.array([len(grams), grams.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(grams + np.uint64(77)))], np.uint64)
    return int(mix(mix(mix(h[:1]) + h[1:2]) + h[2:3]).view(np.int64)[0])


def _prefix(freq: np.ndarray, percent: int) -> tuple[int, int]:
    """Length of a set's prefix and the matches it asks for, by estimated cost.

    ``freq``: estimated texts per n-gram, least first. With ``need`` shared
    n-grams required, the first ``n - need + k`` of both sets share ``k``.
    A longer prefix costs its rows; fewer candidates repay it.
    """
    n = len(freq)
    need = -(-percent * n // 100)
    most = min(MOST_MATCHES, need)
    if freq[min(n, n - need + most) - 1] == 0:
        return n - need + 1, 1
    length = n - need + np.arange(1, most + 1)
    cost = length + 8.0 * np.cumsum(freq)[length - 1] / np.arange(1, most + 1)
    k = int(np.argmin(cost)) + 1
    return n - need + k, k


def _postings(common: np.ndarray, freq: np.ndarray, size: int, percent: int):
    """One row without ``gram`` for each text, and a row for each n-gram of its prefix.

    ``meta`` packs the set's size, the matches it asks for and the n-gram's
    level: the least number of asked matches whose prefix holds it.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("gram", pa.int64()), ("set_id", pa.int64()), ("meta", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, grams, at in _sets(batch.column(1), size):
                est = np.zeros(len(grams))
                if len(common) and len(grams):
                    spot = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    hit = common[spot] == grams
                    est[hit] = freq[spot[hit]]
                doc, tokens = [], []
                for r in range(len(at) - 1):
                    n = int(at[r + 1] - at[r])
                    name = _class_of(grams[at[r] : at[r + 1]]) if n else None
                    doc.append((name, n))
                    if not n:
                        continue
                    own = est[at[r] : at[r + 1]]
                    order = np.argsort(own, kind="stable")
                    length, asks = _prefix(own[order], percent)
                    level = np.maximum(1, np.arange(length) - (length - asks) + 1)
                    tokens.append((grams[at[r] : at[r + 1]][order[:length]].view(np.int64), name, (n << 16 | asks << 8) + level))
                rows = len(doc)
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, rows).cast(pa.int64()), none, pa.array([d[0] for d in doc], pa.int64()), pa.array([d[1] << 16 for d in doc], pa.int64())], schema=fields)
                if tokens:
                    lens = [len(t[0]) for t in tokens]
                    yield pa.RecordBatch.from_arrays([pa.nulls(sum(lens), pa.int64()), pa.array(np.concatenate([t[0] for t in tokens])), pa.array(np.repeat(np.array([t[1] for t in tokens]), lens)), pa.array(np.concatenate([t[2] for t in tokens]))], schema=fields)

    return run


def _gram_rows(size: int):
    def run(batches):
        for batch in batches:
            for _, grams, _ in _sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return run


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated texts per common n-gram, from every eighth text, the commonest ones.

    Only the order of n-grams and the prefix lengths depend on it. Any order
    and any length give the same links.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_EVERY)) == 0)
    counts = save(sample.mapInArrow(_gram_rows(size), "gram long").groupBy("gram").count().where("count > 1"), "common")
    # the least count that leaves no more than can be remembered
    least, room = 2, COMMON_GRAMS
    for n, grams in sorted(((r["n"], r["grams"]) for r in counts.groupBy(F.least("count", F.lit(100_000)).alias("n")).agg(F.count("*").alias("grams")).collect()), reverse=True):
        room -= grams
        if room < 0:
            least = n + 1
            break
    top = bounded(counts.where(F.col("count") >= least), COMMON_GRAMS)
    grams = top["gram"].astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top["count"].astype(float)[order] * SAMPLE_EVERY


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            for lo, grams, at in _sets(batch.column(1), size):
                names = [_class_of(grams[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(0).slice(lo, len(names)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))], ["set_id", "doc_id", "grams"])

    return run


def _sets_of(docs: DataFrame, one: DataFrame, nodes: DataFrame, size: int, name: str) -> DataFrame:
    """``(set_id, grams)`` of ``nodes(set_id)``, taken again from their texts."""
    wanted = save(nodes.join(one, "set_id"), f"{name}_wanted")
    found = texts_in(docs, wanted.select("doc_id"), _set_rows(size), "set_id long, doc_id long, grams array<long>")
    # an id may stand on several texts, and a text on several rows
    return save(found.join(wanted, ["set_id", "doc_id"]).select("set_id", "grams").dropDuplicates(["set_id"]), f"{name}_sets")


def _verified(docs: DataFrame, one: DataFrame, pairs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Pairs ``(a, b)`` that reach the similarity, by their whole sets.

    ``one``: a text's id for each set. Sets are taken again from the texts of
    the candidates only; both sides of a join can be split if a set is hot.
    """
    sets = _sets_of(docs, one, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), size, name)
    left = pairs.select("a", "b").join(sets.select(F.col("set_id").alias("b"), F.col("grams").alias("gb")), "b")
    both = left.join(sets.select(F.col("set_id").alias("a"), F.col("grams").alias("ga")), "a")
    both = both.select("a", "b", (F.size("ga") + F.size("gb")).alias("sum"), F.size(F.array_intersect("ga", "gb")).alias("shared"))
    return save(both.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("sum") - F.col("shared"))).select("a", "b"), name)


def _linked(sizes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int) -> np.ndarray:
    """For each set the sets of the other block that it links with (of its own, if there is one block)."""
    n = len(sets)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    links, mark = np.zeros(n, np.int64), np.zeros(ids.max() + 1, np.int32)
    # sets stand by block and size: the partners of a set are a stretch
    last = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else n
    for i in range(last):
        lo = last if last < n else i + 1
        a = lo + int(np.searchsorted(sizes[lo:] * 100, sizes[i] * percent))
        b = lo + int(np.searchsorted(sizes[lo:] * percent, sizes[i] * 100, "right"))
        if a >= b:
            continue
        own = ids[at[i] : at[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[at[a] : at[b]]], at[a:b] - at[a])
        mark[own] = 0
        hit = 100 * shared >= percent * (sizes[i] + sizes[a:b] - shared)
        links[i] += hit.sum()
        links[a:b] += hit
    return links


def _link_counts(docs: DataFrame, one: DataFrame, part: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """``(set_id, n_links)``: all links of each set of ``part(node, component)``.

    Links lie inside components, where every two sets are compared that their
    sizes allow to link. A component is cut, by size, into blocks of so many
    n-grams, and each pair of blocks is a group of its own: a task holds two
    blocks, however large the component is.
    """
    before = Window.partitionBy("component").orderBy("n", "set_id").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum(F.greatest("n", F.lit(LEAST_GRAMS))).over(before), F.lit(0)) / BLOCK_GRAMS).cast("int")
    members = part.select(F.col("node").alias("set_id"), "component").join(sizes, "set_id").withColumn("block", block)
    members = save(members, "members")
    blocks = members.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.high") * 100 >= F.col("y.low") * percent)
    pairs = save(x.join(y, meet).select("x.component", F.col("x.block").alias("b0"), F.col("y.block").alias("b1")), "block_pairs")
    placed = pairs.select("component", "b0", "b1", F.explode(F.array_distinct(F.array("b0", "b1"))).alias("block")).join(members, ["component", "block"])
    rows = placed.join(_sets_of(docs, one, members.select("set_id"), size, "members"), "set_id").select("component", "b0", "b1", "block", "n", "set_id", "grams")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("n", "ascending")]).combine_chunks()
        grams = group["grams"].combine_chunks()
        sets = np.split(grams.flatten().to_numpy(), np.cumsum(grams.value_lengths().to_numpy())[:-1])
        found = _linked(group["n"].to_numpy().astype(np.int64), sets, group["block"].to_numpy(), percent)
        return pa.table({"set_id": group["set_id"], "n_links": pa.array(found)})

    found = rows.groupBy("component", "b0", "b1").applyInArrow(run, "set_id long, n_links long")
    return save(found.groupBy("set_id").agg(F.sum("n_links").alias("n_links")), "link_counts")


def _open(lists: DataFrame, part: DataFrame) -> DataFrame:
    """Lists that span components, with each member's component, the list's largest as ``main``, its members there, and all its ``members``."""
    placed = lists.join(part.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    per = placed.groupBy("gram", "component").count().groupBy("gram").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("parts"), F.sum("count").alias("members")).where("parts > 1")
    return placed.join(per.select("gram", F.col("m.component").alias("main"), F.col("m.count").alias("most"), "members"), "gram")


def _least(n: Column, asks: Column, o_n: Column, o_asks: Column, percent: int) -> Column:
    """Prefix n-grams that two sets must share.

    Beyond a prefix of length n - need + asks, at most need - asks n-grams of
    the set can still match, of whichever set's prefix ends first.
    """
    beyond = lambda n, asks: F.ceil(n * percent / 100) - asks
    return F.ceil((n + o_n) * percent / (100 + percent)) - F.greatest(beyond(n, asks), beyond(o_n, o_asks))


def _likely(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` with enough of ``rows(set_id, n, asks, o_id, o_n, o_asks)``, one per shared n-gram."""
    least = _least(F.col("n"), F.col("asks"), F.col("o_n"), F.col("o_asks"), percent)
    return rows.groupBy(F.least("set_id", "o_id").alias("a"), F.greatest("set_id", "o_id").alias("b"), least.alias("least")).count().where("count >= least").select("a", "b")


def _ranked(lists: DataFrame) -> DataFrame:
    """Rows of ``lists`` with the number ``k`` of their set's n-grams and the n-gram's ``place`` there, shortest lists first.

    A set's rows are n-grams of one text. All sets follow the same order.
    """
    own = Window.partitionBy("set_id")
    return lists.withColumns({"k": F.count("*").over(own), "place": F.row_number().over(own.orderBy("members", "gram"))})


def _enough(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that share enough of the n-grams of ``lists``."""
    sets = save(lists.groupBy("set_id").agg(F.first("n").alias("n"), F.first("asks").alias("asks"), F.collect_list("gram").alias("grams")), "open_sets")
    side = lambda name: sets.select(F.col("set_id").alias(name), F.struct("n", "asks", "grams").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least = _least(F.col("of_a.n"), F.col("of_a.asks"), F.col("of_b.n"), F.col("of_b.asks"), percent)
    return both.where(F.size(F.array_intersect("of_a.grams", "of_b.grams")) >= least).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` of every row.

    Words are lower-cased in A-Z and split at ASCII white space; a text's set
    is its distinct ``size``-word shingles, or all its words as one shingle if
    it has fewer. Two texts link when ``100 * intersection >= percent * union``;
    a component is named by its least ``doc_id``.

    1. Equal sets form a class. Each set's prefix, rarest n-grams first, gets
       the length and the number of required matches that cost least
       (`_prefix`).
    2. In long lists, members are first verified against one hub only, the
       member with most n-grams in long lists (of a group of edited copies,
       the one with fewest edits); components of the found links are
       contracted. A few such rounds; they only save work.
    3. Lists that span components give their pairs between a component other
       than the list's largest and the rest. Beyond the shorter-reaching
       prefix at most its remaining n-grams can match, so a pair needs so
       many shared prefix n-grams; it meets on the first few of each set
       only (a prefix filter among the n-grams of these lists), and is then
       counted over all of them. Pairs with enough are verified. No possible
       link between components is skipped.
    4. The links inside each component, which steps 2 and 3 pass over where
       others already connect it, are all found by comparing blocks of its sets.

    Null or empty texts have size 0 and link with nothing; a null id gives a
    row of its own with a null component. Repeated ids or rows are separate
    rows of one component if their sets link. ``n_links`` counts all links of
    the row's class to other classes. Extra columns are ignored. An empty
    table gives no rows.
    """
    docs = docs_of(docs, id_col, text_col)
    spark = docs.sparkSession
    grams, freq = _common(docs, size)
    known = spark.sparkContext.broadcast((grams, freq))

    def postings(batches):
        yield from _postings(*known.value, size, percent)(batches)

    rows = save(docs.mapInArrow(postings, "doc_id long, gram long, set_id long, meta long"), "postings")
    texts = rows.where("gram is null").select("doc_id", "set_id", F.shiftright("meta", 16).alias("n_shingles"))
    one = texts.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    lists = rows.where("gram is not null").select("gram", "set_id", "meta")

    # lists with at least two different sets, each set once
    several = lists.groupBy("gram").agg(F.min("set_id").alias("one"), F.max("set_id").alias("other")).where("one <> other").select("gram")
    lists = lists.join(several, "gram").groupBy("gram", "set_id").agg(F.min("meta").alias("meta"))
    lists = save(lists.select("gram", "set_id", F.shiftright("meta", 16).alias("n"), (F.shiftright("meta", 8) % 256).alias("asks")), "lists")
    links = spark.createDataFrame([], "a long, b long")
    part = spark.createDataFrame([], "node long, component long")

    # long lists: members against a hub
    long = lists.join(lists.groupBy("gram").count().where(F.col("count") > LONG_LIST).select("gram"), "gram")
    long = save(long.join(long.groupBy("set_id").agg(F.count("*").alias("common")), "set_id"), "long_lists")
    for k in range(HUB_ROUNDS):
        placed = _open(long, part)
        hubs = placed.groupBy("gram").agg(F.max_by(F.struct("set_id", "n", "asks", "component"), F.struct(((F.col("component") == F.col("main")) | (F.col("most") == 1)).alias("inside"), F.col("common") / F.col("n"), F.xxhash64("set_id", F.lit(k)))).alias("hub"))
        x = placed.join(hubs, "gram").where("component <> hub.component")
        near = save(_likely(x.select("set_id", "n", "asks", F.col("hub.set_id").alias("o_id"), F.col("hub.n").alias("o_n"), F.col("hub.asks").alias("o_asks")), percent), f"near_{k}")
        found = _verified(docs, one, near.join(links, ["a", "b"], "left_anti"), size, percent, f"hub_links_{k}")
        if found.isEmpty():
            break
        links = save(links.union(found), f"links_{k}")
        part = save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), f"parts_{k}")

    # lists that still span components: members outside the largest against all
    open_lists = save(_ranked(_open(lists, part)), "open_lists")
    x, y = open_lists.where("component <> main").alias("x"), open_lists.alias("y")
    fits = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    # of the k open n-grams of a set at least ``least`` are shared, so the first shared one is among its first k - least + 1
    least = _least(F.col("x.n"), F.col("x.asks"), F.col("y.n"), F.col("y.asks"), percent)
    early = (F.col("x.place") <= F.col("x.k") - least + 1) & (F.col("y.place") <= F.col("y.k") - least + 1)
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.set_id") < F.col("y.set_id"))
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & once & fits & early)
    met = save(met.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct(), "met")
    rest = _enough(met, open_lists, percent)
    more = _verified(docs, one, save(rest, "candidates"), size, percent, "more_links")
    links = links.union(more)
    part = save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")

    sizes = texts.where("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n"))
    degree = _link_counts(docs, one, part, sizes, size, percent)
    classes = texts.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least_id"))
    classes = classes.join(part.withColumnRenamed("node", "set_id"), "set_id", "left").join(degree, "set_id", "left")
    classes = classes.select("set_id", "least_id", F.coalesce("component", "set_id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(names, "component").select("set_id", "component_id", "n_links")
    out = texts.join(classes, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
