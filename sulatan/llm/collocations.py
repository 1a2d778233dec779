"""Phrase collocations, counted in quotient filters of packed word ids.

A word's id is a hash of its language and bytes, as wide as the counted
vocabulary needs; that no frequent word shares its id with another word is
checked over the whole vocabulary (else another seed is taken). Tasks count
packed ids in filters, one per part of the permuted key space, and the filters
of each part are merged.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sulatan.llm import quotient
from sulatan.llm.store import bounded, save
from sulatan.llm.words import mix, span_hashes, text_bytes

BREAKS = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
WORD = ~BREAKS & ~np.isin(np.arange(256), [32, 9])
_UPPER = bytes(range(65, 91))
#: A-Z in lower case, every separator a space
_TABLE = bytes(32 if not WORD[b] else _UPPER.lower()[b - 65] if 65 <= b <= 90 else b for b in range(256))
_LANG = "und"
PIECE = 1 << 20
#: words or n-grams that a task holds before it hands them on
HELD = 1 << 20
#: entries of all tasks that a merged part holds at most, on average
PART_ENTRIES = 1 << 21
WORD_BITS, PHRASE_BITS = 24, 25


# --- vocabulary ----------------------------------------------------------------

def _word_counts(batches):
    """``(lang, word, f)`` of the words a task has met since it last handed them on."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out():
        for lang, found in held.items():
            words = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "f"])
        held.clear()

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            raw, begin = text.encode().translate(_TABLE), 0
            while begin < len(raw):
                end = len(raw)
                if end - begin > PIECE:
                    cut = raw.rfind(b" ", begin, begin + PIECE)
                    cut = cut if cut > begin else raw.find(b" ", begin + PIECE)
                    end = cut if cut > 0 else end
                held[lang].update(raw[begin:end].split())
                begin = end
        if sum(map(len, held.values())) > HELD:
            yield from out()
    yield from out()


def _values(seed: int) -> np.ndarray:
    """A random number per byte; A-Z as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    return values


def _text_hashes(column: pa.Array, values: np.ndarray) -> np.ndarray:
    data, at = text_bytes(column)
    return span_hashes(values[data[at[0] : at[-1]]], at[:-1] - at[0], at[1:] - at[0])


def _ids(words: np.ndarray, langs: np.ndarray, width: int) -> np.ndarray:
    return mix(words ^ mix(langs + np.uint64(1))) >> np.uint64(64 - width)


def _with_ids(vocabulary: DataFrame, seed: int, width: int) -> DataFrame:
    def run(batches):
        values = _values(seed)
        for batch in batches:
            ids = _ids(_text_hashes(batch.column(1), values), _text_hashes(batch.column(0), values), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids.view(np.int64))], ["lang", "word", "f", "id"])

    return vocabulary.select("lang", "word", "f").mapInArrow(run, "lang string, word string, f long, id long")


def _frequent(vocabulary: DataFrame, least: int) -> tuple[DataFrame, int, int]:
    """Words met ``least`` times, with ids no other word has; the seed and width of the ids."""
    n, often = vocabulary.agg(F.count("*"), F.count(F.when(F.col("f") >= least, 1))).first()
    width = min(64, max(32, int(n).bit_length() + int(often).bit_length() + 7))
    for seed in range(16):
        named = _with_ids(vocabulary, seed, width)
        shared = named.groupBy("id").agg(F.count("*").alias("n"), F.max("f").alias("f")).where(F.col("n") > 1).where(F.col("f") >= least)
        if shared.isEmpty():
            return save(named.where(F.col("f") >= least), "frequent"), seed, width
    raise ValueError("no seed gives every frequent word an id of its own")


# --- counting --------------------------------------------------------------------

def _stream(batch: pa.RecordBatch, values: np.ndarray, width: int):
    """``(ids, fresh)`` of a batch's words, some at a time; ``fresh`` words begin a piece."""
    data, at = text_bytes(batch.column(1))
    langs = _text_hashes(batch.column(0), values)
    begin, last = int(at[0]), int(at[-1])
    pending = True
    while begin < last:
        end = min(last, begin + PIECE)
        if end < last:
            gaps = np.flatnonzero(~WORD[data[begin:end]])
            rows = at[np.searchsorted(at, begin, "right") : np.searchsorted(at, end, "right")]
            cut = max(begin + int(gaps[-1]) + 1 if len(gaps) else begin, int(rows[-1]) if len(rows) else begin)
            while cut == begin and end < last:  # one word fills the stretch
                wider = min(last, end + PIECE)
                gaps = np.flatnonzero(~WORD[data[end:wider]])
                rows = at[np.searchsorted(at, end, "right") : np.searchsorted(at, wider, "right")]
                stops = [end + int(x) + 1 for x in gaps[:1]] + [int(x) for x in rows[:1]]
                cut, end = (min(stops), wider) if stops else (begin, wider)
            end = cut if cut > begin else end
        part = data[begin:end]
        word = WORD[part]
        first, stop = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        rows = np.unique(at[(at >= begin) & (at < end)]) - begin
        first[rows] = word[rows]
        stop[rows[rows > 0] - 1] = word[rows[rows > 0] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(stop) + 1
        breaks = BREAKS[part].astype(np.int64)
        breaks[rows] += 1
        breaks = np.cumsum(breaks)
        if not len(starts):
            pending = pending or bool(breaks[-1])
        else:
            seen = breaks[starts]
            fresh = np.append(pending or seen[0] > 0, seen[1:] != seen[:-1])
            row = np.searchsorted(at, starts + begin, "right") - 1
            yield _ids(span_hashes(values[part], starts, ends), langs[row], width), fresh
            pending = bool(breaks[-1] != seen[-1])
        begin = end


def _marked(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filters(texts: DataFrame, n: int, width: int, seed: int, table: np.ndarray, part_bits: int) -> DataFrame:
    """``(part, filter)`` of all runs of ``n`` words whose shorter runs may be frequent.

    ``table`` marks the slots of all frequent runs of ``n - 1`` words; its size
    is fixed, and it lets every frequent one pass.
    """
    held_table = texts.sparkSession.sparkContext.broadcast(table)
    bits = n * width

    def run(batches):
        marks, values = held_table.value, _values(seed)
        keys: list[list[np.ndarray]] = []
        n_keys = 0
        tail = np.zeros(0, np.uint64), np.zeros(0, bool)

        def out():
            limbs, counts = quotient.counted([np.concatenate([k[i] for k in keys]) for i in range(len(keys[0]))], np.ones(n_keys, np.int64))
            edges = quotient.parts_of(limbs, part_bits)
            full = np.flatnonzero(np.diff(edges))
            packed = [quotient.dump([x[edges[p] : edges[p + 1]] for x in limbs], counts[edges[p] : edges[p + 1]], part_bits, bits) for p in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["part", "filter"])

        for batch in batches:
            for ids, fresh in _stream(batch, values, width):
                ids, fresh = np.concatenate([tail[0], ids]), np.concatenate([tail[1], fresh])
                tail = ids[len(ids) - n + 1 :], fresh[len(fresh) - n + 1 :]
                count = len(ids) - n + 1
                if count <= 0:
                    tail = ids, fresh
                    continue
                # whole: the run of n - 1 words that starts here stays in one piece and may be frequent
                shorter = n - 1
                whole = np.ones(len(ids) - shorter + 1, bool)
                for k in range(1, shorter):
                    whole &= ~fresh[k : k + len(whole)]
                at = np.flatnonzero(whole)
                if shorter == 1:
                    whole = _marked(marks, ids >> np.uint64(width - WORD_BITS))
                else:
                    low = quotient.permute(quotient.pack([ids[at + k] for k in range(shorter)], width))[0]
                    whole[at] = _marked(marks, low >> np.uint64(64 - PHRASE_BITS))
                at = np.flatnonzero(whole[:count] & whole[1 : count + 1] & ~fresh[n - 1 :])
                if len(at):
                    keys.append(quotient.permute(quotient.pack([ids[at + k] for k in range(n)], width)))
                    n_keys += len(at)
                if n_keys > HELD:
                    yield out()
                    keys, n_keys = [], 0
        if n_keys:
            yield out()

    return texts.mapInArrow(run, "part int, filter binary")


def _merged(filters: DataFrame, n: int, width: int, least: int, part_bits: int) -> DataFrame:
    """``(ids, slot, a)`` of the runs counted ``least`` times in all filters of a part.

    A part holds a fixed share of the permuted key space: the number of parts
    grows with the counted words, and a common run is one entry per filter.
    """

    def run(key, table):
        part = key[0].as_py()
        limbs, counts = quotient.merge([quotient.load(f.as_buffer().to_pybytes(), part, part_bits, n * width) for c in table.column("filter").chunks for f in c])
        often = counts >= least
        limbs, counts = [x[often] for x in limbs], counts[often]
        ids = np.stack(quotient.unpack(quotient.restore(limbs), width, n), axis=1).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, n), pa.int32()), pa.array(ids))
        return pa.table([lists, pa.array((limbs[0] >> np.uint64(64 - PHRASE_BITS)).astype(np.int64)), pa.array(counts)], ["ids", "slot", "a"])

    return filters.groupBy("part").applyInArrow(run, "ids array<long>, slot long, a long")


def _bit_table(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """A table of ``2 ** bits`` bits with the rows' slots set, whatever their number."""
    words = rows.select(slot.alias("s")).select((F.shiftright("s", 6)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    got = bounded(words.groupBy("w").agg(F.bit_or("b").alias("b")), 1 << bits - 6)
    table = np.zeros(1 << bits - 6, np.int64)
    table[got["w"].astype(np.int64)] = got["b"]
    return table.view(np.uint8)


# --- candidates ----------------------------------------------------------------------

def _scored(df: DataFrame, n: int) -> DataFrame:
    """Adds ``l``, ``r`` and ``score`` of the lowest-scoring cut; a tie goes to the shorter first part.

    ``before[k - 1]`` counts the first k words, ``after[k - 1]`` the last k.
    """
    cuts = []
    for k in range(1, n):
        first, rest = F.get("before", F.lit(k - 1)), F.get("after", F.lit(n - k - 1))
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(get(before, {k - 1}) as decimal(18,0)) * cast(get(after, {n - k - 1}) as decimal(18,0)))")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
    best = df.withColumn("_cut", F.array_min(F.array(*cuts)))
    return best.select("ids", "lang", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))


def _joined(found: DataFrame, shorter: DataFrame, n: int) -> DataFrame:
    """Runs of ``n`` words beside their first and last ``n - 1``: language and counts of all beginnings and ends."""
    front = shorter.select(F.col("ids").alias("_front"), "lang", F.col("before").alias("_before"))
    back = shorter.select(F.col("ids").alias("_back"), F.col("after").alias("_after"))
    keyed = found.select("ids", "slot", "a", F.slice("ids", 1, n - 1).alias("_front"), F.slice("ids", 2, n - 1).alias("_back"))
    out = keyed.join(front, "_front").join(back, "_back")
    own = F.array("a")
    return out.select("ids", "slot", "lang", "a", F.concat("_before", own).alias("before"), F.concat("_after", own).alias("after"))


def _not_inside(level: DataFrame, longer: list[tuple[int, DataFrame]], n: int, share: int) -> DataFrame:
    """Rows that no longer run of at least ``share`` percent of their count holds."""
    for m, rows in longer:
        inner = rows.select("a", F.explode(F.array(*[F.slice("ids", k + 1, n) for k in range(m - n + 1)])).alias("ids"))
        most = inner.groupBy("ids").agg(F.max("a").alias("_most"))
        level = level.join(most, "ids", "left").where(F.coalesce(100 * F.col("_most") < share * F.col("a"), F.lit(True))).drop("_most")
    return level


def _first(rows: DataFrame, order: list, most: int, number) -> DataFrame:
    """Each language's rows with a ``number`` of up to ``most``, found in shares of a language first."""
    shares = max(1, -(-rows.count() >> 18))
    salt = F.pmod(F.xxhash64("ids"), F.lit(shares))
    near = rows.withColumn("_salt", salt).withColumn("_rank", number.over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    return near.where(F.col("_rank") <= most).drop("_salt", "_rank")


def collocations(docs: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into
    pieces, these at spaces and tabs into words. A candidate is a run of
    ``shortest`` to ``longest`` words of a piece met ``a >= least`` times; cut
    in two, its parts are met ``l`` and ``r`` times, and its score is
    ``floor(1000000 a a / (l r))`` of the lowest-scoring cut. Candidates inside
    a longer one of at least ``share`` percent of their count are dropped.
    ``n`` counts the language's words.

    A null text is empty, a null language is ``und``; repeated rows count again;
    a language with no words or no candidates has no rows; equal scores go by
    ``a``, then by the phrase's bytes; extra columns are ignored; an empty
    table gives no rows.
    """
    if not 2 <= shortest <= longest:
        raise ValueError("2 <= shortest <= longest")
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(_LANG)).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_word_counts, "lang string, word string, f long")
    vocabulary = save(counts.groupBy("lang", "word").agg(F.sum("f").alias("f")), "vocabulary")
    totals = save(vocabulary.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words, seed, width = _frequent(vocabulary, least)
    total = totals.agg(F.sum("n")).first()[0] or 0
    part_bits = max(0, (total // PART_ENTRIES).bit_length())

    # level by level: a run is counted where both of its shorter runs may be frequent
    level = words.select(F.array("id").alias("ids"), "lang", F.array("f").alias("before"), F.array("f").alias("after"))
    table = _bit_table(words, F.shiftrightunsigned("id", width - WORD_BITS), WORD_BITS)
    levels: list[tuple[int, DataFrame]] = []
    for n in range(2, longest + 1):
        found = save(_merged(_filters(texts, n, width, seed, table, part_bits), n, width, least, part_bits), "runs")
        level = save(_joined(found, level, n), "level")
        levels.append((n, level))
        if n < longest:
            table = _bit_table(level, F.col("slot"), PHRASE_BITS)

    best = None
    for n, rows in levels:
        if n >= shortest:
            kept = _scored(_not_inside(rows, [x for x in levels if x[0] > n], n, share), n)
            best = kept if best is None else best.unionByName(kept)
    best = save(best, "scored")
    # ties at the end stay until their phrases are known
    near = save(_first(best, [F.col("score").desc(), F.col("a").desc()], top, F.rank()), "near")
    spelled = near
    for k in range(longest):
        spelled = spelled.join(words.select(F.col("id").alias(f"_id{k}"), F.col("word").alias(f"_w{k}")), F.get("ids", F.lit(k)) == F.col(f"_id{k}"), "left").drop(f"_id{k}")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"_w{k}" for k in range(longest)]))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    last = save(_first(save(spelled, "spelled"), order, top, F.row_number()), "first")
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
