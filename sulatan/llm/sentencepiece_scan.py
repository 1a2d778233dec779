"""SentencePiece encoding by a max-plus scan over chunks, and decoding."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.chunks import cut, short_and_long
from sulatan.llm.store import docs_of, save
from sulatan.llm.token_counts import _groups
from sulatan.llm.words import span_hashes

CHUNK = 1 << 15
GAP = "▁"
#: no path; weights are integers, exact in sums
NONE = -(10**37)
#: distinct units kept per worker; the ones not met since the last turn are forgotten
MOST_WORDS = 120_000
#: characters of a unit that is segmented together with others
SHORT_UNIT = 32


class Pieces:
    """Pieces of a model file, and the best segmentation under their scores.

    Weights are whole numbers: the score in 1024ths, and a tie-break from the
    piece and its place in its unit. Sums are exact, so every way of computing
    the best path finds the same one. Pieces stand in a tree by character. A character outside the vocabulary costs
    ten more than the lowest score and becomes its bytes.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weight: dict[str, tuple[int, int]] = {}
        self.byte: dict[int, int] = {}
        self.raw: list[bytes] = []
        lowest = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
                continue
            usual = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            self.raw.append(piece.replace(GAP, " ").encode() if usual else b"")
            if usual:
                self.weight[piece] = (round(model.get_score(i) * 1024), i)
                if model.get_score(i) > -1e6:
                    lowest = min(lowest, model.get_score(i))
        self.unknown = round((lowest - 10) * 1024)
        self.root: dict = {}
        for piece, (w, i) in self.weight.items():
            node = self.root
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, None, 0])[0]
            node.setdefault(piece[-1], [{}, None, 0])[1:] = [w, i]
        self.states = max(map(len, self.weight))
        # no piece has a gap after another character: every gap after one starts a unit
        self.units = not any(GAP in p.lstrip(GAP) for p in self.weight)
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}
        self._arrays()

    def _arrays(self) -> None:
        """The tree as sorted arrays: ``edge`` (node and character), the node it leads to, and each node's weight and piece (-1: none)."""
        letters = np.unique(np.array([ord(c) for p in self.weight for c in p], np.int64))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        edges, weight, piece, todo = [], [0], [-1], [(0, self.root)]
        for number, nodes in todo:
            for c, (below, w, i) in nodes.items():
                edges.append((number * self.letters + int(self.letter[ord(c)]), len(weight)))
                todo.append((len(weight), below))
                weight.append(w or 0)
                piece.append(-1 if w is None else i)
        self.edge, self.child = np.array(sorted(edges), np.int64).T.copy()
        self.node_weight, self.node_piece = np.array(weight, np.int64), np.array(piece, np.int64)

    def units_at_once(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best pieces of many short units: ids, their offsets, and which units are plain.

        The tree is walked from all characters together; the best scores are
        then taken by distance from the unit's end. A character that begins no
        piece gives the id -1 less its code. Units with two ways that score
        alike are not plain.
        """
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size)])
        unit = np.repeat(np.arange(len(size)), size)
        place = np.arange(at[-1]) - at[unit]
        left = size[unit] - place  # characters to the unit's end
        letter = self.letter[code[starts[unit] + place]].astype(np.int64)
        node, live, found = np.zeros(at[-1], np.int64), np.arange(at[-1]), []
        for depth in range(int(size.max())):
            live = live[left[live] > depth]
            want = node[live] * self.letters + letter[live + depth]
            spot = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
            hit = self.edge[spot] == want
            live = live[hit]
            if not len(live):
                break
            node[live] = self.child[spot[hit]]
            whole = live[self.node_piece[node[live]] >= 0]
            found.append((whole, node[whole], np.full(len(whole), depth + 1)))
        begin, to, long = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        plain = np.ones(len(size), bool)
        some = np.zeros(at[-1], bool)
        some[begin] = True
        alone = np.flatnonzero(~some)
        own_code = code[starts[unit[alone]] + place[alone]].astype(np.int64)
        begin, long = np.append(begin, alone), np.append(long, np.ones(len(alone), np.int64))
        weight, which = np.append(self.node_weight[to], np.full(len(alone), self.unknown)), np.append(self.node_piece[to], -1 - own_code)
        order = np.lexsort((begin, left[begin]))
        begin, long, weight, which = begin[order], long[order], weight[order], which[order]
        best = np.zeros(at[-1] + 1, np.int64)
        step, piece = np.zeros(at[-1], np.int64), np.zeros(at[-1], np.int64)
        bounds = np.searchsorted(left[begin], np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            own, reach, last = begin[lo:hi], long[lo:hi], left[begin[lo]]
            score = weight[lo:hi] + np.where(reach < last, best[own + reach], 0)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            top = np.maximum.reduceat(score, first)
            is_top = score == np.repeat(top, np.diff(np.append(first, hi - lo)))
            plain[unit[own[first[np.add.reduceat(is_top, first) > 1]]]] = False
            best[own[first]] = top
            step[own[is_top]], piece[own[is_top]] = reach[is_top], which[lo:hi][is_top]
        now, rows, ids = at[:-1][plain & (size > 0)], [], []
        while len(now):
            rows.append(unit[now])
            ids.append(piece[now])
            now = now[step[now] < left[now]] + step[now][step[now] < left[now]]
        row, out = (np.concatenate(rows), np.concatenate(ids)) if rows else (np.zeros(0, np.int64),) * 2
        order = np.argsort(row, kind="stable")
        return out[order].astype(np.int32), np.searchsorted(row[order], np.arange(len(size) + 1)), plain

    def backward(self, text: str, n: int, end: int, lead: int = 0) -> tuple[list[int | None], list[int], list[int]]:
        """Best score from each position to ``end`` with pieces that start before ``n``, its tie-break, and where the first piece ends.

        ``lead``: how far before ``text`` its first unit began.
        """
        size = len(text) + 1
        best, tie, step = [None] * size, [0] * size, [0] * size
        best[end] = 0
        root, weight = self.root, self.weight
        for i in range(min(n, end) - 1, -1, -1):
            top, to, which, node = None, i + 1, -1, None
            nodes = root
            for j in range(i, end):
                node = nodes.get(text[j])
                if node is None:
                    break
                nodes = node[0]
                w = node[1]
                if w is None or best[j + 1] is None:
                    continue
                w += best[j + 1]
                if top is None or w > top:
                    top, to, which = w, j + 1, node[2]
                elif w == top and tie[j + 1] + self._tie(node[2], lead + i) > tie[to] + self._tie(which, lead + i):
                    to, which = j + 1, node[2]
            if top is None and text[i] not in weight and best[i + 1] is not None:
                top = self.unknown + best[i + 1]
            best[i], step[i] = top, to
            tie[i] = tie[to] + self._tie(which, lead + i)
        return best, tie, step

    @staticmethod
    def _tie(piece: int, place: int) -> int:
        return (piece + 7) * (place + 1) * 2654435761 >> 7 & 0xFFFFFF

    def path(self, text: str, start: int, step: list[int], end: int) -> list[int]:
        out, i = [], start
        while i < end:
            got = self.weight.get(text[i : step[i]])
            out += [got[1]] if got is not None else [self.byte[b] for b in text[i].encode()]
            i = step[i]
        return out

    def unit(self, text: str) -> list[int]:
        """Best pieces of a unit; the tie-break is only worked out where two ways score alike."""
        n, root = len(text), self.root
        best, step, piece = [0] * (n + 1), [0] * n, [-1] * n
        for i in range(n - 1, -1, -1):
            top, nodes = None, root
            for j in range(i, n):
                node = nodes.get(text[j])
                if node is None:
                    break
                nodes, w, which = node
                if w is not None:
                    w += best[j + 1]
                    if top is None or w > top:
                        top = w
                        step[i], piece[i] = j + 1, which
                    elif w == top:
                        return self.path(text, 0, self.backward(text, n, n)[2], n)
            if top is None:
                top, step[i] = self.unknown + best[i + 1], i + 1
            best[i] = top
        out, i = [], 0
        while i < n:
            if piece[i] >= 0:
                out.append(piece[i])
            else:
                out += [self.byte[b] for b in text[i].encode()]
            i = step[i]
        return out

    def cuts(self, text: str) -> np.ndarray:
        """Positions that no piece can span."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        gap = code == ord(GAP)
        return np.flatnonzero(gap[1:] & ~gap[:-1]) + 1 if self.units and len(code) else np.zeros(0, np.int64)

    def many(self, text: str, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each ``text[at[k]:at[k+1]]``; every distinct unit is segmented once."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], self.cuts(text)]))
        ends = np.append(starts[1:], len(code))
        if not len(starts):
            return [np.zeros(0, np.int32)] * (len(at) - 1)
        value = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        units, first, which = np.unique(span_hashes(value, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self.known, self.older = {}, self.known
        ids, names = [], units.tolist()
        for h in names:
            got = self.known.get(h)
            if got is None:
                got = self.older.get(h)
                if got is not None:
                    self.known[h] = got
            ids.append(got)
        new = np.array([k for k, got in enumerate(ids) if got is None], np.int64)
        size = (ends - starts)[first[new]]
        short = new[size <= SHORT_UNIT]
        if len(short):
            flat, spot, plain = self.units_at_once(code, starts[first[short]], ends[first[short]])
            raw, odd = flat.tobytes(), np.zeros(len(short), bool)
            odd[np.searchsorted(spot, np.flatnonzero(flat < 0), "right") - 1] = True
            for k, a, b, ok, unknown in zip(short.tolist(), spot[:-1].tolist(), spot[1:].tolist(), plain.tolist(), odd.tolist()):
                if unknown:
                    got = [[i] if i >= 0 else [self.byte[x] for x in chr(-1 - i).encode()] for i in flat[a:b].tolist()]
                    ids[k] = np.array([i for part in got for i in part], np.int32).tobytes()
                elif ok:
                    ids[k] = raw[4 * a : 4 * b]
                else:  # ways that score alike
                    part = text[starts[first[k]] : ends[first[k]]]
                    ids[k] = np.array(self.path(part, 0, self.backward(part, len(part), len(part))[2], len(part)), np.int32).tobytes()
        for k, n in zip(new.tolist(), size.tolist()):
            if ids[k] is None:
                f = first[k]
                ids[k] = np.array(self.unit(text[starts[f] : ends[f]]), np.int32).tobytes()
            if n <= 64:
                self.known[names[k]] = ids[k]
        sizes = np.array([len(x) // 4 for x in ids])
        flat, base = np.frombuffer(b"".join(ids), np.int32), np.concatenate([[0], np.cumsum(sizes)])
        n = sizes[which]
        to = np.concatenate([[0], np.cumsum(n)])
        every = flat[np.repeat(base[which] - to[:-1], n) + np.arange(to[-1])]
        bounds = to[np.searchsorted(starts, at)]
        return [every[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def transfer(self, text: str, ahead: str, lead: int) -> tuple[bool, list[int]]:
        """A chunk's max-plus transfer matrix between boundary states.

        State a: the first a characters belong to a piece begun before; state
        b: the last piece reaches b characters ahead. With a cut inside, the
        matrix is an outer sum of a head and a tail vector (the constant
        between them changes no choice), else it is given row by row.
        """
        n, size = len(text), self.states
        every = text + ahead
        found = self.cuts(text)

        def values(part: str, n: int, end: int, lead: int) -> list[int]:
            best, tie, _ = self.backward(part, n, end, lead) if end <= len(part) else ([], [], [])
            return ([NONE if x is None else (x << 48) + t for x, t in zip(best, tie)] + [NONE] * size)[:size]

        if len(found):
            f, last = int(found[0]), int(found[-1])
            head = values(text[:f], f, f, lead)
            tail = [values(every[last:], n - last, n - last + b, 0)[0] for b in range(size)]
            return True, head + tail
        columns = [values(every, n, n + b, lead) for b in range(size)]
        return False, [columns[b][a] for a in range(size) for b in range(size)]

    def chunk(self, text: str, ahead: str, lead: int, a: int, b: int) -> np.ndarray:
        """Ids of the pieces that start in the chunk, from state ``a`` to state ``b``."""
        n = len(text)
        found = self.cuts(text)
        if not len(found):
            return np.array(self.path(text + ahead, a, self.backward(text + ahead, n, n + b, lead)[2], n + b) if a < n else [], np.int32)
        f, last = int(found[0]), int(found[-1])
        head = self.path(text[:f], a, self.backward(text[:f], f, f, lead)[2], f)
        rest = (text + ahead)[last : n + b]
        tail = self.path(rest, 0, self.backward(rest, n - last, n - last + b)[2], len(rest))
        return np.concatenate([np.array(head, np.int32), self.many(text[f:last], np.array([0, last - f]))[0], np.array(tail, np.int32)])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model, once per worker."""
    return Pieces(path)


def compose(left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
    """Max-plus product of two transfer matrices (associative)."""
    return [[max(max(x + y for x, y in zip(row, column)), NONE) for column in zip(*right)] for row in left]


def _states(size: int):
    """Entry and exit state of every chunk of one text, from the transfer matrices."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        after = [[0]] + [[NONE]] * (size - 1)
        choice = []
        for cuts, values in zip(frame["cuts"][::-1], frame["values"][::-1]):
            v = [int(x) for x in values]
            # a rank-one matrix needs only its head and tail
            rows = [v[size:]] if cuts else [v[a * size : a * size + size] for a in range(size)]
            choice.append([max(range(size), key=lambda b, r=r: r[b] + after[b][0]) for r in rows])
            after = [[x] for x in v[:size]] if cuts else compose(rows, after)
        a, enter, leave = 0, [], []
        for best in choice[::-1]:
            enter.append(a)
            a = best[a if len(best) > 1 else 0]
            leave.append(a)
        return pd.DataFrame({"row": frame["row"], "k": frame["k"], "a": enter, "b": leave})

    return run


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def _encoded(path: str):
    def run(batches):
        for batch in batches:
            for lo, hi, text, at in _groups(batch.column(2)):
                ids = pieces(path).many(text, at)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _lists(ids), _same(path, rows.column(1), ids)], ["doc_id", "text", "ids", "round_trip"])

    return run


def _same(path: str, texts: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    """Decoding the ids gives the text."""
    return pa.array([pieces(path).decode(i) == (t or "") for t, i in zip(texts.to_pylist(), ids)], pa.bool_())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, text, ids, round_trip)``: the best-scoring pieces of every row's text.

    Blanks become gaps and one gap is put in front, as in the model's files.
    Rows over ``chunk`` characters are cut: each chunk row gives a transfer
    matrix, the matrices of a text are combined into the boundary states, and
    each chunk then traces its own pieces. The ids equal those of the whole
    text at once. ``round_trip``: decoding the ids gives the text back, which
    fails only where a text has the gap sign itself.

    Null and empty texts have no ids (null stays null in ``text``); null ids
    stay; repeated rows are encoded alike; extra columns are ignored; an empty
    table gives no rows.
    """
    docs = docs_of(docs, id_col, text_col)
    own = F.when(F.length("text") > 0, F.concat(F.lit(GAP), F.translate("text", " ", GAP))).otherwise("")
    none = docs.where("text is null").select("doc_id", "text", F.array().cast("array<int>").alias("ids"), F.lit(True).alias("round_trip"))
    short, long = short_and_long(docs.where("text is not null"), chunk)
    kept = short.select("doc_id", "text", own.alias("gapped")).mapInArrow(_encoded(path), "doc_id long, text string, ids array<int>, round_trip boolean")
    size = pieces(path).states

    def transfers(batches):
        for batch in batches:
            got = [pieces(path).transfer(*x) for x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.list_(pa.decimal128(38)))], ["row", "k", "cuts", "values"])

    def traces(batches):
        for batch in batches:
            _, _, *parts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([pieces(path).chunk(*x) for x in zip(*parts)])], ["row", "k", "ids"])

    keyed = save(long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long_texts")
    chunks = save(cut(keyed.select(F.col("row").alias("doc_id"), own.alias("text")), chunk, size - 1, GAP).select(F.col("doc_id").alias("row"), "k", "text", "ahead", "lead"), "chunks")
    states = chunks.mapInArrow(transfers, "row long, k long, cuts boolean, values array<decimal(38,0)>").groupBy("row").applyInPandas(_states(size), "row long, k long, a int, b int")
    traced = chunks.join(states, ["row", "k"]).select("row", "k", "text", "ahead", "lead", "a", "b").mapInArrow(traces, "row long, k long, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))

    def checked(batches):
        for batch in batches:
            lists = batch.column(2)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            yield batch.append_column("round_trip", _same(path, batch.column(1), [values[a:b] for a, b in zip(at[:-1], at[1:])]))

    long_rows = keyed.join(whole, "row").select("doc_id", "text", "ids").mapInArrow(checked, "doc_id long, text string, ids array<int>, round_trip boolean")
    return kept.unionByName(long_rows).unionByName(none)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as column ``into`` (null ids: empty text)."""
    spot = encoded.columns.index(ids_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + [f"`{into}` string"]

    def run(batches):
        for batch in batches:
            lists = batch.column(spot).fill_null([])
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [pieces(path).decode(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return encoded.mapInArrow(run, ", ".join(fields))
