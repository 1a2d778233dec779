"""Token counts of a byte-level BPE, by a compiled transducer and a chunk scan."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sulatan.llm.chunks import cut, short_and_long
from sulatan.llm.store import docs_of
from sulatan.llm.words import PIECE_BYTES, span_hashes, text_bytes

#: characters of a text that one task counts at once
CHUNK = 1 << 16
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: states and words kept per worker before they are built anew
MOST_STATES, MOST_WORDS, LONG_WORD = 1_000_000, 400_000, 256


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character class by code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    out[WHITE] = BLANK
    out[32] = SPACE
    return out


def _byte_of() -> dict[str, int]:
    """Byte for each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Deterministic transducer from bytes of a word to its number of tokens.

    A state is a prefix; it holds the last token of the prefix's encoding and
    the tokens emitted so far. The last token is the one vocabulary suffix
    that the tokens before it leave whole, so a transition looks back at most
    one token. Transitions are compiled when first used.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        raw = lambda s: bytes(byte[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in byte for c in s)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # tokens by merge order: single bytes first
        self.rank = {bytes([b]): b for b in range(256)}
        self.split = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs):
            left, right = self.rank[raw(a)], self.rank[raw(b)]
            whole = raw(a) + raw(b)
            assert whole in vocab
            self.joined[left, right] = self.rank.setdefault(whole, 256 + k)
            self.split.append((left, right))
        self.longest = max(map(len, self.rank))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.apart: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.count = [-1], [0]

    def _keep_apart(self, left: int, right: int) -> bool:
        """The two tokens side by side are not merged into, or out of, each other.

        Undoes the younger token's last merge again and again; if the tokens
        that then meet have a merge older than what was undone, it would have
        come first.
        """
        key = left * len(self.split) + right
        if (known := self.apart.get(key)) is not None:
            return known
        if len(self.apart) > MOST_STATES:
            self.apart.clear()
        a, b, limit = left, right, len(self.split)
        while True:
            if (made := self.joined.get((a, b))) is not None and made < limit:
                ok = False
                break
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        ok = True
                        break
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        ok = True
                        break
        self.apart[key] = ok
        return ok

    @lru_cache(maxsize=1 << 17)  # noqa: B019
    def _whole(self, token: int) -> bool:
        """The token's own bytes encode to the token."""
        left, right = self.split[token]
        if left == right == token:
            return True
        # its parts, without their own last merge, stay apart until they merge
        if not (self._whole(left) and self._whole(right)):
            return False
        joined = self.joined.pop((left, right))
        self.apart.pop(left * len(self.split) + right, None)
        ok = self._keep_apart(left, right)
        self.joined[left, right] = joined
        self.apart.pop(left * len(self.split) + right, None)
        return ok

    def _step(self, word: bytes, end: int, last: list[int]) -> tuple[int, int]:
        """Last token of ``word[:end]`` and where it starts; ``last`` has those of shorter prefixes."""
        for start in range(max(0, end - self.longest), end):
            token = self.rank.get(word[start:end])
            if token is not None and (self._whole(token) if start == 0 else self._keep_apart(last[start], token)):
                return token, start
        raise AssertionError("single bytes are tokens")

    def tokens(self, word: bytes) -> int:
        """Number of tokens of one word."""
        if len(word) > LONG_WORD:
            last, count = [-1], [0]
            for end in range(1, len(word) + 1):
                token, start = self._step(word, end, last)
                last.append(token)
                count.append(count[start] + 1)
            return count[-1]
        state, path = 0, [0]
        for end, b in enumerate(word, 1):
            new = self.next.get(state << 8 | b)
            if new is None:
                if len(self.last) > MOST_STATES:
                    self.reset()
                    return self.tokens(word)
                token, start = self._step(word, end, [self.last[s] for s in path])
                new = len(self.last)
                self.next[state << 8 | b] = new
                self.last.append(token)
                self.count.append(self.count[path[start]] + 1)
            state = new
            path.append(state)
        return self.count[state]


class Counter:
    """Counts tokens of many texts at once: word boundaries by array rules, each distinct word once."""

    def __init__(self, path: str) -> None:
        self.transducer, self.known = Transducer(path), {}

    def pieces(self, text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and start flag of each character, and its code point; ``at``: offsets of the texts in ``text``.

        Words: letters, digits or other signs, each run with one space before
        it; white space before that space; and the English endings after an
        apostrophe that starts a word.
        """
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = classes()[code]
        n = len(code)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        white = kind >= BLANK
        group = np.where(white, BLANK, kind)
        start = edge[:-1].copy()
        start[1:] |= group[1:] != group[:-1]
        inner = ~edge[1:-1]  # between two characters of a text
        start[1:] &= ~(inner & ~white[1:] & (kind[:-1] == SPACE))
        start[:-1] |= inner & white[:-1] & ~white[1:]
        for i in np.flatnonzero((code == 39) & start).tolist():
            end = i + 1
            while end < min(n, i + 3) and not edge[end]:
                end += 1
            tail = text[i + 1 : end]
            size = 2 if tail[:1] in ("s", "t", "m", "d") else 3 if tail in ("re", "ve", "ll") else 0
            if size:
                start[i + 1] = False
                if i + size < n:
                    start[i + size] = True
        return code, kind, start

    def count(self, text: str, at: np.ndarray) -> np.ndarray:
        """Tokens of each text ``text[at[k]:at[k+1]]``."""
        out = np.zeros(len(at) - 1, np.int64)
        marks = []
        for token in self.transducer.special:
            spot = text.find(token)
            while spot >= 0:
                row = int(np.searchsorted(at, spot, "right")) - 1
                if spot + len(token) <= at[row + 1]:
                    marks.append((spot, spot + len(token)))
                    out[row] += 1
                    spot = text.find(token, spot + len(token))
                else:
                    spot = text.find(token, spot + 1)
        if not text:
            return out
        edges = np.unique(np.concatenate([at, np.array(marks, np.int64).ravel()])).astype(np.int64)
        code, _, start = self.pieces(text, edges)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(code))
        if marks:
            plain = ~np.isin(starts, [m[0] for m in marks])
            # a special token is one word: drop the starts inside it
            for s, e in marks:
                plain &= ~((starts > s) & (starts < e))
            ends = np.minimum(ends, edges[np.minimum(np.searchsorted(edges, starts, "right"), len(edges) - 1)])
            starts, ends = starts[plain], ends[plain]
        value = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        words, first, which = np.unique(span_hashes(value, starts, ends), return_index=True, return_inverse=True)
        n = np.empty(len(words), np.int64)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        for k, (h, f) in enumerate(zip(words.tolist(), first.tolist())):
            got = self.known.get(h)
            if got is None:
                got = self.known[h] = self.transducer.tokens(text[starts[f] : ends[f]].encode())
            n[k] = got
        return out + np.bincount(np.searchsorted(at, starts, "right") - 1, weights=n[which], minlength=len(out)).astype(np.int64)

    def summary(self, text: str) -> tuple[int, str, str, bool]:
        """A chunk as an element of the scan: tokens inside, head, tail, and whether it has a cut.

        A cut is a space between a letter and a character that is not white: a
        word starts there whatever stands around the chunk. Elements compose:
        the left tail and the right head make a text of their own.
        """
        at = np.array([0, len(text)])
        code, kind, _ = self.pieces(text, at)
        cuts = np.flatnonzero((kind[1:-1] == SPACE) & (kind[:-2] == LETTER) & (kind[2:] < BLANK)) + 1
        if not len(cuts):
            return 0, text, "", False
        a, b = int(cuts[0]), int(cuts[-1])
        return int(self.count(text[a:b], np.array([0, b - a]))[0]), text[:a], text[b:], True


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The compiled tokenizer, once per worker."""
    return Counter(path)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, str, np.ndarray]]:
    data, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE_BYTES, "right")) - 1)
        part = data[at[lo] : at[hi]]
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        yield lo, hi, part.tobytes().decode(), chars[at[lo : hi + 1] - at[lo]]
        lo = hi


def _counted(path: str):
    """Appends the token count of the last column to the others."""

    def run(batches):
        for batch in batches:
            n = [counter(path).count(text, at) for _, _, text, at in _groups(batch.column(batch.num_columns - 1))]
            n = pa.array(np.concatenate(n) if n else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return run


def _summaries(path: str):
    def run(batches):
        for batch in batches:
            inner, head, tail, cuts = zip(*(counter(path).summary(t) for t in batch.column(3).to_pylist())) if batch.num_rows else ((),) * 4
            size = [len(t.encode()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(inner, pa.int64()), pa.array(head, pa.string()), pa.array(tail, pa.string()), pa.array([int(c) for c in cuts], pa.int64())], ["row", "doc_id", "k", "size", "inner", "head", "tail", "cuts"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row.

    Equals the tokenizer library's count for the file at ``path``, without
    added tokens; special strings inside a text are one token, as its default.
    ``path`` must be readable on every worker.

    Rows longer than ``chunk`` characters are cut into chunk rows. A chunk
    becomes (tokens between its first and last cut, text before, text after);
    a prefix sum of cuts numbers the seams between chunks, and each seam, left
    tails with right heads, is counted like a text. So no task counts more
    than a chunk, unless a text has no cut at all.

    Null and empty texts have 0 bytes and tokens; null ids stay; repeated rows
    are counted alike; extra columns are ignored; an empty table gives no rows.
    """
    short, long = short_and_long(docs_of(docs, id_col, text_col), chunk)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    kept = short.select("doc_id", size, "text").mapInArrow(_counted(path), "doc_id long, n_bytes long, n_tokens long")

    chunks = cut(long, chunk).mapInArrow(_summaries(path), "row long, doc_id long, k long, size long, inner long, head string, tail string, cuts long")
    chunks = chunks.withColumn("seam", F.sum("cuts").over(Window.partitionBy("row").orderBy("k")))
    seams = chunks.select("row", "doc_id", "size", "inner", F.explode(F.array(
        F.struct((F.col("seam") - F.col("cuts")).alias("seam"), F.col("k"), F.lit(0).alias("side"), F.col("head").alias("text")),
        F.struct(F.col("seam"), F.col("k"), F.lit(1).alias("side"), F.col("tail").alias("text")))).alias("s"))
    seams = seams.select("row", "doc_id", F.when(F.col("s.side") == 0, F.col("inner")).otherwise(0).alias("inner"), F.when(F.col("s.side") == 0, F.col("size")).otherwise(0).alias("size"), "s.*")
    seams = seams.groupBy("row", "doc_id", "seam").agg(F.sum("inner").alias("inner"), F.sum("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "side", "text"))), lambda x: x["text"]), "").alias("text"))
    counted = seams.select("row", "doc_id", "size", "inner", "text").mapInArrow(_counted(path), "row long, doc_id long, size long, inner long, n_tokens long")
    totals = counted.groupBy("row", "doc_id").agg(F.sum("size").alias("n_bytes"), F.sum(F.col("inner") + F.col("n_tokens")).alias("n_tokens"))
    counted = kept.unionByName(totals.select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
