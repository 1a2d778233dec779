"""Secret scans: fixed patterns, and character Markov models for other strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.llm.store import bounded, docs_of
from sulatan.llm.words import PIECE_BYTES, text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
KEYWORD = re.compile(rb"(?:password|passwd|secret|token|api_?key)$", re.I)
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: symbols of the Markov models: 0 for outside a string, then the characters of STRING
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1
CODE = np.zeros(256, np.uint8)
CODE[list(ALPHABET.encode())] = np.arange(1, SYMBOLS)
HEXES = np.isin(np.arange(256), list(b"0123456789abcdef"))
#: characters of a string that is judged, and of one that is learned from
JUDGED, LEARNED = 20, 8
#: virtual counts after each character
PRIOR = 16.0
COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]


def _long_runs(inside: np.ndarray, breaks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``inside`` that do not cross ``breaks``."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = breaks[(breaks > 0) & (breaks < len(inside))]
    first[inner], last[inner - 1] = inside[inner], inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _keyword_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of ``:`` or ``=`` that follow a keyword of ASSIGN."""
    marks = np.flatnonzero((data == 58) | (data == 61))
    if not len(marks):
        return marks
    solid = np.maximum.accumulate(np.where(data != 32, np.arange(len(data)), -1))
    end = np.where(marks > 0, solid[marks - 1], -1)
    end = end - ((end >= 0) & np.isin(data[end], [34, 39]))
    marks, end = marks[end >= 4], end[end >= 4]
    likely = np.isin(data[end] | 32, list(b"dtny"))
    marks, end = marks[likely], end[likely]
    raw = data.tobytes()
    return np.array([m for m, e in zip(marks.tolist(), end.tolist()) if KEYWORD.search(raw, max(0, e - 8), e + 1)], np.int64)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some whole rows at a time: first row, last row, bytes and offsets."""
    data, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE_BYTES, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _rows_of(spots: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, spots, "right") - 1


def _suspects(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may hold a base match, and rows with a string to judge."""
    base = np.concatenate([_rows_of(_keyword_rows(data, at), at), _rows_of(_long_runs(HEXES[data], at, LEAST["hex"])[0], at)])
    strings, ends = _long_runs(CODE[data] > 0, at, JUDGED)
    return np.unique(base), np.unique(_rows_of(strings, at))


def _counts(batches):
    """Character pairs of labelled samples: base matches are random, the rest ordinary."""
    total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for batch in batches:
        for lo, hi, data, at in _pieces(batch.column(0)):
            if not len(data):
                continue
            base, judged = _suspects(data, at)
            random = np.zeros(len(data), bool)
            for r in np.union1d(base, judged):
                text = data[at[r] : at[r + 1]].tobytes().decode()
                spans = base_spans(text)
                where = np.cumsum([0] + [len(c.encode()) for c in text]) if spans and not text.isascii() else None
                for _, s, e in spans:
                    s, e = (s, e) if where is None else (int(where[s]), int(where[e]))
                    random[at[r] + s : at[r] + e] = True
            code = CODE[data].astype(np.int64)
            starts, ends = _long_runs(code > 0, at, LEARNED)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            inside = np.cumsum(inside[:-1]) > 0
            left = np.zeros(len(data), bool)
            left[starts] = True
            pair = np.where(left, 0, np.concatenate([[0], code[:-1]])) * SYMBOLS + code
            for label in (0, 1):
                total[label] += np.bincount(pair[inside & (random == bool(label))], minlength=SYMBOLS * SYMBOLS)
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], ["label", "pair", "n"])


def fit_models(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each character after each other.

    Pair counts of all rows, two models of fixed size. After a character seen
    little, the random model expects any character alike, and the ordinary one
    the characters that ordinary strings have.
    """
    counts = docs.select("text").mapInArrow(_counts, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    got = bounded(counts, 2 * SYMBOLS * SYMBOLS)
    n = np.zeros((2, SYMBOLS * SYMBOLS))
    n[got["label"].astype(int), got["pair"].astype(int)] += got["n"]
    n = n.reshape(2, SYMBOLS, SYMBOLS)[:, :, 1:]
    n[0] = np.maximum(n[0] - 1, 0)  # a pair seen once may be the very string that is judged
    alone = np.stack([n[0].sum(axis=0) + 1, np.ones(SYMBOLS - 1)])
    alone /= alone.sum(axis=1, keepdims=True)
    p = np.log((n + PRIOR * alone[:, None, :]) / (n.sum(axis=2, keepdims=True) + PRIOR))
    return np.pad(p[1] - p[0], ((0, 0), (1, 0)))


def random_score(string: str, ratio: np.ndarray) -> float:
    """Mean log-likelihood ratio per character."""
    code = CODE[np.frombuffer(string.encode(), np.uint8)]
    return float(ratio[np.concatenate([[0], code[:-1]]), code].mean())


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(ratio: np.ndarray, least: float):
    order = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in _pieces(batch.column(1)):
                base, judged = _suspects(data, at) if len(data) else ([], [])
                base, judged = set(map(int, base)), set(map(int, judged))
                rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "found")}
                for r in range(hi - lo):
                    spans, digest = [], empty
                    if r in base or r in judged:
                        text = data[at[r] : at[r + 1]].tobytes().decode()
                        spans = sorted(base_spans(text), key=lambda x: (x[1], order[x[0]]))
                        digest = hashlib.sha256(_joined(spans).encode()).hexdigest()
                        taken = [(s, e) for _, s, e in spans]
                        if r in judged:
                            for m in STRING.finditer(text):
                                if len(m[0]) >= JUDGED and not any(s <= m.start() and m.end() <= e for s, e in taken) and random_score(m[0], ratio) >= least:
                                    spans.append(("random", m.start(), m.end()))
                            spans.sort(key=lambda x: (x[1], order[x[0]]))
                    kinds = [k for k, _, _ in spans]
                    for k in order:
                        rows[f"n_{k}"].append(kinds.count(k))
                    rows["base_sha256"].append(digest)
                    rows["spans"].append(_joined(spans))
                    rows["found"].append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(rows[f"n_{k}"], pa.int64()) for k in order), pa.array(rows["base_sha256"], pa.string()), pa.array(rows["spans"], pa.string()), pa.array(rows["found"], kind)], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "found"])

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Secrets of every row: counts, ``base_sha256``, ``spans`` and ``found``.

    Base kinds are the fixed patterns ``assign``, ``access`` and ``hex``
    (leftmost, non-overlapping per kind, too short ones dropped). Two
    first-order character models, one of base matches and one of all other
    strings of the texts, then judge each string of 20 or more characters that
    no base span covers whole: kind ``random`` if its mean log-likelihood ratio
    per character is at least ``least``. Spans are code points, end exclusive,
    ordered by start, then kind.

    Null and empty texts have no spans and the digest of the empty string; a
    null id stays null; repeated rows are scanned alike; extra columns are
    ignored; an empty table gives no rows.
    """
    docs = docs_of(docs, id_col, text_col)
    ratio = docs.sparkSession.sparkContext.broadcast(fit_models(docs))

    def run(batches):
        yield from _scan(ratio.value, least)(batches)

    return docs.mapInArrow(run, COLUMNS)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", least: float = 0.7) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one).

    All columns and rows stay; a null text stays null.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit_models(docs_of(docs, id_col, text_col)))
    spot, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in batches:
            column = batch.column(spot)
            texts = column.to_pylist()
            start = 0
            for part in _scan(ratio.value, least)([pa.RecordBatch.from_arrays([pa.array(range(len(column))), column], ["i", "t"])]):
                for k, spans in enumerate(part.column("found").to_pylist()):
                    if spans:
                        texts[start + k] = _cut(texts[start + k], spans, mark)
                start += part.num_rows
            yield batch.set_column(spot, batch.schema.field(spot), pa.array(texts, batch.schema.field(spot).type))

    return docs.mapInArrow(run, schema)


def _cut(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])
