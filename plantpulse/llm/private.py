"""Private data: four exact patterns, and a linear-chain conditional random field for what they miss.

The model labels words by their shape (which kinds of characters, how many digits and dots, how long), the shapes of
both neighbours, and the labels' transitions. A word without a digit or an at-sign is outside, in training as in
decoding. The model is trained on the driver from the small labelled table (labelled.py, its size is the bound) and
travels with the tasks. Tasks decode Arrow batches in numpy: words that can only be outside cut a text into stretches,
and the Viterbi recursion runs over all stretches of a slice at once; the result is that of the whole sequence.

Spans that overlap a pattern's span are dropped, patterns always stay. Positions are code points, end exclusive.

Defined cases: a null or empty text has no spans. A text is one sequence whatever its length. Repeated rows are judged
alike, each on its own. Input columns stay; a column that has the name of a result is replaced by it. No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from plantpulse.llm import labelled, words

KINDS = labelled.KINDS
BASE_KINDS = KINDS[:4]
LABELS = len(KINDS) + 1  # 0 is outside
# What a labelled stretch must hold to be reported: digits, and characters.
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 13, "phone": 7, "secret": 3}
MOST_DIGITS = {"email": 320, "ip": 12, "card": 19, "phone": 15, "secret": 512}
LEAST_CHARS = {"email": 6, "ip": 7, "card": 13, "phone": 8, "secret": 12}
MOST_CHARS = {"email": 320, "ip": 15, "card": 24, "phone": 24, "secret": 512}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the look-behind only spares restarts within one run of digits, which could not match either
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _card_ok(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and _luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if len(m[0]) >= 16 and _card_ok(m[0])]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def plausible(kind: str, stretch: str) -> bool:
    """Whether a labelled stretch holds what its kind must hold; a number that fails its own check is no private data."""
    digits = "".join(c for c in stretch if c in "0123456789")
    if not LEAST_DIGITS[kind] <= len(digits) <= MOST_DIGITS[kind] or len(stretch) < LEAST_CHARS[kind]:
        return False
    if kind == "card":
        return _luhn(digits)
    if kind == "ip":
        parts = stretch.strip("()[]\"'").split(".")
        return len(parts) == 4 and all(p.isdecimal() and int(p) <= 255 for p in parts)
    return kind != "email" or "@" in stretch[1:]


# Character classes of a shape, one bit each.
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "@", ".", "-", "+", "()", ":/", "=", "_%",
            "\"'#$&*!?,;<>[]{}|\\^`~")
_BITS = np.zeros(256, np.uint16)
for _k, _chars in enumerate(_CLASSES):
    _BITS[list(_chars.encode())] = 1 << _k
_BITS[128:] = 1 << len(_CLASSES)
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?#$%&*")] = True
_DIGIT_STEPS, _CHAR_STEPS = np.array([1, 2, 3, 4, 5, 8, 13, 17]), np.array([2, 4, 8, 13, 20, 40])
_DOT_LEVELS = 5
SHAPES = 1 << 12


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coarse shape, full shape, end without closing punctuation) of every word."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    ends = ends.copy()
    for _ in range(6):
        loose = (ends - starts > 1) & _TAIL[data[ends - 1]]
        ends[loose] -= 1
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, np.minimum(ends, len(data) - 1)
    mask = np.bitwise_or.reduceat(_BITS[data], edges)[0::2]
    at_end = ends == len(data)  # reduceat cannot end behind the last byte
    mask[at_end] |= _BITS[data[-1]]
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 48) & (data <= 57)).astype(np.int64) + ((data == 46).astype(np.int64) << 32), out=count[1:])
    both = count[ends] - count[starts]
    digits, dots = both & 0xFFFFFFFF, both >> 32
    full = ((np.searchsorted(_DIGIT_STEPS, digits, "right") * _DOT_LEVELS + np.minimum(dots, _DOT_LEVELS - 1)) * 7
            + np.searchsorted(_CHAR_STEPS, ends - starts, "right"))
    coarse = mask.astype(np.int64)
    mixed = words.mix((coarse * 1024 + full).astype(np.uint64)) & np.uint64(SHAPES - 1)
    return coarse, mixed.astype(np.int64), ends


@dataclass
class Model:
    coarse: np.ndarray  # class mask -> label scores
    shape: np.ndarray  # shape -> label scores
    before: np.ndarray  # class mask of the word before -> label scores
    after: np.ndarray
    moves: np.ndarray  # label -> next label


# One more than the last class mask: stands before the first and after the last word.
_MASKS = 1 << (len(_CLASSES) + 1)
# Class masks of words that may be part of private data: those with a digit or an at-sign.
_OPEN = (np.arange(_MASKS + 1) & 12 != 0) & (np.arange(_MASKS + 1) < _MASKS)


def _line_arrays(text: str):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = words.bounds(words.SPACED[data], np.zeros(1, np.int64))
    return shapes(data, starts, ends)


def train(lines: list[str] | None = None, rounds: int = 300, rate: float = 0.5, decay: float = 2e-3) -> Model:
    """Maximum likelihood by AdaGrad over all lines at once; the gradient comes from the forward-backward sums."""
    parsed = [labelled.parse(x) for x in (labelled.LINES if lines is None else lines)]
    longest, n = max(map(len, parsed)), len(parsed)
    coarse = np.full((n, longest + 2), _MASKS)
    shape = np.full((n, longest), SHAPES)
    gold, used = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for r, line in enumerate(parsed):
        c, s, _ = _line_arrays(" ".join(w for w, _ in line))
        k = len(line)
        coarse[r, 1:k + 1], shape[r, :k], used[r, :k] = c, s, True
        gold[r, :k] = [KINDS.index(x) + 1 if x else 0 for _, x in line]
    tables = [np.zeros((_MASKS + 1, LABELS)), np.zeros((SHAPES + 1, LABELS)), np.zeros((_MASKS + 1, LABELS)),
              np.zeros((_MASKS + 1, LABELS)), np.zeros((LABELS, LABELS))]
    seen = [np.full(t.shape, 1e-6) for t in tables]
    index = [coarse[:, 1:-1], shape, coarse[:, :-2], coarse[:, 2:]]
    one = np.eye(LABELS)[gold] * used[..., None]
    pairs = used[:, 1:] & used[:, :-1]
    gold_moves = np.einsum("rti,rtj->ij", one[:, :-1] * pairs[..., None], one[:, 1:])
    barred = np.where(_OPEN[index[0]], 0.0, -1e4)[..., None] * (np.arange(LABELS) > 0)
    for _ in range(rounds):
        score = sum(t[i] for t, i in zip(tables, index)) + barred
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + tables[4], axis=1) + score[:, t]
            forward[:, t] = np.where(used[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(tables[4] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(used[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        node = np.exp(forward + backward - total) * used[..., None]
        edge = np.exp(forward[:, :-1, :, None] + tables[4] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None])
        gradients = []
        for table, at in zip(tables[:4], index):
            g = np.zeros_like(table)
            np.add.at(g, at[used], (one - node)[used])
            gradients.append(g)
        gradients.append(gold_moves - (edge * pairs[..., None, None]).sum((0, 1)))
        for table, g, s in zip(tables, gradients, seen):
            g -= decay * n * table
            s += g * g
            table += rate * g / np.sqrt(s)
    return Model(*tables)


def decode(model: Model, coarse: np.ndarray, shape: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The best label of every word; a row is one sequence."""
    labels = np.zeros(len(coarse), np.int8)
    open_words = np.flatnonzero(_OPEN[coarse])
    if not len(open_words):
        return labels
    new = np.ones(len(open_words), bool)
    new[1:] = (np.diff(open_words) > 1) | (rows[open_words[1:]] != rows[open_words[:-1]])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(open_words)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    w = open_words
    same_before = (w > 0) & (rows[np.maximum(w - 1, 0)] == rows[w])
    same_after = (w < len(rows) - 1) & (rows[np.minimum(w + 1, len(rows) - 1)] == rows[w])
    before = np.where(same_before, coarse[np.maximum(w - 1, 0)], _MASKS)
    after = np.where(same_after, coarse[np.minimum(w + 1, len(rows) - 1)], _MASKS)
    score = model.coarse[coarse[w]] + model.shape[shape[w]] + model.before[before] + model.after[after]
    # a stretch lies between words that are outside, or begins or ends its row
    best = score[first] + np.where(same_before[first], 1, 0)[:, None] * model.moves[0]
    back = np.zeros((len(w), LABELS), np.int8)
    final = np.zeros((len(first), LABELS))
    for t in range(int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))  # stretches longer than t
        if t:
            ways = best[:live, :, None] + model.moves
            back[first[:live] + t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + score[first[:live] + t]
        ended = length[:live] == t + 1
        final[:live][ended] = best[:live][ended]
    goes_on = same_after[first + length - 1]
    label = (final + goes_on[:, None] * model.moves[:, 0]).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = length > t
        at = first[live] + t
        labels[w[at]] = label[live]
        label[live] = back[at, label[live]] if t else label[live]
    return labels


def _model_spans(model: Model, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (kind, start byte, end byte) within the row, of every labelled stretch that holds enough."""
    if not len(data):
        return {}
    starts, ends = words.bounds(words.SPACED[data], offsets[:-1])
    rows = np.searchsorted(offsets[1:], starts, "right")
    coarse, shape, ends = shapes(data, starts, ends)
    labels = decode(model, coarse, shape, rows)
    hit = np.flatnonzero(labels)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(hit):
        return out
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (rows[hit[1:]] != rows[hit[:-1]])
    begin = np.flatnonzero(new)
    for i, j in zip(begin, np.append(begin[1:], len(hit)) - 1):
        row, kind, low, high = int(rows[hit[i]]), int(labels[hit[i]]) - 1, int(starts[hit[i]]), int(ends[hit[j]])
        if high - low <= MOST_CHARS[KINDS[kind]] and plausible(KINDS[kind], bytes(data[low:high]).decode("utf-8", "replace")):
            base = int(offsets[row])
            out.setdefault(row, []).append((kind, low - base, high - base))
    return out


def find(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """The input with base_spans and spans, arrays of (kind, start, end) by kind and start."""
    span = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                                 StructField("end", IntegerType())]))
    kept = [c for c in df.columns if c.lower() not in ("base_spans", "spans")]
    shared = df.sparkSession.sparkContext.broadcast(model or train())
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            column = batch.column("__text")
            base_out, all_out = [], []
            for first, data, offsets in words.slices(batch, "__text"):
                found = _model_spans(crf, data, offsets)
                telling = np.add.reduceat(np.append(((data >= 48) & (data <= 57)) | (data == 64), False).astype(np.int64),
                                          offsets[:-1]) * (np.diff(offsets) > 0)
                for r in range(len(offsets) - 1):
                    base, more = [], []
                    if telling[r]:
                        base = base_spans(column[first + r].as_py())
                    if r in found:
                        body = data[offsets[r]:offsets[r + 1]]
                        points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                        more = [(k, int(points[s]), int(points[e])) for k, s, e in found[r]]
                        taken = sorted((s, e) for _, s, e in base)
                        more = [m for m in more if not _overlaps(taken, m[1], m[2])]
                    base_out.append([_named(x) for x in base])
                    all_out.append([_named(x) for x in sorted(base + more)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept_names], pa.array(base_out, arrow), pa.array(all_out, arrow)],
                [*kept_names, "base_spans", "spans"])

    inner = df.select(F.struct(*kept).alias("__row"), F.col(text).alias("__text")) if kept else df.select(
        F.col(text).alias("__text"))
    kept_names = ["__row"] if kept else []
    schema = StructType([*[f for f in inner.schema.fields if f.name == "__row"],
                         StructField("base_spans", span), StructField("spans", span)])
    out = inner.mapInArrow(search, schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in kept], "base_spans", "spans")


def _named(span: tuple[int, int, int]) -> dict:
    return {"kind": KINDS[span[0]], "start": span[1], "end": span[2]}


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in taken)


def joined(spans: str):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast(
        "string"))), ",")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def query(spark, folder: str) -> DataFrame:
    out = find(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *[_count("base_spans", k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"),
                      joined("spans").alias("spans"))
