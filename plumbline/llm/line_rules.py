"""Quality rules by labelling lines: a linear-chain conditional random field marks each line as content or boilerplate.

Features describe a line's words, symbols, repetition and place; Viterbi decoding finds a text's best sequence of
labels; the share of words on content lines decides whether the text stays. Weights are learned from labelled texts by
maximum likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrays import MULT, bounds, chunks, mix, windows, words
from plumbline.llm.common import prefilter
from plumbline.plans.lineage import materialize

CONTENT, BOILERPLATE = 0, 1
SYMBOLS = b"#*$%&|<>"
WIDTH = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT = 0.5
# Labelled texts to learn from, and lines of each, from a hashed position on: training windows of a bounded sample.
TRAIN_TEXTS = 3000
TRAIN_LINES = 64
FEATURES = (
    "bias", "log_words", "symbols", "capitals", "digits", "exclamations", "word_length", "sentence_end", "repeated_line",
    "repeated_words", "short", "first",
)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text and features per line with a word, for one slice of texts."""
    rows = len(offsets) - 1
    h, row, begin, end = words(data, offsets, lower=False)
    newline = np.zeros(256, bool)
    newline[10] = True
    separator = np.zeros(256, bool)
    separator[[32, *range(9, 14)]] = True
    lh, lrow, lbegin, lend = words(data, offsets, lower=False, separator=newline)

    def running(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=out[1:])
        return out

    def table(chars: bytes) -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(chars)] = True
        return out

    char = running(((data & 0xC0) != 0x80) & ~separator[data])
    symbol = running(table(SYMBOLS)[data])
    upper = running(table(bytes(range(65, 91)))[data])
    letter = running(table(bytes([*range(65, 91), *range(97, 123)]))[data])
    digit = running(table(b"0123456789")[data])
    bang = running(table(b"!")[data])
    between = lambda c, a, b: c[b] - c[a]

    # Words inside windows of five that occur twice or more in their text.
    wh, at = windows(h, row, WIDTH)
    marked = np.zeros(len(h) + WIDTH, np.int32)
    if len(wh):
        with np.errstate(over="ignore"):
            keyed = wh ^ (row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keyed, kind="stable")
        ordered = keyed[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(ordered), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(marked, hit, 1)
        np.add.at(marked, hit + WIDTH, -1)
    repeated = running_sum(np.cumsum(marked[: len(h)]) > 0)

    # Lines with a word, and those equal to an earlier one of their text.
    first_word = np.searchsorted(begin, lbegin)
    last_word = np.searchsorted(begin, lend)
    kept = last_word > first_word
    lh, lrow, lbegin, lend, first_word, last_word = (x[kept] for x in (lh, lrow, lbegin, lend, first_word, last_word))
    with np.errstate(over="ignore"):
        keyed = lh ^ (lrow.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keyed, kind="stable")
    again = np.zeros(len(lh), bool)
    again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]

    edge, ledge = bounds(row, rows), bounds(lrow, rows)
    n_words = last_word - first_word
    chars = np.maximum(between(char, lbegin, lend), 1)
    letters = np.maximum(between(letter, lbegin, lend), 1)
    tail = data[end[last_word - 1] - 1] if len(lh) else np.zeros(0, np.uint8)
    features = np.stack(
        [
            np.ones(len(lh)),
            np.log1p(n_words) / 4,
            np.minimum(between(symbol, lbegin, lend) / chars * 4, 1),
            between(upper, lbegin, lend) / letters,
            between(digit, lbegin, lend) / chars,
            np.minimum(between(bang, lbegin, lend) / n_words, 1),
            np.minimum(chars / n_words / 10, 2),
            table(b".!?:;")[tail],
            again,
            between(repeated, first_word, last_word) / n_words,
            n_words < 3,
            np.r_[True, lrow[1:] != lrow[:-1]] if len(lh) else np.zeros(0),
        ],
        axis=1,
    ).astype(np.float64)
    lines_again = running_sum(again)
    return {
        "n_words": np.diff(edge),
        "word_chars": between(char, offsets[:-1], offsets[1:]),
        "n_symbols": between(symbol, offsets[:-1], offsets[1:]),
        "n_dup_lines": between(lines_again, ledge[:-1], ledge[1:]),
        "n_repeat_words": between(repeated, edge[:-1], edge[1:]),
        "features": features,
        "line_hash": lh,
        "line_edge": ledge,
        "line_words": n_words,
        "line_begin": lbegin,
        "line_end": lend,
    }


def running_sum(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def viterbi(state: np.ndarray, step: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Best labels of all lines; ``state`` [lines, 2] and ``step`` [2, 2] are log weights, ties go to content."""
    labels = np.zeros(len(state), np.int8)
    (s00, s01), (s10, s11) = step.tolist()
    score = state.tolist()
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if a == b:
            continue
        x, y = score[a]
        back = []
        for i in range(a + 1, b):
            from_x, from_y = x + s01 > y + s11, x + s00 >= y + s10
            back.append((0 if from_y else 1, 0 if from_x else 1))
            x, y = (x + s00 if from_y else y + s10) + score[i][0], (x + s01 if from_x else y + s11) + score[i][1]
        last = 0 if x >= y else 1
        for i in range(b - 1, a, -1):
            labels[i] = last
            last = back[i - a - 1][last]
        labels[a] = last
    return labels


def fit(features: np.ndarray, labels: np.ndarray, mask: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``[features, 2]`` and transitions ``[2, 2]`` of most likelihood, by gradient ascent with adaptive steps.

    ``features`` [texts, lines, features], ``labels`` and ``mask`` [texts, lines]: windows of equal length, padded.
    Forward and backward sums run over all texts at once.
    """
    n, length, width = features.shape
    theta = np.zeros((width, 2))
    step = np.zeros((2, 2))
    moments = [np.zeros((2, *x.shape)) for x in (theta, step)]
    gold = np.eye(2)[labels] * mask[..., None]
    pairs = mask[:, 1:] * mask[:, :-1]
    gold_pairs = np.einsum("ntp,ntq->pq", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    lines = max(mask.sum(), 1)
    for r in range(1, rounds + 1):
        state = features @ theta * mask[..., None]
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = state[:, 0]
        for t in range(1, length):
            new = np.logaddexp(forward[:, t - 1, :1] + step[0], forward[:, t - 1, 1:] + step[1]) + state[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            ahead = state[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, new, backward[:, t + 1])
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        belief = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        joint = forward[:, :-1, :, None] + step + (state + backward)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * pairs[..., None, None]).sum((0, 1))
        for x, m, g in (
            (theta, moments[0], np.einsum("ntf,ntp->fp", features, gold - belief) / lines - ridge * theta),
            (step, moments[1], (gold_pairs - expected) / lines - ridge * step),
        ):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += 0.2 * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-8)
    return theta, step


# Used where no text is labelled: symbols, capitals, exclamations and repetition speak for boilerplate.
PRIOR = np.zeros((len(FEATURES), 2))
PRIOR[:, BOILERPLATE] = [-3.0, 0.0, 4.0, 3.0, 1.0, 4.0, 0.0, -0.5, 3.0, 4.0, 0.5, 0.0]
PRIOR_STEP = np.array([[0.5, -0.5], [-0.5, 0.5]])


def window(hashes: np.ndarray, at: int) -> tuple[int, int]:
    """First and end line of a text's training window; its lines, with these ``hashes``, begin at ``at``."""
    n = len(hashes)
    if n <= TRAIN_LINES:
        return at, at + n
    with np.errstate(over="ignore"):
        point = int(mix(np.array([np.bitwise_xor.reduce(mix(hashes ^ np.uint64(MULT)))]))[0])
    start = point % (n + TRAIN_LINES - 1) - TRAIN_LINES + 1
    return at + max(start, 0), at + min(start + TRAIN_LINES, n)


def learn(docs: DataFrame, quality: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most about ``TRAIN_TEXTS`` labelled texts of each class, drawn by a hash of their id.

    ``quality`` holds ``doc_id, quality``. Of each a window of ``TRAIN_LINES`` lines is learned that begins at a hashed
    position, so that every line of a text is as likely in it. Lines of good texts are content; lines of bad texts are
    boilerplate unless a good text of the sample has the same line anywhere. Ids labelled both ways and null ids are
    left out; of an id's texts that with the smallest hash is learned, so reruns learn the same. Without labels of both
    classes the prior weights are returned.
    """
    sure = quality.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id")
    sure = sure.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    sizes = sure.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(TRAIN_TEXTS)) / F.col("n"))
    drawn = sure.join(sizes, "quality").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    drawn = materialize(drawn.select("doc_id", "quality"), "drawn")
    # Texts that aren't drawn stay out of the shuffle.
    rows = prefilter(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), F.col("doc_id"), drawn, F.col("doc_id")).join(drawn, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").cast("long").alias("quality"))
    rows = materialize(rows.select("text", "quality"), "training")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes, bytes]] = []
            quality = batch.column(1).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(0)):
                m = measure(data, offsets)
                for r in range(hi - lo):
                    a, b = m["line_edge"][r], m["line_edge"][r + 1]
                    if b > a:
                        a, b = window(m["line_hash"][a:b], a)
                        out.append((quality[lo + r], m["features"][a:b].tobytes(), m["line_hash"][a:b].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["quality", "features", "hashes"]
            )

    found = rows.mapInArrow(run, "quality long, features binary, hashes binary").collect()
    if len({q for q, _, _ in found}) < 2:
        return PRIOR, PRIOR_STEP
    found = sorted(tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, f)) for f in found)
    # Of all lines of good texts those that are asked for, whose number the windows bound.
    asked = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for q, _, h in found if q == 0]))
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.intersect1d(measure(data, offsets)["line_hash"], shared.value) for _, _, data, offsets in chunks(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *held])).view(np.int64))], names=["h"])

    same = rows.where("quality = 1").mapInArrow(lines, "h long").distinct().collect()
    good = {h & 0xFFFFFFFFFFFFFFFF for (h,) in same}
    features = np.zeros((len(found), TRAIN_LINES, len(FEATURES)), np.float32)
    labels, mask = np.zeros((len(found), TRAIN_LINES), np.int8), np.zeros((len(found), TRAIN_LINES), np.float32)
    for i, (q, f, h) in enumerate(found):
        own = np.frombuffer(f).reshape(-1, len(FEATURES))
        features[i, : len(own)], mask[i, : len(own)] = own, 1
        if q == 0:
            labels[i, : len(own)] = [BOILERPLATE if x not in good else CONTENT for x in np.frombuffer(h, np.uint64).tolist()]
    return fit(features, labels, mask)


def judge(
    docs: DataFrame,
    weights: tuple[np.ndarray, np.ndarray],
    doc_id: str = "doc_id",
    text: str = "text",
    min_content: float = MIN_CONTENT,
    with_content: bool = False,
) -> DataFrame:
    """Per row ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share``.

    ``with_content`` adds ``content``, the content lines joined by line feeds. A text fails the base rules with fewer
    than ``MIN_WORDS`` words or more than ``MAX_REPEAT_PERCENT`` percent of words in repeated windows. A null or empty
    text has no words and is not kept; its share is 0. Rows are independent, so repeated rows get equal results and
    null ids stay null; other columns are not read.
    """
    theta, step = weights
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                m = measure(data, offsets)
                edge = m["line_edge"]
                labels = viterbi(m["features"] @ theta, step, edge)
                own = running_sum(np.where(labels == CONTENT, m["line_words"], 0))
                n = m["n_words"]
                share = (own[edge[1:]] - own[edge[:-1]]) / np.maximum(n, 1)
                failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                columns = [pa.array(m[c].astype(np.int64)) for c in names]
                columns += [pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)]
                if with_content:
                    spans = list(zip(m["line_begin"].tolist(), m["line_end"].tolist(), labels.tolist(), strict=True))
                    raw = data.tobytes()
                    kept = [b"\n".join(raw[s:e] for s, e, l in spans[a:b] if l == CONTENT).decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    columns.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=out_names)

    out = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double"
    out += ", content string" if with_content else ""
    out_names = [x.split()[0] for x in out.split(", ")]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)
