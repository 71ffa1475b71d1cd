"""Quality rules: line labelling by a linear-chain conditional random field.

A document's lines are marked content or boilerplate by Viterbi decoding of a
two-state linear-chain CRF over line features (length, letter case, digits, signs,
closing punctuation, repetition).  A document is kept when the lines marked content hold at least
``min_share`` of its words, unless the plain rules - too few words, or too many words
inside repeated eight-word windows - have failed it before.

The CRF is trained on weak line labels: the lines of documents whose quality label
is 1 count as content, those of label 0 as boilerplate.  It sees at most
``max_train_docs`` labelled ids, the first in hash order, with one text each and of it the first ``max_train_lines`` lines (a bounded,
documented sample): features are made in parallel, one task runs the gradient
steps (forward-backward, Adam).  Judging reads every whole text once and shuffles nothing.

Defined results: a null or empty text has no words and fails the base rules;
without labels of both kinds the model marks every line content; lines without
a word have no label and take no part; several labels of one id count as the lowest;
repeated rows get equal verdicts; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import training_texts
from .hashing import MULTIPLY, groups, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["base_counts", "line_features", "fit_crf", "viterbi", "train", "judge_documents", "FEATURES"]

FEATURES = (
    "words", "short", "upper", "digits", "symbols", "bang", "other_signs", "closed", "distinct", "adjacent", "word_length", "seen", "signed_words", "bars",
)
# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)), b"0123456789"
_SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_CLASS = np.zeros(256, np.uint8)  # 1 white space, 2 continuation byte, 3 symbol
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[0x80:0xC0] = 2
_CLASS[list(SYMBOLS)] = 3


def _repeated_words(w: np.ndarray, width: int = 8) -> int:
    """Words inside ``width``-word windows that occur twice or more, the first occurrence included; ``w`` are word hashes."""
    n = len(w)
    if n <= width:
        return 0
    h = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h = h * MULTIPLY + w[i : n - width + 1 + i]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(texts: list) -> list[tuple[int, int, int, int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts (UTF-8)."""
    w, _, n_words, _ = words_of(texts)
    bounds, out = np.concatenate([[0], np.cumsum(n_words)]), []
    for i, text in enumerate(texts):
        text = text or b""
        kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4)
        seen, dup = set(), 0
        for line in text.split(b"\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        repeated = _repeated_words(w[bounds[i] : bounds[i + 1]])
        out.append((int(n_words[i]), int(kinds[0] + kinds[3]), int(kinds[3]), dup, repeated))
    return out


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of the lines of ``text`` that have a word; features lie in [0, 1]."""
    rows, counts, seen = [], [], set()
    for line in (text or b"").split(b"\n"):
        tokens = line.split()
        n = len(tokens)
        if not n:
            continue
        size = len(line)
        chars = max(1, size - line.count(b" "))
        upper, lower = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER))
        symbols, bang = size - len(line.translate(None, SYMBOLS)), line.count(b"!")
        signs = size - len(line.translate(None, _SIGNS))
        rows.append((
            min(1.0, n / 40), float(n <= 4), upper / max(1, upper + lower), (size - len(line.translate(None, _DIGITS))) / chars,
            min(1.0, 5 * symbols / chars), min(1.0, 5 * bang / chars), min(1.0, (signs - symbols - bang) / chars),
            float(tokens[-1][-1:] in b".!?:;\"'"), len(set(tokens)) / n,
            sum(a == b for a, b in zip(tokens, tokens[1:])) / n, min(1.0, chars / n / 16), float(line in seen),
            sum(t[-1] in _SIGNS and t[-2:-1] in (b"!", b"#", b"*", b"$", b"%", b"&") for t in tokens) / n,
            min(1.0, 3 * tokens.count(b"|") / n),
        ))
        counts.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(counts, np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best state of each line; ``emit`` is lines x 2, ``move[i, j]`` the score of j after i."""
    n = len(emit)
    back = np.zeros((n, 2), np.int8)
    (m00, m01), (m10, m11) = move.tolist()
    rows = emit.tolist()
    a, b = rows[0]
    for t in range(1, n):
        x0, x1, y0, y1 = a + m00, b + m10, a + m01, b + m11
        back[t] = (x1 > x0, y1 > y0)
        a, b = (x1 if x1 > x0 else x0) + rows[t][0], (y1 if y1 > y0 else y0) + rows[t][1]
    out = np.zeros(n, np.int8)
    out[-1] = b >= a
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t][out[t]]
    return out


def _gradient(x, y, mask, weights, move):
    """Gradient of the mean log likelihood over a batch: x (n, t, f), labels y and mask (n, t)."""
    n, steps, _ = x.shape
    emit = np.stack([np.zeros((n, steps)), x @ weights], axis=2)
    alpha, beta = np.empty((n, steps, 2)), np.zeros((n, steps, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, steps):
        go = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], go, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        on = beta[:, t + 1] + emit[:, t + 1]
        go = np.stack([np.logaddexp(move[i, 0] + on[:, 0], move[i, 1] + on[:, 1]) for i in (0, 1)], axis=1)
        beta[:, t] = np.where(mask[:, t + 1, None], go, beta[:, t + 1])
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * mask
    grad_w = np.einsum("nt,ntf->f", y * mask - p, x)
    grad_m = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            on = mask[:, 1:]
            expected = np.exp(alpha[:, :-1, i] + move[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - total[:, None]) * on
            grad_m[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j)) * on).sum() - expected.sum()
    return grad_w, grad_m


def fit_crf(sequences, steps: int = 120, rate: float = 0.3, l2: float = 1e-4, move_l2: float = 1e-2, chunk: int = 64):
    """(weights, move) from (features, label) per document; the last weight is the bias.

    Long documents are cut into chunks of ``chunk`` lines; chunks of similar length share a padded batch.
    Moves are held small (``move_l2``): the labels are whole documents', which would tie a line to its neighbours."""
    groups: dict[int, list] = {}
    for rows, label in sequences:
        for a in range(0, len(rows), chunk):
            part = rows[a : a + chunk]
            groups.setdefault(1 << (len(part) - 1).bit_length(), []).append((part, label))
    batches, lines = [], 0
    for width, parts in groups.items():
        x, y, mask = np.zeros((len(parts), width, len(FEATURES) + 1)), np.zeros((len(parts), width), int), np.zeros((len(parts), width), bool)
        for i, (part, label) in enumerate(parts):
            x[i, : len(part), :-1], x[i, : len(part), -1], y[i, : len(part)], mask[i, : len(part)] = part, 1.0, label, True
            lines += len(part)
        batches.append((x, y, mask))
    theta = np.zeros(len(FEATURES) + 1 + 4)
    hold = np.append(np.full(len(FEATURES) + 1, l2), np.full(4, move_l2))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = np.zeros_like(theta)
        for x, y, mask in batches:
            w, m = _gradient(x, y, mask, theta[:-4], theta[-4:].reshape(2, 2))
            grad += np.concatenate([w, m.ravel()])
        grad = grad / max(1, lines) - hold * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _feature_task(max_lines):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "label": batch.column("label").cast(pa.int32()), "turn": batch.column("turn"),
                "rows": pa.array([line_features(t)[0][:max_lines].ravel() for t in texts], pa.list_(pa.float64())),
            })

    return run


def _train_task(batches):
    sequences = []
    for pdf in batches:
        sequences += [(np.asarray(r, np.float64).reshape(-1, len(FEATURES)), int(y)) for r, y in zip(pdf["rows"], pdf["label"])]
    sequences = [(r, 1 if y else 0) for r, y in sequences if len(r)]
    if len({y for _, y in sequences}) < 2:
        weights, move = np.append(np.zeros(len(FEATURES)), 1.0), np.zeros((2, 2))  # every line is content
    else:
        weights, move = fit_crf(sequences)
    yield pd.DataFrame({"weights": [weights.tolist()], "move": [move.ravel().tolist()]})


def train(docs: DataFrame, labels: DataFrame, *, max_train_docs: int = 4000, max_train_lines: int = 1000, seed: int = 3):
    """(weights, move) of the CRF from ``labels[doc_id, quality]`` and ``docs[doc_id, text]``."""
    known = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = training_texts(docs, known, max_train_docs, seed)
    made = rows.select("text", "label", "turn").mapInArrow(_feature_task(max_train_lines), "label int, turn bigint, rows array<double>")
    one = made.repartition(1).sortWithinPartitions("turn", "label", F.xxhash64("rows"))
    got = one.mapInPandas(_train_task, "weights array<double>, move array<double>").collect()
    if not got:
        return np.append(np.zeros(len(FEATURES)), 1.0), np.zeros((2, 2))
    return np.array(got[0]["weights"]), np.array(got[0]["move"]).reshape(2, 2)


def _judge_task(model, min_words, max_repeat, min_share):
    def run(batches):
        weights, move = model.value
        for batch, first, texts in groups(batches):
            out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept", "marks")}
            for text, counts in zip(texts, base_counts(texts)):
                rows, words = line_features(text)
                share, marks = 0.0, ""
                if len(rows):
                    emit = np.stack([np.zeros(len(rows)), rows @ weights[:-1] + weights[-1]], axis=1)
                    states = viterbi(emit, move)
                    share = float((words * states).sum() / words.sum())
                    marks = "".join("BC"[s] for s in states)
                failed = counts[0] < min_words or 100 * counts[4] > max_repeat * counts[0]
                for k, v in zip(out, (*counts, failed, share, not failed and share >= min_share, marks)):
                    out[k].append(v)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), **{k: pa.array(v, t) for (k, v), t in zip(out.items(), types)}})

    return run


def judge_documents(
    docs: DataFrame, labels: DataFrame, *, min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5, **settings
) -> DataFrame:
    """Per row of ``docs[doc_id, text]``: the base counts, ``base_failed``, ``content_share``, ``kept``, ``marks``.

    ``marks`` has one letter per line that has a word: C content, B boilerplate.  ``max_repeat`` is a percentage."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **settings))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _judge_task(model, min_words, max_repeat, min_share),
        f"doc_id {id_type}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, content_share double, kept boolean, marks string",
    )
