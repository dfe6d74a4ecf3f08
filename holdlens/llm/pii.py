"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels tokens that hold a digit or an at sign: neighbours share a potential, and so do each token
and the next one in the document that is the same, or has the same last digits, however far away. Its weights are fitted by
pseudo-likelihood on tokens that the patterns label; loopy message passing over all tokens of a step of documents gives each token's
label, and labelled tokens that no base span covers become spans as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of personal data in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
#: The label of a token that is none.
OTHER = len(KINDS)
LABELS = OTHER + 1
#: Tokens, and documents, that the weights are fitted on; those with the smallest hashes are taken.
TRAIN_TOKENS, TRAIN_DOCS = 20_000, 4_000
#: Kinds of edges: neighbours, same tokens, tokens with the same last digits.
NEXT, SAME, ALIKE = range(3)
#: Log potential of equal labels that skip edges have before they are fitted: the mean of their ridge penalty.
AGREEMENT = 4.0
#: Digits that make two tokens alike.
LAST_DIGITS = 7
#: Rounds of messages at most, the change that ends them, and the share of the old message that is kept.
ROUNDS, CHANGE, DAMPING = 40, 1e-4, 0.3
#: A span needs a label that is likelier than all others together.
LEAST_P = 0.5
#: Tokens that one step passes messages between.
STEP_TOKENS = 1 << 15

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(digits: str) -> bool:
    """At most 255, however many zeros stand before."""
    x = digits.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign is looked at once, with the run of local characters before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Matches of the two patterns that begin with a digit; where one fails, so it does in the rest of that run of digits."""
    ip_from = card_from = 0
    run = _DIGITS.search(text)
    while run:
        if run.start() >= ip_from and (m := _IP.match(text, run.start())):
            ip_from = m.end()
            yield "ip", m.start(), m.end()
        if run.start() >= card_from and (m := _CARD.match(text, run.start())):
            card_from = m.end()
            yield "card", m.start(), m.end()
        run = _DIGITS.search(text, run.end())


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            yield m.start(), m.end()
        at = text.find("+", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns in code points, by start and kind; every pattern takes time in proportion to the text."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for kind, a, b in _numbers(text):
        if kind == "ip":
            if all(_small(p) for p in text[a:b].split(".")):
                out.append((a, b, 1))
        else:
            digits = re.sub("[ -]", "", text[a:b]) if b - a <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((a, b, 2))
    for a, b in _phones(text):
        if 10 <= sum("0" <= c <= "9" for c in text[a:b]) <= 15:
            out.append((a, b, 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


#: What stands between tokens.
_BLANKS = " \t\n\r\x0b\x0c\xa0\u3000"
_SPACE = re.compile(f"[{_BLANKS}]")
_MARK = re.compile(r"[0-9@]")
_EDGES = "\"'`,;:!?.()[]{}<>*#$%&=|~_^\\/"


@dataclass
class Token:
    """What stands between white space, without the marks around it; ``near``: only white space is before it since the last token."""

    start: int
    end: int
    near: bool
    features: list[str]
    forms: tuple[str, str]


def _word(text: str) -> str:
    return re.sub(r"[^a-z]", "", text.lower())[:12]


def tokens(text: str) -> Iterator[Token]:
    """The tokens of ``text`` that hold a digit or an at sign."""
    end, mark = 0, _MARK.search(text)
    while mark:
        start = max(end, 1 + max(text.rfind(c, end, mark.start()) for c in _BLANKS))
        space = _SPACE.search(text, mark.start())
        stop = space.start() if space else len(text)
        chunk = text[start:stop]
        core = chunk.strip(_EDGES)
        a = start + len(chunk) - len(chunk.lstrip(_EDGES))
        b = a + len(core)
        # one word on either side, from a window that holds any usual word
        before, after = text[max(0, start - 40) : start].split(), text[stop : stop + 40].split()
        digits = re.sub("[^0-9]", "", core)
        shape = re.sub("A{2,}", "A", re.sub("[^\\W\\d_]", "A", re.sub("[0-9]", "9", core)))
        n = len(digits)
        ip = core.split(".")
        features = [
            "bias", f"shape={shape[:24]}", f"kinds={re.sub('9+', '9', shape)[:24]}", f"digits={min(n, 24)}", f"at={core.count('@')}", f"dots={min(core.count('.'), 5)}",
            f"first={chunk[:1] if not chunk[:1].isalnum() else ''}", f"before={_word(before[-1]) if before else ''}", f"after={_word(after[0]) if after else ''}",
            f"check={n}{luhn(digits)}" if 14 <= n <= 19 else "check=", f"parts={len(ip) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in ip)}",
        ]
        same = core.lower() if len(core) > 4 else ""
        yield Token(a, b, end > 0 and not text[end:start].strip(_BLANKS), features, (same, digits[-LAST_DIGITS:] if n >= LAST_DIGITS else ""))
        end = stop
        mark = _MARK.search(text, stop)


def edges_of(found: list[Token], first: int = 0) -> list[tuple[int, int, int]]:
    """(token, token, kind): neighbours, and each token with the next one that is the same or alike; tokens are numbered from ``first``."""
    out, last = [], ({}, {})
    for i, t in enumerate(found, first):
        linked = set()
        if t.near and i > first:
            out.append((i - 1, i, NEXT))
            linked.add(i - 1)
        for kind, form, seen in ((SAME, t.forms[0], last[0]), (ALIKE, t.forms[1], last[1])):
            if form:
                j = seen.get(form)
                if j is not None and j not in linked:
                    out.append((j, i, kind))
                    linked.add(j)
                seen[form] = i
    return out


@dataclass
class Field:
    """Log potentials: ``weights`` of a feature and label, ``pairs`` of two labels for each kind of edge."""

    features: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The rows of ``values`` summed by ``index``."""
    return np.stack([np.bincount(index, column, size) for column in values.T], 1)


def _unary(field: Field, features: list[list[str]]) -> np.ndarray:
    at = [(i, field.features[f]) for i, fs in enumerate(features) for f in fs if f in field.features]
    i, f = np.array(at, np.int64).reshape(-1, 2).T
    return _sums(i, field.weights[f], len(features))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product messages; exact where the graph has no loop and few rounds span it.

    ``edges``: rows (i, j, kind), where ``pairs[kind][label of i, label of j]`` is the log potential.
    """
    belief = unary.copy()
    if len(edges):
        i, j, kind = edges.T
        to, of = np.concatenate((j, i)), np.concatenate((i, j))
        back = np.concatenate((np.arange(len(i)) + len(i), np.arange(len(i))))
        potential = np.concatenate((pairs[kind], pairs[kind].transpose(0, 2, 1)))  # [message, label of `of`, label of `to`]
        sent = np.zeros((len(to), LABELS))
        for _ in range(ROUNDS):
            new = _log_sum((belief[of] - sent[back])[:, :, None] + potential, 1)
            new -= _log_sum(new, 1)[:, None]
            new = DAMPING * sent + (1 - DAMPING) * new
            moved = np.abs(np.exp(new) - np.exp(sent)).max()
            sent = new
            belief = unary + _sums(to, sent, len(unary))
            if moved < CHANGE:
                break
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def fit_field(features: list[list[str]], labels: np.ndarray, edges: np.ndarray, ridge: float = 1.0, steps: int = 300) -> Field:
    """Weights that maximise the pseudo-likelihood: each token's label given its features and its neighbours' labels, with a ridge penalty.

    Pseudo-likelihood tells little of edges whose ends the features explain, so skip edges are drawn to agreement, not to 0.
    """
    names = {f: i for i, f in enumerate(sorted({f for fs in features for f in fs}))}
    field = Field(names, np.zeros((len(names), LABELS)), np.stack([np.zeros((LABELS, LABELS)), *[AGREEMENT * np.eye(LABELS)] * 2]))
    prior = field.pairs.copy()
    if not len(features):
        return field
    row = np.array([i for i, fs in enumerate(features) for _ in fs])
    col = np.array([names[f] for fs in features for f in fs])
    i, j, kind = edges.T if len(edges) else np.zeros((3, 0), np.int64)
    truth = np.eye(LABELS)[labels]
    w, p = field.weights, field.pairs
    vw, vp, mw, mp = np.zeros_like(w), np.zeros_like(p), np.zeros_like(w), np.zeros_like(p)
    for step in range(1, steps + 1):
        score = _sums(row, w[col], len(labels)) + _sums(i, p[kind, :, labels[j]], len(labels)) + _sums(j, p[kind, labels[i], :], len(labels))
        gap = truth - np.exp(score - _log_sum(score, 1)[:, None])
        gw, gp = _sums(col, gap[row], len(w)) - ridge * w, -ridge * (p - prior)
        np.add.at(gp.transpose(0, 2, 1), (kind, labels[j]), gap[i])
        np.add.at(gp, (kind, labels[i]), gap[j])
        for x, g, m, v in ((w, gw, mw, vw), (p, gp, mp, vp)):  # Adam steps that shrink
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.3 / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def base_label(t: Token, spans: list[tuple[int, int, int]]) -> int:
    """The kind of the longest base span that meets the token."""
    met = [(min(b, t.end) - max(a, t.start), -k) for a, b, k in spans if a < t.end and t.start < b]
    return -max(met)[1] if met else OTHER


def _labels(found: list[Token], spans: list[tuple[int, int, int]]) -> list[int]:
    """``base_label`` of each token in one pass; base spans of a document seldom overlap."""
    out, at = [], 0
    for t in found:
        while at < len(spans) and spans[at][1] <= t.start:
            at += 1
        to = at
        while to < len(spans) and spans[to][0] < t.end:
            to += 1
        out.append(base_label(t, spans[at:to]))
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_tokens: int = TRAIN_TOKENS) -> Field:
    """A field fitted on the documents with the smallest hashes among those with a digit or an at sign, as far as their tokens stay within the bound.

    Equal texts count once. Without such documents no feature has a weight, and no span is added.
    """
    text = F.col("text").cast("string")
    chosen = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("hash"))
    edge = chosen.select("hash").distinct().orderBy("hash").limit(train_docs).agg(F.max("hash")).first()[0]

    def run(batches):
        for batch in batches:
            for hash_, x in zip(batch.column("hash").to_pylist(), batch.column("text"), strict=True):
                x = x.as_py()
                found = []
                for t in tokens(x):
                    found.append(t)
                    if len(found) == train_tokens:
                        break
                labels = _labels(found, base_spans(x))
                links = edges_of(found)
                yield pa.record_batch([
                    pa.array([hash_]), pa.array([[t.features for t in found]], pa.list_(pa.list_(pa.string()))), pa.array([labels], pa.list_(pa.int32())),
                    pa.array([[list(e) for e in links]], pa.list_(pa.list_(pa.int64()))),
                ], ["hash", "features", "labels", "edges"])

    features, labels, links = [], [], []
    if edge is not None:
        rows = chosen.where(F.col("hash") <= edge).dropDuplicates(["hash"])
        seen = rows.mapInArrow(run, "hash long, features array<array<string>>, labels array<int>, edges array<array<long>>")
        for r in seen.orderBy("hash").toLocalIterator():
            links += [(a + len(labels), b + len(labels), k) for a, b, k in r.edges]
            features += r.features
            labels += r.labels
            if len(labels) >= train_tokens:
                break
    return fit_field(features, np.array(labels, np.int64), np.array(links, np.int64).reshape(-1, 3))


def added_spans(found: list[Token], p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of labelled tokens that no base span meets; neighbours with one label are one span."""
    out: list[list[int]] = []
    best, last = p.argmax(1), None
    free = [label == OTHER for label in _labels(found, base)]
    for i, t in enumerate(found):
        k = int(best[i])
        if k == OTHER or p[i, k] < LEAST_P or not free[i] or t.end <= t.start:
            continue
        if out and last == i - 1 and t.near and out[-1][2] == k:
            out[-1][1] = t.end
        else:
            out.append([t.start, t.end, k])
        last = i
    return [tuple(x) for x in out]


def scan_texts(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans and added spans of each text; messages pass between the tokens of about ``STEP_TOKENS`` at once, never between texts."""
    out: list[tuple[list, list]] = []
    waiting: list[tuple[int, list[Token]]] = []
    features: list[list[str]] = []
    links: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        out.append((base_spans(text), []))
        if found := list(tokens(text)):
            links += edges_of(found, len(features))
            waiting.append((i, found))
            features += [t.features for t in found]
        if features and (len(features) >= STEP_TOKENS or i == len(texts) - 1):
            p, first = marginals(_unary(field, features), np.array(links, np.int64).reshape(-1, 3), field.pairs), 0
            for row, found in waiting:
                out[row][1].extend(added_spans(found, p[first : first + len(found)], out[row][0]))
                first += len(found)
            waiting, features, links = [], [], []
    return out


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` of each row.

    n_: base spans of each kind; base_sha256: of their joined list; spans: base spans and those that the field adds, in code points of the whole
    text, end exclusive. A null text is as an empty one; rows that repeat have a row each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            rows = scan_texts(shared.value, [x or "" for x in batch.column("text").to_pylist()])
            counts = [[sum(k == n for _, _, k in base) for base, _ in rows] for n in range(len(KINDS))]
            hashes = [sha256(joined(base).encode()).hexdigest() for base, _ in rows]
            spans = [joined(sorted(base + more, key=lambda s: (s[0], s[2]))) for base, more in rows]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array([len(m) for _, m in rows], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
