"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Nodes are the tokens that could be part of an entity (they hold a digit or an @); all other
tokens are outside. Neighbouring nodes and distant repeated or similar nodes share potentials;
loopy message passing brings their labels into line across the whole document. Weights and
potentials are learned together from the base spans of all documents, by tempered pseudo-likelihood: each
node's label given those of the nodes that share a potential with it, once with and once without
the node's own features, so that potentials have to explain labels that features don't.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns of the base spans.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Rounds of message passing, damping, and the least belief from which a node is labelled.
ROUNDS, DAMPING, BELIEF = 10, 0.3, 0.6
#: One base span in so many is hidden to measure the field, and the precision that the belief from which nodes are labelled has to reach there.
HIDE, PRECISION = 5, 0.95
#: Newton steps of training, the largest change of a parameter in a step, the weight of squared distances from the prior,
#: and the prior potential of two repeated or similar nodes with the same label (all else: 0).
STEPS, STRIDE, RIDGE, AGREE = 8, 2.0, 1e-2, 2.0

_HINT = re.compile(r"[0-9@]")
#: No address of four numbers begins inside a run of digits; to say so keeps long runs linear.
_IP = re.compile("(?<![0-9])" + PATTERNS["ip"].pattern)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACE = set(" \t\n\x0b\x0c\r")
_EDGES = ".,;:!?\"'<>[]{}|#$%&*=/\\"
_NOT_ALNUM = re.compile(r"[^0-9a-z]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, begun at each @ and its run before: linear in the text however long its runs are."""
    out, done = [], 0
    while (at := text.find("@", done)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = PATTERNS["email"].match(text, start) if start < at else None
        if m:
            out.append(m.span())
        done = m.end() if m else at + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kind and start; failing matches are dropped without another try."""
    out = []
    if not _HINT.search(text):
        return out
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in PATTERNS["card"].finditer(text):
        d = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PATTERNS["phone"].finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def nodes_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens (parted by ASCII white space) that hold a digit or an @."""
    out, at, n = [], 0, len(text)
    while m := _HINT.search(text, at):
        start = end = m.start()
        while start > 0 and text[start - 1] not in _SPACE:
            start -= 1
        while end < n and text[end] not in _SPACE:
            end += 1
        out.append((start, end))
        at = end
    return out


def features(text: str, nodes: list[tuple[int, int]]) -> list[int]:
    """A bit mask for each node: what the token is made of, and its neighbours."""
    out = []
    for n, (a, b) in enumerate(nodes):
        t = text[a:b].strip(_EDGES)
        d = _NOT_DIGIT.sub("", t)
        letters = any(ch.isalpha() for ch in t)
        marks = [
            "@" in t,
            t.startswith("+"),
            "(" in t or ")" in t,
            "-" in t,
            t.count(".") == 3 and not letters,
            "." in t,
            letters,
            len(d) <= 3,
            4 <= len(d) <= 7,
            8 <= len(d) <= 15,
            16 <= len(d) <= 19,
            len(d) > 19,
            len(d) >= 16 and luhn(d),
            n > 0 and text[nodes[n - 1][1] : a].isspace(),
            n + 1 < len(nodes) and text[b : nodes[n + 1][0]].isspace(),
        ]
        out.append(sum(1 << i for i, m in enumerate(marks) if m))
    return out


N_FEATURES, N_LABELS = 15, 5  # label 0: outside


def edges_of(text: str, nodes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(node, node, type): 0 neighbours, 1 repeated, 2 similar (the same last seven digits); each with the one before it."""
    out, same, like = [], {}, {}
    for n, (a, b) in enumerate(nodes):
        if n and text[nodes[n - 1][1] : a].isspace():
            out.append((n - 1, n, 0))
        key = _NOT_ALNUM.sub("", text[a:b].lower())
        digits = _NOT_DIGIT.sub("", key)
        if len(key) >= 3:
            if key in same:
                out.append((same[key], n, 1))
            same[key] = n
        if len(digits) >= 7:
            if digits[-7:] in like and like[digits[-7:]][1] != key:
                out.append((like[digits[-7:]][0], n, 2))
            like[digits[-7:]] = (n, key)
    return out


def _labels(nodes: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each node: the first kind of span that it touches; nodes are in order and apart."""
    out = [0] * len(nodes)
    for kind, a, b in spans:
        n = bisect_right(nodes, a, key=lambda node: node[1])
        while n < len(nodes) and nodes[n][0] < b:
            out[n] = out[n] or kind + 1
            n += 1
    return out


@dataclass
class Field:
    """weights [features + 1, labels] and a log potential for each type of edge [3, labels, labels]."""

    weights: np.ndarray
    pairs: np.ndarray
    #: From which belief a node is labelled, and how hidden labels were found with it.
    belief: float = BELIEF
    recall: float = 0.0
    precision: float = 1.0


def fit(docs: DataFrame, text: str = "text") -> Field:
    """The field that makes the base spans of all documents most likely, node by node (see the module's text), and the belief that hidden labels ask for.

    Nodes that agree in features, label and neighbours' labels are counted in Spark; Newton steps
    run over the counted table, and a step brings the driver one row for each pair of parameters.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                nodes = nodes_of(t)
                got.update(_cases(features(t, nodes), _labels(nodes, base_spans(t)), edges_of(t, nodes)))
        if got:
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["mask", "y", "near", "n"])

    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    counts = rows.mapInPandas(count, "mask int, y int, near binary, n long").groupBy("mask", "y", "near").agg(F.sum("n").alias("n"))
    table, theta = materialise(counts, "field-cases"), prior()
    for _ in range(STEPS):
        now = theta

        def slopes(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(N_PARAMS * (N_PARAMS + 1))
            for pdf in batches:
                total += _slopes(now, pdf["mask"].to_numpy(), pdf["y"].to_numpy(), list(pdf["near"]), pdf["n"].to_numpy())
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        summed = table.mapInPandas(slopes, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(N_PARAMS * (N_PARAMS + 1))
        total[summed["i"].to_numpy()] = summed["v"].to_numpy()
        theta = newton_step(theta, total)
    field = field_of(theta)
    hidden = hidden_labels(docs, field, text).toPandas()  # a row for each hundredth at most
    field.belief, field.recall, field.precision = choose_belief(hidden)
    return field


N_PARAMS = (N_FEATURES + 1) * N_LABELS + 3 * N_LABELS * N_LABELS


def prior() -> np.ndarray:
    """Parameters before any text is seen: repeated and similar nodes tend to agree."""
    pairs = np.zeros((3, N_LABELS, N_LABELS))
    pairs[1:] = AGREE * np.eye(N_LABELS)
    return np.concatenate([np.zeros((N_FEATURES + 1) * N_LABELS), pairs.ravel()])


def field_of(theta: np.ndarray) -> Field:
    cut = (N_FEATURES + 1) * N_LABELS
    return Field(theta[:cut].reshape(N_FEATURES + 1, N_LABELS), theta[cut:].reshape(3, N_LABELS, N_LABELS))


def _cases(masks: list[int], y: list[int], edges: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(mask, label, neighbours' labels) of each node with a known label.

    A token outside base spans that repeats one inside is unlabelled, not outside. Neighbours'
    labels: how many edges of each type come in from, and then go out to, each label, 255 at most.
    """
    unsure = {n for i, j, kind in edges if kind for n, m in ((i, j), (j, i)) if not y[n] and y[m]}
    near = np.zeros((len(masks), 2, 3, N_LABELS), np.int64)
    for i, j, kind in edges:
        if i not in unsure and j not in unsure:
            near[j, 0, kind, y[i]] += 1
            near[i, 1, kind, y[j]] += 1
    near = np.minimum(near, 255).astype(np.uint8)
    return ((masks[n], y[n], near[n].tobytes()) for n in range(len(masks)) if n not in unsure)


def _slopes(theta: np.ndarray, masks: np.ndarray, y: np.ndarray, near: list[bytes], n: np.ndarray) -> np.ndarray:
    """Gradient, then second derivatives, of the cases' negative log pseudo-likelihood, tempered: a case that n nodes share counts log(1 + n).

    Plain tokens outside outnumber entities by far; at full weight their features drown what repeated tokens say of each other.
    """
    if not len(masks):
        return np.zeros(N_PARAMS * (N_PARAMS + 1))
    bits = (masks[:, None] >> np.arange(N_FEATURES)) & 1
    x = np.concatenate([np.ones((len(masks), 1)), bits], axis=1)
    bare = np.concatenate([np.ones((len(masks), 1)), np.zeros_like(bits)], axis=1)
    x, y, weight = np.concatenate([x, bare]), np.concatenate([y, y]), np.tile(np.log1p(n), 2)
    labels = np.frombuffer(b"".join(near), np.uint8).reshape(len(masks), 2, 3, N_LABELS)
    labels = np.concatenate([labels, labels]).astype(float)
    f = np.zeros((len(x), N_LABELS, N_PARAMS))  # what each label would add to each parameter
    cut = (N_FEATURES + 1) * N_LABELS
    for c in range(N_LABELS):
        f[:, c, np.arange(N_FEATURES + 1) * N_LABELS + c] = x
        pair = f[:, c, cut:].reshape(len(x), 3, N_LABELS, N_LABELS)
        pair[:, :, :, c] += labels[:, 0]
        pair[:, :, c, :] += labels[:, 1]
        f[:, c, cut:] = pair.reshape(len(x), -1)
    s = f @ theta
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    mean = np.einsum("rc,rcp->rp", p, f)
    gradient = ((mean - f[np.arange(len(x)), y]) * weight[:, None]).sum(0)
    apart = (f - mean[:, None]) * np.sqrt(p * weight[:, None])[:, :, None]
    apart = apart.reshape(-1, N_PARAMS)
    return np.concatenate([gradient, (apart.T @ apart).ravel()])


def newton_step(theta: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """A step down the summed slopes and the pull of the prior, held within STRIDE."""
    gradient = slopes[:N_PARAMS] + RIDGE * (theta - prior())
    curve = slopes[N_PARAMS:].reshape(N_PARAMS, N_PARAMS) + RIDGE * np.eye(N_PARAMS)
    step = np.linalg.solve(curve, gradient)
    return theta - step * min(1.0, STRIDE / max(np.abs(step).max(), 1e-12))


def beliefs(field: Field, masks: list[int], edges: list[tuple[int, int, int]], clamp: list[int]) -> np.ndarray:
    """Loopy sum-product beliefs [nodes, labels]; ``clamp``: labels of nodes that base spans fix (0: free)."""
    x = np.array([[1, *((m >> i) & 1 for i in range(N_FEATURES))] for m in masks], float)
    unary = x @ field.weights
    fixed = np.array(clamp)
    unary[fixed > 0] = -30
    unary[fixed > 0, fixed[fixed > 0]] = 0
    unary -= unary.max(1, keepdims=True)
    total = unary
    if edges:
        e = np.array(edges)
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        pot = np.concatenate([field.pairs[e[:, 2]], field.pairs[e[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        msg = np.zeros((len(src), N_LABELS))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = (np.log(np.exp(out - top).sum(1, keepdims=True)) + top)[:, 0]
            new -= new.max(1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        total = unary.copy()
        np.add.at(total, dst, msg)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _judged(text: str, field: Field) -> Iterator[tuple[int, int]]:
    """(belief in hundredths, outcome) of the nodes of a text whose label is hidden or free: 1 found, 2 another kind or no entity, 0 hidden and not seen.

    One base span in HIDE, by a hash of its text and place, gives up its labels. Of the other nodes
    those count that neither are in a base span nor repeat one.
    """
    base, nodes = base_spans(text), nodes_of(text)
    if not nodes:
        return
    gone = {k for k, (kind, a, b) in enumerate(base) if zlib.crc32(f"{kind}:{a}:{text[a:b]}".encode()) % HIDE == 0}
    true, clamp = _labels(nodes, base), _labels(nodes, [x for k, x in enumerate(base) if k not in gone])
    edges = edges_of(text, nodes)
    unsure = {n for i, j, kind in edges if kind for n, m in ((i, j), (j, i)) if not true[n] and true[m]}
    p = beliefs(field, features(text, nodes), edges, clamp)
    for n in range(len(nodes)):
        if clamp[n] or n in unsure:
            continue
        label = int(p[n].argmax())
        if label:
            yield int(100 * p[n, label]), 1 if label == true[n] else 2
        elif true[n]:
            yield 0, 0


def hidden_labels(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """(belief, found, wrong): the field against labels that it doesn't see, by belief in hundredths; ``missed`` nodes have none."""
    bounded_batches(docs.sparkSession)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                got.update(_judged(t, field))
        yield pd.DataFrame([(b, o, n) for (b, o), n in got.items()], columns=["belief", "outcome", "n"])

    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    of = lambda k: F.sum(F.when(F.col("outcome") == k, F.col("n")).otherwise(0)).cast("long")
    return rows.mapInPandas(judge, "belief int, outcome int, n long").groupBy("belief").agg(of(1).alias("found"), of(2).alias("wrong"), of(0).alias("missed"))


def choose_belief(hidden: pd.DataFrame, precision: float = PRECISION) -> tuple[float, float, float]:
    """(belief, recall, precision): the least belief of BELIEF or more at which hidden labels are found with that precision; nothing is labelled if there is none."""
    every, least = int(hidden["found"].sum() + hidden["missed"].sum()), int(round(100 * BELIEF))
    for t in sorted({least, *(int(b) for b in hidden["belief"] if b > least)}):
        at = hidden[hidden["belief"] >= t]
        found, wrong = int(at["found"].sum()), int(at["wrong"].sum())
        if found and found >= precision * (found + wrong):
            return t / 100, found / every, found / (found + wrong)
    return 1.01, 0.0, 1.0


def find_spans(text: str, field: Field, belief: float | None = None) -> tuple[list, list]:
    """(base spans, added spans) of a text."""
    base = base_spans(text)
    nodes = nodes_of(text)
    if not nodes:
        return base, []
    belief = field.belief if belief is None else belief
    clamp = _labels(nodes, base)
    edges = edges_of(text, nodes)
    p = beliefs(field, features(text, nodes), edges, clamp)
    added: list[tuple[int, int, int]] = []
    last = -2
    for n, (a, b) in enumerate(nodes):
        label = int(p[n].argmax())
        if clamp[n] or not label or p[n, label] < belief:
            continue
        t = text[a:b]
        a, b = a + len(t) - len(t.lstrip(_EDGES)), b - (len(t) - len(t.rstrip(_EDGES)))
        if a >= b:
            continue
        if added and last == n - 1 and added[-1][0] == label - 1 and text[added[-1][2] : a].isspace():
            added[-1] = (label - 1, added[-1][1], b)
        else:
            added.append((label - 1, a, b))
        last = n
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, added.

    Spans are written kind:start:end in code points. Null counts as empty and has none. Repeated
    rows are each reported; extra columns are not carried. Without ``field`` one is fitted on ``docs``.
    """
    field = field or fit(docs, text)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added string")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", "")
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "added"]
        for s in texts:
            rows = []
            for t in s:
                if not t or not _HINT.search(t):
                    rows.append(none)
                    continue
                base, added = find_spans(t, field)
                n = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), written(added)))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(doc_id).alias("doc_id"), found(F.col(text)).alias("f")).select("doc_id", "f.*")
