"""Personal data: exact base patterns, and a skip-chain conditional random field that adds to them.

Base spans are leftmost non-overlapping matches of the four patterns (:data:`KINDS`), each
kept only if its test holds.  The field labels tokens O, one of the kinds, or ``secret`` (a credential).
Token potentials come from surface features, chain potentials from neighbours, and skip
potentials tie distant tokens that are repeated or similar (same last seven digits, same address),
so loopy sum-product message passing makes labels agree across a document.  Tokens that
lie in base spans are observed, and so are long tokens that mix letters and digits, as secrets;
others decoded as an entity with a marginal of at least ``min_marginal`` become added spans (secrets
are listed apart).  Base spans always stay.

Only tokens that carry a digit, ``@`` or ``+`` or repeat a part of a base address can be
entities; all others are observed O and enter as their neighbours' chain potentials.
All tokens of a key are linked to one hub, so links grow with the tokens, not with their
square, and any two repeats are as near as if they were linked themselves.
Parameters are trained piecewise on a bounded sample (``fit``), of which only counts of feature
patterns reach the driver; a token that shares a key with an observed entity but is none
itself is left out there, so that what the patterns miss is not taught as O.  Inference covers whole texts.

Null text is empty.  Positions are code points, end exclusive.  Repeated rows give
repeated results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sub_batches

KINDS = ("email", "ip", "card", "phone")
# Possessive and anchored forms of the patterns, linear in the text and with the same matches: no part can
# give back what the next part needs, and none can start within a run that it would have begun with.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SECRET = re.compile(r"[A-Za-z0-9_-]{24,}+")
_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@+]")
_EDGE = ".,;:!?()\"'"
NAMES = (*KINDS, "secret")
LABELS = 1 + len(NAMES)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if _HINT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """Runs of at least 24 letters, digits, ``_`` and ``-`` with six digits and six letters or more."""
    out = []
    for m in _SECRET.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if digits >= 6 and sum(c.isalpha() for c in m[0]) >= 6:
            out.append((len(KINDS), m.start(), m.end()))
    return out


N_TOKEN_FEATURES = 11


@dataclass
class Field:
    """Potentials (logs): token weights by label, chain by label pair, and the skip bonus for agreement."""

    token: np.ndarray = field(default_factory=lambda: np.zeros((N_TOKEN_FEATURES, LABELS)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    skip: float = 0.0


@dataclass
class Lattice:
    spans: list[tuple[int, int]]
    features: np.ndarray
    known: np.ndarray  # base label, -1 where it is open
    beside: np.ndarray  # whether an O token that cannot be an entity stands before, after
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]  # each repeat and the one before, for training
    hubs: list[tuple[int, int]]  # (hub, token) of every key with repeats


def lattice(text: str, base: list[tuple[int, int, int]]) -> Lattice | None:
    """Tokens that can be entities, their features and links; None without any."""
    parts = set()
    for kind, a, b in base:
        if kind == 0:
            parts.update(p for p in (text[a:b].lower(), text[a:b].lower().partition("@")[0]) if len(p) >= 5)
    tokens, beside, last_open = [], [], None  # last_open: whether the token before is in the list; None at the start
    for m in _TOKEN.finditer(text):
        t = m[0]
        if _HINT.search(t) or (parts and t.lower().strip(_EDGE) in parts):
            tokens.append((m.start(), m.end(), t))
            beside.append([last_open is False, False])
            last_open = True
        else:
            if last_open:
                beside[-1][1] = True
            last_open = False
    if not tokens:
        return None
    n = len(tokens)
    x, known = np.zeros((n, N_TOKEN_FEATURES)), np.full(n, -1)
    chain, skip, last, holders = [], [], {}, {}
    marks = sorted((a, b, k + 1) for k, a, b in base)
    at = 0
    for i, (a, b, t) in enumerate(tokens):
        core = t.strip(_EDGE)
        digits = _NOT_DIGIT.sub("", core)
        x[i] = (
            1, "@" in core, core.startswith("+"), core.count(".") == 3 and len(digits) >= 4, len(digits) >= 13, 7 <= len(digits) <= 12,
            1 <= len(digits) <= 6, not digits, len(digits) == len(core), any(c.isalpha() for c in core),
            len(core) >= 20 and len(digits) >= 6 and any(c.isalpha() for c in core),
        )
        while at < len(marks) and marks[at][1] <= a:
            at += 1
        j = at
        while j < len(marks) and marks[j][0] < b:  # the earliest span that covers a part of the token
            known[i] = marks[j][2] if known[i] < 0 else known[i]
            j += 1
        if i and not beside[i][0]:
            chain.append((i - 1, i))
        key = digits if len(digits) >= 7 else (core.lower() if len(core) >= 5 else None)
        keys = {key, digits[-7:]} if len(digits) >= 7 else {key} if key else set()  # a number is similar to one with a longer prefix
        if "@" in core:
            keys.add(core.lower().partition("@")[0])
        for key in keys:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
            holders.setdefault(key, []).append(i)
    repeated = [held for held in holders.values() if len(held) > 1]
    hubs = [(h, i) for h, held in enumerate(repeated) for i in held]
    return Lattice([(a, b) for a, b, _ in tokens], x, known, np.array(beside), chain, skip, hubs)


def hub_bonus(skip: float) -> float:
    """Bonus of a link to a hub: two such links in a row are one link with the bonus ``skip``."""
    e = np.exp(skip)
    r = np.sqrt(max(e - 1, 0) / (e - 1 + LABELS))
    return float(np.log((1 + (LABELS - 1) * r) / (1 - r)))


def marginals(g: Lattice, f: Field, damping: float = 0.3) -> np.ndarray:
    """Label marginals by damped loopy sum-product over chain and hub links, until messages
    stand still; the bound on rounds grows with the graph, as a label moves one link a round."""
    n = len(g.features)
    unary = np.zeros((n + (g.hubs[-1][0] + 1 if g.hubs else 0), LABELS))  # hubs come after the tokens
    unary[:n] = g.features @ f.token + np.outer(g.beside[:, 0], f.chain[0]) + np.outer(g.beside[:, 1], f.chain[:, 0])
    seen = np.flatnonzero(g.known >= 0)
    unary[seen] = -30.0
    unary[seen, g.known[seen]] = 0.0
    pairs = g.chain + [(n + h, i) for h, i in g.hubs]
    if pairs:
        edges = np.array(pairs)
        agree = hub_bonus(f.skip) * np.eye(LABELS)
        table = np.stack([f.chain] * len(g.chain) + [agree] * len(g.hubs))
        source, sink = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        m, back = np.zeros((len(source), LABELS)), np.r_[len(edges) : 2 * len(edges), 0 : len(edges)]
        for _ in range(24 + 4 * len(unary)):
            belief = unary.copy()
            np.add.at(belief, sink, m)
            out = (belief[source] - m[back])[:, :, None] + table
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.abs(new - m).max()
            m = damping * m + (1 - damping) * new
            if change < 1e-3:
                break
        np.add.at(unary, sink, m)
    unary = unary[:n]
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def counts(g: Lattice) -> Counter:
    """What training takes from a lattice: (0, feature pattern, label), (1, label, label) of neighbours and
    (2, whether labels agree, 0) of repeats.  Tokens that share a key with an entity and are none are left out."""
    y, out = g.known.copy(), Counter()
    groups: dict[int, list[int]] = {}
    for h, i in g.hubs:
        groups.setdefault(h, []).append(i)
    doubtful = {i for held in groups.values() if any(y[j] > 0 for j in held) for i in held if y[i] < 0}
    y[y < 0] = 0
    pattern = g.features.astype(np.int64) @ (1 << np.arange(N_TOKEN_FEATURES))
    for i in range(len(y)):
        if i not in doubtful:
            out[0, int(pattern[i]), int(y[i])] += 1
            if g.beside[i, 0]:
                out[1, 0, int(y[i])] += 1
            if g.beside[i, 1]:
                out[1, int(y[i]), 0] += 1
    for a, b in g.chain:
        if not {a, b} & doubtful:
            out[1, int(y[a]), int(y[b])] += 1
    for a, b in g.skip:
        if not {a, b} & doubtful:
            out[2, int(y[a] == y[b]), 0] += 1
    return out


def train(total: Counter) -> Field:
    """Token weights by multinomial logistic regression over weighted patterns, chain and skip potentials from
    label counts, all smoothed."""
    token = [(p, y, n) for (k, p, y), n in sorted(total.items()) if k == 0]
    if not token:
        return Field()
    pattern, y, n = (np.array(v) for v in zip(*token))
    x = ((pattern[:, None] >> np.arange(N_TOKEN_FEATURES)) & 1).astype(float)
    w, truth, share = np.zeros((N_TOKEN_FEATURES, LABELS)), np.eye(LABELS)[y], (n / n.sum())[:, None]
    for _ in range(1500):
        s = x @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w += x.T @ (share * (truth - p)) - 0.0005 * w
    chain, same = np.full((LABELS, LABELS), 1.0), np.array([1.0, 1.0])
    for (k, a, b), c in total.items():
        if k == 1:
            chain[a, b] += c
        elif k == 2:
            same[a] += c
    joint = chain / chain.sum()
    chain_log = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    return Field(w, np.clip(chain_log, -3, 3), float(np.clip(np.log(same[1] / same[0]), 0.5, 4)))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 16_000) -> Field:
    """Piecewise training on the documents of the ``sample_rows`` ids with the smallest hashes.  Tasks count feature
    patterns and labels; at most a few thousand different ones reach the driver, and no text."""
    key = F.xxhash64(F.lit("pii"), F.col(doc_id))
    chosen = docs.select(key.alias("_h")).distinct().orderBy("_h").limit(sample_rows)  # reads ids only
    texts = docs.select(key.alias("_h"), F.col(text).alias("text")).join(F.broadcast(chosen), "_h").filter(F.col("text").rlike("[@+0-9]")).select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = Counter()
            for t in batch.column("text").to_pylist():
                g = lattice(t, base_spans(t) + secret_spans(t))
                if g is not None:
                    total.update(counts(g))
            rows = [(*k, n) for k, n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["k", "a", "b", "n"])

    found = map_arrow(texts, work, "k long, a long, b long, n long").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    return train(Counter({(r.k, r.a, r.b): r.n for r in found.collect()}))


def added_spans(text: str, base: list[tuple[int, int, int]], f: Field, min_marginal: float) -> list[tuple[int, int, int]]:
    """Spans of open tokens that the field labels as an entity, trimmed of punctuation."""
    g = lattice(text, base)
    if g is None or (g.known >= 0).all():
        return []
    p = marginals(g, f)
    out = []
    for i, (a, b) in enumerate(g.spans):
        label = int(p[i].argmax())
        if g.known[i] < 0 and label and p[i, label] >= min_marginal:
            core = text[a:b].strip(_EDGE)
            if core:
                a = text.index(core, a, b)
                out.append((label - 1, a, a + len(core)))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_marginal: float = 0.9, model: Field | None = None, **fitting) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base`` and ``spans`` (kind:start:end lists of the four kinds), ``n_added``
    (by the field), ``secrets`` (a list of its own), ``n_secret`` and ``n_found`` (all of them)."""
    f = model or fit(docs, doc_id=doc_id, text=text, **fitting)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                out = []
                for t in part.column("text").to_pylist():
                    hint = _HINT.search(t)
                    base = base_spans(t) if hint else []
                    secrets = secret_spans(t) if hint else []
                    added = added_spans(t, base + secrets, f, min_marginal) if hint else []
                    more, secrets = [s for s in added if s[0] < len(KINDS)], secrets + [s for s in added if s[0] >= len(KINDS)]
                    counts = [sum(k == i for k, _, _ in base) for i in range(4)]
                    listed = _listed(base)
                    out.append((*counts, listed, hashlib.sha256(listed.encode()).hexdigest(), _listed(base + more) if more else listed, len(more), _listed(secrets), len(secrets), len(base) + len(more) + len(secrets)))
                cols = list(zip(*out))
                kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64(), pa.string()] + [pa.int64()] * 2
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "spans", "n_added", "secrets", "n_secret", "n_found"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(rows, work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, spans string, n_added long, secrets string, n_secret long, n_found long")
