"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from patterns (emails, IP addresses, card and phone numbers), leftmost and non-overlapping for each
kind. The field then labels tokens that hold a digit or an @ as O or one of the kinds. Its potentials are learned
from the whole corpus: token potentials from the base labels by shape (smoothed log frequencies), chain potentials
between neighbouring tokens, and skip potentials between tokens of one document that repeat or resemble each other
(the same core, or one core ending in the other's last digits). Tokens inside base spans are observed. Loopy
sum-product passes run over the joint graph of many documents at once. A pass moves evidence by one link, so documents
that have not settled after ROUNDS of them go on by sweeps over their tokens in order and back, each of which carries
evidence through the whole document, until they settle (one whose messages circle for SWEEPS sweeps ends there). A token whose most
probable label is a kind adds a span (its core, without surrounding punctuation) where it meets no base span.
Skip links go to the next token of the same core, so a token repeated without end costs one link each time.

Documents without tokens of that sort need no inference: all their tokens are O by construction. A null text is the
empty text. Rows are handled on their own; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship

#: Kinds in the order of the contract; label 0 is "none".
KINDS = ("email", "ip", "card", "phone")
K = len(KINDS) + 1

# The patterns, written so that no input takes more than linear time: digit runs are entered only at their start
# and never given back, and email addresses are looked for around each @.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_HAS = re.compile(r"[0-9@]")
_CORE = re.compile(r"[0-9A-Za-z]")

#: Neighbouring added tokens are parts of one card or phone number up to so many digits.
JOINED = {3: 19, 4: 15}
UNMET_NONE = 0.8  # a shape that was never met is O unless its links say otherwise
CORE_LEAST = 6  # shorter cores are too common to link
ROUNDS = 30
SWEEPS, UNDAMPED = 200, 100
SETTLED = 1e-3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _HAS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0") or "0") <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def spans_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Tokens(NamedTuple):
    start: list[int]
    end: list[int]
    shape: list[str]
    label: list[int]  # of the base span the token meets, 0 for none
    core: list[str]


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    """Tokens that may be personal data: those with a digit or an @, cut to their cores."""
    out = Tokens([], [], [], [], [])
    if not _HAS.search(text):
        return out
    at = 0
    for m in _TOKEN.finditer(text):
        raw, begin = m.group(), m.start()
        inner = raw.strip(".,;:!?()[]{}<>\"'")
        a = begin + raw.find(inner) if inner else begin
        b = a + len(inner)
        while at < len(base) and base[at][2] <= a and at + 1 < len(base) and base[at + 1][0] < b:
            at += 1
        label = next((k + 1 for s, k, e in base[max(0, at - 1) : at + 3] if s < b and e > a), 0)
        digits = sum(c.isdigit() for c in inner)
        alnum = "".join(_CORE.findall(inner)).lower()
        out.start.append(a)
        out.end.append(b)
        out.label.append(label)
        out.core.append(alnum if digits < len(alnum) else alnum.lstrip("0"))
        out.shape.append(_shape(raw, inner, digits, alnum))
    return out


def _shape(raw: str, inner: str, digits: int, alnum: str) -> str:
    """A token's class, of which there are a few hundred: counts in steps, and what the patterns would check."""
    letters = len(alnum) - digits
    dots = min(inner.count("."), 4)
    if "@" in inner:
        return f"@{min(inner.count('@'), 2)}.{dots}"
    if letters:
        return f"a{min(letters, 8) // 4}d{min(digits, 16) // 4}.{dots}{'=' if '=' in inner else ''}"
    ok = "l" if 12 <= digits <= 19 and luhn(alnum) else ""
    return f"d{min(digits, 20)}.{dots}-{min(inner.count('-'), 3)}{'+' if raw[:1] == '+' else ''}{'(' if raw[:1] == '(' else ''}{ok}"


def _links(docs: list[Tokens], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(chain links, skip links) between token numbers counted over all documents."""
    chain, skip, first = [], [], 0
    for t, text in zip(docs, texts, strict=True):
        last: dict[str, int] = {}
        for i, core in enumerate(t.core):
            if i and t.start[i] - t.end[i - 1] <= 3 and text[t.end[i - 1] : t.start[i]].strip(".,;:!?()[]{}<>\"'") in ("", " "):
                chain.append((first + i - 1, first + i))
            if len(core) >= CORE_LEAST:
                tail = core[-CORE_LEAST - 1 :] if core.isdigit() else core
                for key in {core, "~" + tail}:
                    j = last.get(key)
                    if j is not None and (not skip or skip[-1] != (first + j, first + i)):
                        skip.append((first + j, first + i))
                    last[key] = i
        first += len(t.core)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return pairs(chain), pairs(skip)


class Model(NamedTuple):
    node: dict[str, np.ndarray]  # log potentials by shape
    other: np.ndarray  # of a shape not met
    chain: np.ndarray  # (K, K) log potentials
    skip: np.ndarray


def fit(docs: DataFrame) -> Model:
    """Potentials from the base labels of all documents. What reaches the driver is a row for each (shape, label)
    and (kind of link, label, label): a number bounded by the shapes."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                if not _HAS.search(text):
                    continue
                t = tokens_of(text, base_spans(text))
                for key in zip(t.shape, t.label, [0] * len(t.label), strict=True):
                    n[key] = n.get(key, 0) + 1
                for name, pairs in zip(("chain", "skip"), _links([t], [text]), strict=True):
                    for i, j in pairs.tolist():
                        key = ("\0" + name, t.label[i], t.label[j])
                        n[key] = n.get(key, 0) + 1
        if n:
            kind, a, c = zip(*n, strict=True)
            yield pa.record_batch([pa.array(kind), pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(n.values(), pa.int64())], names=["kind", "a", "b", "n"])

    rows = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "kind string, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    node: dict[str, np.ndarray] = {}
    pair = {"\0chain": np.zeros((K, K)), "\0skip": np.zeros((K, K))}
    for r in rows:
        if r.kind in pair:
            pair[r.kind][r.a, r.b] += r.n
        else:
            node.setdefault(r.kind, np.zeros(K))[r.a] += r.n
    prior = np.array([UNMET_NONE, *[(1 - UNMET_NONE) / (K - 1)] * (K - 1)])
    # A shape is certain only as far as it has been met: counts are smoothed towards the prior and kept finite.
    log = {s: np.log((c + 2 * prior) / (c.sum() + 2)) for s, c in node.items()}

    def compatible(counts: np.ndarray, agree: float) -> np.ndarray:
        """Log of how much more often two labels are linked than if they were independent; the same kind is favoured
        by `agree` pseudo-links."""
        c = counts + counts.T + 0.5 + agree * np.eye(K)
        p = c / c.sum()
        m = p.sum(1)
        return np.clip(np.log(p / np.outer(m, m)), -6, 6)

    return Model(log, np.log(prior), compatible(pair["\0chain"], 1.0), compatible(pair["\0skip"], 10.0))


def propagate(node: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], doc: np.ndarray | None = None) -> np.ndarray:
    """Beliefs (tokens, K) by damped loopy sum-product; `links` are (pairs, log potentials), `doc` the document of each
    token. A document's messages rest once its own have settled, so what else is in the batch changes nothing. Documents
    that move for longer than ROUNDS are settled by sweeps."""
    pairs = [(p, w) for p, w in links if len(p)]
    if not pairs:
        return node
    src = np.concatenate([np.concatenate([p[:, 0], p[:, 1]]) for p, _ in pairs])
    dst = np.concatenate([np.concatenate([p[:, 1], p[:, 0]]) for p, _ in pairs])
    back = np.concatenate([np.r_[len(p) : 2 * len(p), 0 : len(p)] + 2 * sum(len(q) for q, _ in pairs[:i]) for i, (p, _) in enumerate(pairs)])
    weight = np.concatenate([np.repeat(np.exp(w)[None], 2 * len(p), 0) if np.allclose(w, w.T) else np.concatenate([np.repeat(np.exp(w)[None], len(p), 0), np.repeat(np.exp(w.T)[None], len(p), 0)]) for p, w in pairs])
    msg = np.zeros((len(src), K))
    of = (np.zeros(len(node), np.int64) if doc is None else doc)[src]
    live = np.ones(int(of.max()) + 1, bool)
    beliefs = node
    for _ in range(ROUNDS):
        out = beliefs[src] - msg[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ek,ekl->el", out, weight))
        new -= new.max(1, keepdims=True)
        moved = np.zeros(len(live))
        np.maximum.at(moved, of, np.abs(new - msg).max(1))
        msg = np.where(live[of][:, None], 0.5 * msg + 0.5 * new, msg)
        beliefs = node.copy()
        np.add.at(beliefs, dst, msg)
        live &= moved >= SETTLED
        if not live.any():
            return beliefs
    _sweep(beliefs, msg, src, dst, back, weight, of, live)
    return beliefs


def _sweep(beliefs: np.ndarray, msg: np.ndarray, src: np.ndarray, dst: np.ndarray, back: np.ndarray, weight: np.ndarray, of: np.ndarray, live: np.ndarray) -> None:
    """Settle the live documents in place: messages to later tokens in their order, then those to earlier ones in
    reverse, each from the newest beliefs. A level holds tokens that wait for none of each other, of all documents."""
    level = np.zeros(len(beliefs), np.int64)
    ahead = np.flatnonzero(live[of] & (src < dst))
    at = level.tolist()
    for i, j in sorted(zip(dst[ahead].tolist(), src[ahead].tolist(), strict=True)):
        at[i] = max(at[i], at[j] + 1)
    level[:] = at

    def steps() -> list[np.ndarray]:
        out = []
        for e, key in ((np.flatnonzero(live[of] & (src < dst)), dst), (np.flatnonzero(live[of] & (src > dst)), src)):
            order = e[np.argsort(level[key[e]], kind="stable")]
            parts = np.split(order, np.flatnonzero(np.diff(level[key[order]])) + 1)
            out += parts if key is dst else parts[::-1]
        return out

    todo = steps()
    for n in range(SWEEPS):
        moved = np.zeros(len(live))
        for e in todo:
            out = beliefs[src[e]] - msg[back[e]]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", out, weight[e]))
            new -= new.max(1, keepdims=True)
            change = new - msg[e]
            np.maximum.at(moved, of[e], np.abs(change).max(1))
            if n >= UNDAMPED:
                change *= 0.5
            msg[e] += change
            np.add.at(beliefs, dst[e], change)
        rest = live & (moved < SETTLED)
        if rest.any():
            live = live & ~rest
            if not live.any():
                return
            todo = steps()


def label(docs: list[Tokens], texts: list[str], model: Model) -> list[list[int]]:
    """Most probable label of every token; base tokens keep theirs."""
    n = sum(len(t.core) for t in docs)
    if not n:
        return [[] for _ in docs]
    own = np.array([x for t in docs for x in t.label])
    node = np.array([model.node.get(s, model.other) for t in docs for s in t.shape])
    fixed = np.flatnonzero(own)
    node[fixed] = -30.0
    node[fixed, own[fixed]] = 0.0
    chain, skip = _links(docs, texts)
    doc = np.repeat(np.arange(len(docs)), [len(t.core) for t in docs])
    found = propagate(node, [(chain, model.chain), (skip, model.skip)], doc).argmax(1)
    out, at = [], 0
    for t in docs:
        out.append(found[at : at + len(t.core)].tolist())
        at += len(t.core)
    return out


def added_spans(t: Tokens, labels: list[int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, at, held = [], 0, 0
    reach = sorted(base)
    for a, b, own, k, core in zip(t.start, t.end, t.label, labels, t.core, strict=True):
        if k and not own and b > a:
            while at < len(reach) and reach[at][2] <= a:
                at += 1
            if any(s < b and e > a for s, _, e in reach[at : at + 8]):
                continue
            n = sum(map(str.isdigit, core))
            if out and out[-1][1] == k - 1 and a - out[-1][2] <= 3 and held + n <= JOINED.get(k, 0):
                out[-1], held = (out[-1][0], k - 1, b), held + n  # parts of one number
            else:
                out.append((a, k - 1, b))
                held = n
    return out


def all_spans(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    toks = [tokens_of(t, b) for t, b in zip(texts, base, strict=True)]
    return [(b, added_spans(t, x, b)) for b, t, x in zip(base, toks, label(toks, texts, model), strict=True)]


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones joined) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` but text, and n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added
    (these replace clashing columns)."""
    ship(docs.sparkSession)
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    docs = docs.drop(*new)
    schema = StructType([f for f in docs.schema if f.name != "text"])
    for name in new:
        schema = schema.add(name, "string" if name in ("base_sha256", "spans") else "long")
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = [t or "" for t in b.column(i).to_pylist()]
            cols: list[list] = [[] for _ in new]
            for base, added in all_spans(texts, model):
                s = spans_string(base)
                counts = [sum(k == j for _, k, _ in base) for j in range(len(KINDS))] if base else [0] * len(KINDS)
                for c, v in zip(cols, (*counts, hashlib.sha256(s.encode()).hexdigest() if s else empty, spans_string(sorted(base + added)) if added else s, len(added)), strict=True):
                    c.append(v)
            names = [n for n in b.schema.names if n != "text"]
            arrays = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.record_batch([*arrays, *(pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(new, cols, strict=True))], names=[*names, *new])

    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with the spans in text replaced by [KIND]; n_chars, if there, counted anew where text changed."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            had = b.column(i).to_pylist()
            now = [redact(t, base + added) if base or added else t for t, (base, added) in zip(had, all_spans([t or "" for t in had], model), strict=True)]
            b = b.set_column(i, b.schema.field(i), pa.array(now, b.schema.field(i).type))
            j = b.schema.get_field_index("n_chars")
            if j >= 0:
                n = [len(x) if x != y else c for x, y, c in zip(now, had, b.column(j).to_pylist(), strict=True)]
                b = b.set_column(j, b.schema.field(j), pa.array(n, b.schema.field(j).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
