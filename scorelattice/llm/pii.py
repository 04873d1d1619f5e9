"""Personal data: rules, and a character BiLSTM with CRF transitions (operator 2).

The base rules find email addresses, IP addresses, cards and phone numbers in
whole texts.  The model adds spans that the rules' formats miss: a bidirectional
LSTM over character classes with a CRF over BIO tags, trained here in numpy on a
bounded sample of windows whose labelled spans are those of the rules, some
rewritten into other spellings of the same data.

Every kind holds a digit or an at sign, in any script's spelling, so only
stretches of text around such characters are decoded: windows that overlap by
half, all over the text.  They are reconciled for the text as a whole: each
character takes its tag from the window in which it lies deepest, and spans are
read from the joined tags, across windows.  Base spans always stay; a decoded
span is added where it touches none of them and holds enough of its kind.

Defined results: null text is the empty text; null ids and repeated rows are
carried along; without documents to learn from the rules stand alone; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import smallest_hashes, whole_text

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Rows looked at for training windows, and most windows learnt from.
TRAINING_ROWS, TRAINING_WINDOWS = 20_000, 2_000
WINDOW, MARGIN = 96, 28
EMBED, HIDDEN, BATCH, EPOCHS, RATE = 10, 16, 64, 6, 0.01
#: Windows decoded at a time.
DECODE = 1024

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[\d@＠]")

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the rules, by start and kind.

    Each search is linear in the text: an address is read from its at sign, a
    number from the start of its digits.
    """
    out, done = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "email"))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Character classes: each sign of its own, letters and digits by kind.
_SIGN = {c: i + 8 for i, c in enumerate("@.-_+()%=\":/#|,;[] \n")}
CLASSES = 8 + len(_SIGN)
_CLASS = np.zeros(128, np.int8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = _SIGN.get(_c) or (1 if _c.isdigit() else 2 if _c in "abcdef" else 3 if _c.islower() else 4 if _c.isupper() else 7)


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _CLASS[np.minimum(points, 127)]
    for i in np.flatnonzero(points > 127):
        c = text[i]
        out[i] = 1 if c.isdigit() else _SIGN["@"] if c == "＠" else 5 if c.islower() else 6 if c.isupper() else 7
    return out


def windows(text: str, size: int = WINDOW, margin: int = MARGIN) -> list[int]:
    """Starts of windows that overlap by half and cover every trigger with its margin."""
    out, stretch = [], None
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if stretch and a <= stretch[1]:
            stretch[1] = b
            continue
        if stretch:
            out += _tiles(*stretch, size)
        stretch = [a, b]
    if stretch:
        out += _tiles(*stretch, size)
    return out


def _tiles(a: int, b: int, size: int) -> list[int]:
    return [a] if b - a <= size else [*range(a, b - size // 2, size // 2)]


def _tags(spans: list[Span], start: int, size: int) -> np.ndarray:
    out = np.zeros(size, np.int8)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        lo, hi = max(a, start), min(b, start + size)
        if lo < hi:
            out[lo - start : hi - start] = k + 1
            if a >= start:
                out[a - start] = k
    return out


def _respelled(value: str, kind: str, random: Random) -> str:
    """Another spelling of the same data, which the rules need not know."""
    if kind == "email":
        return value.replace("@", random.choice((" @ ", "(@)", "[@]", "@")), 1)
    if kind == "ip":
        return value.replace(".", random.choice((" . ", "-", ".")))
    digits = _digits(value)
    if kind == "card":
        by = random.choice((".", "  ", "_", "/"))
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    by = random.choice(("-", ".", " ", "/"))
    return random.choice(("", "tel:", "00")) + by.join((digits[:-10] or "1", digits[-10:-7], digits[-7:-4], digits[-4:]))


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, codes, tags) of windows around spans and around other triggers."""
    for batch in batches:
        codes, tags = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            random = Random(hashlib.sha256(text.encode()).digest())
            versions = [(text, spans)]
            if spans:
                out, moved, at, size = [], [], 0, 0
                for a, b, kind in spans:
                    if a < at:
                        continue
                    start = size + a - at
                    new = _respelled(text[a:b], kind, random)
                    out += [text[at:a], new]
                    size = start + len(new)
                    moved.append((start, size, kind))
                    at = b
                versions.append(("".join([*out, text[at:]]), moved))
            for body, own in versions:
                coded = _classes(body)
                for start in windows(body):
                    start = max(0, start - random.randrange(WINDOW // 2))
                    part = np.zeros(WINDOW, np.int8)
                    here = coded[start : start + WINDOW]
                    part[: len(here)] = here
                    codes.append(part.tobytes())
                    tags.append(_tags(own, start, WINDOW).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(tags, pa.binary())], names=["codes", "tags"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Tagger:
    """Embedding, two LSTMs, a projection to tag scores, and CRF transitions."""

    def __init__(self, seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        k, h, e = len(TAGS), HIDDEN, EMBED
        self.p = {
            "embed": r.normal(0, 0.3, (CLASSES, e)), "out": r.normal(0, 0.3, (2 * h, k)), "out_b": np.zeros(k),
            "trans": r.normal(0, 0.1, (k, k)), "first": np.zeros(k),
        }
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.25, (e + h, 4 * h))
            self.p[f"b{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction over embedded time steps."""
        steps, batch, _ = x.shape
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        w, b = self.p[f"w{d}"], self.p[f"b{d}"]
        ready = x @ w[:EMBED] + b
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = ready[t] + h @ w[EMBED:]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep is not None:
                keep.append((t, before_h, before_c, i, f, o, g, squashed))
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (time, batch, tags) of windows (batch, time)."""
        x = self.p["embed"][codes.T]
        saved = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._run(x, d, saved[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep.update(x=x, states=states, **saved)
        return states @ self.p["out"] + self.p["out_b"]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences, and its gradients."""
        keep: dict = {}
        e = self.emissions(codes, keep).astype(np.float64)
        steps, batch, k = e.shape
        trans, first, y = self.p["trans"].astype(np.float64), self.p["first"], tags.T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + trans
            top = s.max(1)
            alpha[t] = top + np.log(np.exp(s - top[:, None, :]).sum(1)) + e[t]
        for t in range(steps - 2, -1, -1):
            s = trans + (e[t + 1] + beta[t + 1])[:, None, :]
            top = s.max(2)
            beta[t] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        de = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(batch)
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(pair, (y[t - 1], y[t]), -1)
            g["trans"] += pair / batch
        gold = first[y[0]] + e[0, rows, y[0]]
        for t in range(1, steps):
            gold = gold + trans[y[t - 1], y[t]] + e[t, rows, y[t]]
        de[np.arange(steps)[:, None], rows[None, :], y] -= 1
        de = (de / batch).astype(np.float32)
        g["first"] += de[0].sum(0)
        g["out"] += np.einsum("tbh,tbk->hk", keep["states"], de)
        g["out_b"] += de.sum((0, 1))
        ds, dx = de @ self.p["out"].T, np.zeros_like(keep["x"])
        for n, d in enumerate("fb"):
            w, dh_all = self.p[f"w{d}"], ds[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            dh = dc = np.zeros((batch, HIDDEN), np.float32)
            for t, bh, bc, i, f, o, gate, squashed in reversed(keep[d]):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * gate * i * (1 - i), dc * bc * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - gate**2)], axis=1)
                g[f"w{d}"][:EMBED] += keep["x"][t].T @ dz
                g[f"w{d}"][EMBED:] += bh.T @ dz
                g[f"b{d}"] += dz.sum(0)
                dx[t] += dz @ w[:EMBED].T
                dh, dc = dz @ w[EMBED:].T, dc * f
        np.add.at(g["embed"], codes.T, dx)
        return float((z - gold).mean()), g

    def train(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> list[float]:
        """Adam with clipped gradients; returns the loss of each epoch."""
        r = np.random.default_rng(seed)
        m, v, n, losses = {}, {}, 0, []
        for _ in range(epochs):
            order, total = r.permutation(len(codes)), 0.0
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                loss, g = self.gradients(codes[part], tags[part])
                total += loss * len(part)
                size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                n += 1
                for name, x in g.items():
                    x = x * min(1.0, 5.0 / (size + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * x**2
                    step = RATE * (m[name] / (1 - 0.9**n)) / (np.sqrt(v[name] / (1 - 0.99**n)) + 1e-8)
                    self.p[name] = (self.p[name] - step).astype(np.float32)
            losses.append(total / len(codes))
        return losses

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tag sequences (batch, time) of windows."""
        e = self.emissions(codes)
        steps, batch, k = e.shape
        score, back = self.p["first"] + e[0], np.empty((steps, batch, k), np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + self.p["trans"]
            back[t] = s.argmax(1)
            score = s.max(1) + e[t]
        out = np.empty((batch, steps), np.int8)
        out[:, -1] = score.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t, rows, out[:, t]]
        return out


def fit(docs: DataFrame, rows: int = TRAINING_ROWS, most: int = TRAINING_WINDOWS) -> Tagger | None:
    """Train on windows of at most ``rows`` documents, picked by a hash of their id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    picked = smallest_hashes(texts.select("id").where("id is not null").distinct(), ["id"], rows, docs.count())
    found = texts.join(F.broadcast(picked), "id").select("text").mapInArrow(_training_windows, "codes binary, tags binary")
    kept = found.distinct().orderBy(F.xxhash64("codes", "tags"), "codes", "tags").limit(most).collect()
    if not kept:
        return None
    codes, tags = (np.array([np.frombuffer(r[i], np.int8) for r in kept]) for i in (0, 1))
    tagger = Tagger()
    tagger.train(codes, tags)
    return tagger


def _enough(value: str, kind: str) -> bool:
    """Whether a decoded span holds what its kind needs."""
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        return ("@" in value or "＠" in value) and "." in value and len(value) >= 6
    if kind == "ip":
        groups = re.findall(r"\d+", value)
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    letters = sum(c.isalpha() for c in value)
    if kind == "card":
        return 14 <= digits <= 19 and not letters and _luhn("".join(str(int(c)) for c in value if c.isdigit()))
    return 10 <= digits <= 15 and letters <= 4


def reconciled(text: str, starts: list[int], tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the whole text from its windows' tags, with the base spans in their places."""
    depth: dict[int, tuple[int, int]] = {}
    for start, row in zip(starts, tags):
        for i in np.flatnonzero(row[: len(text) - start]).tolist():
            depth[start + i] = (0, 0)
    for start, row in zip(starts, tags):
        size = min(len(row), len(text) - start)
        for i in range(size):
            at = start + i
            if at in depth:
                left = i if start else size
                right = size - 1 - i if start + size < len(text) else size
                inside = 1 + min(left, right)
                if inside > depth[at][0]:
                    depth[at] = (inside, int(row[i]))
    out, now = [], None
    for at in sorted(depth):
        tag = depth[at][1]
        kind = KINDS[(tag - 1) // 2] if tag else None
        if now and (now[1] != at or tag == 0 or now[2] != kind or tag % 2 == 1):
            out.append(tuple(now))
            now = None
        if tag:
            now = [now[0], at + 1, kind] if now else [at, at + 1, kind]
    if now:
        out.append(tuple(now))
    free = []
    # Both in order: of the base spans that begin before a span ends, the one that ends last decides.
    known, met, reach = sorted(base), 0, -1
    for a, b, kind in out:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        while met < len(known) and known[met][0] < b:
            reach = max(reach, known[met][1])
            met += 1
        if reach <= a and _enough(text[a:b], kind):
            free.append((a, b, kind))
    return sorted([*base, *free], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            starts = [windows(t) if tagger else [] for t in texts]
            final = list(base)
            group: list[int] = []
            held = 0
            for k, own in enumerate(starts):
                if own:
                    group.append(k)
                    held += len(own)
                if group and (held >= DECODE or k == len(texts) - 1):
                    for i, spans in _decoded(tagger, texts, starts, group, base):
                        final[i] = spans
                    group, held = [], 0
            if group:
                for i, spans in _decoded(tagger, texts, starts, group, base):
                    final[i] = spans
            counts = [pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
            shown = [_shown(b) for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *counts, pa.array([hashlib.sha256(s.encode()).hexdigest() for s in shown]),
                    pa.array([_shown(f) for f in final], pa.string()), pa.array([len(f) - len(b) for f, b in zip(final, base)], pa.int64()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return texts.mapInArrow(find, schema)


def _decoded(tagger: Tagger, texts: list[str], starts: list[list[int]], group: list[int], base: list[list[Span]]):
    """Spans of the texts numbered in ``group``, a bounded number of windows at a time."""
    places = [(k, start) for k in group for start in starts[k]]
    tags = np.zeros((len(places), WINDOW), np.int8)
    for at in range(0, len(places), DECODE):
        part = places[at : at + DECODE]
        codes = np.zeros((len(part), WINDOW), np.int8)
        for row, (k, start) in zip(codes, part):
            own = _classes(texts[k][start : start + WINDOW])
            row[: len(own)] = own
        tags[at : at + len(part)] = tagger.decode(codes)
    at = 0
    for k in group:
        n = len(starts[k])
        yield k, reconciled(texts[k], starts[k], tags[at : at + n], base[k])
        at += n
