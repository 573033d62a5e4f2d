"""Personal data: exact patterns, and spans that a character BiLSTM-CRF adds.

The tagger is trained here, in numpy, from spans that the patterns label in a bounded sample of documents. A span must
hold a digit or an at sign, so the tagger reads the windows (``WINDOW`` characters, one every ``STRIDE``) that have one;
all others are free of spans by that rule. Emissions of overlapping windows are blended, weighted towards the middle of
each, and the CRF decodes every connected stretch of windows as a whole, so window edges leave no trace. An added span
needs a high marginal probability on each of its characters, the kind's own look, and no overlap with a pattern's span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import query, table, tidy

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: Documents that training looks at, about; windows that it uses at most; least probability of an added span.
FIT_DOCS, FIT_WINDOWS, STEPS, SURE = 4000, 1500, 700, 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# All starts inside a run of digits match or fail alike, so a match is only looked for at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = "[0-9@]"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            m = _DOMAIN.match(text, at + 1)
            if m:
                start = at
                while start > free and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    out.append((0, start, m.end()))
                    free = m.end()
                    at = text.find("@", free)
                    continue
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def plausible(kind: int, piece: str) -> bool:
    """Whether an added span looks like its kind."""
    digits = sum("0" <= c <= "9" for c in piece)
    if piece != piece.strip():
        return False
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", piece) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", piece) is not None and all(int(p) <= 255 for p in piece.split("."))
    if kind == 2:
        plain = re.sub(r"[\s.-]", "", piece)
        return plain.isascii() and plain.isdigit() and 13 <= len(plain) <= 19 and _luhn(plain)
    return 8 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9\s().-]*[\s().-][0-9\s().-]*[0-9]", piece) is not None


# Characters in classes: 0 is beyond the text.
_SINGLE = "@.-+()_%:/,"
CLASSES = 8 + len(_SINGLE)
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind


def char_classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(c < 128, 7, 4).astype(np.uint8)  # other signs; other letters
    out[(c >= 48) & (c <= 57)] = 1
    out[(c >= 97) & (c <= 122)] = 2
    out[(c >= 65) & (c <= 90)] = 3
    out[c == 32] = 5
    out[(c >= 9) & (c <= 13)] = 6
    for i, x in enumerate(_SINGLE):
        out[c == ord(x)] = 8 + i
    return out


def windows_of(classes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign; a window may begin before the text."""
    at = np.flatnonzero((classes == 1) | (classes == 8)) // STRIDE * STRIDE
    return np.unique(np.concatenate([at, at - STRIDE]))


def cut(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.zeros(STRIDE, classes.dtype), classes, np.zeros(WINDOW, classes.dtype)])
    return padded[(starts + STRIDE)[:, None] + np.arange(WINDOW)]


def span_tags(n: int, spans) -> np.ndarray:
    """Tags of a text of n characters; where kinds overlap, the first span counts."""
    out = np.zeros(n, np.uint8)
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """A bidirectional LSTM over character classes with CRF transitions."""

    SIZE, HIDDEN = 10, 14

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        h = self.HIDDEN
        self.p = {"emb": rng.normal(0, 0.5, (CLASSES, self.SIZE)), "out": w(2 * h, TAGS), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"x{d}": w(self.SIZE, 4 * h), f"h{d}": w(h, 4 * h), f"b{d}": np.zeros(4 * h)}
            self.p[f"b{d}"][h:2 * h] = 1
        tag = np.arange(TAGS)
        kind, inside = (tag - 1) // 2, (tag > 0) & (tag % 2 == 0)
        # Inside follows only begin or inside of its own kind.
        self.barred = inside[None, :] & ~((tag[:, None] > 0) & (kind[:, None] == kind[None, :]))

    def _lstm(self, x, d, keep):
        h_n = self.HIDDEN
        steps, n, _ = x.shape
        z_all = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, h_n)), np.zeros((n, h_n))
        hs, saved = np.zeros((steps, n, h_n)), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_all[t] + h @ self.p[f"h{d}"]
            gate = _sigmoid(z[:, :3 * h_n])
            i, f, o, g = gate[:, :h_n], gate[:, h_n:2 * h_n], gate[:, 2 * h_n:], np.tanh(z[:, 3 * h_n:])
            before, past = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                saved[t] = (i, f, o, g, before, past, tc)
        return hs, saved

    def emissions(self, classes: np.ndarray, keep: bool = False):
        """(steps, windows, tags) for (windows, steps) character classes."""
        x = self.p["emb"][classes.T]
        f, sf = self._lstm(x, "f", keep)
        b, sb = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        out = both @ self.p["out"] + self.p["bias"]
        return (out, x, both, sf, sb) if keep else out

    def transitions(self):
        return np.where(self.barred, -1e4, self.p["trans"])

    def marginals(self, e: np.ndarray):
        """Tag probabilities and pair probabilities summed over steps, from (steps, n, tags) emissions."""
        steps, n, k = e.shape
        trans = self.transitions()
        start = np.where((np.arange(k) > 0) & (np.arange(k) % 2 == 0), -1e4, 0.0)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + start
        for t in range(1, steps):
            a[t] = e[t] + _logsum(a[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            b[t] = _logsum(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _logsum(a[-1], 1)
        p = np.exp(np.minimum(a + b - z[None, :, None], 0))
        return p, a, b, z, trans

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        steps, n, k = e.shape
        trans = self.transitions()
        score = e[0] + np.where((np.arange(k) > 0) & (np.arange(k) % 2 == 0), -1e4, 0.0)
        back = np.zeros((steps, n, k), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + trans
            back[t] = all_.argmax(axis=1)
            score = e[t] + all_.max(axis=1)
        path = np.zeros((steps, n), np.int64)
        path[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(n), path[t]]
        return path

    def _lstm_back(self, dh, x, saved, d, grad):
        h_n = self.HIDDEN
        steps, n, _ = x.shape
        dx = np.zeros((steps, n, 4 * h_n))
        dnext, dc = np.zeros((n, h_n)), np.zeros((n, h_n))
        wh = self.p[f"h{d}"]
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            i, f, o, g, before, past, tc = saved[t]
            dht = dh[t] + dnext
            dct = dc + dht * o * (1 - tc * tc)
            dz = np.concatenate([
                dct * g * i * (1 - i), dct * before * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)
            ], axis=1)
            dx[t] = dz
            grad[f"h{d}"] += past.T @ dz
            dnext, dc = dz @ wh.T, dct * f
        flat = dx.reshape(-1, 4 * h_n)
        grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"b{d}"] += flat.sum(axis=0)
        return dx @ self.p[f"x{d}"].T

    def gradient(self, classes: np.ndarray, tags: np.ndarray):
        """Negative log likelihood per window, and its gradient."""
        e, x, both, sf, sb = self.emissions(classes, keep=True)
        steps, n, k = e.shape
        p, a, b, z, trans = self.marginals(e)
        gold = tags.T
        rows = np.arange(n)
        one = np.zeros_like(e)
        one[np.arange(steps)[:, None], rows, gold] = 1
        score = (e * one).sum() + trans[gold[:-1], gold[1:]].sum()
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        de = (p - one) / n
        for t in range(1, steps):
            pair = np.exp(np.minimum(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - z[:, None, None], 0))
            grad["trans"] += pair.sum(axis=0) / n
        np.add.at(grad["trans"], (gold[:-1].ravel(), gold[1:].ravel()), -1.0 / n)
        grad["trans"][self.barred] = 0
        grad["out"] += both.reshape(steps * n, -1).T @ de.reshape(steps * n, k)
        grad["bias"] += de.sum(axis=(0, 1))
        dboth = de @ self.p["out"].T
        h = self.HIDDEN
        dx = self._lstm_back(dboth[:, :, :h], x, sf, "f", grad) + self._lstm_back(dboth[:, :, h:], x, sb, "b", grad)
        np.add.at(grad["emb"], classes.T, dx)
        return (z.sum() - score) / n, grad

    def fit(self, classes: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 0.05, seed: int = 1) -> float:
        """Adam on shuffled batches; the last losses' mean."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order, losses = np.zeros(0, np.int64), []
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(classes))])
            now, order = order[:batch], order[batch:]
            loss, grad = self.gradient(classes[now], tags[now])
            losses.append(loss)
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            lr, cap = rate * (1 - 0.95 * step / steps), min(1.0, 5 / (norm + 1e-9))
            for k, g in grad.items():
                g = g * cap
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses[-20:]))


_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)


def added_spans(tagger: Tagger, texts: list[str], taken: list[list[tuple[int, int, int]]], sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) that the tagger adds to each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes = [char_classes(x) for x in texts]
    starts = [windows_of(c) for c in classes]
    if not sum(map(len, starts)):
        return out
    cuts = np.concatenate([cut(c, s) for c, s in zip(classes, starts, strict=True) if len(s)])
    e = np.concatenate([tagger.emissions(cuts[i:i + 512]).transpose(1, 0, 2) for i in range(0, len(cuts), 512)])
    regions, at = [], 0  # (text, start, emissions): stretches of windows that touch
    for i, s in enumerate(starts):
        for group in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s) > STRIDE) + 1) if len(s) else ():
            first, length = s[group[0]], s[group[-1]] - s[group[0]] + WINDOW
            total, weight = np.zeros((length, TAGS)), np.zeros(length)
            for g in group:
                o = s[g] - first
                total[o:o + WINDOW] += e[at + g] * _WEIGHT[:, None]
                weight[o:o + WINDOW] += _WEIGHT
            regions.append((i, int(first), total / weight[:, None]))
        at += len(s)
    regions.sort(key=lambda r: len(r[2]))
    outside = np.full(TAGS, -1e4)
    outside[0] = 0
    for lo in range(0, len(regions), 256):
        part = regions[lo:lo + 256]
        size = max(len(r[2]) for r in part) + 1
        if size * len(part) > 400_000 and len(part) > 1:  # very long stretches go one by one
            parts = [[r] for r in part]
        else:
            parts = [part]
        for batch in parts:
            size = max(len(r[2]) for r in batch) + 1
            block = np.tile(outside, (size, len(batch), 1))
            for j, (_, _, x) in enumerate(batch):
                block[:len(x), j] = x
            path, p = tagger.viterbi(block), tagger.marginals(block)[0]
            for j in np.flatnonzero(path.any(axis=0)):
                i, first, _ = batch[j]
                line = path[:, j]
                begins = np.flatnonzero((line > 0) & (line % 2 == 1))
                for b in begins:
                    kind, end = int(line[b] - 1) // 2, b + 1
                    while end < size and line[end] == 2 + 2 * kind:
                        end += 1
                    s, t = int(b) + first, int(end) + first
                    if s < 0 or t > len(texts[i]) or p[np.arange(b, end), j, line[b:end]].min() < sure:
                        continue
                    if plausible(kind, texts[i][s:t]) and not any(s < y and x < t for _, x, y in taken[i]):
                        out[i].append((kind, s, t))
    return [sorted(x) for x in out]


def vary(x: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Copies of windows with phone numbers in other spellings: no plus sign, other separators."""
    rng = np.random.default_rng(seed)
    begin, inside = 1 + 2 * KINDS.index("phone"), 2 + 2 * KINDS.index("phone")
    rows = np.flatnonzero((y == begin).any(axis=1))
    x, y = x[rows].copy(), y[rows].copy()
    signs = np.array([5, 8 + _SINGLE.index("."), 8 + _SINGLE.index("-")])
    separators = [5, *(8 + _SINGLE.index(c) for c in ".-()")]
    for a, b in zip(x, y, strict=True):
        part = (b == begin) | (b == inside)
        swap = part & np.isin(a, separators) & (rng.random(len(a)) < 0.7)
        a[swap] = rng.choice(signs) if rng.random() < 0.5 else rng.choice(signs, swap.sum())
        for i in np.flatnonzero((b == begin) & (a == 8 + _SINGLE.index("+"))):
            if rng.random() < 0.5 and i + 1 < len(a) and b[i + 1] == inside:
                a[i], b[i], b[i + 1] = 5, 0, begin
    return x, y


def fit_tagger(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Tagger | None:
    """A tagger trained on windows of about ``fit_docs`` documents (a hash of the doc_id decides), labelled by the
    patterns, some also in other spellings; None if they hold fewer than five spans. At most ``FIT_WINDOWS`` windows are used."""
    share = min(1.0, fit_docs / max(1, docs.select(F.lit(1)).count()))
    spread = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 40)) / float(1 << 40)

    def run(batches):
        rng = np.random.default_rng(0)
        for batch in batches:
            xs, ys, has = [], [], []
            for text in batch.column("text").to_pylist():
                c = char_classes(text)
                spans = pattern_spans(text)
                starts = windows_of(c)
                x, y = cut(c, starts), cut(span_tags(len(c), spans), starts)
                y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])  # a cut span begins at the edge
                full = y.any(axis=1)
                keep = full | (rng.random(len(full)) < 0.5)
                xs += [a.tobytes() for a in x[keep]]
                ys += [a.tobytes() for a in y[keep]]
                has += full[keep].tolist()
            yield pa.record_batch([pa.array(xs, pa.binary()), pa.array(ys, pa.binary()), pa.array(has, pa.bool_())], ["x", "y", "has"])

    found = docs.where(spread < share).where(F.col("text").rlike(_ANCHOR)).select("text").mapInArrow(tidy(run), "x binary, y binary, has boolean")
    found = found.withColumn("order", F.xxhash64("x", "y"))
    rows = []
    for has in (True, False):
        rows += found.where(F.col("has") == has).orderBy("order", "x", "y").limit(FIT_WINDOWS // 2).collect()
    if sum(r["has"] for r in rows) < 5:
        return None
    x, y = (np.array([np.frombuffer(r[c], np.uint8) for r in rows]).astype(np.int64) for c in ("x", "y"))
    more_x, more_y = vary(x, y)
    tagger = Tagger()
    tagger.fit(np.concatenate([x, more_x]), np.concatenate([y, more_y]))
    return tagger


def find_spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs(text, ...)`` with columns base and spans: arrays of (kind number, start, end); a null text has none."""
    names, span = docs.columns, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [pattern_spans(t) for t in texts]
            rows = [i for i, t in enumerate(texts) if tagger is not None and ("@" in t or _DIGIT.search(t))]
            every = list(base)
            for at in range(0, len(rows), 128):
                part = rows[at:at + 128]
                for i, more in zip(part, added_spans(tagger, [texts[i] for i in part], [base[i] for i in part]), strict=True):
                    every[i] = sorted(base[i] + more)
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in y], span) for y in (base, every)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "base", "spans"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    kind = "array<struct<kind:int,start:int,end:int>>"
    return docs.mapInArrow(tidy(run), f"{kinds}, base {kind}, spans {kind}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced by its kind in brackets (overlapping spans by the first one's).

    Other columns stay; a null text stays null.
    """
    tagger = fit_tagger(docs)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [pattern_spans(t or "") for t in texts]
            out = list(texts)
            rows = [i for i, t in enumerate(texts) if t and ("@" in t or _DIGIT.search(t))]
            for at in range(0, len(rows), 128):
                part = rows[at:at + 128]
                more = added_spans(tagger, [texts[i] for i in part], [base[i] for i in part]) if tagger else [[]] * len(part)
                for i, m in zip(part, more, strict=True):
                    out[i] = mask(texts[i], base[i] + m)
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array(out, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), ", ".join(f"`{n}` {'string' if n == 'text' else t}" for n, t in docs.dtypes)).select(names)


def mask(text: str, spans) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = find_spans(docs, fit_tagger(docs)).drop("text")
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
