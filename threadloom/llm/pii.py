"""Personal information in free text: a linear-chain conditional random field over word shapes.

Each line of a text is a sequence of tokens; the field labels them by kind of mention. It is trained on the lines of the small
labelled table (`pii_table`) by maximum likelihood, with the same numpy code on every machine, and decoded by Viterbi over
batches of lines of similar length. Its features are shapes, endings and surroundings of tokens. What a token adds to the
scores is worked out once per worker and token; equal lines of a batch are decoded once.

A mention must also hold what its kind can't be without: an e-mail address a sign or word for "at", a phone or identity number
enough digits, a name two words with capitals, an address a digit. Lines that hold none of these aren't tagged at all.

The field is trained from `pii_table` alone, once per process; where the session names a shared folder (`MODELS` or
spark.checkpoint.dir) the weights are kept there under a hash of the table and the training's parameters, and later sessions read them.

Null and empty texts have no mention. Names in scripts without capitals (Chinese, Japanese, Arabic and so on) aren't found.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import pii_table

KINDS = ("email", "phone", "identity_number", "street_address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]", "name": "[NAME]"}
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
LINES, EPOCHS, RATE, DECAY = 20_000, 4, 0.05, 1e-6
#: The share of words that the training hides, and the features that stay.
HIDDEN, PLAIN = 0.15, ("s=", "t=", "n=")
#: What is added to the scores of a kind's labels when decoding: a mention left in clear costs more than one found too much. Chosen among
#: a handful of settings by the totals on the hand-written lines and on sf0.1, so figures on these two are no held-out figures.
FAVOUR = {"name": 1.0, "identity_number": 1.6, "phone": 1.3, "street_address": 1.0, "email": 1.0}

TOKEN = re.compile(r"(\w+(?:[.'’+-]+\w+)*|[^\w\s])")
RUN = regex.compile(r"\p{Lu}+|[^\W\d_\p{Lu}]+|\d+")
#: Where weights are kept; without it a folder below spark.checkpoint.dir.
MODELS = "spark.threadloom.models"


def shape(token: str, lengths: bool) -> str:
    """Runs of capitals, small letters and digits as X, x, d; digits with their number if `lengths`."""
    return RUN.sub(lambda m: "X" if m[0][0].isupper() else ("d" + str(min(len(m[0]), 12)) if lengths else "d") if m[0][0].isdigit() else "x", token)[:16]


def parts(token: str) -> tuple[str, str, str, list[str]]:
    """(word or shape, short shape, ending, all features at its own place) of a token."""
    low, short = token.lower(), shape(token, False)
    letters = low.replace("-", "").replace("'", "").isalpha()
    own = ["s=" + shape(token, True), "t=" + short, "n=" + str(min(len(token), 14))]
    if letters or not low[0].isalnum():
        own.append("w=" + low)
    if letters:
        own += ["p=" + low[:3], "x=" + low[-3:], "y=" + low[-4:], "z=" + low[-2:], "c=" + short + low[-3:]]
    return ("w=" + low if letters or not low[0].isalnum() else "t=" + short), short, low[-3:] if letters else "", own


class Model:
    """Weights by feature, and for pairs of neighbours dense tables by class and short shape."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, classes: dict[str, int], shapes: dict[str, int]) -> None:
        self.index, self.weights, self.transitions, self.classes, self.shapes = index, weights, transitions, classes, shapes

    def table(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Scores of a pair feature, [rows * columns, labels]."""
        out = np.zeros((rows * columns, len(LABELS)), np.float32)
        for feature, k in self.index.items():
            if feature.startswith(name):
                a, b = feature[len(name) :].split(",")
                out[int(a) * columns + int(b)] = self.weights[k]
        return out


#: Unary features by offset: what of a token counts at its neighbours.
def unary(token: str | None) -> dict[int, list[str]]:
    if token is None:
        return {o: [f"{o}:none"] for o in (-2, -1, 1, 2)} | {0: []}
    word, short, end, own = parts(token)
    near = [word, "t=" + short, own[0], "x=" + end]
    return {0: ["0:" + f for f in own], -1: ["-1:" + f for f in near], 1: ["1:" + f for f in near], -2: ["-2:" + f for f in near[:2]], 2: ["2:" + f for f in near[:2]]}


def read_lines(rows: list[list[tuple[str, str | None]]]) -> list[tuple[list[str], list[int], list[int]]]:
    """Labelled parts as lines of (tokens, blanks before them, labels)."""
    out = []
    for row in rows:
        text, spans = "", []
        for piece, kind in row:
            if kind:
                spans.append((len(text), len(text) + len(piece), KINDS.index(kind)))
            text += piece
        at = 0
        for line in text.split("\n"):
            found = TOKEN.split(line)
            tokens, gaps = found[1::2], found[0::2]
            place, labels, blanks = at, [], []
            for k, token in enumerate(tokens):
                place += len(gaps[k])
                hit = next((s for s in spans if s[0] <= place < s[1]), None)
                labels.append(0 if hit is None else 1 + 2 * hit[2] + (place > hit[0]))
                blanks.append(2 if not k else int(bool(gaps[k])))
                place += len(token)
            if tokens:
                out.append((tokens, blanks, labels))
            at += len(line) + 1
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, each repeated count times, with first, first + 1, ... beside them."""
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@lru_cache(maxsize=2)
def train(lines: int = LINES, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Maximum likelihood by Adam over batches of lines of the table; a weight decay keeps rare features small."""
    data = read_lines(pii_table.labelled(lines, seed))
    seen = Counter(t for tokens, _, _ in data for t in tokens)
    info = {t: (parts(t), unary(t)) for t in seen}
    often = Counter()
    for t, n in seen.items():
        often[info[t][0][0]] += n
    classes = {"?": 0, "none": 1} | {c: k + 2 for k, c in enumerate(c for c, n in sorted(often.items()) if n >= 4)}
    shapes = {"?": 0, "none": 1} | {s: k + 2 for k, s in enumerate(s for s, _ in Counter(x[0][1] for x in info.values()).most_common(60))}
    index: dict[str, int] = {}
    edge = unary(None)
    rows: list[list[int]] = []
    chance = np.random.default_rng(seed)
    for tokens, blanks, _ in data:
        hidden = (chance.random((len(tokens), 5)) < HIDDEN).tolist()  # words are hidden now and then: by themselves, and from each neighbour
        cls = [1, *(classes.get(info[t][0][0], 0) for t in tokens), 1]
        shp = [1, *(shapes.get(info[t][0][1], 0) for t in tokens), 1]
        for k, t in enumerate(tokens):
            near = {o: (info[tokens[k + o]][1] if 0 <= k + o < len(tokens) else edge)[o] for o in (-2, -1, 1, 2)}
            own, hide = info[t][1][0], dict(zip((0, -2, -1, 1, 2), hidden[k], strict=True))
            names = [f for f in own if f[2:4] in PLAIN] if hide[0] else list(own)
            for o, some in near.items():
                names += some[1:] if hide[o] and len(some) > 1 else some
            names += [f"b{blanks[k]}", f"a{blanks[k + 1] if k + 1 < len(tokens) else 2}"]
            names += [f"L{0 if hide[-1] and k else cls[k]},{shp[k + 1]}", f"R{0 if hide[1] and k + 1 < len(tokens) else cls[k + 2]},{shp[k + 1]}", f"S{shp[k]},{shp[k + 2]}", f"B{blanks[k]},{shp[k + 1]}"]
            rows.append([index.setdefault(f, len(index)) for f in names])
    count, labels = len(index), len(LABELS)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, of = np.fromiter((f for r in rows for f in r), np.int64, int(size.sum())), np.repeat(np.arange(len(rows)), size)
    first = np.cumsum([0, *(len(t) for t, _, _ in data)])
    gold = np.array([y for _, _, ys in data for y in ys])
    begin = np.r_[0, np.cumsum(size)]
    w, trans = np.zeros((count, labels), np.float32), np.zeros((labels, labels))
    seen_w, seen_t = [np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(trans), np.zeros_like(trans)]
    by_length = np.argsort(np.diff(first) + chance.random(len(data)), kind="stable")  # lines of like length go together
    batches = []
    for some in np.array_split(by_length, max(1, len(data) // 200)):
        length = np.diff(first)[some]
        at = first[some][:, None] + np.minimum(np.arange(length.max()), length[:, None] - 1)
        live = np.arange(length.max()) < length[:, None]
        tokens = at[live]
        row, entry = _spread(begin[tokens], size[tokens])
        order = np.argsort(flat[entry], kind="stable")
        names = flat[entry][order]
        head = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        batches.append((length, at, live, entry, np.r_[0, np.cumsum(size[tokens])[:-1]], row[order], head, names[head]))

    def adam(x, g, m, v, rate, step):
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        return x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6), m, v

    step = 0
    for epoch in range(epochs):
        for k in chance.permutation(len(batches)):
            step += 1
            length, at, live, entry, starts, by_name, head, names = batches[k]
            most, n = int(length.max()), len(length)
            e = np.zeros((*at.shape, labels))
            e[live] = np.add.reduceat(w[flat[entry]], starts, axis=0)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, most):
                alpha[:, t] = np.where(live[:, t, None], _lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t], alpha[:, t - 1])
            for t in range(most - 2, -1, -1):
                beta[:, t] = np.where(live[:, t + 1, None], _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            z = _lse(alpha[np.arange(n), length - 1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
            y = gold[at]
            p[np.arange(n)[:, None], np.arange(most), y] -= live
            g_t = np.zeros_like(trans)
            for t in range(1, most):
                on = live[:, t]
                if on.any():
                    g_t += np.exp(alpha[on, t - 1, :, None] + trans + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None]).sum(0)
                    np.subtract.at(g_t, (y[on, t - 1], y[on, t]), 1)
            g_w = np.add.reduceat(p[live].astype(np.float32)[by_name], head, axis=0)
            rate = RATE * (1 - epoch / (epochs + 1))
            # a feature's weight moves only in batches that hold it
            w[names], seen_w[0][names], seen_w[1][names] = adam(w[names], g_w / n + DECAY * w[names], seen_w[0][names], seen_w[1][names], rate, step)
            trans, seen_t[0], seen_t[1] = adam(trans, g_t / n + DECAY * trans, seen_t[0], seen_t[1], rate, step)
    return Model(index, w, trans.astype(np.float32), classes, shapes)


def pack(model: Model) -> bytes:
    """A model as bytes, read again by `unpack`."""
    out = io.BytesIO()
    names = lambda d: np.frombuffer("\n".join(d).encode(), np.uint8)  # noqa: E731 - keys stand in the order of their numbers
    np.savez_compressed(out, index=names(model.index), weights=model.weights, transitions=model.transitions, classes=names(model.classes), shapes=names(model.shapes))
    return out.getvalue()


def unpack(data: bytes) -> Model:
    x = np.load(io.BytesIO(data), allow_pickle=False)
    numbered = lambda a: {n: k for k, n in enumerate(a.tobytes().decode().split("\n"))}
    return Model(numbered(x["index"]), x["weights"], x["transitions"], numbered(x["classes"]), numbered(x["shapes"]))


def fingerprint(*params: object) -> str:
    """Hash of the training table, of this module and of the training's parameters."""
    from pathlib import Path

    return hashlib.sha256(repr(params).encode() + Path(pii_table.__file__).read_bytes() + Path(__file__).read_bytes()).hexdigest()[:24]


def trained(spark: SparkSession, lines: int = LINES, epochs: int = EPOCHS) -> Model:
    """The field's weights: from this process, from the shared folder if the session names one, else trained (and kept there).

    Two sessions that train at the same time write the same weights; an unreadable file counts as none.
    """
    key = (lines, epochs)
    if key in _TRAINED:
        return _TRAINED[key]
    folder = spark.conf.get(MODELS, None) or spark.conf.get("spark.checkpoint.dir", None)
    path = folder and f"{folder.rstrip('/')}/threadloom-models/pii-{fingerprint(*key)}"
    model = None
    if path:
        try:
            model = unpack(bytes(spark.read.parquet(path).first().data))
        except Exception:  # noqa: BLE001 - absent or half written
            model = None
    if model is None:
        model = train(lines, epochs)
        if path:
            try:
                spark.createDataFrame([(bytearray(pack(model)),)], "data binary").coalesce(1).write.mode("overwrite").parquet(path)
            except Exception:  # noqa: BLE001 - the folder can't be written: go on with the model at hand
                pass
    _TRAINED[key] = model
    return model


_TRAINED: dict[tuple[int, int], Model] = {}


def viterbi(e: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Most probable labels of padded sequences, e [sequences, steps, labels]."""
    rows, most, labels = e.shape
    back = np.zeros((most, rows, labels), np.int8)
    best = e[:, 0].copy()
    into = np.ascontiguousarray(trans.T)
    for t in range(1, most):
        on = int(np.searchsorted(-length, -t, "left"))  # sequences come longest first
        score = best[:on, None, :] + into
        k = score.argmax(2)
        back[t, :on] = k
        best[:on] = np.take_along_axis(score, k[..., None], 2)[..., 0] + e[:on, t]
    out = np.zeros((rows, most), np.int8)
    now = best.argmax(1)
    for t in range(most - 1, -1, -1):
        on = int(np.searchsorted(-length, -t, "left"))
        out[:on, t] = now[:on]
        now[:on] = back[t, np.arange(on), now[:on]]
    return out


class Tagger:
    """Decodes texts; keeps the scores of each distinct token."""

    KEEP, BLOCK = 300_000, 60_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.n_shapes = len(model.shapes)
        self.left, self.right = (model.table(x, len(model.classes), self.n_shapes) for x in "LR")
        self.around, self.blank = model.table("S", self.n_shapes, self.n_shapes), model.table("B", 3, self.n_shapes)
        w = lambda f: model.weights[model.index[f]] if f in model.index else np.zeros(len(LABELS), np.float32)
        self.before, self.after = (np.stack([w(f"{x}{k}") for k in range(3)]) for x in "ba")
        self.favour = np.array([0.0, *(FAVOUR.get(k, 0.0) for k in KINDS for _ in "BI")], np.float32)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.cls, self.shp = np.array([1]), np.array([1])
        self.scores = {o: self._sum([unary(None)[o]]) for o in (-2, -1, 0, 1, 2)}

    def _sum(self, rows: list[list[str]]) -> np.ndarray:
        index, weights = self.model.index, self.model.weights
        out = np.zeros((len(rows), len(LABELS)), np.float32)
        for k, names in enumerate(rows):
            found = [index[f] for f in names if f in index]
            if found:
                out[k] = weights[found].sum(0)
        return out

    def _learn(self, tokens: set[str]) -> None:
        new = list(tokens)
        known = len(self.cls)
        all_ = [unary(t) for t in new]
        for o in self.scores:
            self.scores[o] = np.vstack([self.scores[o], self._sum([u[o] for u in all_])])
        info = [parts(t) for t in new]
        self.cls = np.r_[self.cls, [self.model.classes.get(i[0], 0) for i in info]]
        self.shp = np.r_[self.shp, [self.model.shapes.get(i[1], 0) for i in info]]
        self.ids.update((t, known + k) for k, t in enumerate(new))

    def lines(self, lines: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the mentions in each line."""
        if len(self.ids) > self.KEEP:
            self.clear()
        tokens: list[str] = []
        starts, ends, sizes, gap = [], [], np.zeros(len(lines), np.int64), []
        for k, line in enumerate(lines):
            found = TOKEN.split(line)
            at = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            tokens += found[1::2]
            starts.append(at[0:-1:2])
            ends.append(at[1::2])
            sizes[k] = len(found) // 2
        out: list[list[tuple[int, int, int]]] = [[] for _ in lines]
        if not tokens:
            return out
        ids = list(map(self.ids.get, tokens))
        if None in ids:
            self._learn({t for t, i in zip(tokens, ids, strict=True) if i is None})
            ids = list(map(self.ids.get, tokens))
        tid, start, end = np.array(ids), np.concatenate(starts), np.concatenate(ends)
        head = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(lines)), sizes)
        place = np.arange(len(tid)) - head[row]
        left = sizes[row] - 1 - place
        blank = np.where(place == 0, 2, np.r_[0, (start[1:] > end[:-1])].astype(np.int64))
        moved = {}
        for o in (-2, -1, 1, 2):
            x = np.zeros_like(tid)
            if o < 0:
                x[-o:] = tid[:o]
                x[place < -o] = 0
            else:
                x[:-o] = tid[o:]
                x[left < o] = 0
            moved[o] = x
        following = np.where(left == 0, 2, np.r_[blank[1:], 2])
        shp, labels = self.shp[tid], len(LABELS)
        e = np.empty((len(tid), labels), np.float32)
        for lo in range(0, len(tid), 200_000):
            s = slice(lo, lo + 200_000)
            x = self.scores[0][tid[s]] + self.before[blank[s]] + self.after[following[s]] + self.blank[blank[s] * self.n_shapes + shp[s]]
            for o, m in moved.items():
                x += self.scores[o][m[s]]
            x += self.left[self.cls[moved[-1][s]] * self.n_shapes + shp[s]]
            x += self.right[self.cls[moved[1][s]] * self.n_shapes + shp[s]]
            x += self.favour
            x += self.around[self.shp[moved[-1][s]] * self.n_shapes + self.shp[moved[1][s]]]
            e[s] = x
        best = np.zeros(len(tid), np.int8)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        lo = 0
        while lo < len(order):
            most = int(sizes[order[lo]])
            some = order[lo : lo + max(1, self.BLOCK // most)]
            lo += len(some)
            n = sizes[some]
            at = head[some][:, None] + np.minimum(np.arange(most), n[:, None] - 1)
            y = viterbi(e[at], n, self.model.transitions)
            live = np.arange(most) < n[:, None]
            best[at[live]] = y[live]
        kind = (best.astype(np.int64) + 1) // 2
        opens = (best > 0) & ((best % 2 == 1) | (place == 0) | (np.r_[0, kind[:-1]] != kind))
        for a in np.flatnonzero(opens):
            b = a + 1
            while b < len(tid) and row[b] == row[a] and kind[b] == kind[a] and not opens[b]:
                b += 1
            k = int(kind[a]) - 1
            if holds(KINDS[k], lines[row[a]][start[a] : end[b - 1]]):
                out[row[a]].append((k, int(start[a]), int(end[b - 1])))
        return out

    def texts(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        split = [t.split("\n") if t else [] for t in texts]
        unique = [x for x in dict.fromkeys(x for lines in split for x in lines if x) if may_hold(x)]
        known = dict(zip(unique, self.lines(unique), strict=True))
        out = []
        for lines in split:
            found, at = [], 0
            for line in lines:
                found += [(k, at + a, at + b) for k, a, b in known.get(line, ())]
                at += len(line) + 1
            out.append(found)
        return out


CAPITAL = regex.compile(r"(?<![\p{L}\p{N}_])[^\W\d_]*\p{Lu}")
#: A capital inside a word that no prefix of family names explains, and a word that is too long for a particle.
INNER = regex.compile(r"(?<!\b(?:Ma?c|De|Di|Du|Da|Del|Des|La|Le|Lo|Van|Von|Fitz|Ver|Ter|Ten|St))(?<=\p{Ll})\p{Lu}")
SMALL = regex.compile(r"(?<![\p{L}'’.-])\p{Ll}{5,}(?!\p{L})")
NO_NUMBER = re.compile(r"(?i)(?!ext|tel)[^\W\d_]{3}|[^\W\d_]\d*[^\W\d_]\d")
AT = re.compile(r"@|\bat\b|_at_", re.IGNORECASE)


def holds(kind: str, text: str) -> bool:
    """What a mention of a kind can't be without."""
    digits = sum(map(str.isdigit, text))
    if kind == "email":
        return bool(AT.search(text) and re.search(r"\.|dot|d0t", text, re.IGNORECASE))
    if kind == "name":
        if INNER.search(text) or SMALL.search(text):
            return False
        return not digits and not re.search(r"[^\W\d_]{3,}\. ", text) and len(re.findall(r"[^\W\d_]+(?:[.'’-]+[^\W\d_]+)*", text)) > 1 and len(CAPITAL.findall(text)) > 1
    if kind == "phone" and NO_NUMBER.search(text) or kind == "identity_number" and len(text) > 32:
        return False
    if kind == "street_address" and not re.search(r"\s", text):
        return False
    return digits >= {"phone": 7, "identity_number": 6, "street_address": 1}[kind]


def may_hold(line: str) -> bool:
    """Whether a line has what a mention of some kind needs (see `holds`)."""
    return bool(DIGIT_OR_AT.search(line)) or bool(TWO_CAPITALS.search(line))


DIGIT_OR_AT = re.compile(r"\d|@|\bat\b|_at_", re.IGNORECASE)
TWO_CAPITALS = regex.compile(r"(?<![\p{L}\p{N}_])[^\W\d_]*\p{Lu}.*?[^\p{L}\p{N}_][^\W\d_]*\p{Lu}")


_TAGGER: dict[tuple, Tagger] = {}


def tagger(mark: tuple, model: Model) -> Tagger:
    """One tagger per worker process and model."""
    if mark not in _TAGGER:
        _TAGGER.clear()
        _TAGGER[mark] = Tagger(model)
    return _TAGGER[mark]


def bodies(curated: DataFrame) -> DataFrame:
    """``record_id, texts``: input_vector.body, then the bodies of the thread in order."""
    return curated.select("record_id", F.concat(F.array("input_vector.body"), F.coalesce(F.transform("deliberation_thread", lambda x: x["body"]), F.array().cast("array<string>"))).alias("texts"))


def mentions(records: DataFrame, lines: int = LINES) -> DataFrame:
    """``record_id, thread_pos, pii_kind, start_pos, end_pos`` of every mention in ``record_id, texts``; thread_pos starts at -1.

    Positions are code points. Repeated rows give repeated mentions.
    """
    return _run(records, lines, False)


def redact(records: DataFrame, lines: int = LINES) -> DataFrame:
    """``record_id, thread_pos, text, mentions``: each text with placeholders for its mentions, all else unchanged; nulls stay."""
    return _run(records, lines, True)


def _run(records: DataFrame, lines: int, redacted: bool) -> DataFrame:
    model = records.sparkSession.sparkContext.broadcast(trained(records.sparkSession, lines))  # weights, of the table's size
    schema = "record_id long, thread_pos int, text string, mentions int" if redacted else "record_id long, thread_pos int, pii_kind string, start_pos int, end_pos int"
    types = (pa.int64(), pa.int32(), pa.string(), pa.int32()) if redacted else (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())

    def run(batches):
        worker = tagger((lines,), model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                flat, rows = [], []
                for i, texts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for k, text in enumerate(texts or ()):
                        flat.append(text)
                        rows.append((i, k - 1))
                out = []
                for (i, k), text, found in zip(rows, flat, worker.texts(flat), strict=True):
                    if redacted:
                        pieces, at = [], 0
                        for kind, a, b in found:
                            pieces += [text[at:a], PLACEHOLDERS[KINDS[kind]]]
                            at = b
                        out.append((i, k, None if text is None else "".join(pieces) + text[at:], len(found)))
                    else:
                        out += [(i, k, KINDS[kind], a, b) for kind, a, b in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return records.select(F.col("record_id").cast("long").alias("record_id"), "texts").mapInArrow(run, schema)
