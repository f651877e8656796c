"""Languages of documents and of their passages: unigram pieces, summed over all segmentations.

Every language has probabilities for the pieces of one fixed public vocabulary. The score of a word is the sum over all ways
to cut it into pieces of the product of their probabilities, by a forward pass; a sentence's score is the product over its
words. As no piece spans a blank, and none spans two characters that no piece holds side by side, the text is cut there
first: the sum over segmentations of the whole is the product of those of the parts, and each part is scored once per worker.

The probabilities are trained by expectation-maximisation (the same forward pass, with a backward one) on a bounded sample of
documents with a label (`SAMPLE`, of which `CALIBRATED` are calibrated on), whose wrong labels are then corrected sentence by sentence by the model itself and the
training repeated. A few sentences per language (`SEEDS`) tie each language to its name where labels are few.

How sure a language is is calibrated. Beside the languages stands a background, whose piece probabilities are the mean of all of
theirs and a uniform share; log scores are divided by a power of the number of words and a temperature before they become
probabilities. Power, temperature and the background's weight are those under which the training sentences are most likely:
each as what it is, and each once more with its own language taken away, when the background is the right answer.

A sentence is a run of at least `WORDS` words, of all scripts, up to a full stop, question or exclamation mark. Code blocks,
lines of logs, headings and identifiers hold no sentence and no words. Null and empty texts have no passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE, SAMPLE_CHARS, ROUNDS, STEPS, CALIBRATED = 2_000, 20_000, 3, 3, 500
#: Words of a sentence at least; in training, the length in which very long parts of words are taken; positions between rescalings.
WORDS, UNIT, RESCALE = 2, 48, 24
#: What the calibration chooses from: the background's uniform share, powers of the number of words, temperatures, background offsets.
UNIFORM, POWERS, TEMPERATURES, OFFSETS = 0.3, (0.0, 0.25, 0.5, 0.75, 1.0), tuple(0.06 * 1.4**k for k in range(16)), (-4.0, -2.0, 0.0, 2.0, 4.0, 6.0, 8.0, 11.0, 15.0, 20.0)
SEGMENTS = "doc_id long, segment_no int, start_pos int, end_pos int, lang string, confidence double, sentences int"

#: Plain sentences of each language, written for this table; what each says doesn't matter.
SEEDS = {
    "en": "The file could not be opened because the name was wrong. We will look at this again after the next release, if that is fine with you. Has anyone seen the same problem with the new version? There are more than ten open entries and nobody knows why. Thanks for the hint, I have tried it and now it works as before.",
    "de": "Die Datei konnte nicht geöffnet werden, weil der Name falsch war. Wir werden uns das nach der nächsten Veröffentlichung noch einmal ansehen, wenn das für dich in Ordnung ist. Hat jemand dasselbe Problem mit der neuen Version? Es gibt mehr als zehn offene Einträge und niemand weiß, warum. Danke für den Hinweis, ich habe es versucht und jetzt läuft es wieder wie vorher.",
    "nl": "Het bestand kon niet worden geopend omdat de naam verkeerd was. Wij zullen hier na de volgende uitgave nog eens naar kijken, als dat goed is voor jou. Heeft iemand hetzelfde probleem met de nieuwe versie? Er zijn meer dan tien open regels en niemand weet waarom. Bedankt voor de tip, ik heb het geprobeerd en nu werkt het weer zoals eerst.",
    "fr": "Le fichier n'a pas pu être ouvert parce que le nom était faux. Nous allons regarder cela encore une fois après la prochaine version, si cela vous convient. Est-ce que quelqu'un a le même problème avec la nouvelle version ? Il y a plus de dix entrées ouvertes et personne ne sait pourquoi. Merci pour le conseil, je l'ai essayé et maintenant cela marche comme avant.",
    "es": "El archivo no se pudo abrir porque el nombre era incorrecto. Vamos a mirar esto otra vez después de la próxima versión, si te parece bien. ¿Alguien tiene el mismo problema con la nueva versión? Hay más de diez entradas abiertas y nadie sabe por qué. Gracias por el consejo, lo he probado y ahora funciona como antes.",
    "pt": "O arquivo não pôde ser aberto porque o nome estava errado. Vamos olhar para isto outra vez depois da próxima versão, se estiver bem para você. Alguém tem o mesmo problema com a nova versão? Há mais de dez entradas abertas e ninguém sabe por quê. Obrigado pela dica, eu tentei e agora funciona como antes.",
    "it": "Il file non si poteva aprire perché il nome era sbagliato. Guarderemo questo ancora una volta dopo la prossima versione, se per te va bene. Qualcuno ha lo stesso problema con la nuova versione? Ci sono più di dieci voci aperte e nessuno sa perché. Grazie per il consiglio, l'ho provato e adesso funziona come prima.",
    "pl": "Nie można było otworzyć pliku, ponieważ nazwa była błędna. Po następnym wydaniu spojrzymy na to jeszcze raz, jeśli ci to odpowiada. Czy ktoś ma ten sam problem z nową wersją? Jest więcej niż dziesięć otwartych wpisów i nikt nie wie dlaczego. Dziękuję za wskazówkę, spróbowałem i teraz działa tak jak przedtem.",
    "ru": "Файл не удалось открыть, потому что имя было неверным. Мы посмотрим на это ещё раз после следующего выпуска, если вам это подходит. Есть ли у кого-нибудь та же проблема с новой версией? Открыто больше десяти записей, и никто не знает почему. Спасибо за подсказку, я попробовал, и теперь всё работает как раньше.",
    "ja": "名前が間違っていたので、ファイルを開くことができませんでした。よければ次のリリースの後でもう一度確認します。新しいバージョンで同じ問題がある人はいますか。開いている項目は十個以上ありますが、理由は誰にもわかりません。教えてくれてありがとうございます、試したら前のように動くようになりました。",
    "zh": "因为名字错了，所以文件打不开。如果你觉得可以，我们会在下一个版本之后再看一次。有人在新版本里遇到同样的问题吗？有十多个打开的条目，而且没有人知道为什么。谢谢你的提示，我试过了，现在又像以前一样正常工作了。",
}

#: What has no language: code blocks, identifiers, paths, numbers.
SKIP = (
    r"```.*?(?:```|\Z)|`[^`\n]*+`"
    r"|(?:[A-Za-z][a-z]*+[A-Z0-9_@/\\=#$%+~]|[0-9_@/\\=#$%+~])[A-Za-z0-9_]*+(?:[.@/\\:=#$%+~-]*+[A-Za-z0-9_]++)*+(?:\(\))?"
    r"|[A-Za-z]++\(\)"
)
#: All that a text is made of but blanks and punctuation inside sentences; plain words come first, as most tokens are.
SCAN = re.compile(rf"([A-Za-z]?[a-z]++(?=[ ,;\n]|[.!?:](?:[ \n]|\Z))|{SKIP}|[^\W\d_\u3040-\u9fff]++(?:['’][^\W\d_\u3040-\u9fff]++)*+|[\u3040-\u9fff]++|[.!?…]++(?=[\s\"'»”)\]]|\Z)|[。！？]|\n)", re.DOTALL)
NO_WORD = re.compile(SKIP, re.DOTALL)
#: Sentences in capitals are no identifiers.
SHOUT = re.compile(r"[A-Z]{2,}(?: [A-Z]{2,}){3,}")
ENDS = frozenset("。！？")


def scan(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of a text with their starts and ends."""
    parts = SCAN.split(SHOUT.sub(lambda m: m[0].lower(), text))
    at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return parts[1::2], at[0:-1:2], at[1::2]


class Vocabulary:
    """The public pieces, and the characters that never stand side by side in one."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.size = len(names)
        self.ids = {n: i for i, n in enumerate(names) if not (n[0] == "<" and n[-1] == ">")}
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(names) if re.fullmatch("<0x..>", n)}
        self.heads = {n[:k] for n in self.ids for k in range(2, len(n) + 1)}
        self.longest = max(len(n) for n in self.ids)
        self.side_by_side = {n[k : k + 2] for n in self.ids for k in range(len(n) - 1)}

    def units(self, word: str, most: int = 0) -> list[str]:
        """Parts of a word (with its leading blank) that segmentations can't bridge; with `most`, longer ones in that length."""
        s = "▁" + word.lower()
        cut = [0, *(k for k in range(1, len(s)) if s[k - 1 : k + 1] not in self.side_by_side), len(s)]
        return [s[k : min(k + most, b) if most else b] for a, b in zip(cut, cut[1:], strict=False) for k in range(a, b, most or max(1, b - a))]

    def spans(self, unit: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, ids) of the pieces in a unit; a character that is no piece is spelled in bytes."""
        out = []
        for a in range(len(unit)):
            for b in range(a + 1, min(len(unit), a + self.longest) + 1):
                if b > a + 1 and unit[a:b] not in self.heads:
                    break
                if (k := self.ids.get(unit[a:b])) is not None:
                    out.append((a, b, (k,)))
                elif b == a + 1:
                    out.append((a, b, tuple(self.bytes[x] for x in unit[a:b].encode("utf-8", "replace"))))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str = PIECES) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Segmentation lattices of many units at once, ordered so that a pass goes end by end over all of them."""

    def __init__(self, vocab: Vocabulary, units: list[str]) -> None:
        self.longest = vocab.longest
        self.n, self.length = len(units), np.array([len(u) for u in units], np.int64)
        base = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1]
        flat = [(b, base[i] + a, base[i] + b, ids) for i, u in enumerate(units) for a, b, ids in vocab.spans(u)]
        flat.sort(key=lambda x: x[0])
        self.level = np.array([x[0] for x in flat], np.int64)
        self.start, self.end = (np.array([x[k] for x in flat], np.int64) for k in (1, 2))
        width = max((len(x[3]) for x in flat), default=1)
        self.pieces = np.full((len(flat), width), vocab.size, np.int64)  # the last row of a table of probabilities is 1
        for r, x in enumerate(flat):
            self.pieces[r, : len(x[3])] = x[3]
        self.first, self.last, self.nodes = base, base + self.length, int((self.length + 1).sum())
        self.cuts = np.searchsorted(self.level, np.arange(1, (self.length.max() if self.n else 0) + 2))

    def weights(self, prob: np.ndarray) -> np.ndarray:
        w = prob[self.pieces[:, 0]]
        for k in range(1, self.pieces.shape[1]):
            w = w * prob[self.pieces[:, k]]
        return w

    def forward(self, w: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
        """Sums up to each node. With `scale` [units, columns] they are rescaled on the way, all that later ones are made of at once,
        and the logarithms of the factors added up there: no length of unit makes them vanish."""
        alpha = np.zeros((self.nodes, w.shape[1]))
        alpha[self.first] = 1
        for level, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if scale is not None and level and level % RESCALE == 0:
                live = np.flatnonzero(self.length > level)
                back = self.first[live][:, None] + level - np.arange(min(self.longest, level + 1))
                top = np.maximum(alpha[back].max(1), 1e-300)
                alpha[back] /= top[:, None]
                scale[live] += np.log(top)
            if a < b:
                part = alpha[self.start[a:b]] * w[a:b]
                order = np.argsort(self.end[a:b], kind="stable")
                ends = self.end[a:b][order]
                head = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
                alpha[ends[head]] = np.add.reduceat(part[order], head, axis=0)
        return alpha

    def backward(self, w: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.nodes, w.shape[1]))
        beta[self.last] = 1
        for level in range(int(self.length.max()) - 1, -1, -1):
            at = np.flatnonzero(self.start_level == level)
            if len(at):
                part = beta[self.end[at]] * w[at]
                order = np.argsort(self.start[at], kind="stable")
                starts = self.start[at][order]
                head = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1]])
                beta[starts[head]] += np.add.reduceat(part[order], head, axis=0)
        return beta

    @property
    def start_level(self) -> np.ndarray:
        return self.level - (self.end - self.start)

    def log_scores(self, prob: np.ndarray) -> np.ndarray:
        """Per unit and language the logarithm of the sum over all segmentations."""
        if not self.n:
            return np.zeros((0, prob.shape[1]))
        scale = np.zeros((self.n, prob.shape[1]))
        return np.log(np.maximum(self.forward(self.weights(prob), scale)[self.last], 1e-300)) + scale


def with_one(prob: np.ndarray) -> np.ndarray:
    return np.vstack([prob, np.ones((1, prob.shape[1]))])


def fit(vocab: Vocabulary, counts: list[Counter], steps: int = STEPS) -> np.ndarray:
    """Piece probabilities [pieces, languages] from word counts per language."""
    unit_count: dict[str, np.ndarray] = {}
    for k, words in enumerate(counts):
        for word, n in words.items():
            for u in vocab.units(word, UNIT):
                unit_count.setdefault(u, np.zeros(len(counts)))[k] += n
    units = list(unit_count)
    weight = np.array([unit_count[u] for u in units])
    lattice = Lattice(vocab, units)
    owner = np.repeat(np.arange(lattice.n), lattice.length + 1)[lattice.start]
    prob = np.full((vocab.size, len(counts)), 1.0 / vocab.size)
    for _ in range(steps):
        w = lattice.weights(with_one(prob))
        alpha, beta = lattice.forward(w), lattice.backward(w)
        whole = np.maximum(alpha[lattice.last], 1e-300)
        soft = alpha[lattice.start] * w * beta[lattice.end] / whole[owner] * weight[owner]
        seen = np.zeros((vocab.size + 1, len(counts)))
        for k in range(lattice.pieces.shape[1]):
            np.add.at(seen, lattice.pieces[:, k], soft)
        seen = seen[:-1]
        mean = (seen / np.maximum(seen.sum(0), 1)).mean(1, keepdims=True)
        back = 0.9 * mean / max(mean.sum(), 1e-9) + 0.1 / vocab.size
        mass = np.maximum(50.0, 0.01 * seen.sum(0))
        prob = (seen + mass * back) / (seen.sum(0) + mass)
    return prob


@dataclass(frozen=True)
class Model:
    """Piece probabilities [pieces, languages and the background last], and the calibration of scores."""

    prob: np.ndarray
    power: float = 0.5
    temperature: float = 1.0
    offset: float = 0.0

    def posterior(self, scores: np.ndarray, words: np.ndarray) -> np.ndarray:
        """[sentences, languages and background] from log scores and the numbers of words."""
        return posterior(calibrated(scores, words, self.power, self.temperature, self.offset))


def calibrated(scores: np.ndarray, words: np.ndarray, power: float, temperature: float, offset: float) -> np.ndarray:
    out = scores / (temperature * np.maximum(words, 1.0)[:, None] ** power)
    out[:, -1] += offset
    return out


def with_background(prob: np.ndarray) -> np.ndarray:
    mean = prob.mean(1, keepdims=True)
    return np.hstack([prob, (1 - UNIFORM) * mean + UNIFORM / len(prob)])


def calibrate(prob: np.ndarray, texts: list[str], path: str = PIECES, most: int = 4000) -> Model:
    """The calibration under which sentences of the sample, at most `most`, are most likely with their language and without it.

    A language counts as left out by taking its column away and out of the background's mean. Without sentences: the defaults.
    """
    model, langs = Model(with_background(prob)), prob.shape[1]
    # beside the background also those that are left when one language is taken away, all scored at once
    without = [with_background(np.delete(prob, k, axis=1))[:, -1:] for k in range(langs)] if langs > 1 else []
    _, _, _, scores, words, _, _ = Scorer(np.hstack([model.prob, *without]), path).sentences(texts)
    if not len(scores) or not without:
        return model
    some = np.linspace(0, len(scores) - 1, min(most, len(scores))).astype(int)
    scores, words = scores[some], words[some]
    own, row = scores[:, :langs].argmax(1), np.arange(len(scores))
    left = scores[:, : langs + 1].copy()
    left[row, -1], left[row, own] = scores[row, langs + 1 + own], -np.inf
    scores = scores[:, : langs + 1]
    both, right, size = np.vstack([scores, left]), np.r_[own, np.full(len(own), langs)], np.r_[words, words]
    # every language counts the same, and so do its presence and its absence
    weight = 1 / np.bincount(own, minlength=langs)[own]
    weight = np.r_[weight, weight]
    best = None
    for power in POWERS:
        for temperature in TEMPERATURES:
            for offset in OFFSETS:
                x = calibrated(both, size, power, temperature, offset)
                top = x.max(1)
                fit = float((weight * (x[np.arange(len(x)), right] - top - np.log(np.exp(x - top[:, None]).sum(1)))).sum())
                if best is None or fit > best[0]:
                    best = (fit, power, temperature, offset)
    return Model(model.prob, *best[1:])


class Scorer:
    """Sentences of texts with their language scores; keeps what it has worked out of each distinct word."""

    BLANK, END, LINE, MARK = 0, 1, 2, 3
    KEEP = 400_000

    def __init__(self, prob: np.ndarray, path: str = PIECES) -> None:
        self.prob, self.vocab = with_one(np.asarray(prob, np.float64)), vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.word: dict[str, int] = {"": self.BLANK, "\n": self.LINE, "\f": self.MARK} | dict.fromkeys(ENDS, self.END)
        self.scores, self.weight = np.zeros((4, self.prob.shape[1]), np.float32), np.zeros(4)
        self.unit: dict[str, np.ndarray] = {}

    def learn(self, tokens: set[str]) -> None:
        ends = {t for t in tokens if t[0] in ".!?…"}
        self.word.update(dict.fromkeys(ends, self.END))
        skipped = {t for t in tokens if NO_WORD.fullmatch(t)}
        self.word.update(dict.fromkeys(skipped, self.BLANK))
        new = list(tokens - ends - skipped)
        if not new:
            return
        parts = [self.vocab.units(t) for t in new]
        fresh = list({u for p in parts for u in p if u not in self.unit})
        for lo in range(0, len(fresh), 4000):
            some = fresh[lo : lo + 4000]
            self.unit.update(zip(some, Lattice(self.vocab, some).log_scores(self.prob), strict=True))
        self.word.update((t, len(self.scores) + k) for k, t in enumerate(new))
        self.scores = np.vstack([self.scores, np.array([np.sum([self.unit[u] for u in p], axis=0) for p in parts], np.float32)])
        # scripts that set no blanks count a word for every two characters
        self.weight = np.concatenate([self.weight, [max(1, len(t) // 2) if ord(t[0]) >= 0x2E80 else 1 for t in new]])

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], list[str]]:
        """Of each sentence: number of its text, start, end, log scores [languages], words, its range of tokens; and all tokens."""
        if len(self.word) > self.KEEP:
            self.clear()
        tokens: list[str] = []
        starts, ends, sizes = [], [], []
        for text in texts:
            t, a, b = scan(text)
            tokens += t
            tokens.append("\f")
            starts += [a, [0]]
            ends += [b, [0]]
            sizes.append(len(t) + 1)
        ids = list(map(self.word.get, tokens))
        if None in ids:
            self.learn({t for t, i in zip(tokens, ids, strict=True) if i is None})
            ids = list(map(self.word.get, tokens))
        none = np.zeros(0, np.int64)
        if not ids:
            return none, none, none, np.zeros((0, self.prob.shape[1])), np.zeros(0), [], tokens
        code, start, end = np.array(ids), np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)
        bound = np.flatnonzero((code >= self.END) & (code <= self.MARK))
        first = np.r_[0, bound[:-1] + 1]
        words = np.add.reduceat(np.r_[self.weight[code], 0], np.minimum(first, len(code)))
        kept = (code[bound] == self.END) & (bound > first) & (words >= WORDS)
        first, bound, words = first[kept], bound[kept], words[kept]
        text = np.repeat(np.arange(len(texts)), sizes)[bound]
        edges = np.stack([first, bound], 1).ravel()
        total = np.add.reduceat(self.scores[code], edges, axis=0)[::2] if len(first) else np.zeros((0, self.prob.shape[1]))
        return text, start[first], end[bound], total.astype(np.float64), words, list(zip(first.tolist(), bound.tolist(), strict=True)), tokens


_SCORERS: dict[tuple[int, str], Scorer] = {}


def worker_scorer(key: tuple, prob: np.ndarray, path: str) -> Scorer:
    """One scorer per worker process and model, so that tasks of a worker share what it has worked out."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(prob, path)
    return _SCORERS[key]


def posterior(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def train(labelled: list[tuple[str, str]], langs: list[str], path: str = PIECES, rounds: int = ROUNDS) -> Model:
    """A calibrated model of `langs` from (text, label) with labels in langs, some of them wrong.

    Each round counts every sentence to the language it is given, first by its document's label, then by the model of the
    round before. Words also count a little without their accents, as they are often typed so.
    """
    vocab, at = vocabulary(path), {x: k for k, x in enumerate(langs)}
    labelled = [(t, x) for t, x in labelled if t and x in at]
    blank = Scorer(np.full((vocab.size, len(langs)), 1.0 / vocab.size), path)
    seeds = [scan(SEEDS.get(x, ""))[0] for x in langs]
    keep = np.array([at[x] for _, x in labelled], np.int64)
    text, _, _, _, _, ranges, tokens = blank.sentences([t for t, _ in labelled])
    given = keep[text] if len(text) else keep[:0]
    prob = None
    for _ in range(rounds):
        if prob is not None and len(ranges):
            scorer = Scorer(prob, path)
            given = scorer.sentences([t for t, _ in labelled])[3].argmax(1)
        counts: list[Counter] = [Counter(seed) for seed in seeds]
        for (a, b), k in zip(ranges, given.tolist(), strict=True):
            counts[k].update(tokens[a:b])
        for c in counts:
            for w in [w for w in c if not w[0].isalpha() or NO_WORD.fullmatch(w)]:
                del c[w]
        for c in counts:
            for w, n in list(c.items()):
                if (p := plain(w)) != w and ord(w[0]) < 0x250:
                    c[p] += 0.2 * n
        prob = fit(vocab, counts)
    return calibrate(prob, [t for t, _ in labelled[:CALIBRATED]] + [SEEDS[x] for x in langs if x in SEEDS], path)


def normal_label(lang: Column, reference: list) -> Column:
    """The language_ref.lang that a label names by code, three-letter code or name; null if it names none."""
    base = F.lower(F.regexp_extract(F.trim(lang), r"^([^_-]*)", 1))
    names = {str(x).lower(): r.lang for r in reference for x in (r.name, r.iso3, r.lang) if x}
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[base] if names else F.lit(None).cast("string")


def fit_documents(documents: DataFrame, language_ref: DataFrame, sample: int = SAMPLE, path: str = PIECES) -> tuple[list[str], Model]:
    """The languages (of the fixed small table) and a model trained on at most `sample` labelled documents, chosen by hash."""
    reference = language_ref.select("lang", "iso3", "name").collect()
    langs = sorted({r.lang for r in reference if r.lang})
    label, place = normal_label(F.col("lang"), reference), F.xxhash64("doc_id")
    # the last place of the sample first, from ids alone, so that no task sends texts that aren't in it
    last = documents.where(label.isNotNull()).select(place.alias("p")).orderBy("p").limit(sample).agg(F.max("p")).first()[0]
    some = documents.where(label.isNotNull() & (place <= F.lit(last)) & (F.char_length("text") <= SAMPLE_CHARS)).select("text", label.alias("label"))
    return langs, train([(r.text, r.label) for r in some.collect()], langs, path)


def segments(documents: DataFrame, langs: list[str], model: Model, path: str = PIECES, label: Column | None = None) -> DataFrame:
    """Passages of one language each: doc_id, segment_no, start_pos, end_pos, lang, confidence, sentences; and `label`, if given.

    A passage is a run of sentences of the same most probable language; its confidence is the mean calibrated posterior of that language
    over its sentences, low where the background (none of the languages) is as likely. Texts without a sentence, null and empty texts give
    no row; repeated rows give repeated rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Model(model.prob.astype(np.float32), model.power, model.temperature, model.offset))  # vocabulary by languages, of fixed size
    mark = hash((model.prob.tobytes(), model.power, model.temperature, model.offset))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
    names = np.array(langs, object)
    schema = SEGMENTS + (", label string" if label is not None else "")
    labelled = label is not None
    columns_of = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        scorer = worker_scorer((mark, path), shared.value.prob, path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                doc = part.column(0).to_numpy(zero_copy_only=False)
                text, start, end, scores, words, _, _ = scorer.sentences([x or "" for x in part.column(1).to_pylist()])
                if not len(text):
                    continue
                best = scores[:, :-1].argmax(1)
                sure = shared.value.posterior(scores, words)[np.arange(len(best)), best]
                head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (best[1:] != best[:-1])])
                tail = np.r_[head[1:], len(text)] - 1
                size = tail - head + 1
                new = np.r_[True, text[head][1:] != text[head][:-1]]
                number = np.arange(len(head)) - np.maximum.accumulate(np.where(new, np.arange(len(head)), 0))
                columns = [doc[text[head]], number, start[head], end[tail], names[best[head]], np.add.reduceat(sure, head) / size, size]
                out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                if labelled:
                    out.append(part.column(2).take(pa.array(text[head])))
                yield pa.RecordBatch.from_arrays(out, columns_of)

    taken = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([label.cast("string").alias("label")] if label is not None else []))
    return taken.mapInArrow(run, schema)


def document_languages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, share, confidence, languages.

    lang is the language of most of its sentences (ties: the more confident one, then by name), share its part of them,
    confidence their mean posterior, languages their number. A document without a sentence comes out with null and 0.
    """
    each = passages.groupBy("doc_id", "lang").agg(F.sum("sentences").alias("n"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("c"))
    best = each.groupBy("doc_id").agg(F.max_by(F.struct("lang", "n", "c"), F.struct("n", "c", "lang")).alias("r"), F.sum("n").alias("all"), F.count("*").cast("int").alias("languages"))
    zero = lambda x, t: F.coalesce(x, F.lit(0).cast(t))
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .join(best, "doc_id", "left")
        .select("doc_id", F.col("r.lang").alias("lang"), zero(F.col("r.n") / F.col("all"), "double").alias("share"), zero(F.col("r.c"), "double").alias("confidence"), zero(F.col("languages"), "int").alias("languages"))
    )


def labelled_segments(documents: DataFrame, language_ref: DataFrame, langs: list[str], model: Model, path: str = PIECES) -> DataFrame:
    """Passages with ``label``: the language that the document's own label names, null if none."""
    reference = language_ref.select("lang", "iso3", "name").collect()  # the fixed small table
    return segments(documents, langs, model, path, normal_label(F.col("lang"), reference))


def wrong_labels(passages: DataFrame) -> DataFrame:
    """``doc_id, lang``: the languages of each document whose label is missing, isn't its one language, or can't be right alone.

    passages: those of `labelled_segments`; repeated rows of a document count once.
    """
    found = passages.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    bad = F.col("label").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("label"))
    return found.where(bad).select("doc_id", F.explode("langs").alias("lang"))
