"""Toxicity by a lexicon that is learned from labels and matched with Levenshtein automata.

Fitting keeps words and open word beginnings whose presence in a document is strong evidence of the label, as a trie. The automata of
all terms, intersected with the trie, run as one deterministic automaton that is built where words lead it; a batch's new words go
through it together. Each hit counts by its term's evidence and edits, and by its context window: a hit between quotation marks or beside
words of reporting counts as quotation, not as abuse.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, text_or_empty
from .learning import SAMPLE, fit, score, scored

MOD, HELD, THRESHOLD = 3, 1, 0.7
#: Least log-likelihood gain of a term over the base rate, least documents with it, and words that share an open beginning.
GAIN, SUPPORT, ENDINGS = 10.0, 4, 4
#: Words of this length or more tell near copies of a toxic text; a pair of them that is smallest by one of SEEDS hashes joins two texts.
TELLING, SEEDS = 8, 4
SHORTEST_OPEN, LONGEST_OPEN = 4, 10
#: Words on each side of a hit that are its context; what a quoted hit counts for.
WINDOW, QUOTED = 6, 0.3
#: fixed values: marks that open or close quotation, and words of reporting in English, German, French and Spanish
QUOTES = "\"“”„‟«»‹›‘’"
REPORTING = frozenset(
    "quote quoted quotes quoting said says word words term insult insults called reported wrote writes article defines definition"
    " zitat zitiert zitierte sagte wort wörter begriff beleidigung schrieb citation cité cita citó dit mot mots terme insulte écrit dijo palabra palabras término insulto escribió".split()
)
REMEMBER = 200_000
WORD = re.compile(r"\w+").findall


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Lexicon:
    """Terms (``open`` ones match as beginnings, without edits) and the determinised product of their automata with their trie."""

    def __init__(self, closed: dict[str, float], opened: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.most, self.weight, self.open_weight = [0], [0.0], [0.0]
        for terms, is_open in ((closed, False), (opened, True)):
            for term, w in terms.items():
                node, most = 0, 0 if is_open else edits_allowed(term)
                self.most[0] = max(self.most[0], most)
                for c in term:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.most.append(0)
                        self.weight.append(0.0)
                        self.open_weight.append(0.0)
                    node = nxt
                    self.most[node] = max(self.most[node], most)
                kind = self.open_weight if is_open else self.weight
                kind[node] = max(kind[node], w)
        self.allowed = {}
        for term in closed:
            node = 0
            for c in term:
                node = self.children[node][c]
            self.allowed[node] = edits_allowed(term)
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for kids in self.children for c in kids}))}
        self.names = [""] + list(self.letters)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((1024, len(self.names)), -1, dtype=np.int64)
        self.accept: list[tuple[float, int]] = []
        self.opened = np.zeros(1024)
        self.dead, self.start = self._state(frozenset()), self._state(self._closure({(0, 0)}))

    def _closure(self, found: set[tuple[int, int]]) -> frozenset:
        """With the letters of terms that a word leaves out; of a node only the fewest edits stay."""
        least: dict[int, int] = {}
        todo = list(found)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(k, e + 1) for k in self.children[node].values()]
        return frozenset(least.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            if len(self.sets) >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.opened = np.append(self.opened, np.zeros_like(self.opened))
            best = max(((self.weight[n], -e) for n, e in s if self.weight[n] and e <= self.allowed[n]), default=(0.0, 0), key=lambda x: (x[1], x[0]) if x[0] else (-9, 0))
            self.opened[len(self.sets)] = max((self.open_weight[n] for n, e in s if e == 0), default=0.0)
            self.accept.append((best[0], -best[1]))
            self.sets.append(s)
        return self.states[s]

    def _step(self, s: frozenset, letter: str) -> frozenset:
        out = set()
        for node, e in s:
            out.add((node, e + 1))
            for c, k in self.children[node].items():
                out.add((k, e if c == letter else e + 1))
        return self._closure(out)

    def match(self, words: list[str]) -> list[tuple[float, int]]:
        """(weight, edits) of each word's best term; weight 0 if it has none. An open beginning counts as 0 edits."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        to_class = np.zeros(int(codes.max(initial=0)) + 2, dtype=np.int64)
        for c, i in self.letters.items():
            if ord(c) < len(to_class):
                to_class[ord(c)] = i
        classes, begin = to_class[codes], np.cumsum(lengths) - lengths
        state, opened = np.full(len(words), self.start), np.zeros(len(words))
        live = np.arange(len(words))
        at = 0
        while True:
            live = live[(lengths[live] > at) & (state[live] != self.dead)]
            if not len(live):
                break
            letter = classes[begin[live] + at]
            nxt = self.table[state[live], letter]
            while len(missing := np.flatnonzero(nxt < 0)):
                for s, k in set(zip(state[live[missing]].tolist(), letter[missing].tolist(), strict=True)):
                    target = self._state(self._step(self.sets[s], self.names[k]))
                    self.table[s, k] = target
                nxt = self.table[state[live], letter]
            state[live] = nxt
            opened[live] = np.maximum(opened[live], self.opened[nxt])
            at += 1
        return [(o, 0) if o >= self.accept[s][0] and o else self.accept[s] for s, o in zip(state.tolist(), opened.tolist(), strict=True)]


def witnesses(word_sets: list[set[str]]) -> list[int]:
    """A number for each set of words, the same for near copies."""
    parent = list(range(len(word_sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for seed in range(SEEDS):
        first: dict[tuple, int] = {}
        for i, words in enumerate(word_sets):
            hashes = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass"), seed) for w in words if len(w) >= TELLING)[:2]
            if len(hashes) == 2:
                parent[root(i)] = root(first.setdefault(tuple(hashes), i))
    return [root(i) for i in range(len(word_sets))]


def heads(word: str) -> list[str]:
    """The beginnings of a word that may be open terms; each is followed by one letter at least."""
    return [word[:k] for k in range(SHORTEST_OPEN, min(len(word), LONGEST_OPEN + 1))]


def counts_of(judged: list[tuple[np.ndarray, bool]], vocabulary: list[str]) -> tuple[int, int, np.ndarray, np.ndarray, list[tuple[np.ndarray, bool]]]:
    """Documents, toxic ones among them, documents and toxic ones with each word, and the documents; near copies of a toxic text are one."""
    merged: dict[int, list[np.ndarray]] = {}
    bad = [ids for ids, y in judged if y]
    for ids, group in zip(bad, witnesses([{vocabulary[i] for i in ids.tolist()} for ids in bad]), strict=True):
        merged.setdefault(group, []).append(ids)
    docs = [(np.unique(np.concatenate(parts)), True) for parts in merged.values()] + [(ids, False) for ids, y in judged if not y]
    total, toxic = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for ids, y in docs:
        total[ids] += 1
        if y:
            toxic[ids] += 1
    return len(docs), len(merged), total, toxic, docs


def train(rows: Iterable[tuple[str, int]]) -> dict:
    """The lexicon with each term's evidence, words near a term that labelled documents show to mean something else, and how strongly
    a document's hits together speak for the label.

    Equal texts are one witness, and so are near copies among the toxic texts. Of a text its bytes and the numbers of its distinct words
    are held; beginnings are counted only where toxic texts have them often enough.
    """
    number: dict[str, int] = {}
    seen: dict[bytes, list] = {}
    for text, y in rows:
        raw = zlib.compress(text.encode("utf-8", "surrogatepass"), 1)
        if raw not in seen:
            ids = np.array([number.setdefault(w, len(number)) for w in set(WORD(text.lower()))], dtype=np.int32)
            seen[raw] = [np.sort(ids), 0, 0]
        seen[raw][1] += y
        seen[raw][2] += 1
    vocabulary = list(number)
    judged = [(ids, a / k >= 0.5) for ids, a, k in seen.values()]
    n, bad, total, toxic, docs = counts_of(judged, vocabulary)
    if not bad:
        return {"closed": {}, "opened": {}, "known": {}, "near": 0.0, "line": (1.0, 0.0)}
    base = min(max(bad / n, 1e-6), 1 - 1e-6)

    def evidence(a: int, k: int) -> float:
        """Gain in log likelihood by a term in ``k`` documents, ``a`` of them toxic; 0 if it speaks for the other label."""
        p = a / k
        if p < 0.8:
            return 0.0
        return a * math.log(p / base) + ((k - a) * math.log((1 - p) / (1 - base)) if k > a else 0)

    gain = max(GAIN, math.log(1 + int((total >= SUPPORT).sum())) + 2)

    def weight(a: int, k: int) -> float:
        return (a + base) / (k + 2 + base)

    closed = {vocabulary[i]: weight(int(toxic[i]), int(total[i])) for i in np.flatnonzero(toxic >= SUPPORT).tolist() if evidence(int(toxic[i]), int(total[i])) > gain}
    beginnings: Counter = Counter()
    for ids, y in docs:
        if y:
            beginnings.update({h for i in ids.tolist() for h in heads(vocabulary[i])})
    likely = {h: j for j, h in enumerate(h for h, a in beginnings.items() if a >= SUPPORT)}
    of_word = [[likely[h] for h in heads(w) if h in likely] for w in vocabulary]
    begun, endings = np.zeros(len(likely), np.int64), np.zeros(len(likely), np.int64)
    for i in np.flatnonzero(toxic).tolist():
        endings[of_word[i]] += 1
    for ids, _ in docs:
        begun[list({j for i in ids.tolist() for j in of_word[i]})] += 1
    opened: dict[str, float] = {}
    for head, j in sorted(likely.items(), key=lambda x: len(x[0])):  # the shortest beginning stands for the longer ones
        a, k = beginnings[head], int(begun[j])
        if endings[j] >= ENDINGS and evidence(a, k) > gain and not any(head[:i] in opened for i in range(SHORTEST_OPEN, len(head))):
            opened[head] = weight(a, k)
    del beginnings, likely, of_word, docs
    near: dict[str, int] = {}
    lexicon = Lexicon(closed, opened)
    for at in range(0, len(vocabulary), 50_000):
        part = vocabulary[at : at + 50_000]
        near.update((w, at + i) for i, (w, (x, e)) in enumerate(zip(part, lexicon.match(part), strict=True)) if x and e and w not in closed)
    speaks = {w: bool(toxic[i] >= 0.8 * total[i]) for w, i in near.items()}
    known = {w: weight(int(toxic[i]), int(total[i])) if speaks[w] else 0.0 for w, i in near.items()}
    share = (sum(speaks.values()) + 1) / (len(near) + 2)
    model = {"closed": closed, "opened": opened, "known": known, "near": share, "line": (1.0, 0.0)}
    raws, scores = list(seen), scorer(model)
    hits = [x for at in range(0, len(raws), 256) for x in scores([zlib.decompress(r).decode("utf-8", "surrogatepass") for r in raws[at : at + 256]], raw=True)]
    return model | {"line": fitted_line(np.array(hits), np.array([y for _, y in judged], dtype=float))}


def fitted_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and offset of a logistic curve through (x, y), with a light pull of the slope towards 1."""
    a, b = 1.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * (b + 2)])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = max(0.0, a + float(np.clip(step[0], -2, 2))), b + float(np.clip(step[1], -2, 2))
    return a, b


def scorer(model: dict):
    lexicon, known, near, seen = Lexicon(model["closed"], model["opened"]), model["known"], model["near"], {}
    slope, offset = model["line"]

    def judged(pieces: list[str]) -> list[float]:
        """The strongest word's weight of each piece between white space."""
        parts = [WORD(p) for p in pieces]
        words = list(dict.fromkeys(w for ws in parts for w in ws))
        hit = {w: known[w] if w in known else x * near**e for w, (x, e) in zip(words, lexicon.match(words), strict=True) if x}
        return [max((hit.get(w, 0.0) for w in ws), default=0.0) for ws in parts]

    def scores(texts: list[str], raw: bool = False) -> list[float]:
        if len(seen) > REMEMBER:
            seen.clear()
        docs = [t.lower().split() for t in texts]
        new = list(set().union(*docs) - seen.keys())
        seen.update(zip(new, judged(new), strict=True))
        found = [in_context(d, w) if any(w := list(map(seen.__getitem__, d))) else 0.0 for d in docs]
        return found if raw else [1 / (1 + math.exp(-max(-50.0, min(50.0, slope * x + offset)))) for x in found]

    return scores


def in_context(pieces: list[str], weights: list[float]) -> float:
    """What the hits of a text say together, as minus the logarithm of the chance that none is meant; quoted ones count less."""
    found = 0.0
    for i, w in enumerate(weights):
        if not w:
            continue
        before, after = pieces[max(0, i - WINDOW) : i], pieces[i + 1 : i + 1 + WINDOW]
        opens = pieces[i][0] in QUOTES or any(p[0] in QUOTES for p in before)
        closes = pieces[i].rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(p.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for p in after)
        reported = any(p.strip(".,;:!?") in REPORTING for p in before + after)
        found -= math.log(1 - w * (QUOTED if (opens and closes) or reported else 1.0))
    return found


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score of 0.7 or more) of every row's whole text.

    ``labels`` has doc_id and toxic. Null and empty texts have the score of a text without any term, near 0. Without usable labels, or
    where none is toxic, every score is 0.5. Repeated rows are scored
    alike; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, "toxic", MOD, HELD, train, sample)
    return score(docs.sparkSession, docs, model, scorer, MOD, HELD, THRESHOLD)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; a null or repeated doc_id is judged by its own text.

    Null, empty and very long texts are judged as in toxicity_scores. Columns may have any names. Without usable labels all rows stay.
    """
    model = fit(docs.select("doc_id", "text"), labels, "toxic", MOD, HELD, train)
    return docs if model is None else docs.where(scored(docs.sparkSession, model, scorer)(text_or_empty()) < THRESHOLD)
