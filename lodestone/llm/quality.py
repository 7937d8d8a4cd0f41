"""Quality classifier: supervised subword embeddings, learned with numpy.

Every word stands for the hashed vectors of itself and of its character n-grams; a document is the average over its words, and a softmax
over two classes reads that average. Both layers are trained by stochastic gradient descent on a bounded sample of labelled rows. The
output is linear in the average, so scoring needs one number a word, remembered within a task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import INVERSE, ODD, documents, mix
from .learning import SAMPLE, fit, score

BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4)
EPOCHS, RATE, BATCH = 6, 2.0, 32
MOD, HELD, THRESHOLD = 4, 2, 0.7
#: Stands for a word that repeats the one before it.
SAME = "\x00same"
#: Words that a task remembers, and words taken apart at once.
REMEMBER, PART = 200_000, 20_000


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word itself and of its n-grams, n-grams counted in bytes with marks at both ends."""
    marked = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    data = np.frombuffer(b"".join(marked), dtype=np.uint8)
    begin = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(data)) - begin[word]
    longest = int(lengths.max(initial=0)) + 1
    up, down = powers(ODD, longest), powers(INVERSE, longest)
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[place]))
    which, hashes = [np.arange(len(words))], [total[begin + lengths] - total[begin]]
    for n in GRAMS:
        at = np.flatnonzero(place + n <= lengths[word])
        which.append(word[at])
        hashes.append((total[at + n] - total[at]) * down[place[at]] + np.uint64(n))
    h = mix(np.concatenate(hashes)) >> np.uint64(64 - buckets.bit_length() + 1)
    return np.concatenate(which), h.astype(np.int64)


def words_of(text: str) -> list[str]:
    """Words between white space, and SAME beside each that repeats the one before."""
    ws = text.split()
    return ws + [SAME for a, b in zip(ws, ws[1:], strict=False) if a == b]


def train(rows: Iterable[tuple[str, int]], buckets: int = BUCKETS, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """The two layers (``vectors``, ``output``, ``bias``), by minibatch gradient descent with a falling rate.

    Of a text only its distinct words' numbers and their counts are held; a minibatch's words are taken apart when it comes.
    """
    number: dict[str, int] = {}
    docs, shares, targets = [], [], []
    for text, y in rows:
        d = np.array([number.setdefault(w, len(number)) for w in words_of(text)], dtype=np.int32)
        ids, n = np.unique(d, return_counts=True)
        docs.append(ids)
        shares.append((n / max(1, len(d))).astype(np.float32))
        targets.append(y)
    targets = np.array(targets, dtype=np.int64)
    known, first, bucket = list(number), np.zeros(len(number) + 1, np.int64), [np.zeros(0, np.int32)]
    for at in range(0, len(known), PART):
        word, found = features(known[at : at + PART], buckets)
        first[at + 1 : at + PART + 1] = np.bincount(word)
        bucket.append(found[np.argsort(word, kind="stable")].astype(np.int32))
    bucket = np.concatenate(bucket)
    parts, first = first[1:].copy(), np.cumsum(first)
    del number, known
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (buckets, WIDTH)).astype(np.float32)
    output, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    output[:] = rng.normal(0, 0.1, output.shape)
    steps, done = max(1, epochs * -(-len(docs) // BATCH)), 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(docs)), -(-len(docs) // BATCH) or 1):
            rate, done = RATE * (1 - done / steps), done + 1
            share = np.concatenate([shares[i] for i in chosen])
            word, of = np.unique(np.concatenate([docs[i] for i in chosen]), return_inverse=True)
            sizes = np.array([len(docs[i]) for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), sizes)
            k = parts[word]
            ids = bucket[np.repeat(first[word] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            hidden = np.zeros((len(chosen), WIDTH), np.float32)
            if len(word):
                vector = np.add.reduceat(vectors[ids], np.cumsum(k) - k) / k[:, None].astype(np.float32)
                full = np.flatnonzero(sizes)
                hidden[full] = np.add.reduceat(vector[of] * share[:, None], (np.cumsum(sizes) - sizes)[full])
            z = hidden @ output + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), targets[chosen]] -= 1
            back = (p @ output.T)[doc] * share[:, None]  # each document moves its own words by a full step
            p /= len(chosen)
            output -= rate * hidden.T @ p
            bias -= rate * p.sum(0)
            for j in range(WIDTH):
                moved = np.bincount(of, back[:, j], minlength=len(word)) / k
                vectors[:, j] -= rate * np.bincount(ids, np.repeat(moved, k), minlength=buckets).astype(np.float32)
    return {"vectors": vectors, "output": output, "bias": bias}


def scorer(model: dict):
    """A function from texts to probabilities of label 1, which remembers each word's share."""
    weight = (model["vectors"] @ (model["output"][:, 1] - model["output"][:, 0])).astype(np.float64)
    bias, seen = float(model["bias"][1] - model["bias"][0]), {}

    def scores(texts: list[str]) -> list[float]:
        if len(seen) > REMEMBER:
            seen.clear()
        docs = [words_of(t) for t in texts]
        new = list(set().union(*docs) - seen.keys())
        for at in range(0, len(new), PART):
            word, bucket = features(new[at : at + PART], len(weight))
            seen.update(zip(new[at : at + PART], (np.bincount(word, weight[bucket]) / np.bincount(word)).tolist(), strict=True))
        z = np.array([sum(map(seen.__getitem__, d)) / len(d) if d else 0.0 for d in docs]) + bias
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score of 0.7 or more) of every row's whole text.

    ``labels`` has doc_id and quality. Null and empty texts get the model's score of no words. Without usable labels every score is 0.5.
    Repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, "quality", MOD, HELD, train, sample)
    if model is not None:  # scoring needs the collapsed layers alone
        model = {"vectors": model["vectors"] @ (model["output"][:, 1:] - model["output"][:, :1]), "output": np.array([[0.0, 1.0]]), "bias": model["bias"]}
    return score(docs.sparkSession, docs, model, scorer, MOD, HELD, THRESHOLD)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
