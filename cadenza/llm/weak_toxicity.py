"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

 1. Voters look for a word or for words that begin with a stem. Some are a fixed lexicon; the others are learned from labelled
    rows of the learning fold: of the words and stems that stand in labelled toxic texts, those of high precision that cover
    most of them, one after another.
 2. Every document of the corpus is turned into the list of features (candidate words and stems) that it holds; its votes are
    some of these. The label model is fitted by EM to the votes of all documents, counted by pattern, with the labelled
    sample as known: class share, each voter's rate under either class, and the correlations of voters within the classes.
    Correlated voters share their weight: a voter's log-likelihood ratio is divided by one plus its correlations.
 3. A logistic regression over the candidate features is fitted to the posterior labels of the sample and scores all
    documents. Features are present or absent, so a text's length alone changes nothing.

The learning fold is crc32(key as text) mod 3 <> 1. Labels, language, source and key are never inputs of a score. The sample is
bounded by `most_rows` labelled rows of either class, taken in the order of a hash; all counts of the label model cover all
documents. A learned feature must stand in `least_texts` sampled toxic texts (unless given: a twentieth of them, but 2 at least
and 3 at most, or a thousandth where that is more, so 6 of 6000), and the best are listed, `most_features` with the lexicon. A toxic
text that holds no listed feature gets the score of an empty one. At most `most_voters` (63 at most) features vote; lexicon words
that learned voters leave no room for don't vote, but stay features of the classifier.

Cases: null and empty texts have no feature and get the score of one without any; keys without a label and labels without a
document are no hindrance; labels that contradict each other for a key count as toxic; without any toxic label only the fixed
lexicon votes; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, texts, written

#: Fixed lexicon.
LEXICON = tuple("asshole bastard bitch clown crap cretin cunt disgusting dumbass filth fool idiot imbecile loser moron pathetic retard scum slut stupid trash vermin whore worthless".split())
STEMS = (3, 4, 5, 6, 7, 8)
FOLD = bytes(0x20 if b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b for b in range(256))
MOST_FEATURES, MOST_VOTERS = 2000, 48
LABEL_ACCURACY = 0.97


def forms(text: str) -> set[bytes]:
    """The distinct lower-cased words of a text; characters above 127 belong to words."""
    return set(text.lower().encode().translate(FOLD).split())


def features(words: set[bytes]) -> set[bytes]:
    """Words, and stems written with a star."""
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + b"*" for w in words if len(w) >= k])
    return out


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def _sample(labels: DataFrame, key: str, label: str, most_rows: int) -> dict:
    """key -> 0 or 1 for a bounded sample of the learning fold."""
    own = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    out = {}
    for y in (0, 1):
        rows = own.where(F.col("y") == y).orderBy(F.xxhash64(F.col(key)), key).limit(most_rows).collect()
        out |= {r[0]: y for r in rows}
    return out


def _counted(docs: DataFrame, sample: dict, wanted: int, only: set[bytes] | None, least: int, most: int) -> dict[bytes, int]:
    """In how many sampled texts of class `wanted` each feature stands."""
    shared = docs.sparkSession.sparkContext.broadcast(({k for k, y in sample.items() if y == wanted}, only))

    def counted(batches):
        keys, only = shared.value
        total: Counter[bytes] = Counter()
        for batch in batches:
            at = [k for k, d in enumerate(batch.column(0).to_pylist()) if d in keys]
            for t in texts(batch.column(1).take(pa.array(at, pa.int64()))):
                found = features(forms(t))
                total.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["feature", "n"])

    rows = docs.mapInArrow(lean(counted), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = rows.orderBy(F.desc("n"), "feature").limit(most).toArrow()
    return dict(zip(got.column("feature").to_pylist(), got.column("n").to_pylist()))


class Finder:
    """The features of a list that a text holds, by number."""

    def __init__(self, listed: list[bytes]):
        self.number = {f: k for k, f in enumerate(listed)}
        self.stems: dict[bytes, list[tuple[bytes, int]]] = {}
        for f, k in self.number.items():
            if f.endswith(b"*"):
                self.stems.setdefault(f[:3], []).append((f[:-1], k))
        self.words = frozenset(f for f in listed if not f.endswith(b"*"))

    def __call__(self, text: str) -> list[int]:
        own = forms(text)
        out = {self.number[w] for w in own & self.words}
        for w in own:
            if w[:3] in self.stems:
                out.update([k for s, k in self.stems[w[:3]] if w.startswith(s)])
        return sorted(out)


def choose_voters(incidence: list[tuple[int, list[int]]], listed: list[bytes], fixed: list[int], most: int = MOST_VOTERS) -> list[int]:
    """Features that cover toxic texts not covered yet, as long as they are right in 9 of 10 cases."""
    held, wrong = {}, Counter()
    for row, (y, own) in enumerate(incidence):
        for k in own:
            if y:
                held.setdefault(k, set()).add(row)
            else:
                wrong[k] += 1
    out = list(fixed)
    covered: Counter[int] = Counter()
    good = {k: rows for k, rows in held.items() if len(rows) >= 9 * wrong[k]}
    while good and len(out) < most:
        # two voters for each text: a correlation is seen only where voters overlap
        value, _, k = max((sum(1.0 if not covered[r] else 0.25 if covered[r] == 1 else 0.0 for r in rows) / (1 + wrong[k]), -len(listed[k]), k) for k, rows in good.items())
        if value < 1:
            break
        covered.update(good.pop(k))
        if k not in out:
            out.append(k)
    return out


class LabelModel:
    """Voters that are conditionally independent but for pairwise correlations, which share out their weights."""

    def __init__(self, share: float, rate: np.ndarray):
        self.share, self.rate = share, rate  # rate[y, j]: voter j votes given class y
        self.correlation = np.zeros((rate.shape[1],) * 2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.rate[1] / self.rate[0])
        no = np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        weight = 1 / (1 + np.clip(self.correlation, 0, 1).sum(axis=1))
        z = np.log(self.share / (1 - self.share)) + votes @ ((yes - no) * weight) + (no * weight).sum()
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def update(self, total: np.ndarray) -> None:
        """total[y]: weight of the class, sums of votes, sums of pairs of votes."""
        v = self.rate.shape[1]
        mass = total[:, 0]
        self.share = float(np.clip((mass[1] + 1) / (mass.sum() + 2), 1e-4, 0.9))
        mean = (total[:, 1 : v + 1] + [[0.05], [0.5]]) / (mass[:, None] + 1)
        self.rate = np.clip(mean, 1e-5, 1 - 1e-5)
        pair = total[:, v + 1 :].reshape(2, v, v)
        within = sum(pair[y] - mass[y] * np.outer(mean[y], mean[y]) for y in (0, 1)) / max(1.0, mass.sum())
        scale = np.sqrt(np.clip(np.diag(within), 1e-9, None))
        self.correlation = np.clip(within / np.outer(scale, scale), -1, 1)
        np.fill_diagonal(self.correlation, 0)


def _votes(patterns: np.ndarray, voters: int) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(voters)) & 1).astype(np.float64)


def _sums(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    own = votes * weight[:, None]
    return np.concatenate([[weight.sum()], own.sum(axis=0), (own.T @ votes).ravel()])


def fit_label_model(patterns: DataFrame, model: LabelModel, known: tuple[np.ndarray, np.ndarray], rounds: int) -> LabelModel:
    """EM over (pattern, n), one small job a round; known: patterns and labels of the sample."""
    voters = model.rate.shape[1]
    width = 1 + voters + voters * voters
    fixed = np.stack([_sums(_votes(known[0], voters), (known[1] == y).astype(float)) for y in (0, 1)]) if len(known[0]) else np.zeros((2, width))
    for _ in range(rounds):
        shared = patterns.sparkSession.sparkContext.broadcast(model)

        def expected(batches):
            total = np.zeros((2, width))
            for batch in batches:
                v, n = _votes(batch.column(0).to_numpy(), voters), batch.column(1).to_numpy().astype(float)
                p = shared.value.posterior(v)
                total += np.stack([_sums(v, n * (1 - p)), _sums(v, n * p)])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["one", "total"])

        # one short vector from each task, added up in a tree
        parts = patterns.mapInArrow(lean(expected), "one int, total array<double>").select(F.posexplode("total").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
        total = np.zeros(2 * width)
        for r in parts.collect():
            total[r.k] = r.x
        model.update(total.reshape(2, width) + fixed)
    return model


def fit_classifier(rows: list[list[int]], posterior: np.ndarray, size: int, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on present features by Newton steps. A row's target is the likelier class under its posterior, its weight how
    sure that is; both classes weigh the same in total (up to a factor of 5), so one clear feature is enough in a text without others."""
    used = sorted({k for r in rows for k in r})
    at = {k: i for i, k in enumerate(used)}
    target, sure = (posterior > 0.5).astype(float), np.abs(2 * posterior - 1)
    share = sure[target > 0].sum(), sure[target == 0].sum()
    sure = sure * np.where(target > 0, np.clip(share[1] / max(share[0], 1e-9), 1, 5), 1.0)
    # equal rows are frequent: work on the distinct ones
    distinct: dict[tuple[int, ...], list[float]] = {}
    for r, y, w in zip(rows, target.tolist(), sure.tolist()):
        own = distinct.setdefault(tuple(at[k] for k in r), [0.0, 0.0])
        own[0] += w
        own[1] += w * y
    x = np.zeros((len(distinct), len(used) + 1), np.int8)
    x[:, -1] = 1
    for i, r in enumerate(distinct):
        x[i, list(r)] = 1
    n, yes = np.array(list(distinct.values())).T
    w = np.zeros(len(used) + 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        h, g = np.diag(penalty), -penalty * w
        for low in range(0, len(x), 256):  # the table stays in bytes; 256 rows at a time are numbers
            part, m, t = x[low : low + 256].astype(np.float64), n[low : low + 256], yes[low : low + 256]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h += (part * (m * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
            g += part.T @ (t - m * p)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        w += step
        if np.abs(step).max() < 1e-4:
            break
    out = np.zeros(size)
    out[used] = w[:-1]
    return out, float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, most_rows: int = 6000, rounds: int = 8, carried: tuple[str, ...] = (), least_texts: int | None = None, most_features: int = MOST_FEATURES, most_voters: int = MOST_VOTERS) -> DataFrame:
    """key, held_out, score, predicted (score >= threshold) and votes (how many voters found something) of every document, and the
    columns `carried` as they are."""
    own = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    sample = _sample(labels, key, label, most_rows)
    toxic = sum(sample.values())
    fixed = [w.encode() for w in LEXICON]
    least = max(2, min(3, toxic // 20), toxic // 1000) if least_texts is None else least_texts
    found = _counted(own, sample, 1, None, least, 200_000) if toxic else {}
    wrong = _counted(own, sample, 0, set(found), 1, 200_000) if found else {}
    clean = max(1, len(sample) - toxic)

    def value(f: bytes) -> float:
        a, b = (found[f] + 0.1) / (toxic + 1), (wrong.get(f, 0) + 0.5) / (clean + 1)
        return found[f] * np.log(a / b)

    good = sorted((f for f in found if found[f] >= 9 * wrong.get(f, 0)), key=lambda f: (-value(f), f))
    listed = fixed + [f for f in good if f not in set(fixed)][: max(0, most_features - len(fixed))]
    shared = own.sparkSession.sparkContext.broadcast(listed)

    def described(batches):
        finder = Finder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([finder(t) for t in texts(batch.column(1))], pa.list_(pa.int32())), *batch.columns[2:]], [key, "found", *carried])

    table = written(docs.select(key, text, *carried).mapInArrow(lean(described), f"`{key}` {kind}, found array<int>{more}"), "features")
    ids = own.sparkSession.createDataFrame([(k, y) for k, y in sample.items()], f"`{key}` {kind}, y int") if sample else None
    rows = table.join(F.broadcast(ids), key).select("y", "found").collect() if ids is not None else []  # most_rows of either class at most
    voters = choose_voters([(r.y, r.found) for r in rows], listed, [], most_voters)
    voters += [k for k in range(len(fixed)) if k not in voters][: max(0, most_voters - len(voters))]
    bit = {k: j for j, k in enumerate(voters)}
    masks = F.aggregate(F.array_intersect("found", F.array(*(F.lit(k) for k in voters))), F.lit(0).cast("long"), lambda n, k: n + F.expr("cast(1 as bigint)") * F.element_at(F.create_map(*(F.lit(x) for k, j in bit.items() for x in (k, 1 << j))).cast("map<int,bigint>"), k))
    patterns = written(table.select(masks.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    known = np.array([sum(1 << bit[k] for k in r.found if k in bit) for r in rows], np.int64), np.array([r.y for r in rows])
    rate = np.full((2, len(voters)), 0.002)
    rate[1] = 0.1
    model = LabelModel(float(np.clip(toxic / len(sample) if sample else 0.05, 0.01, 0.5)), rate)
    if len(rows):
        v = _votes(known[0], len(voters))
        for y in (0, 1):
            if (known[1] == y).any():
                model.rate[y] = np.clip((v[known[1] == y].sum(axis=0) + (0.02, 0.2)[y]) / ((known[1] == y).sum() + 1), 1e-5, 0.99)
    model = fit_label_model(patterns, model, known, rounds)
    if len(rows):
        # the given label is one more voter, of a set accuracy
        p = model.posterior(_votes(known[0], len(voters)))
        odds = p / (1 - p + 1e-12) * (LABEL_ACCURACY / (1 - LABEL_ACCURACY)) ** np.where(known[1] == 1, 1.0, -1.0)
        weight, bias = fit_classifier([r.found for r in rows], odds / (1 + odds), len(listed))
    else:  # no labelled rows: the label model's own linear form
        yes, no = np.log(model.rate[1] / model.rate[0]), np.log((1 - model.rate[1]) / (1 - model.rate[0]))
        weight, bias = np.zeros(len(listed)), float(np.log(model.share / (1 - model.share)) + no.sum())
        weight[voters] = yes - no
    linear = own.sparkSession.sparkContext.broadcast((weight, bias, frozenset(voters)))

    def scored(batches):
        weight, bias, voters = linear.value
        for batch in batches:
            lists = batch.column(1).to_pylist()
            score = [1 / (1 + np.exp(-np.clip(bias + weight[own].sum(), -60, 60))) if own else 1 / (1 + np.exp(-np.clip(bias, -60, 60))) for own in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([len(voters.intersection(own)) for own in lists], pa.int64()), *batch.columns[2:]], [key, "score", "votes", *carried])

    out = table.mapInArrow(lean(scored), f"`{key}` {kind}, score double, votes long{more}")
    return out.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "votes", *carried)
