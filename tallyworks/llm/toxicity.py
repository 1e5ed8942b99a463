"""Toxicity by weak supervision.

1. Voters. Words, word beginnings and frequent word beginnings (shared by two different words and one in FREQUENT words
   of the text; languages that compound and inflect insult by stem) that tell toxic from other labelled training texts
   are mined from all labelled training rows; the strongest become lexicon voters, next to fixed pattern voters
   (shouting, symbols, repeated words).
2. Label model. Every text of the corpus casts its votes. A generative model with one pair of vote probabilities for
   each voter and class is fitted by expectation maximisation over the counts of all vote patterns, the labels of
   training rows being held fixed up to LABEL_NOISE. Then the correlations of the voters within both classes are
   estimated; voters that are correlated form a group, whose joint vote (how many of them fire) has its own
   probabilities in a second fit, so that voters that repeat one another are not counted as independent.
3. Classifier. A linear (logistic) model over the mined features is trained on the posterior labels of two bounded
   samples of training rows, labelled ones and ones without a label that some voter votes on (SAMPLE_ROWS each, a
   documented parameter); of the latter, those whose posterior is CONFIDENT either way. It scores every text.

Labels are learned only from rows with crc32(doc_id as text) mod 5 <> 0; a score depends on the text alone.

Defined cases: a null or empty text has no features and scores the intercept; texts of any length are read whole; a null
id counts as held out; of several labels of one id the highest counts; repeated rows are scored each and vote each;
without any training label, or on an empty table, every score is 0; null labels are ignored; extra columns are ignored
by the score and kept, whatever their names, by the filter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

SAMPLE_ROWS = 20_000  # rows with a label, and rows without one, that the classifier is trained on
FEATURES = 320
LEXICON_VOTERS = 40
MIN_TOXIC = 3
PREFIXES = (3, 4, 5, 6, 7)
FREQUENT = 100
EM_ROUNDS = 8
LABEL_NOISE = 0.03
CONFIDENT = 0.9
CORRELATED = 0.2  # from here on two voters belong to one group
LEVELS = 4
PATTERNS = ("shout", "symbols", "repeats")

_CLEAN = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_ASCII, _NOT_CAPITAL = bytes(range(128)), bytes(b for b in range(256) if not 65 <= b <= 90)


def held_out(folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def capitals(text: str) -> int:
    """Upper-case characters of the whole text."""
    raw = text.encode()
    n = len(raw.translate(None, _NOT_CAPITAL))
    return n if text.isascii() else n + sum(map(str.isupper, raw.translate(None, _ASCII).decode()))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and of all other characters that are not ASCII."""
    return text.lower().encode().translate(_CLEAN).decode().split()


def patterns(text: str, words: int, kinds: int) -> list[str]:
    """The pattern voters that fire on a text of so many words and different words."""
    out = []
    if words >= 8:
        if text.isupper() or capitals(text) > 0.6 * len(text):
            out.append("#shout")
        if kinds * 4 < words:
            out.append("#repeats")
    if len(text) >= 40 and sum(text.count(x) for x in "!$%&#*") * 8 > len(text):
        out.append("#symbols")
    return out


def text_features(text: str) -> set[str]:
    """Distinct lower-cased words, their beginnings (marked ``^``, the frequent ones also ``^...+``) and the pattern
    voters that fire."""
    words = words_of(text)
    kinds = Counter(words)
    out = set(kinds)
    out.update(patterns(text, len(words), len(kinds)))
    for n in PREFIXES:
        long = [(w[:n], k) for w, k in kinds.items() if len(w) > n]
        begins = Counter(x for x, _ in long)
        out.update("^" + x for x in begins)
        twice = {x: 0 for x, k in begins.items() if k > 1}
        for x, k in long:
            if x in twice:
                twice[x] += k
        out.update(f"^{x}+" for x, k in twice.items() if k * FREQUENT >= len(words))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of features among toxic and all texts (columns text, toxic)."""
    toxic: Counter = Counter()
    every: Counter = Counter()
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            f = text_features(text.as_py() or "")
            every.update(f)
            every["\x00"] += 1
            if y:
                toxic.update(f)
                toxic["\x00"] += 1
        if len(every) > 500_000:
            yield _counts(toxic, every)
            toxic.clear()
            every.clear()
    yield _counts(toxic, every)


def _counts(toxic: Counter, every: Counter) -> pa.RecordBatch:
    keys = list(every)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["feature", "toxic", "n"])


def mine(rows: DataFrame, features: int = FEATURES) -> tuple[list[str], list[str]]:
    """(features, voters) from rows (text, toxic): a bounded list each."""
    counts = rows.select("text", "toxic").mapInArrow(_count, "feature string, toxic bigint, n bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    counts = c.materialize(counts, "tox-counts")
    total = counts.where(F.col("feature") == "\x00").first()
    if total is None or not 0 < total["toxic"] < total["n"]:
        return [], []
    p, m = total["toxic"], total["n"] - total["toxic"]
    t, f = F.col("toxic"), F.col("n") - F.col("toxic")
    rate = lambda hits, of: (hits + 0.5) / (of + 1.0)
    share = lambda k, of, n: F.when(k > 0, k * F.log(k * float(p + m) / (float(of) * n))).otherwise(0.0)
    # the log-likelihood ratio of "the feature tells the classes apart"
    gain = share(t, p, F.col("n")) + share(f, m, F.col("n")) + share(p - t, p, p + m - F.col("n")) + share(m - f, m, p + m - F.col("n"))
    ranked = counts.where((F.col("n") >= MIN_TOXIC) & (F.col("feature") != "\x00")).select("feature", "toxic", (F.log(rate(t, p)) - F.log(rate(f, m))).alias("odds"), F.round(gain, 6).alias("gain"))
    best = [r["feature"] for r in ranked.orderBy(F.desc("gain"), "feature").limit(features).collect()]
    lead = ranked.where((F.col("toxic") >= MIN_TOXIC) & (F.col("odds") > 2.0) & ~F.col("feature").startswith("#"))
    voters: list[str] = []
    for r in lead.orderBy(F.desc("gain"), "feature").limit(LEXICON_VOTERS * 50).collect():
        stem = r["feature"].strip("^+")
        # a word and its beginnings are one voice: the strongest of them votes
        if len(voters) < LEXICON_VOTERS and not any(stem.startswith(v.strip("^+")) or v.strip("^+").startswith(stem) for v in voters):
            voters.append(r["feature"])
    c.release(counts)
    return sorted(set(best) | set(voters)), voters + [f"#{x}" for x in PATTERNS]


class Finder:
    """Those features of ``text_features`` that are wanted. What a word contributes is looked up once and kept, for
    WORDS_KEPT words at a time, so that a text costs one look-up for each of its different words."""

    WORDS_KEPT = 300_000

    def __init__(self, wanted: set[str]):
        self.wanted, self.known = wanted, {}

    def _of(self, word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        begins = ["^" + word[:n] for n in PREFIXES if len(word) > n]
        return tuple(x for x in (word, *begins) if x in self.wanted), tuple(x + "+" for x in begins if x + "+" in self.wanted)

    def __call__(self, text: str) -> set[str]:
        words = words_of(text)
        kinds = Counter(words)
        out = {x for x in patterns(text, len(words), len(kinds)) if x in self.wanted}
        frequent: dict[str, list[int]] = {}
        known = self.known
        if len(known) > self.WORDS_KEPT:
            known.clear()
        for w, k in kinds.items():
            got = known.get(w)
            if got is None:
                got = known[w] = self._of(w)
            if got[0]:
                out.update(got[0])
            for x in got[1]:
                frequent.setdefault(x, []).append(k)
        out.update(x for x, counts in frequent.items() if len(counts) > 1 and sum(counts) * FREQUENT >= len(words))
        return out


def _extract(batches: Iterator[pa.RecordBatch], names: list[str], voters: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``x`` (text) and others -> the others, feats, mask."""
    at, bit = {f: i for i, f in enumerate(names)}, {v: 1 << i for i, v in enumerate(voters)}
    known, ballots = set(at), set(bit)
    find = Finder(known | ballots)
    for batch in batches:
        feats, masks = [], []
        for text in batch.column(0):
            f = find(text.as_py() or "")
            feats.append(sorted(at[x] for x in f & known))
            masks.append(sum(bit[x] for x in f & ballots))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(feats, pa.list_(pa.int32())), pa.array(masks, pa.int64())], names=[*batch.schema.names[1:], "feats", "mask"])


def bits(masks: np.ndarray, m: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(m)) & 1).astype(np.int64)


class LabelModel:
    """p(votes, class). Voters that are correlated within a class form a group and vote as one: by how many of them fire
    (0 to LEVELS - 1 or more). Groups are independent given the class."""

    def __init__(self, groups: np.ndarray, prior: float, rates: np.ndarray):
        self.groups, self.prior, self.rates = groups, prior, rates  # group of each voter; rates[class, group, level]

    @classmethod
    def start(cls, groups: np.ndarray) -> LabelModel:
        """Where estimation begins: a voter tells of toxicity, and is mostly silent."""
        fire = 0.5 ** np.arange(LEVELS)
        rates = np.array([fire * x for x in (0.002, 0.2)])
        rates[:, 0] = 1 - rates[:, 1:].sum(axis=1)
        return cls(groups, 0.1, np.repeat(rates[:, None], groups.max() + 1, axis=1))

    def levels(self, masks: np.ndarray) -> np.ndarray:
        """Votes of each group."""
        member = np.zeros((len(self.groups), self.rates.shape[1]), np.int64)
        member[np.arange(len(self.groups)), self.groups] = 1
        return np.minimum(bits(masks, len(self.groups)) @ member, LEVELS - 1)

    def posterior(self, masks: np.ndarray, y: np.ndarray) -> np.ndarray:
        """p(toxic | votes, label); y is NaN where there is no label."""
        evidence = np.log(self.rates[1] / self.rates[0])
        logit = np.log(self.prior / (1 - self.prior)) + evidence[np.arange(evidence.shape[0]), self.levels(masks)].sum(axis=1)
        label = np.where(np.isnan(y), 0, np.where(y > 0, 1, -1) * np.log((1 - LABEL_NOISE) / LABEL_NOISE))
        return 1 / (1 + np.exp(-np.clip(logit + label, -30, 30)))


def _moments(batches: Iterator[pa.RecordBatch], model: LabelModel, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Sums over patterns (mask, y, n), for each class: the weight of each group's levels, or the votes and the products
    of votes of all voters after the weight itself."""
    m, size = len(model.groups), model.rates.shape[1]
    total = np.zeros((2, 1 + m + m * m if pairs else size * LEVELS))
    for batch in batches:
        masks, y, n = (np.array(batch.column(i).to_pylist(), np.float64 if i == 1 else np.int64) for i in range(3))
        if not len(masks):
            continue
        # labels are held fixed
        p = np.where(np.isnan(y), model.posterior(masks, np.full(len(y), np.nan)), np.where(y > 0, 1 - LABEL_NOISE, LABEL_NOISE))
        for k, w in ((0, n * (1 - p)), (1, n * p)):
            if pairs:
                v = bits(masks, m).astype(np.float64)
                total[k] += np.concatenate([[w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()])
            else:
                at = model.levels(masks) + np.arange(size) * LEVELS
                total[k] += np.bincount(at.ravel(), np.repeat(w, size), minlength=size * LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])


def correlations(moments: np.ndarray, m: int) -> np.ndarray:
    """Positive correlations of the votes within one class, from its weight, votes and products of votes. Pairs of voters
    that fire together less than three times say nothing."""
    weight, votes, joint = max(moments[0], 1e-9), moments[1 : m + 1], moments[m + 1 :].reshape(m, m)
    mean = votes / weight
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.clip((joint / weight - np.outer(mean, mean)) / np.outer(sd, sd), 0, 1)
    corr[joint < 3] = 0
    np.fill_diagonal(corr, 1)
    return corr


def vote_groups(corr: np.ndarray) -> np.ndarray:
    """Number of the group of each voter: voters linked by correlations above CORRELATED, directly or through others."""
    reach = corr > CORRELATED
    for _ in range(len(corr).bit_length()):
        reach = reach @ reach
    return np.unique(reach.argmax(axis=1), return_inverse=True)[1]


def fit_label_model(patterns: DataFrame, m: int) -> LabelModel:
    """patterns(mask, y, n): counts over the whole corpus; y is null but for training rows. First with voters that are
    independent given the class, then with the groups that their correlations in the two classes make."""

    def gather(model: LabelModel, pairs: bool = False) -> np.ndarray:
        rows = patterns.select("mask", "y", "n").mapInArrow(lambda b: _moments(b, model, pairs), "s array<double>")
        sums = rows.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(2 * (1 + m + m * m if pairs else model.rates.shape[1] * LEVELS))
        for i, x in sums:
            out[i] = x
        return out.reshape(2, -1)

    def estimate(model: LabelModel) -> LabelModel:
        for _ in range(EM_ROUNDS):
            s = gather(model).reshape(model.rates.shape)
            weight = s[:, 0].sum(axis=1)
            rates = s + 0.2 * 0.1 ** np.minimum(np.arange(LEVELS), 1)
            rates /= rates.sum(axis=2, keepdims=True)
            moved = np.abs(np.log(rates / model.rates)).max()
            model = LabelModel(model.groups, float(np.clip(weight[1] / max(weight.sum(), 1e-9), 1e-3, 0.5)), rates)
            if moved < 0.02:
                break
        return model

    alone = estimate(LabelModel.start(np.arange(m)))
    linked = np.maximum(*(correlations(x, m) for x in gather(alone, True)))
    return estimate(LabelModel.start(vote_groups(linked)))


def train_linear(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam. Rows are lists of active features."""
    flat = np.array([f for r in rows for f in r], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, n = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), len(rows)
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[flat], minlength=n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(flat, g[of], minlength=size) / n + l2 * w, g.mean())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Scorer:
    """The trained linear model: features of a text, their weights, and the intercept."""

    def __init__(self, names: list[str], w: np.ndarray, b: float):
        self.at, self.w, self.b = {f: i for i, f in enumerate(names)}, w, b

    def logit(self) -> Column:
        """The log odds of a row from its column ``feats``."""
        weights = F.array(*[F.lit(float(x)) for x in self.w])
        return F.aggregate("feats", F.lit(float(self.b)), lambda z, f: z + F.get(weights, f))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep: bool = False) -> tuple[Scorer | None, DataFrame | None]:
    """The scorer, and the table of all rows' features (doc_id, held_out, feats, mask; the whole row as ``row`` if it is
    to be kept): each text is looked at once. None, None without labels."""
    rows = [F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")] if keep else []
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *rows)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    y = y.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = c.materialize(y.join(docs.select("doc_id"), "doc_id", "left_semi"), "tox-labels")
    names, voters = mine(docs.where(~F.col("held_out")).select("doc_id", "text").join(y.hint("merge"), "doc_id"), FEATURES)  # labels grow with the corpus
    if not names:
        return None, None
    schema = T.StructType([*docs.schema.fields[1:], T.StructField("feats", T.ArrayType(T.IntegerType())), T.StructField("mask", T.LongType())])
    votes = c.materialize(docs.mapInArrow(lambda b: _extract(b, names, voters), schema), "tox-votes")
    training = votes.where(~F.col("held_out")).select("doc_id", "feats", "mask").join(y.withColumnRenamed("toxic", "y"), "doc_id", "left")
    patterns = training.groupBy("mask", "y").agg(F.count("*").alias("n"))
    unseen = votes.where("held_out").groupBy("mask").agg(F.count("*").alias("n")).select("mask", F.lit(None).cast("int").alias("y"), "n")
    patterns = c.materialize(patterns.unionByName(unseen), "tox-patterns")
    model = fit_label_model(patterns, len(voters))
    # several rows may share an id: one row of features an id, so that the samples stay bounded
    # a text without a label for which every voter abstains has nothing to teach
    voted = {True: F.col("y").isNotNull(), False: F.col("y").isNull() & (F.col("mask") != 0)}
    sample = [training.where(voted[labelled]).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("feats", "mask")).limit(sample_rows) for labelled in (True, False)]
    one = F.min_by(F.struct("feats", "mask", "y"), F.xxhash64("feats", "mask")).alias("r")
    some = sample[0].unionByName(sample[1]).groupBy("doc_id").agg(one).select("doc_id", "r.*").orderBy("doc_id").collect()
    y_some = np.array([np.nan if r["y"] is None else r["y"] for r in some])
    target = model.posterior(np.array([r["mask"] for r in some], np.int64), y_some)
    sure = ~np.isnan(y_some) | (np.abs(target - 0.5) >= CONFIDENT - 0.5)
    w, b = train_linear([r["feats"] for r, ok in zip(some, sure) if ok], target[sure], len(names))
    c.release(y, patterns)
    return Scorer(names, w, b), votes


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scorer, votes = fit(docs, labels, sample_rows)
    if scorer is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    score = 1 / (1 + F.exp(-scorer.logit()))
    return votes.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; judged row by row, so ids need not be unique."""
    scorer, votes = fit(docs, labels, keep=True)
    return docs if scorer is None else votes.where(scorer.logit() < 0).select("row.*")
