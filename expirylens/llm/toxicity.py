"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from expirylens.llm.common import materialise

# Abuse in four languages, insults first, then slurs on worth, then hostile verbs.
INSULTS = """idiot moron stupid imbecile cretin fool dumb dumbass jerk bastard asshole bitch loser clown scum trash garbage vermin parasite
crétin abruti imbécile connard salaud débile ordure idiot dummkopf trottel arschloch depp abschaum versager idiota estúpido imbécil
tonto cabrón basura gilipollas payaso""".split()
CONTEMPT = "worthless pathetic disgusting useless despicable repulsive vile filthy ugly inferior nutzlos erbärmlich widerlich dégoûtant minable asqueroso patético inútil".split()
HOSTILE = "hate kill die shut despise destroy hang hasse verreck crève déteste odio muere muérete".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

# Characters written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

FEATURES = ["log_words", "insults", "contempt", "hostile", "insult_rate", "contempt_rate", "hostile_rate", "kinds", "disguised",
            "disguised_rate", "second_person_rate", "near_second_person", "densest", "capitals", "capital_words", "punctuation",
            "exclamations", "questions", "symbols", "digits_in_words", "long_runs", "mean_word", "repeated_words",
            "learned", "learned_rate", "learned_kinds", "learned_weight"]
NEAR, WINDOW = 6, 50
# Folds of the cross-fitting.
FOLDS = 3
# Learned lexicon: word beginnings of so many letters, in at least three texts with the label and this part of
# them, and so many times likelier there than in texts without it. The strongest are kept, up to a number that is a parameter.
STEM, LEAST_PART, LEAST_LIFT, MOST_STEMS = 4, 0.01, 15.0, 2000

_PUNCTUATION = {ord(c): " " for c in ".,;:!?\"'()[]{}<>«»“”„‘’…—–-/\\|*_#%&$@+=~^`¡¿"}
_DISGUISE = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in ".,;:?\"'()[]{}*_-#%&+=~^`/\\"}
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SPELLED = re.compile(r"(?<!\w)[^\W\d_]([ .\-_*])[^\W\d_](?:\1[^\W\d_]){2,}(?!\w)")
_MIXED = re.compile(r"[^\W\d_][0-9@$!|]+[^\W\d_]")
_SIGNS = np.array([ord(c) for c in "0123456789@$!|"], "<u4")


_LETTER, _UPPER, _PLAIN, _UNDISGUISED = range(4)
_DELETED = 0xFFFFFFFF


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """By code point: whether it's a letter as the patterns mean it, whether it's upper case, and what both translations make of it."""
    every = [chr(c) for c in range(sys.maxunicode + 1)]
    plain, undisguised = np.arange(len(every), dtype="<u4"), np.arange(len(every), dtype="<u4")
    for table, change in ((plain, _PUNCTUATION), (undisguised, _DISGUISE)):
        for code, to in change.items():
            table[code] = _DELETED if to is None else ord(to)
    return (np.array([c.isalnum() and not c.isdecimal() for c in every]), np.array([c.isupper() for c in every]), plain, undisguised)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _translated(codes: np.ndarray, table: int) -> list[str]:
    """The words of a text once its characters are translated."""
    out = _tables()[table][codes]
    return out[out != _DELETED].tobytes().decode("utf-32-le", "surrogatepass").split()


def _split(text: str) -> list[str]:
    return _translated(_codes(text.lower()), _PLAIN)


def features(text: str, stems: dict[str, float] | None = None) -> list[float]:
    """The numbers named in FEATURES, over the whole text; all zero for a text without words. ``stems``: the learned lexicon."""
    stems = stems or {}
    low = text.lower()
    codes = _codes(low)
    words = _translated(codes, _PLAIN)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    different = set(words)
    plain = [] if different.isdisjoint(_ALL) else [i for i, w in enumerate(words) if w in _ALL]
    found = [words[i] for i in plain]
    kinds = [sum(w in s for w in found) for s in (_INSULTS, _CONTEMPT, _HOSTILE)]
    # what only shows once look-alikes, separators, spelling out and stretched letters are undone; each pattern runs only
    # where its least part stands: three equal characters, a separator in every second place, a sign beside a letter
    letter = _tables()[_LETTER][codes]
    same = codes[1:] == codes[:-1]
    stretched = len(_RUN.findall(low)) if (same[1:] & same[:-1] & letter[2:]).any() else 0
    folded = _RUN.sub(r"\1", low) if stretched else low
    spelled = []
    for c in " .-_*":
        at = _codes(folded) == ord(c) if stretched else codes == ord(c)
        if (at[4:] & at[2:-2] & at[:-4]).any():
            spelled = [re.sub(r"[ .\-_*]", "", m[0]) for m in _SPELLED.finditer(folded)]
            break
    mixed = 0
    if any(c in low for c in "0123456789@$!|"):
        signs = np.isin(codes, _SIGNS)
        mixed = len(_MIXED.findall(low)) if (signs[1:] & letter[:-1]).any() else 0
    hidden = sum(w in _STRONG for w in spelled) + sum(w in _STRONG for w in _translated(_codes(folded), _UNDISGUISED))
    hidden = max(0, hidden - sum(w in _STRONG for w in found))
    you = [] if different.isdisjoint(_YOU) else [i for i, w in enumerate(words) if w in _YOU]
    near = densest = 0
    if plain:
        at = np.array(plain)
        if you:
            k = np.searchsorted(you, at)
            y = np.array([-10 * NEAR, *you, 10 * NEAR + n])
            near = int((np.minimum(at - y[k], y[k + 1] - at) <= NEAR).sum())
        densest = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
    learned = [s for s in [w[:STEM] for w in words] if s in stems] if any(w[:STEM] in stems for w in different) else []
    chars = len(text)
    upper = int(_tables()[_UPPER][_codes(text)].sum())
    capitals = sum([w.isupper() for w in text.split() if len(w) > 2]) if upper else 0
    return [float(x) for x in (
        np.log1p(n), *kinds, *(1000 * k / n for k in kinds), len(set(found)), hidden, 1000 * hidden / n, 1000 * len(you) / n, near, densest,
        upper / chars, capitals / n, sum(map(text.count, ".,;:!?")) / chars,
        1000 * text.count("!") / n, 1000 * text.count("?") / n, sum(map(text.count, "#$%&*@^~+=<>|\\{}[]_")) / chars, 1000 * mixed / n,
        1000 * stretched / n, chars / n, 1 - len(different) / n,
        len(learned), 1000 * len(learned) / n, len(set(learned)), sum(stems[s] for s in set(learned)))]


_INSULTS, _CONTEMPT, _HOSTILE, _YOU = map(frozenset, (INSULTS, CONTEMPT, HOSTILE, SECOND_PERSON))
_STRONG = _INSULTS | _CONTEMPT
_ALL = _STRONG | _HOSTILE


def learn_stems(taught: DataFrame, most: int = MOST_STEMS) -> list[dict[str, float]]:
    """Word beginnings that speak for the label, with their log lift: for each fold what the other folds teach, and last what all do.

    ``taught`` has text, label and fold. Tasks count first, each text once; at most ``most`` rows come to the driver for each lexicon.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[Counter]] = [[Counter(), Counter()] for _ in range(FOLDS)]
        for batch in batches:
            for text, label, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[fold][int(label)].update({w[:STEM] for w in _split(text.as_py() or "")})
                seen[fold][int(label)][""] += 1  # the number of texts
        for fold, pair in enumerate(seen):
            stems = list(pair[0].keys() | pair[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([fold] * len(stems), pa.int32()),
                                              *[pa.array([c[s] for s in stems], pa.int64()) for c in pair]], ["stem", "fold", "without", "with"])

    counts = (taught.select("text", "label", "fold").mapInArrow(run, "stem string, fold int, without long, `with` long").groupBy("stem").agg(
        *[F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(FOLDS + 1) for c in ("without", "with")]))
    counts = materialise(counts)
    total = counts.filter("stem = ''").first()
    found = []
    for k in range(FOLDS + 1):
        if total is None or not total[f"without_{k}"] or not total[f"with_{k}"]:
            found.append({})
            continue
        held = F.col(f"with_{k}")
        lift = (held / total[f"with_{k}"]) / ((F.col(f"without_{k}") + 0.5) / total[f"without_{k}"])
        rows = (counts.filter((F.col("stem") != "") & (held >= max(3, LEAST_PART * total[f"with_{k}"])))
                .select("stem", F.log(lift).alias("weight"), held.alias("with")).filter(F.col("weight") >= math.log(LEAST_LIFT))
                .orderBy(F.desc(F.col("weight") * F.col("with")), "stem").limit(most).collect())
        found.append({r.stem: r.weight for r in rows})
    return found


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stems: list[dict[str, float]] | None = None,
                  own: tuple[str, ...] = (), fold_col: str | None = None) -> DataFrame:
    """(id, features array<double>) of each row's whole text, and its columns ``own``; a null text counts as empty.

    The last lexicon of ``stems`` serves all rows, or each row the one of its fold where ``fold_col`` (one of ``own``) is named.
    """
    stems = stems or [{}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(2 + own.index(fold_col)).to_pylist() if fold_col else [-1] * batch.num_rows
            rows = [features(t.as_py() or "", stems[k]) for t, k in zip(batch.column(1), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], [id_col, "features", *own])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *own)]
    return docs.select(id_col, text_col, *own).mapInArrow(run, ", ".join([kinds[0], "features array<double>", *kinds[1:]]))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no rest modulo 5; such rows never teach. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def calibration_rows(margins: DataFrame, mean: float) -> DataFrame:
    """The rows for the isotonic fit, and at either end one more row that holds the mean label: steps of few rows don't reach 0 or 1."""
    ends = margins.agg(F.min("margin").alias("low"), F.max("margin").alias("high"))
    return margins.select("margin", "label").unionByName(ends.select(F.explode(F.array("low", "high")).alias("margin"), F.lit(float(mean)).alias("label")))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most_rows: int = 100_000, trees: int = 20, depth: int = 4, row_col: str | None = None, most_stems: int = MOST_STEMS) -> DataFrame:
    """(id, held_out, score, predicted), and ``row_col`` if named, for each row: a calibrated probability of the label, and score >= 0.5.

    Only the text enters a score. What is learned comes from labelled rows outside the held-out fold, cross-fitted over three
    folds (by a hash of the id): a row's lexicon of word beginnings, and the trees that judge it for the calibration, come from the
    other folds alone, so all labelled rows calibrate one isotonic fit. The lexicon and the trees of all folds then score all rows.
    ``most_rows`` bounds the labelled rows used for learning (beyond it a hash of the id picks as many), ``most_stems`` the lexicon.

    Labels are averaged by id first (null labels are none), so repeated labels add no rows. An id
    with several texts teaches with each. Where a fold's others lack one of the two classes, all scores are the mean label; without
    labels they are 0. Few labels give scores near the mean: one row of the mean label stands at either end of the calibration.
    Empty and null texts get a score like others, from features that are zero. Every
    row of ``docs`` is returned, repeated rows and null ids too; an empty table gives no rows. Other
    columns are left out.
    """
    own = (row_col,) if row_col else ()
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("y")).filter("of IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("of").agg((F.avg("y") >= 0.5).cast("double").alias("label")).filter(~held_out("of"))
    draw = F.crc32(F.concat(F.lit("draw "), F.col("of").cast("string"))) / float(1 << 32)
    n = known.count()
    fold = (F.crc32(F.concat(F.lit("part "), F.col("of").cast("string"))) % FOLDS).cast("int")
    known = materialise(known.filter(draw < F.lit(min(1.0, 0.95 * most_rows / max(n, 1)))).withColumn("fold", fold))
    # broadcast: at most about most_rows rows of three numbers
    named = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text"))
    taught = materialise(named.join(F.broadcast(known), "of"))
    sums = {(r["fold"], r.label): r["count"] for r in taught.groupBy("fold", "label").count().collect()}
    total = sum(sums.values())
    mean = sum(c for (_, y), c in sums.items() if y) / total if total else 0.0
    if not all(sum(c for (k, label), c in sums.items() if label == y and k != out) for out in range(FOLDS) for y in (0.0, 1.0)):
        return docs.select(id_col, held_out(id_col).alias("held_out"), F.lit(float(mean)).alias("score"), F.lit(int(mean >= 0.5)).alias("predicted"), *own)
    stems = learn_stems(taught, most_stems)
    # every tree is several jobs over these few rows, so they are kept in few partitions
    vectors = feature_table(taught, "of", "text", stems, ("label", "fold"), "fold").select(array_to_vector("features").alias("x"), "label", "fold")
    vectors = materialise(vectors).coalesce(-(-total // 20_000))

    def fit(rows: DataFrame):
        return GBTClassifier(featuresCol="x", labelCol="label", predictionCol="p", maxIter=trees, maxDepth=depth, stepSize=0.25, maxBins=48, minInstancesPerNode=5, seed=1).fit(rows)

    def margin(model, rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("margin", vector_to_array("probability")[1])

    margins = None
    for k in range(FOLDS):
        one = margin(fit(vectors.filter(F.col("fold") != k)), vectors.filter(F.col("fold") == k)).select("margin", "label")
        margins = one if margins is None else margins.unionByName(one)
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(calibration_rows(materialise(margins), mean))
    table = feature_table(docs, id_col, text_col, stems[-1:], own).withColumn("x", array_to_vector("features"))
    scored = steps.transform(margin(fit(vectors), table).select(id_col, "margin", *own))
    limited = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(id_col, held_out(id_col).alias("held_out"), limited.alias("score"), (limited >= 0.5).cast("int").alias("predicted"), *own)
