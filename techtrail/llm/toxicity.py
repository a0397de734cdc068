"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: how many and how dense the words of a fixed abuse lexicon are, and those of one learned from labelled texts (words and
beginnings of words far more frequent in toxic texts), how often a word of
the second person is near one, rates of capitals, exclamation and other signs, and of
obfuscated words (letters with digits or signs between them), with those that
read as a lexicon word. The lexicon learns from one half of the labelled rows and trees from most of the rest, so that
they see it as it does on new texts; isotonic regression maps their probabilities to scores on what remains.

Defined results: a null text is an empty one and is scored like any other; without labels of both kinds every score is the
labels' mean (0 if there are none); repeated rows have equal scores; an empty table gives an empty
result. Labels, language, source and id are no input of a score. Long texts are read whole, in time in proportion to their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from techtrail.llm.common import small_batches, stash, text_or_empty

#: Labelled rows that a model is fitted on at most, those of least hash. Of ten parts, five teach the lexicon, four the trees, one calibrates.
TRAINING_ROWS = 40_000
#: Of a term of the learned lexicon: the texts of label 1 that have it at least, and its least log odds. TRAINING_ROWS bounds the lexicon.
TERM_TEXTS, TERM_ODDS = 3, 2.5
#: Bytes of a word's beginnings that can be terms.
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, STEP = 20, 4, 0.3
#: Bytes of the words whose weights a worker keeps (500,000 words, some 60 MB, at most).
SHORT = 40

# Words of abuse in four languages, and words of the second person.
LEXICON = """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass loser losers scum scumbag trash garbage worthless
pathetic disgusting clown clowns fool fools imbecile imbeciles jerk jerks bastard bastards bitch bitches asshole assholes
shit shitty bullshit crap fuck fucking fucked fucker damn pig pigs swine vermin filth filthy freak freaks creep creeps
coward cowards liar liars retard retarded cretin cretins dimwit halfwit brainless useless hateful hate kill die ugly vile
repulsive sickening despicable subhuman parasite parasites rat rats snake slut whore dickhead prick wanker twat cunt
idiota idiotas imbécil estúpido estúpida tonto basura asqueroso asquerosa inútil payaso mierda puta cabrón pendejo gilipollas escoria
idiote idiots imbécile crétin crétine stupide connard connasse salaud salope merde ordure minable dégoûtant pitoyable bouffon débile
dumm dummkopf vollidiot trottel arschloch scheiße scheisse abschaum wertlos erbärmlich widerlich ekelhaft hure schwein""".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tuyo usted ustedes vosotros vuestro".split()
LEET = str.maketrans("013457@$!|+", "oieastasiit")

LEXICON_BYTES, SECOND_BYTES = frozenset(x.encode() for x in LEXICON), frozenset(x.encode() for x in SECOND_PERSON)
#: Words on either side of a lexicon word where the second person counts.
NEAR = 5
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
TO_SPACE = bytes.maketrans(SIGNS, b" " * len(SIGNS))
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
OBFUSCATED = re.compile(rb"(?<![a-z0-9])[a-z]+[0-9@$!|+*#]+[a-z][a-z0-9@$!|+*#]*|(?<![a-z0-9])[a-z](?:[-._][a-z]){3,}(?![a-z])")
NAMES = ["log_words", "abuse", "abuse_density", "abuse_kinds", "near_second", "second_density", "capitals", "exclamations", "questions", "signs", "digits", "obfuscated", "obfuscated_abuse", "word_bytes", "capital_words", "learned", "learned_density", "learned_kinds", "learned_weight"]


def reads_as_abuse(word: bytes) -> bool:
    """Whether an obfuscated word is a lexicon word when signs are read as letters; * and # stand for any letter."""
    text = word.decode("utf-8", "replace").rstrip("!|+*#")  # signs after a word are no letters of it
    plain = text.translate(LEET).replace("-", "").replace(".", "").replace("_", "")
    if "*" not in plain and "#" not in plain:
        return plain in ABUSE
    letters = plain.replace("#", "*")
    return any(len(x) == len(letters) and all(a in ("*", b) for a, b in zip(letters, x, strict=True)) for x in ABUSE)


ABUSE = frozenset(LEXICON)


def terms(word: bytes) -> list[bytes]:
    """What a word can be in the learned lexicon: itself, and its beginnings, marked by a *."""
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]


class Weights(dict):
    """The largest weight of a word's terms, 0 if it has none; filled as words are asked for, with those of up to SHORT bytes."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        weight = max(self.lexicon.get(x, 0.0) for x in terms(word))
        if len(word) <= SHORT:
            if len(self) >= 500_000:
                self.clear()
            self[word] = weight
        return weight


def features(text: str, weights: Weights) -> list[float]:
    """The features of NAMES."""
    data = text.encode()
    low = data.lower()
    words = low.translate(TO_SPACE).split()
    n, size = max(1, len(words)), max(1, len(data))
    abuse = [i for i, w in enumerate(words) if w in LEXICON_BYTES]
    second = sum([w in SECOND_BYTES for w in words])
    near = sum(any(w in SECOND_BYTES for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in abuse)
    odd = OBFUSCATED.findall(low)
    learned = [w for w in words if weights[w]]
    signs = len(data) - len(data.translate(None, SIGNS))
    return [
        math.log1p(len(words)),
        float(len(abuse)),
        1000 * len(abuse) / n,
        float(len({words[i] for i in abuse})),
        float(near),
        1000 * second / n,
        (size - len(data.translate(None, UPPER))) / size if data else 0.0,
        1000 * data.count(b"!") / n,
        1000 * data.count(b"?") / n,
        1000 * (signs - data.count(b".") - data.count(b",")) / n,
        1000 * (len(data) - len(data.translate(None, DIGITS))) / n,
        1000 * len(odd) / n,
        float(sum(map(reads_as_abuse, odd))),
        len(low) / n,
        sum([w.isupper() for w in data.split()]) / n,
        float(len(learned)),
        1000 * len(learned) / n,
        float(len(set(learned))),
        sum([weights[w] for w in learned]) / n,
    ]


def with_features(df: DataFrame, lexicon: dict[bytes, float], name: str = "toxicity features") -> DataFrame:
    """Adds, or replaces, the array of features."""
    kept = df.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in small_batches(batches, "text"):
            made = [features(x or "", weights) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, StructType([*(StructField(x.name, x.dataType) for x in kept.schema.fields), StructField(name, ArrayType(DoubleType()))]))


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """labelled_id, label, part (0 to 9): the rows to learn from, of an id's labels the largest."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").alias("labelled_id")).agg((F.max("toxic") > 0).cast("double").alias("label"))
    return stash(known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows).withColumn("part", F.pmod(F.xxhash64("labelled_id", F.lit(1)), F.lit(10))))


def learn_lexicon(documents: DataFrame, known: DataFrame) -> dict[bytes, float]:
    """Log odds of all terms that are far more frequent in texts of label 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found: dict[bytes, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for term in {x for w in set((text or "").encode().lower().translate(TO_SPACE).split()) for x in terms(w)}:
                    found.setdefault(term, [0, 0])[label > 0] += 1
            columns = [pa.array(found.keys(), pa.binary()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[0] for x in found.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    teaching = F.broadcast(known.where("part < 5").select("labelled_id", "label"))  # at most TRAINING_ROWS rows
    texts = documents.join(teaching, documents["doc_id"] == teaching["labelled_id"]).select(documents["text"], teaching["label"])
    total = {r["label"]: r["count"] for r in known.where("part < 5").groupBy("label").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (total.get(1.0, 0) + 1)) - F.log((F.col("clean") + 0.5) / (total.get(0.0, 0) + 1))
    counted = texts.mapInArrow(count, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counted.where(F.col("toxic") >= TERM_TEXTS).select("term", odds.alias("odds")).where(F.col("odds") >= TERM_ODDS)
    return {bytes(r["term"]): r["odds"] for r in best.collect()}  # terms of at most TRAINING_ROWS texts


class ToxicityModel:
    """Scores an array of features; without trees, all alike."""

    def __init__(self, trees=None, calibration=None, constant: float = 0.0):
        self.trees, self.calibration, self.constant = trees, calibration, constant

    def score(self, df: DataFrame, name: str = "toxicity features", out: str = "score") -> DataFrame:
        """df with a score in place of the features."""
        if self.trees is None:
            return df.withColumn(out, F.lit(self.constant)).drop(name)
        work = ["toxicity vector", "toxicity raw", "toxicity odds", "toxicity guess", "toxicity score"]
        scored = self.trees.transform(df.drop(*work).withColumn("toxicity vector", array_to_vector(F.col(f"`{name}`"))))
        scored = self.calibration.transform(scored.withColumn("toxicity odds", vector_to_array("toxicity odds")[1]))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("toxicity score")))
        return scored.withColumn("toxicity score", score).drop(name, *([out] if out in df.columns else [])).withColumnRenamed("toxicity score", out).drop(*work[:-1])


def fit(marked: DataFrame, known: DataFrame) -> ToxicityModel:
    """A model from features (doc_id, "toxicity features") and labelled rows."""
    sample = marked.join(known.where("part >= 5"), marked["doc_id"] == known["labelled_id"])
    sample = stash(sample.select("label", array_to_vector("toxicity features").alias("toxicity vector"), (F.col("part") == 9).alias("calibrates")))
    seen = {(r["calibrates"], r["label"]): r["count"] for r in sample.groupBy("calibrates", "label").count().collect()}
    if len(seen) < 4:
        total = sum(seen.values())
        return ToxicityModel(constant=float(sum(k[1] * v for k, v in seen.items()) / total) if total else 0.0)
    boosting = GBTClassifier(featuresCol="toxicity vector", labelCol="label", predictionCol="toxicity guess", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7)
    boosting.setProbabilityCol("toxicity odds").setRawPredictionCol("toxicity raw")
    trees = boosting.fit(sample.where("not calibrates"))
    # most rows share a few odds, by which the regression deals them: they are one row for each of the odds, of their number's weight
    odds = trees.transform(sample.where("calibrates")).groupBy(vector_to_array("toxicity odds")[1].alias("toxicity odds")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("rows"))
    calibration = IsotonicRegression(featuresCol="toxicity odds", labelCol="label", weightCol="rows", predictionCol="toxicity score").fit(odds)
    return ToxicityModel(trees, calibration)


def score_all(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, ToxicityModel, dict[bytes, float]]:
    """(doc_id and score of each document, the model, its lexicon)."""
    known = labelled(labels)
    lexicon = learn_lexicon(documents, known)
    marked = stash(with_features(documents.select("doc_id", "text"), lexicon).drop("text"))
    model = fit(marked, known)
    return model.score(marked), model, lexicon


def op7_toxicity_trees(spark, sf_dir):
    """Toxicity score of each document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    scored, _, _ = score_all(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
