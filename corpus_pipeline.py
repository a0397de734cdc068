"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents:

1. toxicity: documents that the model rejects go;
2. near-duplicates: of each SimHash component the document of smallest doc_id stays;
3. substring dedup: sentences of repeated spans are cut from texts, the rows stay;
4. secrets: spans are replaced by a mark, the rows stay;
5. packing: sequences of at most 2048 tokens.

n_chars follows the text where a stage changes it. Rows that share a doc_id and a text are one document to stages 1 to 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from techtrail.llm import packing, secrets, sentence_spans, simhash, toxicity
from techtrail.llm.common import stash, stashed
from techtrail.sources.shared import remove_path

#: SQL for run()'s rows: none, since no stage can be said in SQL; each is tested against a plain version.
ORACLE_SQL = None


#: Documents' other columns while a stage is at work: in one column, so that no name of theirs meets one of the stage's.
BOX = "other columns of document"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one."""
    others = [F.col(_quoted(x)).alias(x) for x in docs.columns if x not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias(BOX))


def _opened(boxed: DataFrame, docs: DataFrame, recount: bool = False) -> DataFrame:
    """The columns of docs again; recount: n_chars, where there is such a column, of the present text."""
    made = []
    for field in docs.schema.fields:
        column = F.col(field.name) if field.name in ("doc_id", "text") else F.col(BOX).getField(field.name)
        if recount and field.name == "n_chars":
            column = F.length("text").cast(field.dataType)
        made.append(column.alias(field.name))
    return boxed.select(*made)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5."""
    boxed = _boxed(docs)
    _, model, lexicon = toxicity.score_all(boxed, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(toxicity.with_features(boxed, lexicon), out="toxicity score")
    return _opened(scored.where(F.col("`toxicity score`") < 0.5), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of smallest doc_id, once if its row is repeated. Null ids name no document and stay."""
    boxed = _boxed(docs)
    found = simhash.near_duplicates(boxed)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("other id"), F.col("digest").alias("other digest")).distinct()
    kept = boxed.join(gone, (boxed["doc_id"] == gone["other id"]) & (F.xxhash64(boxed["text"]) == gone["other digest"]), "left_anti")
    again = stash(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("other id")))
    if again.isEmpty():  # the usual case: ids are unique, and no row is moved to find out
        return _opened(kept, docs)
    one = kept.join(again, kept["doc_id"] == again["other id"], "left_semi").dropDuplicates(["doc_id"])
    return _opened(kept.join(again, kept["doc_id"] == again["other id"], "left_anti").unionByName(one), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of spans that another document has already."""
    return _opened(sentence_spans.remove_repeats(_boxed(docs)), docs, recount=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret."""
    return _opened(secrets.redact(_boxed(docs), secrets.identifier_dictionary(docs)), docs, recount=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's sequence and place."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each over what its predecessor kept. When a stage's result is written, what it was made from is deleted; the last result is read from the tables of the last two."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with stashed() as made:
            docs = stash(stage(spark, docs, sf_dir))
        for path in before + made[:-1]:
            remove_path(spark, path)
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
