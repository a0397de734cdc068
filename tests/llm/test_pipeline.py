"""Each stage against a plain version of what it decides."""

import corpus_pipeline
from pyspark.sql import functions as F
from techtrail.llm import sentence_spans, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 5000}" for i in range(n))


def documents(spark):
    passage = ". ".join(words(77 + k, 20) for k in range(4)) + "."
    texts = [words(1, 80) + ".", words(1, 80) + ".", words(2, 90) + ".", f"{words(3, 30)}.\n{passage}\n{words(4, 30)}.", f"{words(5, 30)}.\n{passage}\n{words(6, 30)}.", f"{words(8, 40)} token = abcdefgh1 end.", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2], (None, words(9, 60), None, None, None)], COLUMNS), passage


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_near_duplicates_keep_one_of_each_group(spark):
    docs, _ = documents(spark)
    kept = stage("near-duplicates")(spark, docs, "")
    assert kept.columns == docs.columns
    value = {i: simhash.fingerprint(t or "") for i, t in by_id(docs).items() if i is not None}
    groups = {i: min(j for j in value if (value[i] ^ value[j]).bit_count() <= 3) for i in value}  # no chains here
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(set(groups.values()))
    assert kept.where("doc_id is null").count() == 1


def test_repeats_are_cut_once(spark):
    docs, passage = documents(spark)
    cut = stage("substring dedup")(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    found = by_id(cut)
    assert found[3] == by_id(docs)[3] and passage not in found[4] and found[4].startswith(words(5, 30)) and found[4].endswith(words(6, 30) + ".")
    assert len(sentence_spans.sentences(found[4])) == 2
    assert cut.where("doc_id = 4").first()["n_chars"] == len(found[4])


def test_secrets_are_marked(spark):
    docs, _ = documents(spark)
    marked = stage("secrets")(spark, docs, "")
    assert marked.columns == docs.columns
    before, after = by_id(docs), by_id(marked)
    assert after[5] == before[5].replace("token = abcdefgh1", "[secret]")
    assert all(after[i] == before[i] for i in before if i != 5)


def test_toxicity_drops_what_the_model_rejects(spark, tmp_path):
    rows = [(i, words(i, 40) + (" scum moron scum" if i % 3 == 0 else ""), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = stage("toxicity")(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 3}


def test_run_takes_every_stage_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "substring dedup", "secrets", "packing"]
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r["doc_id"] for r in packed}
    assert 100 < len(ids) <= 200
    sums = {}
    for r in packed:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 2048


def names_in_use():
    """Every text in the subpackage's source that could be a column's name."""
    import ast
    from pathlib import Path

    import techtrail.llm

    files = [*Path(techtrail.llm.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]
    found = {x.value for f in files for x in ast.walk(ast.parse(f.read_text())) if isinstance(x, ast.Constant) and isinstance(x.value, str)}
    short = {x.strip("`") for x in found if 0 < len(x) <= 40 and "\n" not in x and "`" not in x.strip("`")}
    lower = {}
    for x in sorted(short - {"doc_id", "text", "n_chars"}):
        lower.setdefault(x.lower(), x)
    return sorted(v for k, v in lower.items() if k not in ("doc_id", "text", "n_chars", "lang", "source"))


def test_other_columns_keep_their_values_in_every_stage(spark, tmp_path):
    names = names_in_use()
    assert {"label", "sentences", "repeated spans", "toxicity features", "other id", "component", "key", "secret_spans", corpus_pipeline.BOX} <= set(names)
    rows = [(i, words(i, 40) + (" scum moron scum" if i % 3 == 0 else ""), "en", "s", i) for i in range(60)]
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    docs = docs.select("*", *(F.concat(F.lit(f"{x} "), F.col("doc_id").cast("string")).alias(x) for x in names))
    for name, run in corpus_pipeline.STAGES:
        made = run(spark, docs, str(tmp_path))
        if name == "packing":
            assert {r["doc_id"] for r in made.select("doc_id").collect()} == set(range(60))
            continue
        assert made.columns == docs.columns
        kept = made.collect()
        assert kept and all(r[x] == f"{x} {r['doc_id']}" for r in kept for x in names)
