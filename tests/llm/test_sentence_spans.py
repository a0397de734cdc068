import random

from techtrail.llm import sentence_spans as s


def test_sentences_join_to_the_text():
    for text in ["", " ", "One. Two! Three?\nFour", "\n\n  A.  B\n", "no end", "a.b c. d..."]:
        assert "".join(s.sentences(text)) == text
    assert s.sentences("One. Two!\nThree") == ["One. ", "Two!\n", "Three"]


def brute(rows, run, words, long_words):
    """Texts by id: each run is looked up among all runs before it."""
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(i, t)
    first, cut = {}, {i: set() for i in texts}
    for i in sorted(texts):
        parts = [x.split() for x in s.sentences(texts[i])]
        for begin, end in s.spans([len(x) for x in parts], run, words, long_words):
            key = tuple(w for x in parts[begin:end] for w in x)
            if first.setdefault(key, (i, begin)) != (i, begin):
                cut[i] |= set(range(begin, end))
    return {i: "".join(x for k, x in enumerate(s.sentences(t)) if k not in cut[i]).strip() if cut[i] else t for i, t in texts.items()}


def test_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) + rng.choice([". ", "! ", ".\n"])
    passages = ["".join(sentence() for _ in range(rng.randint(2, 8))) for _ in range(5)] + [" ".join(words[:60]) + ". "]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[0][1]), (63, " ".join(words[:60]) + ".")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, begin int")
    found = {r["doc_id"]: r["text"] for r in s.remove_repeats(frame).collect()}
    want = brute(rows, s.RUN, s.WORDS, s.LONG_WORDS) | {60: None}
    assert found == want
    assert found[62] == "" and found[63] == "" and sum(a != b for (_, a), b in zip(rows, found.values(), strict=False)) > 10


def test_whole_passages_are_covered():
    rng = random.Random(4)
    for _ in range(300):
        counts = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        if sum(counts) <= 50:
            continue
        covered = {k for begin, end in s.spans(counts) for k in range(begin, end)}
        assert len(counts) < s.RUN or covered == set(range(len(counts)))
        assert covered


def test_equal_ids_null_ids_and_no_rows(spark):
    long = " ".join(f"x{i}" for i in range(50)) + "."
    rows = [(1, long), (1, long), (None, long), (None, "short one."), (2, "clean text here.")]
    found = s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in found) == sorted([(1, long), (1, long), (-1, ""), (-1, "short one."), (2, "clean text here.")])
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_portions_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(60)) + ". " for k in range(3)]
    rows = [(i % 40 if i % 9 else None, "".join(rng.choice(passages) if rng.random() < 0.5 else f"own{i} words here. " for _ in range(4))) for i in range(80)]
    frame = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string").repartition(3).cache()
    found = []
    for portion in (1, 40, s.PORTION):
        monkeypatch.setattr(s, "PORTION", portion)
        found.append(sorted((r["doc_id"] or -1, r["text"]) for r in s.remove_repeats(frame).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 100


def test_null_ids_are_told_apart_by_their_texts(spark):
    passage = " ".join(f"x{i}" for i in range(60)) + "."
    rows = [(None, f"{passage} Own text {i}.") for i in range(3)]
    found = s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(passage in r["text"] for r in found) == 1 and all("Own text" in r["text"] for r in found)


def test_long_runs_of_stops_take_linear_time():
    for text in ("." * 200_000 + " a", ". " * 200_000, "word. " * 100_000, "a!?" * 100_000):
        parts = s.sentences(text)
        assert "".join(parts) == text and len(s.spans([len(x.split()) for x in parts])) <= len(parts)


def test_passages_that_begin_and_end_inside_sentences(spark):
    rng = random.Random(7)
    own = lambda k, n: " ".join(f"d{k}x{i}" for i in range(n))
    rows, shared = [], []
    for k, lengths in enumerate([(17, 17, 17), (14, 14, 14, 14), (26, 25), (51,), (60, 60)]):
        passage = [f"p{k}w{i}" for i in range(sum(lengths))]
        for at in range(1, len(lengths)):
            passage[sum(lengths[:at]) + rng.randint(-5, 0)] += "."
        shared.append(" ".join(passage))
        rows += [(10 * k + i, f"{own(10 * k + i, 30)}. {own(10 * k + i, 9)} {shared[-1]} {own(10 * k + i, 8)}. {own(10 * k + i, 5)}!") for i in range(2)]
    texts = {r["doc_id"]: r for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    runs = lambda text: {tuple(w[i : i + 51]) for w in [text.split()] for i in range(len(w) - 50)}
    for k in range(len(shared)):
        first, second = texts[10 * k], texts[10 * k + 1]
        assert first["text"] == dict(rows)[10 * k] and second["sentences removed"] > 0
        assert not runs(first["text"]) & runs(second["text"])
        assert [w for w in dict(rows)[10 * k + 1].split() if w.startswith("d")] == [w for w in second["text"].split() if w.startswith("d")]


def test_equal_passages_have_a_run_in_common_wherever_they_stand():
    rng = random.Random(8)
    for _ in range(200):
        passage = [f"w{rng.randint(0, 50)}" for _ in range(s.EDGE + s.WINDOW - 1)]
        found = []
        for _ in range(2):
            text = [[str(rng.random()) for _ in range(rng.randint(0, 40))] for _ in range(2)]
            words = [*text[0], *passage, *text[1]]
            found.append({tuple(words[i : i + s.EDGE]) for i in runs(words)})
        assert found[0] & found[1]
    assert runs(["a"] * 50) == [] and runs(["a"] * 51) == list(range(22))


def runs(*texts):
    return s.word_runs(s.Ranges([w for x in texts for w in x]), s.np.cumsum([len(x) for x in texts])).tolist()


def test_runs_of_one_text_do_not_depend_on_others():
    rng = random.Random(11)
    texts = [[str(rng.random()) for _ in range(n)] for n in (0, 20, 51, 52, 400, 30, 90, 50, 1)]
    at, wanted = 0, []
    for x in texts:
        wanted += [at + i for i in runs(x)]
        at += len(x)
    assert runs(*texts) == wanted and len(wanted) > 20


def test_hashes_of_stretches_tell_words_apart():
    rng = random.Random(12)
    words = [rng.choice("abcd") for _ in range(3000)]
    ranges, found = s.Ranges(words), {}
    for size in (1, 2, 5, 16, 31):
        begins = s.np.arange(len(words) - size)
        for i, key in zip(begins, zip(ranges.high(begins, begins + size).tolist(), ranges.low(begins, begins + size).tolist(), strict=True), strict=True):
            assert found.setdefault(key, words[i : i + size]) == words[i : i + size]
    assert len(found) == len({tuple(x) for x in found.values()})
