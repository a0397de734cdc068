"""Patterns in histories: how labels come, go and replace each other."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from techtrail.sources.shared import written


def prefixspan(sequences: DataFrame, min_support: float, max_length: int) -> DataFrame:
    """sequence (array of sorted itemsets), freq. Mined when this is called."""
    found = PrefixSpan(minSupport=min_support, maxPatternLength=max_length, sequenceCol="sequence").findFrequentSequentialPatterns(sequences.select("sequence"))
    return found.select(F.transform("sequence", lambda s: F.sort_array(s)).alias("sequence"), "freq")


def pattern_text(sequence: Column) -> Column:
    """Itemsets joined by |, items of one by a space."""
    return F.array_join(F.transform(sequence, lambda s: F.array_join(s, " ")), "|")


def contains_pattern(sequence: Column, pattern: Column) -> Column:
    """Whether the itemsets of pattern are contained, in order, in different itemsets of sequence."""
    step = lambda i, s: F.when((i < F.size(pattern)) & (F.size(F.array_except(F.get(pattern, i), s)) == 0), i + 1).otherwise(i)
    return F.aggregate(sequence, F.lit(0), step) == F.size(pattern)


#: Patterns in one array, and parts that the sequences of one item are dealt to.
PATTERN_BLOCK, PATTERN_SALT = 256, 64


def pattern_sids(patterns: DataFrame, sequences: DataFrame, project: str) -> DataFrame:
    """pattern (text), freq, project: a row for each pattern and project whose sequence contains it.

    Patterns that begin with the same item stand in arrays of about PATTERN_BLOCK; a sequence meets those of its items, and is tested against a whole array at
    once. Items are few, so the sequences of each are dealt to PATTERN_SALT parts, and the arrays, which are small, to all of these. Patterns are counted when this is called.
    """
    blocks = patterns.count() // PATTERN_BLOCK + 1
    named = patterns.select(F.col("sequence")[0][0].alias("item"), F.struct(pattern_text(F.col("sequence")).alias("pattern"), F.col("sequence").alias("itemsets"), "freq").alias("p"))
    arrays = named.groupBy("item", F.pmod(F.xxhash64("p.pattern"), F.lit(blocks)).alias("block")).agg(F.collect_list("p").alias("patterns"))
    dealt = arrays.select("item", "patterns", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PATTERN_SALT - 1).cast("long"))).alias("salt"))
    items = sequences.select(project, "sequence", F.pmod(F.xxhash64(project), F.lit(PATTERN_SALT)).alias("salt"), F.explode(F.array_distinct(F.flatten("sequence"))).alias("item"))
    own = F.filter("patterns", lambda p: contains_pattern(F.col("sequence"), p["itemsets"]))
    return items.join(dealt, ["item", "salt"]).select(project, F.explode(own).alias("p")).select("p.pattern", "p.freq", project)


def mine_lists(hist: DataFrame, min_support: float, max_length: int, project: str = "user_id") -> DataFrame:
    """pattern (text), freq, project: the patterns of up to max_length items that enough projects have in their slices (project, part, label), with each project that has them.

    Each pattern has a list of the places (project, part) where its last itemset can stand. A level joins these lists with the labels: a label of a later part than the pattern's first place makes a new itemset, a
    label of the same part that comes after the last one, by name, goes into the last itemset. So mining gives the projects, and no history is matched against patterns. The lists of each level are written when this is called.
    """
    places = written(hist.select(project, "part", "label").distinct(), "places")
    least = F.ceil(F.countDistinct(project) * F.lit(min_support) - 1e-9)
    least = places.agg(least.alias("least")).first()["least"]
    lists, found = places.select(F.col("label").alias("pattern"), F.col("label").alias("last"), project, "part"), None
    for length in range(1, max_length + 1):
        every = written(lists, "lists")
        firsts = every.groupBy("pattern", "last", project).agg(F.min("part").alias("first"))
        frequent = written(firsts.groupBy("pattern").agg(F.count("*").alias("freq")).where(F.col("freq") >= least), "frequent")
        kept = firsts.join(frequent, "pattern")
        own = kept.select("pattern", "freq", project)
        found = own if found is None else found.unionByName(own)
        if length == 1:
            places = written(places.join(frequent.select(F.col("pattern").alias("label")), "label", "left_semi"), "places")
        later = kept.join(places, project).where("part > first").select(F.concat("pattern", F.lit("|"), "label").alias("pattern"), F.col("label").alias("last"), project, "part")
        beside = every.join(frequent, "pattern", "left_semi").join(places, [project, "part"]).where(F.col("label") > F.col("last"))
        lists = later.unionByName(beside.select(F.concat("pattern", F.lit(" "), "label").alias("pattern"), F.col("label").alias("last"), project, "part"))
    return found


def life(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """For each project and label: n_in (INIT counts), n_out, first and last part present, n_parts, in_last."""
    present = F.when(F.col("op") != "OUT", F.col("part"))
    return trans.groupBy(project, "label").agg(
        F.count_if(F.col("op").isin("INIT", "IN")).alias("n_in"),
        F.count_if(F.col("op") == "OUT").alias("n_out"),
        F.min(present).alias("first_part"),
        F.max(present).alias("last_part"),
        F.max("n_parts").alias("n_parts"),
    ).withColumn("in_last", F.col("last_part") == F.col("n_parts"))


#: The closed list of patterns over one label X; -> is a later slice, $ the last slice, ~ never.
COUNTED = {
    "InX": "n_in >= 1",
    "InX -> InX": "n_in >= 2",
    "OutX": "n_out >= 1",
    "OutX -> OutX": "n_out >= 2",
    "InX -> OutX": "n_out >= 1",
    "InX -> OutX -> InX": "n_in >= 2",
    "$X": "in_last",
    "X ~OutX": "n_out = 0",
    "OutX & $X": "n_out >= 1 and in_last",
}


def count_pattern(trans: DataFrame, names: list[str] | None = None, project: str = "user_id") -> DataFrame:
    """name, label, line_count, support: in how many projects each pattern holds for a label, and their share of all projects."""
    lives = life(trans, project)
    total = trans.agg(F.countDistinct(project).alias("n_projects"))
    held = F.explode(F.array_compact(F.array(*(F.when(F.expr(COUNTED[x]), F.lit(x)) for x in names or COUNTED)))).alias("name")
    counted = lives.select("label", held).groupBy("name", "label").agg(F.count("*").alias("line_count"))
    return counted.crossJoin(F.broadcast(total)).select("name", "label", "line_count", (F.col("line_count") / F.col("n_projects")).alias("support"))  # total is one row


def depth(trans: DataFrame, most: int = 4, project: str = "user_id") -> DataFrame:
    """label, times, inserted, removed: projects in which a label was inserted, or removed, at least so many times."""
    lives = life(trans, project)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.least(F.col(c), F.lit(most)).cast("int").alias("n")) for k, c in (("in", "n_in"), ("out", "n_out"))))
    rows = lives.select("label", F.explode(kinds).alias("k")).where("k.n > 0").select("label", "k.kind", F.explode(F.sequence(F.lit(1), F.col("k.n"))).alias("times"))
    return rows.groupBy("label", "times").agg(F.count_if(F.col("kind") == "in").alias("inserted"), F.count_if(F.col("kind") == "out").alias("removed"))


def _leaving(trans: DataFrame, project: str) -> DataFrame:
    """A row for each label x that leaves and each label y that is present in the same slice: project, part, x, y and what is known of both. Rows meet by project and slice alone."""
    own = Window.partitionBy(project, "label")
    ordered = own.orderBy("part")
    seen = trans.select(
        project,
        "part",
        "label",
        "op",
        F.min(F.when(F.col("op") != "OUT", F.col("part"))).over(own).alias("first_part"),
        F.max(F.when(F.col("op") != "OUT", F.col("part"))).over(own).alias("last_part"),
        F.max(F.when(F.col("op") == "IN", F.col("part"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("entered"),
        F.lag("op").over(ordered).alias("op_before"),
        ((F.lead("op").over(ordered) == "KEEP") & (F.lead("part").over(ordered) == F.col("part") + 1)).alias("kept_next"),
    )
    gone = seen.where("op = 'OUT'").select(project, "part", F.col("label").alias("x"), F.col("first_part").alias("x_first"), (F.col("op_before") == "KEEP").alias("x_was_kept"))
    there = seen.where("op <> 'OUT'").withColumnRenamed("label", "y")
    return gone.hint("merge").join(there, [project, "part"])  # read from files, both are sized by what they take there, a small part of what they take in memory


def substitution_cases(trans: DataFrame, project: str = "user_id", adjacent: bool = False) -> DataFrame:
    """pattern, project, x, y: cases of y replacing x, one row each.

    S1: in one slice x leaves and y enters, and y is present in a later slice (adjacent: in the next).
    S2: x is present, in a later slice y enters, and in a later one still x leaves while y is present (adjacent: each in the slice after the other).
    """
    stays = F.col("kept_next") if adjacent else F.col("last_part") > F.col("part")
    came = (F.col("entered") == F.col("part") - 1) & F.col("x_was_kept") if adjacent else F.col("entered") > F.col("x_first")
    held = F.array_compact(F.array(F.when((F.col("op") == "IN") & stays, "S1"), F.when(came, "S2")))
    return _leaving(trans, project).select(F.explode(held).alias("pattern"), project, "x", "y").distinct()


def substitutions(trans: DataFrame, project: str = "user_id", adjacent: bool = False) -> DataFrame:
    """pattern, x, y, line_count, support."""
    total = trans.agg(F.countDistinct(project).alias("n_projects"))
    counted = substitution_cases(trans, project, adjacent).groupBy("pattern", "x", "y").agg(F.count("*").alias("line_count"))
    return counted.crossJoin(F.broadcast(total)).select("pattern", "x", "y", "line_count", (F.col("line_count") / F.col("n_projects")).alias("support"))  # total is one row


def substitution_rows(trans: DataFrame, project: str = "user_id", adjacent: bool = False) -> DataFrame:
    """pattern, x, y, unbound, line_count: substitutions as counted with variables, so each pattern has a row of its own too.

    In that row X and Y stand for any labels: x and y are null, unbound is X, and each project counts once. In others unbound is null, whatever their labels are called. Rows of trans without a label are none's.
    """
    found = substitution_cases(trans.where(F.col("label").isNotNull()), project, adjacent)
    counted = found.groupingSets([("pattern", "x", "y"), ("pattern",)], "pattern", "x", "y").agg(F.grouping_id().alias("level"), F.countDistinct(project).alias("line_count"))
    return counted.select("pattern", "x", "y", F.when(F.col("level") > 0, "X").alias("unbound"), "line_count")


def ever(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """label, ever: projects that ever had it."""
    return trans.select(project, "label").distinct().groupBy("label").agg(F.count("*").alias("ever"))


def replaced(cases: DataFrame, usage: DataFrame, side: str = "x", project: str = "user_id") -> DataFrame:
    """label, others, projects, share: by how many labels one was replaced (side y: how many it replaced), in how many projects, and their share of those that ever had it."""
    other = "y" if side == "x" else "x"
    counted = cases.groupBy(F.col(side).alias("label")).agg(F.countDistinct(other).alias("others"), F.countDistinct(project).alias("projects"))
    return counted.join(usage, "label").select("label", "others", "projects", (F.col("projects") / F.col("ever")).alias("share"))


def frequent(subst: DataFrame, least: int) -> DataFrame:
    return subst.where(F.col("line_count") >= least)


def by_model(cases: DataFrame, models: DataFrame, project: str = "user_id") -> DataFrame:
    """kind, n_patterns, n_projects: total, both relational, both non-relational, mixed, same."""
    typed = cases.join(models.select(F.col("label").alias("x"), F.col("model").alias("mx")), "x").join(models.select(F.col("label").alias("y"), F.col("model").alias("my")), "y")
    relational, non = (F.col("mx") == "Relational") & (F.col("my") == "Relational"), (F.col("mx") != "Relational") & (F.col("my") != "Relational")
    kinds = F.array_compact(F.array(F.lit("total"), F.when(relational, "relational"), F.when(non, "non relational"), F.when(~relational & ~non, "mixed"), F.when(relational | non, "same")))
    rows = typed.select(F.explode(kinds).alias("kind"), F.struct("pattern", "x", "y").alias("p"), project)
    return rows.groupBy("kind").agg(F.countDistinct("p").alias("n_patterns"), F.countDistinct(project).alias("n_projects"))


def only_same_model(cases: DataFrame, models: DataFrame, project: str = "user_id") -> DataFrame:
    """project, non_relational: projects whose replacements never mix models; whether any is non-relational on both sides."""
    typed = cases.join(models.select(F.col("label").alias("x"), F.col("model").alias("mx")), "x").join(models.select(F.col("label").alias("y"), F.col("model").alias("my")), "y")
    mixed = (F.col("mx") == "Relational") != (F.col("my") == "Relational")
    flags = typed.groupBy(project).agg(F.bool_or(mixed).alias("mixed"), F.bool_or((F.col("mx") != "Relational") & (F.col("my") != "Relational")).alias("non_relational"))
    return flags.where("not mixed").select(project, "non_relational")


def retention(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """label, inserted, never_removed, removed, in_last, left_for_good: numbers of projects."""
    return life(trans, project).groupBy("label").agg(
        F.count("*").alias("inserted"),
        F.count_if(F.col("n_out") == 0).alias("never_removed"),
        F.count_if(F.col("n_out") > 0).alias("removed"),
        F.count_if("in_last").alias("in_last"),
        F.count_if(~F.col("in_last")).alias("left_for_good"),
    )


def exit_only(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """project, label, from_start: labels whose last change is OUT; whether they were there from the first slice."""
    last = trans.where("op <> 'KEEP'").groupBy(project, "label").agg(F.max_by("op", "part").alias("last_op"), F.bool_or(F.col("op") == "INIT").alias("from_start"))
    return last.where("last_op = 'OUT'").select(project, "label", "from_start")


def at_least_to_exact(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers for "at least so many times" as numbers for "exactly so many times"."""
    later = Window.partitionBy("label").orderBy("times")
    return counts.select("label", "times", *((F.col(c) - F.lead(c, 1, 0).over(later)).alias(c) for c in columns))


def balance(counts: DataFrame) -> DataFrame:
    """label, adoption, removals, second insertions and removals, still: first and second insertions less removals; shares of adoption."""
    one = lambda n, c: F.coalesce(F.max(F.when(F.col("times") == n, F.col(c))), F.lit(0))
    wide = counts.groupBy("label").agg(one(1, "inserted").alias("adoption"), one(1, "removed").alias("removals"), one(2, "inserted").alias("again"), one(2, "removed").alias("removed_again"))
    still = F.col("adoption") - F.col("removals") + F.col("again") - F.col("removed_again")
    return wide.withColumn("still", still).withColumn("still_share", still / F.col("adoption")).withColumn("removed_share", F.col("removals") / F.col("adoption"))


def drop_variables(found: DataFrame, columns: list[str]) -> DataFrame:
    """found without the pattern's own rows: those in which a label is still X or Y, the variables of patterns."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & ~F.coalesce(F.col(c).isin("X", "Y"), F.lit(False))
    return found.where(kept)


def support_buckets(subst: DataFrame) -> DataFrame:
    """line_count, patterns, exactly_two, over_two, three_to_ten, max_x: for each count the number of patterns, and what holds for it."""
    n = F.col("line_count")
    rows = subst.groupBy("line_count").agg(F.count("*").alias("patterns"), F.max("x").alias("max_x"))
    return rows.select("line_count", "patterns", "max_x", (n == 2).alias("exactly_two"), (n > 2).alias("over_two"), n.between(3, 10).alias("three_to_ten"))


def parse_bindings(df: DataFrame) -> DataFrame:
    """x and y of "X = a; Y = b", and lines, the array of numbers of "1; 2; 3"."""
    bound = lambda name: F.regexp_extract("bindings", rf"(?:^|;\s*){name} = ([^;]*)", 1)
    return df.select("*", bound("X").alias("x"), bound("Y").alias("y"), F.transform(F.split("lines_text", r"\s*;\s*"), lambda x: x.cast("long")).alias("lines"))


def select_shapes(patterns: DataFrame) -> DataFrame:
    """pattern, itemsets, shape, x, y, freq: mined patterns of four items that show label x giving way to y.

    S1 is X | INY OUTX | Y, S2 is X | INY | OUTX Y; within an itemset order means nothing, and what is found has this one, whatever the labels are called. Labels are compared whole.
    """
    part = lambda i: F.get("sequence", F.lit(i))
    x = part(0)[0]
    sizes = F.transform("sequence", lambda k: F.size(k))
    y1, y2 = part(2)[0], F.substring(part(1)[0], 3, 1 << 20)
    first = (sizes == F.array(*map(F.lit, (1, 2, 1)))) & (part(1) == F.sort_array(F.array(F.concat(F.lit("IN"), y1), F.concat(F.lit("OUT"), x))))
    second = (sizes == F.array(*map(F.lit, (1, 1, 2)))) & part(1)[0].startswith("IN") & (part(2) == F.sort_array(F.array(F.concat(F.lit("OUT"), x), y2)))
    shaped = patterns.where(F.size("sequence") == 3).select("sequence", "freq", F.when(first, "S1").when(second, "S2").alias("shape"), x.alias("x"), F.when(first, y1).otherwise(y2).alias("y"))
    ordered = F.when(F.col("shape") == "S1", F.col("sequence")).otherwise(F.array(part(0), part(1), F.array(F.concat(F.lit("OUT"), "x"), F.col("y"))))
    return shaped.where("shape is not null and x <> y").select(pattern_text(ordered).alias("pattern"), ordered.alias("itemsets"), "shape", "x", "y", "freq")


#: Of what select_shapes looks for, what a project shows where x leaves and y is present: S1 and S2 whole, INY OUTX of S1, INY | OUTX Y of S2.
SHOWN = {"s1": "op = 'IN' and last_part > part", "s2": "entered > x_first", "bc1": "op = 'IN'", "bcd2": "entered is not null"}


def shape_counts(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """x, y and, for each of SHOWN, the number of projects that show it: a row for each two labels. Each project's labels are compared where they meet; no other pattern is mined."""
    own = _leaving(trans.where(F.col("label").isNotNull()), project).groupBy(project, "x", "y").agg(*(F.bool_or(F.expr(rule)).alias(name) for name, rule in SHOWN.items()))
    return own.groupBy("x", "y").agg(*(F.count_if(name).alias(name) for name in SHOWN))


def _sequences(counts: DataFrame, *made: tuple[str, list[list[Column]]]) -> DataFrame:
    """sequence, freq: patterns by the name of their count and their itemsets; those of no project are left out."""
    rows = F.array(*(F.struct(F.array(*(F.array(*items) for items in sets)).alias("sequence"), F.col(name).alias("freq")) for name, sets in made))
    return counts.select(F.explode(rows).alias("p")).select("p.sequence", "p.freq").where("freq > 0")


def _items() -> tuple[Column, Column, Column, Column]:
    """x, y, INY and OUTX."""
    return F.col("x"), F.col("y"), F.concat(F.lit("IN"), "y"), F.concat(F.lit("OUT"), "x")


def mine_shapes(counts: DataFrame, least: int) -> DataFrame:
    """sequence, freq: of the patterns that select_shapes looks for those that enough projects have, from shape_counts; as mining finds them, but these alone."""
    x, y, enters, leaves = _items()
    found = _sequences(counts, ("s1", [[x], [enters, leaves], [y]]), ("s2", [[x], [enters], [leaves, y]])).where(F.col("freq") >= least)
    return found.select(F.transform("sequence", lambda s: F.sort_array(s)).alias("sequence"), "freq")


def mine_items(trans: DataFrame, project: str = "user_id") -> DataFrame:
    """sequence, freq: patterns of one item, x, INX or OUTX, with the number of projects that have it."""
    has = F.array_compact(F.array(F.when(F.col("op") != "OUT", F.col("label")), F.when(F.col("op").isin("IN", "OUT"), F.concat("op", "label"))))
    counted = trans.select(project, F.explode(has).alias("item")).distinct().groupBy("item").agg(F.count("*").alias("freq"))
    return counted.select(F.array(F.array("item")).alias("sequence"), "freq")


def mine_parts(trans: DataFrame, counts: DataFrame, project: str = "user_id") -> DataFrame:
    """sequence, freq: all parts of patterns of the two shapes for which measures wants a support, from transitions and their shape_counts; items are in the order of the shapes.

    For S2, a, b and c need not meet in a slice: each slice in which y enters is compared with a row for each label x of the project, the first slice that has it and the last one in which it leaves.
    """
    x, y, enters, leaves = _items()
    known = trans.where(F.col("label").isNotNull())
    of = lambda ops: F.when(F.col("op").isin(*ops), F.col("part"))
    spans = known.groupBy(project, F.col("label").alias("x")).agg(F.min(of(["INIT", "IN", "KEEP"])).alias("first_part"), F.max(of(["OUT"])).alias("last_out"))
    entries = known.where("op = 'IN'").select(project, "part", F.col("label").alias("y"))
    rules = {"ab": "part > first_part", "bc2": "part < last_out", "abc2": "part > first_part and part < last_out"}
    own = entries.hint("merge").join(spans, project).where("x <> y").groupBy(project, "x", "y").agg(*(F.bool_or(F.expr(rule)).alias(name) for name, rule in rules.items()))
    apart = own.groupBy("x", "y").agg(*(F.count_if(name).alias(name) for name in rules))
    apart = _sequences(apart, ("ab", [[x], [enters]]), ("bc2", [[enters], [leaves]]), ("abc2", [[x], [enters], [leaves]]))
    met = _sequences(counts, ("bc1", [[enters, leaves]]), ("bc1", [[x], [enters, leaves]]), ("s1", [[enters, leaves], [y]]), ("bcd2", [[enters], [leaves, y]]))
    return mine_items(known, project).unionByName(apart).unionByName(met)


def split_pattern(patterns: DataFrame) -> DataFrame:
    """Adds the parts a, ab, abc, b, bc, bcd, c, cd, d of patterns of four items, as text; a space joins items of one slice, | those of a later one."""
    items = F.flatten(F.transform("itemsets", lambda s, i: F.transform(s, lambda t: F.struct(t.alias("item"), i.alias("set")))))
    step = lambda acc, t: F.struct(F.when(acc["set"] == -1, t["item"]).when(acc["set"] == t["set"], F.concat(acc["text"], F.lit(" "), t["item"])).otherwise(F.concat(acc["text"], F.lit("|"), t["item"])).alias("text"), t["set"].alias("set"))
    part = lambda i, n: F.aggregate(F.slice(items, i, n), F.struct(F.lit("").alias("text"), F.lit(-1).alias("set")), step)["text"]
    spans = {"a": (1, 1), "ab": (1, 2), "abc": (1, 3), "b": (2, 1), "bc": (2, 2), "bcd": (2, 3), "c": (3, 1), "cd": (3, 2), "d": (4, 1)}
    return patterns.select("*", *(part(*span).alias(name) for name, span in spans.items()))


def attach_supports(patterns: DataFrame, supports: DataFrame, parts: list[str]) -> DataFrame:
    """Adds s_<part>, the freq of each part among supports (pattern, freq); null if it has none. One join, whatever the number of parts."""
    long = patterns.select("pattern", F.explode(F.array(*(F.struct(F.lit(p).alias("name"), F.col(p).alias("text")) for p in parts))).alias("p")).select(F.col("pattern").alias("whole"), "p.name", "p.text")
    found = long.join(supports.select(F.col("pattern").alias("text"), F.col("freq").alias("n")), "text")
    wide = found.groupBy("whole").agg(*(F.max(F.when(F.col("name") == p, F.col("n"))).alias(f"s_{p}") for p in parts))
    return patterns.join(wide, patterns["pattern"] == wide["whole"], "left").drop("whole")


def measures(patterns: DataFrame, supports: DataFrame, n: int) -> DataFrame:
    """Confidence of the rest given each item, and lifts of a -> b, a -> bc, a -> bcd over n sequences."""
    s = attach_supports(split_pattern(patterns), supports, ["a", "ab", "abc", "b", "bc", "bcd", "c", "d"])
    ratio = lambda top, *under: top / F.nullif(F.expr(" * ".join(under)), F.lit(0))
    confidences = [ratio(F.col("freq"), f"s_{p}").alias(f"conf_{p}") for p in "abcd"]
    lifts = [(n * ratio(F.col(top), f"s_a * s_{rest}")).alias(f"lift_{rest}") for top, rest in (("s_ab", "b"), ("s_abc", "bc"), ("freq", "bcd"))]
    return s.select("pattern", "shape", "x", "y", "freq", "s_bc", *confidences, *lifts)


def rank_patterns(measured: DataFrame, by: list[str]) -> DataFrame:
    return measured.orderBy(*(F.desc_nulls_last(c) for c in by), "pattern")
