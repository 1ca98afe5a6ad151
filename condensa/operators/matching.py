"""Occurrences of rules in documents, their conflicts, and applying them.

Occurrences are found by one pass of an automaton over each text, on Arrow
batches: no join, no shuffle, and the same rows for any number of rules. The rule
table is a dimension whose size is checked; one of over ``RULES_A_PASS`` rows is
dealt into blocks, a pass each. Resolution inside a document runs in the same
pass if there is one block, else as a fold over the collected matches of each
document. The Column functions say the same for one rule or a short list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as lx
from ..functions.text import any_sub, let
from . import kernel

#: rules that one pass over the texts looks for; an automaton of so many takes some hundred megabytes
RULES_A_PASS = 100_000
MATCH = "array<struct<position:int,priority:int,id:int,size:int,original_text:string,compressed_text:string,confidence:double,success_rate:double>>"


def positions(text: Column, original: Column) -> Column:
    """0-based places where the rule's original occurs, letter case aside, overlapping ones too."""
    return let(F.struct(F.lower(text).alias("low"), F.lower(original).alias("key")), lambda s: _positions(s["low"], s["key"]))


def _positions(low: Column, key: Column) -> Column:
    # split before each occurrence: a zero-width match, so occurrences may overlap; one at the very beginning gives no part
    parts = F.split(low, F.concat(F.lit(r"(?=\Q"), F.replace(key, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")), F.lit(-1))
    empty = F.array().cast("array<int>")
    places = lambda p: F.aggregate(
        F.slice(p, F.lit(1), F.size(p) - 1),
        F.struct(F.lit(0).alias("at"), F.when(F.startswith(low, key), F.array(F.lit(0))).otherwise(empty).alias("found")),
        lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(x))).alias("found")),
        lambda s: s["found"],
    )
    return F.when((F.length(key) == 0) | ~F.contains(low, key), empty).otherwise(let(parts, places))


def whole_word(text: Column, position: Column, size: Column) -> Column:
    before = F.when(position > 0, text.substr(position, F.lit(1))).otherwise("")
    return ~before.rlike(r"[\p{L}\p{N}]") & ~text.substr(position + size + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")


def confidence(text: Column, position: Column, size: Column, priority: Column, success: Column, domain: Column, tech=lx.TECH_CONTEXT) -> Column:
    from ..functions.rewrite import context

    technical = any_sub(context(text, position, size), tech) & domain.isin("web-development", "general")
    return F.least(F.lit(1.0), 0.8 + F.least(F.lit(0.2), priority / 5000) + success * 0.1 + F.when(technical, 0.1).otherwise(0.0))


def blocks(rules: DataFrame) -> Iterator[list[dict]]:
    """The rules on the driver, at most RULES_A_PASS at a time."""
    needed = rules.select("id", "original", "compressed", "pattern_type", "priority", "success_rate", "domain")
    n = -(-rules.count() // RULES_A_PASS)
    for k in range(max(n, 1)):
        yield [r.asDict() for r in (needed if n <= 1 else needed.where(F.pmod(F.xxhash64("id", "original"), F.lit(n)) == k)).collect()]


def _fields(docs: DataFrame, rules: DataFrame) -> list[T.StructField]:
    kinds = [("id", rules.schema["id"].dataType), ("pattern_type", T.StringType()), ("position", T.IntegerType()), ("size", T.IntegerType()), ("original_text", T.StringType()), ("compressed_text", T.StringType()), ("priority", T.IntegerType()), ("success_rate", T.DoubleType()), ("confidence", T.DoubleType()), ("context", T.StringType())]
    return [docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)]


#: rows of an output batch
BATCH_ROWS = 20_000


def _found(docs: DataFrame, fields: list[T.StructField], rules: list[dict], text: str, resolve: bool) -> DataFrame:
    arrow = [pa.int32() if isinstance(fields[1].dataType, T.IntegerType) else pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]

    def run(batches):
        compiled = kernel.Rules(rules)
        for b in batches:
            rows, kind = [], b.schema.types[0]

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, *arrow])], names=[f.name for f in fields])

            for doc, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not value:
                    continue
                found = compiled.matches(value)
                for at, _, number, size, short, sure, r in kernel.resolve(found) if resolve else found:
                    rows.append((doc, number, r["pattern_type"], at, size, value[at : at + size], short, r["priority"], r["success_rate"], sure, value[max(0, at - 20) : at + size + 20]))
                if len(rows) >= BATCH_ROWS:
                    yield out()
                    rows = []
            if rows:
                yield out()

    return docs.select("doc_id", text).mapInArrow(run, T.StructType(fields))


def find(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """One row per occurrence: doc_id, id, pattern_type, position, size, original_text, compressed_text, priority, success_rate, confidence, context."""
    out = None
    for block in blocks(rules):
        one = _found(docs, _fields(docs, rules), block, text, False)
        out = one if out is None else out.unionByName(one)
    return out


def counts(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Documents of each rule and its non-overlapping occurrences (in any place), summed up in the pass that finds them."""
    kind = rules.schema["id"].dataType.simpleString()

    def one(block: list[dict]) -> DataFrame:
        def run(batches):
            compiled = kernel.Rules({**r, "pattern_type": "", "row": k} for k, r in enumerate(block))
            for b in batches:
                documents, times = Counter(), Counter()
                for value in b.column(0).to_pylist():
                    ends = {}
                    for at, size, r in compiled.occurrences(value or ""):
                        if at >= ends.get(r["row"], 0):
                            ends[r["row"]] = at + size
                            times[r["row"]] += 1
                    documents.update(ends.keys())
                rows = [(block[k]["id"], n, times[k]) for k, n in documents.items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "documents", "occurrences"), r)) for r in rows], pa.schema([("id", pa.int32() if kind == "int" else pa.int64()), ("documents", pa.int64()), ("occurrences", pa.int64())]))

        return docs.select(text).mapInArrow(run, f"id {kind}, documents long, occurrences long")

    out = None
    for block in blocks(rules):
        out = one(block) if out is None else out.unionByName(one(block))
    return out.groupBy("id").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


def statistics(matches: DataFrame) -> DataFrame:
    saved = F.sum(F.length("original_text") - F.length("compressed_text"))
    return matches.groupBy("doc_id").agg(
        F.count("*").alias("matches"), saved.alias("chars_saved"), F.floor(saved / 4).alias("tokens_saved"), F.avg("confidence").alias("avg_confidence"), *[F.count_if(F.col("pattern_type") == k).alias(f"{k}_matches") for k in ("word", "phrase", "compound")]
    )


# --- conflict resolution -------------------------------------------------------------


def resolve(matches: Column) -> Column:
    """Greedy resolution of an array of MATCH structs.

    By position, then priority: a match is taken if it is free of overlaps, else it
    replaces what it overlaps if its priority is over 1.2 times the best of these,
    or its confidence over that one's by more than 0.2. Ties go by rule id.
    """
    order = F.array_sort(matches, lambda a, b: F.when(a["position"] != b["position"], a["position"] - b["position"]).when(a["priority"] != b["priority"], b["priority"] - a["priority"]).otherwise(a["id"] - b["id"]).cast("int"))
    # matches come by position and taken ones are disjoint, so a match can overlap the last taken one only
    def step(taken, m):
        last = F.try_element_at(taken, F.lit(-1))
        free = (F.size(taken) == 0) | (last["position"] + last["size"] <= m["position"])
        better = (m["priority"] > last["priority"] * 1.2) | (m["confidence"] > last["confidence"] + 0.2)
        return F.when(free, F.concat(taken, F.array(m))).when(better, F.concat(F.slice(taken, F.lit(1), F.size(taken) - 1), F.array(m))).otherwise(taken)

    return F.aggregate(order, F.array().cast(MATCH), step)


def as_array(matches: DataFrame) -> DataFrame:
    """doc_id with its matches as one array; bounded by the matches of one document."""
    fields = ["position", "priority", "id", "size", "original_text", "compressed_text", "confidence", "success_rate"]
    return matches.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).cast(MATCH).alias("matches"))


def resolved(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """The occurrences that are left after greedy resolution inside each document."""
    first, *rest = blocks(rules)
    if not rest:
        return _found(docs, _fields(docs, rules), first, text, True)
    return as_array(find(docs, rules, text)).select("doc_id", F.inline(resolve(F.col("matches"))))


def splice(text: Column, matches: Column) -> Column:
    """The text with resolved (disjoint, sorted) matches replaced."""
    return let(F.struct(text.alias("text"), matches.alias("matches")), lambda s: _splice(s["text"], s["matches"]))


def _splice(text: Column, matches: Column) -> Column:
    folded = F.aggregate(
        matches,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, m: F.struct((m["position"] + m["size"]).alias("at"), F.concat(s["out"], F.array(text.substr(s["at"] + 1, m["position"] - s["at"]), m["compressed_text"])).alias("out")),
    )
    return let(folded, lambda f: F.concat(F.array_join(f["out"], ""), text.substr(f["at"] + 1, F.length(text))))


def overlap_groups(matches: DataFrame) -> DataFrame:
    """Islands of matches, by whether each overlaps the one before it."""
    w = Window.partitionBy("doc_id").orderBy("position", F.desc("priority"), "id")
    apart = F.coalesce(F.col("position") >= F.lag(F.col("position") + F.col("size")).over(w), F.lit(True))
    return matches.withColumn("_new", apart.cast("int")).withColumn("group", F.sum("_new").over(w)).drop("_new")


def group_score(strategy: str) -> Column:
    hybrid = F.least(F.lit(1.0), F.col("priority") / 1000) * 0.4 + F.col("confidence") * 0.3 + F.least(F.lit(1.0), F.col("size") / 50) * 0.2 + F.col("success_rate") * 0.1
    return {"priority": F.col("priority").cast("double"), "length": F.col("size").cast("double"), "confidence": F.col("confidence"), "hybrid": hybrid}[strategy]


def best_of_groups(matches: DataFrame, strategy: str = "hybrid") -> DataFrame:
    scored = overlap_groups(matches).withColumn("score", group_score(strategy))
    w = Window.partitionBy("doc_id", "group").orderBy(F.desc(F.round("score", 9)), "position", F.desc("priority"), "id")
    return scored.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


#: matches meet in bins of so many characters, so a long document isn't paired with itself
BIN = 64


#: what makes a match the better one, by strategy; ties go by priority, length, id and place
BETTER = {
    "priority": lambda m: [F.col(f"{m}.priority").cast("double")],
    "length": lambda m: [F.col(f"{m}.size").cast("double")],
    "confidence": lambda m: [F.round(f"{m}.confidence", 9)],
    "compression": lambda m: [(F.length(f"{m}.original_text") - F.length(f"{m}.compressed_text")).cast("double")],
}


def pairwise_elimination(matches: DataFrame, strategy: str = "priority") -> DataFrame:
    """Matches that no overlapping better one beats."""
    bins = F.sequence(F.floor(F.col("position") / BIN), F.floor((F.col("position") + F.col("size") - 1) / BIN))
    binned = matches.withColumn("_bin", F.explode(bins))
    m, o = binned.alias("m"), binned.alias("o")
    over = (F.col("m.doc_id") == F.col("o.doc_id")) & (F.col("m._bin") == F.col("o._bin")) & (F.col("o.position") < F.col("m.position") + F.col("m.size")) & (F.col("m.position") < F.col("o.position") + F.col("o.size"))
    rank = lambda x: F.struct(*BETTER[strategy](x), F.col(f"{x}.priority"), F.col(f"{x}.size"), -F.col(f"{x}.id"), -F.col(f"{x}.position"))
    losers = m.join(o, over & (rank("o") > rank("m")), "left_semi").select("doc_id", "id", "position").distinct()
    return matches.join(losers, ["doc_id", "id", "position"], "left_anti")


# --- inside an engine: a fold over literal rules, no shuffle ----------------------------


def matches_in(text: Column, rules: list[dict]) -> Column:
    """All occurrences of a bounded list of rules in a text, as an array of MATCH structs."""
    found = []
    for r in rules:
        size = len(r["original"])
        places = positions(text, F.lit(r["original"]))
        if r["pattern_type"] == "word":
            places = F.filter(places, lambda p: whole_word(text, p, F.lit(size)))
        made = F.transform(
            places,
            lambda p: F.struct(
                p.alias("position"), F.lit(r["priority"]).alias("priority"), F.lit(r["id"]).alias("id"), F.lit(size).alias("size"), text.substr(p + 1, F.lit(size)).alias("original_text"), F.lit(r["compressed"]).alias("compressed_text"),
                confidence(text, p, F.lit(size), F.lit(r["priority"]), F.lit(r["success_rate"]), F.lit(r["domain"])).alias("confidence"), F.lit(r["success_rate"]).alias("success_rate"),
            ),
        )
        found.append(F.when(F.contains(F.lower(text), F.lit(r["original"].lower())), made).otherwise(F.array()).cast(MATCH))
    return F.concat(*found) if found else F.array().cast(MATCH)


def rewrite(text: Column, rules: list[dict]) -> Column:
    return let(text, lambda t: _splice(t, resolve(matches_in(t, rules))))

