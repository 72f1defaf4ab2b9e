import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from basalt.llm import winnowing

TOKEN = re.compile(r"[^\x20\x09-\x0D]{1,24}")


def split(fingerprint):
    values = [int(fingerprint[i : i + 16], 16) for i in range(0, len(fingerprint), 16)]
    return [(v >> 24, winnowing._LOW - (v & winnowing._LOW)) for v in values]


def slow(spark, text):
    """Winnowed (hash, position) pairs; token and gram hashes come from Spark's own xxhash64."""
    tokens = TOKEN.findall(text)
    grams = [tokens[i : i + 3] for i in range(max(1, len(tokens) - 2))] if tokens else []
    df = spark.createDataFrame([(i, (*g, None, None)[:3]) for i, g in enumerate(grams)], "i int, g array<string>")
    word = lambda j: F.when(F.get("g", F.lit(j)).isNotNull(), F.xxhash64(F.get("g", F.lit(j))))
    h = [r[0] for r in df.select("i", F.xxhash64(word(0), word(1), word(2)).alias("h")).orderBy("i").select("h").collect()]
    short = [x & ~winnowing._LOW for x in h]
    kept = []
    for s in range(max(1, len(short) - 7) if short else 0):
        window = short[s : s + 8]
        at = s + max(i for i, x in enumerate(window) if x == min(window))
        if not kept or kept[-1] != at:
            kept.append(at)
    return [((short[i] & (1 << 64) - 1) >> 24, i) for i in kept]


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark, odd_docs, no_docs, sf):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id between 20 and 24").select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(50, "la " * 40), (51, "a b a b a b a b c " * 5)], "doc_id long, text string"))
    # null ids first, then ids, then a hash of the text whose lowest bit doesn't count
    keys = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["h"] >> 1, r["text"]) for r in keys})
    want = {}
    prints = {text: slow(spark, text) for text in {r[3] for r in rows}}
    for i, (known, doc, _, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        m = len(text) // 2
        edited = text[: len(text) - m] + after[:m]
        mine, changed, other = prints[text], slow(spark, edited), prints[after]
        want[doc if known else None, text] = (doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, changed, round(jaccard(mine, changed), 9), round(jaccard(mine, other), 9))
    expected = Counter(str(want[r["doc_id"], r["text"]]) for r in keys)
    got = winnowing.edited_likeness(docs).collect()
    assert Counter(str((*r[:3], split(r[3]), split(r[4]), round(r[5], 9), round(r[6], 9))) for r in got) == expected
    assert winnowing.edited_likeness(no_docs).count() == 0


def test_texts_of_many_tokens(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(n)) for n in (0, 1, 2, 3, 9, 10, 11, 40, 300)] + ["same " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    short, wide = (df.select(winnowing.entries(F.col("text"), most=most).alias("e"), "text") for most in (1 << 24, 0))
    assert [r["e"] for r in short.collect()] == [r["e"] for r in wide.collect()]
    far = spark.createDataFrame([([(5, 1 << 25)],), ([((1 << 40) - 1, 3)],)], "e array<struct<hash long, at long>>")
    assert [r[0] for r in far.select(winnowing.fingerprint(F.col("e"))).collect()] == ["000000000502000000", "ffffffffff" + "fffffc"]


def test_shared_runs_are_found(spark):
    run = " ".join("r%d" % i for i in range(10))
    rows = [(i, " ".join("a%d_%d" % (i, j) for j in range(30)) + " " + run + " " + " ".join("b%d_%d" % (i, j) for j in range(i))) for i in range(12)]
    got = spark.createDataFrame(rows, "id int, text string").select(winnowing.fingerprint(winnowing.entries(F.col("text"))).alias("f")).collect()
    prints = [{h for h, _ in split(r["f"])} for r in got]
    assert all(a & b for a in prints for b in prints)


def test_odd_tables(odd_docs):
    rows = winnowing.edited_likeness(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4, 5)} == {""}
    ones = [r for r in rows if r["doc_id"] == 1]
    assert len(ones) == 2 and ones[0] == ones[1]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_plan_is_native(odd_docs):
    plan = winnowing.edited_likeness(odd_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
