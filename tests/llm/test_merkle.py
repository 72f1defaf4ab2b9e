import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from basalt.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def told(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def walk(levels, i, node):
    """(siblings, folded node) from one node up."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % 16
        run = nodes[first : first + 16]
        out.extend(run[: i - first] + run[i - first + 1 :])
        run[i - first] = node
        node, i = H(*run), i // 16
    return out, node


def model(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    groups = defaultdict(list)
    for r in rows:
        cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
        groups[r["source"]].append((r["doc_id"], told(r, r["text"]), told(r, r["text"].translate(lower) if cut else r["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (doc_id, leaf, copy) in enumerate(groups[s]):
            lower_part, part = walk(trees[s], i, copy)
            upper_part, folded = walk(top, k, part)
            yield doc_id, leaf, trees[s][-1][0], top[-1][0], H(*lower_part, *upper_part), folded, folded == top[-1][0]


def answer(docs):
    changed, when = merkle.tampered()
    got = merkle.manifest(docs, changed=changed, when=when)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return Counter(map(tuple, got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof.siblings", ""), 256), "folded_root", "verified").collect()))


def test_collapse_and_fold():
    rng = random.Random(2)
    for n in (1, 2, 15, 16, 17, 33, 255, 256):
        nodes = [H(str(rng.random())) for _ in range(n)]
        levels = merkle.collapse(nodes, merkle._levels(n))
        assert levels == tree(nodes)
        for i in {0, n - 1, n // 2}:
            path = list(merkle.siblings(levels, i))
            assert merkle.fold(nodes[i], path) == levels[-1][0]
            assert ("".join(s for _, s in path), merkle.fold("f" * 64, path)) == ("".join((w := walk(levels, i, "f" * 64))[0]), w[1])


def test_trees_of_many_shapes(spark):
    rng, rows = random.Random(4), []
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "é": 257, None: 300, "": 5, "z": 4097, "Z": 1}
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows) * 3 % 9973, rng.choice([None, "A b", "lower", "ÄÖ X", ""]), rng.choice(["en", None]), s, rng.choice([None, 3]), None))
    rows += [(None, "T", None, f"s{i}", None, None) for i in range(290)]  # three levels of sources
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").repartition(7)
    assert answer(docs) == Counter(model(docs.collect()))


def test_odd_tables(spark, odd_docs, no_docs, sf):
    more = odd_docs.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long"), "g": F.lit(1), "i": F.lit("x"), "b": F.lit(2), "path": F.lit("p")})
    assert answer(more) == Counter(model(more.collect()))
    assert answer(more.limit(0)) == Counter()
    one = more.limit(1)
    assert answer(one) == Counter(model(one.collect()))
    many = one.select(F.explode(F.array_repeat(F.struct(*one.columns), 600)).alias("x")).select("x.*")  # rows that are alike
    assert answer(many) == Counter(model(many.collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert answer(docs) == Counter(model(docs.collect()))


def test_no_source_is_sorted_in_one_task(spark, monkeypatch):
    written = []
    monkeypatch.setattr(merkle, "staged", lambda df, name, f=merkle.staged: written.append(f(df, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.lit("one").alias("g"), F.col("id").alias("doc_id"))
        numbered = merkle.numbered(rows, "g", "doc_id")
        assert numbered.where("i <> doc_id or size <> 40000").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = written[0].groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count")).first()
    assert files[0] >= 4 and files[1] < 20_000
