"""Secret scans: candidates by pattern, then a random forest that removes false positives. DataFrame functions only.

A candidate is a run of [A-Za-z0-9+/_-] (and closing =) inside a word: of 16 characters or more with a digit, 12 capitals in a row, or three changes from
small to capital letters; or of 8 or more that is assigned (by = or :, perhaps with quotes) to a key word such as password or token. What else may be secret
is no candidate and stays: shorter runs, passwords of other characters or of several words, and runs of one case without digits that nothing assigns. Lines
of PEM blocks are runs like others. The features are a candidate's length, character transitions, dictionary coverage, path-like
surroundings and the words beside it. The forest is trained on labelled findings (by default those of labelled_findings(), which are generated from a fixed
seed: the tables hold no labels for secrets) and is compiled to a SQL expression, so scanning needs no Python. Each text's candidates stay in its row: no
shuffle, and a document of any length or a source of any share is just rows. In words of more than FRAME characters, what stands before and around a candidate is read from the
PIECES runs and gaps it is cut with and SIDE characters on either side, so the work grows with a word's length, not with its square.

Defined cases: a null or empty text has no candidates; null ids stay null; repeated rows are scanned each; a secret that stands more than once is
found each time, at its own place; a probability of exactly the threshold is a secret; an empty table gives an empty result; redact() returns exactly the
columns of its input, whatever they are called.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.forest import Node, fit_forest, to_sql

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
RUN = r"[A-Za-z0-9+/_-]{8,}={0,2}"
TILE = r"[A-Za-z0-9+/_-]+={0,2}|[^A-Za-z0-9+/_-]+"
LONG, FRAME, PIECES, SIDE = 16, 1024, 64, 128
LIKELY = r"[0-9]|[A-Z]{12}|([a-z][A-Z].*){3}"
THRESHOLD = 0.5
MASK = "[secret]"
# Common words and letter groups of the languages in use, longest first so that coverage counts them whole.
DICTIONARY = (
    "tion ment ould ight ough ciones elle eaux heit keit ung sch ing and the ent ion for her tha nth int ere ted ver ter ist ich ein der die "
    "que les des con por est ado aci ent ant eur our ou ai oi au en er re te ti th he in an on at nd es or of ed is it al ar st to nt se ha as le "
    "ve me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
).split()
KEY_WORDS = r"(?i)(token|secret|passw|pwd|api|key|auth|credential|bearer|private)"
OTHER_WORDS = r"(?i)(sha|md5|hash|commit|digest|checksum|uuid|card|phone|order|invoice|isbn|serial|version|build|file|page|example|sample)"
ASSIGNED = KEY_WORDS + r"[A-Za-z_-]*[\"']? ?[=:][\"' ]*$"
MAYBE = r"[A-Za-z0-9+/_-]{16}|[=:][\"']?[A-Za-z0-9+/_-]{8}"
KNOWN_FORMAT = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live|sk-|AIza|eyJ)"
PATH = r"://|\.(com|net|org|html?|png|jpg|js|css|py)\b|@|(^|[^A-Za-z0-9])/|/[A-Za-z0-9_-]+/"
FEATURES = ("n", "transitions", "digits", "capitals", "small", "hex", "coverage", "slashes", "path", "key_before", "key_near", "other_near", "assigned", "known", "distinct")


def _share(core: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(core, f"[^{kept}]", "")) / F.length(core)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def feature_columns(core: Column, word: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features of a candidate core in its word, between the two words before it (joined) and the one after."""
    n = F.length(core)
    lower = F.lower(core)
    left = F.call_function("substring_index", word, core, F.lit(1))
    return {
        "n": n.cast("double"),
        "transitions": (F.regexp_count(core, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / (n - 1),
        "digits": _share(core, "0-9"),
        "capitals": _share(core, "A-Z"),
        "small": _share(core, "a-z"),
        "hex": _flag(core.rlike("^[0-9a-fA-F]+$")),
        "coverage": 1 - F.length(F.regexp_replace(lower, "|".join(DICTIONARY), "")) / n,
        "slashes": F.length(F.regexp_replace(core, "[^/_-]", "")).cast("double"),
        "path": _flag(word.rlike(PATH)),
        "key_before": _flag(left.rlike(KEY_WORDS)),
        "key_near": _flag(before.rlike(KEY_WORDS)),
        "other_near": _flag(F.concat_ws(" ", before, left, after).rlike(OTHER_WORDS)),
        "assigned": _flag(F.concat(before, F.lit(" "), left).rlike("[=:][\"' ]*$")),
        "known": _flag(core.rlike(KNOWN_FORMAT)),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / n,
    }


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(core, word, before, after, label) of n generated findings; label 1 is a secret."""
    rng = random.Random(seed)
    hexd, b32, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    prose = lambda k: "".join(rng.choice(DICTIONARY) for _ in range(k))
    out = []
    while len(out) < n:
        before, after = f"{prose(2)} {prose(1)}", prose(2)
        name = rng.choice(["token", "api_key", "secret", "access_token", "password", "auth_token", "client_secret", "key", "passwd", "private_key"])
        if rng.random() < 0.2:  # neighbours that have nothing to do with the finding
            after = rng.choice([f"{prose(2)}@mail.example.com", "order", f"page{rng.randint(1, 99)}", "file", "version 2"])
        label, kind, end = rng.randint(0, 1), rng.random(), rng.choice(["", "", ".", ",", "###", "***", "!!", "%%%", "$$$"])
        if label:
            makers = (lambda: some(hexd, 40), lambda: some(hexd, 32), lambda: some(hexd, rng.choice([16, 18, 20, 24])), lambda: "AKIA" + some(b32, 16), lambda: "ghp_" + some(b62, 36), lambda: some(b62 + "+/", 40), lambda: "sk_live_" + some(b62, 24), lambda: some(b62, rng.randint(20, 48)), lambda: some(b62[:52], rng.randint(18, 40)), lambda: some(b62, rng.randint(8, 15)))
            core = rng.choice(makers)()
            if core.startswith(("AKIA", "ghp_", "sk_live")) and kind < 0.7:
                word = core + end
            elif kind < 0.5:
                word, before = f'"{core}"' + end, f"{name} ="
            else:
                word = f"{name}{rng.choice('=:')}{core}" + end
        else:
            pick = rng.randint(0, 13)
            core = word = [
                lambda: some("0123456789", 16),
                lambda: prose(9).upper()[:30],
                lambda: prose(8)[:20] + some("0123456789", rng.randint(1, 4)),
                lambda: f"{some(hexd, 8)}-{some(hexd, 4)}-{some(hexd, 4)}-{some(hexd, 4)}-{some(hexd, 12)}",
                lambda: some(hexd, rng.choice([32, 40, 64])),
                lambda: f"{prose(3)}/{prose(3)}/{some('0123456789', 4)}/{prose(3)}",
                lambda: f"{prose(3)}_{prose(2)}-{some('0123456789', 3)}_{prose(3)}",
                lambda: f"202{rng.randint(0, 9)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}_{some('0123456789', 6)}",
                lambda: rng.choice(["x", "X", "0", "1"]) * rng.randint(16, 24),
                lambda: "YOUR_API_KEY_HERE_" + some("0123456789", 2),
                lambda: prose(4).upper() + prose(4).upper(),
                lambda: "".join(prose(2).capitalize() for _ in range(rng.randint(4, 7))),
                lambda: prose(5)[: rng.randint(8, 15)],
                lambda: rng.choice(["x", "X", "0", "changeme", "undefined", "required", "example_", "your_password"]) * 8,
            ][pick]()
            if pick >= 12:
                core = core[: rng.randint(8, 15)]
                word, before = (f"{name}{rng.choice('=:')}{core}{end}", before) if kind < 0.5 else (f"{core}{end}", f"{name} {rng.choice('=:')}")
            elif len(core) < LONG:
                continue
            elif pick == 4:
                before = f"{prose(1)} {rng.choice(['sha1', 'commit', 'digest', 'md5', 'checksum', 'sha256:'])}"
            elif pick == 5:
                word = rng.choice(["https://", "/", "www."]) + core + rng.choice([".html", "", ".net"])
            elif pick in (8, 9) and kind < 0.7:
                word = f"{name}={core}"
            elif pick in (0, 3) and kind < 0.4:
                before = f"{prose(1)} {rng.choice(['card', 'order', 'invoice', 'uuid', 'phone'])}"
            else:
                word = core + end
        if rng.random() < 0.12:  # texts in capitals
            core, word, before, after = (x.upper() for x in (core, word, before, after))
        out.append((core, word, before, after, label))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list[Node]:
    """Fit the forest on labelled findings, at most a few thousand; their features come from the same expressions as at scan time."""
    rows = spark.createDataFrame(findings or labelled_findings(), "core string, word string, before string, after string, label int")
    made = feature_columns(F.col("core"), F.col("word"), F.col("before"), F.col("after"))
    got = rows.select("label", *(c.cast("double").alias(k) for k, c in made.items())).toPandas()
    return fit_forest(got[list(FEATURES)].to_numpy(), got["label"].to_numpy(float))


def candidates(text: Column) -> Column:
    """array<struct<at, start, word, before, after>>: the words of a text that may hold a candidate, where they start, and their neighbours."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))  # a word each, with the white space before it
    block = 256

    def word(t: Column) -> Column:
        return F.coalesce(F.regexp_replace(t, r"^[\x20\x09-\x0D]+", ""), F.lit(""))

    def length(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda n, t: n + F.length(t))

    def around(held: Column) -> Column:
        tokens, places, blocks = held["tokens"], held["places"], held["blocks"]
        near = lambda i: word(F.get(tokens, i))

        def one(i: Column) -> Column:
            of = F.floor(i / block).cast("int")
            end = F.aggregate(F.slice(blocks, F.lit(1), of), F.lit(0), lambda n, x: n + x) + length(F.slice(tokens, of * block + 1, i % block + 1))
            return F.struct(i.alias("at"), (end - F.length(near(i))).alias("start"), near(i).alias("word"), F.concat_ws(" ", near(i - 2), near(i - 1)).alias("before"), near(i + 1).alias("after"))

        return F.transform(places, one)

    def placed(tokens: Column) -> Column:
        assigned = lambda i: F.coalesce(F.get(tokens, i - 1).rlike(r"[=:][\"']*$"), F.lit(False))
        places = F.filter(F.transform(tokens, lambda t, i: F.when((F.length(t) >= 8) & ((t.rlike(MAYBE)) | (assigned(i) & t.rlike(RUN))), i)), lambda i: i.isNotNull())
        return F.struct(tokens.alias("tokens"), places.alias("places"))

    def summed(held: Column) -> Column:
        # lengths of blocks of tokens, so that a place costs no sum over the whole text
        many = F.transform(F.sequence(F.lit(0), F.floor(F.size(held["tokens"]) / block).cast("int")), lambda b: length(F.slice(held["tokens"], b * block + 1, F.lit(block))))
        return F.struct(held["tokens"].alias("tokens"), held["places"].alias("places"), F.when(F.size(held["places"]) > 0, many).otherwise(F.array().cast("array<int>")).alias("blocks"))

    # what is used more than once is bound, as a lambda's variable
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(once(once(tokens, placed), summed), around)


def cores(word: Column) -> Column:
    """array<struct<core, place>> of a word's runs in order; place counts characters from 1."""
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<core:string,place:int>>").alias("found"))

    def step(held: Column, core: Column) -> Column:
        place = F.call_function("locate", core, word, held["from"])
        return F.struct((place + F.length(core)).alias("from"), F.concat(held["found"], F.array(F.struct(core.alias("core"), place.alias("place")))).alias("found"))

    return F.aggregate(F.regexp_extract_all(word, F.lit(RUN), F.lit(0)), start, step, lambda held: held["found"])


def frames(word: Column) -> Column:
    """array<struct<text, base, lead, trail>>: a word of up to FRAME characters as it is, a longer one in pieces of PIECES runs and gaps each; base counts the characters before,
    lead and trail are up to SIDE of those beside it."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    whole = F.array(F.struct(word.alias("text"), F.lit(0).alias("base"), F.lit("").alias("lead"), F.lit("").alias("trail")))

    def cut(tiles: Column) -> Column:
        last = F.ceil(F.size(tiles) / PIECES).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.array_join(F.slice(tiles, b * PIECES + 1, F.lit(PIECES)), ""))

    def placed(texts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
        step = lambda held, t: F.struct((held["end"] + F.length(t)).alias("end"), F.concat(held["at"], F.array(held["end"])).alias("at"))
        return F.struct(texts.alias("texts"), F.aggregate(texts, begin, step, lambda held: held["at"]).alias("at"))

    def framed(held: Column) -> Column:
        beside = lambda i, side: F.coalesce(side(F.get(held["texts"], i), F.lit(SIDE)), F.lit(""))
        return F.transform(held["texts"], lambda t, i: F.struct(t.alias("text"), F.get(held["at"], i).alias("base"), beside(i - 1, F.right).alias("lead"), beside(i + 1, F.left).alias("trail")))

    return F.when(F.length(word) <= FRAME, whole).otherwise(once(once(once(F.regexp_extract_all(word, F.lit(TILE), F.lit(0)), cut), placed), framed))


def is_candidate(core: Column, left: Column, before: Column) -> Column:
    """left: what stands before the core in its word; before: the two words before that."""
    return ((F.length(core) >= LONG) & core.rlike(LIKELY)) | F.concat(before, F.lit(" "), left).rlike(ASSIGNED)


def scan(docs: DataFrame, forest: list[Node], *, text_col: str = "text", into: str = "findings", threshold: float = THRESHOLD) -> DataFrame:
    """docs with an array of findings struct<word_at, start, secret, probability, is_secret>; start counts characters from 0."""
    made = lambda c, x, near: F.struct(*(v.cast("double").alias(k) for k, v in feature_columns(x["core"], near, c["before"], c["after"]).items()))

    def in_frame(c: Column, f: Column) -> Column:
        left = lambda x: F.concat(f["lead"], F.substring(f["text"], F.lit(1), x["place"] - 1))
        likely = F.filter(cores(f["text"]), lambda x: is_candidate(x["core"], left(x), c["before"]))
        near = F.concat(f["lead"], f["text"], f["trail"])
        return F.transform(likely, lambda x: F.struct(c["at"].alias("at"), (c["start"] + f["base"] + x["place"] - 1).alias("start"), x["core"].alias("core"), made(c, x, near).alias("f")))

    each = F.flatten(F.flatten(F.transform(F.col("_cand"), lambda c: F.transform(frames(c["word"]), lambda f: in_frame(c, f)))))
    found = docs.withColumn("_cand", candidates(F.col(text_col))).withColumn("_each", each)
    scored = F.expr(f"transform(_each, e -> struct(e.at AS at, e.start AS start, e.core AS core, element_at(transform(array(e.f), _f -> {to_sql(forest, [f'_f.{k}' for k in FEATURES])}), 1) AS p))")
    out = found.withColumn("_scored", scored)
    final = F.transform("_scored", lambda s: F.struct(s["at"].cast("long").alias("word_at"), s["start"].cast("long").alias("start"), s["core"].alias("secret"), s["p"].alias("probability"), (s["p"] >= threshold).alias("is_secret")))
    return out.withColumn(into, final).drop("_cand", "_each", "_scored")


def findings(docs: DataFrame, forest: list[Node], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate: id, word_at, start, length, secret, probability, is_secret."""
    found = scan(docs.select(F.col(id_col), F.col(text_col).alias("_text")), forest, text_col="_text", into="_found", threshold=threshold)
    rows = found.select(F.col(id_col), F.explode("_found").alias("_x")).select(id_col, "_x.*")
    return rows.select(id_col, "word_at", "start", F.length("secret").cast("long").alias("length"), "secret", "probability", "is_secret")


def redact(docs: DataFrame, forest: list[Node], *, text_col: str = "text", count_col: str = "n_chars", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret in the text replaced by mask; count_col, where docs has it and the text changed, is set to the new length."""
    # the input's row is one struct, so its column names cannot clash with ours
    rows = scan(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text")), forest, text_col="_text", into="_found", threshold=threshold)
    secrets = F.array_sort(F.array_distinct(F.transform(F.filter("_found", lambda x: x["is_secret"]), lambda x: F.struct((-F.length(x["secret"])).alias("o"), x["secret"].alias("s")))))
    clean = rows.select("_doc", "_text", F.aggregate(secrets, F.col("_text"), lambda t, x: F.replace(t, x["s"], F.lit(mask))).alias("_clean"))
    out = {c: F.col("_doc")[c] for c in docs.columns} | {text_col: F.col("_clean")}
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        out[count_col] = F.when(F.col("_clean") != F.col("_text"), F.char_length("_clean").cast(kind)).otherwise(F.col("_doc")[count_col])
    return clean.select(*(v.alias(c) for c, v in out.items()))
