"""Secret scans with a random forest on candidates. DataFrame operations only.

Candidates are
* runs of 16 or more characters of keys ([A-Za-z0-9_+/=-]) within words, with a digit or a change from lower to upper case;
* words of 8 or more characters, of any signs, right behind a word of credentials: "password: x", "token=x", "secret is x".

Features of a candidate: length, shares of digits, upper-case letters, hexadecimal digits and other signs, changes of
character class, distinct characters, transitions (the shares of its character pairs that are likelier in words than by
chance, and that words hardly have), how much of it dictionary words cover, whether it
lies in a path or an address, quotes, and the words before it: of credentials, of identifiers and checksums, plain ones.
A random forest trained on labelled findings gives the probability that it is a secret; findings below the threshold
are false positives.

The dictionary is the whole words of a public vocabulary, whose path is a parameter; it also gives the pairs of
words. It goes to the plan as a pattern, a tree of the words' letters, whose size is the vocabulary's.
The labelled findings are made by rule (`labelled_findings`): keys in public formats of access tokens, passwords and
passphrases, and look-alikes: identifiers, checksums, paths, addresses, plain words behind words of credentials. Their
number is a parameter, and so are the shapes, so that a model can be tested on shapes that it has not seen.

Null and empty texts: no candidates, no rows. Texts of any length are searched whole, and so are candidates. Repeated
rows: each has its findings. Ties have none. Empty table: no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import json
import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Chosen here: words that speak of credentials, and words that speak of identifiers and checksums.
CREDENTIAL = "token|secret|passw|passphrase|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|signature"
IDENTIFIER = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|etag|uuid|guid|revision|version|build|session.?id|order|invoice"
RUN = "[A-Za-z0-9_+/=-]{16,}"
#: Letters of a dictionary word at most.
LONGEST = 10
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"

FEATURES = ["length", "digits", "upper", "hex", "signs", "changes", "distinct", "pairs", "odd_pairs", "covered", "in_path", "quoted", "credential", "near_credential", "identifier", "plain_before"]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


@functools.lru_cache(4)
def dictionary(path: str) -> tuple[str, ...]:
    """The whole words of a vocabulary file, of 4 to LONGEST letters."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>"))
    return tuple(sorted(w for w in words if 4 <= len(w) <= LONGEST and w.isascii() and w.isalpha() and w.islower()))


@functools.lru_cache(4)
def word_pattern(path: str) -> str:
    """A pattern of the longest dictionary word at a place: a tree of letters."""
    tree: dict = {}
    for w in dictionary(path):
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        rest = [c + pattern(node[c]) for c in sorted(node) if c]
        if not rest:
            return ""
        one = rest[0] if len(rest) == 1 and "" not in node else "(?:" + "|".join(rest) + ")"
        return one + "?" * ("" in node)

    return pattern(tree)


@functools.lru_cache(4)
def pair_scores(path: str) -> tuple[float, ...]:
    """For each pair of 37 classes (other, letters, digits) log2 of how likely words have it, against chance."""
    n = len(_SIGNS) + 1
    counts = [[0.2] * n for _ in range(n)]
    for w in dictionary(path):
        for x, y in zip(w, w[1:]):
            counts[_SIGNS.index(x) + 1][_SIGNS.index(y) + 1] += 1
    return tuple(round(math.log2(c / sum(row) * n), 4) for row in counts for c in row)


def pair_pattern(path: str, least: float, most: float) -> str:
    """A pattern that holds where a pair of characters begins whose score is within these bounds."""
    n, scores = len(_SIGNS) + 1, pair_scores(path)
    groups = [x + "[" + "".join(y for j, y in enumerate(_SIGNS) if least < scores[(i + 1) * n + j + 1] <= most) + "]" for i, x in enumerate(_SIGNS)]
    return "(?=" + "|".join(g for g in groups if not g.endswith("[]")) + ")"


def with_features(found: DataFrame, path: str) -> DataFrame:
    """Adds the features to rows of before (the words before it), word (that holds it) and candidate."""
    c, low = F.col("candidate"), F.lower(F.col("candidate"))
    n = F.length(c).cast("double")
    own = F.lower(F.expr("substring_index(word, candidate, 1)"))
    near = F.concat_ws(" ", F.lower("before"), own)
    last = F.concat_ws(" ", F.element_at(F.split(F.lower("before"), " "), -1), own)
    changes = F.regexp_count(c, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"))
    pairs = lambda least, most: F.regexp_count(low, F.lit(pair_pattern(path, least, most))) / F.greatest(n - 1, F.lit(1.0))
    return found.withColumns(
        {
            "length": F.least(n, F.lit(120.0)),
            "digits": _count(c, "[0-9]") / n,
            "upper": _count(c, "[A-Z]") / n,
            "hex": _count(low, "[0-9a-f]") / n,
            "signs": _count(c, "[^A-Za-z0-9]") / n,
            "changes": changes / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
            "pairs": pairs(0.0, 99.0),
            "odd_pairs": pairs(-99.0, -3.0),
            "covered": _count(low, word_pattern(path)) / n,
            "in_path": (F.col("word").rlike("://|www[.]|^[./~]|[A-Za-z]:\\\\|/[^/]*/[^/]*/") | F.col("word").rlike("[.](?:html?|php|png|jpe?g|gif|js|css|py|java|txt|pdf|zip)")).cast("double"),
            "quoted": F.col("word").rlike("[\"'`]").cast("double"),
            "credential": near.rlike(CREDENTIAL).cast("double"),
            "near_credential": last.rlike(f"(?:{CREDENTIAL})[\\w.-]*[\"']?[:=]").cast("double"),
            "identifier": near.rlike(IDENTIFIER).cast("double"),
            "plain_before": F.regexp_count("before", F.lit("(?<![^ ])[a-z]{2,}(?![^ ])")).cast("double"),
        }
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_index, before, word, candidate of every candidate in docs(doc_id, text)."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike(f"{RUN}|(?i:{CREDENTIAL})"))
    # each word with the three before it, as arrays side by side, so that no word looks into the whole array again
    none, w = F.lit(""), F.split("text", "[ \\t\\n\\r\\x0B\\f]+")
    words = some.select("doc_id", F.arrays_zip(w.alias("x"), F.concat(F.array(none), w).alias("a"), F.concat(F.array(none, none), w).alias("b"), F.concat(F.array(none, none, none), w).alias("c")).alias("z"))
    # places of runs, and those behind a word of credentials: right behind one, or behind one and a sign or "is"
    spoken = lambda x: x.rlike(f"(?i:{CREDENTIAL})")
    link = ["=", ":", ":=", "=>", "->", "==", "is", "was"]

    def behind(k: Column) -> Column:
        right = k["a"].rlike("[:=]$") & spoken(k["a"])
        linked = F.lower(k["a"]).isin(link) & spoken(k["b"])
        return right | linked | F.lower(k["a"]).isin("bearer", "basic") | k["x"].rlike(f"(?i:{CREDENTIAL})[\\w.-]*[\"']?[:=]+.")

    kind = lambda k, i: F.when(F.length(k["x"]) >= 8, F.struct(i.alias("word_index"), ((F.length(k["x"]) >= 16) & k["x"].rlike(RUN)).alias("run"), behind(k).alias("behind"), k["x"].alias("word"), F.concat_ws(" ", k["c"], k["b"], k["a"]).alias("before")))
    hits = F.filter(F.transform("z", kind), lambda k: k["run"] | k["behind"])
    rows = words.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({RUN})"), F.lit(1)), lambda c: c.rlike("[0-9]|[a-z][A-Z]"))
    bare = F.regexp_replace("word", f"^.*?(?i:{CREDENTIAL})[\\w.-]*[\"']?[:=]+", "")
    bare = F.regexp_replace(bare, "^[\"'`(<\\[{]+|[\"'`)>\\]},;.:]+$", "")
    spoken_of = F.when(F.col("behind") & (F.length(bare) >= 8), F.array(bare)).otherwise(F.array().cast("array<string>"))
    # a word that is a run as a whole is one candidate
    every = F.when(F.col("run"), F.array_union(runs, F.when(F.size(runs) == 0, spoken_of).otherwise(F.array().cast("array<string>")))).otherwise(spoken_of)
    return rows.withColumn("candidate", F.explode(every)).select("doc_id", "word_index", "before", "word", "candidate")


SECRETS = ["hex40", "hex64", "base64", "AKIA", "ghp", "hex32", "sk_live", "password", "passphrase"]
OTHERS = ["commit", "digest", "uuid", "path", "camel", "slug", "number", "snake", "plain", "quoted_words", "url"]
#: Shapes that the default model has not seen; tests measure it on them.
HELD_OUT = ["xoxb", "AIza", "jwt", "letters", "pin_words", "etag", "file", "sentence"]


def labelled_findings(spark: SparkSession, path: str, n: int = 6000, shapes: list[str] | None = None) -> DataFrame:
    """before, word, candidate, label, shape of n findings made by rule, of the given shapes or of SECRETS and OTHERS."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(h("b"), h("c")))), "[=]", "")
    letters = F.regexp_replace(base64, "[^A-Za-z0-9]", "x")
    chosen = F.split(F.lit(" ".join(dictionary(path)[::7])), " ")
    word = lambda k: F.element_at(chosen, (F.pmod(F.xxhash64(i, F.lit(k)), F.size(chosen)) + 1).cast("int"))
    of = lambda k, *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(x))) + 1).cast("int"))
    key = of("k", "token =", "the secret:", "api_key =", "with password =", "Authorization: Bearer", "access_key:", "auth token is", "my passphrase is", "set pwd =")
    loose = of("k", "and then the", "it was set to", "token =", "secret:", "api_key =", "password =", "Authorization: Bearer", "access key")
    ident = of("i", "commit", "sha256", "checksum is", "uuid", "order number", "the file", "see also", "version", "build id =", "etag:")
    prose = of("r", "see also the", "in the", "call to", "a long", "with", "go to")
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    number = lambda m: F.pmod(F.xxhash64(i, F.lit("n")), F.lit(m)).cast("string")
    cut = lambda x, k: F.substring(x, 1, k)
    every = {
        "hex40": (1, loose, cut(h("a"), 40)), "hex64": (1, loose, h("a")), "hex32": (1, loose, cut(h("a"), 32)), "base64": (1, loose, cut(base64, 40)),
        "AKIA": (1, loose, F.concat(F.lit("AKIA"), F.upper(cut(letters, 16)))), "ghp": (1, loose, F.concat(F.lit("ghp_"), cut(letters, 36))), "sk_live": (1, loose, F.concat(F.lit("sk_live_"), cut(letters, 24))),
        "password": (1, key, F.concat(of("pw", "", "My", "x"), word(1), number(9999), of("s", "!", "!x", "@", "#1", "$", "_?"))), "passphrase": (1, key, F.call_function("concat_ws", of("j", "-", "_", "."), word(1), word(2), word(3), word(4))),
        "xoxb": (1, loose, F.concat(F.lit("xoxb-"), F.regexp_replace(cut(h("d"), 11), "[a-f]", "7"), F.lit("-"), cut(letters, 24))), "AIza": (1, loose, F.concat(F.lit("AIza"), cut(base64, 35))), "jwt": (1, loose, F.concat_ws("-", F.concat(F.lit("eyJ"), cut(base64, 30)), cut(F.reverse(base64), 43))),
        "letters": (1, key, F.regexp_replace(cut(letters, 24), "[0-9]", "q")), "pin_words": (1, key, F.concat(word(1), of("s", "!", "#", "&"), word(2), number(99))),
        "commit": (0, ident, cut(h("c"), 40)), "digest": (0, ident, h("c")), "uuid": (0, ident, uuid), "path": (0, prose, F.concat_ws("/", F.lit("usr"), word(1), word(2), F.concat(word(3), number(90)))),
        "camel": (0, prose, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)))), "slug": (0, prose, F.concat_ws("-", word(1), word(2), word(3), number(2000))), "number": (0, ident, F.regexp_replace(cut(h("d"), 18), "[a-f]", "7")),
        "snake": (0, prose, F.concat_ws("_", word(1), word(2), number(90), word(3))), "plain": (0, key, F.concat(word(1), of("e", "", "ing", "ed", "s"), of("q", "", "ment", "able"))), "quoted_words": (0, of("v", "the token is", "password: is", "a secret is", "auth ="), F.concat(word(1), word(2))),
        "url": (0, of("t", "at", "from", "token ="), F.concat(F.lit("https-//"), word(1), F.lit("-"), word(2), F.lit("/"), word(3), number(99))),
        "etag": (0, F.lit("the etag was"), cut(h("e"), 32)), "file": (0, F.lit("open"), F.concat_ws("_", word(1), word(2), F.lit("2019"), number(12), F.lit("final"))), "sentence": (0, F.lit("the password is"), F.concat(word(1), F.lit("ness"))),
    }
    names = shapes or [x for pair in zip(SECRETS + OTHERS, OTHERS + SECRETS) for x in pair]
    shape = of("p", *names) if shapes else F.when(F.pmod(i, F.lit(2)) == 1, of("p", *SECRETS)).otherwise(of("p", *OTHERS))
    pick = lambda k: F.coalesce(*(F.when(F.col("shape") == s, F.lit(every[s][0]).cast("double") if k == 0 else every[s][k]) for s in dict.fromkeys(names)))
    out = spark.range(0, n, 1, 4).withColumn("shape", shape).select(pick(0).alias("label"), pick(1).alias("before"), pick(2).alias("candidate"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("q"), "shape")
    return out.withColumn("word", F.when(F.col("q") == 0, F.col("candidate")).when(F.col("q") == 1, F.concat(F.lit('"'), F.col("candidate"), F.lit('"'))).otherwise(F.concat("candidate", F.lit(".")))).drop("q")


def forest(findings: DataFrame, path: str, trees: int = 30, depth: int = 9, seed: int = 17):
    """A random forest trained on labelled findings (before, word, candidate, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, path)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, path: str, threshold: float = 0.5, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, word_index, candidate, probability, is_secret of every candidate in docs(doc_id, text)."""
    model = forest(labelled_findings(docs.sparkSession, path) if findings is None else findings, path)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs), path))
    scored = model.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "word_index", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def op9_secret_forest(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
