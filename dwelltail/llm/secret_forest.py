"""Secret scans: candidates by form, false positives removed by a random forest.

A candidate is a core of a word that is long and has a digit, is a long run of capitals, or is assigned to a
secret's name, in its word or by the words before it. Its features are length, transitions between kinds of characters, how much of it the corpus dictionary covers,
its document's path, and the words around it. A random forest learns from labelled findings and is then
written out as one expression, so that scanning is a projection of the table: no join, no shuffle, no row per candidate.

Labelled findings are any table with the columns of ``findings`` and ``label`` (1 secret, 0 not).
Where none is given, ``weak_labels`` marks those whose form alone decides (a provider's key format, a value assigned to a
secret's name; addresses, numbers and plain words on the other side); the forest sees none of these rules and decides
the rest. The fit reads at most ``SAMPLE_FINDINGS`` labelled rows of each kind, the lowest hashes; the dictionary
counts every text.

Defined results: NULL and empty texts have no candidates and stay as they are; equal rows give equal findings, once
per row; a NULL path is an empty path; without labelled rows of both kinds a finding's score is that of its
weak label (0.5 where it has none); columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwelltail.llm.common import without
from dwelltail.session import cut

#: Labelled findings of each kind that the fit reads at most.
SAMPLE_FINDINGS = 10_000
#: Words of the corpus dictionary, the ones in most documents.
DICTIONARY_WORDS = 300
TREES, DEPTH, SEED = 20, 5, 4
#: Score from which a finding is a secret.
THRESHOLD = 0.5
REDACTED = "[SECRET]"

# Names that secrets are assigned to, and published key formats.
SECRET_NAMES = "password|passwd|pwd|passphrase|secret|token|api_?key|access_?key|auth|credential|private_?key|bearer"
FORMATS = {
    "aws-access-key": r"^AKIA[0-9A-Z]{16}$",
    "github-token": r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    "slack-token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "jwt": r"^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*$",
}
#: A text without any of these has no candidate.
GATE = rf"[0-9]|[A-Z]{{16}}|[=:>]|(?i:-[a-z_-]{{0,30}}(?:{SECRET_NAMES})|bearer)"
_CORE = r"[A-Za-z0-9](?:[A-Za-z0-9_+/.@:=-]*[A-Za-z0-9])?"

# What stands between a key and its value inside a word: quotes, an assignment or the end of a tag.
_ASSIGN = r"[\\\"'\])]{0,4}(?:[=:]++>?|>)"
# Possessive up to the first name and behind it: a run of key characters is read once, however often names repeat in it.
_NAMED_KEY = rf"(?:(?!(?i:{SECRET_NAMES}))[A-Za-z0-9_.-])*+(?i:{SECRET_NAMES})[A-Za-z0-9_.-]*+"
#: A value assigned to a secret's name: up to its closing quote, without quotes up to a separator.
_VALUE = r"""[\\(\[{]{0,4}(?:"[^"\s]+|'[^'\s]+|(?!//)[^\s"'`<>,;&|()\[\]{}]+)"""
_NO_VALUE = rf"(?![\\\"'(\[{{]{{0,4}}(?:[A-Za-z][A-Za-z0-9+.-]*://|{_NAMED_KEY}[\\\"']{{0,2}}[=:]+[^\s=:]))"
#: One candidate of a word with its key. A word that the words before it assign to a name starts with a blank.
_CHUNK = (
    rf"^ [=:]*+>?{_NO_VALUE}{_VALUE}|[^A-Za-z0-9 ]{{0,8}}+(?:{_NAMED_KEY}{_ASSIGN}{_NO_VALUE}{_VALUE}"
    rf"|[A-Za-z][A-Za-z0-9_.-]*+{_ASSIGN}[\\\"'(]{{0,4}}{_CORE}|{_CORE})"
)
#: Where a core goes on into a secret's name with a value of its own.
_INSIDE = (
    rf"(?<=[^/][=:/@+])(?<!(?i:{SECRET_NAMES})[A-Za-z0-9_.-]{{0,40}}[\\\"']{{0,2}}[=:])(?={_NAMED_KEY}[\\\"']{{0,2}}[=:]+[\\\"']{{0,2}}[A-Za-z0-9])"
)
# The same over several words.
_ASSIGNING = rf"(?i)(?:{SECRET_NAMES})[a-z0-9_.-]{{0,40}}{_ASSIGN}[\\\"'(\[{{]{{0,4}}$|^-.{{0,30}}(?:{SECRET_NAMES})[a-z0-9_-]{{0,40}}$|^\W*bearer$"
_NAMING = rf"(?i)(?:{SECRET_NAMES})[a-z0-9_.-]{{0,40}}[\\\"'\])]{{0,4}}$"
_SIGN = r"^[=:]+>?[\\\"'(\[{]{0,4}$"

FEATURES = (
    "length", "digit_share", "upper_share", "digit_changes", "case_changes", "consonant_pairs", "distinct_share", "hex", "dotted", "at_sign",
    "covered", "named", "quoted", "assigned", "before_known", "after_known", "path_depth", "path_sample",
)


def candidates(text: Column) -> Column:
    """Array of (place, key, value, quoted, before, before2, after), one per candidate of a text.

    A word has a candidate for each of its cores. ``before``, ``before2`` and ``after`` are the neighbouring ones of the
    word, or the neighbouring words where it has none.
    """
    # one element through a lambda, so that a text is split once
    return F.when(text.rlike(GATE), F.flatten(F.transform(F.array(F.split(text, r"\s+")), _of_words)))


def _of_words(words: Column) -> Column:
    name = f"(?i)(?:{SECRET_NAMES})"

    def near(place: Column) -> Column:
        return F.coalesce(F.when(place >= 0, F.get(words, place)), F.lit(""))

    def assigned(word: Column, place: Column) -> Column:
        before, before2 = near(place - 1), near(place - 2)
        return before.rlike(_ASSIGNING) | (before.rlike(_SIGN) & before2.rlike(_NAMING)) | (word.rlike("^[=:]") & before.rlike(_NAMING))

    def parts(chunk: Column) -> Column:
        """Key and value of one match of ``_CHUNK``."""
        named = F.regexp_extract(chunk, rf"^[^A-Za-z0-9 ]*({_NAMED_KEY}){_ASSIGN}{_NO_VALUE}{_VALUE}$", 1)
        plain = F.regexp_extract(chunk, rf"^[^A-Za-z0-9 ]*([A-Za-z][A-Za-z0-9_.-]*+){_ASSIGN}[\\\"'(]{{0,4}}{_CORE}$", 1)
        told = F.startswith(chunk, F.lit(" "))
        key = F.when(told, F.lit("")).when(named != "", named).otherwise(plain)
        head = (
            F.when(told, F.regexp_extract(chunk, r"^ [=:]*>?[\\(\[{]{0,4}[\"']?", 0))
            .when(named != "", F.regexp_extract(chunk, rf"^[^A-Za-z0-9 ]*{_NAMED_KEY}{_ASSIGN}[\\(\[{{]{{0,4}}[\"']?", 0))
            .when(plain != "", F.regexp_extract(chunk, rf"^[^A-Za-z0-9 ]*[A-Za-z][A-Za-z0-9_.-]*+{_ASSIGN}[\\\"'(]{{0,4}}", 0))
            .otherwise(F.regexp_extract(chunk, "^[^A-Za-z0-9]*", 0))
        )
        value = F.regexp_replace(F.substr(chunk, F.length(head) + 1), r"[.:?\\]+$", "")
        return F.struct(key.alias("key"), value.alias("value"), head.rlike("[\"'][^A-Za-z0-9=:>]*$").alias("quoted"), told.alias("told"))

    def likely(c: Column) -> Column:
        value = c["value"]
        secret_name = (c["told"] | c["key"].rlike(name)) & (F.length(value) >= 6)
        return secret_name | ((F.length(value) >= 12) & value.rlike("[0-9]")) | value.rlike("[A-Z]{16}")

    def of_word(s: Column) -> Column:
        word, place = s["w"], s["i"]
        apart = F.regexp_replace(word, _INSIDE, " ")
        chunks = F.regexp_extract_all(F.when(s["told"], F.concat(F.lit(" "), apart)).otherwise(apart), F.lit(f"(?:{_CHUNK})"), F.lit(0))

        def with_context(each: Column) -> Column:
            def beside(chunk: Column, step: int) -> Column:
                at = chunk["j"] + step
                inside = F.when(at >= 0, F.get(each, at)["chunk"])
                beyond = place + at if step < 0 else place + 1
                return F.lower(F.trim(F.coalesce(inside, near(beyond))))

            return F.transform(F.filter(F.transform(each, lambda c: F.struct(c["chunk"].alias("chunk"), c["j"].alias("j"), parts(c["chunk"]).alias("p"))),
                                        lambda c: likely(c["p"])), lambda c: F.struct(
                place.cast("long").alias("place"), c["p"]["key"].alias("key"), c["p"]["value"].alias("value"), c["p"]["quoted"].alias("quoted"),
                beside(c, -1).alias("before"), beside(c, -2).alias("before2"), beside(c, 1).alias("after"),
            ))

        # one element through a lambda, so that the matches of a word are found once
        numbered = F.transform(chunks, lambda c, j: F.struct(c.alias("chunk"), j.alias("j")))
        return F.flatten(F.transform(F.array(numbered), with_context))

    marked = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"), assigned(w, i).alias("told")))
    return F.flatten(F.transform(F.filter(marked, lambda s: s["told"] | s["w"].rlike(GATE)), of_word))


def features(c: Column, path: Column, dictionary: list[str]) -> list[Column]:
    """The numbers a forest decides by, in the order of ``FEATURES``."""
    value, size = c["value"], F.greatest(F.length(c["value"]), F.lit(1)).cast("double")
    lowered = F.lower(value)
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) or "(?!)"
    whole = f"^\\W*(?:{words})\\W*$"

    def count(column: Column, pattern: str) -> Column:
        return F.regexp_count(column, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    name = f"(?i)(?:{SECRET_NAMES})"
    path = F.coalesce(path, F.lit(""))
    return [
        size, count(value, "[0-9]") / size, count(value, "[A-Z]") / size,
        count(value, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / size, count(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / size,
        count(lowered, "[bcdfghjklmnpqrstvwxz](?=[bcdfghjklmnpqrstvwxz])") / size,
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / size, flag(value.rlike("^[0-9a-fA-F]+$")),
        count(value, r"\."), flag(F.contains(value, F.lit("@"))),
        F.lit(1.0) - F.length(F.regexp_replace(lowered, words, "")).cast("double") / size,
        flag(c["key"].rlike(name) | c["before"].rlike(name) | c["before2"].rlike(name)), flag(c["quoted"]),
        flag((c["key"] != "") | c["before"].rlike("[=:]$")), flag(c["before"].rlike(whole)), flag(c["after"].rlike(whole)),
        count(path, "/"), flag(path.rlike("(?i)test|example|sample|fixture|mock|doc")),
    ]


def weak_label(c: Column) -> Column:
    """1 or 0 where the form alone decides, else NULL."""
    value, name = c["value"], f"(?i)^\\W*(?:{SECRET_NAMES})\\W*$"
    known = F.lit(False)
    for pattern in FORMATS.values():
        known = known | value.rlike(pattern)
    assigned = c["key"].rlike(name) | (c["before"].rlike("^[=:]+$") & c["before2"].rlike(name)) | c["before"].rlike(f"(?i)^\\W*(?:{SECRET_NAMES})[\"']*[=:]+>?$")
    random = value.rlike("^[A-Za-z0-9+/_=-]{16,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    harmless = (
        value.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$") | value.rlike(r"^[0-9.:/+-]+$") | value.rlike("^(?:https?://|www\\.)") | (value.rlike("^[A-Za-z]+$") & ~assigned)
    )
    return F.when(known | (assigned & random), F.lit(1)).when(harmless, F.lit(0))


def kind(c: Column) -> Column:
    named = F.when(F.lit(False), F.lit(""))
    for label, pattern in FORMATS.items():
        named = named.when(c["value"].rlike(pattern), F.lit(label))
    around = F.concat_ws(" ", c["key"], c["before"], c["before2"])
    return named.when(around.rlike("(?i)pass|pwd"), F.lit("password")).when(around.rlike(f"(?i){SECRET_NAMES}"), F.lit("token")).otherwise(F.lit("other"))


def dictionary(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The short words in most documents, counted over every text."""
    own = F.filter(F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z]+")), lambda w: F.length(w).between(2, 6))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(words).collect()]


def findings(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: the columns of ``candidates`` and ``path``."""
    each = docs.select(F.explode(candidates(F.col(text))).alias("c"), F.col(path).alias("path"))
    return each.select("c.*", "path")


class Forest:
    """A fitted forest as a column expression, with the dictionary its features need."""

    def __init__(self, trees: list, dictionary: list[str]):
        self.trees, self.dictionary = trees, dictionary

    def score(self, c: Column, path: Column) -> Column:
        """Mean over the trees of the leaf's share of secrets, from 0 to 1."""
        if not self.trees:
            return F.coalesce(weak_label(c).cast("double"), F.lit(0.5))
        values = F.struct(*[value.alias(name) for value, name in zip(features(c, path, self.dictionary), FEATURES)])
        # one element through a lambda, so that each feature is computed once and not once per node
        return F.element_at(F.transform(F.array(values), lambda f: sum((branch(t, f) for t in self.trees), F.lit(0.0)) / len(self.trees)), 1)


def branch(node, values: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold, low, high = node
    return F.when(values[FEATURES[feature]] <= F.lit(threshold), branch(low, values)).otherwise(branch(high, values))


def _tree(node):
    """A fitted tree's node as (feature, threshold, low, high), a leaf as its share of secrets."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def train(labelled: DataFrame, words: list[str], sample: int = SAMPLE_FINDINGS, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit on at most ``sample`` findings of each label, the lowest hashes of value and neighbours."""
    numbers = features({n: F.col(n) for n in ("key", "value", "quoted", "before", "before2", "after")}, F.col("path"), words)
    order = F.xxhash64("value", "before", "after", "place")
    kinds = [labelled.filter(F.col("label") == k).orderBy(order, "value").limit(sample) for k in (0, 1)]
    rows = cut(kinds[0].unionByName(kinds[1]).select(*[n.alias(f) for n, f in zip(numbers, FEATURES)], F.col("label").cast("double").alias("label")))
    if rows.select("label").distinct().count() < 2:
        return Forest([], words)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="_vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt"
    ).fit(vectors)
    return Forest([_tree(tree._call_java("rootNode")) for tree in forest.trees], words)


def learn(docs: DataFrame, text: str = "text", path: str = "source") -> Forest:
    """A forest from the table's own findings with weak labels."""
    found = findings(docs, text, path)
    label = weak_label({n: F.col(n) for n in ("key", "value", "before", "before2")})
    marked = cut(found.withColumn("label", label).filter("label is not null"))
    return train(marked, dictionary(docs, text))


def scan(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with ``findings``: (place, kind, value, score) of every candidate, in text order."""
    kept = without(docs, ("findings",))
    candidate = docs.withColumn("_found", candidates(F.col(text)))
    scored = F.transform("_found", lambda c: F.struct(
        c["place"].alias("place"), kind(c).alias("kind"), c["value"].alias("value"), forest.score(c, F.col(path)).alias("score")
    ))
    return candidate.select(*kept, scored.alias("findings"))


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source", size: str = "n_chars") -> DataFrame:
    """``docs`` with every secret's text replaced by a mark, and the character count brought up to date."""
    scanned = scan(docs.withColumn("_path", F.col(path)).withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c.lower() == "findings"}), forest, text, "_path")
    secrets = F.transform(F.filter("findings", lambda f: f["score"] >= THRESHOLD), lambda f: f["value"])
    longest = F.array_sort(F.array_distinct(secrets), lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(longest, F.col(text), lambda done, value: F.replace(done, value, F.lit(REDACTED)))
    changed = scanned.withColumn("_secrets", secrets).withColumn("_clean", F.when(F.size("_secrets") > 0, clean).otherwise(F.col(text)))
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(F.col("_clean").alias(text))
        elif name == size:
            columns.append(F.when(F.size("_secrets") > 0, F.length("_clean")).otherwise(F.col(size)).cast(docs.schema[size].dataType).alias(size))
        else:
            columns.append(F.col(f"_in_{name}" if name.lower() == "findings" else name).alias(name))
    return changed.select(*columns)
