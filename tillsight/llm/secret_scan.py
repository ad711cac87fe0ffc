"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters, or a value of at least eight
characters that is assigned to a credential's name.  What stands around it, or
the format of a known issuer, labels it; the forest doesn't see that.  It judges by
the value's length, characters and their transitions, by how much of it frequent
words of the corpus cover, by the path it was found under and by the
neighbouring words.  So a word that is assigned to a password's name is
labelled a secret, but looks like all the words that aren't, and is removed.  All
of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .storage import Scratch

# A credential's name: a word that holds one of these.
CREDENTIAL = "token|secret|passw|pwd|api|auth|cred|key|bearer|private|session"
NAMED = rf"""(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{{0,40}}?(?i:{CREDENTIAL})[A-Za-z0-9_.-]{{0,40}}["']?\s{{0,4}}(?:=>?|:=?)\s{{0,4}}["']?"""
# Its value ends before white space, quotes and punctuation of its surroundings.
VALUE = r"""[^\s"'`<>,;&(){}\[\]]{8,}"""
RUN = "[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{NAMED}{VALUE}|{RUN}"
# Formats that issuers of keys use.
ISSUED = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})$"
)
TRIAL_PATH = r"(?i)test|example|sample|mock|fixture|docs?/"
# Characters before and after a candidate in which neighbouring words are looked for.
CONTEXT = 48
# The most frequent words that count as the dictionary.
DICTIONARY_WORDS = 200
# Labelled findings of either kind that the forest is grown on, at most about so many.
TRAIN_ROWS = 5000
# One labelled finding in so many is held out to set the threshold.
HELD_OUT = 5
TREES, DEPTH, SEED = 24, 6, 11
# The threshold where nothing is held out.
SECRET_FROM = 0.5
DRAWS = 1 << 30
MASK = "[SECRET]"
NEIGHBOURS = ("word_before", "digits_before", "known_before", "word_after", "known_after")
FEATURES = (
    "length",
    "digits",
    "upper",
    "lower",
    "signs",
    "transitions",
    "distinct",
    "distinct_pairs",
    "vowels",
    "longest_letters",
    "hexadecimal",
    "dictionary",
    "path",
    "trial_path",
    *NEIGHBOURS,
)


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to seven letters, counted over all documents."""
    each = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("word"))
    counts = each.where(F.length("word").between(3, 7)).groupBy("word").count()
    return [row["word"] for row in counts.orderBy(F.desc("count"), "word").limit(words).collect()]


def candidates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", context: int = CONTEXT
) -> DataFrame:
    """One row for each place of a candidate: doc_id, path, value, start (from 1), named, before, after.

    ``named`` tells whether the value is assigned to a credential's name; before
    and after reach ``context`` characters, at most to the next candidate.  The
    pieces between the matches give every place in one pass, however many a
    text holds.  Nulls and texts without a candidate give no row.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(path_col).alias("path"),
        F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0)).alias("matches"),
    ).where(F.size("matches") > 0)
    rows = rows.select("doc_id", "path", "matches", F.split("text", CANDIDATE, -1).alias("pieces"))
    # Running lengths of pieces and matches: where each match starts.
    steps = F.zip_with(
        F.slice("pieces", 1, F.size("matches")), "matches", lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size"))
    )
    state = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))

    def placed(held: Column, step: Column) -> Column:
        start = held["next"] + step["gap"]
        return F.struct((start + step["size"]).alias("next"), F.concat(held["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate(steps, state, placed, lambda held: held["starts"])
    places = F.transform(
        F.arrays_zip(F.col("matches").alias("found"), starts.alias("at")),
        lambda f, i: F.struct(
            f["found"].alias("found"),
            f["at"].alias("at"),
            F.get("pieces", i).alias("piece"),
            F.get("pieces", i + 1).alias("after"),
        ),
    )
    each = rows.select("doc_id", "path", F.explode(places).alias("f")).select("doc_id", "path", "f.*")
    value = F.regexp_replace(F.regexp_replace("found", f"^{NAMED}(?={VALUE})", ""), "(?<=.{8})[.:!?]+$", "")
    cut = each.withColumns({"value": value, "named": F.col("found").rlike(f"^{NAMED}{VALUE}")})
    lead = F.length(F.regexp_extract("found", f"^{NAMED}(?={VALUE})", 0))
    return cut.select(
        "doc_id",
        "path",
        "value",
        (F.col("at") + F.when(F.col("named"), lead).otherwise(0)).alias("start"),
        "named",
        F.substring("piece", -context, context).alias("before"),
        F.substring("after", 1, context).alias("after"),
    )


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """Candidates with the features of the forest."""
    value, n = F.col("value"), F.length("value")
    letters = F.greatest(F.regexp_count(value, F.lit("[A-Za-z]")), F.lit(1))
    pieces = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    rest = F.regexp_replace(F.lower(value), pieces, "") if pieces else value
    previous = F.regexp_extract("before", r"""([^\s"'=:]+)[\s"'=:]*$""", 1)
    following = F.regexp_extract("after", r"""^[\s"'.,;]*([^\s"'.,;]+)""", 1)
    path = F.coalesce("path", F.lit(""))

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    def known(word: Column) -> Column:
        return F.lower(word).isin(*words) if words else F.lit(False)

    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(value, i, F.lit(2)))
    runs = F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), F.length)
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "transitions": share(changes),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "distinct_pairs": F.size(F.array_distinct(pairs)) / (n - 1),
        "vowels": F.regexp_count(value, F.lit("[aeiouAEIOU]")) / letters,
        "longest_letters": F.coalesce(F.array_max(runs), F.lit(0)) / n,
        "hexadecimal": value.rlike("^[0-9a-fA-F]+$"),
        "dictionary": 1 - F.length(rest) / n,
        "path": F.pmod(F.crc32(path.cast("binary")), F.lit(16)),
        "trial_path": path.rlike(TRIAL_PATH),
        "word_before": F.length(previous),
        "digits_before": F.regexp_count(previous, F.lit("[0-9]")),
        "known_before": known(previous),
        "word_after": F.length(following),
        "known_after": known(following),
    }
    return found.withColumns({name: column.cast("double") for name, column in columns.items()})


def weak_labels() -> Column:
    """1 for a value that is assigned to a credential's name or has an issuer's format, 0 for any other
    run of letters or of digits alone, null for what only its looks could tell.

    What makes a 1 stands around a value, or is an issuer's sign; the forest's
    features hold neither, so a word may be labelled either way.
    """
    named = F.col("named") | F.col("value").rlike(ISSUED)
    return F.when(named, 1).when(F.col("value").rlike("^([A-Za-z]+|[0-9]+)$"), 0)


@dataclass
class SecretModel:
    """A forest, or none where the labels are all of one kind, and the score from which on a value is a secret.

    ``held_out`` counts the held-out findings by label and by what the forest
    says: (label, secret) -> rows.
    """

    words: list[str]
    forest: Model | None
    secret_from: float = SECRET_FROM
    held_out: dict[tuple[int, bool], int] | None = None


def _draw(*columns: str) -> Column:
    """An even number below 1 from some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(DRAWS)) / float(DRAWS)


def fit(labelled: DataFrame, words: list[str], train_rows: int = TRAIN_ROWS) -> SecretModel:
    """A forest from labelled findings: the columns of ``described`` and label (1 secret, 0 not, null unknown).

    About ``train_rows`` findings of either label are learned from, picked by a
    hash; in smaller tables all are.  They are weighed by 1 / the share taken, so
    the labels keep their rates.  Each is learned twice, once without its
    neighbouring words, so that a value decides more than its place.  A fifth of
    the values is held out; the threshold is the score at which precision and
    recall over all held-out findings balance best, in the middle of equal ones.
    """
    rows = labelled.where(F.col("label").isin(0, 1)).select("doc_id", "value", "start", F.col("label").cast("double").alias("label"), *FEATURES)
    learned = rows.where(_draw("value") >= 1 / HELD_OUT)
    numbers = {row["label"]: row["count"] for row in learned.groupBy("label").count().collect()}
    if len(numbers) < 2:
        return SecretModel(words, None)
    most = {label: min(1.0, train_rows / count) for label, count in numbers.items()}
    share = F.when(F.col("label") == 1, most[1.0]).otherwise(most[0.0])
    taken = learned.where(_draw("doc_id", "start", "value") < share).withColumn("weight", 1 / share)
    bare = taken.withColumns({name: F.lit(0.0) for name in NEIGHBOURS})
    # A bounded sample in one fixed order grows the same forest everywhere.
    sample = taken.union(bare).repartition(1).sortWithinPartitions("doc_id", "start", "value", *NEIGHBOURS)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight"
    ).fit(vectors)
    checked = _scored(rows.where(_draw("value") < 1 / HELD_OUT), forest)
    # A row for each hundredth of the score and label.
    steps = checked.groupBy(F.floor(F.col("score") * 100).cast("int").alias("step"), "label").count().collect()
    threshold, held_out = _balanced([(row["step"], int(row["label"]), row["count"]) for row in steps])
    return SecretModel(words, forest, threshold, held_out)


def _balanced(steps: list[tuple[int, int, int]]) -> tuple[float, dict[tuple[int, bool], int]]:
    """The score from which on findings are best called secrets, and the counts by label and verdict there."""

    def counted(limit: int) -> dict[tuple[int, bool], int]:
        counts = {(label, said): 0 for label in (0, 1) for said in (False, True)}
        for step, label, rows in steps:
            counts[label, step >= limit] += rows
        return counts

    balance = []
    for limit in range(1, 101):
        counts = counted(limit)
        both = 2 * counts[1, True] + counts[0, True] + counts[1, False]
        balance.append(2 * counts[1, True] / both if both else 0.0)
    best = max(balance)
    if best <= 0:
        return SECRET_FROM, {}
    first = balance.index(best)
    last = next((n for n in range(first, 100) if balance[n] < best), 100) - 1
    limit = (first + last) // 2 + 1
    return limit / 100, counted(limit)


def _scored(found: DataFrame, forest: Model) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    return forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def judged(found: DataFrame, model: SecretModel) -> DataFrame:
    """Described candidates with score and is_secret; a score that equals the threshold is a secret's.

    Without a forest the weak labels stand.
    """
    if model.forest is None:
        scored = found.withColumn("score", F.coalesce(weak_labels(), F.lit(0)).cast("double"))
    else:
        scored = _scored(found, model.forest)
    return scored.withColumn("is_secret", F.col("score") >= model.secret_from)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    scratch: Scratch | None = None,
    label: Column | None = None,
) -> DataFrame:
    """All secrets, at every place where they stand: doc_id, value, start (from 1), length, score.

    The forest is grown on the findings that ``label`` marks (see ``fit``), by
    default by ``weak_labels``.  Null, empty and candidate-free texts have none,
    of texts of any length all candidates are judged; repeated rows give repeated
    findings; an empty table gives none.  Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secret-scan")
    words = dictionary(docs, text_col)
    found = scratch.table(described(candidates(docs, id_col, text_col, path_col), words), "candidates")
    model = fit(found.withColumn("label", weak_labels() if label is None else label), words)
    secrets = judged(found, model).where("is_secret")
    return secrets.select("doc_id", "value", "start", F.col("length").cast("int").alias("length"), "score")


def redact(docs: DataFrame, secrets: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in their texts masked; n_chars, if there, follows the text.

    The longest values are masked first.  Rows that repeat an id share its
    findings, and so do rows without an id.  Null and empty texts stay as they
    are; the columns of ``docs`` may have any names and all come back.
    """
    longest_first = F.array_sort(
        F.collect_set("value"),
        lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    values = secrets.groupBy(F.col("doc_id").alias("id")).agg(longest_first.alias("values")).alias("found")
    joined = docs.alias("doc").join(values, F.col(f"doc.{id_col}").eqNullSafe(F.col("found.id")), "left")
    own, held = F.col(f"doc.{text_col}"), F.col("found.values")
    masked = F.when(held.isNull(), own).otherwise(F.aggregate(held, own, lambda text, value: F.replace(text, value, F.lit(mask))))

    def column(name: str) -> Column:
        if name == text_col:
            return masked.alias(name)
        if name == "n_chars":
            length = F.length(masked).cast(docs.schema["n_chars"].dataType)
            return F.when(held.isNull(), F.col("doc.n_chars")).otherwise(length).alias(name)
        return F.col(f"doc.`{name}`").alias(name)

    return joined.select(*[column(name) for name in docs.columns])
