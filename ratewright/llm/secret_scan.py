"""Secrets in texts: patterns propose candidates, a random forest removes the false ones.

DataFrame functions and Spark's own forest only. A candidate's features are its length, how often its letters change class, how much
of it common words of the corpus cover, whether it is part of a path or address, and its neighbouring words. The forest is trained
from labelled findings, a parameter: doc_id, start and label (1: a secret).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import smallest_hashes
from ratewright.llm.spans import letters_of, nearby, with_matches
from ratewright.sources.tables import written

#: Names before a value, known forms of keys, words of placeholders, and any long run of letters with a digit.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
FORMS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10}|AIza[0-9A-Za-z_-]{35}|sk[-_](?:live_|test_)?[A-Za-z0-9]{20}"
FORM = rf"(?:{FORMS})[A-Za-z0-9_-]*+"  # at least so long; a key ends where its run of letters does, or its tail would stay readable
PLACEHOLDERS = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|your[_-]"
PLACEHOLDER_WORDS = r"(?i)(?<![.@\w-])(?:example|sample|dummy|placeholder)(?![.@\w-])"
VALUE = r"[A-Za-z0-9+/=_.-]"
START = rf"(?i:(?:{NAMES})(?:\\?[\"'])?[\x20\t]{{0,3}}[:=][\x20\t]{{0,3}}(?:\\?[\"'])?)"  # a name, quoted or not, up to its value
#: After a quote all marks up to the closing one, else the marks that do not part values; an address is no value.
MARKED = r"(?:(?<=\")(?:[^\"\s\\]|\\[^\"'\s]){8,}+|(?<=')(?:[^'\s\\]|\\[^\"'\s]){8,}+|[A-Za-z0-9+/=_.@!#$%^*?~:-]{8,}+)"
CANDIDATE = (
    rf"{START}(?=\S)(?:(?![A-Za-z]{{2,9}}://){MARKED}|{VALUE}{{8,}}+)"
    rf"|(?<![A-Za-z0-9]){FORM}"
    rf"|(?<!{VALUE})(?={VALUE}*+)(?=[A-Za-z+/=_.-]*+[0-9]){VALUE}{{16,}}+"
)
HEAD = f"^{START}"
REACH = 40
COMMON_SHARE, COMMON_LEAST = 1 / 2500, 3  # of all documents, but at least so many
SAMPLE_FINDINGS = 5000
TREES, DEPTH, SEED = 20, 8, 11
FEATURE_SHARE = "0.7"
LEAST_SCORE = 0.5
FEW_TRANSITIONS = 0.35  # words parted by marks change class at every third place, random letters and digits at every second
MASK = "[SECRET]"
FEATURES = ("length", "transitions", "classes", "digits", "distinct", "coverage", "path", "named", "form", "placeholder", "word_before")


def candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, start, end, value, before, after, named: one row per proposed span (the value alone, without its name).

    ``text_hash`` tells rows with the same id apart. NULL and empty texts have none; repeated rows give repeated candidates.
    """
    df = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    df = with_matches(df, "text", "found", CANDIDATE, F.col("text").rlike(f"(?i:{NAMES})|[0-9]|{FORMS}"), lambda match: F.lit(True))
    df = df.where(F.size("found") > 0).select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.explode("found").alias("match"))
    value = F.regexp_replace(F.col("match.text"), HEAD, "")
    df = df.withColumns({"value": value, "skipped": F.length("match.text") - F.length(value)})
    df = df.withColumn("start", (F.col("match.start") + F.col("skipped")).cast("long"))
    df = df.withColumn("end", F.col("start") + F.length("value"))
    before, after = nearby(F.col("text"), F.col("start").cast("int"), F.col("end").cast("int"), REACH)
    return df.select("doc_id", "text_hash", "start", "end", "value", before.alias("before"), after.alias("after"), (F.col("skipped") > 0).alias("named"))


def letter_class(letter: Column) -> Column:
    code = F.ascii(letter)
    return F.when(code.between(48, 57), 1).when(code.between(65, 90), 2).when(code.between(97, 122), 3).otherwise(4)


def common_words(documents: DataFrame, pieces: DataFrame, text_col: str = "text") -> DataFrame:
    """The ``piece``s that are words of a ``COMMON_SHARE`` of the documents; counted over all documents."""
    words = F.array_distinct(F.split(F.lower(documents[text_col].cast("string")), r"[^\p{L}]+"))
    seen = documents.select(F.explode(words).alias("piece")).where(F.length("piece") >= 3)
    least = max(COMMON_LEAST, COMMON_SHARE * documents.count())
    common = seen.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return common.join(pieces, "piece", "left_semi").select("piece")


def with_features(found: DataFrame, documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    value = F.col("value")
    length = F.length(value)
    classes = F.transform(letters_of(value), letter_class)
    pairs = F.zip_with(F.slice(classes, 1, F.greatest(length - 1, F.lit(0))), F.slice(classes, 2, F.greatest(length - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    changes = F.aggregate(pairs, F.lit(0), lambda a, b: a + b)
    pieces = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), F.lit(0)))
    key = ["doc_id", "text_hash", "start"]
    parts = found.select("value", F.explode(pieces).alias("piece")).distinct()
    common = common_words(documents, parts.select("piece").distinct(), text_col)
    covered = parts.join(common, "piece").groupBy("value").agg(F.sum(F.length("piece")).alias("covered"))
    around = F.concat_ws(" ", "before", "after")
    df = found.join(covered, "value", "left")
    return df.withColumns(
        {
            "length": length.cast("double"),
            "transitions": changes / F.greatest(length - 1, F.lit(1)),
            "classes": F.size(F.array_distinct(classes)).cast("double"),
            "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / F.greatest(length, F.lit(1)),
            "distinct": F.size(F.array_distinct(letters_of(value))) / F.greatest(length, F.lit(1)),
            "coverage": F.least(F.coalesce(F.col("covered"), F.lit(0)) / F.greatest(length, F.lit(1)), F.lit(1.0)),
            "path": (F.col("before").rlike(r"[/@.\\]$|://") | value.rlike(r"[/.]") | F.col("after").rlike(r"^[/@\\]")).cast("double"),
            "named": (F.col("named") | F.col("before").rlike(rf"(?i:{NAMES})\W*$")).cast("double"),
            "form": value.rlike(f"^{FORM}$").cast("double"),
            "placeholder": (value.rlike(PLACEHOLDERS) | around.rlike(PLACEHOLDER_WORDS)).cast("double"),
            "word_before": F.col("before").rlike(r"\p{L}\W*$").cast("double"),
        }
    ).select(*key, "end", "value", *FEATURES)


def rule_labels(featured: DataFrame) -> DataFrame:
    """Labelled findings where no person has labelled any: doc_id, text_hash, start, label, for the clear cases only.

    Clear secrets are known key forms, and named values that mix letters and digits and are not covered by common words. Clear
    non-secrets are placeholders, values without a name that are mostly one class of letter, and values common words cover. Other
    values without a name are left to the forest.
    """
    mixed = (F.col("digits") > 0.1) & (F.col("transitions") > 0.15) & (F.col("coverage") < 0.5) & (F.col("placeholder") == 0)
    secret = ((F.col("form") == 1) & (F.col("placeholder") == 0)) | ((F.col("named") == 1) & mixed)
    even = (F.col("transitions") <= FEW_TRANSITIONS) | ~F.col("value").rlike("[A-Za-z]")
    unnamed = (F.col("named") == 0) & (F.col("form") == 0) & even
    plain = (F.col("placeholder") == 1) | unnamed | (F.col("coverage") >= 0.8)
    label = F.when(secret, 1).when(plain, 0)
    return featured.withColumn("label", label).where(F.col("label").isNotNull()).select("doc_id", "text_hash", "start", "label")


def train(featured: DataFrame, labelled: DataFrame, sample: int = SAMPLE_FINDINGS, hide_names: bool = False) -> RandomForestClassificationModel | float:
    """Forest from at most ``sample`` labelled findings of each label (by hash of their place); with one label alone, its share of 1.

    With ``hide_names`` named secrets are learned a second time as if they had no name: rules know secrets of no known form by their
    names only, and the forest would take the name for what makes a secret.
    """
    keys = [c for c in ("doc_id", "text_hash", "start") if c in labelled.columns]
    known = featured.join(labelled.select(*keys, F.col("label").cast("double").alias("label")).dropDuplicates(keys), keys)
    known = written(known)
    sides = [smallest_hashes(known.where(F.col("label") == label), ["doc_id", "text_hash", "start"], sample) for label in (0.0, 1.0)]
    chosen = written(sides[0].unionByName(sides[1]).select("label", *FEATURES))
    counts = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return 1.0 if counts.get(1.0) else 0.0
    if hide_names:
        chosen = chosen.unionByName(chosen.where("label = 1 and named = 1 and form = 0").withColumn("named", F.lit(0.0)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy=FEATURE_SHARE, featuresCol="features", labelCol="label")
    return forest.fit(_assembled(chosen))


def _assembled(featured: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)


def scan(documents: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, start, end, value, score, secret: every candidate of every whole text with the forest's probability.

    ``labelled`` has doc_id, start and label; without it the clear cases are labelled by rule. An empty table, or one without
    candidates, gives an empty result. Columns other than the two named are ignored.
    """
    featured = written(with_features(written(candidates(documents, id_col, text_col)), documents, text_col))
    model = train(featured, rule_labels(featured) if labelled is None else labelled, hide_names=labelled is None)
    if isinstance(model, float):
        scored = featured.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_assembled(featured)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "text_hash", "start", "end", "value", "score", (F.col("score") >= LEAST_SCORE).alias("secret"))


def masked(documents: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``documents`` with the accepted findings of each text replaced by ``mask``; all rows and columns are kept.

    NULL and empty texts stay as they are; rows that repeat an id and a text are all masked.
    """
    spans = F.array_sort(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))))
    per_text = findings.where("secret").groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(spans.alias("__spans"))
    text = documents[text_col]
    joined = documents.join(per_text, documents[id_col].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__hash")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        kept = F.substring(F.col(text_col), state["at"] + 1, span["start"] - state["at"])
        return F.struct(span["end"].alias("at"), F.concat(state["out"], kept, F.lit(mask)).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col(text_col), state["at"] + 1, F.length(F.col(text_col))))

    cleaned = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.aggregate(F.col("__spans"), begin, step, finish))
    return joined.withColumn(text_col, cleaned).select(*documents.columns)
