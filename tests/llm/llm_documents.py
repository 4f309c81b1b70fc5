"""Small made-up documents for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, node string, score double, language string, found int, key string"


def syllables(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


LANGUAGES = {
    "aa": ["ka", "to", "mi", "re", "su"],
    "bb": ["öl", "grü", "tz", "sch", "ei"],
    "cc": ["ção", "nh", "lha", "é", "ou"],
}


def prose(rng, language, words):
    return " ".join(syllables(rng, LANGUAGES[language], rng.randint(1, 4)) for _ in range(words))


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, l, "src", None if t is None else len(t), 5, "n", 0.5, "x", 1, "k") for i, t, l in rows]
    return spark.createDataFrame(full, SCHEMA)
