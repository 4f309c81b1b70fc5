import random

import pytest
from llm_documents import LANGUAGES, frame, prose


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text, lang): prose, copies, near copies, NULLs, empty and very long texts, repeated and nameless rows."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice(list(LANGUAGES)), rng.randint(3, 120)), None) for i in range(60)]
    rows = [(i, t, "aa" if "ka" in t or "to" in t else "bb" if "sch" in t or "tz" in t else "cc") for i, t, _ in rows]
    long = prose(rng, "aa", 30_000)
    words = rows[10][1].split() + rows[11][1].split() + rows[12][1].split() + rows[13][1].split()
    for k in range(6):
        changed = list(words)
        changed[(7 * k) % len(changed)] = f"other{k}"
        rows.append((100 + k, " ".join(changed), "aa"))
    rows += [(200, rows[0][1], "aa"), (201, rows[0][1].upper(), None), (202, None, "aa"), (203, "", "bb"), (204, " \n\t ", None), (205, long, "aa")]
    rows += [(206, "1234 !!! ...", None), (207, "word", "aa"), (208, "two  words\n \n x", "cc"), (209, "<|endoftext|> é́ 世界 🎉", None)]
    rows += [(210, "a" * 5000 + "!" * 3000 + " " * 2000, None), (5, rows[5][1], "aa"), (None, "no name here", "aa"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return frame(spark, awkward_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
