"""Short ways that give what the plain ones give."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vocab
from quillspark.functions.issues import ISSUES
from quillspark.operators import device, digest, textrank


def test_white_space_is_that_of_the_pattern(spark):
    chars = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(chr(c),) for c in chars], "c string")
    odd = rows.filter((X.trimmed(F.concat("c", F.lit("a b"), "c", "c")) != F.regexp_replace(F.concat("c", F.lit("a b"), "c", "c"), r"(?U)^\s+|\s+$", "")))
    assert odd.count() == 0
    assert "btrim" in str(X.trimmed(F.col("c"))).lower() and "regexp" not in str(X.trimmed(F.col("c"))).lower()


def test_what_cannot_score_is_not_searched():
    told = re.compile("[가-힣0-9]")
    assert all(told.search(w) for w in (*vocab.TERM_HINTS, *(i[0] for i in ISSUES)))
    assert "RLIKE" in str(device.key_sentences(F.col("t"), 4)).upper()
    assert not textrank._DIGIT.search("no signal here") and textrank._bonus("no signal here") == 0 and textrank._bonus("on 2020. 5. 14.") == 0.15


def test_endings_are_cut_as_by_the_pattern(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("가나다", k=rng.randint(1, 3))) + rng.choice([*vocab.ENDINGS, "", "ab"]) + rng.choice(["", "", "\r", " ", "."]) for _ in range(2000)]
    endings = "|".join(sorted(set(vocab.ENDINGS), key=len, reverse=True))
    w = F.trim("w")
    plain = F.when(F.length(w) >= 3, F.regexp_replace(w, f"^(.{{2,}}?)(?:{endings})$", "$1")).otherwise(w)
    assert spark.createDataFrame([(w,) for w in words], "w string").filter(~X.strip_ending(F.col("w")).eqNullSafe(plain)).count() == 0


def test_words_with_a_syllable_are_those_of_the_split(spark):
    """Of texts with few words in Hangul among many others, also in one that is long; only these are cut out."""
    rng = random.Random(6)
    texts = ["", "가나", "abc", "x" * 3000] + ["".join(rng.choices(["증거능력", "상고를", "ab", "12", " ", ",", "·", "』", "\n", "x가", "é", "의", "《"], k=60)) for _ in range(200)] + ["ab cd " * 40_000 + "증거능력을 판단"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.k for r in rows.select(digest.scan_keywords(F.col("t"), 10**6).alias("k")).collect()]
    want = []
    for t in texts:
        words = {w for w in re.split(r"[ \n\t.,()\[\]「」『』《》〈〉·:;]+", t) if re.search("[가-힣]", w)}
        want.append(words)
    assert all(len(k) <= len(w) + 99 and ("증거능력" in k) == any(x.startswith("증거능력") and x[4:] in ("", "을", "를", "의") for x in w) for k, w in zip(got, want, strict=True))
    assert got[-1] == ["증거능력", "판단"]
