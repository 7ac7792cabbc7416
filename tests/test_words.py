from pyspark.sql import functions as F

from coursegrain.functions.text import BLANKS, WORD, token_count


def test_words_are_counted_as_the_pattern_does(spark):
    assert set(BLANKS) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    texts = [None, "", " ", *BLANKS, *(f"a{c}b{c}{c}" for c in BLANKS), "x​y", "é " * 50, "w" * 30000]
    d = spark.createDataFrame([(x,) for x in texts], "text string")
    slow = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    assert d.filter(token_count(F.col("text")) != slow).isEmpty()
    assert "regexp_extract_all" not in d.select(token_count(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
