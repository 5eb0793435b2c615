"""What larger tables ask of the queries: work on every core, answers that a memo does not change, words of great keys."""

import pytest

from verbaspark.operators import english, multilingual
from verbaspark.plans import sentences


@pytest.fixture(scope="module")
def great_parts(spark, tmp_path_factory):
    """Parts in one file of one split, with keys on both sides of a million."""
    sf = str(tmp_path_factory.mktemp("parts"))
    keys = "explode(array(0, 7, 101, 9999, 10000, 19999, 999999, 1000000, 1000001, 1000021, 1001000, 1020100, 1100000, 1199999))"
    spark.sql(f"SELECT {keys} AS k").selectExpr("CAST(k AS BIGINT) AS p_partkey", "CAST(k % 50 + 1 AS INT) AS p_size", "'SMALL TIN' AS p_type").coalesce(1).write.parquet(f"{sf}/part.parquet")
    return sf


def test_sentences_are_spread(spark, great_parts):
    cores = spark.sparkContext.defaultParallelism
    assert sentences.spoken(spark, great_parts, "en").rdd.getNumPartitions() >= cores
    assert sentences.spoken(spark, great_parts, "en").count() == 14 * len(sentences.cases("en"))


def test_memo_changes_no_answer():
    multilingual._remembered.cache_clear()
    texts = ["ab 12 cd", " $3.50 ", "", "  ", None, "x" * english.MEMO_CHARS + " 12", "ab 12 cd"]
    assert [multilingual.normalize_again(t, "en") for t in texts] == [multilingual.normalize_one(t, "en") for t in texts]
    assert [english.normalize_again(t) for t in texts] == [english.normalize_one(t) for t in texts]
    assert multilingual.normalize_again("ab 12 cd", "de") == "ab zwölf cd"
    assert multilingual._remembered.cache_info().hits == 1 and multilingual._remembered.cache_info().maxsize == english.MEMO


def test_words_beyond_the_twins(spark, great_parts):
    """The SQL twins count to 999,999 (Kinyarwanda: 9,999); the queries count on."""
    from verbaspark.functions import worldwords
    from verbaspark.plans import registry

    said = {lang: {r.p_partkey: r.words for r in registry.QUERIES[f"cardinal_{lang}"](spark, great_parts).collect()} for lang in ("ar", "hu", "hy", "it", "pt", "ru", "rw", "sv", "vi")}
    assert all(words == worldwords.words(n, lang) for lang, rows in said.items() for n, words in rows.items())
    assert said["vi"][1000001] == "một triệu linh một" and said["pt"][1001000] == "um milhão e mil" and said["ru"][1199999].startswith("один миллион сто девяносто девять тысяч ")
    assert said["rw"][10000] == "ibihumbi icumi"
    spoken = {r.p_partkey: r.spoken for r in sentences.spoken(spark, great_parts, "vi").where("kind = 'cardinal'").collect()}
    assert spoken == {n: f"ab {words} cd" for n, words in said["vi"].items()}
