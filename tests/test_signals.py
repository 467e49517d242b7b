import pytest
from pyspark.sql import functions as F

from quirespark.functions import signals as G


def one(spark, column, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_scripts_and_lost_characters(spark):
    assert one(spark, G.mixed_script_ratio, "Мocква и Рим", "Moscow", "", None) == [0.3333, 0.0, 0.0, 0.0]
    assert one(spark, G.private_use, "\ue001 a bullet\nlost \ue002 sign\ue003", " \ue001\nx", None) == [2, 0, 0]
    assert one(spark, G.foreign_script, "plain текст λόγος", "a ሀ and ଅ and த", "𝒜 ℵ µ º ˇc é́", None) == [0, 3, 0, 0]


def test_loops(spark):
    assert one(spark, G.letter_run, "a" * 45, "aab", "112233", "", None) == [45, 2, 0, 0, 0]
    assert one(spark, G.repeated_tail, "start " + "abc" * 25, "x" * 19, "x" * 20 + "\n\n", "done. " + "again and again " * 30, "list\n" + "." * 60, None) == [75, 0, 20, 480, 0, 0]


@pytest.mark.parametrize(("text", "n"), [("Сырны й комбина т", 1), ("и в с у", 0), ("5 м и 6 т", 0), ("кВт·ч", 0), ("см. стр. п.", 0), ("млн т зерна", 0), ("Д ом", 1), ("х леб", 1), ("е́хать", 0), ("5 т6", 1), (None, 0)])
def test_stray_letters(spark, text, n):
    assert one(spark, G.stray_letters, text) == [n]


def test_signs_and_leaders(spark):
    assert one(spark, G.capital_signs, "благочестивЪйшихЪ МИРЪ", None) == [2, 0]
    assert one(spark, G.unfinished_leaders, "Index ........\nA .... 5\nB . . . xii\nC ... d\nD ..... lost", None) == [2, 0]
    assert one(spark, G.numeric_lines, "12 14\na 5\n\n3.5", None) == [2, 0]


def test_remarks_of_a_model(spark):
    assert one(spark, G.partial_transcription, "text [remaining lines omitted]", "[omitted names] of", "a list [of names]", None) == [True, True, False, False]
    assert one(spark, G.model_commentary, "Page.\n\n*Note: the scan is too small to read.*", "Note the price.\n\nThe image was sold.", None) == [True, False, False]


def test_old_spelling_lost(spark):
    modern, old = "Писарь проверил список сборов в городе. " * 12, "Писарь провѣрилъ списокъ сборовъ въ городѣ. " * 12
    assert one(spark, G.historical_letters_lost, modern, old, "короткий", None) == [True, False, False, False]
